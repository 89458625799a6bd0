"""Iterative refinement against a plain loop over the same rows; registries; runs that were broken off."""

import math

import pytest
from pyspark.sql import functions as F

from folioforge.operators import refine
from folioforge.plans import refine_queries

SF = "/root/testdata/sf0.001"
FIELDS = ["title", "author", "year"]


def plain_loop(spark, rows, registry, plan, keep=None):
    """The same by a Python loop: only what the predictors say of a row is asked of Spark, row values at hand."""
    state = {r["id"]: r.asDict() | {"updated": 0} for r in rows.collect()}
    schema, best, number, told = rows.schema, 0.0, 0, []
    while number < plan.iterations and (plan.target is None or best < plan.target):
        number += 1
        worst = sorted(state.values(), key=lambda r: (r["confidence"], r["updated"], r["id"]))[: plan.batch]
        worst = [r for r in worst if keep is None or keep(r)]
        if not worst:
            break
        df = spark.createDataFrame([tuple(r[c] for c in schema.names) for r in worst], schema)
        said = {r.id: r for r in df.select("id", *[F.struct(p.confidence.alias("c"), *[v.alias(f) for f, v in p.fields.items()]).alias(n) for n, p in registry.predictors.items()]).collect()}
        new = {}
        for r in worst:
            found = [(said[r["id"]][n], p.weight) for n, p in registry.predictors.items()]
            weight = sum(w for s, w in found if s.c is not None)
            out = dict(r, updated=number, confidence=sum(s.c * w for s, w in found if s.c is not None) / weight if weight else r["confidence"])
            for f in FIELDS:
                if not out[f]:
                    out[f] = next((s[f] for s, _ in found if s.c is not None and s.c > 0.5 and f in s and s[f]), None)
            new[r["id"]] = out
        each = {"accuracy": [n["confidence"] for n in new.values()], "improvement": [float(n["confidence"] > state[i]["confidence"]) for i, n in new.items()], "completeness": [float(n["confidence"] >= 0.8) for n in new.values()]}[plan.metric]
        best = max(best, sum(each) / len(each))
        told.append(sum(each) / len(each))
        if number % plan.every == 0:
            state |= new
    return state, told


def same(got, want):
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert math.isclose(got[i].confidence, w["confidence"], abs_tol=1e-9), i
        assert all((got[i][f] or None) == (w[f] or None) for f in FIELDS) and got[i].updated == w["updated"], (got[i], w)


def read(df):
    return {r.id: r for r in df.collect()}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(refine_queries.predictions(spark, SF).collect(), refine_queries.predictions(spark, SF).schema)


def test_refinement_equals_a_plain_loop_and_goes_on_after_a_break(spark, rows, tmp_path):
    plan = refine.Plan(batch=70, iterations=5)
    want, told = plain_loop(spark, rows, refine.adapters(), plan)
    whole = refine.Refinement(spark, f"file://{tmp_path}/whole", "id", FIELDS)
    whole.start(rows)
    same(read(whole.run(refine.adapters(), plan)), want)
    assert [m["performance"] for m in whole.metrics()] == pytest.approx(told)
    sure = {i for i, w in want.items() if w["updated"] and w["confidence"] >= 0.8}
    assert sure <= set(read(whole.consolidated()))
    # a run of two iterations, then one that broke off after its rows were written, and the rest by another object
    first = refine.Refinement(spark, f"file://{tmp_path}/broken", "id", FIELDS)
    first.start(rows)
    first.run(refine.adapters(), refine.Plan(batch=70, iterations=2))
    rows.limit(3).write.parquet(f"file://{tmp_path}/broken/version=3")
    second = refine.Refinement(spark, f"file://{tmp_path}/broken", "id", FIELDS)
    second.start(rows.limit(0))
    same(read(second.run(refine.adapters(), plan)), want)
    assert len(second.metrics()) == 5


def test_stops_and_filters(spark, rows, tmp_path):
    def run(name, plan, **more):
        r = refine.Refinement(spark, f"file://{tmp_path}/{name}", "id", FIELDS)
        r.start(rows)
        return r, read(r.run(refine.adapters(), plan, **more))

    r, got = run("target", refine.Plan(batch=40, iterations=9, target=0.5))
    want, told = plain_loop(spark, rows, refine.adapters(), refine.Plan(batch=40, iterations=9, target=0.5))
    same(got, want)
    assert 0 < len(r.metrics()) == len(told) < 9
    r, got = run("time", refine.Plan(batch=40, seconds=0.0))
    assert not r.metrics() and not any(x.updated for x in got.values())
    r, _ = run("nothing", refine.Plan(batch=40, iterations=3), file_filter=F.lit(False))
    assert not r.metrics()
    plan = refine.Plan(batch=60, iterations=4, metric="improvement", every=2)
    r, got = run("filter", plan, file_filter=F.col("path").endswith(".pdf"))
    same(got, plain_loop(spark, rows, refine.adapters(), plan, lambda x: x["path"].endswith(".pdf"))[0])
    assert [m["kept"] for m in r.metrics()] == [False, True, False, True]


def test_a_registered_predictor_changes_the_ensemble(spark):
    df = spark.createDataFrame([(1, "a.pdf", None, 0.2), (2, "b.pdf", "kept", 0.4), (3, "c.pdf", "", 0.3)], "id int, path string, title string, confidence double")
    registry = refine.Registry()
    assert read(registry.apply(df, ["title"]))[1].confidence == 0.2
    registry.register("half", F.col("confidence") + 0.5, {"title": F.lit("half")}, weight=1.0)
    got = read(registry.apply(df, ["title"]))
    assert [(round(got[i].confidence, 9), got[i].title) for i in (1, 2, 3)] == [(0.7, "half"), (0.9, "kept"), (0.8, "half")]
    registry.register("picky", F.when(F.col("id") == 1, 0.1), {"title": F.lit("picky")}, weight=3.0)
    got = read(registry.apply(df, ["title"]))
    assert [round(got[i].confidence, 9) for i in (1, 2, 3)] == [0.25, 0.9, 0.8] and got[1].title == "half"
    registry.register("silent", F.lit(None).cast("double"))
    assert read(registry.apply(df, ["title"])) == got
    assert registry.unregister("half") and not registry.unregister("half")
    got = read(registry.apply(df, ["title"]))
    assert [round(got[i].confidence, 9) for i in (1, 2, 3)] == [0.1, 0.4, 0.3] and got[1].title is None
    assert sum(p.weight for p in refine.adapters().predictors.values()) == pytest.approx(8.4)


def test_registered_query_equals_the_plain_loop(spark, rows):
    plan = refine.Plan(batch=int(refine_queries.SHARE * rows.count()), iterations=refine_queries.ITERATIONS)
    want, _ = plain_loop(spark, rows, refine.adapters(), plan)
    got = read(refine_queries.x2_refined_predictions(spark, SF))
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert math.isclose(got[i].confidence, w["confidence"], abs_tol=2e-6) and got[i].updated == w["updated"]

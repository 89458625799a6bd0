"""Cosines by blocks of queries: brute force, bounds, and nothing shuffled for pairs."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioforge.operators import products, ranking

SF = "/root/testdata/sf0.001"


def brute_force(docs, asked, least):
    counts = {i: Counter(ws) for i, ws in docs if ws}
    df = Counter(w for c in counts.values() for w in c)
    idf = {w: math.log(len(docs) / n) if n < len(docs) else 0.1 for w, n in df.items()}

    def unit(words):
        c = Counter(words)
        v = {w: n / len(words) * idf[w] for w, n in c.items() if w in idf}
        return {w: x / math.sqrt(sum(y * y for y in v.values())) for w, x in v.items()}

    rows = {i: unit(ws) for i, ws in docs if ws}
    out = {}
    for q, ws in asked:
        v = unit(ws) if ws else {}
        out |= {(q, i): s for i, r in rows.items() if (s := sum(x * r.get(w, 0.0) for w, x in v.items())) >= least}
    return out


@pytest.mark.parametrize(("common", "block", "longest"), [(1 << 18, 1 << 19, 64), (7, 1 << 19, 64), (0, 40, 64), (1 << 18, 40, 3)])
def test_scan_search_equals_brute_force(spark, monkeypatch, common, block, longest):
    monkeypatch.setattr(products, "COMMON", common)
    monkeypatch.setattr(products, "BLOCK", block)
    monkeypatch.setattr(products, "LONGEST", longest)
    rng = random.Random(4)
    words = lambda n: [f"w{int(rng.paretovariate(0.5)) % 300}" for _ in range(n)] + ["all"]
    docs = [(i, words(rng.randrange(1, 15))) for i in range(150)] + [(900, ["only"]), (901, []), (902, None)]
    asked = [(i, words(rng.randrange(1, 9))) for i in range(30)] + [(50, ["only", "new"]), (51, ["unknown"]), (52, [])]
    frames = [spark.createDataFrame(x, "id long, words array<string>") for x in (asked, docs)]
    search = lambda **more: {(r.query, r.id): r.score for r in ranking.scan_search(*frames, F.col("words"), F.col("words"), "id", "id", 0.2, **more).collect()}
    wanted = brute_force(docs, asked, 0.2)
    got = search()
    assert got.keys() == wanted.keys() and all(got[p] == pytest.approx(s) for p, s in wanted.items())
    best = lambda found: {(q, i) for q in {q for q, _ in found} for _, i in sorted((-round(s, 9), i) for (p, i), s in found.items() if p == q)[:3]}
    few = search(k=3)
    assert few.items() <= got.items() and best(few) == best(wanted)


@pytest.mark.parametrize("name", ["q10_tfidf_search", "q11_semantic_score"])
def test_no_pair_of_a_search_is_shuffled(spark, name):
    from folioforge.plans import registry

    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_pairs_that_score_just_the_least_are_all_found(spark):
    content = lambda i: [f"house{i * i % 17}", f"{1980 + i * i % 23 % 13}", f"ext{i % 7 % 4}"]
    rows = [(i, content(i % 300)) for i in range(1200)]
    docs = spark.createDataFrame(rows, "id long, words array<string>")
    parts = {"title": (F.array().cast("array<string>"), 0.9), "content": (F.col("words"), 0.1)}
    found = ranking.weighted_search(docs.filter("id < 300"), docs, parts, "id", "id").collect()
    assert sorted((r.query, r.id) for r in found) == sorted((q, i) for q, x in rows[:300] for i, y in rows if x == y)
    assert all(r.score == pytest.approx(0.1) for r in found)

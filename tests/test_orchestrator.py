"""Staged search against an orchestrator in plain Python, over the rankers' own answers; how much each ranker is asked."""

import math

import pytest
from pyspark.sql import functions as F

from folioforge.operators import orchestrator as O
from folioforge.operators import ranking as R
from folioforge.plans import search_queries as Q
from folioforge.sources import derived as D

SF = "/root/testdata/sf0.001"
ORDER = ["fuzzy", "isbn", "semantic"]


@pytest.fixture(scope="module")
def world(spark):
    catalog = spark.createDataFrame(D.books(spark, SF).collect(), D.books(spark, SF).schema)
    queries = catalog.filter("id % 8 = 0").withColumn("query", F.col("id") + 1000)
    # some queries know less: no title, nobody, or no identifier
    k = F.col("id") % 5
    queries = queries.withColumns({"title": F.when(k != 1, F.col("title")), "authors": F.when((k == 1) | (k == 2), F.array().cast("array<string>")).otherwise(F.col("authors")), "isbn_raw": F.when(k == 3, "123").otherwise(F.col("isbn_raw"))})
    queries = spark.createDataFrame(queries.collect(), queries.schema)
    given = Q.orchestrator()
    answers = {}
    for name in ORDER:
        rows = R.top_k(given.rankers[name][0](queries, catalog).select("query", "id", "score"), 10).collect()
        for r in sorted(rows, key=lambda r: r["rank"]):
            answers.setdefault((name, r.query), []).append((r.id, float(r.score)))
    suited = {r.query: r.suited for r in given.prepared(queries).select("query", "suited").collect()}
    return catalog, queries, {r.id: r for r in catalog.collect()}, answers, suited


def alike(a, b):
    holds = lambda x, y: x in y or y in x
    if a.isbn_13 and a.isbn_13 == b.isbn_13:
        return True
    t, u = (a.title or "").lower(), (b.title or "").lower()
    x, y = ((c.authors[0] if c.authors else "").lower() for c in (a, b))
    return bool(t and u and (holds(t, u) or abs(len(t) - len(u)) <= 3) and x and y and holds(x, y))


def together(found, books):
    groups = []
    for name, i, s in found:
        for g in groups:
            if alike(books[g[0][1]], books[i]):
                g.append((name, i, s))
                break
        else:
            groups.append([(name, i, s)])
    out = [(min(1.0, sum(s for *_, s in g) / len(g)), max(g, key=lambda x: x[2])[1], sorted({n for n, *_ in g})) for g in groups]
    return [(i, s, n) for s, i, n in sorted(out, key=lambda x: -round(x[0], 12))[:10]]


def brute(world, strategy):
    _, _, books, answers, suited = world
    out, asked = {}, dict.fromkeys(ORDER, 0)
    for q, names in suited.items():
        seen = set()

        def ask(name, q=q, seen=seen):
            if name not in seen:
                seen.add(name)
                asked[name] += 1
            return [(name, i, s) for i, s in answers.get((name, q), [])]

        plain = lambda rows: [(i, s, [n]) for n, i, s in rows]
        how = ("best" if len(names) <= 1 else "parallel") if strategy == "auto" else strategy
        if how == "parallel":
            out[q] = together([x for n in ORDER if n in names for x in ask(n)], books)
        elif how == "best":
            out[q] = plain(ask(names[0])) if names else []
        elif how == "sequential":
            found = []
            for n in names:
                rows = ask(n)
                found += rows
                if rows and rows[0][2] >= 0.8:
                    out[q] = plain(rows)
                    break
            else:
                out[q] = together(found, books)
        else:
            rows = ask(names[0]) if names else []
            out[q] = plain(rows) if rows and rows[0][2] >= 0.9 else together([x for n in ORDER if n in names[:3] for x in ask(n)], books)
    return {q: rows for q, rows in out.items() if rows}, {n: c for n, c in asked.items() if c}


@pytest.mark.parametrize("strategy", ["parallel", "sequential", "best", "adaptive", "auto"])
def test_strategies_equal_a_plain_orchestrator(world, strategy):
    catalog, queries, *_ = world
    given = Q.orchestrator()
    got = {}
    for r in sorted(given.search(queries, catalog, strategy).collect(), key=lambda r: (r.query, r["rank"])):
        got.setdefault(r.query, []).append((r.id, r.score, r.algorithms))
        assert r["rank"] == len(got[r.query])
    want, asked = brute(world, strategy)
    assert got.keys() == want.keys()
    for q, rows in want.items():
        assert len(rows) == len(got[q])
        for (i, s, n), (a, b, c) in zip(rows, got[q], strict=True):
            assert (i, n) == (a, c) and math.isclose(s, b, abs_tol=2e-6), (q, rows, got[q])
    total = {}
    for n, c in given.trace:
        total[n] = total.get(n, 0) + c
    assert total == asked
    if strategy in ("sequential", "adaptive"):  # what is settled is not asked for again
        assert sum(total.values()) < sum(map(len, world[4].values()))


def test_registry_and_queries_that_suit_no_ranker(world):
    catalog, queries, *_ = world
    empty = O.Orchestrator()
    assert empty.search(queries, catalog).count() == 0 and not empty.trace
    given = Q.orchestrator()
    assert given.unregister("semantic") and not given.unregister("semantic")
    given.register("fuzzy", Q.lexical_ranker, F.lit(False))
    got = given.search(queries, catalog, "sequential")
    assert {a for r in got.collect() for a in r.algorithms} == {"isbn"}
    assert [n for n, _ in given.trace] == ["isbn"]
    with pytest.raises(ValueError, match="no such strategy"):
        given.search(queries, catalog, "guess")
    assert Q.orchestrator().search(queries.limit(0), catalog, "adaptive").count() == 0


def test_pruned_search_looks_at_few_postings(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from folioforge.functions import text as T

    rows, idf = R.vectors(docs, "doc_id", T.tokens(F.col("text")))
    rows.persist()
    asked, _ = R.vectors(D.search_queries(spark, SF), "item_id", T.tokens(F.col("q")), idf)
    terms = R.essential_terms(asked, rows, 0.1).collect()
    df = {r.term: r["count"] for r in rows.select(F.inline("entries")).groupBy("term").count().collect()}
    read, all_of = sum(df[t.term] for t in terms if t.essential), sum(df[t.term] for t in terms)
    assert read < 0.5 * all_of
    rows.unpersist()


@pytest.mark.parametrize("share", [False, True])
def test_overlap_search_equals_brute_force(spark, share):
    import random

    rng = random.Random(3)
    words = lambda n: sorted({f"w{int(rng.paretovariate(0.6)) % 40}" for _ in range(n)} | {"all"})
    docs = [(i, words(rng.randrange(1, 12))) for i in range(300)] + [(900, ["only"]), (901, [])]
    asked = [(i, words(rng.randrange(1, 9))) for i in range(20)] + [(50, ["only", "all"]), (51, ["unknown"]), (52, [])]
    got = R.most_shared(spark.createDataFrame(asked, "id long, words array<string>"), spark.createDataFrame(docs, "id long, words array<string>"), 7, share).collect()
    want = set()
    for q, a in asked:
        found = []
        for i, d in docs:
            both = len(set(a) & set(d))
            if both:
                found.append((-(both / len(set(a) | set(d)) if share else both), i))
        want |= {(q, i, n) for n, (_, i) in enumerate(sorted(found)[:7], 1)}
    assert {(r.query, r.id, r["rank"]) for r in got} == want


def test_equal_titles_are_searched_once(spark):
    """Copies of a title stand for one row of the search; the answers are those of all rows one by one."""
    titles = ["red ring", "red rod", "ring red old", "blue rod", "Red Ring"]
    rows = [(i, titles[i * 7 % 5]) for i in range(200)] + [(500, None)]
    catalog = spark.createDataFrame(rows, "id long, title string")
    queries = catalog.filter("id % 20 = 0 or id = 500").withColumn("query", F.col("id") + 1000)
    words = {i: set(t.lower().split()) for i, t in rows if t}
    want = set()
    for q in range(0, 200, 20):
        found = sorted((-round(len(words[q] & w) / len(words[q] | w), 6), i) for i, w in words.items() if words[q] & w)
        want |= {(q + 1000, i, -s) for s, i in found[:10]}
    assert set(map(tuple, Q.lexical_ranker(queries, catalog).collect())) == want
    seen = []

    def search(asked, texts):
        seen.append((asked.count(), sorted((r.text, r.id, r.copies) for r in texts.collect())))
        return asked.crossJoin(texts).select("query", "id", F.lit(1.0).alias("score"))

    text = F.lower("title").alias("text")
    given = catalog.filter("title is not null").select("id", text)
    got = R.search_texts(given.filter("id % 5 = 0").select(F.col("id").alias("query"), "text"), given, 3, search)
    assert {(r.query, r.id, r["rank"]) for r in got.collect()} == {(q, i, i + 1) for q in range(0, 200, 5) for i in range(3)}
    assert seen == [(1, [("blue rod", 4, 40), ("red ring", 0, 80), ("red rod", 3, 40), ("ring red old", 1, 40)])]


def test_idf_counts_the_rows_that_a_row_stands_for(spark):
    rows = [("red ring", 3), ("red rod", 1), ("old rod", 2)]
    whole = spark.createDataFrame([(10 * i + j, t) for i, (t, n) in enumerate(rows) for j in range(n)], "id long, text string")
    once = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(rows)], "id long, text string, copies long")
    words = F.split("text", " ")
    idf = lambda df, **more: sorted(map(tuple, R.term_weights(df, "id", words, **more)[1].collect()))
    assert idf(once, copies=F.col("copies")) == idf(whole)


def test_terms_are_counted_without_a_shuffle(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b", "b"]), (2, []), (3, None), (4, ["a"])], "id long, words array<string>")
    tf, idf = R.term_weights(rows, "id", F.col("words"))
    assert sorted(map(tuple, tf.collect())) == [(1, "a", 0.25), (1, "b", 0.75), (4, "a", 1.0)]
    assert {(r.term, r.df) for r in idf.collect()} == {("a", 2), ("b", 1)}
    assert "Exchange" not in tf._jdf.queryExecution().executedPlan().toString()

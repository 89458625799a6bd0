"""The fuzzy search against brute force."""

import random

import pytest

from folioforge.functions import similarity as S
from folioforge.plans import search_queries
from folioforge.sources import derived as D

SF = "/root/testdata/sf0.001"


def test_block_equals_one_by_one():
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcé ") for _ in range(rng.randrange(12))) for _ in range(300)]
    for asked in [*texts[:40], "", "a"]:
        assert S.jaro_winkler_block(asked, texts).tolist() == [S.jaro_winkler(asked, t) for t in texts]


@pytest.mark.parametrize("block", [1000, 40])
def test_fuzzy_search_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(search_queries, "BLOCK", block)
    titles = {r.id: r.title.lower() for r in D.books(spark, SF).filter("title is not null").collect()}
    want = set()
    for query in titles:
        if query % 50 == 0:
            scores = sorted((-round(S.jaro_winkler(titles[query] + "x", t), 6), i) for i, t in titles.items())
            want |= {(query, i, -s, n) for n, (s, i) in enumerate([x for x in scores if -x[0] >= 0.8][:10], 1)}
    got = search_queries.q6_fuzzy_search(spark, SF).select("query", "id", "score", "rank").collect()
    assert len(got) == len(want) > 20 and set(map(tuple, got)) == want


def test_bounds_lose_no_pair_and_spare_most(spark):
    from folioforge.operators import fuzzy

    rng = random.Random(8)
    words = ["red", "ring", "steel", "economy", "volume", "lemon", "x", "été"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 7))) for _ in range(500)] + ["", "a", "ab"]
    asked = [*texts[:40], "", "red rign", "volmue", "étè red"]
    counts, sizes, heads = fuzzy.letter_counts(texts), fuzzy.np.array([len(t) for t in texts]), fuzzy.heads_of(texts)
    looked = 0
    for a in asked:
        may = fuzzy.reachable(a, counts, texts, sizes, heads, 0.8)
        looked += may.sum()
        assert not [t for t, m in zip(texts, may, strict=True) if not m and S.jaro_winkler(a, t) >= 0.8]
    assert looked < 0.5 * len(asked) * len(texts)  # the share of pairs that are compared
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9000, None)], "id long, text string")
    queries = spark.createDataFrame(list(enumerate(asked)) + [(700, None)], "query long, asked string")
    want = {(q, i): round(S.jaro_winkler(a, t), 6) for q, a in enumerate(asked) for i, t in enumerate(texts) if round(S.jaro_winkler(a, t), 6) >= 0.8}
    got = {(r.query, r.id): r.score for r in fuzzy.fuzzy_search(queries, rows, 0.8, 30).collect()}
    assert got == want
    assert fuzzy.fuzzy_search(queries, rows.limit(0), 0.8).count() == 0

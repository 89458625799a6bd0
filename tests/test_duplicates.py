"""Classes of duplicates against the closure of the pairs' rule, and components against union-find."""

import random

from pyspark.sql import functions as F

from folioforge.operators import duplicates as U


def roots(ids, pairs):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {i: find(i) for i in ids}


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(2)
    path = [(i, i + 1) for i in range(0, 200)]
    star = [(1000, i) for i in range(1001, 1300)]
    loose = [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(180)]
    pairs = path + star + loose + [(3000, 3000), (3001, 3002), (3002, 3001), (3001, 3002)]
    rng.shuffle(pairs)
    names = list({i for p in pairs for i in p if p[0] != p[1]})
    got = {r["id"]: r["class"] for r in U.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == roots(names, [p for p in pairs if p[0] != p[1]])
    assert U.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_classes_equal_the_closure(spark):
    rng = random.Random(7)
    words = ["red", "ring", "steel", "a", "ox", "copper", "lemon", "volume"]
    people = ["Ana Silva", "Silva", "Bo", "B", "Ana Sil", "Chris Bo", "", None]
    rows = []
    for i in range(260):
        title = rng.choice([None, "", "a", "ox"] + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 15))) for _ in range(9)])
        rows.append((i, rng.choice([None, f"isbn{rng.randrange(150)}"]), title, [rng.choice(people)] if rng.random() < 0.9 else []))
    rows += [(900 + i, None, "the very same title", ["Twin"]) for i in range(20)]
    low = {i: (t or "").lower() for i, _, t, _ in rows}
    who = {i: (a[0] or "").lower() if a else "" for i, _, _, a in rows}
    isbn = {i: n for i, n, _, _ in rows}
    holds = lambda x, y: x in y or y in x

    def alike(a, b):
        if isbn[a] and isbn[a] == isbn[b]:
            return True
        return bool(low[a] and low[b] and who[a] and who[b] and holds(who[a], who[b]) and (holds(low[a], low[b]) or abs(len(low[a]) - len(low[b])) <= 3))

    ids = [r[0] for r in rows]
    want = roots(ids, [(a, b) for a in ids for b in ids if a < b and alike(a, b)])
    df = spark.createDataFrame(rows, "id long, isbn_13 string, title string, authors array<string>")
    got = {r["id"]: (r["class"], r["size"]) for r in U.classes(df).collect()}
    assert {i: c for i, (c, _) in got.items()} == want
    assert all(n == sum(x == c for x in want.values()) for c, n in got.values())
    assert U.classes(df.limit(0)).count() == 0
    # links stay few: no pairs of a group
    assert U.links(df).count() < 12 * len(rows)


def test_classes_derive_the_books_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(title):
        read.add(1)
        return title

    rows = [(i, f"978{i:010d}", f"red ring volume {i % 5}", ["Ana Silva"]) for i in range(40)]
    books = spark.createDataFrame(rows, "id long, isbn_13 string, title string, authors array<string>")
    books = books.withColumn("title", F.udf(seen, "string").asNondeterministic()("title"))
    assert U.classes(books).count() == 40 and read.value == 40

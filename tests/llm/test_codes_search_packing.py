"""Vector codes, windowed search and packing against brute force."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from folioforge.llm import lexical_search, packing, vector_codes
from folioforge.llm import queries as llm_queries

SF = "/root/testdata/sf0.001"


def brute_codes(rows, entries=256, rounds=4, parts=4, scale=1024):
    """rows: (id, vector, label); the same by plain integers, all distances."""
    kept = [(i, [math.floor(scale * x) for x in v], l) for i, v, l in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], []
    width = len(kept[0][1]) // parts
    cut = lambda v: [tuple(v[p * width : (p + 1) * width]) for p in range(parts)]
    seeds = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v)[p] for _, v, _ in seeds] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))  # noqa: E731, B905
    assign = lambda v: [min((far(x, e), k) for k, e in enumerate(book)) for x, book in zip(cut(v), books)]  # noqa: E731, B905
    for _ in range(rounds):
        sums = {}
        for _, v, _ in kept:
            for p, (_, k) in enumerate(assign(v)):
                sums.setdefault((p, k), []).append(cut(v)[p])
        for (p, k), got in sums.items():
            books[p][k] = tuple(sum(x) // len(got) for x in zip(*got))  # noqa: B905
    last = [(i, assign(v), l) for i, v, l in kept]
    total = Counter()
    for _, a, l in last:
        total[l] += sum(d for d, _ in a)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in a), sum(d for d, _ in a), total[l], sha) for i, a, l in last], books


def codes_of(spark, rows, kind="array<double>"):
    df = spark.createDataFrame([(i, v, l, "x", 1, "y") for i, v, l in rows], f"vec_id bigint, embedding {kind}, label int, code string, error int, x string")
    return [tuple(r) for r in vector_codes.compressed(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()]


def test_exponion_codes_equal_brute_force(spark):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(40)]
    rows = [(i * 3, [x + rng.gauss(0, 0.2) for x in rng.choice(centres)], rng.choice([0, 1, None])) for i in range(700)]
    rows += [(i, [rng.randrange(-2, 3) / 1024 for _ in range(8)], 7) for i in range(5000, 5200)]  # ties
    rows += [(6000 + i, list(centres[0]), 0) for i in range(150)] + [(3, list(centres[1]), 0), (None, list(centres[2]), 1)]
    rows += [(1, None, 0), (2, [], 0), (4, [1.0, None] * 4, 0), (5, [1.0, float("nan")] * 4, 0), (7, [float("inf")] * 8, 0), (8, [1.0] * 7, 0)]
    want, _ = brute_codes([r for r in rows if r[1] is None or len(r[1]) != 7])
    assert sorted(codes_of(spark, rows), key=repr) == sorted(want, key=repr)


def test_exponion_codes_of_few_equal_huge_and_no_vectors(spark):
    few = [(i, [float(i % 3), 0.0, -1.0, 2.5], 1) for i in range(9)]
    assert sorted(codes_of(spark, few)) == sorted(brute_codes(few)[0])
    assert codes_of(spark, []) == [] and codes_of(spark, [(1, None, 1)]) == []
    huge = [(1, [1e300, -1e300, 3e8, 0.0] * 4, 1), (2, [0.0] * 16, 1), (3, [1e300] * 16, None)]
    got = {r[0]: r for r in codes_of(spark, huge)}
    assert len(got) == 3 and all(r[2] == 0 for r in got.values())
    wide = [(i, [float(random.Random(i).randrange(-(10**5), 10**5)) for _ in range(16)], 0) for i in range(300)]  # beyond what doubles hold exactly
    assert sorted(codes_of(spark, wide)) == sorted(brute_codes(wide)[0])


def test_the_search_looks_at_few_entries_and_misses_none():
    rng = np.random.default_rng(2)
    centres = rng.integers(-2000, 2000, (64, 4))
    book = vector_codes.Codebook(np.vstack([centres, centres[:9]]))  # equal entries: the lower index wins
    parts = centres[rng.integers(0, 64, 3000)] + rng.integers(-60, 60, (3000, 4))
    far = ((parts[:, None, :] - book.entries[None]) ** 2).sum(axis=2)
    for start in (np.zeros(3000, np.int64), far.argmin(axis=1), rng.integers(0, 73, 3000), np.full(3000, 70)):
        code, best = book.nearest(parts, start)
        assert (code == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()


def brute_search(docs, items, top=20):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    counts = [(i, Counter(words(t))) for i, t in docs if words(t)]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in counts:
            m = 75 + 25 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in words(text) if t in c)
            if s > 0:
                found.append((-s, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("block", "window"), [(2**21, 4096), (60, 7)])
def test_windowed_search_equals_brute_force(spark, monkeypatch, block, window):
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", block)
    monkeypatch.setattr(lexical_search, "WINDOW", window)
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(["Alpha", "beta", "gamma-ray", "É", "delta", "été", "x1", "the", "the", "the"]) for _ in range(n))
    docs = [(i, text(rng.randrange(1, 30))) for i in range(120)] + [(200 + i, "the same words twice") for i in range(60)]
    docs += [(1, None), (2, ""), (3, "-- !"), (5, text(4)), (None, "alpha beta"), (None, "alpha beta"), (300, "word " * 60_000 + "delta"), (2**62 + 1, "été x1")]
    items = [(1, "alpha the été É"), (2, "the the same beta"), (3, None), (4, ""), (5, "nothing here is known"), (6, "delta delta x1 gamma ray")]
    d = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], "doc_id bigint, text string, rank int, item_id string, score int").repartition(5)
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, doc_id string")
    got = lexical_search.search(d, q)
    assert sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == brute_search(docs, items)
    assert lexical_search.search(d.limit(0), q).count() == 0 and lexical_search.search(d, q.limit(0)).count() == 0


def test_windowed_search_equals_its_sql(spark):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = llm_queries.op12_windowed_scoring(spark, SF)
    assert sorted(tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()) == sorted(duck.execute(lexical_search.SQL).fetchall())


def brute_cuts(places, penalty, length, least):
    best = [0] + [None] * (len(places) - 1)
    for j in range(1, len(places)):
        for i in range(j):
            n = int(places[j] - places[i])
            if n <= length and best[i] is not None:
                cost = best[i] + int(penalty[j]) + (0 if n >= least and n & (n - 1) == 0 else length - n)
                best[j] = cost if best[j] is None else min(best[j], cost)
    return best


def test_cuts_cost_the_least():
    rng = random.Random(6)
    for _ in range(60):
        places = np.cumsum([0] + [rng.randint(1, 9) for _ in range(80)])
        penalty = np.array([rng.choice([0, 3, 11]) for _ in places])
        f, before = packing.solve(places, penalty, 32, 4)
        assert f == brute_cuts(places, penalty, 32, 4)
        path = packing.way(before, len(places) - 1)
        assert path[0] == 0 and all(places[b] - places[a] <= 32 for a, b in zip(path, path[1:]))  # noqa: B905
    for rest in range(1, 4097):
        sizes = packing.splits(rest, 4096)
        padded = [0 if n & (n - 1) == 0 else 4096 - n for n in sizes]
        assert sum(sizes) == rest and sum(padded) + packing.HARD_CUT * (len(sizes) - 1) <= (0 if rest & (rest - 1) == 0 else 4096 - rest)


def packed_and_checked(spark, docs, **options):
    """Packs, and checks what must always hold; gives the rows by sequence."""
    from tokenizers import Tokenizer

    direct = Tokenizer.from_file(packing.vocabulary_file())
    ids = {i: [*direct.encode(t or "", add_special_tokens=False).ids, packing.END] for i, t in docs}
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id bigint, text string, start string, length int").repartition(2)
    rows = packing.pack(df, **options).collect()
    length = options.get("length", packing.LENGTH)
    pieces, by = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        by.setdefault(r.sequence_id, []).append(r)
        assert len(r.tokens) == 4 * r.length and r.doc_tokens == len(ids[r.doc_id])
    assert pieces.keys() == ids.keys()
    for i, own in pieces.items():
        own.sort(key=lambda r: r.start)
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]]
        assert list(struct.unpack(f"<{len(ids[i])}I", b"".join(bytes(r.tokens) for r in own))) == ids[i]
    for own in by.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]] and sum(r.length for r in own) <= length
    return rows, by


def test_packing_of_odd_texts(spark):
    rng = random.Random(9)
    words = ["Hello,", "don't", "WE'LL", "naïve", "İstanbul", "ΣΊΣΥΦΟΣ", "été", "x y", "1234", "a_b", "<|endoftext|>", "a<|endoftext|>b", "--", "...", "日本。", "🙂🙂", "end.", "\x1c", "a\x85b", "word;:", "Abc!?"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(150)]
    docs += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "x" * 5000), (1004, "go " * 30_000), (1005, "go. " * 9000), (1006, "́ combining"), (1007, "a\n\nb\r\nc")]
    packed_and_checked(spark, docs)
    packed_and_checked(spark, docs, length=64)
    same = spark.createDataFrame([(7, "same text.")] * 3 + [(None, "no id")], "doc_id bigint, text string")
    got = packing.pack(same).collect()
    assert sorted(str(r.doc_id) for r in got if r.start == 0) == ["7", "7", "7", "None"]
    assert packing.pack(same.limit(0)).count() == 0


def test_packing_in_blocks_keeps_order_and_pads_little(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 9000)
    docs = [(r[0], r[1]) for r in duckdb.connect().execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()]
    rows, by = packed_and_checked(spark, docs)
    used = sum(r.length for r in rows)
    padded = sum(0 if (n := sum(r.length for r in own)) & (n - 1) == 0 else packing.LENGTH - n for own in by.values())
    assert padded < 0.01 * used
    whole = packing.sequences(packing.pack(spark.createDataFrame(docs, "doc_id bigint, text string"))).collect()
    for r in whole:
        assert len(r.tokens) == 4 * (r.n_tokens if r.n_tokens & (r.n_tokens - 1) == 0 else packing.LENGTH)
    assert sum(r.n_tokens for r in whole) == used


def test_packing_query_gives_checksums(spark):
    got = llm_queries.op13_monotone_packing(spark, SF)
    want = {(r.doc_id, r.start): zlib.crc32(r.tokens) for r in packing.pack(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert {(r.doc_id, r.start): r.ids_crc32 for r in got.collect()} == want

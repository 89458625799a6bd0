"""Operators over the corpus: URL cascade, Jaccard join, line dedup, language model, and the pipeline."""

import collections
import hashlib
import math
import random
import zlib

import duckdb
import pytest

from folioforge.llm import components, line_dedup, minhash_forest, suffix_tree_lm, url_cascade
from folioforge.llm import queries as llm_queries
from folioforge.llm.common import plain_words

SF = "/root/testdata/sf0.001"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1.5) for i, t in rows], "doc_id bigint, text string, class_id string, score double")


@pytest.mark.parametrize("name", sorted(llm_queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = llm_queries.queries()[name](spark, SF)
    found = c.execute(llm_queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    order = [names.index(x) for x in df.columns]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=repr)


def test_cascade_is_exact(spark, monkeypatch):
    urls = [f"http://H{i % 50}.example.ORG/fr/{i}?x" for i in range(3000)] + [None, "", "no scheme", "x://", "a://b#c", "http://a.com/en/1", "http://xcom/en/1", "https://example.com/en/77", "http://b.example.net/de/8x", "http://b.net/de/8"]
    pages = spark.createDataFrame([(i, u, "verdict") for i, u in enumerate([*urls, *urls[:5]])], "page_id bigint, url string, verdict string")
    listed = {f"h{i % 50}.example.org/fr/{i}" for i in range(0, 3000, 3)}
    given = spark.createDataFrame([(k,) for k in [*listed, None, "elsewhere/"]], "key string")
    got = url_cascade.cascade_filter(pages, given).collect()
    assert len(got) == len(urls) + 5
    for r in got:
        assert r.verdict == {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block"}.get(r.rule, "block" if r.host + r.path in listed else "allow")
    by = {r.page_id: r for r in got}
    assert [(by[i].host, by[i].path) for i in (3000, 3002, 3003, 3004)] == [("", ""), ("", ""), ("", ""), ("b", "")]
    assert [by[i].rule for i in range(3005, 3010)] == ["com/en/", None, "example.com/en/7", "example.net/de/8", "net/de/"]
    monkeypatch.setattr(url_cascade, "MAX_BITS", 12_000)  # several shards give the same
    assert sorted(map(tuple, url_cascade.cascade_filter(pages, given).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert url_cascade.cascade_filter(pages, given.filter("false")).filter("verdict = 'block' and rule is null").count() == 0
    assert url_cascade.cascade_filter(pages.filter("false"), given).count() == 0


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = plain_words((t or "").encode())
        out[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    return out


def test_jaccard_join_against_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"v{i}" for i in range(500)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice((3, 30, 90)))]
        for _ in range(rng.choice((1, 2, 5, 90 if g == 0 else 4))):
            copy = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 3))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    rows += [(1000, None), (1001, ""), (1002, "..."), (1003, "...")]
    sets = sets_of(rows)
    near = {(a, b) for a in sets for b in sets if a != b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    least = {i: i for i in sets}
    for _ in sets:
        for a, b in near:
            least[a] = least[b] = min(least[a], least[b])
    degree = collections.Counter(a for a, _ in near)
    want = sorted((i, least[i], degree[i]) for i in sets)
    docs = docs_of(spark, rows)
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in minhash_forest.jaccard_join(docs).collect()) == want
    monkeypatch.setattr(minhash_forest, "SMALL", 8)  # crowded groups: whole paths first, then shorter prefixes, in blocks
    monkeypatch.setattr(minhash_forest, "BLOCK", 4)
    monkeypatch.setattr(minhash_forest, "LARGE_BLOCK", 6)
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in minhash_forest.jaccard_join(docs).collect()) == want
    kept = minhash_forest.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({least[i] for i in sets})


def test_jaccard_join_odd_rows(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text), (1, text), (None, text.upper()), (2, "one two"), (3, "One, two!"), (4, " ".join(f"w{i}" for i in range(30_000)))]
    got = sorted(((str(r.doc_id), str(r.class_id), r.n_links) for r in minhash_forest.jaccard_join(docs_of(spark, rows)).collect()))
    assert got == sorted([("1", "None", 2), ("1", "None", 2), ("None", "None", 2), ("2", "2", 1), ("3", "2", 1), ("4", "4", 0)])
    assert minhash_forest.jaccard_join(docs_of(spark, [])).count() == 0 and minhash_forest.levels() == [10, 9, 8, 7, 6]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 7), (200, 201), (201, 200), (5, 5)]
    got = {r.a: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 100: 0, 201: 200}


def within_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("letters,low,high", [("ab", 1, 9), ("abé", 14, 60)])
def test_line_dedup_against_brute_force(spark, letters, low, high):
    rng = random.Random(high)
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(30)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(3):
            x = list(rng.choice(base))
            at, kind = rng.randrange(len(x)), rng.randrange(5)
            if kind == 0:
                x[at] = rng.choice(letters)
            elif kind == 1:
                x.insert(at, rng.choice(letters))
            elif kind == 2 and len(x) > 1:
                del x[at]
            lines.append("".join(x))
        docs.append((i, "\n".join([*lines, " "])))
    first = {}
    for d, t in docs:
        for n, line in enumerate(t.split("\n")):
            first.setdefault(line, (d, n))
    stays = lambda d, n, x: x == " " or (first[x] == (d, n) and not any(first[y] < (d, n) and y not in (x, " ") and within_one(x, y) for y in first))
    want = {d: "\n".join(x for n, x in enumerate(t.split("\n")) if stays(d, n, x)) for d, t in docs}
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(docs_of(spark, docs), near_chars=1).collect()}
    assert got == want


def test_line_dedup_odd_rows(spark):
    long = "long line " * 3000
    rows = [(1, "a line of some length\n\n}\nb"), (2, "a line of some lengths\n}\nnew words in this line"), (3, None), (4, ""), (5, "same row twice here"), (5, "same row twice here"), (None, "null id comes first here"), (6, "null id comes first here"), (7, long), (8, long + "x")]
    docs = docs_of(spark, rows)
    got = line_dedup.line_dedup(docs)
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == sorted(
        [("1", rows[0][1]), ("2", "new words in this line"), ("3", "None"), ("4", ""), ("5", rows[4][1]), ("5", rows[4][1]), ("None", rows[6][1]), ("6", ""), ("7", long), ("8", "")]
    )
    assert sorted(str(r.doc_id) for r in line_dedup.keep_first_lines(docs).collect()) == sorted(["1", "2", "3", "4", "5", "5", "7", "None"])
    assert line_dedup.dedup_report(docs).count() == len(rows) and line_dedup.dedup_report(docs.filter("false")).count() == 0


def test_language_model(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(vocabulary[: 300 - i % 40]) for _ in range(rng.randrange(0, 60)))) for i in range(120)] + [(500, None), (501, ""), (502, "ÉTÉ É\xa0b " + "z" * 9000), (503, "A a"), (503, "A a")]
    train = collections.Counter()
    low = lambda t: (t or "").encode().lower().split() + [None]
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            train.update(low(t))
    n, v = sum(train.values()), len(train)
    for hot in (1 << 18, 40):  # all counts broadcast, or most of them joined
        monkeypatch.setattr(suffix_tree_lm, "HOT", hot)
        got = suffix_tree_lm.lm_scores(docs_of(spark, rows)).collect()
        want = sorted((i, zlib.crc32(str(i).encode()) % 7 == 2, len(low(t)), sum(train[w] > 0 for w in low(t)), n, round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in low(t)), 6)) for i, t in rows)
        assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(r.score < 0 for r in got)
    assert suffix_tree_lm.lm_scores(docs_of(spark, [])).count() == 0


def test_terms_beyond_the_broadcast_bound_are_joined(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)
    want = sorted((r.doc_id, round(r.score, 5), round(r.base_score, 5)) for r in suffix_tree_lm.lm_scores(docs).collect())
    monkeypatch.setattr(suffix_tree_lm, "HOT", 40)
    assert sorted((r.doc_id, round(r.score, 5), round(r.base_score, 5)) for r in suffix_tree_lm.lm_scores(docs).collect()) == want


def test_broadcast_terms_reach_the_driver_as_arrow(spark, monkeypatch):
    docs = docs_of(spark, [(i, "a b c d " * 20) for i in range(30)])
    monkeypatch.setattr(type(docs), "toPandas", lambda df: pytest.fail("an object for each row on the driver"))
    assert suffix_tree_lm.lm_scores(docs).count() == 30


def chains(n, length, seed=1):
    """Texts of which each word depends on the two before it: the same words follow after 'a b', others after 'b b'."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [rng.randrange(12), rng.randrange(12)]
        while len(words) < length:
            words.append((3 * words[-1] + 5 * words[-2] + rng.randrange(2)) % 12)
        out.append((i, " ".join(f"w{'abcdefghijkl'[w]}" for w in words)))
    return out


def test_language_model_knows_sequences(spark, monkeypatch):
    rows = chains(400, 40)
    rng = random.Random(2)
    shuffled = []
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 == 2:
            words = t.split()
            rng.shuffle(words)
            shuffled.append((i, " ".join(words)))
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    own = {r.doc_id: r for r in suffix_tree_lm.lm_scores(docs_of(spark, rows)).collect() if r.held_out}
    other = {r.doc_id: r for r in suffix_tree_lm.lm_scores(docs_of(spark, train + shuffled)).collect() if r.held_out}
    assert len(own) > 30 and own.keys() == other.keys()
    for i, r in own.items():
        assert r.base_score == pytest.approx(other[i].base_score)
        assert r.score > other[i].score + 5 and r.score > r.base_score + 5
    monkeypatch.setattr(suffix_tree_lm, "HOT", 40)  # most terms joined
    cold = {r.doc_id: r.score for r in suffix_tree_lm.lm_scores(docs_of(spark, rows)).collect() if r.held_out}
    assert cold == pytest.approx({i: r.score for i, r in own.items()})


def test_contexts_of_words_equal_brute_force(spark):
    rows = chains(150, 30, seed=3)
    train = [["", *t.split(), ""] for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = collections.defaultdict(collections.Counter)
    for words in train:
        for i in range(1, len(words)):
            for d in range(0, i + 1):
                counts[tuple(words[i - d : i])][words[i]] += 1
    total = {c: sum(x.values()) for c, x in counts.items()}
    least = suffix_tree_lm.LEAST_COUNT
    told = {c: {w: n for w, n in x.items() if n >= suffix_tree_lm.CUT and counts[()][w] >= least} for c, x in counts.items()}
    tokens, types = total[()], len(counts[()])
    nodes, tells, counted = {()}, set(), {()}

    def p(word, context):
        """The probability by the longest node that is a suffix of the context."""
        out = (counts[()][word] + 1) / (tokens + types + 1)
        for d in range(1, len(context) + 1):
            c = tuple(context[-d:])
            if c not in nodes:
                break
            if c in tells:
                pool = total[c] - sum(told[c].values()) + len(told[c])
                out = (told[c].get(word, 0) + pool * out) / (total[c] + len(told[c]))
        return out

    for c in sorted(counts, key=len):
        if c and c[1:] in nodes and c[:-1] in counted and total[c] >= least:
            counted.add(c)
            rest, size = total[c] - sum(told[c].values()), total[c] + len(told[c])
            pool = rest + len(told[c])
            gain = rest * math.log(pool - 1) if rest and told[c] else 0
            for w, n in told[c].items():
                up = p(w, c[1:])
                gain += n * math.log(((n - 1 if n > suffix_tree_lm.CUT else 0) + pool * up) / up)
            if told[c] and gain - total[c] * math.log(size - 1) >= max(suffix_tree_lm.LEAST_GAIN, suffix_tree_lm.LEAST_MEAN * total[c] * (len(c) > 1)):
                tells.add(c)
            if c in tells or len(c) == 1:
                nodes.add(c)
    assert max(map(len, tells)) >= 2
    some = [c for c in tells if len(c) == 2][:5] + [()]
    for c in some:  # with one unknown word for all, it is a distribution
        assert sum(p(w, c) for w in [*counts[()], "unknown"]) == pytest.approx(1)
    got = {r.doc_id: r.score for r in suffix_tree_lm.lm_scores(docs_of(spark, rows)).collect()}
    want = {}
    for i, t in rows:
        words = ["", *t.split(), ""]
        want[i] = sum(math.log10(p(words[j], words[:j])) for j in range(1, len(words)))
    assert got == pytest.approx(want)


def test_filters_of_the_suffix_tree_only_save_work(spark, monkeypatch):
    """With filters that pass everything the scores are the same: rare words are told apart by no context."""
    rng = random.Random(6)
    rows = [(i, f"{t} {rng.choice('xyz')}{i // 3}" if i % 2 else f"r{i // 5} {t}") for i, t in chains(200, 30, seed=5)]
    want = {r.doc_id: r.score for r in suffix_tree_lm.lm_scores(docs_of(spark, rows)).collect()}
    made = suffix_tree_lm.Filter.__init__

    def full(self, *args, **kwargs):
        made(self, *args, **kwargs)
        self.bits[:] = 255

    monkeypatch.setattr(suffix_tree_lm.Filter, "__init__", full)
    assert {r.doc_id: r.score for r in suffix_tree_lm.lm_scores(docs_of(spark, rows)).collect()} == pytest.approx(want)


def test_held_out_texts_score_above_base(spark):
    """Of prose that repeats nothing the contexts may tell little, but they do no harm."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = suffix_tree_lm.lm_scores(docs).filter("held_out").selectExpr("sum(score) AS score", "sum(base_score) AS base").first()
    assert held.score > held.base


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "decontamination", "sentencepiece"]
    done = corpus_pipeline.run(spark, SF)
    assert done.columns == ["doc_id", "n_tokens", "exact", "ids"] and 0 < done.count() < docs.count()
    assert done.filter("not exact").count() == 0
    odd = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "a few words", "en", "s", 9), (None, "a few words", "en", "s", 9)], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SF).count() == 4
        assert stage(spark, odd.filter("false"), SF).count() == 0


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline
    from folioforge.llm import sentencepiece_viterbi, toxicity
    from folioforge.llm.common import read, written
    from tests.llm.test_row_operators import brute_overlap

    docs = read(spark, SF, "documents")
    outs = []
    for _, stage in corpus_pipeline.STAGES:
        outs.append(written(stage(spark, outs[-1] if outs else docs, SF)))
    rows = [{r.doc_id: r.text for r in df.collect()} for df in (docs, *outs[:4])]
    assert all(df.columns == docs.columns for df in outs[:4])
    scores = {r.doc_id: r.score for r in toxicity.toxicity(docs, read(spark, SF, "labels")).collect()}
    assert set(rows[1]) == {i for i, x in scores.items() if x < 0.7} and rows[1].items() <= rows[0].items()
    # line dedup: a line goes if an earlier one equals it, or is within one edit and both are long enough
    first, blank = {}, " \t\n\x0b\f\r"
    for i in sorted(rows[1]):
        for n, line in enumerate(rows[1][i].split("\n")):
            if line.strip(blank):
                first.setdefault(line, (i, n))
    by_size = collections.defaultdict(list)
    for line in first:
        by_size[len(line)].append(line)
    near = {x for x in first if len(x) >= 12 and any(first[y] < first[x] and y[:3] + y[-3:] != "" and x != y and (y[: len(x) // 2] == x[: len(x) // 2] or y[-(len(x) // 2) :] == x[-(len(x) // 2) :]) and within_one(x, y) for n in (-1, 0, 1) for y in by_size[len(x) + n] if len(y) >= 12)}
    want = {}
    for i, t in rows[1].items():
        kept = [x for n, x in enumerate(t.split("\n")) if not x.strip(blank) or (first[x] == (i, n) and x not in near)]
        if any(x.strip(blank) for x in kept) or len(kept) == len(t.split("\n")):
            want[i] = "\n".join(kept)
    assert rows[2] == want
    # Jaccard join: the first of each component
    sets = {i: x for i, x in sets_of(rows[2].items()).items()}
    least = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for _ in range(len(sets)):
        before = dict(least)
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
        if before == least:
            break
    assert set(rows[3]) == set(least.values())
    # decontamination: a run that counts begins with three equal words, unless the item is shorter
    items = [plain_words(r.text.encode()) for r in read(spark, SF, "benchmark").collect() if r.text]
    starts = collections.defaultdict(set)
    for k, item in enumerate(items):
        for j in range(len(item) - 2):
            starts[tuple(item[j : j + 3])].add(k)
    bad = set()
    for i, t in rows[3].items():
        words = plain_words((t or "").encode())
        due = set().union(*[starts.get(tuple(words[j : j + 3]), set()) for j in range(len(words) - 2)])
        if any(brute_overlap(words, items[k]) for k in due):
            bad.add(i)
    assert set(rows[4]) == set(rows[3]) - bad
    # tokens: each kept text comes back from its ids
    back = {r.doc_id: r.text for r in sentencepiece_viterbi.decode(outs[4]).collect()}
    assert back == rows[4]


def test_digest_of_dedup(spark):
    row = line_dedup.dedup_report(docs_of(spark, [(1, "x\ny"), (2, "x")])).filter("doc_id = 2").first()
    assert (row.n_lines, row.n_exact, row.n_near, row.n_kept, row.text_sha256) == (1, 1, 0, 0, hashlib.sha256(b"").hexdigest())


def test_shuffle_files_of_the_suffix_tree_go_with_each_action(spark):
    import glob

    from folioforge.llm import common
    from pyspark.sql import functions as F

    folders = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*.data")}
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = files(), spark.conf.get(name)
    with common.shuffles_go(spark):
        out = common.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert not files() - before and out.count() == 7 and spark.conf.get(name) == was

"""Line dedup by a deletion-neighbourhood join, with DataFrame functions only.

Lines are split at newlines; only lines with a word take part, all others stay. A line goes if an earlier line of the corpus
equals it or, if both have NEAR_CHARS characters, is within an edit distance of 1 (a character inserted, deleted or
substituted); order is (id, text hash, line number). That the earlier line may go as well makes no difference.

1. Every line is known by a 128-bit hash; equal lines meet in an aggregate of hashes, not of texts.
2. Gates drop distinct lines that can have no neighbour. Of two lines at distance 1, either the first or the last `half`
   characters are equal, where `half` is half of the least length of their length class (powers of two); all but one of
   PARTS parts are equal; and within that part all but one of its small parts. Each gate hashes what must be equal.
3. Where the last gate leaves two lines, each gives its deletion neighbourhood in the small part as hashed keys. Two lines of
   one length that differ in one place are equal without that place; a line equals a longer one without one place. Keys hold
   the place and all around it, so that equal keys mean distance 1, and each key needs only its earliest line, not its pairs.
4. The earliest line found for each is verified by its edit distance, and the lines that go are cut out of the texts.

Null and empty texts have no lines and stay as they are. Repeated rows (equal id and text) are treated alike: their lines do
not count as earlier than one another. Other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, written
from .url_cascade import perhaps

#: Characters that make no word.
BLANK = " \\t\\n\\x0B\\f\\r"
EDITS = 1
#: Parts of a line outside one of which two lines must be equal; and of such a part in turn, at most so many of so many characters.
PARTS, FINE_PARTS, FINE_CHARS = 8, 64, 4
#: Lines shorter than this are dropped only where an earlier line equals them: one edit would change too much of them.
NEAR_CHARS = 12


def line_hash(line: Column) -> tuple[Column, Column]:
    return F.xxhash64(line), F.xxhash64(F.lit(7), line)


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """d, k (the text's hash), n (line number), line: the lines with a word."""
    text = F.col(text_col)
    split = docs.select(F.col(id_col).alias("d"), F.xxhash64(text).alias("k"), F.posexplode(F.split(text, "\n")).alias("n", "line"))
    return split.filter(F.col("line").rlike(f"[^{BLANK}]"))


def length_class(n: Column) -> Column:
    """The largest power of two up to n (1 for 0)."""
    return F.call_function("shiftleft", F.lit(1), (F.length(F.bin(F.greatest(n, F.lit(1)))) - 1).cast("int"))


def gate_keys(line: Column) -> Column:
    """Hashes of the line's ends: for its length's class and, where the length starts a class, for the class below."""
    n = F.length(line)
    ends = lambda c: [F.xxhash64(F.lit(s), c, part) for s, part in ((0, F.left(line, (c / 2).cast("int"))), (1, F.right(line, (c / 2).cast("int"))))]
    own, below = length_class(n), length_class(n - 1)
    return F.when(own == below, F.array(*ends(own))).otherwise(F.array(*ends(own), *ends(below)))


def windows(line: Column, short: Column, low: Column, high: Column, parts: Column) -> Column:
    """The line as one of a pair whose shorter line has `short` characters: array<struct<a, b, key>>, where [a, b) are parts of
    [low, high) in the shorter line and key hashes all before and after the part. The longer line has one more character there."""

    def part(i: Column) -> Column:
        a = low + F.floor(i * (high - low) / parts).cast("int")
        b = low + F.floor((i + 1) * (high - low) / parts).cast("int")
        key = F.xxhash64(short, a, b, F.xxhash64(F.left(line, a)), F.xxhash64(F.right(line, short - b)))
        return F.struct(a.alias("a"), b.alias("b"), key.alias("key"))

    return F.filter(F.transform(F.sequence(F.lit(0), parts - 1), part), lambda p: p["a"] < p["b"])


def variants(line: Column, short: Column, a: Column, b: Column) -> Column:
    """The deletion neighbourhood within a part, as array<struct<key, role>>: role 0: one of two equally long lines, without a
    place; 1: the shorter line, whole; 2: the longer one without a place."""
    longer = F.length(line) > short
    ends = F.xxhash64(short, a, b, F.xxhash64(F.left(line, a)), F.xxhash64(F.right(line, short - b)))
    part = F.substring(line, a + 1, F.length(line) - short + b - a)
    return let(F.struct(ends.alias("around"), part.alias("middle")), lambda x: _deleted(x["around"], x["middle"], longer, b - a))


def _deleted(around: Column, middle: Column, longer: Column, width: Column) -> Column:
    without = lambda i: F.concat(F.left(middle, i), F.substring(middle, i + 2, width + 1))
    places = F.sequence(F.lit(0), F.length(middle) - 1)
    same = F.transform(places, lambda i: F.struct(F.xxhash64(F.lit(0), around, i, without(i)).alias("key"), F.lit(0).alias("role")))
    whole = F.array(F.struct(F.xxhash64(F.lit(1), around, middle).alias("key"), F.lit(1).alias("role")))
    less = F.transform(places, lambda i: F.struct(F.xxhash64(F.lit(1), around, without(i)).alias("key"), F.lit(2).alias("role")))
    return F.array_distinct(F.when(longer, less).otherwise(F.concat(same, whole)))


def alike(parts: DataFrame) -> DataFrame:
    """The parts whose key two different lines (h1) have."""
    shared = written(parts.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).filter("low < high").select("key"))
    return parts.filter(perhaps(F.col("key"), shared)).join(shared, "key")


def near_lines(first: DataFrame, docs: DataFrame, id_col: str, text_col: str, near_chars: int) -> DataFrame:
    """h1, h2 of the distinct lines that an earlier distinct line is near. first: h1, h2, at (d, k, n of the earliest)."""
    l1, l2 = line_hash(F.col("line"))
    found = lines_of(docs, id_col, text_col).filter(F.length("line") >= near_chars)
    gated = written(alike(found.select(l1.alias("h1"), F.explode(gate_keys(F.col("line"))).alias("key"))).select(F.col("h1").alias("key")).distinct())
    places = first.filter(perhaps(F.col("h1"), gated)).join(gated, F.col("h1") == F.col("key"), "left_semi")
    places = written(places.select(F.col("at.d").alias("d"), F.col("at.k").alias("k"), F.col("at.n").alias("n"), "h1", "h2", "at"))
    # their texts, each from the earliest place
    there = perhaps(F.xxhash64("d", "k", "n", "l1"), places.select(F.xxhash64("d", "k", "n", "h1").alias("key")))
    found = found.withColumn("l1", l1).filter(there).withColumn("l2", l2)
    on = found["d"].eqNullSafe(places["d"]) & (found["k"] == places["k"]) & (found["n"] == places["n"]) & (found["l1"] == places["h1"]) & (found["l2"] == places["h2"])
    lines = written(found.join(places, on).groupBy("h1", "h2").agg(F.first("line").alias("line"), F.min("at").alias("at")), drop=[gated, places])
    size = F.length("line")
    roles = lines.select("h1", "h2", "line", F.explode(F.array(size, size - 1)).alias("short")).filter("short > 0")
    coarse = roles.select("h1", "h2", "short", F.explode(windows(F.col("line"), F.col("short"), F.lit(0), F.col("short"), F.lit(PARTS))).alias("p")).select("h1", "h2", "short", "p.*")
    texts = lines.select("h1", "h2", "line")
    narrow = written(alike(coarse).select("h1", "h2", "short", "a", "b").distinct()).join(texts, ["h1", "h2"])
    parts = F.least(F.lit(FINE_PARTS), F.ceil((F.col("b") - F.col("a")) / FINE_CHARS)).cast("int")
    fine = narrow.select("h1", "h2", "short", F.explode(windows(F.col("line"), F.col("short"), F.col("a"), F.col("b"), parts)).alias("p")).select("h1", "h2", "short", "p.*")
    last = written(alike(fine).select("h1", "h2", "short", "a", "b").distinct()).join(lines, ["h1", "h2"])
    each = written(last.select("h1", "h2", "at", F.explode(variants(F.col("line"), F.col("short"), F.col("a"), F.col("b"))).alias("v")).select("h1", "h2", "at", "v.key", "v.role"))
    of = lambda role: F.min(F.when(F.col("role") == role, F.struct("at", "h1", "h2")))
    earliest = each.groupBy("key").agg(F.count("*").alias("c"), of(0).alias("e0"), of(1).alias("e1"), of(2).alias("e2")).filter("c > 1").drop("c")
    # written, so that the join with it has a shuffle of its own, whose hot keys Spark splits
    earliest = written(earliest)
    other = F.when(F.col("role") == 0, F.col("e0")).when(F.col("role") == 1, F.col("e2")).otherwise(F.col("e1"))
    links = each.filter(perhaps(F.col("key"), earliest)).join(earliest, "key").withColumn("e", other).filter(F.col("e.at") < F.col("at"))
    pairs = links.groupBy("h1", "h2").agg(F.min("e").alias("e")).select("h1", "h2", F.col("e.h1").alias("e1"), F.col("e.h2").alias("e2"))
    checked = pairs.join(texts, ["h1", "h2"]).join(texts.select(F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("line").alias("other")), ["e1", "e2"])
    return written(checked.filter(F.levenshtein("line", "other", EDITS).between(0, EDITS)).select("h1", "h2"), drop=[lines, each, earliest])


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near_chars: int = NEAR_CHARS) -> DataFrame:
    """d, k, exact, near: for each text that loses lines, their sorted numbers by reason."""
    h1, h2 = line_hash(F.col("line"))
    known = written(lines_of(docs, id_col, text_col).select("d", "k", "n", h1.alias("h1"), h2.alias("h2")))
    first = written(known.groupBy("h1", "h2").agg(F.min(F.struct("d", "k", "n")).alias("at"), F.count("*").alias("c")))
    near = near_lines(first, docs, id_col, text_col, near_chars)
    repeated = first.filter("c > 1").select("h1", "h2", "at", F.lit(False).alias("near"))
    doomed = repeated.unionByName(near.select("h1", "h2", F.lit(None).cast(first.schema["at"].dataType).alias("at"), F.lit(True).alias("near")))
    # written, so that the join with it has a shuffle of its own, whose hot keys (a line that stands everywhere) Spark splits
    doomed = written(doomed.groupBy("h1", "h2").agg(F.max("at").alias("at"), F.max("near").alias("near")), drop=[first])
    here = F.struct("d", "k", "n")
    gone = known.filter(perhaps(F.col("h1"), doomed.select(F.col("h1").alias("key")))).join(doomed, ["h1", "h2"])
    gone = gone.select("d", "k", "n", (F.col("at").isNotNull() & (F.col("at") < here)).alias("exact"), "near").filter("exact or near")
    lists = gone.groupBy("d", "k").agg(F.collect_set(F.when(F.col("exact"), F.col("n"))).alias("exact"), F.collect_set(F.when(~F.col("exact"), F.col("n"))).alias("near"))
    return written(lists, drop=[known, doomed])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", report: bool = False, near_chars: int = NEAR_CHARS) -> DataFrame:
    """The documents with their own columns and the lines cut out of their texts; report: with __ff_lines, a struct of n, exact, near counts."""
    gone = dropped_lines(docs, id_col, text_col, near_chars).withColumnsRenamed({"d": "__ff_d", "k": "__ff_k", "exact": "__ff_exact", "near": "__ff_near"})
    text = F.col(f"`{text_col}`")
    marked = docs.withColumn("__ff_t", F.xxhash64(text))
    # texts that surely lose nothing are not shuffled
    loses = perhaps(F.xxhash64(f"`{id_col}`", "__ff_t"), gone.select(F.xxhash64("__ff_d", "__ff_k").alias("key")))
    some = marked.filter(loses)
    both = some.join(gone.hint("shuffle_hash"), some[f"`{id_col}`"].eqNullSafe(gone["__ff_d"]) & (some["__ff_t"] == gone["__ff_k"]), "left")
    both = both.unionByName(marked.filter(~loses), allowMissingColumns=True)
    lines = F.split(text, "\n")
    kept = lambda own: F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.concat("__ff_exact", "__ff_near"))
    rest = let(lines, lambda own: F.array_join(F.transform(kept(own), lambda i: F.get(own, i)), "\n"))
    cut = F.when(F.col("__ff_d").isNull() & F.col("__ff_k").isNull(), text).otherwise(rest)
    columns = [cut.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if report:
        size = lambda c: F.greatest(F.size(c), F.lit(0)).cast("long")
        columns.append(F.struct(size(lines).alias("n"), size("__ff_exact").alias("exact"), size("__ff_near").alias("near")).alias("__ff_lines"))
    return both.select(*columns)


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_exact, n_near, n_kept, text_sha256: one row per document."""
    done = line_dedup(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), report=True)
    n = F.col("__ff_lines")
    return done.select(
        "doc_id", n["n"].alias("n_lines"), n["exact"].alias("n_exact"), n["near"].alias("n_near"), (n["n"] - n["exact"] - n["near"]).alias("n_kept"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    )


def keep_first_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents after line_dedup; those that had words and have none left are copies through and through, and go."""
    done = line_dedup(docs, id_col, text_col, report=True)
    empty = ~F.col(f"`{text_col}`").rlike(f"[^{BLANK}]")
    lost = (F.col("__ff_lines")["exact"] + F.col("__ff_lines")["near"]) > 0
    return done.filter(~F.coalesce(empty & lost, F.lit(False))).select(*[F.col(f"`{c}`") for c in docs.columns])


#: One row per document, by plain SQL: all pairs of distinct lines whose lengths differ by 1 at most.
SQL = r"""
WITH t AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
w AS (SELECT * FROM t WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]')),
f AS (SELECT line, min({'d': doc_id, 'n': n}) AS pos, length(line) AS len FROM w GROUP BY line),
near AS (SELECT DISTINCT x.line FROM (SELECT *, unnest([len - 1, len, len + 1]) AS other FROM f WHERE len >= 12) x JOIN f y ON y.len = x.other AND y.len >= 12 AND y.pos < x.pos WHERE levenshtein(x.line, y.line) <= 1),
m AS (SELECT w.doc_id, count(*) FILTER (f.pos < {'d': w.doc_id, 'n': w.n}) AS n_exact, count(*) FILTER (NOT f.pos < {'d': w.doc_id, 'n': w.n} AND near.line IS NOT NULL) AS n_near
  FROM w JOIN f ON w.line = f.line LEFT JOIN near ON w.line = near.line GROUP BY w.doc_id),
r AS (SELECT t.doc_id, string_agg(t.line, chr(10) ORDER BY t.n) AS text FROM t LEFT JOIN f ON t.line = f.line LEFT JOIN near ON t.line = near.line
  WHERE f.line IS NULL OR (NOT f.pos < {'d': t.doc_id, 'n': t.n} AND near.line IS NULL) GROUP BY t.doc_id)
SELECT d.doc_id, CAST(length(d.text) - length(replace(d.text, chr(10), '')) + 1 AS BIGINT) AS n_lines, coalesce(m.n_exact, 0) AS n_exact, coalesce(m.n_near, 0) AS n_near,
CAST(length(d.text) - length(replace(d.text, chr(10), '')) + 1 - coalesce(m.n_exact, 0) - coalesce(m.n_near, 0) AS BIGINT) AS n_kept, sha256(coalesce(r.text, '')) AS text_sha256
FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id LEFT JOIN r ON d.doc_id = r.doc_id
"""

"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Texts are sets of five-word shingles (words: runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased; a
text of fewer words is one shingle). Two texts are linked if their sets' Jaccard similarity is 0.8 or more.

1. Texts of one shingle set are one node with a multiplicity; all that follows is about nodes.
2. The forest has TREES prefix tries; a node's path in each is DEPTH minimum hashes. Shortening matched prefixes raises recall:
   FLOOR is the longest prefix at which the recall expected at the threshold reaches RECALL, so prefixes are never shortened
   below it. A node that shares no prefix of FLOOR has no match at any length; the others form candidate groups by them.
3. A group of SMALL nodes at most is verified whole. In a crowded group paths go on to DEPTH. Nodes that share a whole path are
   verified with all that they are joined to by such. Then the matched prefixes are shortened step by step: at each step only
   the prefixes that still join different such subgroups are open, and only pairs that no longer prefix has shown are verified,
   each in the first tree that shows it. It ends at FLOOR.
4. Verification is exact: the sets of a task are laid side by side in one matrix product. Tasks are bounded: what is larger is
   cut into blocks, and each pair of blocks is a task. What leaves a task is a count for each node and a spanning forest, never
   pairs.
5. The components of the verified links are the classes.

Null texts and texts without a word have no shingles: each is a class of its own, without links. Rows of equal id and text
count each as a document. Null ids are kept. Extra columns play no part and stay, in keep_one(), as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain_words, slices, utf8, written
from .components import components
from .url_cascade import perhaps

WORDS = 5
#: The threshold as a fraction, so that it is compared exactly.
NUMERATOR, DENOMINATOR = 4, 5
TREES, DEPTH = 24, 10
RECALL = 0.999
#: Levels by which matched prefixes are shortened at a time.
STEP = 2
#: Nodes of a candidate group that is verified whole.
SMALL = 64
#: Of what is cut: nodes of a block, as long as there are BLOCKS blocks at most; nodes and bytes of shingles of a larger one.
BLOCK, BLOCKS, LARGE_BLOCK, BLOCK_BYTES = 256, 8, 2048, 16_000_000
#: Cells of the matrix of one product.
CELLS = 8_000_000

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def expected_recall(length: int) -> float:
    """The chance that a pair at the threshold shares a prefix of `length` in at least one tree."""
    return 1 - (1 - (NUMERATOR / DENOMINATOR) ** length) ** TREES


def levels() -> list[int]:
    """The lengths of matched prefixes, each shorter than the one before, until the expected recall is RECALL."""
    out = [DEPTH]
    while expected_recall(out[-1]) < RECALL and out[-1] > 1:
        out.append(out[-1] - 1)
    return out


def ladder() -> list[int]:
    """The lengths that are looked at: every STEP-th level, and the last. The last one decides what is linked; fewer rungs mean fewer rows."""
    found = levels()
    return [*found[:-1:STEP], found[-1]]


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20240229))
    return rng.integers(1, 2**63, n, dtype=np.uint64), rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles."""
    number: dict[bytes, int] = {}
    ids = [[number.setdefault(w, len(number)) for w in plain_words(utf8(t))] for t in texts]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
    out = []
    with np.errstate(over="ignore"):
        for row in ids:
            h = hashes[np.array(row, np.int64)]
            if not len(h):
                out.append(h)
                continue
            n = max(1, len(h) - WORDS + 1)
            total = np.full(n, np.uint64(min(len(h), WORDS)))
            for k in range(min(WORDS, len(h))):
                total = (total ^ h[k : k + n]) * _GOLDEN
                total ^= total >> np.uint64(32)
            out.append(np.unique(_mix(total)))
    return out


def prefix_hashes(sets: list[np.ndarray], lengths: list[int]) -> np.ndarray:
    """For each non-empty set, length and tree, the hash of its path's prefix."""
    flat = np.concatenate(sets)
    start = np.cumsum([len(s) for s in sets]) - [len(s) for s in sets]
    add, times = _constants(TREES * DEPTH)
    out = np.zeros((len(sets), len(lengths), TREES), np.uint64)
    with np.errstate(over="ignore"):
        for t in range(TREES):
            path = np.full(len(sets), np.uint64(t + 1))
            for k in range(max(lengths)):
                least = np.minimum.reduceat((flat ^ add[t * DEPTH + k]) * times[t * DEPTH + k], start)
                path = _mix((path * _GOLDEN) ^ least)
                if k + 1 in lengths:
                    out[:, lengths.index(k + 1), t] = path
    return out


def signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """d, k (the text's hash), s (the shingle set's 128-bit hash, null if it is empty), size (shingles), paths (prefixes of the floor's length)."""
    floor = levels()[-1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames):
            sets = shingle_sets(list(frame["text"]))
            full = [s for s in sets if len(s)]
            paths = iter(prefix_hashes(full, [floor])[:, 0].view(np.int64)) if full else iter(())
            yield pd.DataFrame(
                {
                    "d": frame["d"].astype("Int64").to_numpy(dtype=object),
                    "k": frame["k"].to_numpy(),
                    "s": [xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets],
                    "size": [len(s) for s in sets],
                    "paths": [next(paths) if len(s) else None for s in sets],
                }
            )

    return given_texts(docs, id_col, text_col).mapInPandas(run, "d bigint, k bigint, s binary, size bigint, paths array<bigint>")


def given_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("d"), F.xxhash64(F.col(text_col)).alias("k"), F.col(text_col).alias("text"))


def grouped(places: DataFrame) -> DataFrame:
    """s, group: the nodes (s) that a shared path joins with others, of places (s, path)."""
    shared = written(places.groupBy("path").agg(F.min("s").alias("low"), F.max("s").alias("high")).filter("low < high").select("path", "low"))
    here = places.filter(perhaps(F.col("path"), shared.select(F.col("path").alias("key")))).join(shared, "path")
    groups = written(components(here.filter("s > low").select(F.col("s").alias("a"), F.col("low").alias("b"))))
    return groups.select(F.col("a").alias("s"), F.col("root").alias("group")).unionAll(groups.select(F.col("root").alias("s"), F.col("root").alias("group")).distinct())


def blocks(n: Column, shingles: Column) -> Column:
    """Into how many blocks so many nodes with so many shingles are cut."""
    return F.greatest(F.ceil(n / LARGE_BLOCK), F.least(F.ceil(n / BLOCK), F.lit(BLOCKS)), F.ceil(shingles * 8 / BLOCK_BYTES)).cast("int")


def in_tasks(rows: DataFrame, *of: str) -> DataFrame:
    """The rows once for each task that they take part in: each pair (i, j) of the `blocks` blocks of what the columns `of` tell apart."""
    pairs = lambda b: F.struct(F.least(b, F.col("block")).alias("i"), F.greatest(b, F.col("block")).alias("j"))
    cut = rows.withColumn("block", F.pmod(F.xxhash64("s"), F.col("blocks")).cast("int"))
    return cut.withColumn("t", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pairs))).select("*", "t.i", "t.j").drop("t", "blocks").withColumn("key", F.xxhash64(*of, "i", "j"))


LINKS = "s binary, texts bigint, documents bigint, to binary"


def verify(rows: pd.DataFrame) -> list[tuple[bytes, int, int, bytes]]:
    """For each linked node of one task (columns s, m, i, j, block, shingles; and to leave out known pairs: subgroup, tree, longer,
    same) its links, by texts and documents, and a node that it is joined with."""
    rows = rows.drop_duplicates("s").sort_values(["block", "s"])
    names, copies, n = list(rows["s"]), rows["m"].to_numpy(dtype=np.int64), len(rows)
    sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
    low = int((rows["block"] == rows["i"].iloc[0]).sum())
    linked = np.zeros((n, n), bool)
    if rows["i"].iloc[0] == rows["j"].iloc[0]:
        linked[:] = similar(sets, sets)
        np.fill_diagonal(linked, False)
    elif 0 < low < n:
        linked[:low, low:] = similar(sets[:low], sets[low:])
        linked[low:, :low] = linked[:low, low:].T
    if "tree" in rows:
        subgroup = np.unique(rows["subgroup"].to_numpy(), return_inverse=True)[1]
        linked &= subgroup[:, None] != subgroup[None, :]
        longer, same = np.stack(rows["longer"].to_list()), np.stack(rows["same"].to_list())
        for t in range(TREES):
            linked &= longer[:, None, t] != longer[None, :, t]
        for t in range(int(rows["tree"].iloc[0])):
            linked &= same[:, None, t] != same[None, :, t]
    label = np.full(n, -1)
    for x in range(n):  # each node's component, row by row
        front = np.array([x]) if label[x] < 0 else np.zeros(0, np.int64)
        while len(front):
            label[front] = x
            front = np.flatnonzero(linked[front].any(axis=0) & (label < 0))
    texts, documents = linked.sum(axis=1), linked @ copies
    return [(names[x], int(texts[x]), int(documents[x]), names[label[x]]) for x in np.flatnonzero(texts)]


def similar(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which pairs of sets reach the threshold."""
    sets = left if left is right else left + right
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    column = np.cumsum(np.diff(flat, prepend=flat[:1]) != 0)
    often = np.bincount(column)[column] > 1
    row, column = row[often], column[often]
    column = np.cumsum(np.diff(column, prepend=column[:1]) != 0)
    first = 0 if left is right else len(left)
    both = np.zeros((len(left), len(right)), np.float32)  # counts below 2^24 are exact
    width = max(1, CELLS // len(sets))
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        low, high = np.searchsorted(column, [start, start + width])
        cells = np.zeros((len(sets), min(width, int(column[-1]) + 1 - start)), np.float32)
        cells[row[low:high], column[low:high] - start] = 1
        both += cells[: len(left)] @ cells[first:].T
    return (NUMERATOR + DENOMINATOR) * both.astype(np.int64) >= NUMERATOR * (size[: len(left), None] + size[None, first:])


def run_tasks(sent: DataFrame) -> DataFrame:
    """The links of tasks that share no more than a key, a few at a time."""

    def task(part: pd.DataFrame) -> pd.DataFrame:
        out = [x for _, rows in part.groupby(["of", "i", "j"], sort=False) for x in verify(rows)]
        return pd.DataFrame(out, columns=["s", "texts", "documents", "to"])

    return sent.groupBy("key").applyInPandas(task, LINKS)


def forest_links(nodes: DataFrame) -> list[DataFrame]:
    """Links within crowded groups: by whole paths, then by ever shorter prefixes. nodes: s, m, shingles, prefixes (by level, by tree)."""
    size = F.octet_length("shingles") / 8
    whole = grouped(nodes.select("s", F.explode(F.col("prefixes")[0]).alias("path")))
    sub = written(nodes.join(whole.withColumnRenamed("group", "subgroup"), "s", "left").withColumn("subgroup", F.coalesce("subgroup", "s")))
    cut = sub.groupBy("subgroup").agg(F.count("*").alias("n"), F.sum(size).alias("shingles")).filter("n > 1").select("subgroup", blocks(F.col("n"), F.col("shingles")).alias("blocks"))
    found = [run_tasks(in_tasks(sub.drop("prefixes").join(cut, "subgroup").withColumnRenamed("subgroup", "of"), "of"))]
    for level in range(1, len(ladder())):
        places = sub.select("s", "subgroup", size.alias("size"), F.posexplode(F.col("prefixes")[level]).alias("tree", "of"))
        several = places.groupBy("of").agg(F.min("subgroup").alias("low"), F.max("subgroup").alias("high"), F.count("*").alias("n"), F.sum("size").alias("shingles"))
        several = written(several.filter("low < high").select("of", blocks(F.col("n"), F.col("shingles")).alias("blocks")))
        if not several.isEmpty():
            due = places.join(several, "of").select("s", "tree", "of", "blocks")
            own = sub.select("s", "m", "subgroup", "shingles", F.col("prefixes")[level - 1].alias("longer"), F.col("prefixes")[level].alias("same"))
            found.append(run_tasks(in_tasks(due.join(own, "s"), "of")))
    return found


def joined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """d, k, class (d and k of its first document), links, texts: one row per document."""
    rows = written(signed(docs, id_col, text_col))
    nodes = written(rows.filter("s is not null").groupBy("s").agg(F.min(F.struct("d", "k")).alias("at"), F.count("*").alias("m"), F.first("size").alias("size"), F.first("paths").alias("paths")))
    groups = grouped(nodes.select("s", F.explode("paths").alias("path")))
    members = written(groups.join(nodes.select("s", "m", "at", "size"), "s").select("s", "m", "at.d", "at.k", "size", "group"))
    whole = written(members.groupBy("group").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")).select("group", ((F.col("n") <= SMALL) & (F.col("shingles") * 8 <= BLOCK_BYTES)).alias("whole")))
    # written, so that the join with it has a shuffle of its own, whose hot keys Spark splits
    members = written(members.join(whole, "group"), drop=[members])
    lengths = ladder()

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames):
            sets = shingle_sets(list(frame["text"]))
            paths = [None if w else prefix_hashes([s], lengths)[0].view(np.int64) for s, w in zip(sets, frame["whole"], strict=True)]
            yield frame.drop(columns="text").assign(shingles=[s.tobytes() for s in sets], prefixes=[None if p is None else list(p) for p in paths])

    # one text of each node; texts of no candidates are not shuffled
    texts = given_texts(docs, id_col, text_col).filter(perhaps(F.xxhash64("d", "k"), members.select(F.xxhash64("d", "k").alias("key"))))
    texts = texts.groupBy("d", "k").agg(F.first("text").alias("text")).withColumnsRenamed({"d": "d2", "k": "k2"})
    texts = members.join(texts.hint("shuffle_hash"), F.col("d").eqNullSafe(F.col("d2")) & (F.col("k") == F.col("k2")))
    sets = written(texts.select("s", "m", "group", "whole", "text").mapInPandas(pack, "s binary, m bigint, group binary, whole boolean, shingles binary, prefixes array<array<bigint>>"))
    counts = {r.whole: r["count"] for r in sets.groupBy("whole").count().collect()}
    # groups that are verified whole, a few by task
    few = max(1, counts.get(True, 0) // (2 * SMALL))
    none = F.lit(0)
    small = sets.filter("whole").select("s", "m", "shingles", F.col("group").alias("of"), none.alias("block"), none.alias("i"), none.alias("j"), F.pmod(F.xxhash64("group"), F.lit(few)).alias("key"))
    links = run_tasks(small)
    for more in forest_links(sets.filter("not whole")) if counts.get(False) else []:
        links = links.unionByName(more)
    links = written(links, drop=[sets])
    sums = links.groupBy("s").agg(F.sum("texts").alias("texts"), F.sum("documents").alias("documents"))
    found = components(links.select(F.col("s").alias("a"), F.col("to").alias("b")))
    class_of = nodes.select("s", "m", "at").join(found.withColumnRenamed("a", "s"), "s", "left").withColumn("root", F.coalesce("root", "s"))
    first = written(class_of.groupBy("root").agg(F.min("at").alias("class")))
    info = class_of.join(first, "root").join(sums, "s", "left").select("s", "class", (F.coalesce("documents", F.lit(0)) + F.col("m") - 1).alias("links"), F.coalesce("texts", F.lit(0)).alias("texts"))
    own = rows.select("d", "k", "s")
    some = own.join(written(info), "s").select("d", "k", "class", "links", "texts")
    none = own.filter("s is null").select("d", "k", F.struct("d", "k").alias("class"), F.lit(0).cast("long").alias("links"), F.lit(0).cast("long").alias("texts"))
    return some.unionByName(none)


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), n_links (documents of 0.8 or more, copies too), n_texts (different shingle
    sets among them), first_text (hash of the class's first text: with class_id it tells classes apart where ids are null or repeat)."""
    return joined(docs, id_col, text_col).select(F.col("d").alias("doc_id"), F.col("class.d").alias("class_id"), F.col("links").alias("n_links"), F.col("texts").alias("n_texts"), F.col("class.k").alias("first_text"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first document of each class, with its own columns; rows that repeat its id and text stay with it."""
    gone = written(joined(docs, id_col, text_col).filter("not (class.d <=> d and class.k <=> k)").select("d", "k").distinct())
    marked = docs.withColumn("__ff_k", F.xxhash64(F.col(f"`{text_col}`")))
    # the texts of those that surely stay are not shuffled
    goes = perhaps(F.xxhash64(F.col(f"`{id_col}`").cast("long"), "__ff_k"), gone.select(F.xxhash64("d", "k").alias("key")))
    gone = gone.withColumnsRenamed({"d": "__ff_d", "k": "__ff_own"}).hint("shuffle_hash")
    asked = marked.filter(goes)
    stay = asked.join(gone, asked[f"`{id_col}`"].eqNullSafe(F.col("__ff_d")) & (F.col("__ff_k") == F.col("__ff_own")), "left_anti")
    return stay.unionByName(marked.filter(~goes)).select(*[F.col(f"`{c}`") for c in docs.columns])

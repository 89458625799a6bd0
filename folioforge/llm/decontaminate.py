"""Benchmark decontamination by spaced-seed hashing.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. A seed is a fixed mask over a window of words
that hashes only some of its positions, so a substituted word at an ignored position does not hide the match. All windows of all
whole texts are hashed by every mask and joined with the hashes of the benchmark's windows. Around each hit, text and item are
laid along each other without gaps, and scored by runs (+1 for an equal word, -PENALTY for another, begun anew at 0); the
document is contaminated if a run holds LEAST equal words, or SHARE of a shorter item's.

Items of up to SHORT words allow m substitutions, and so have m + 1 masks over all their length, each of every (m + 1)-th word:
m substitutions leave at least one mask whole, so no match is missed. Longer items have MASKS over windows of SPAN words; a run
of few substitutions is always found, one of very many may be missed. Items of one or two words are found wherever they stand; as
they are no passages, clean() lets documents that hold them pass, and takes items from PASSAGE words on. Of hits that follow one another along a diagonal only the first is taken up, so repeated words cost no more.

The benchmark is broadcast in blocks of at most BLOCK_BYTES of text, one map over the documents for each block, one block after
another; with one block nothing is shuffled. Null and empty texts are clean; repeated rows are judged alike; null items and an empty benchmark match
nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain_words, slices, utf8, written

#: Fixed masks; 1 hashes a position, 0 ignores it.
MASKS = ("11101100101", "11010011011", "10110110011", "11100011101")
SPAN = 11
MIN_ITEM, SHORT = 1, 16
#: The fewest words of an item for which clean() drops a document.
PASSAGE = 3
LEAST = 13
SHARE = 0.8
PENALTY = 2
BLOCK_BYTES = 16_000_000
#: Cells of the matrix in which one batch of alignments is verified.
CELLS = 4_000_000
#: Hits that are taken up at once.
EXPAND = 2_000_000

_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9FB21C651E98DF25, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def offsets(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def seed_hash(ids: np.ndarray, at: np.ndarray, positions: list[int]) -> np.ndarray:
    """A 64-bit hash of the ids at `positions` after each start in `at`."""
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k, p in enumerate(positions):
            h = (h ^ ids[at + p].astype(np.uint64)) * _MIX[k % len(_MIX)]
            h ^= h >> np.uint64(29)
    return h


def least(length: int) -> int:
    """The equal words that an item of so many words must have in a run."""
    return min(LEAST, math.ceil(SHARE * length - 1e-9))


def short_masks(length: int) -> list[list[int]]:
    """The positions of the masks of an item of up to SHORT words."""
    step = length - least(length) + 1
    return [list(range(r, length, step)) for r in range(step)]


class Table(NamedTuple):
    """The hashed windows of one mask, sorted by hash and then by the hash of the window before."""

    positions: list[int]
    window: int
    hashes: np.ndarray
    before: np.ndarray  # the distinct hashes of windows before
    pairs: np.ndarray  # place of the hash, place of the one before (0: none)
    first: np.ndarray  # of each distinct hash, where its entries start
    item: np.ndarray
    place: np.ndarray


class Seeds:
    """The hashed windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str | None]], masks: tuple[str, ...] = MASKS, fewest: int = MIN_ITEM):
        self.vocabulary: dict[bytes, int] = {}
        self.items, words = [], []
        for item_id, text in items:
            w = plain_words(utf8(text))
            if item_id is not None and len(w) >= fewest:
                self.items.append(item_id)
                words.append([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w])
        self.length = np.array([len(w) for w in words], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int64)
        self.ids = np.array([i for w in words for i in w] + [-1] * SPAN, np.int64)
        self.tables: list[Table] = []
        plans = [(offsets(m), SPAN, np.flatnonzero(self.length > SHORT)) for m in masks]
        plans += [(p, n, np.flatnonzero(self.length == n)) for n in range(MIN_ITEM, SHORT + 1) for p in short_masks(n)]
        self.tables = [self.table(*plan) for plan in plans if len(plan[2])]

    def table(self, positions: list[int], window: int, chosen: np.ndarray) -> Table:
        item = np.repeat(chosen, self.length[chosen] - window + 1)
        place = np.concatenate([np.arange(self.length[i] - window + 1) for i in chosen])
        h = seed_hash(self.ids, self.start[item] + place, positions)
        hashes, at = np.unique(h, return_inverse=True)
        before, previous = np.unique(h, return_inverse=True)
        previous = np.where(place > 0, np.roll(previous, 1) + 1, 0)
        pairs = at * (len(before) + 1) + previous
        order = np.argsort(pairs, kind="stable")
        return Table(positions, window, hashes, before, pairs[order], np.searchsorted(at[order], np.arange(len(hashes) + 1)), item[order], place[order])

    def hits(self, ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Distinct rows (item, place of the item's first word, text); ids: words, with SHORT zeros around each text; doc: each word's text."""
        known, found = ids > 0, np.zeros(0, np.int64)
        longest = int(self.length.max(initial=0))
        texts, width = int(doc.max(initial=0)) + 1, len(ids) + longest
        for t in self.tables:
            n = len(ids) - t.window + 1
            if n <= 0:
                continue
            ok = np.ones(n, bool)
            for p in t.positions:
                ok &= known[p : p + n]
            at = np.flatnonzero(ok)
            h, of = seed_hash(ids, at, t.positions), doc[at + t.positions[0]]
            k = np.minimum(np.searchsorted(t.hashes, h), len(t.hashes) - 1)
            hit = t.hashes[k] == h
            # entries whose window before equals the text's window before are on a diagonal that is known already
            before = np.minimum(np.searchsorted(t.before, np.roll(h, 1)), len(t.before) - 1)
            follows = (t.before[before] == np.roll(h, 1)) & (np.roll(at, 1) == at - 1) & (np.roll(of, 1) == of)
            k, pair, at, of = k[hit], np.where(follows, k * (len(t.before) + 1) + before + 1, -1)[hit], at[hit], of[hit]
            low, high = t.first[k], t.first[k + 1]
            skip, on = np.where(pair < 0, high, np.searchsorted(t.pairs, pair, "left")), np.where(pair < 0, high, np.searchsorted(t.pairs, pair, "right"))
            for a, b in ((low, skip), (on, high)):
                count = b - a
                total = np.cumsum(count)
                done = 0
                while done < len(count):  # a bounded number of entries at a time
                    to = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + EXPAND, "right")))
                    c = count[done:to]
                    entry = np.repeat(a[done:to], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                    start = np.repeat(at[done:to], c) - t.place[entry] + longest
                    found = np.union1d(found, (t.item[entry] * texts + np.repeat(of[done:to], c)) * width + start)
                    done = to
        rest, start = np.divmod(found, width)
        return np.stack([rest // texts, start - longest, rest % texts], axis=1)

    def overlap(self, ids: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Equal words in the best run of each alignment; low, high: the bounds of its text."""
        best = np.zeros(len(item), np.int64)
        order = np.argsort(self.length[item], kind="stable")
        done = 0
        while done < len(order):
            # items come by rising length, so a batch is sized by the longest length that it may hold
            step = max(1, CELLS // int(self.length[item[order[min(done + 4096, len(order) - 1)]]]))
            part = order[done : done + min(step, 4097)]
            done += len(part)
            width = int(self.length[item[part]].max())
            run, equal = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
            top = np.zeros(len(part), np.int64)
            for j in range(width):
                there = at[part] + j
                inside = (j < self.length[item[part]]) & (there >= low[part]) & (there < high[part])
                mine = self.ids[np.minimum(self.start[item[part]] + j, len(self.ids) - 1)]
                same = inside & (ids[np.clip(there, 0, len(ids) - 1)] == mine)
                run += np.where(same, 1, -PENALTY)
                equal += same
                lost = run <= 0
                run[lost], equal[lost] = 0, 0
                top = np.maximum(top, equal)
            best[part] = top
        return best

    def least(self, item: np.ndarray) -> np.ndarray:
        return np.array([least(int(n)) for n in self.length], np.int64)[item]


def find(texts: list[str | None], seeds: Seeds) -> tuple[np.ndarray, list[list[int]], np.ndarray]:
    """For each text: its words, the sorted ids of the items it holds, and the most equal words in one run."""
    words = [plain_words(utf8(t)) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes + SHORT)
    get = seeds.vocabulary.get
    pad = [0] * SHORT
    ids = np.array([*pad, *(i for w in words for i in (*map(get, w, repeat(0)), *pad))], np.int64)
    held: list[set[int]] = [set() for _ in texts]
    most = np.zeros(len(texts), np.int64)
    doc = np.concatenate([np.zeros(SHORT, np.int64), np.repeat(np.arange(len(texts)), sizes + SHORT)])
    item, at, of = seeds.hits(ids, doc).T
    best = seeds.overlap(ids, ends[of] - sizes[of], ends[of], item, at)
    good = best >= seeds.least(item)
    for d, i, b in zip(of[good], item[good], best[good], strict=True):
        held[d].add(int(seeds.items[i]))
        most[d] = max(most[d], b)
    return sizes, [sorted(h) for h in held], most


def blocks(bench: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str | None]]]:
    """The benchmark in blocks that the driver and each task can hold; one empty block if it is empty."""
    bench = bench.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).filter("t is not null and i is not null")
    total = bench.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    for k in range(n):
        part = bench if n == 1 else bench.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r.i, r.t) for r in part.orderBy("i", "t").collect()]


def overlaps(text: Column, seeds: Broadcast) -> Column:
    """struct(n_words, items, overlap) of a text column against a block of the benchmark."""

    @F.pandas_udf("n_words bigint, items array<bigint>, overlap bigint")
    def run(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts = [find(list(part["text"]), seeds.value) for part in slices([frame.to_frame("text")])]
            yield pd.DataFrame(
                {
                    "n_words": [int(n) for sizes, _, _ in parts for n in sizes],
                    "items": [items for _, held, _ in parts for items in held],
                    "overlap": [int(n) for _, _, most in parts for n in most],
                }
            )

    return run(text)


def judged(docs: DataFrame, bench: DataFrame, text_col: str = "text", fewest: int = MIN_ITEM) -> DataFrame:
    """The documents with __ff_o, struct(n_words, items, overlap), for items of `fewest` words or more. Of several blocks all but the first are looked for one after another, and what they find is joined by the text's hash."""
    spark, more = docs.sparkSession, None
    todo = blocks(bench, "item_id", "text")
    out = docs.withColumn("__ff_o", overlaps(F.col(f"`{text_col}`"), spark.sparkContext.broadcast(Seeds(next(todo), fewest=fewest))))
    keys = [F.xxhash64(f"`{text_col}`").alias("__ff_k1"), F.xxhash64(F.lit(7), f"`{text_col}`").alias("__ff_k2")]
    names = ["__ff_k1", "__ff_k2"]
    for block in todo:
        shared = spark.sparkContext.broadcast(Seeds(block, fewest=fewest))
        hits = written(docs.select(*keys, overlaps(F.col(f"`{text_col}`"), shared).alias("o")).filter(F.size("o.items") > 0).dropDuplicates(names))
        shared.destroy()
        more = hits if more is None else more.unionByName(hits)
    if more is None:
        return out
    more = more.groupBy(*names).agg(F.flatten(F.collect_list("o.items")).alias("__ff_more"), F.max("o.overlap").alias("__ff_most"))
    both = out.select("*", *keys).join(more, names, "left")
    items = F.array_sort(F.array_distinct(F.concat("__ff_o.items", F.coalesce("__ff_more", F.array().cast("array<bigint>")))))
    return both.withColumn("__ff_o", F.struct(F.col("__ff_o.n_words").alias("n_words"), items.alias("items"), F.greatest("__ff_o.overlap", F.coalesce("__ff_most", F.lit(0))).alias("overlap")))


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, items array<long>, overlap, contaminated: one row per document."""
    found = judged(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), bench)
    return found.select("doc_id", "__ff_o.n_words", "__ff_o.items", "__ff_o.overlap", (F.size("__ff_o.items") > 0).alias("contaminated"))


def clean(docs: DataFrame, bench: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that hold no item of the benchmark, with their own columns."""
    return judged(docs, bench, text_col, PASSAGE).filter(F.size("__ff_o.items") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])

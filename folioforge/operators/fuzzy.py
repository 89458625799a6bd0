"""Jaro-Winkler search that looks at few pairs: texts in blocks by first letter and length, left out where no text can be near enough.

The matches that Jaro counts are letters that both texts have, so there are at most as many as the texts have in common as bags
of letters: with c of those, Jaro is at most (c / |a| + c / |b| + 1) / 3, and Jaro-Winkler raises that for a common prefix. A block
knows the most that any of its texts has of each letter, and their least length, so a bound holds for it as a whole; within a
block the same bound is worked out for each text, and only what may reach the asked score is compared. No pair at or above it is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions import similarity as S

from .tables import written

#: Classes of letters; letters of one class count as equal, which only raises the bound.
LETTERS = 32
#: Lengths that share a block, and queries that meet a block at once.
LENGTHS, CHUNK = 4, 100
#: Tasks that the comparisons are dealt over.
TASKS = 192
#: What rounding may take from a bound.
EPS = 1e-4


def letter_counts(texts: list[str]) -> np.ndarray:
    """How many letters of each class each text has."""
    out = np.zeros((len(texts), LETTERS), np.int32)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    np.add.at(out, (np.repeat(np.arange(len(texts)), size), codes % LETTERS), 1)
    return out


def reachable(asked: str, counts: np.ndarray, texts: list[str], sizes: np.ndarray, heads: np.ndarray, least: float) -> np.ndarray:
    """Which texts may score `least` against the asked one; counts, sizes, heads: their letters, lengths and first four letters."""
    own = letter_counts([asked])[0]
    common = np.minimum(own, counts).sum(axis=1)
    n = max(len(asked), 1)
    jaro = (common / n + common / np.maximum(sizes, 1) + 1) / 3
    first = np.frombuffer(asked[:4].ljust(4, "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    prefix = np.logical_and.accumulate(heads == first, axis=1).sum(axis=1)
    best = np.where(jaro < 0.7, jaro, jaro + 0.1 * prefix * (1 - jaro))
    return (best >= least - EPS) | (sizes == 0)


def heads_of(texts: list[str]) -> np.ndarray:
    return np.stack([np.frombuffer(t[:4].ljust(4, "\1").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts])


def blocks_of(texts: DataFrame, size: int) -> DataFrame:
    """block, letter, low (least length), top (most of each letter), rows array<(id, text)>: about `size` texts each."""
    key = [F.substring("text", 1, 1).alias("letter"), F.floor(F.length("text") / LENGTHS).alias("span")]
    parts = texts.groupBy(*key).agg(F.ceil(F.count("*") / size).alias("parts")).withColumnsRenamed({"letter": "l", "span": "s"})
    rows = texts.select("id", "text", *key).join(parts, (F.col("letter") == F.col("l")) & (F.col("span") == F.col("s")))
    rows = rows.groupBy("letter", "span", F.pmod(F.xxhash64("id"), "parts").alias("part")).agg(F.min(F.length("text")).alias("low"), F.collect_list(F.struct("id", "text")).alias("rows"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["top"] = [letter_counts([r["text"] for r in rows]).max(axis=0).tolist() for rows in frame["rows"]]
            yield frame[["letter", "low", "top", "rows"]]

    found = rows.drop("span", "part").mapInPandas(run, "letter string, low int, top array<int>, rows array<struct<id:bigint,text:string>>")
    return written(found.withColumn("block", F.monotonically_increasing_id()))


def fuzzy_search(queries: DataFrame, texts: DataFrame, least: float, size: int = 1000) -> DataFrame:
    """query, id, score: the texts (id, text) that score `least` or more against a query (query, asked). Nulls are left out."""
    texts, queries = texts.filter("text is not null"), queries.filter("asked is not null")
    blocks = blocks_of(texts, size)

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["own"] = letter_counts(list(frame["asked"])).tolist()
            yield frame

    asked = queries.select(F.col("query").cast("long").alias("query"), "asked").mapInPandas(counted, "query bigint, asked string, own array<int>")
    # queries meet what is known of each block, not its texts
    n = F.greatest(F.length("asked"), F.lit(1))
    common = F.aggregate(F.zip_with("own", "top", lambda a, b: F.least(a, b)), F.lit(0), lambda a, x: a + x)
    near = asked.crossJoin(blocks.select("block", "letter", "low", "top")).withColumn("c", common)
    jaro = (F.least("c", n) / n + F.least("c", "low") / F.greatest("low", F.lit(1)) + 1) / 3
    prefix = F.when(F.substring("asked", 1, 1) == F.col("letter"), 4).otherwise(0)
    near = near.filter((F.when(jaro < 0.7, jaro).otherwise(jaro + 0.1 * prefix * (1 - jaro)) >= least - EPS) | (F.col("low") == 0))
    chunk = F.pmod(F.xxhash64("query"), F.lit(queries.count() // CHUNK + 1)).alias("chunk")
    near = near.groupBy("block", chunk).agg(F.collect_list(F.struct("query", "asked")).alias("queries"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for asked, rows in zip(frame["queries"], frame["rows"], strict=True):
                ids, own = np.array([r["id"] for r in rows], np.int64), [r["text"] for r in rows]
                counts, sizes, heads = letter_counts(own), np.array([len(t) for t in own]), heads_of(own)
                for a in asked:
                    may = np.flatnonzero(reachable(a["asked"], counts, own, sizes, heads, least))
                    score = S.jaro_winkler_block(a["asked"], [own[i] for i in may])
                    near = score >= least - EPS
                    yield pd.DataFrame({"query": a["query"], "id": ids[may[near]], "score": score[near]})

    # few bytes, but much work: these rows are dealt over all cores
    met = near.join(blocks.select("block", "rows"), "block").repartition(TASKS, "block", "chunk")
    found = met.select("queries", "rows").mapInPandas(run, "query bigint, id bigint, score double")
    return found.withColumn("score", F.round("score", 6)).filter(F.col("score") >= least)

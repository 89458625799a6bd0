"""Toxicity by a counterfactually regularised classifier.

Logistic regression over a text's distinct lower-cased words, each given by hashed features: the word and its prefixes,
which catch inflected forms. Its labels come from a bounded sample of labelled rows: the SAMPLE ids with the least hash, and of
rows that repeat an id the least text. Spark counts the sample's features and keeps those that pass a two-proportion test.

Counterfactuals swap identity terms, found word by word: each labelled text that names groups is set beside texts in which
another term, or a neutral word, stands instead. A labelled text that names none gets a term planted, by turns, and swapped
alike. The loss penalises the squared change of the logit within each pair, so that which group is named moves no score.

The score depends on the text alone. Null and empty texts get the score of the bias. Rows without labels are scored, too.
Repeated rows are scored alike; labels that are null, or of rows to hold out, are not used; a null id is not held out, and has no
label. With no labels all score 0.5, with one class only nearly 0 or 1.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_hash, plain_words, release, slices, utf8, written

SAMPLE = 8192
BUCKETS = 1 << 20
#: Features kept: at most so many, in at least so many texts, with a test value of so much.
FEATURES, LEAST_TEXTS, LEAST_Z = 2000, 5, 4.0
L2, COUNTERFACTUAL, STEPS, RATE = 1e-4, 1.0, 400, 0.3
#: Bytes of a word's prefixes.
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Words whose weight a worker keeps.
MEMO = 100_000
THRESHOLD = 0.7

#: Identity terms, which are swapped for one another, and the neutral words that may stand for them.
IDENTITY = (
    "women men woman man girls boys girl boy female male gay lesbian bisexual straight transgender queer homosexual heterosexual black white asian "
    "african european latino latina hispanic arab indian chinese mexican american jewish jews muslim muslims christian christians catholic catholics "
    "hindu hindus buddhist atheist atheists immigrant immigrants refugee refugees blind deaf disabled elderly old young teenage"
).split()
NEUTRAL = ("person", "people")
TERMS = (*IDENTITY, *NEUTRAL)
#: Other terms that each term of a text is swapped for.
SWAPS = 6


def bucket(word: bytes) -> int:
    return zlib.crc32(word) % BUCKETS


def word_buckets(word: bytes) -> list[int]:
    return [bucket(word), *(bucket(b"^" + word[:n]) for n in PREFIXES if len(word) >= n)]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's distinct words, sorted, and how many of the words have each (255 at most)."""
    found = [b for w in set(plain_words(utf8(text))) for b in word_buckets(w)]
    buckets, counts = np.unique(np.array(found, np.int32), return_counts=True)
    return buckets, np.minimum(counts, 255).astype(np.uint8)


def swaps(text: str | None, turn: int) -> list[tuple[int, int]]:
    """(term that goes, word that comes), as numbers of TERMS: for each identity term of a text, or one that is planted by turns."""
    words = set(plain_words(utf8(text)))
    there = [w.encode() in words for w in TERMS]
    out = []
    for k, term in enumerate([i for i in range(len(IDENTITY)) if there[i]] or [turn % len(IDENTITY)]):
        others = [i for i in range(len(IDENTITY)) if not there[i] and i != term]
        step = max(1, len(others) // SWAPS)
        out += [(term, i) for i in [*others[(turn + k) % step :: step][:SWAPS], *range(len(IDENTITY), len(TERMS))] if not there[i]]
    return out


class Model:
    """Weights by bucket."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self.memo: dict[bytes, float] = {}

    def word(self, word: bytes) -> float:
        if len(self.memo) >= MEMO:
            self.memo.clear()
        self.memo[word] = out = float(self.weights[word_buckets(word)].sum())
        return out

    def score(self, text: str | None) -> float:
        get = self.memo.get
        logit = self.bias
        for w in sorted(set(plain_words(utf8(text)))):
            x = get(w)
            logit += self.word(w) if x is None else x
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


Row = tuple[np.ndarray, np.ndarray]


def fit(rows: list[Row], toxic: np.ndarray, chosen: np.ndarray, swapped: dict[tuple[int, int], int]) -> Model:
    """The model of these texts' features and 0/1 labels. chosen: the buckets that get weights, those of the terms among them, sorted; swapped: how often each pair of terms was swapped."""
    n, pos = len(rows), int(toxic.sum())
    weights = np.zeros(BUCKETS)
    if not n or not pos or pos == n:
        return Model(weights.astype(np.float32), 0.0 if not n else -30.0 if not pos else 30.0)
    terms = [np.array(word_buckets(w.encode()), np.int32) for w in TERMS]
    pairs = sorted(swapped)
    column = np.full(BUCKETS, -1)
    column[chosen] = np.arange(len(chosen))
    few = [(column[b][column[b] >= 0], c[column[b] >= 0]) for b, c in rows]
    row = np.repeat(np.arange(n), [len(b) for b, _ in few])
    col, count = np.concatenate([b for b, _ in few]), np.concatenate([c for _, c in few]).astype(np.float32)
    change = np.zeros((len(pairs), len(chosen)))
    for i, (gone, come) in enumerate(pairs):
        np.add.at(change[i], column[terms[come]], 1)
        np.add.at(change[i], column[terms[gone]], -1)
    share = np.array([swapped[p] for p in pairs], float) / max(1, sum(swapped.values()))
    weight = np.where(toxic > 0, 0.5 / pos, 0.5 / (n - pos))  # both classes weigh alike
    w, bias = np.zeros(len(chosen)), 0.0
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, STEPS + 1):  # Adam over the whole sample
        logit = bias + np.bincount(row, weights=w[col] * count, minlength=n)
        error = weight * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - toxic)
        grad = np.bincount(col, weights=error[row] * count, minlength=len(w)) + L2 * w
        grad += 2 * COUNTERFACTUAL * ((share * (change @ w)) @ change)
        grad = np.append(grad, error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) * (1 - step / (STEPS + 1))
        w, bias = w - move[:-1], bias - move[-1]
    weights[chosen] = w
    return Model(weights.astype(np.float32), float(bias))


def telling(sample: DataFrame, n: int, pos: int) -> np.ndarray:
    """The buckets whose share of texts differs most between the classes. sample: t, y."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, bad = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for frame in slices(frames, column="t"):
            for text, y in zip(frame["t"], frame["y"], strict=True):
                buckets = features(text)[0]
                seen[buckets] += 1
                if y:
                    bad[buckets] += 1
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"b": at, "seen": seen[at], "bad": bad[at]})

    found = sample.select("t", "y").mapInPandas(run, "b bigint, seen bigint, bad bigint").groupBy("b").agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad"))
    share = (F.col("seen") + 1) / (n + 2)
    z = (F.col("bad") / pos - (F.col("seen") - F.col("bad")) / (n - pos)) / F.sqrt(share * (1 - share) * (1 / pos + 1 / (n - pos)))
    top = found.filter(F.col("seen") >= LEAST_TEXTS).select("b", F.abs(z).alias("z")).filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "b").limit(FEATURES)
    return np.array([r.b for r in top.collect()], np.int32)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on the labelled rows whose crc32 of the id, modulo 3, is not 1."""
    ids = (
        labels.select(F.col(id_col).alias("i"), F.col(label_col).alias("y"))
        .filter(F.col("y").isNotNull() & F.col("i").isNotNull() & (doc_hash("i", 3) != 1))
        .groupBy("i")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("i"), "i")
        .limit(SAMPLE)
    )
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(ids), "i")
    sample = written(texts.groupBy("i").agg(F.min("t").alias("t"), F.max("y").alias("y")))
    n, pos = sample.agg(F.count("*"), F.coalesce(F.sum((F.col("y") > 0).cast("int")), F.lit(0))).first()
    chosen = np.unique([b for w in TERMS for b in word_buckets(w.encode())])
    if 0 < pos < n:
        chosen = np.union1d(chosen, telling(sample.withColumn("y", F.col("y") > 0), n, pos))

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames, column="t"):
            found = [features(t) for t in frame["t"]]
            few = [np.isin(b, chosen) for b, _ in found]
            pairs = [swaps(t, zlib.crc32(str(i).encode())) for t, i in zip(frame["t"], frame["i"], strict=True)]
            yield pd.DataFrame(
                {
                    "i": [str(i) for i in frame["i"]],
                    "y": (frame["y"] > 0).to_numpy(),
                    "buckets": [b[f].tobytes() for (b, _), f in zip(found, few, strict=True)],
                    "counts": [c[f].tobytes() for (_, c), f in zip(found, few, strict=True)],
                    "swaps": [[g * len(TERMS) + c for g, c in p] for p in pairs],
                }
            )

    packed = sorted((r.i, bytes(r.buckets), bytes(r.counts), r.y, r.swaps) for r in sample.mapInPandas(pack, "i string, y boolean, buckets binary, counts binary, swaps array<int>").collect())
    swapped: dict[tuple[int, int], int] = {}
    for *_, pairs in packed:
        for p in pairs:
            swapped[divmod(p, len(TERMS))] = swapped.get(divmod(p, len(TERMS)), 0) + 1
    rows = [(np.frombuffer(b, np.int32), np.frombuffer(c, np.uint8)) for _, b, c, *_ in packed]
    return fit(rows, np.array([y for *_, y, _ in packed], float), chosen, swapped)


def scores(text: Column, model: Model, session) -> Column:
    """The score of a text column under a model."""
    shared = session.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in frames:
            yield pd.Series([shared.value.score(t) for t in texts], dtype=float)
            release()
        shared.value.memo.clear()

    return run(text)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document."""
    model = train(docs, labels, id_col, text_col)
    found = docs.select(F.col(id_col).alias("doc_id"), scores(F.col(text_col), model, docs.sparkSession).alias("score"))
    return found.select("doc_id", F.coalesce(doc_hash("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that score under the threshold, with their own columns."""
    mark = "__ff_score"
    model = train(docs, labels, id_col, text_col)
    return docs.withColumn(mark, scores(F.col(text_col), model, docs.sparkSession)).filter(F.col(mark) < THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])

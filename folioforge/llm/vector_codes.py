"""Vector code compression: product quantization whose codebooks are trained by Lloyd's rounds with Exponion search.

Vectors become integers, floor(scale * x), and are cut into equal consecutive parts; each part position has a codebook of its
own, which starts as the parts of the vectors with the smallest ids. A round assigns every part to the nearest entry and
replaces each entry by the floored mean of its parts. All distances are exact integers, ties go to the lower index.

Exponion search: a part starts at the entry it had in the round before, at distance u. Entries are looked at in the order of
their distance from that entry, which a table sorted once per round gives. With v the best distance so far, an entry further
than u + v from the start entry is further than v from the part, by the triangle inequality; so the scan ends there. In the
first round all parts start at entry 0.

Each round is a map over the rows and a sum by entry: tasks hand on one partial sum per entry, and the driver holds the codebooks
only, parts * entries * width integers. Rows, their integers and their codes are written once per round, so that a lost executor
costs its own tasks only; the folder before goes. No row is shuffled but in the sums by label.

Rows whose vector is null, empty, or holds null or non-finite components are dropped; so are those whose length is not that of
most vectors (the shortest of the most frequent lengths that the parts divide). Components whose integer would let a squared distance
leave 64 bits are held at the largest that does not (`limit()`, 2^28 at 16 components a part). Of rows with equal ids that may
start the codebooks, those with the smaller vectors come first; null ids come last. With fewer rows than entries the codebooks
are as short as the rows are few; an empty table gives no rows. Repeated rows are counted each.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Neighbours of the start entry that are looked at in one step.
RING = 32
#: Vectors whose codes are searched at once.
ROWS = 16_384


def limit(width: int) -> int:
    """The largest magnitude of a component at which squared distances of `width` components stay under 2^61."""
    return math.isqrt(2**61 // width) // 2


class Codebook:
    """The entries of one part position, with each entry's neighbours by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = np.asarray(entries, np.int64)
        self.size, self.width = self.entries.shape
        far = int(np.abs(self.entries).max(initial=0))
        self.far = far
        between = np.empty((self.size, self.size), np.int64)
        for i in range(self.size):
            between[i] = ((self.entries - self.entries[i]) ** 2).sum(axis=1)
        self.near = np.argsort(between, axis=1, kind="stable")
        self.reach = np.take_along_axis(between, self.near, axis=1)

    def nearest(self, parts: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each part and its squared distance; start: the entries at which the search begins."""
        most = int(np.abs(parts).max(initial=0)) + self.far
        # doubles hold the integers exactly up to 2^53, and are multiplied much faster
        kind = np.float64 if self.width * most * most < 2**53 else np.int64
        x, centres = parts.astype(kind), self.entries.astype(kind)
        own, norms = (x * x).sum(axis=1), (centres * centres).sum(axis=1)
        first = own - 2 * (x * centres[start]).sum(axis=1) + norms[start]
        best, code = first.copy(), start.copy()
        order = np.argsort(start, kind="stable")
        cuts = np.searchsorted(start[order], np.arange(self.size + 1))
        for s in np.unique(start):
            near, reach = self.near[s], self.reach[s]
            at = order[cuts[s] : cuts[s + 1]]
            for ring in range(0, self.size, RING):
                u, v = first[at].astype(np.float64), best[at].astype(np.float64)
                # the square of the radius u + v, rounded up; nothing in the ring or beyond is inside it: done
                at = at[(u + v + 2 * np.sqrt(u) * np.sqrt(v)) * (1 + 1e-9) + 1 >= reach[ring]]
                if not len(at):
                    break
                ids = near[ring : ring + RING]
                far = own[at, None] - 2 * (x[at] @ centres[ids].T) + norms[ids]
                low = far.min(axis=1)
                index = np.where(far == low[:, None], ids, self.size).min(axis=1)
                better = (low < best[at]) | ((low == best[at]) & (index < code[at]))
                best[at[better]], code[at[better]] = low[better], index[better]
        return code, best.astype(np.int64)


def assign(vectors: np.ndarray, books: list[Codebook], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New codes, a column for each part, and the squared distances summed over parts."""
    width = books[0].width
    out, error = np.empty_like(codes), np.zeros(len(vectors), np.int64)
    for p, book in enumerate(books):
        out[:, p], far = book.nearest(vectors[:, p * width : (p + 1) * width], codes[:, p].astype(np.int64))
        error += far
    return out, error


def matrix(column: pa.Array, kind) -> np.ndarray:
    """An Arrow column of lists of equal length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def listed(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.reshape(-1), kind))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def usable(rows: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int) -> DataFrame:
    """id, label and vector (doubles) of the rows that are kept."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").alias("label"), v.alias("x"))
    rows = rows.filter((F.size("x") > 0) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    lengths = rows.groupBy(F.size("x").alias("n")).count().filter(F.col("n") % parts == 0).orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("x") == (lengths.n if lengths else -1))


def integers(rows: DataFrame, scale: int, parts: int) -> DataFrame:
    """The rows with x as integers, and codes, all 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            x = matrix(b.column(2), np.float64)
            most = limit(x.shape[1] // parts)
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(x * scale), -most, most).astype(np.int64)
            codes = np.zeros((len(x), parts), np.int16)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), listed(x, pa.int64()), listed(codes, pa.int16()), pa.array(np.zeros(len(x), np.int64))], ["id", "label", "x", "codes", "error"])

    return rows.mapInArrow(run, f"id bigint, label {rows.schema['label'].dataType.simpleString()}, x array<bigint>, codes array<smallint>, error bigint")


def assigned(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """The rows with new codes and errors."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [Codebook(b) for b in shared.value]
        for b in pieces(batches):
            codes, error = assign(matrix(b.column(2), np.int64), ready, matrix(b.column(3), np.int16))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), listed(codes, pa.int16()), pa.array(error)], ["id", "label", "x", "codes", "error"])
        release()

    return rows.mapInArrow(run, rows.schema)


def means(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after a round: floored means of what was assigned to each entry; unused entries stay."""
    parts, width = len(books), books[0].shape[1]
    size = len(books[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * size, width), np.int64), np.zeros(parts * size, np.int64)
        for b in pieces(batches):
            x, codes = matrix(b.column(0), np.int64), matrix(b.column(1), np.int16)
            for p in range(parts):
                slot = codes[:, p].astype(np.int64)
                order = np.argsort(slot, kind="stable")
                used, first, count = np.unique(slot[order], return_index=True, return_counts=True)
                sums[p * size + used] += np.add.reduceat(x[order, p * width : (p + 1) * width], first, axis=0)
                counts[p * size + used] += count
        used = np.flatnonzero(counts)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), listed(sums[used], pa.int64())], ["slot", "n", "s"])

    found = rows.select("x", "codes").mapInArrow(run, "slot bigint, n bigint, s array<bigint>")
    # sums of very many large components leave 64 bits, so they are added as decimals
    total = found.groupBy("slot").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i].cast("decimal(38,0)")) for i in range(width)]).alias("s"))
    out = [b.copy() for b in books]
    for r in total.toLocalIterator():
        out[r.slot // size][r.slot % size] = [int(x) // r.n for x in r.s]
    return out


def quantize(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """Rows id, label, codes array<smallint> and error of the kept rows, and the codebooks, an array for each part."""
    kept = usable(rows, id_col, vector_col, label_col, parts)
    state = written(integers(kept, scale, parts))
    seeds = state.orderBy(F.col("id").asc_nulls_last(), "x", "label").select("x").limit(entries).collect()
    if not seeds:
        return state.select("id", "label", "codes", "error"), []
    books = [np.ascontiguousarray(b) for b in np.split(np.array([r.x for r in seeds], np.int64), parts, axis=1)]
    for _ in range(rounds):
        state = written(assigned(state, books), drop=[state])
        books = means(state, books)
    last = written(assigned(state, books).select("id", "label", "codes", "error"), drop=[state])
    return last, books


def fingerprint(books: list[np.ndarray]) -> str:
    """sha256 of all components as decimals, by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.reshape(-1)).encode()).hexdigest()


def compressed(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (summed over equal labels, nulls together) and codebooks_sha256.

    Errors over 2^63 - 1 are given as that.
    """
    found, books = quantize(rows, id_col, vector_col, label_col)
    totals = found.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long").alias("label_error")).withColumnRenamed("label", "of")
    code = F.lower(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    return found.join(totals, F.col("label").eqNullSafe(F.col("of"))).select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))

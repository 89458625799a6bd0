"""Ranked lexical search by windowed bucket scoring.

A first pass over the texts keeps of each document its length and the frequencies of the terms that some query holds, and is written
once; sums over it give the corpus statistics. In the second pass a task numbers its documents as they come and takes them
in fixed windows of WINDOW numbers: a window's postings are sorted by term, their scores are worked out once, and each query
adds those of its terms into an array of WINDOW cells that stays in the cache, beside a bitset of the cells in use. What is in use
is harvested into the query's heap of the best so far, and the cells are cleared. A task hands on its heaps, and the
best of those are ranked by query. No posting is shuffled: documents are numbered within a task, as in a segment of an index, so no
order of ids, and no id that is frequent, makes windows thin or tasks large.

Queries come in blocks of up to BLOCK_BYTES of text, whose terms, weights and heaps each task holds; further blocks pass over the
texts again. Scores are exact in 64 bits.

Terms: maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. A null or empty text has none and is
not counted as a document; queries without terms find nothing. Each row is a document of its own, so rows with equal ids may both be
found; equal scores come by ascending id, null ids last. Rows of queries with equal ids are ranked apart.
A very long text is split within its task, which holds its terms once. Other columns are left out.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_slices, plain_words, release, utf8, written

TOP = 20
#: Documents of a window: 32 KB of scores.
WINDOW = 4096
#: Bytes of the queries' texts that are looked for at once.
BLOCK_BYTES = 2 * 2**20

SQL = """
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents
), counts AS (
  SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL
), lengths AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY doc_id
), corpus AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS l FROM lengths
), marks AS (
  SELECT doc_id, 100 - 25 + ((25 * n * docs) // l) AS m FROM lengths, corpus
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM counts, corpus GROUP BY term, docs
), asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark
), scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN marks USING (doc_id) GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


@dataclass
class Queries:
    """A block of queries: their ids, and the terms of each with repeats."""

    ids: list[int | None]
    terms: list[list[tuple[int, int]]]
    vocabulary: dict[bytes, int]

    @classmethod
    def of(cls, rows: list[tuple[int | None, str | None]]) -> Queries:
        vocabulary: dict[bytes, int] = {}
        terms = [sorted(Counter(vocabulary.setdefault(w, len(vocabulary)) for w in plain_words(utf8(t))).items()) for _, t in rows]
        return cls([i for i, _ in rows], terms, vocabulary)


def blocks(queries: DataFrame) -> Iterator[list[tuple[int | None, str | None]]]:
    """The queries (i, t) in blocks by a hash of the row; a block of them all is sorted."""
    queries = queries.filter("t is not null")
    total = queries.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    for k in range(n):
        part = queries if n == 1 else queries.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r.i, r.t) for r in part.orderBy("i", "t").collect()]


def postings(docs: DataFrame, queries: Queries) -> DataFrame:
    """id, n, terms array<int> and tfs array<int> of each document with a term; terms: those of the queries."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(queries.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.value.get
        for b in arrow_slices(batches):
            length, kept, sizes, terms, tfs = [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                words = plain_words(utf8(text))
                if not words:
                    continue
                found = np.fromiter((t for t in map(get, words) if t is not None), np.int32)
                one, count = np.unique(found, return_counts=True)
                kept.append(i)
                length.append(len(words))
                sizes.append(len(one))
                terms.append(one)
                tfs.append(count)
            if kept:
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(np.int32))) for x in (terms, tfs)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(kept)), pa.array(length, pa.int64()), *lists], ["id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, "id bigint, n bigint, terms array<int>, tfs array<int>")


@dataclass
class Corpus:
    """N, L and the weight of each term of the queries."""

    docs: int
    words: int
    weights: np.ndarray

    def marks(self, n: np.ndarray) -> np.ndarray:
        """m of documents with n terms."""
        if int(n.max(initial=0)) * 25 * self.docs < 2**63:
            return 75 + (25 * self.docs * n) // self.words
        return np.array([75 + 25 * int(x) * self.docs // self.words for x in n], np.int64)


def corpus_of(found: DataFrame, terms: int) -> Corpus:
    total = found.agg(F.count("*").alias("d"), F.sum("n").alias("l")).first()
    weights = np.zeros(terms, np.int64)
    for r in found.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
        weights[r.t] = math.floor(1000 * math.log((2 * total.d + 2) / (2 * r["count"] + 1)))
    return Corpus(total.d, total.l or 0, weights)


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task in runs of WINDOW; the last may be shorter."""
    kept, size = [], 0
    for batch in batches:
        kept.append(batch)
        size += batch.num_rows
        if size >= WINDOW:
            table = pa.Table.from_batches(kept)
            full = size - size % WINDOW
            for at in range(0, full, WINDOW):
                yield from table.slice(at, WINDOW).combine_chunks().to_batches()
            kept, size = table.slice(full).to_batches(), size - full
    if size:
        yield from pa.Table.from_batches(kept).combine_chunks().to_batches()


@dataclass
class Best:
    """Heaps of the best documents of each query; an entry is (score, whether the id is known, -id)."""

    queries: Queries
    top: int
    heaps: list[list[tuple[int, bool, int]]] = field(default_factory=list)

    def __post_init__(self):
        self.heaps = [[] for _ in self.queries.ids]
        self.cells, self.used = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, bool)

    def window(self, ids: np.ndarray, known: np.ndarray, place: np.ndarray, terms: np.ndarray, gains: np.ndarray) -> None:
        """Scores a window's documents for all queries; place, terms, gains: its postings."""
        order = np.argsort(terms, kind="stable")
        place, gains = place[order], gains[order]
        first = np.searchsorted(terms[order], np.arange(len(self.queries.vocabulary) + 1)).tolist()
        cells, used = self.cells, self.used
        for query, heap in zip(self.queries.terms, self.heaps, strict=True):
            for term, times in query:
                low, high = first[term], first[term + 1]
                if low < high:
                    at = place[low:high]
                    cells[at] += times * gains[low:high] if times > 1 else gains[low:high]
                    used[at] = True
            at = np.flatnonzero(used)
            if not len(at):
                continue
            score = cells[at]
            cells[at], used[at] = 0, False
            enough = score >= (heap[0][0] if len(heap) == self.top else 1)
            at, score = at[enough], score[enough]
            if len(at) > self.top:
                some = np.lexsort((ids[at], ~known[at], -score))[: self.top]
                at, score = at[some], score[some]
            for s, k, i in zip(score.tolist(), known[at].tolist(), ids[at].tolist(), strict=True):
                if len(heap) < self.top:
                    heapq.heappush(heap, (s, k, -i))
                else:
                    heapq.heappushpop(heap, (s, k, -i))


def best_of_tasks(found: DataFrame, queries: Queries, corpus: Corpus, top: int) -> DataFrame:
    """query (its number), item_id, doc_id, score: the best of each task."""
    shared = found.sparkSession.sparkContext.broadcast((queries, corpus))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, corpus = shared.value
        best = Best(queries, top)
        for b in windows(batches):
            known = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids = b.column(0).fill_null(0).to_numpy()
            sizes = np.diff(b.column(2).offsets.to_numpy())
            terms, tf = (b.column(k).flatten().to_numpy().astype(np.int64) for k in (2, 3))
            place = np.repeat(np.arange(len(ids)), sizes)
            m = corpus.marks(b.column(1).to_numpy())[place]
            best.window(ids, known, place, terms, corpus.weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m)))
        rows = [(q, queries.ids[q], -i if k else None, s) for q, heap in enumerate(best.heaps) for s, k, i in heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["query", "item_id", "doc_id", "score"])
        release()

    return found.mapInArrow(run, "query bigint, item_id bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", top: int = TOP) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the best `top` documents of each item with a score above 0."""
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    items = items.select(F.col(f"`{item_col}`").cast("long").alias("i"), F.col(f"`{item_text_col}`").alias("t"))
    out = None
    for rows in blocks(items):
        queries = Queries.of(rows)
        found = written(postings(docs, queries))
        part = written(best_of_tasks(found, queries, corpus_of(found, len(queries.vocabulary)), top), drop=[found])
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        part = part.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out

"""Packing of documents into token sequences by order-preserving dynamic programming.

Documents keep their order: those of a task form one stream of tokens, which is cut into windows of at most `length` tokens, one
per sequence. Cuts fall at ends of documents or, for a penalty, at ends of sentences; a window costs the tokens that pad it to
`length`, nothing if its size is a power of two. With c the places where a cut may fall, the least cost up to place j is

    f[j] = penalty[j] + min over i with c[j] - c[i] <= length of f[i] + padding(c[j] - c[i])

As padding falls with the size, the minimum over i is that of f[i] + c[i] within a window of places that only moves
forward: a monotone queue gives it in constant time. Sizes of a power of two add a place or none each. The stream is solved in
blocks of BLOCK tokens; each block is cut at its best place within the last `length` tokens, and the rest goes to the next one. A
stretch of STRETCH tokens without an end of a sentence gets places of its own, for a higher penalty. What is left at the end of a task
is split into powers of two where that costs less than padding it.

A map over rows: nothing is shuffled, a task holds a block, and a task that is run again gives the same rows, as it reads the same
ones. Sequence ids are the number of the task times 2^33 plus that of the window.

Null and empty texts consist of the end token only. Each row is a document, repeated rows and ids too; ids may be null. Of an empty
table come no rows. A very long text is tokenized by its words like others, and its ids are held by one task. Other columns are left out.
"""

from __future__ import annotations

import re
import sys
from collections import deque
from collections.abc import Iterable, Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_slices, release

LENGTH = 4096
#: The id after each document.
END = 2
#: What a cut at the end of a sentence and elsewhere within a document costs, in tokens of padding.
SENTENCE_CUT, HARD_CUT = 16, 96
#: Tokens without an end of a sentence after which a cut may fall anyway.
STRETCH = 256
#: The smallest power of two that a sequence may have but at the end of a task.
LEAST_POWER = 256
#: Tokens that are solved at once.
BLOCK = 2**19
#: Words whose ids a worker keeps in each of two generations, and the bytes of the texts that are tokenized at once.
MEMO, TEXT_BYTES = 500_000, 2_000_000

_TAIL = ".,;:!?"
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_BLANKS = re.compile("[ \t\n\r]+")
#: Up to here letters are told from marks, and lower case is made, alike everywhere.
_LATIN_END = "\u0250"


def vocabulary_file() -> str:
    """The tokenizer's file, wherever the module of public tokenizers is on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in the vocabulary: printable bytes for themselves, the others for those from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Words:
    """Tokenizes texts word by word: the tokenizer drops white space and looks at no word's neighbours, so each distinct word is tokenized
    once. What is learnt is kept in two generations: once MEMO words are known, those that were not used since the last time go."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.letters = byte_letters()
        names = self.tokenizer.get_vocab()
        self.piece = [int(i).to_bytes(4, "little") for i in range(max(names.values(), default=0) + 1)]
        self.ends = np.zeros(len(self.piece), bool)
        for name, i in names.items():
            mark = name.removesuffix("</w>")
            self.ends[i] = bool(set(mark) & set(".!?")) and set(mark) <= set(".!?\"')]")

    def learn(self, words: Iterable[str]) -> None:
        """Adds new words. Latin letters go to the model in lower case, marks after them are a word of their own; all else goes the whole way."""
        known, older, piece, tokenize = self.known, self.older, self.piece, self.tokenizer.model.tokenize
        other: list[str] = []
        for w in words:
            ids = older.get(w)
            if ids is None:
                head = w.rstrip(_TAIL)
                low = head.lower()
                if not (low.isalpha() and (low.isascii() or (max(low) < _LATIN_END and is_normalized("NFC", head)))):
                    other.append(w)
                    continue
                ids = known.get(low) or older.get(low)
                if ids is None:
                    form = low if low.isascii() else low.encode().decode("latin-1").translate(self.letters)
                    ids = known[low] = b"".join([piece[t.id] for t in tokenize(form)])
                if len(head) < len(w):
                    tail = w[len(head) :]
                    if tail not in known:
                        known[tail] = b"".join([piece[i] for i in self.tokenizer.encode(tail, add_special_tokens=False).ids])
                    ids += known[tail]
            known[w] = ids
        for w, found in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
            known[w] = b"".join([piece[i] for i in found.ids])

    def encode_all(self, texts: list[str | None], end: bytes = b"") -> list[bytes]:
        """The ids of each text, as 32-bit little-endian integers, and `end`."""
        texts = [words_in(t) if t else [] for t in texts]
        if len(self.known) > MEMO:
            self.older, self.known = self.known, {}
        self.learn(set().union(*texts).difference(self.known))
        ids = self.known.__getitem__
        return [b"".join(map(ids, words)) + end for words in texts]


def words_in(text: str) -> list[str]:
    """The words between white space, as the tokenizer sees it: not at the four separators that str.split takes for blanks too."""
    if any(c in text for c in _SEPARATORS):
        return [w for w in _BLANKS.split(text) if w]
    return text.split()


def words_of(path: str) -> Words:
    """The tokenizer, once per process: kept in `sys`, as this module's own globals travel with each task."""
    kept = sys.__dict__.setdefault("_folioforge_words", {})
    if path not in kept:
        kept[path] = Words(path)
    return kept[path]


def power_of_two(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


def solve(places: np.ndarray, penalty: np.ndarray, length: int, least: int = LEAST_POWER) -> tuple[list[int], list[int]]:
    """f and, for each place, the place before it on the best way there; places start with 0 and are at most `length` apart."""
    pairs = []
    power = least
    while power <= length:
        at = np.searchsorted(places, places - power)
        hit = np.flatnonzero(places[at] == places - power)
        pairs.append(np.stack([hit, at[hit]], axis=1))
        power *= 2
    exact = np.concatenate([*pairs, np.zeros((0, 2), np.int64)])
    exact = exact[np.argsort(exact[:, 0], kind="stable")]
    first = np.searchsorted(exact[:, 0], np.arange(len(places) + 1)).tolist()
    exact, c, fine = exact[:, 1].tolist(), places.tolist(), penalty.tolist()
    f, before = [0] * len(c), [0] * len(c)
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # f[i] + c[i], c[i], i: rising in both
    for j in range(1, len(c)):
        here = c[j]
        while queue[0][1] < here - length:
            queue.popleft()
        best, _, i = queue[0]
        best += length - here
        for k in exact[first[j] : first[j + 1]]:
            if f[k] < best:
                best, i = f[k], k
        best += fine[j]
        f[j], before[j] = best, i
        best += here
        while queue and queue[-1][0] > best:
            queue.pop()
        queue.append((best, here, j))
    return f, before


def way(before: list[int], j: int) -> list[int]:
    """The places on the best way to place j, 0 and j included."""
    out = [j]
    while j:
        j = before[j]
        out.append(j)
    return out[::-1]


def splits(rest: int, length: int) -> list[int]:
    """The sizes of the last sequences: powers of two if cutting them apart costs less than padding, else one."""
    powers = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
    return powers if (len(powers) - 1) * HARD_CUT < length - rest else [rest]


class Stream:
    """The documents of a task, from the first token that stands in no sequence yet."""

    def __init__(self, ends: np.ndarray, length: int, base: int):
        self.ends, self.length, self.next = ends, length, base
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple[int | None, int, int]] = []  # id, tokens, tokens that stand in sequences
        self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.docs.append((doc_id, len(ids), 0))
        self.tokens += len(ids)

    def places(self, ids: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where cuts may fall, and what they cost; stops: ends of documents."""
        sentence = np.flatnonzero(self.ends[ids]) + 1
        c = np.unique(np.concatenate([[0], sentence, stops]))
        gap = np.diff(c)
        more = (gap - 1) // min(STRETCH, self.length)
        wide = np.repeat(np.arange(len(gap)), more)
        step = np.arange(len(wide)) - np.repeat(np.cumsum(more) - more, more) + 1
        hard = c[wide] + step * min(STRETCH, self.length)
        cost = np.concatenate([np.full(len(c), SENTENCE_CUT), np.full(len(hard), HARD_CUT)])
        c = np.concatenate([c, hard])
        order = np.argsort(c, kind="stable")
        c, cost = c[order], cost[order]
        cost[np.isin(c, stops)] = 0
        return c, cost

    def flush(self, last: bool) -> pa.RecordBatch | None:
        """Cuts the block: all of it if it is the last, else up to its best place near the end."""
        if not self.tokens:
            return None
        ids = np.concatenate(self.ids)
        left = np.array([n - done for _, n, done in self.docs], np.int64)
        stops = np.cumsum(left)
        c, cost = self.places(ids, stops)
        f, before = solve(c, cost, self.length)
        if last:
            low = int(np.searchsorted(c, c[-1] - self.length))
            ends = [(f[i] + min(0 if power_of_two(r := int(c[-1] - c[i])) else self.length - r, (r.bit_count() - 1) * HARD_CUT), -i) for i in range(low, len(c) - 1)]
            start = -min(ends)[1]
            cuts = [*c[way(before, start)].tolist()]
            for size in splits(int(c[-1]) - cuts[-1], self.length):
                cuts.append(cuts[-1] + size)
        else:
            low = int(np.searchsorted(c, c[-1] - self.length, "right"))
            cuts = c[way(before, min(range(low, len(c)), key=f.__getitem__))].tolist()
        out = self.pieces(ids, left, stops, np.array(cuts, np.int64))
        # what lies after the last cut stays
        done = cuts[-1]
        k = int(np.searchsorted(stops, done, "right"))
        docs = self.docs[k:]
        if docs:
            i, n, was = docs[0]
            docs[0] = (i, n, was + max(0, done - int(stops[k] - left[k])))
        self.docs, self.ids, self.tokens = docs, [ids[done:].copy()], len(ids) - done
        return out

    def pieces(self, ids: np.ndarray, left: np.ndarray, stops: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
        begin = stops - left
        start = np.union1d(cuts[:-1], begin[begin < cuts[-1]])
        size = np.diff(np.append(start, cuts[-1]))
        doc = np.searchsorted(begin, start, "right") - 1
        window = np.searchsorted(cuts, start, "right") - 1
        raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
        done = np.array([d for _, _, d in self.docs], np.int64)
        total = np.array([n for _, n, _ in self.docs], np.int64)
        out = [
            pa.array([self.docs[d][0] for d in doc.tolist()], pa.int64()),
            pa.array(start - begin[doc] + done[doc]),
            pa.array(size),
            pa.array([bytes(raw[4 * a : 4 * (a + n)]) for a, n in zip(start.tolist(), size.tolist(), strict=True)], pa.binary()),
            pa.array(total[doc]),
            pa.array(self.next + window),
            pa.array(start - cuts[window]),
        ]
        self.next += len(cuts) - 1
        return pa.RecordBatch.from_arrays(out, NAMES)


NAMES = ["doc_id", "start", "length", "tokens", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, model: str | None = None) -> DataFrame:
    """A row for each piece of a document: doc_id, start, length, tokens (binary, 32-bit little-endian ids), doc_tokens, sequence_id, offset."""
    end = END.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, stream = words_of(model or vocabulary_file()), None
        for b in arrow_slices(batches, size=TEXT_BYTES):
            if stream is None:
                stream = Stream(words.ends, length, b.column(2)[0].as_py() << 33)
            for i, ids in zip(b.column(0).to_pylist(), words.encode_all(b.column(1).to_pylist(), end), strict=True):
                stream.add(i, np.frombuffer(ids, "<u4"))
                if stream.tokens >= BLOCK:
                    yield stream.flush(False)
        if stream is not None and (out := stream.flush(True)) is not None:
            yield out
        release()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.spark_partition_id().cast("long").alias("task"))
    return rows.mapInArrow(run, "doc_id bigint, start bigint, length bigint, tokens binary, doc_tokens bigint, sequence_id bigint, offset bigint")


def sequences(packed: DataFrame, length: int = LENGTH, pad: int = 0) -> DataFrame:
    """sequence_id, n_tokens and tokens (binary), padded by id `pad` to `length` or left at a power of two; a sequence has at most `length` pieces."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "tokens")))
    whole = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.concat_ws("", F.transform(parts, lambda p: F.hex(p["tokens"]))).alias("h"))
    mark = int(pad).to_bytes(4, "little").hex().upper()
    full = F.when(F.bit_count("n_tokens") == 1, F.col("h")).otherwise(F.rpad("h", 8 * length, mark))
    return whole.select("sequence_id", "n_tokens", F.unhex(full).alias("tokens"))


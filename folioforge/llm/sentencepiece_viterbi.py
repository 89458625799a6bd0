"""SentencePiece encoding and decoding by an Aho-Corasick automaton and a single-pass Viterbi.

The vocabulary is that of a public tokenizer's file and is never trained here. Its pieces carry merge ranks only, so a piece
of rank r gets the unigram log probability of Zipf's law, -ln(r + 1) less a constant. The automaton holds all pieces: at
each position the state's output links give every piece that ends there, longest first, and each relaxes the best score of
that position. Characters outside the vocabulary fall back to their UTF-8 bytes, so decoding gives back every text,
character for character.

Pieces hold the blank mark only as a prefix; so a text splits into independent chunks (marks, then other characters). The
distinct chunks of a slice of texts step through the automaton side by side, one character at a time, and the paths of
frequent chunks are kept in a bounded memo. Null gives null ids, an empty text none; repeated rows give equal ids; other
columns are left out.
"""

from __future__ import annotations

import math
import os
import re
import sys
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: What a byte outside the vocabulary costs besides the rarest piece.
BYTE_PENALTY = 10.0
#: Chunks whose path a worker keeps, and the longest of them.
MEMO, MEMO_CHARS = 60_000, 48
#: Cells of the table in which chunks are relaxed side by side; a longer chunk has a table of its own.
CELLS = 1_000_000
#: Characters of the texts that are encoded at once.
ENCODE_CHARS = 2_000_000

_CHUNKS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+$")
_MARKS = re.compile(f"({BLANK}+)")


class Pieces:
    """A vocabulary with its automaton, in flat arrays. State 0 is the root, and no piece."""

    def __init__(self, path: str = MODEL):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.byte_ids = np.zeros(256, np.int64)
        self.plain: list[bytes] = [b""] * size
        normal: list[tuple[float, int, str]] = []
        for i in range(size):
            if model.is_byte(i):
                byte = int(model.id_to_piece(i)[1:-1], 16)
                self.byte_ids[byte], self.plain[i] = i, bytes([byte])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                piece = model.id_to_piece(i)
                if BLANK in piece.lstrip(BLANK):
                    raise ValueError(f"piece {piece!r} holds a blank mark inside")
                self.plain[i] = piece.replace(BLANK, " ").encode()
                normal.append((-model.get_score(i), i, piece))
        normal.sort()
        constant = math.log(sum(1 / (rank + 1) for rank in range(len(normal))))
        self.byte_score = -math.log(len(normal) + 1) - constant - BYTE_PENALTY
        self.score_of = {piece: -math.log(rank + 1) - constant for rank, (_, _, piece) in enumerate(normal)}
        self.build([(piece, i) for _, i, piece in normal])
        self.plain_size = np.array([len(x) for x in self.plain], np.int64)
        self.plain_start = np.cumsum(self.plain_size) - self.plain_size
        self.plain_bytes = np.frombuffer(b"".join(self.plain), np.uint8)
        self.memo: dict[str, bytes] = {}  # int32 ids
        self.mark = self.byte_ids[list(BLANK.encode())].astype(np.int32).tobytes()

    def build(self, pieces: list[tuple[str, int]]) -> None:
        edges: list[dict[str, int]] = [{}]
        piece, length = [-1], [0]
        for text, i in pieces:
            at = 0
            for depth, c in enumerate(text):
                nxt = edges[at].get(c)
                if nxt is None:
                    nxt = edges[at][c] = len(edges)
                    edges.append({})
                    piece.append(-1)
                    length.append(depth + 1)
                at = nxt
            piece[at] = i
        fail, link = [0] * len(edges), [0] * len(edges)  # link: the longest proper suffix that is a piece
        queue = [0]
        for at in queue:
            for c, nxt in edges[at].items():
                back = fail[at]
                while at and back and c not in edges[back]:
                    back = fail[back]
                fail[nxt] = edges[back].get(c, 0) if at else 0
                link[nxt] = fail[nxt] if piece[fail[nxt]] >= 0 else link[fail[nxt]]
                queue.append(nxt)
        keys = sorted((at << 21 | ord(c), nxt) for at, out in enumerate(edges) for c, nxt in out.items())
        self.keys = np.array([k for k, _ in keys], np.int64)
        self.goto = np.array([n for _, n in keys], np.int64)
        self.fail, self.link = np.array(fail, np.int64), np.array(link, np.int64)
        self.piece, self.length = np.array(piece, np.int64), np.array(length, np.int64)
        self.score = np.full(len(edges), -np.inf)
        for text, _ in pieces:
            at = 0
            for c in text:
                at = edges[at][c]
            self.score[at] = self.score_of[text]
        self.single = np.zeros(0x110000, bool)  # characters that are pieces of their own
        self.single[[ord(t) for t, _ in pieces if len(t) == 1]] = True

    def step(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The states after one more character each."""
        out = np.zeros(len(state), np.int64)
        due, at = np.arange(len(state)), state
        while len(due):
            want = at << 21 | codes[due]
            place = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            hit = self.keys[place] == want
            out[due[hit]] = self.goto[place[hit]]
            left = ~hit & (at > 0)
            due, at = due[left], self.fail[at[left]]
        return out

    def relax(self, codes: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best paths of chunks in order of falling size, as (chunk, place of the piece's last character, id; -1: bytes)."""
        n, width = len(size), int(size[0])
        best, choice, reach = np.zeros((width + 1, n)), np.full((width + 1, n), -1), np.ones((width + 1, n), np.int64)
        state = np.zeros(n, np.int64)
        longer = n - np.searchsorted(size[::-1], np.arange(width), "right")
        for j in range(1, width + 1):
            k = longer[j - 1]
            c = codes[first[:k] + j - 1]
            state = self.step(state[:k], c)
            cost = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
            top = np.where(self.single[c], -np.inf, best[j - 1, :k] + self.byte_score * cost)
            node = np.where(self.piece[state] >= 0, state, self.link[state])
            due = np.flatnonzero(node)
            node = node[due]
            while len(due):
                length = self.length[node]
                total = best[j - length, due] + self.score[node]
                won = total > top[due]
                up = due[won]
                top[up], choice[j, up], reach[j, up] = total[won], self.piece[node[won]], length[won]
                node = self.link[node]
                due, node = due[node > 0], node[node > 0]
            best[j, :k] = top
        at, who, steps = size.copy(), np.arange(n), []
        while len(who := who[at[who] > 0]):
            place = at[who]
            steps.append((who, place - 1, choice[place, who]))
            at[who] -= reach[place, who]
        return tuple(np.concatenate(x) for x in zip(*steps, strict=True))

    def together(self, chunks: list[str]) -> list[tuple[int, ...]]:
        """The ids of each chunk's best path; of equal paths the one whose last piece is longest. No chunk may be empty."""
        chunks_by_size = sorted(range(len(chunks)), key=lambda i: -len(chunks[i]))
        out: list = [None] * len(chunks)
        done = 0
        while done < len(chunks):
            some = chunks_by_size[done : done + max(1, CELLS // (len(chunks[chunks_by_size[done]]) + 1))]
            done += len(some)
            joined = "".join([chunks[i] for i in some])
            size = np.fromiter((len(chunks[i]) for i in some), np.int64, len(some))
            first = np.cumsum(size) - size
            codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            codes[(codes >= 0xD800) & (codes < 0xE000)] = 63  # a lone surrogate is written as '?'
            who, place, ids = self.relax(codes, first, size)
            order = np.lexsort((place, who))
            who, place, ids = who[order], place[order], ids[order]
            if (ids < 0).any():  # each such character gives its bytes
                own = [self.byte_ids[list(chr(c).encode())] for c in codes[(first[who] + place)[ids < 0]]]
                count = np.ones(len(ids), np.int64)
                count[ids < 0] = [len(b) for b in own]
                whole = np.repeat(ids, count)
                whole[np.repeat(ids < 0, count)] = np.concatenate(own)
                who, ids = np.repeat(who, count), whole
            flat = ids.tolist()
            cut = np.searchsorted(who, np.arange(len(some) + 1)).tolist()
            for k, i in enumerate(some):
                out[i] = tuple(flat[cut[k] : cut[k + 1]])
        return out

    def plan(self, text: str) -> list[str | None]:
        """A text's chunks as keys of the memo: see chunk_of(); None stands for a mark of the text itself."""
        if not text:
            return []
        if BLANK not in text and "  " not in text and text[0] != " ":
            return text.split(" ")
        keys: list[str | None] = []
        for i, part in enumerate(_MARKS.split(" " + text)):
            if i % 2:
                keys += [None] * len(part)
            else:
                for chunk in _CHUNKS.findall(part.replace(" ", BLANK)):
                    keys.append(BLANK + chunk if chunk[0] != BLANK else chunk if chunk[:2] == BLANK * 2 else chunk[1:])
        return keys

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """The ids of each text."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        get = self.memo.get
        plans: list[tuple[list, list] | None] = []
        new: set[str] = set()
        for text in texts:
            if not isinstance(text, str):
                plans.append(None)
                continue
            keys = self.plan(text)
            paths = list(map(get, keys))
            if None in paths:
                new.update(compress(keys, [p is None for p in paths]))
            plans.append((keys, paths))
        new.discard(None)
        keys = list(new)
        found = {k: np.array(ids, np.int32).tobytes() for k, ids in zip(keys, self.together([chunk_of(k) for k in keys]), strict=True)}
        self.memo.update(item for item in found.items() if len(item[0]) <= MEMO_CHARS)
        found[None] = self.mark
        out: list[np.ndarray | None] = []
        for plan in plans:
            if plan is None:
                out.append(None)
                continue
            keys, paths = plan
            if None in paths:
                paths = [found[k] if p is None else p for k, p in zip(keys, paths, strict=True)]
            out.append(np.frombuffer(b"".join(paths), np.int32))
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids) -> str:
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return ""
        size = self.plain_size[ids]
        end = np.cumsum(size)
        at = np.arange(end[-1]) + np.repeat(self.plain_start[ids] - end + size, size)
        return self.plain_bytes[at].tobytes().decode("utf-8", "replace")[1:]


def chunk_of(key: str) -> str:
    """The chunk of a memo's key: a word stands for the mark and the word; after one mark stands a chunk without any; chunks with more marks stand for themselves."""
    return BLANK + key if key[:1] != BLANK else key if key[:2] == BLANK * 2 else key[1:]


def pieces(path: str = MODEL) -> Pieces:
    """The vocabulary, once per process: kept in `sys`, as this module's own globals travel with each task."""
    kept = sys.__dict__.setdefault("_folioforge_pieces", {})
    key = os.path.abspath(path)
    if key not in kept:
        kept[key] = Pieces(path)
    return kept[key]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """doc_id, ids array<int>, n_tokens, exact (decoding gives back the text). A map over rows: no shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = pieces(model)
        for frame in slices(frames, chars=ENCODE_CHARS):
            texts = [t if isinstance(t, str) else None for t in frame["text"]]
            ids = vocabulary.encode_all(texts)
            yield pd.DataFrame(
                {
                    "doc_id": frame["doc_id"].astype("Int64").to_numpy(dtype=object),
                    "ids": ids,
                    "n_tokens": [0 if i is None else len(i) for i in ids],
                    "exact": [i is None or vocabulary.decode(i) == t for i, t in zip(ids, texts, strict=True)],
                }
            )
        vocabulary.memo.clear()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id bigint, ids array<int>, n_tokens bigint, exact boolean")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """doc_id and text from ids; null ids give a null text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = pieces(model)
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64").to_numpy(dtype=object), "text": [None if i is None else vocabulary.decode(i) for i in frame["ids"]]})

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInPandas(run, "doc_id bigint, text string")

"""Quality rule by compression bands.

A text is judged by zstandard's ratio (compressed bytes / UTF-8 bytes) as a whole and over fixed chunks, the last and shorter one
included. Low ratios mean repetition, high ones noise; how low and how high is allowed depends on the length, since short texts
compress badly. A text is rejected if its own ratio is outside its band, or those of chunks that hold more than CHUNK_SHARE of it.

Nulls and empty texts count no words and fail the base rule. Repeated rows are judged alike. Other columns are left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8

#: Limits of the ratio by length: (UTF-8 bytes from which they hold, least ratio, most). Prose keeps well inside: at 1 KiB it has 0.41
#: to 0.59, at 16 KiB 0.34 to 0.43; texts that say the same again and again have 0.25 at most, base64 0.75 or more.
BANDS = ((0, 0.30, 6.00), (64, 0.30, 1.40), (128, 0.30, 1.05), (256, 0.28, 0.90), (512, 0.26, 0.80), (1024, 0.24, 0.72), (4096, 0.20, 0.68), (16384, 0.16, 0.66), (65536, 0.12, 0.64))
#: Chunks are judged by the band of their length.
CHUNK_BYTES = 1024
#: The share of a text that odd chunks may hold.
CHUNK_SHARE = 0.3
LEVEL = 3

_BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
_SYMBOLS = "#*$%&|<>"

SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
    "kept boolean, ratio double, n_chunks bigint, n_odd_chunks bigint, reason string"
)


def band(n_bytes: int) -> tuple[float, float]:
    return next((low, high) for start, low, high in reversed(BANDS) if n_bytes >= start)


def in_band(packed: int, size: int) -> bool:
    low, high = band(size)
    return low <= packed / size <= high


def repeated_window_words(words: list[bytes], size: int = 3) -> int:
    """Words that stand in a window of `size` words found twice or more."""
    if len(words) <= size:
        return 0
    windows = list(zip(*(words[i:] for i in range(size)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    starts = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for i in range(size):
        covered[i : i + len(windows)] |= starts
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def judge(text: str | None, packer: zstandard.ZstdCompressor) -> tuple:
    text = text if isinstance(text, str) else ""
    raw = utf8(text)
    words = raw.split()
    n, repeat = len(words), repeated_window_words(words)
    failed = n < 50 or 100 * repeat > 50 * n
    ratio = len(packer.compress(raw)) / len(raw) if raw else None
    low, high = band(len(raw))
    chunks = [raw[i : i + CHUNK_BYTES] for i in range(0, len(raw), CHUNK_BYTES)]
    odd = [c for c in chunks if not in_band(len(packer.compress(c)), len(c))]
    reason = "base" if failed else "repetitive" if ratio < low else "incompressible" if ratio > high else "chunks" if sum(map(len, odd)) > CHUNK_SHARE * len(raw) else "kept"
    chars = len(text) - sum(map(text.count, _BLANKS))
    return n, chars, sum(map(text.count, _SYMBOLS)), duplicate_lines(text), repeat, failed, reason == "kept", ratio, len(chunks), len(odd), reason


def compression_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the base counts, the ratios and the verdict. A map over rows: no shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for frame in slices(frames):
            rows = [judge(t, packer) for t in frame["text"]]
            out = pd.DataFrame(rows, columns=names[1:])
            out.insert(0, names[0], frame["doc_id"].astype("Int64").to_numpy(dtype=object))
            yield out

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, SCHEMA)

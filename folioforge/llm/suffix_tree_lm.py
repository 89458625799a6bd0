"""Language-model scoring with a probabilistic suffix tree over the words of texts.

Tokens are lower-cased words (A-Z only) and one end for each text. The next token depends on the longest retained suffix of
the tokens before it, of any length, the end of the text before (its start) included; contexts never reach over a start. Without
a context a token has its share of all training tokens, each count one more than it is; all unknown words are one more token.
That is base_score, so that score - base_score is what the contexts tell.

A context tells apart the tokens that followed it CUT times and were seen LEAST_COUNT times in all; what else followed it is one
class (the pool), within which its suffix decides. Distributions are smoothed by their suffix's: the pool has the weight of its
size and of the number of tokens told apart. A context is retained if it was seen LEAST_COUNT times and what follows it diverges
from what its suffix says by LEAST_GAIN nats in all, and if it is longer than a word by LEAST_MEAN nats on average, each occurrence
judged by the counts of the others. Contexts grow word by word, from a retained suffix and from a context without their last word,
until none is added; as two words may tell what neither tells alone, all contexts of one word seen LEAST_COUNT times are inner
nodes, and those that fail the test say what no context says. These bounds are the same for a corpus of any size.

Texts are split into words twice: to count the words, and for the scores without contexts, when their tokens are written as numbers;
contexts are counted and looked up in these. Words seen less than LEAST_COUNT times are in no context and never told apart, so they are
one number there.

A token's score is a sum: its score without a context, a term for each retained context before it, and one for each that tells it
apart. Terms of high counts, TERMS * HOT at most, are broadcast; the others are joined, for one of ROUNDS shares of the texts after
another, so that the disk holds one share of the keys that are looked up. Counts of words are broadcast or joined likewise. Tokens and
contexts are told apart by 64-bit hashes. All is counted in all training texts.

Null and empty texts consist of the end alone. A very long text is held by one task as a list of its tokens' numbers, 8 bytes each. A null id counts as training, not held out. Repeated rows are counted and
scored as often as they stand. With no training texts every count is 0. Other columns are left out.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_hash, lowered, shuffles_go, slices, utf8, written

#: How often contexts, and tokens that they tell apart, were seen at least; nats that a context tells in all, and on average; how often a token followed a context that tells it apart.
LEAST_COUNT, LEAST_GAIN, LEAST_MEAN, CUT = 8, 12.0, 0.3, 2
HOT, TERMS, ROUNDS = 1 << 18, 8, 3
#: Distinct words that a task gathers before it hands their counts on.
GATHER = 200_000
#: Tokens after contexts that a task gathers before it adds up their counts; of which so many, of all tasks, are merged at a time; characters of the texts, or bytes of their tokens, that are looked at at once.
STEPS, MERGED, SCORE_CHARS = 1_000_000, 1 << 17, 3_000_000
#: Bytes of a word whose count may be broadcast.
HOT_BYTES = 64

#: Bits of the filters that tell tasks which contexts to count and which terms to look for, as a power of two. They only save work: what passes wrongly is dropped later.
BITS, PAIR_BITS = 24, 27

#: Odd multipliers of the hashes of contexts.
_CHAIN, _PAIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
END = b"\n"  # stands in no word


def words_of(text: str | None) -> list[bytes]:
    return lowered(utf8(text)).split()


def word_counts(texts: DataFrame) -> DataFrame:
    """w, n: how often each word stands in the texts (column text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[bytes] = Counter()
        for frame in slices(frames, chars=SCORE_CHARS):
            for text in frame["text"]:
                counts.update(words_of(text))
            if len(counts) > GATHER:
                yield pd.DataFrame({"w": list(counts.keys()), "n": list(counts.values())})
                counts.clear()
        if counts:
            yield pd.DataFrame({"w": list(counts.keys()), "n": list(counts.values())})

    return texts.select("text").mapInPandas(run, "w binary, n bigint").groupBy("w").agg(F.sum("n").alias("n"))


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _PAIR
    return x ^ (x >> np.uint64(29))


def followed(code: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The key of a token after a context; after the empty context (0) it is the token's own hash."""
    return np.where(code == 0, token, mixed(mixed(code) + token))


def power(d: int) -> np.uint64:
    return np.uint64(pow(int(_CHAIN), d, 1 << 64))


def _unsigned(frame: pd.DataFrame, *columns: str) -> list[np.ndarray]:
    return [frame[c].to_numpy(np.int64).view(np.uint64) for c in columns]


class Filter:
    """Which codes a table has: a Bloom filter of bounded size."""

    def __init__(self, codes: DataFrame, column: str = "code", size: int = BITS, places: int = 1):
        self.size, self.places = size, places

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pages: dict[int, np.ndarray] = {}
            for frame in frames:
                place = np.unique(np.concatenate([_place(_unsigned(frame, column)[0], size, k) for k in range(places)]))
                at, first = np.unique(place >> 15, return_index=True)
                for k, own in zip(at.tolist(), np.split(place, first[1:]), strict=True):
                    bits = np.zeros(1 << 15, bool)
                    bits[own & 32767] = True
                    pages[k] = pages[k] | np.packbits(bits) if k in pages else np.packbits(bits)
            yield pd.DataFrame({"at": list(pages), "bits": [zlib.compress(x.tobytes(), 1) for x in pages.values()]})

        parts = codes.select(column).mapInPandas(run, "at bigint, bits binary")
        self.bits = np.zeros(1 << (size - 3), np.uint8)
        for r in parts.groupBy(F.pmod("at", F.lit(64)).alias("part")).applyInPandas(_either, "at bigint, bits binary").collect():
            self.bits[r.at << 12 : (r.at + 1) << 12] = np.frombuffer(zlib.decompress(r.bits), np.uint8)

    def has(self, code: np.ndarray) -> np.ndarray:
        found = np.ones(len(code), bool)
        for k in range(self.places):
            place = _place(code, self.size, k)
            found &= (self.bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)
        return found


def _place(code: np.ndarray, size: int, k: int) -> np.ndarray:
    """Where the k-th bit of each code stands, of 2^size."""
    return (mixed(code) << np.uint64(k * size) >> np.uint64(64 - size)).astype(np.int64)


def _either(part: pd.DataFrame) -> pd.DataFrame:
    out = {}
    for k, own in part.groupby("at")["bits"]:
        bits = np.zeros(1 << 12, np.uint8)
        for x in own:
            bits |= np.frombuffer(zlib.decompress(x), np.uint8)
        out[k] = zlib.compress(bits.tobytes(), 1)
    return pd.DataFrame({"at": list(out), "bits": list(out.values())})


def joined(parts: pd.Series, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows, and how many each row has."""
    return np.frombuffer(b"".join(parts), kind), parts.map(len).to_numpy(np.int64) // np.dtype(kind).itemsize


class Contexts:
    """Filters: for each depth, of the contexts of so many words; of the keys that have a term."""

    def __init__(self, hot: np.ndarray):
        self.hot = np.append(hot, np.uint64(0))  # by number; -1 is a word that no context holds
        self.levels: list[Filter] = []
        self.pairs: Filter | None = None

    def hashed(self, frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all tokens, and how many each text has. ids: numbers of hot words, and, from their end on, of those whose hashes are in `more`."""
        ids, size = joined(frame["ids"], np.int32)
        more, extra = joined(frame["more"], np.uint64)
        n = len(self.hot) - 1
        rare = ids >= n
        if not rare.any():
            return self.hot[ids], size
        at = ids + np.repeat(np.cumsum(extra) - extra, size) - n
        seq = self.hot[np.where(rare, -1, ids)]
        seq[rare] = more[at[rare]]
        return seq, size

    def steps(self, tokens: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each depth, of the tokens after a context that the filters pass: text, context's code, its suffix's code, token's hash. See hashed()."""
        text = np.repeat(np.arange(len(size)), size)
        into = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size) + 1
        seq = np.append(tokens[-1:], tokens)  # before a text's first token stands the end of the one before it
        due, up = np.arange(len(text)), np.zeros(len(text), np.uint64)
        for d, level in enumerate(self.levels, 1):
            first = seq[due + 1 - d]
            ok = (into[due] >= d) & (first != 0)
            due, up, first = due[ok], up[ok], first[ok]
            code = up + first * power(d)
            ok = level.has(code)
            due, up, code = due[ok], up[ok], code[ok]
            yield text[due], code, up, seq[due + 1]
            up = code


def tally(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands first, by the keys' first bits, and what its n add up to. Keys that differ in their last bits only may be listed twice."""
    bits = np.uint64(max(1, len(key).bit_length()))
    packed = (key >> bits << bits) | np.arange(len(key), dtype=np.uint64)
    packed.sort()
    order = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    key = key[order]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return order[start], np.add.reduceat(n[order], start)


def followers(tokens: DataFrame, contexts: Contexts, few: int, total: int) -> DataFrame:
    """code, token, n, key, above: the tokens that follow a context of the deepest level `few` times; key: of the token after the context, above: after its suffix.

    Tasks hand counts on as arrays, dealt by the first bits of their keys into parts of some MERGED tokens (total: all tokens)."""
    shared, bits = tokens.sparkSession.sparkContext.broadcast(contexts), np.uint64(64 - max(1, (total // MERGED).bit_length()))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def reduce() -> None:
            code, up, token, n = (np.concatenate(c) for c in zip(*held, strict=True))
            first, n = tally(followed(code, token), n)
            held[:] = [(code[first], up[first], token[first], n)]

        def parts() -> pd.DataFrame:
            reduce()
            part = (followed(held[0][0], held[0][2]) >> bits).astype(np.int64)
            at, first = np.unique(part, return_index=True)
            cuts = [[x.tobytes() for x in np.split(c, first[1:])] for c in held[0]]
            held.clear()
            return pd.DataFrame({"part": at, **dict(zip(("code", "up", "token", "n"), cuts, strict=True))})

        for frame in slices(frames, "ids", SCORE_CHARS):
            *_, (_, code, up, token) = shared.value.steps(*shared.value.hashed(frame))
            ok = token != 0
            if ok.any():
                held.append((code[ok], up[ok], token[ok], np.ones(ok.sum(), np.int64)))
                size += len(held[-1][0])
            if size > STEPS:
                reduce()
                size = len(held[0][0])
                if size > STEPS // 2:
                    yield parts()
                    size = 0
        if held:
            yield parts()

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        code, up, token = (joined(frame[c], np.uint64)[0] for c in ("code", "up", "token"))
        key, first, where = np.unique(followed(code, token), return_index=True, return_inverse=True)
        n = np.bincount(where, weights=joined(frame["n"], np.int64)[0]).astype(np.int64)
        ok = n >= few
        first = first[ok]
        above = followed(up[first], token[first])
        return pd.DataFrame({"code": code[first].view(np.int64), "token": token[first].view(np.int64), "n": n[ok], "key": key[ok].view(np.int64), "above": above.view(np.int64)})

    found = tokens.filter("not held_out").select("ids", "more").mapInPandas(run, "part bigint, code binary, up binary, token binary, n binary")
    return found.groupBy("part").applyInPandas(merged, "code bigint, token bigint, n bigint, key bigint, above bigint")


def longer(counted: DataFrame, least: int) -> DataFrame:
    """code, t: the contexts, each with its next word, that were seen `least` times."""
    end = int(hashes([END]).view(np.int64)[0])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            code, token = _unsigned(frame, "code", "token")
            yield pd.DataFrame({"code": ((code + token) * _CHAIN).view(np.int64), "t": frame["n"]})

    return counted.filter((F.col("n") >= least) & (F.col("token") != end)).select("code", "token", "n").mapInPandas(run, "code bigint, t bigint")


def context_terms(tokens: DataFrame, contexts: Contexts, roots: DataFrame, total: int, types: int) -> DataFrame | None:
    """key, n, x: what a context (key: its code), or a token that it tells apart, adds to log10; fills in the filters of contexts.

    tokens: ids, more and held_out; see Words. roots: key, n of every token of training that was seen LEAST_COUNT times.
    """
    terms, least, few = None, LEAST_COUNT, CUT
    above = roots.select("key", "n", ((F.col("n") + 1) / (total + types + 1)).alias("p"))

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"code": (_unsigned(frame, "key")[0] * _CHAIN).view(np.int64), "t": frame["n"]})

    due = written(roots.select("key", "n").mapInPandas(first, "code bigint, t bigint"))
    while not due.isEmpty():
        contexts.levels.append(Filter(due))
        counted = written(followers(tokens, contexts, few, total))
        inner = contexts.levels.pop()
        upper = above.select(F.col("key").alias("above"), F.col("p").alias("up_p"))
        told = written(counted.join(upper, "above").join(due, "code").drop("above"), drop=[counted, due])  # drops contexts that a filter passed wrongly
        n, t, up = F.col("n"), F.col("t"), F.col("up_p")
        sizes = told.groupBy("code").agg(F.sum("n").alias("kept"), F.count("*").alias("kinds"))
        pool, size = F.col("pool"), t + F.col("kinds")
        others = F.when(n > few, n - 1).otherwise(0)
        states = told.join(sizes, "code").withColumn("pool", t - F.col("kept") + F.col("kinds"))
        states = states.groupBy("code", "t", "pool", "kinds", "kept").agg(F.sum(n * F.log((others + pool * up) / up)).alias("g"))
        rest = t - F.col("kept")
        gain = F.col("g") + F.when(rest > 0, rest * F.log(pool - 1)).otherwise(0.0) - t * F.log(size - 1)
        mean = LEAST_MEAN if contexts.levels else 0.0
        states = written(states.select("code", "pool", "kinds", "t", ((gain >= LEAST_GAIN) & (gain >= mean * t)).alias("tells")))
        telling = states.filter("tells")
        back = F.log10(pool / size)
        p = F.when(F.col("tells"), (n + pool * up) / size).otherwise(up)
        x = F.when(F.col("tells"), F.log10(p) - F.log10(up) - back)
        if contexts.levels:
            if telling.isEmpty():
                break
            contexts.levels.append(Filter(telling))
        else:
            contexts.levels.append(inner)
        above = written(told.join((telling if len(contexts.levels) > 1 else states).drop("t"), "code").select("key", "n", p.alias("p"), x.alias("x")))
        own = above.select("key", "n", "x").filter("x is not null").unionByName(telling.select(F.col("code").alias("key"), t.alias("n"), back.alias("x")))
        terms = own if terms is None else terms.unionByName(own)
        due = written(longer(told, least), drop=[told])
    if terms is not None:
        contexts.pairs = Filter(terms, "key", PAIR_BITS, 2)
    return terms


class Words:
    """The hot words, whose numbers are their places (the end is 0), their counts, and a filter of the words seen LEAST_COUNT times."""

    def __init__(self, hot: list[bytes], counts: np.ndarray, tokens: int, types: int, common: Filter):
        self.hot, self.common, self.numbers = hot, common, None
        self.base, self.known, self.frequent = np.log10((counts + 1) / (tokens + types + 1)), counts > 0, counts >= LEAST_COUNT

    def frame(self, frame: pd.DataFrame) -> pd.DataFrame:
        """For each text its tokens, the known and their score without contexts, those of words that are not hot aside (tail); ids, more: see Contexts.hashed()."""
        if self.numbers is None:
            self.numbers = defaultdict(None, {w: i for i, w in enumerate(self.hot)})
            self.numbers.default_factory = self.numbers.__len__
        ids, size, hot = [], [], len(self.hot)
        for text in frame["text"]:
            before = len(ids)
            ids.extend(map(self.numbers.__getitem__, words_of(text)))
            ids.append(0)
            size.append(len(ids) - before)
        words = list(islice(reversed(self.numbers), len(self.numbers) - hot))[::-1]
        for _ in words:
            self.numbers.popitem()
        code = hashes(words)
        frequent = np.append(self.frequent, self.common.has(code))
        base, known = np.append(self.base, np.zeros(len(words))), np.append(self.known, np.zeros(len(words), bool))
        ids, ends = np.array(ids, np.int32), np.cumsum(size)
        starts = ends - size
        kept = np.where(frequent[ids], ids, -1).astype(np.int32)
        tails, more = [], []
        for a, b, rare in zip(starts.tolist(), ends.tolist(), np.logical_or.reduceat(ids >= hot, starts).tolist(), strict=True):
            if not rare:
                tails.append([])
                more.append(b"")
                continue
            own, count = np.unique(ids[a:b][ids[a:b] >= hot], return_counts=True)
            tails.append([{"w": words[w - hot], "n": c} for w, c in zip(own.tolist(), count.tolist(), strict=True)])
            own = own[frequent[own]]
            more.append(code[own - hot].tobytes())
            at = kept[a:b]
            cold = at >= hot
            at[cold] = hot + np.searchsorted(own, at[cold])
        return pd.DataFrame(
            {
                "doc_id": frame["doc_id"].astype("Int64").to_numpy(dtype=object), "held_out": frame["held_out"].to_numpy(), "n_tokens": size,
                "n_known": np.add.reduceat(known[ids].astype(np.int64), starts), "base_score": np.add.reduceat(base[ids], starts),
                "tail": tails, "ids": [kept[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], "more": more,
            }
        )


class Scorer:
    """What each task needs for the contexts: their filters and the hot terms."""

    def __init__(self, contexts: Contexts, keys: np.ndarray, terms: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.terms, self.contexts = keys[order], terms[order], contexts

    def frame(self, frame: pd.DataFrame) -> pd.DataFrame:
        """row, key, x: for each text the sum x of the hot terms of its contexts (with a key of its own), and the keys of those that are joined (x null)."""
        seq, size = self.contexts.hashed(frame)
        row, added = frame["row"].to_numpy(), np.zeros(len(size))
        rows, keys = [], []
        for text, code, _, token in self.contexts.steps(seq, size):
            for key in (code, followed(code, token)):
                there = self.contexts.pairs.has(key)  # first, as most pairs of words have no term
                key, own = key[there].view(np.int64), text[there]
                place = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
                hit = self.keys[place] == key if len(self.keys) else np.zeros(len(key), bool)
                added += np.bincount(own[hit], weights=self.terms[place[hit]], minlength=len(size))
                rows.append(row[own[~hit]])
                keys.append(key[~hit])
        own = mixed(row.view(np.uint64)).view(np.int64)  # spread like other keys, so that none is met by many rows
        return pd.DataFrame({"row": np.concatenate([row, *rows]), "key": np.concatenate([own, *keys]), "x": np.append(added, np.full(sum(map(len, keys)), np.nan))})


def token_roots(vocabulary: DataFrame, ends: int) -> DataFrame:
    """key, n: the hash of every token of training that was seen LEAST_COUNT times, and its count."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"key": hashes([bytes(w) for w in frame["w"]]).view(np.int64), "n": frame["n"]})

    found = vocabulary.filter(F.col("n") >= LEAST_COUNT).mapInPandas(run, "key bigint, n bigint")
    end = vocabulary.sparkSession.createDataFrame([(int(hashes([END]).view(np.int64)[0]), ends)], found.schema)
    return written(found.unionByName(end.filter(F.col("n") >= LEAST_COUNT)))


def hot_words(vocabulary: DataFrame, most: int) -> DataFrame:
    """The words whose count is above a bound, `most` at most."""
    level = F.floor(F.log2("n") * 8).cast("int")
    levels = sorted(((r.level, r.c) for r in vocabulary.groupBy(level.alias("level")).agg(F.count("*").alias("c")).collect()), reverse=True)
    total, least = 0, None
    for found, c in levels:
        total += c
        if total > most:
            break
        least = found
    return vocabulary.filter(F.lit(False) if least is None else level >= least)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per document."""
    with shuffles_go(docs.sparkSession):
        given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(doc_hash(F.col(id_col), 7) == 2, F.lit(False)).alias("held_out"))
        train = given.filter(~F.col("held_out"))
        vocabulary = written(word_counts(train))
        sums = vocabulary.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
        ends = train.count()
        total, types = (sums.n or 0) + ends, sums.v + (ends > 0)
        # as Arrow, which holds 8 bytes a number on the driver and no object for each row
        hot = hot_words(vocabulary.filter(F.octet_length("w") <= HOT_BYTES), HOT).toArrow().sort_by([("n", "descending"), ("w", "ascending")])
        names, counts = [END, *hot["w"].to_pylist()], np.append(float(ends), hot["n"].to_numpy())
        roots = token_roots(vocabulary, ends)
        words = docs.sparkSession.sparkContext.broadcast(Words(names, counts, total, types, Filter(roots, "key")))

        def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in slices(frames, chars=SCORE_CHARS):
                yield words.value.frame(frame)

        schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, tail array<struct<w:binary,n:bigint>>, ids binary, more binary"
        tokens = written(given.mapInPandas(split, schema).withColumn("row", F.monotonically_increasing_id()), codec="zstd")
        contexts = Contexts(hashes(names))
        terms = context_terms(tokens, contexts, roots, total, types)
        if terms is None:
            terms = docs.sparkSession.createDataFrame([], "key bigint, n bigint, x double")
        top = hot_words(terms, TERMS * HOT).select("key", "x").toArrow()
        scorer = docs.sparkSession.sparkContext.broadcast(Scorer(contexts, top["key"].to_numpy(), top["x"].to_numpy()))

        def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in slices(frames, "ids", SCORE_CHARS):
                yield scorer.value.frame(frame)

        told = None
        cold = terms.select("key", F.col("x").alias("term"))
        for k in range(ROUNDS):
            looked = tokens.filter(F.col("row") % ROUNDS == k).select("row", "ids", "more").mapInPandas(score, "row bigint, key bigint, x double")
            x = F.when(F.col("x").isNull() | F.isnan("x"), F.coalesce("term", F.lit(0.0))).otherwise(F.col("x"))
            share = written(looked.join(cold, "key", "left").groupBy("row").agg(F.sum(x).alias("told")))
            told = share if told is None else told.unionByName(share)
        tail = tokens.select("row", F.explode("tail").alias("x")).select("row", "x.w", F.col("x.n").alias("k"))
        c = F.coalesce(F.col("n"), F.lit(0))
        rare = tail.join(vocabulary, "w", "left").groupBy("row")
        rare = written(rare.agg(F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("more_known"), F.sum(F.col("k") * F.log10((c + 1) / F.lit(float(total + types + 1)))).alias("more_base")))
    base = F.col("base_score") + F.coalesce("more_base", F.lit(0.0))
    return tokens.drop("tail", "ids", "more").join(told, "row").join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("told")).alias("score"),
    )

"""Secret scan: three fixed patterns, and character Markov models over all other long tokens; DataFrame functions only.

Two first-order models of characters are trained on labelled samples of bounded size: secrets are what the fixed patterns find
in the sampled documents, and random strings in the usual alphabets; ordinary are compound names, and the sampled documents'
words without a digit. A token of the text outside those spans is a secret if its log-likelihood ratio, in all and by character,
is high.

Spans are (kind, start, end) in code points, end exclusive. Null and empty texts have none. Repeated rows are scanned alike.
Characters U+0001 and U+0003 of a text are read as U+0002, which no pattern matches either.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, written

#: The patterns of the base kinds, each as (what precedes, what counts), with the least length of the latter.
ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 12)
ACCESS = (r"()(AKIA[A-Z0-9]+)", 18)
HEX = (r"()([0-9a-f]{16,})", 16)
#: Tokens that the models judge: runs of these characters, from 16 on; a shorter one says too little either way.
TOKEN = (r"()([A-Za-z0-9+/_=-]{16,})", 16)
KINDS = ("assign", "access", "hex", "markov")

#: Random strings of each family, and documents whose secrets and words serve for training.
RANDOM, DOCUMENTS = 2000, 1000
#: Of a secret: the least log-likelihood ratio in nats, in all and by character.
LEAST_TOTAL, LEAST_MEAN = 10.0, 0.45
SMOOTHING = 0.5

#: Parts from which ordinary identifiers are put together, each with each.
PARTS = "get set user name file path http server request response config index count total value parse build create update delete list item node table column data message error handler service client".split()

_LOW, _HIGH = 43, 122  # '+' to 'z'
_SIDE = _HIGH - _LOW + 1
_BLOCK = 64


def prefix_sums(lens: Column) -> Column:
    """The sum of all entries before each: blocks keep the work near n * _BLOCK."""
    add = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    blocks = F.sequence(F.lit(0), F.floor((F.size(lens) - 1) / _BLOCK).cast("int"))

    def inside(b: Column, base: Column) -> Column:
        own = F.sequence(F.lit(0), F.least(F.lit(_BLOCK), F.size(lens) - b * _BLOCK) - 1)
        return F.transform(own, lambda i: base + add(F.slice(lens, b * _BLOCK + 1, i)))

    return let(
        F.transform(blocks, lambda b: add(F.slice(lens, b * _BLOCK + 1, F.lit(_BLOCK)))),
        lambda sums: F.flatten(F.transform(blocks, lambda b: let(add(F.slice(sums, F.lit(1), b)), lambda base: inside(b, base)))),
    )


def marked(text: Column, pattern: str) -> Column:
    """The text split at its matches: odd pieces are matches, with U+0003 before what counts."""
    return F.split(F.regexp_replace(text, pattern, "\x01$1\x03$2\x01"), "\x01")


def without(pieces: Column, text: Column, least: int) -> Column:
    """The text of marked pieces with U+0002 for each character of the matches whose counted part is long enough."""
    blank = lambda p, i: F.when((F.pmod(i, F.lit(2)) == 1) & (F.length(F.substring_index(p, "\x03", -1)) >= least), F.repeat(F.lit("\x02"), F.length(p) - 1)).otherwise(F.translate(p, "\x03", ""))
    return F.when(F.size(pieces) > 1, F.array_join(F.transform(pieces, blank), "")).otherwise(text)


def blanked(text: Column, pattern: str, least: int) -> Column:
    """The text without the matches of a pattern."""
    return let(text, lambda t: let(marked(t, pattern), lambda own: without(own, t, least)))


def spans(pieces: Column, kind: int, least: int) -> Column:
    """array<struct<start, kind, end, token>> of the matches whose counted part is long enough."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int,token:string>>")

    def found(pieces: Column, lens: Column, starts: Column) -> Column:
        match = lambda i: F.struct(
            F.get(starts, i).alias("start"), F.lit(kind).alias("kind"), (F.get(starts, i) + F.get(lens, i)).alias("end"), F.substring_index(F.get(pieces, i), "\x03", -1).alias("token")
        )
        return F.filter(F.transform(F.sequence(F.lit(1), F.size(pieces) - 1, F.lit(2)), match), lambda s: F.length(s["token"]) >= least)

    of = lambda own: let(F.transform(own, lambda p, i: F.length(p) - F.pmod(i, F.lit(2))), lambda lens: let(prefix_sums(lens), lambda starts: found(own, lens, starts)))
    return F.when(F.size(pieces) > 1, let(pieces, of)).otherwise(none)


def random_strings(spark: SparkSession) -> DataFrame:
    """Labelled sample: strings of random bytes in the usual alphabets."""
    digest = F.sha2(F.concat(F.lit("random "), F.col("id").cast("string")), 256)
    base64 = F.base64(F.unhex(digest))
    plain = F.regexp_replace(base64, "[^A-Za-z0-9]", "")
    return spark.range(RANDOM).select(F.explode(F.array(digest, base64, plain, F.upper(plain))).alias("token"))


def compound_names(spark: SparkSession) -> DataFrame:
    """Labelled sample: ordinary identifiers, put together from PARTS in the usual styles."""
    parts = spark.range(len(PARTS)).select(F.explode(F.array(*map(F.lit, PARTS))).alias("b"), F.get(F.array(*map(F.lit, PARTS)), F.col("id").cast("int")).alias("a"))
    return parts.select(F.explode(F.array(F.concat("a", F.initcap("b")), F.concat_ws("_", "a", "b"), F.concat_ws("-", "a", "b"), F.concat_ws("/", "a", "b"), F.upper(F.concat_ws("_", "a", "b")))).alias("token"))


def sampled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """t: one text of each of DOCUMENTS documents."""
    chosen = docs.select(F.col(id_col).alias("i")).filter("i is not null").orderBy(F.xxhash64("i"), "i").limit(DOCUMENTS).distinct()
    own = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "i", "left_semi")
    return written(own.groupBy("i").agg(F.min("t").alias("t")).select("t"))


def found_secrets(texts: DataFrame) -> DataFrame:
    """Labelled sample: what the fixed patterns find in texts (t)."""
    long = lambda p, least: F.filter(F.regexp_extract_all("t", F.lit(p), F.lit(2)), lambda x: F.length(x) >= least)
    each = [long(*kind) for kind in (ASSIGN, ACCESS, HEX)]
    return texts.select(F.explode(F.flatten(F.array(*each))).alias("token"))


def ordinary_words(texts: DataFrame) -> DataFrame:
    """Labelled sample: the letter-only words of texts (t)."""
    return texts.select(F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{4,40}(?![A-Za-z0-9+/_=-])"), F.lit(0)))).alias("token"))


def transitions(tokens: DataFrame) -> DataFrame:
    """(a, b, n): how often code b follows code a."""
    chars = F.split(F.regexp_replace("token", r"[^+-9=A-Z_a-z]", ""), "")
    codes = F.transform(F.filter(chars, lambda c: c != ""), lambda c: F.ascii(c) - _LOW)
    pairs = tokens.select(codes.alias("c")).filter(F.size("c") > 1).select(F.explode(F.zip_with(F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p"))
    return pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def ratios(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """ln P_random(b|a) / P_ordinary(b|a) by a * _SIDE + b; of fixed size."""
    spark, texts, out = docs.sparkSession, sampled(docs, id_col, text_col), []
    for tokens in (random_strings(spark).unionAll(found_secrets(texts)), compound_names(spark).unionAll(ordinary_words(texts))):
        n = {(r.a, r.b): r.n for r in transitions(tokens).collect()}
        total = [SMOOTHING * _SIDE] * _SIDE
        for (a, _), c in n.items():
            total[a] += c
        out.append([math.log((n.get((a, b), 0) + SMOOTHING) / total[a]) for a in range(_SIDE) for b in range(_SIDE)])
    return [round(r - o, 4) for r, o in zip(*out, strict=True)]


def ratio_of(token: Column, table: Column) -> Column:
    """The log-likelihood ratio of a token."""
    codes = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.ascii(c) - _LOW)
    steps = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: F.get(table, a * _SIDE + b))
    return F.aggregate(steps, F.lit(0.0), lambda x, y: x + y)


def joined(found: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov: one row per document. No shuffle but for training."""
    table = F.split(F.lit(",".join(map(str, ratios(docs, id_col, text_col)))), ",").cast("array<double>")  # folded to a constant
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), "\x01\x03", "\x02\x02")
    cut = docs.select(F.col(id_col).alias("doc_id"), text.alias("t")).select("doc_id", "t", *[marked(F.col("t"), p).alias(f"p{k}") for k, (p, _) in enumerate((ASSIGN, ACCESS, HEX))])
    rest = without(F.col("p0"), F.col("t"), ASSIGN[1])
    for found in (ACCESS, HEX):
        rest = blanked(rest, *found)
    cut = cut.select("doc_id", "p0", "p1", "p2", marked(rest, TOKEN[0]).alias("p3"))
    found = cut.select("doc_id", *[spans(F.col(f"p{k}"), k, least).alias(f"s{k}") for k, (_, least) in enumerate((ASSIGN, ACCESS, HEX, TOKEN))])
    random = lambda s: (ratio_of(s["token"], table) >= LEAST_TOTAL) & (ratio_of(s["token"], table) >= LEAST_MEAN * (F.length(s["token"]) - 1))
    base = F.array_sort(F.concat("s0", "s1", "s2"))
    found = found.withColumn("s3", F.filter("s3", random))
    return found.select(
        "doc_id",
        *[F.size(f"s{k}").cast("long").alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("s0", "s1", "s2", "s3"))).alias("spans"),
        F.size("s3").cast("long").alias("n_markov"),
    )

"""URL filter by a cascade of Bloom filters, with DataFrame functions only.

Level 0 encodes the listed keys; level 1 those of all other keys of the corpus that level 0 lets through; level 2 the listed
keys that level 1 lets through; and so on, until no key of the complete universe is left. A key's first level that lacks it
decides: listed after an odd number of hits. Membership is exact for the universe and needs no join with the list.

A level is an array of 64-bit words made by bit_or and given to the probing expression as a scalar subquery. Filters above
MAX_BITS are cut into shards by a hash of the key, and the urls are judged shard by shard.

A null url, or one without '://', has empty host and path, and the key ''. Repeated rows are judged alike; null keys in the
list are ignored; an empty list blocks nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: The rules as (host, path, verdict).
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
HASHES = 6
BITS_PER_KEY = 9
#: Bits of one shard's filters at most, in all: the words are sent to every task.
MAX_BITS = 1 << 27
#: Files of a shard's keys.
PARTS = 16
#: Words that one row holds while a level is put together.
BLOCK = 1024

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(RULES, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def places(key: Column, level: int, bits: int) -> list[Column]:
    """The bits of a key at a level."""
    one, two = F.pmod(F.xxhash64(F.lit(2 * level), key), F.lit(bits)), F.pmod(F.xxhash64(F.lit(2 * level + 1), key), F.lit(bits))
    return [F.pmod(one + two * i, F.lit(bits)) for i in range(HASHES)]


def build_level(keys: DataFrame, level: int, count: int) -> tuple[DataFrame, int]:
    """One row with the words of the filter over keys.key, and the number of bits."""
    words = max(1, math.ceil(count * BITS_PER_KEY / 64))
    bit = F.explode(F.array(*places(F.col("key"), level, words * 64))).alias("b")
    given = keys.select(bit).select((F.col("b") / 64).cast("long").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("b", F.lit(64)).cast("int")).alias("v"))
    zeros = keys.sparkSession.range(words).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("v"))
    dense = given.unionAll(zeros).groupBy("w").agg(F.bit_or("v").alias("v"))
    blocks = dense.groupBy(F.floor(F.col("w") / BLOCK).alias("n")).agg(F.array_sort(F.collect_list(F.struct("w", "v"))).alias("b"))
    row = blocks.agg(F.array_sort(F.collect_list(F.struct("n", "b"))).alias("all"))
    return row.select(F.flatten(F.transform("all", lambda x: F.transform(x["b"], lambda y: y["v"]))).alias("words")), words * 64


def hit(words: Column, key: Column, level: int, bits: int) -> Column:
    """Whether a level's filter holds the key."""
    out = F.lit(True)
    for b in places(key, level, bits):
        out = out & (F.call_function("shiftright", F.get(words, (b / 64).cast("int")), F.pmod(b, F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("long")) != 0)
    return out


def perhaps(key: Column, keys: DataFrame) -> Column:
    """Whether a key may be among keys.key, told by a filter of bounded size: it spares shuffles, the join after it decides."""
    words, bits = build_level(keys, 0, min(keys.count(), MAX_BITS // BITS_PER_KEY))
    return hit(written(words).scalar(), key, 0, bits)


Level = tuple[DataFrame, int]


def member(levels: list[Level], key: Column) -> Column:
    """Whether a key of the universe is listed."""
    out = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        words, bits = levels[i]
        out = F.when(hit(words.scalar(), key, i, bits), out).otherwise(F.lit(i % 2 == 1))
    return out


def build(universe: DataFrame) -> list[Level]:
    """The levels over (key, listed): all distinct keys and whether each is listed."""
    levels: list[Level] = []
    n = {r.listed: r["count"] for r in universe.groupBy("listed").count().collect()}
    due, other, count = True, universe, n.get(True, 0)
    while count:
        row, bits = build_level(other.filter(F.col("listed") == due), len(levels), count)
        levels.append((written(row), bits))
        # of the other kind, those that this level lets through; of the same kind all go on
        last = hit(levels[-1][0].scalar(), F.col("key"), len(levels) - 1, bits)
        other = other.filter((F.col("listed") == due) | last)
        due = not due
        count = other.filter(F.col("listed") == due).count()
    return levels


def cascade_filter(urls: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", key_col: str = "key") -> DataFrame:
    """id, host, path, rule, verdict: one row per url. listed: keys (host and path) to block where no rule fits."""
    host, path = host_and_path(F.col(url_col))
    parsed = urls.select(F.col(id_col), host.alias("host"), path.alias("path")).withColumn("key", F.concat("host", "path"))
    keys = parsed.select("key", F.lit(False).alias("listed")).unionAll(listed.select(F.col(key_col).alias("key"), F.lit(True).alias("listed")).filter("key is not null"))
    universe = written(keys.groupBy("key").agg(F.max("listed").alias("listed")))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    shards = max(1, math.ceil(universe.count() * BITS_PER_KEY * 1.1 / MAX_BITS))
    if shards > 1:  # parted once, so that each shard's keys and urls are read once
        shard = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard")
        part = lambda df: written(df.select("*", shard).repartition("shard", F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(PARTS))), by=["shard"])
        universe, parsed = part(universe), part(parsed)
    out = None
    for s in range(shards):
        of = lambda df: df if shards == 1 else df.filter(F.col("shard") == s)  # noqa: B023, E731
        levels = build(of(universe))
        blocked = F.when(member(levels, F.col("key")), "block").otherwise("allow")
        own = of(parsed).select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, blocked).alias("verdict"))
        out = own if out is None else out.unionAll(own)
    return out


def tracked_keys(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Keys of urls that carry a campaign tag somewhere in the corpus: the list that the registered query blocks."""
    host, path = host_and_path(F.col(url_col))
    return urls.filter(F.col(url_col).contains("utm_source=")).select(F.concat(host, path).alias("key"))


def _sql() -> str:
    case = lambda what: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p) if what == 'rule' else v}'" for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
    return f"""
WITH rest AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substring(url, CAST(strpos(url, '://') + 3 AS BIGINT)) ELSE '' END AS r FROM pages),
parsed AS (SELECT page_id, url, translate(regexp_extract(r, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
listed AS (SELECT DISTINCT concat(host, path) AS k FROM parsed WHERE contains(url, 'utm_source='))
SELECT page_id, host, path, {case("rule")} END AS rule,
{case("verdict")} WHEN concat(host, path) IN (SELECT k FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM parsed"""


SQL = _sql()

"""Catalogue operators: missing values, filters, latest records, upserts and other rewrites, as functions over DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_missing(c: Column, wide: bool = False) -> Column:
    """Null, blank or 'Unknown'; wide: also n/a and na, in any case."""
    text = F.trim(c)
    return c.isNull() | (F.lower(text).isin("", "unknown", "n/a", "na") if wide else (text == "") | (text == "Unknown"))


def no_authors(c: Column) -> Column:
    return c.isNull() | (F.size(c) == 0)


def incomplete() -> Column:
    """A record that lacks title, authors, publisher or date."""
    return is_missing(F.col("title")) | no_authors(F.col("authors")) | is_missing(F.col("publisher")) | is_missing(F.col("published_date"))


def catalog_filter(books: DataFrame, title: str | None = None, author: str | None = None, publisher: str | None = None, year: str | None = None, only_isbn: bool = False, only_incomplete: bool = False, limit: int = 100, offset: int = 0) -> DataFrame:
    """All given conditions at once, newest first; a page of them."""
    out = books
    for column, part in ((F.col("title"), title), (F.array_join("authors", ", "), author), (F.col("publisher"), publisher), (F.col("published_date"), year)):
        if part:
            out = out.filter(column.ilike(f"%{part}%"))
    if only_isbn:
        out = out.filter(~is_missing(F.col("isbn_13")) | ~is_missing(F.col("isbn_10")))
    if only_incomplete:
        out = out.filter(incomplete())
    return out.orderBy(F.desc("ts"), F.desc("id")).offset(offset).limit(limit)


def omnibox(books: DataFrame, q: str | None, limit: int = 100) -> DataFrame:
    """Rows with q in title, authors or an ISBN, by confidence."""
    if q:
        like = lambda c: F.coalesce(c.ilike(f"%{q}%"), F.lit(False))
        books = books.filter(like(F.col("title")) | like(F.array_join("authors", ", ")) | like(F.col("isbn_13")) | like(F.col("isbn_10")))
    return books.orderBy(F.desc("confidence"), "id").limit(limit)


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order: one window, one shuffle on the keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace those of equal keys."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return latest(both, keys, [F.desc("__new")]).drop("__new")


def replace_keys(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All new rows, and the old ones whose keys no new row has."""
    return new.unionByName(old.join(new.select(*keys).distinct(), list(keys), "left_anti"))


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows, and new ones of new keys."""
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti"))


def improve_only(old: DataFrame, new: DataFrame, key: str, score: str, least: float = 1e-6) -> DataFrame:
    """The new row where its score is above the old one's by more than `least`; else the old one."""
    n = new.select(F.col(key).alias("__k"), F.struct(*[c for c in new.columns if c != key]).alias("__n"))
    joined = old.join(n, F.col(key) == F.col("__k"), "left")
    better = F.col("__n").isNotNull() & (F.col(f"__n.{score}") > F.coalesce(score, F.lit(-1.0)) + least)
    return joined.select(key, *[F.when(better, F.col(f"__n.{c}")).otherwise(F.col(c)).alias(c) for c in old.columns if c != key], better.alias("updated"))


def keep_existing(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """New rows, with what they lack in `columns` taken from the old."""
    o = old.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__o_{c}") for c in columns])
    joined = new.join(o, F.col(key) == F.col("__k"), "left")
    return joined.select(*[F.coalesce(c, f"__o_{c}").alias(c) if c in columns else F.col(c) for c in new.columns])


def ttl(rows: DataFrame, stamp: str, as_of: int, days: int) -> DataFrame:
    """Rows not older than so many days."""
    return rows.filter(F.col(stamp) >= as_of - days * 86400)


def evict(entries: DataFrame, size: str, last_access: str, key: str, target: int) -> DataFrame:
    """Which entries an LRU cache of `target` bytes keeps, most recent first; entries of one second in the order of a hash of their key.

    The running size is put together from what came later: days, hours of the day, seconds of the hour, 1,024 ranges of the hash within the
    second, and the entries of a range. Each level is a sum of the one below, so however many entries a day or a second has, no task orders them all."""
    spread = F.xxhash64(key)
    at = F.col(last_access)
    rows = entries.withColumns({"__h": spread, "__part": F.shiftright(spread, 54).cast("int"), "__second": at, "__hour": F.floor(at / 3600), "__day": F.floor(at / 86400)})
    names = ["__day", "__hour", "__second", "__part"]
    out, sums = rows, rows.groupBy(*names).agg(F.sum(size).alias("__sum"))
    for n in range(len(names), 0, -1):
        # what comes later within the same group of the level above
        w = Window.partitionBy(*names[: n - 1]).orderBy(F.col(names[n - 1]).asc() if names[n - 1] == "__part" else F.desc(names[n - 1]))
        later = sums.select(*names[:n], F.coalesce(F.sum("__sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"__later{n}"))
        out = out.join(later, names[:n])
        sums = sums.groupBy(*names[: n - 1]).agg(F.sum("__sum").alias("__sum"))
    within = Window.partitionBy(*names).orderBy("__h", key)
    running = F.sum(size).over(within) + sum((F.col(f"__later{n}") for n in range(1, len(names) + 1)), F.lit(0))
    out = out.withColumn("running", running).withColumn("kept", F.col("running") <= target)
    return out.select(*entries.columns, "running", "kept")

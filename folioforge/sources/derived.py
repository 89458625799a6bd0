"""The catalogue views, derived by arithmetic from the given tables, and the same rules as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import isbn

#: Raw spellings of publishers in the derived catalogue.
RAW_PUBLISHERS = ("MANNING", "O'REILLY", "PACKT PUBLISHING", "oreilly media", "Casa do Codigo", "NOVATEC EDITORA")
SOURCES = ("openlibrary", "google_books", "loc", "crossref", "isbnlib", "internet_archive", "worldcat", "mercado_editorial")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per part, with gaps, wrong check digits and scanning errors at fixed places."""
    part = read(spark, sf_dir, "part")
    shipped = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    authors = shipped.join(supplier, shipped["l_suppkey"] == supplier["s_suppkey"]).groupBy("l_partkey").agg(F.slice(F.array_sort(F.collect_set("s_name")), 1, 3).alias("names"))
    k = F.col("p_partkey")
    year = (1980 + (7 * k) % 46).cast("string")
    core = F.lpad(k.cast("string"), 9, "0")
    twelve = F.concat(F.lit("978"), core)
    digit = (isbn.check13(twelve).cast("int") + F.when(k % 7 == 0, 1).otherwise(0)) % 10
    isbn13 = F.col("isbn_13")  # a column of its own, so that what names it twice does not compute it twice
    date = F.when(k % 4 == 0, year).when(k % 4 == 1, F.concat(year, F.lit("-05"))).when(k % 4 == 2, F.concat(year, F.lit("-05-17"))).when(k % 8 == 3, "Unknown").otherwise("8400")
    rows = part.join(authors, part["p_partkey"] == authors["l_partkey"], "left").withColumn("isbn_13", F.concat(twelve, digit.cast("string")))
    return rows.select(
        k.alias("id"),
        F.when(k % 11 != 0, F.concat("p_name", F.lit(" "), F.lower("p_type"), F.lit(" volume "), (k % 50).cast("string"))).alias("title"),
        F.when(k % 17 == 0, F.array().cast("array<string>")).otherwise(F.coalesce("names", F.array().cast("array<string>"))).alias("authors"),
        F.when(k % 13 == 0, "Unknown").when(k % 7 == 0, _pick(RAW_PUBLISHERS, F.floor(k / 7) % len(RAW_PUBLISHERS))).otherwise(F.col("p_brand")).alias("publisher"),
        year.alias("year"),
        date.alias("published_date"),
        "isbn_13",
        F.when(k % 5 == 0, F.replace(isbn13, F.lit("0"), F.lit("O"))).otherwise(isbn13).alias("isbn_raw"),
        F.concat(core, isbn.check10(core)).alias("isbn_10"),
        ((k % 100) / 100.0).alias("confidence"),
        F.col("p_type").alias("source"),
        (1700000000 + 3600 * k).alias("ts"),
        _pick(("pdf", "epub", "mobi"), F.col("p_size") % 3).alias("ext"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file name for each book."""
    b = books(spark, sf_dir)
    name = F.concat(F.coalesce(F.get("authors", F.lit(0)), F.lit("Anonymous")), F.lit(" - "), F.coalesce("title", F.lit("untitled")), F.lit(" ("), "year", F.lit(")."), "ext")
    return b.withColumn("path", F.when(F.col("id") % 9 == 0, F.translate(name, " ", "_")).otherwise(name))


def source_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each catalogue answered for each book: one row per (book, source)."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("book"), (F.col("l_suppkey") % 8).cast("int").alias("source_no"), F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity").alias("o"))
    first = rows.groupBy("book", "source_no").agg(F.min("o").alias("o"))
    return first.select("book", "source_no", _pick(SOURCES, F.col("source_no")).alias("source"), (F.col("o.l_quantity") / 25).alias("elapsed"), (0.70 + 0.03 * F.col("source_no")).alias("confidence"))


def api_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.col("event_type").alias("api"), (F.col("event_type") != "error").alias("success"), F.col("value").alias("response_time"), F.col("ts").cast("timestamp").alias("ts"), "user_id")


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text queries: the words of each benchmark item."""
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.split("text", r"\s+"), " ").alias("q"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader might type to find each book: its identifier, people, a quoted title or loose words, from its own columns."""
    b = books(spark, sf_dir)
    t = F.coalesce("title", F.lit("no title"))
    person = lambda s: F.initcap(F.array_join(F.slice(F.split(s, " "), 1, 2), " "))
    k = F.col("id") % 4
    words = (
        F.when(k == 0, F.concat(F.lit("isbn "), "isbn_raw"))
        .when(k == 1, F.concat(F.lit("books by "), person(t), F.lit(" and by "), person(F.concat("source", F.lit(" Author")))))
        .when(k == 2, F.concat(F.lit('"'), t, F.lit('" '), "year"))
        .otherwise(F.concat(t, F.lit(" with js and ML db")))
    )
    return b.select("id", words.alias("q"))


def _sum(s: str, n: int, weight) -> str:
    return "(" + " + ".join(f"{weight(i)} * CAST(substr({s}, {i}, 1) AS INTEGER)" for i in range(1, n + 1)) + ")"


def check13_sql(s: str) -> str:
    return f"CAST((10 - {_sum(s, 12, lambda i: 1 if i % 2 else 3)} % 10) % 10 AS VARCHAR)"


def check10_sql(s: str) -> str:
    rest = f"((11 - {_sum(s, 9, lambda i: 11 - i)} % 11) % 11)"
    return f"CASE WHEN {rest} = 10 THEN 'X' ELSE CAST({rest} AS VARCHAR) END"


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


BOOKS = f"""
shipped AS (SELECT l_partkey, list_sort(list(DISTINCT s_name))[1:3] AS names FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_partkey),
core AS (SELECT *, p_partkey AS k, CAST(1980 + (7 * p_partkey) % 46 AS VARCHAR) AS y, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS c9, '978' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS c12 FROM part LEFT JOIN shipped ON p_partkey = l_partkey),
digits AS (SELECT *, c12 || CASE WHEN k % 7 = 0 THEN CAST((CAST({check13_sql("c12")} AS INTEGER) + 1) % 10 AS VARCHAR) ELSE {check13_sql("c12")} END AS i13 FROM core),
books AS (SELECT k AS id, CASE WHEN k % 11 <> 0 THEN p_name || ' ' || lower(p_type) || ' volume ' || CAST(k % 50 AS VARCHAR) END AS title,
  CASE WHEN k % 17 = 0 THEN CAST([] AS VARCHAR[]) ELSE coalesce(names, CAST([] AS VARCHAR[])) END AS authors,
  CASE WHEN k % 13 = 0 THEN 'Unknown' WHEN k % 7 = 0 THEN {_list(RAW_PUBLISHERS)}[CAST((k // 7) % {len(RAW_PUBLISHERS)} AS INTEGER) + 1] ELSE p_brand END AS publisher,
  y AS year, CASE WHEN k % 4 = 0 THEN y WHEN k % 4 = 1 THEN y || '-05' WHEN k % 4 = 2 THEN y || '-05-17' WHEN k % 8 = 3 THEN 'Unknown' ELSE '8400' END AS published_date,
  i13 AS isbn_13, CASE WHEN k % 5 = 0 THEN replace(i13, '0', 'O') ELSE i13 END AS isbn_raw, c9 || {check10_sql("c9")} AS isbn_10,
  (k % 100) / 100.0::DOUBLE AS confidence, p_type AS source, 1700000000 + 3600 * k AS ts, ['pdf', 'epub', 'mobi'][p_size % 3 + 1] AS ext FROM digits)"""

FILES = BOOKS + """,
named AS (SELECT *, coalesce(authors[1], 'Anonymous') || ' - ' || coalesce(title, 'untitled') || ' (' || year || ').' || ext AS n FROM books),
files AS (SELECT * EXCLUDE (n), CASE WHEN id % 9 = 0 THEN replace(n, ' ', '_') ELSE n END AS path FROM named)"""

SOURCE_RECORDS = f"""
answered AS (SELECT l_partkey AS book, CAST(l_suppkey % 8 AS INTEGER) AS source_no, l_quantity, row_number() OVER (PARTITION BY l_partkey, l_suppkey % 8 ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity) AS rn FROM lineitem),
source_records AS (SELECT book, source_no, {_list(SOURCES)}[source_no + 1] AS source, l_quantity / 25 AS elapsed, 0.70::DOUBLE + 0.03::DOUBLE * source_no AS confidence FROM answered WHERE rn = 1)"""


def _person(s: str) -> str:
    return f"array_to_string(list_transform(string_split({s}, ' ')[1:2], lambda w: upper(w[1]) || lower(w[2:])), ' ')"


ASKED = BOOKS + f""",
asked AS (SELECT id, CASE id % 4 WHEN 0 THEN 'isbn ' || isbn_raw WHEN 1 THEN 'books by ' || {_person("coalesce(title, 'no title')")} || ' and by ' || {_person("source || ' Author'")}
  WHEN 2 THEN '"' || coalesce(title, 'no title') || '" ' || year ELSE coalesce(title, 'no title') || ' with js and ML db' END AS q FROM books)"""

API_EVENTS = """
api_events AS (SELECT event_id, event_type AS api, event_type <> 'error' AS success, value AS response_time, ts, user_id FROM events)"""

SEARCH_QUERIES = r"""
search_queries AS (SELECT item_id, array_to_string(regexp_split_to_array(text, '\s+'), ' ') AS q FROM benchmark)"""


def over(*views: str) -> str:
    """The head of a DuckDB query over these views."""
    return "WITH " + ",".join(views) + "\n"

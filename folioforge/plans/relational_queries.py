"""Joins, orders and set operations of the inventory (2.8, 2.9) in forms of their own, and scores that other queries fold in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators.tables import written
from folioforge.sources import derived as D

from .registry import query
from .search_queries import _WR, _ranked, orchestrator
from .text_queries import _TOK

_W = D.over(D.BOOKS)
_WS = D.over(D.SOURCE_RECORDS)
_E = D.over(D.API_EVENTS)


@query(_W + "SELECT publisher, count(*) AS books, coalesce(any_value(m.name), publisher) AS house FROM books LEFT JOIN (VALUES " + ", ".join(f"('{r.replace(chr(39), chr(39) * 2)}', '{n.replace(chr(39), chr(39) * 2)}')" for r, n in T.PUBLISHERS) + ") AS m(raw, name) ON upper(trim(publisher)) = m.raw GROUP BY publisher")
def j2_map_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publishers looked up in the table of spellings, which is a fixed list: a broadcast left join, after the books are counted."""
    table = spark.createDataFrame(list(T.PUBLISHERS), "raw string, name string")
    counted = D.books(spark, sf_dir).groupBy("publisher").agg(F.count("*").alias("books"))
    found = counted.join(F.broadcast(table), F.upper(F.trim("publisher")) == F.col("raw"), "left")
    return found.select("publisher", "books", F.coalesce("name", "publisher").alias("house"))


@query(f"WITH s AS (SELECT DISTINCT unnest({_TOK.format('text')}) AS term FROM benchmark), t AS (SELECT doc_id, unnest({_TOK.format('text')}) AS term FROM documents) SELECT DISTINCT doc_id FROM t SEMI JOIN s USING (term)")
def j5_token_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a token of any query: distinct tokens on the one side, and a token of a document only once on the other."""
    tokens = lambda df, *key: df.select(*key, F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    wanted = tokens(D.read(spark, sf_dir, "benchmark")).distinct()
    return tokens(D.read(spark, sf_dir, "documents"), "doc_id").join(wanted, "term", "left_semi").select("doc_id").distinct()


@query(_E + "SELECT t.user_id, t.calls, coalesce(s.ok, 0) AS successes, round(100.0 * coalesce(s.ok, 0) / t.calls, 6)::DOUBLE AS rate FROM (SELECT user_id, count(*) AS calls FROM api_events GROUP BY user_id) t LEFT JOIN (SELECT user_id, count(*) AS ok FROM api_events WHERE success AND response_time < 50 GROUP BY user_id) s USING (user_id)")
def j7_success_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All calls of each user beside the fast and successful ones; users without any stay, at 0. Both sides are counted before they are joined."""
    e = D.api_events(spark, sf_dir)
    total = e.groupBy("user_id").agg(F.count("*").alias("calls"))
    good = e.filter("success and response_time < 50").groupBy("user_id").agg(F.count("*").alias("ok"))
    ok = F.coalesce("ok", F.lit(0))
    return total.join(good, "user_id", "left").select("user_id", "calls", ok.alias("successes"), F.round(100.0 * ok / F.col("calls"), 6).alias("rate"))


@query(_W + "SELECT id, title, confidence FROM books ORDER BY confidence DESC, id LIMIT 25 OFFSET 50")
def l2_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of 25, by confidence."""
    return D.books(spark, sf_dir).orderBy(F.desc("confidence"), "id").offset(50).limit(25).select("id", "title", "confidence")


@query(_WR + "SELECT algorithm, query, id, score FROM ranked")
def l5_ranker_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all rankers answered, one after another."""
    return _ranked(spark, sf_dir).select("algorithm", "query", "id", "score")


@query(_W + "SELECT x.source, y.source AS other, len(list_intersect(x.w, y.w)) AS shared, len(list_distinct(list_concat(x.w, y.w))) AS together FROM (SELECT source, list_distinct(flatten(list(string_split(lower(title), ' ')))) AS w FROM books WHERE title IS NOT NULL GROUP BY source) x JOIN (SELECT source, list_distinct(flatten(list(string_split(lower(title), ' ')))) AS w FROM books WHERE title IS NOT NULL GROUP BY source) y ON x.source < y.source")
def l8_token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the titles of two sources share, and all of both: counted by word and source, so that no source's words are one row."""
    words = written(D.books(spark, sf_dir).filter("title is not null").select("source", F.explode(F.split(F.lower("title"), " ")).alias("w")).distinct())
    size = words.groupBy("source").agg(F.count("*").alias("n"))
    pairs = size.crossJoin(size.withColumnsRenamed({"source": "other", "n": "m"})).filter("source < other")  # sources are a handful of kinds
    shared = words.join(words.withColumnRenamed("source", "other"), "w").filter("source < other").groupBy("source", "other").agg(F.count("*").alias("shared"))
    both = F.coalesce("shared", F.lit(0))
    return pairs.join(shared, ["source", "other"], "left").select("source", "other", both.alias("shared"), (F.col("n") + F.col("m") - both).alias("together"))


@query(_W + "SELECT publisher, source, n, round(n / total, 6)::DOUBLE AS share FROM (SELECT publisher, source, count(*) AS n, sum(count(*)) OVER (PARTITION BY publisher) AS total, row_number() OVER (PARTITION BY publisher ORDER BY count(*) DESC, source) AS rn FROM books GROUP BY publisher, source) WHERE rn = 1")
def a19_mode_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value that a field has most often in each group, the first of equal ones, and its share."""
    n = D.books(spark, sf_dir).groupBy("publisher", "source").agg(F.count("*").alias("n"))
    first = F.min(F.struct((-F.col("n")).alias("o"), "source")).alias("m")
    found = n.groupBy("publisher").agg(first, F.sum("n").alias("total"))
    return found.select("publisher", F.col("m.source").alias("source"), (-F.col("m.o")).alias("n"), F.round(-F.col("m.o") / F.col("total"), 6).alias("share"))


@query(f"WITH t AS (SELECT doc_id, unnest({_TOK.format('text')}) AS term FROM documents), s AS (SELECT term, count(*) AS postings, count(DISTINCT doc_id) AS docs FROM t GROUP BY term) SELECT term, docs, postings, round(docs / (SELECT count(*) FROM documents), 6)::DOUBLE AS share FROM s WHERE docs >= 0.1 * (SELECT count(*) FROM documents)")
def a25_hot_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms that a tenth of all documents hold, with their postings: counted in each document first."""
    docs = D.read(spark, sf_dir, "documents")
    per = docs.select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    total = docs.agg(F.count("*").alias("total"))
    found = per.groupBy("term").agg(F.count("*").alias("docs"), F.sum("n").alias("postings")).crossJoin(F.broadcast(total))  # one row
    return found.filter(F.col("docs") >= 0.1 * F.col("total")).select("term", "docs", "postings", F.round(F.col("docs") / F.col("total"), 6).alias("share"))


_VALID = f"(length(isbn_raw) = 13 AND regexp_full_match(isbn_raw, '978[0-9]{{10}}') AND {D.check13_sql('isbn_raw')} = isbn_raw[13:13])"


@query(_W + f"SELECT id, array_to_string(list_filter([CASE WHEN title IS NOT NULL OR len(authors) > 0 THEN 'fuzzy' END, CASE WHEN CASE WHEN regexp_full_match(isbn_raw, '[0-9]{{13}}') THEN {_VALID} ELSE false END THEN 'isbn' END, CASE WHEN length(trim(concat_ws(' ', title, array_to_string(authors, ' ')))) > 10 THEN 'semantic' END], lambda x: x IS NOT NULL), ',') AS suited FROM books")
def q23_suitability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the registered rankers suit each book as a query."""
    b = D.books(spark, sf_dir).withColumn("query", F.col("id"))
    return orchestrator().prepared(b).select("id", F.array_join("suited", ",").alias("suited"))


@query(_WR + "SELECT algorithm, round(0.3 * greatest(0, 1 - 120 / 1000.0) + 0.4 * avg(score) + 0.3 * avg(CASE WHEN score > 0.6 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS performance FROM ranked GROUP BY algorithm")
def z19_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0.3 speed (120 of 1,000 ms), 0.4 mean score, 0.3 share of scores above 0.6."""
    ok = F.avg(F.when(F.col("score") > 0.6, 1.0).otherwise(0.0))
    return _ranked(spark, sf_dir).groupBy("algorithm").agg(F.round(0.3 * (1 - 120 / 1000.0) + 0.4 * F.avg("score") + 0.3 * ok, 6).alias("performance"))


@query(_WS + ", ok AS (SELECT *, CASE WHEN confidence >= 0.8 THEN source_no END AS hit FROM source_records) SELECT book, source, confidence FROM (SELECT *, min(hit) OVER (PARTITION BY book) AS stop FROM ok) WHERE stop IS NULL OR source_no <= stop")
def w12_priority_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers that are asked for until a source, in order of priority, answers with 0.8 or more: one aggregate by book, no window over all answers."""
    rows = D.source_records(spark, sf_dir)
    stop = rows.groupBy("book").agg(F.min(F.when(F.col("confidence") >= 0.8, F.col("source_no"))).alias("stop"))
    return rows.join(stop, "book").filter("stop is null or source_no <= stop").select("book", "source", "confidence")

"""Quality queries: validators (2.2), scores and summaries (2.6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import isbn
from folioforge.operators import catalog as C
from folioforge.operators import quality as Q
from folioforge.sources import derived as D

from .isbn_queries import _v13
from .registry import query

_W = D.over(D.BOOKS)
_WF = D.over(D.FILES)
_DATE = "(published_date IN ('Unknown', '8400') = false)"
_MISS = "({0} IS NULL OR trim({0}) = '' OR trim({0}) = 'Unknown')"
YEAR = 2025


@query(_W + f"SELECT id, coalesce(length(trim(title)) >= 3, false) AND len(authors) > 0 AND length(trim(publisher)) >= 2 AS valid, CASE WHEN {_DATE} THEN published_date ELSE 'Unknown' END AS published_date FROM books")
def f8_record_validator(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.col("published_date")
    return D.books(spark, sf_dir).select("id", Q.valid_record(F.col("title"), F.col("authors"), F.col("publisher")).alias("valid"), F.when(Q.valid_date(date, YEAR), date).otherwise("Unknown").alias("published_date"))


@query(_W + f"SELECT id, {_DATE} AS valid, (id % 3 = 0 AND false) AS never FROM books")
def f9_date_validator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.books(spark, sf_dir).select("id", Q.valid_date(F.col("published_date"), YEAR).alias("valid"), Q.valid_date(F.concat("year", F.lit("-13")), YEAR).alias("never"))


@query(_W + "SELECT id, CASE source WHEN 'ECONOMY' THEN regexp_matches(publisher, '(?i)reilly|brand#1') WHEN 'PROMO' THEN regexp_matches(publisher, '(?i)packt|brand#2') ELSE true END AS consistent FROM books")
def f10_publisher_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("publisher")
    return D.books(spark, sf_dir).select("id", F.when(F.col("source") == "ECONOMY", p.rlike("(?i)reilly|brand#1")).when(F.col("source") == "PROMO", p.rlike("(?i)packt|brand#2")).otherwise(True).alias("consistent"))


_V = _v13("isbn_13")


@query(
    _W + f"""SELECT id, array_to_string(list_filter([CASE WHEN coalesce(length(trim(title)), 0) = 0 THEN 'title: missing' END, CASE WHEN length(trim(title)) BETWEEN 1 AND 2 THEN 'title: short' END,
CASE WHEN len(authors) = 0 THEN 'author: missing' END, CASE WHEN len(list_filter(authors, lambda a: regexp_matches(a, '[0-9]'))) > 0 THEN 'author: digits' END, CASE WHEN lower(trim(publisher)) IN ('', 'unknown') THEN 'publisher: missing' END,
CASE WHEN NOT CAST(year AS INTEGER) BETWEEN 1900 AND 2025 THEN 'year: range' END, CASE WHEN NOT {_V} THEN 'isbn: checksum' END], lambda x: x IS NOT NULL), '; ') AS errors,
round(CASE WHEN len(authors) > 0 THEN 0.3 ELSE 0 END + CASE WHEN coalesce(length(trim(title)) >= 3, false) THEN 0.3 ELSE 0 END + CASE WHEN lower(trim(publisher)) NOT IN ('', 'unknown') THEN 0.2 ELSE 0 END + CASE WHEN CAST(year AS INTEGER) BETWEEN 1900 AND 2025 THEN 0.1 ELSE 0 END + CASE WHEN {_V} THEN 0.1 ELSE 0 END, 6)::DOUBLE AS score FROM books"""
)
def f11_strict_validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    args = (F.col("title"), F.col("authors"), F.col("publisher"), F.col("year"), isbn.valid13(F.col("isbn_13")), YEAR)
    return D.books(spark, sf_dir).select("id", F.array_join(Q.errors(*args), "; ").alias("errors"), F.round(Q.strict_score(*args), 6).alias("score"))


_WORDS_OF = r"regexp_split_to_array(trim(line), '\s+')"
_STOP_NAMES = "[" + ", ".join(f"'{w}'" for w in Q.STOP_NAMES) + "]"
_NO_STOP = f"NOT list_has_any(list_transform({_WORDS_OF}, lambda w: lower(w)), {_STOP_NAMES})"
_LINES = "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda line: {0})) AS lines FROM documents"


def _lines(spark: SparkSession, sf_dir: str, good) -> DataFrame:
    """How many of each document's lines read as asked."""
    return D.read(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(F.split("text", "\n"), good)).cast("long").alias("lines"))


@query(_LINES.format(f"len({_WORDS_OF}) >= 2 AND NOT regexp_matches(line, '[0-9]') AND {_NO_STOP} AND len(list_filter({_WORDS_OF}, lambda w: NOT regexp_matches(w, '^[A-Z]'))) = 0"))
def f12_author_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, Q.valid_author)


@query(_W + "SELECT id, CAST(year AS INTEGER) BETWEEN 1990 AND 2030 AS valid FROM books")
def f13_year_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.books(spark, sf_dir).select("id", F.col("year").try_cast("int").between(1990, 2030).alias("valid"))


@query(_W + "SELECT id, coalesce(TRY_CAST(substr(published_date, 1, 4) AS INTEGER) BETWEEN 1900 AND 2025, false) AS valid FROM books")
def f14_form_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.books(spark, sf_dir).select("id", F.coalesce(F.substring("published_date", 1, 4).try_cast("int").between(1900, YEAR), F.lit(False)).alias("valid"))


@query(_LINES.format(f"len({_WORDS_OF}) BETWEEN 2 AND 5 AND {_NO_STOP} AND len(list_filter({_WORDS_OF}, lambda w: NOT regexp_matches(w, '[A-Za-z]'))) = 0 AND len(list_filter({_WORDS_OF}, lambda w: regexp_matches(w, '^[A-Z]'))) >= greatest(2, len({_WORDS_OF}) - 1)"))
def f15_author_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, Q.author_line)


_COUNT = "len(regexp_extract_all({0}, '{1}'))"
_T = "text"


@query(
    f"""SELECT doc_id, {_COUNT.format(_T, "[^A-Za-z0-9\\s.,;:!?''\"()-]")} > 0.3 * length(text) OR {_COUNT.format(_T, "[A-Z]{3,}")} > len(string_split_regex(trim(text), '\\s+')) / 4 OR {_COUNT.format(_T, "[0-9]")} > 0.15 * length(text) AS corrupted FROM documents"""
)
def f16_text_corruption(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.read(spark, sf_dir, "documents").select("doc_id", Q.corrupted(F.col("text")).alias("corrupted"))


@query(_WF + "SELECT id, coalesce(contains(lower(t), 'user guide'), false) AND coalesce(contains(lower(t), 'installation'), false) OR path LIKE '%_sg.pdf' AS manual FROM (SELECT *, CASE WHEN id % 3 = 0 THEN title || ' User Guide: Installation' ELSE title END AS t FROM files)")
def f17_manual_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("id") % 3 == 0, F.concat("title", F.lit(" User Guide: Installation"))).otherwise(F.col("title"))
    return D.files(spark, sf_dir).select("id", Q.is_manual(t, F.col("path")).alias("manual"))


@query(
    r"""WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
parts AS (SELECT doc_id, regexp_split_to_array(trim(line, ' '), '[ \t\x0B\f\r]+') AS w, list_filter(string_split(lower(line), ''), lambda c: regexp_full_match(c, '[a-z]')) AS l FROM lines)
SELECT doc_id, count(*) AS lines, count(*) FILTER (len(w) >= 4 AND len(list_filter(w, lambda x: length(x) = 1)) >= 0.6 * len(w)) AS singles,
count(*) FILTER (len(l) >= 6 AND len(list_filter(range(1, len(l)), lambda i: l[i] = l[i + 1])) >= 0.45 * (len(l) - 1)) AS repeated FROM parts GROUP BY doc_id"""
)
def f18_broken_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of each whole text fall apart into single characters, or repeat their letters."""
    lines = D.read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    flags = lines.select("doc_id", Q.many_singles(F.col("line")).alias("s"), Q.repeated_letters(F.col("line")).alias("r"))
    return flags.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if("s").alias("singles"), F.count_if("r").alias("repeated"))


@query(_W + "SELECT id, isbn_13 LIKE '97800000%' AND publisher ILIKE '%reilly%' AND title IS NOT NULL AS house_ok FROM books")
def f19_house_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.books(spark, sf_dir).select("id", (F.col("isbn_13").startswith("97800000") & F.col("publisher").ilike("%reilly%") & F.col("title").isNotNull()).alias("house_ok"))


@query(_W + "SELECT id, id % 3 <> 2 AS valid FROM books")
def f20_template_validator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders of a rename template are among the five known ones."""
    t = F.when(F.col("id") % 3 == 0, "{title} - {author} ({year})").when(F.col("id") % 3 == 1, "{isbn}_{publisher}").otherwise("{title} {edition}")
    known = F.array(*[F.lit(x) for x in ("title", "author", "year", "publisher", "isbn")])
    return D.books(spark, sf_dir).select("id", (F.size(F.array_except(F.regexp_extract_all(t, F.lit(r"\{([a-z]+)\}"), F.lit(1)), known)) == 0).alias("valid"))


_FOUR = "(CASE WHEN {t} THEN 1 ELSE 0 END)"


@query(
    _W + f"""SELECT count(*) AS total, count(*) FILTER (confidence >= 0.5) AS success, round(100.0 * count(*) FILTER (confidence >= 0.5) / count(*), 6) AS success_rate, round(avg(confidence), 6) AS mean_confidence,
count(*) FILTER ({_MISS.format('title')}) AS no_title, count(*) FILTER (len(authors) = 0) AS no_authors, count(*) FILTER ({_MISS.format('publisher')}) AS no_publisher, count(*) FILTER ({_MISS.format('published_date')}) AS no_date FROM books"""
)
def a8_report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    miss = lambda c: F.count_if(C.is_missing(F.col(c)))
    ok = F.count_if(F.col("confidence") >= 0.5)
    return D.books(spark, sf_dir).agg(
        F.count("*").alias("total"), ok.alias("success"), F.round(100.0 * ok / F.count("*"), 6).alias("success_rate"), F.round(F.avg("confidence"), 6).alias("mean_confidence"),
        miss("title").alias("no_title"), F.count_if(C.no_authors(F.col("authors"))).alias("no_authors"), miss("publisher").alias("no_publisher"), miss("published_date").alias("no_date"),
    )


@query(_W + "SELECT round(avg(confidence), 6) AS mean, median(confidence) AS median, round(stddev_samp(confidence), 6) AS stdev, min(confidence) AS least, max(confidence) AS most FROM books")
def a10_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = "confidence"
    return D.books(spark, sf_dir).agg(F.round(F.avg(c), 6).alias("mean"), F.median(c).alias("median"), F.round(F.stddev_samp(c), 6).alias("stdev"), F.min(c).alias("least"), F.max(c).alias("most"))


_P, _DD, _I = _MISS.format("publisher"), _MISS.format("published_date"), _MISS.format("isbn_13")


@query(
    _W + f"""SELECT id, round((coalesce(2.0 * least(length(title) / 50.0, 1.0), 0) + 1.5 * least(len(authors) / 3.0, 1.0) + CASE WHEN NOT {_P} THEN 1.0 ELSE 0 END + CASE WHEN NOT {_DD} THEN 1.0 ELSE 0 END + CASE WHEN NOT {_I} THEN 2.0 ELSE 0 END
+ CASE WHEN NOT {_P} AND NOT {_DD} AND NOT {_I} AND title IS NOT NULL AND len(authors) > 0 THEN 0.5 ELSE 0 END)::DOUBLE / 8.0 * 100.0, 4) AS quality FROM books"""
)
def a13_metadata_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = Q.quality(F.col("title"), F.col("authors"), F.col("publisher"), F.col("published_date"), F.col("isbn_13"), C.is_missing)
    return D.books(spark, sf_dir).select("id", F.round(score, 4).alias("quality"))


@query(
    _W + f"SELECT id, round(100.0 * (CAST(NOT {_MISS.format('title')} AS INTEGER) + CAST(len(authors) > 0 AS INTEGER) + CAST(NOT {_P} AS INTEGER) + CAST(NOT {_DD} AS INTEGER) + CAST(NOT {_I} AS INTEGER) + CAST(NOT {_MISS.format('isbn_10')} AS INTEGER)) / 6, 6)::DOUBLE AS completeness FROM books"
)
def a14_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = [~C.is_missing(F.col(c)) for c in ("title", "publisher", "published_date", "isbn_13", "isbn_10")] + [F.size("authors") > 0]
    return D.books(spark, sf_dir).select("id", F.round(100.0 * sum((c.cast("int") for c in filled), F.lit(0)) / 6, 6).alias("completeness"))


@query(_W + "SELECT CASE substr(isbn_13, 4, 1) WHEN '0' THEN 'English' WHEN '1' THEN 'English' WHEN '2' THEN 'French' WHEN '3' THEN 'German' ELSE 'other' END AS grp, count(*) AS n FROM books GROUP BY 1")
def a17_isbn_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.substring("isbn_13", 4, 1)
    g = F.when(p.isin("0", "1"), "English").when(p == "2", "French").when(p == "3", "German").otherwise("other")
    return D.books(spark, sf_dir).groupBy(g.alias("grp")).agg(F.count("*").alias("n"))


_MESSAGE = """CASE WHEN event_type = 'error' AND value > 30 THEN 'Read timed out: user ' || user_id WHEN event_type = 'error' THEN '404 Not Found: user ' || user_id WHEN event_type = 'click' AND value > 50 THEN 'HTTP 429 rate limit'
WHEN event_type = 'view' AND value < 1 THEN 'JSON decode error: ' || props WHEN event_type = 'purchase' AND value > 60 THEN 'Connection refused' ELSE event_type || ' done' END"""
_KINDS = (("timed out", "timeout"), ("not found", "not_found"), ("rate limit", "rate_limit"), ("json", "parse"), ("connection", "network"))


@query("SELECT kind, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN contains(lower(m), '{w}') THEN '{k}'" for w, k in _KINDS) + f" ELSE 'other' END AS kind FROM (SELECT {_MESSAGE} AS m FROM events)) GROUP BY kind")
def a18_error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of the event log, by the first keyword that they hold."""
    t, v, user = F.col("event_type"), F.col("value"), F.col("user_id").cast("string")
    m = (
        F.when((t == "error") & (v > 30), F.concat(F.lit("Read timed out: user "), user))
        .when(t == "error", F.concat(F.lit("404 Not Found: user "), user))
        .when((t == "click") & (v > 50), "HTTP 429 rate limit")
        .when((t == "view") & (v < 1), F.concat(F.lit("JSON decode error: "), "props"))
        .when((t == "purchase") & (v > 60), "Connection refused")
        .otherwise(F.concat(t, F.lit(" done")))
    )
    kind = F.lit("other")
    for word, name in reversed(_KINDS):
        kind = F.when(F.lower(m).contains(word), name).otherwise(kind)
    return D.read(spark, sf_dir, "events").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query(_W + "SELECT count(title) AS with_title, count(*) FILTER (len(authors) > 0) AS with_authors, count(isbn_13) AS with_isbn, round(avg(confidence), 6) AS mean, count(*) FILTER (confidence > 0.7) AS high, count(*) FILTER (confidence >= 0.4 AND confidence <= 0.7) AS middle, count(*) FILTER (confidence < 0.4) AS low FROM books")
def z18_extraction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("confidence")
    return D.books(spark, sf_dir).agg(F.count("title").alias("with_title"), F.count_if(F.size("authors") > 0).alias("with_authors"), F.count("isbn_13").alias("with_isbn"), F.round(F.avg(c), 6).alias("mean"), F.count_if(c > 0.7).alias("high"), F.count_if((c >= 0.4) & (c <= 0.7)).alias("middle"), F.count_if(c < 0.4).alias("low"))


@query(_W + "SELECT id, round(least(0.25, 0.1 + 0.15 * (CAST(title IS NOT NULL AS INTEGER) + CAST(len(authors) > 0 AS INTEGER) + CAST(publisher <> 'Unknown' AS INTEGER) + 1 + 1) / 5 + CASE WHEN id % 2 = 0 THEN 0.05 ELSE 0 END), 6)::DOUBLE AS boost FROM books")
def z25_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = F.col("title").isNotNull().cast("int") + (F.size("authors") > 0).cast("int") + (F.col("publisher") != "Unknown").cast("int") + 2
    return D.books(spark, sf_dir).select("id", F.round(F.least(F.lit(0.25), 0.1 + 0.15 * filled / 5 + F.when(F.col("id") % 2 == 0, 0.05).otherwise(0.0)), 6).alias("boost"))


@query(_W + "SELECT id, round(least(1.0, confidence + 0.15), 6) AS confidence, coalesce(title, 'predicted') AS title FROM books")
def z26_prediction_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.books(spark, sf_dir).select("id", F.round(F.least(F.lit(1.0), F.col("confidence") + 0.15), 6).alias("confidence"), F.coalesce("title", F.lit("predicted")).alias("title"))

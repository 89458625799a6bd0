"""ISBN queries (inventory 2.3) over the derived catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import isbn
from folioforge.sources import derived as D

from .registry import query

_W = D.over(D.BOOKS)
_CLEAN = "regexp_replace(upper({0}), '[^0-9X]', '', 'g')"


def _v13(c: str, strict: bool = False) -> str:
    s = _CLEAN.format(c)
    shape = "^97[89][0-9]{10}$" if strict else "^[0-9]{13}$"
    return f"coalesce(CASE WHEN regexp_matches({s}, '{shape}') THEN {D.check13_sql(s)} = substr({s}, 13, 1) END, false)"


def _v10(c: str) -> str:
    s = _CLEAN.format(c)
    return f"coalesce(CASE WHEN regexp_matches({s}, '^[0-9]{{9}}[0-9X]$') THEN {D.check10_sql(s)} = substr({s}, 10, 1) END, false)"


def _to13(c: str) -> str:
    core = f"('978' || substr({_CLEAN.format(c)}, 1, 9))"
    return f"CASE WHEN {_v10(c)} THEN {core} || {D.check13_sql(core)} END"


def _ocr(c: str) -> str:
    for bad, good in isbn.OCR:
        c = f"replace({c}, '{bad}', '{good}')"
    return c


@query(_W + f"SELECT id, title, isbn_13, confidence FROM books WHERE {_v13('isbn_13', True)} AND title IS NOT NULL AND title ILIKE '%ring%' ORDER BY confidence DESC, id LIMIT 20")
def flagship_valid_isbn_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books with a valid ISBN and a title match, best confidence first."""
    b = D.books(spark, sf_dir).filter(F.col("title").ilike("%ring%") & isbn.valid13(F.col("isbn_13"), strict=True))
    return b.orderBy(F.desc("confidence"), "id").limit(20).select("id", "title", "isbn_13", "confidence")


@query(_W + f"SELECT id, {_CLEAN.format('isbn_raw')} AS cleaned FROM books")
def i1_clean_isbn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.books(spark, sf_dir).select("id", isbn.clean(F.col("isbn_raw")).alias("cleaned"))


@query(_W + f"SELECT id, {_v13('isbn_13')} AS valid FROM books")
def i2_isbn13_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.books(spark, sf_dir).select("id", isbn.valid13(F.col("isbn_13")).alias("valid"))


@query(_W + f"SELECT id, {_v13('isbn_raw', True)} AS valid FROM books")
def i3_isbn13_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.books(spark, sf_dir).select("id", isbn.valid13(F.col("isbn_raw"), strict=True).alias("valid"))


@query(_W + f"SELECT id, {_v10('isbn_10')} AS valid, {_v10('isbn_13')} AS other FROM books")
def i4_isbn10_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.books(spark, sf_dir).select("id", isbn.valid10(F.col("isbn_10")).alias("valid"), isbn.valid10(F.col("isbn_13")).alias("other"))


@query(_W + f"SELECT id, {D.check13_sql('isbn_13')} AS check_digit FROM books")
def i5_isbn13_check_digit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.books(spark, sf_dir).select("id", isbn.check13(F.col("isbn_13")).alias("check_digit"))


@query(_W + f"SELECT id, {_to13('isbn_10')} AS isbn13, {_to13('isbn_13')} AS other FROM books")
def i6_isbn10_to_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.books(spark, sf_dir).select("id", isbn.to13(F.col("isbn_10")).alias("isbn13"), isbn.to13(F.col("isbn_13")).alias("other"))


_FULL = _CLEAN.format(_ocr("isbn_raw"))
_CANDIDATES = f"list_distinct([{_CLEAN.format('isbn_raw')}, " + ", ".join(_CLEAN.format(f"replace(isbn_raw, '{b}', '{g}')") for b, g in isbn.OCR) + f", {_FULL}])"


@query(
    _W + f"""SELECT id, coalesce(array_to_string(list_sort(list_filter(c, lambda x: {_v13('x')} OR {_v10('x')})), ','), '') AS valid_isbns,
coalesce(array_to_string(list_sort(list_filter(c, lambda x: NOT ({_v13('x')} OR {_v10('x')}) AND length(x) IN (10, 13))), ','), '') AS recovered_raw FROM (SELECT id, {_CANDIDATES} AS c FROM books)"""
)
def i7_isbn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid repairs and raw recoveries of a damaged ISBN."""
    good, raw = isbn.repaired(F.col("isbn_raw"))
    return D.books(spark, sf_dir).select("id", F.array_join(good, ",").alias("valid_isbns"), F.array_join(raw, ",").alias("recovered_raw"))


def _blurb(c13, c10):
    return F.concat(F.lit("First edition. ISBN "), c13, F.lit(", also ISBN-10: "), c10, F.lit("; printed 2001."))


_BLURB = "('First edition. ISBN ' || isbn_13 || ', also ISBN-10: ' || isbn_10 || '; printed 2001.')"


@query(_W + f"SELECT id, array_to_string(list_sort(list_distinct(list_filter([isbn_13, isbn_10], lambda x: {_v13('x')} OR {_v10('x')}))), ',') AS isbns FROM books")
def i8_extract_isbns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All valid ISBNs of a text that names two."""
    return D.books(spark, sf_dir).select("id", F.array_join(isbn.extract_all(_blurb(F.col("isbn_13"), F.col("isbn_10"))), ",").alias("isbns"))


@query(_W + f"SELECT id, CASE WHEN {_v13('isbn_13', True)} THEN isbn_13 ELSE isbn_10 END AS isbn, CASE WHEN {_v13('isbn_13', True)} THEN isbn_13 ELSE {_to13('isbn_10')} END AS isbn13 FROM books")
def i9_extract_first_with_isbn13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first valid hit in pattern order, with its ISBN-13."""
    first = isbn.first_in(_blurb(F.col("isbn_13"), F.col("isbn_10")))
    return D.books(spark, sf_dir).select("id", first.alias("isbn")).withColumn("isbn13", isbn.normal13(F.col("isbn")))


@query(_W + "SELECT id, regexp_extract('eISBN: ' || isbn_13, '(?:e-?ISBN|ISBN \\(digital\\)|ebook ISBN)[: ]*(97[89][0-9]{10})', 1) AS digital FROM books")
def i10_digital_isbn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.books(spark, sf_dir).select("id", F.regexp_extract(F.concat(F.lit("eISBN: "), "isbn_13"), r"(?:e-?ISBN|ISBN \(digital\)|ebook ISBN)[: ]*(97[89][0-9]{10})", 1).alias("digital"))


@query(_W + f"SELECT id, regexp_matches({_CLEAN.format('isbn_raw')}, '^97[89][0-9]{{10}}$') OR regexp_matches({_CLEAN.format('isbn_raw')}, '^[0-9]{{9}}[0-9X]$') AS quick FROM books")
def i11_quick_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.books(spark, sf_dir).select("id", isbn.quick(F.col("isbn_raw")).alias("quick"))


@query(_W + f"SELECT id, CASE WHEN {_v13('isbn_13', True)} THEN isbn_13 ELSE isbn_10 END AS first_isbn FROM books")
def i12_first_isbn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.books(spark, sf_dir).select("id", isbn.first_in(_blurb(F.col("isbn_13"), F.col("isbn_10"))).alias("first_isbn"))


@query(_W + f"SELECT id, {_ocr('isbn_raw')} AS fixed FROM books")
def i13_ocr_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.books(spark, sf_dir).select("id", isbn.ocr_fixed(F.col("isbn_raw")).alias("fixed"))


@query(_W + r"SELECT id, regexp_replace(regexp_replace(regexp_replace('isbn:  ' || isbn_raw || '  –  x', '\s+', ' ', 'g'), '[‐‑‒–—]', '-', 'g'), '(?i)ISBN[: ]*', 'ISBN: ', 'g') AS cleaned FROM books")
def i14_isbn_text_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.books(spark, sf_dir).select("id", isbn.text_cleanup(F.concat(F.lit("isbn:  "), "isbn_raw", F.lit("  –  x"))).alias("cleaned"))


@query(_W + f"SELECT id, (coalesce({_to13('isbn_10')} = CASE WHEN {_v13('isbn_13')} THEN isbn_13 END, false)) AS variant, true AS self_variant FROM books")
def i15_isbn_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = D.books(spark, sf_dir)
    return b.select("id", isbn.is_variant(F.col("isbn_10"), F.col("isbn_13")).alias("variant"), isbn.is_variant(F.col("isbn_13"), F.col("isbn_13")).alias("self_variant"))


@query(_W + f"SELECT id, {_v13('isbn_13')} AND substr({_CLEAN.format('isbn_raw')}, 1, 7) = substr(isbn_13, 1, 7) AS accepted FROM books")
def i16_variant_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.books(spark, sf_dir).select("id", isbn.accepts_variant(F.col("isbn_raw"), F.col("isbn_13")).alias("accepted"))


@query(_W + "SELECT id, CASE WHEN publisher ILIKE '%casa do codigo%' THEN 'Casa do Codigo' WHEN publisher ILIKE '%novatec%' THEN 'Novatec' WHEN publisher ILIKE '%reilly%' THEN 'O''Reilly' WHEN publisher ILIKE '%packt%' THEN 'Packt' WHEN publisher ILIKE '%manning%' THEN 'Manning' END AS found, round(confidence + CASE WHEN regexp_matches(publisher, '(?i)casa do codigo|novatec|reilly|packt|manning') THEN 0.1 ELSE 0 END, 6) AS boosted FROM books")
def i17_publisher_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, found = F.col("publisher"), F.lit(None).cast("string")
    for word, name in reversed((("casa do codigo", "Casa do Codigo"), ("novatec", "Novatec"), ("reilly", "O'Reilly"), ("packt", "Packt"), ("manning", "Manning"))):
        found = F.when(p.ilike(f"%{word}%"), name).otherwise(found)
    return D.books(spark, sf_dir).select("id", found.alias("found"), F.round(F.col("confidence") + F.when(found.isNotNull(), 0.1).otherwise(0.0), 6).alias("boosted"))


@query(_W + "SELECT id, CASE WHEN ('97865' || substr(isbn_13, 6)) LIKE '97865%' AND id % 2 = 0 THEN 'Casa do Codigo' WHEN id % 3 = 0 THEN 'Novatec' END AS by_prefix FROM books")
def i18_publisher_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("id") % 2 == 0, "97865").when(F.col("id") % 3 == 0, "97885").otherwise("97800")
    return D.books(spark, sf_dir).select("id", isbn.prefix_publisher(F.concat(code, F.substring("isbn_13", 6, 8))).alias("by_prefix"))


@query(_W + "SELECT id, isbn_13 AS loose FROM books")
def i19_loose_isbn_in_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.books(spark, sf_dir).select("id", F.array_join(isbn.loose_in_query(F.concat(F.lit("find book "), "isbn_13", F.lit(" please"))), ",").alias("loose"))


_TOKENS = "list_distinct(string_split(coalesce(lower(title), ''), ' '))"


@query(
    _W + f"""SELECT id, round(least(1.0, 0.9 + 0.1 * (len(list_intersect(t, ['small', 'ring', 'volume'])) * 1.0 / len(list_distinct(list_concat(t, ['small', 'ring', 'volume'])))) + CASE WHEN list_contains(authors, 'Supplier#000000001') THEN 0.05 ELSE 0 END), 6) AS score
FROM (SELECT *, {_TOKENS} AS t FROM books)"""
)
def i20_isbn_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of an ISBN hit, raised by title overlap and an author match."""
    t, want = F.array_distinct(F.split(F.coalesce(F.lower("title"), F.lit("")), " ")), F.array(F.lit("small"), F.lit("ring"), F.lit("volume"))
    overlap = F.size(F.array_intersect(t, want)) / F.size(F.array_union(t, want))
    author = F.when(F.array_contains("authors", "Supplier#000000001"), 0.05).otherwise(0.0)
    return D.books(spark, sf_dir).select("id", F.round(F.least(F.lit(1.0), 0.9 + 0.1 * overlap + author), 6).alias("score"))

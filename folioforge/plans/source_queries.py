"""Source, merge and recovery queries (inventory 2.1, 2.4, 2.5, 2.14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import filenames as N
from folioforge.functions import isbn
from folioforge.functions import similarity as S
from folioforge.functions import text as T
from folioforge.operators import catalog as C
from folioforge.operators import duplicates
from folioforge.operators.tables import written
from folioforge.sources import derived as D
from folioforge.sources import formats as X

from .registry import query

_W = D.over(D.BOOKS)
_WF = D.over(D.FILES)
_WS = D.over(D.SOURCE_RECORDS)


_q = lambda w: "'" + w.replace("'", "''") + "'"
_any = lambda low, text: "(" + " OR ".join(f"contains({low}, {_q(w)})" for w in N.words(text)) + ")"
_first = lambda low, table: "CASE " + " ".join(f"WHEN {_any(low, text)} THEN {_q(name)}" for name, text in table.items()) + " ELSE '' END"
_count = lambda low, text: "(" + " + ".join(f"CAST(contains({low}, {_q(w)}) AS INTEGER)" for w in N.words(text)) + ")"
TRUTH = r"""truth AS (SELECT *, CASE WHEN length(t0) > 3 THEN t0 ELSE '' END AS t FROM (SELECT *, regexp_replace(regexp_replace(trim(CASE WHEN a <> '' THEN trim(clean[pos + 3:]) ELSE clean END), '^-\s*', ''), '\s+', ' ', 'g') AS t0 FROM (
SELECT *, CASE WHEN pos > 0 AND length(who) > 2 AND NOT regexp_matches(who, '^[0-9]') AND NOT """ + _any("lower(who)", N.NO_AUTHOR) + r""" THEN who ELSE '' END AS a, """ + _first("lower(clean)", N.INTERNATIONAL | N.BRAZILIAN) + r""" AS p FROM (
SELECT *, strpos(clean, ' - ') AS pos, trim(clean[1:greatest(strpos(clean, ' - ') - 1, 0)]) AS who FROM (
SELECT *, CASE WHEN y <> '' THEN trim(regexp_replace(stem, '\([0-9]{4}\)', '', 'g')) ELSE stem END AS clean FROM (
SELECT *, regexp_extract(stem, '\(([0-9]{4})\)', 1) AS y FROM (
SELECT id, path, lower(path) AS low, regexp_replace(trim(regexp_replace(regexp_replace(strip_accents(path), '[^\p{L}\p{N}_\s\-().,]', ' ', 'g'), '\s+', ' ', 'g')), '\.[^.]*$', '') AS stem FROM files)))))))"""

@query(_WF + "SELECT id, path AS name FROM files WHERE id % 10 <> 0")
def s11_ls_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names from the lines of a listing; totals give none."""
    line = F.when(F.col("id") % 10 == 0, "total 1234").otherwise(F.concat(F.lit("-rw-r--r--  1 user  staff   1024 Jan  5 10:00 "), "path"))
    return D.files(spark, sf_dir).select("id", X.ls_name(line).alias("name")).filter("name is not null")


@query(_WF + "SELECT id, md5(path) AS drive_id, path AS name FROM files")
def s12_drive_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id of a link in one of its forms, and the file name, the rest of the line: each file's line of a list of links."""
    key = F.md5(F.col("path").cast("binary"))
    forms = [F.concat(F.lit("https://drive.example/file/d/"), key, F.lit("/view?usp=sharing")), F.concat(F.lit("https://drive.example/open?id="), key), F.concat(F.lit("https://drive.example/drive/folders/"), key)]
    line = F.concat(F.get(F.array(*forms), F.pmod(F.xxhash64("path"), F.lit(3)).cast("int")), F.lit(" "), "path")
    return D.files(spark, sf_dir).select("id", line.alias("line")).select("id", X.drive_id(F.col("line")).alias("drive_id"), F.regexp_extract("line", r"^\S+\s+(.*)$", 1).alias("name"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books as the JSON answers of a catalogue API."""
    ids = F.array(F.struct(F.lit("ISBN_10").alias("type"), F.col("isbn_10").alias("identifier")), F.struct(F.lit("ISBN_13").alias("type"), F.col("isbn_13").alias("identifier")))
    info = F.struct("title", "authors", "publisher", F.col("published_date").alias("publishedDate"), ids.alias("industryIdentifiers"))
    return D.books(spark, sf_dir).select("id", F.to_json(F.struct(F.array(F.struct(info.alias("volumeInfo"))).alias("items"))).alias("answer"))


@query(_W + "SELECT id, title, array_to_string(authors, ', ') AS authors, publisher, string_split(published_date, '-')[1] AS year, isbn_10, isbn_13, 0.75::DOUBLE AS confidence FROM books")
def z1_api_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("id", X.api_record(F.col("answer")).alias("r")).select("id", "r.*")


@query(_W + "SELECT id, CASE WHEN id % 2 = 0 THEN title || ': more' ELSE title END AS full_title, array_to_string(authors, ', ') AS authors, coalesce(nullif(regexp_extract(published_date, '(19|20)[0-9]{2}', 0), ''), '') AS year FROM books")
def s15_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and subtitle, joined authors, and the year of a catalogue's record."""
    sub = F.when(F.col("id") % 2 == 0, "more")
    full = F.when(F.col("title").isNotNull(), F.concat_ws(": ", "title", sub))
    return D.books(spark, sf_dir).select("id", full.alias("full_title"), F.array_join("authors", ", ").alias("authors"), F.regexp_extract("published_date", "(19|20)[0-9]{2}", 0).alias("year"))


@query(_WS + "SELECT book, count(*) AS answers, max(confidence) AS best FROM source_records GROUP BY book")
def s14_source_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of remote catalogues' answers, by book."""
    return D.source_records(spark, sf_dir).groupBy("book").agg(F.count("*").alias("answers"), F.max("confidence").alias("best"))


@query(_W + "SELECT id, CASE WHEN regexp_matches(n, '^[A-Z].*') THEN n END AS author FROM (SELECT id, regexp_extract('A Title' || chr(10) || 'by ' || coalesce(authors[1], 'Nobody Known') || chr(10) || 'Published by X', 'by ([A-Z][A-Za-z#0-9 ]+)', 1) AS n FROM books)")
def t26_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("A Title\nby "), F.coalesce(F.get("authors", F.lit(0)), F.lit("Nobody Known")), F.lit("\nPublished by X"))
    return D.books(spark, sf_dir).select("id", F.nullif(F.regexp_extract(text, "by ([A-Z][A-Za-z#0-9 ]+)", 1), F.lit("")).alias("author"))


_LINE = "array_to_string(authors[1:2], ', ') || CASE WHEN len(authors) > 2 THEN ' and ' || authors[3] ELSE '' END || ' & ' || publisher"


@query(_W + f"SELECT id, array_to_string(list_filter(list_transform(regexp_split_to_array({_LINE}, ', | and | & '), lambda x: trim(x)), lambda x: x <> '')[1:3], '|') AS authors FROM books")
def t20_split_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The people of an author line, split at commas and conjunctions; three at most."""
    line = F.concat(F.array_join(F.slice("authors", 1, 2), ", "), F.when(F.size("authors") > 2, F.concat(F.lit(" and "), F.get("authors", F.lit(2)))).otherwise(""), F.lit(" & "), "publisher")
    parts = F.filter(F.transform(F.split(line, ", | and | & "), lambda x: F.trim(x)), lambda x: x != "")
    return D.books(spark, sf_dir).select("id", F.array_join(F.slice(F.array_distinct(parts), 1, 3), "|").alias("authors"))


@query(_W + "SELECT id, CASE WHEN publisher ILIKE '%reilly%' THEN 'O''Reilly' WHEN publisher ILIKE '%packt%' THEN 'Packt' WHEN publisher ILIKE '%manning%' THEN 'Manning' END AS publisher FROM books")
def t22_publisher_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first publisher whose letters stand in the text's."""
    key = F.regexp_replace(F.lower("publisher"), "[^a-z0-9]", "")
    found = F.when(key.contains("reilly"), "O'Reilly").when(key.contains("packt"), "Packt").when(key.contains("manning"), "Manning")
    return D.books(spark, sf_dir).select("id", found.alias("publisher"))


_LOW = "(SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents)"
_WEIGHTS = ", ".join("(" + " + ".join(f"CASE WHEN contains(low, {_q(w)}) THEN {N.weight(w)} ELSE 0 END" for w in N.words(text)) + f") AS {name}" for name, text in N.CATEGORIES.items())
_CATEGORY = "CASE WHEN m = 0 THEN 'General' " + " ".join(f"WHEN {name} = m THEN '{name}'" for name in N.CATEGORIES) + " END"
_SCORED = f"(SELECT doc_id, low, {_CATEGORY} AS category FROM (SELECT *, greatest({', '.join(N.CATEGORIES)}) AS m FROM (SELECT doc_id, low, {_WEIGHTS} FROM {_LOW})))"


@query(f"SELECT doc_id, category FROM {_SCORED}")
def t13_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category of each whole text by the words of nine categories: the greatest weight, the first of equal ones."""
    low = F.lower(F.coalesce("text", F.lit("")))
    return D.read(spark, sf_dir, "documents").select("doc_id", low.alias("low")).withColumn("found", N.keywords(F.col("low"))).select("doc_id", N.category(F.col("low"), F.col("found")).alias("category"))


@query(
    "SELECT doc_id, CASE category " + " ".join(f"WHEN '{name}' THEN {_first('low', table)}" for name, table in N.SUBCATEGORIES.items()) + " ELSE '' END AS subcategory, "
    + "array_to_string(list_sort(list_filter([" + ", ".join(map(_q, N.TERMS)) + f"], lambda w: contains(low, w))), ',') AS keywords, CASE WHEN {_any('low', N.PORTUGUESE_SIGNS)} THEN 'Portuguese' ELSE 'English' END AS language FROM {_SCORED}"
)
def t14_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subcategory, the sorted technical terms and the language of each whole text."""
    low = F.lower(F.coalesce("text", F.lit("")))
    rows = D.read(spark, sf_dir, "documents").select("doc_id", low.alias("low")).withColumn("found", N.keywords(F.col("low")))
    rows = rows.withColumn("main", N.category(F.col("low"), F.col("found")))
    return rows.select("doc_id", N.subcategory(F.col("low"), F.col("main")).alias("subcategory"), F.array_join("found", ",").alias("keywords"), N.language(F.col("low")).alias("language"))


@query(_W + "SELECT id, round(least(1.0, CASE WHEN title IS NOT NULL THEN 0.25 ELSE 0 END + CASE WHEN len(authors) > 0 THEN 0.2 ELSE 0 END + CASE WHEN publisher <> 'Unknown' THEN 0.15 ELSE 0 END + 0.15 + least(0.01 * coalesce(len(string_split(title, ' ')), 0), 0.1)), 6)::DOUBLE AS confidence FROM books")
def t15_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = lambda c, w: F.when(c, w).otherwise(0.0)
    words = F.coalesce(F.size(F.split("title", " ")), F.lit(0))
    words = F.when(F.col("title").isNull(), 0).otherwise(words)
    score = on(F.col("title").isNotNull(), 0.25) + on(F.size("authors") > 0, 0.2) + on(F.col("publisher") != "Unknown", 0.15) + 0.15 + F.least(0.01 * words, F.lit(0.1))
    return D.books(spark, sf_dir).select("id", F.round(F.least(F.lit(1.0), score), 6).alias("confidence"))


@query(_WF + r"""SELECT id, array_to_string(list_transform(string_split(trim(regexp_replace(regexp_replace(path, '\.[A-Za-z0-9]+$', ''), '[_-]+', ' ', 'g')), ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS title FROM files""")
def t24_title_from_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Underscores and hyphens are blanks; title case; no extension."""
    stem = F.regexp_replace("path", r"\.[A-Za-z0-9]+$", "")
    return D.files(spark, sf_dir).select("id", F.initcap(F.trim(F.regexp_replace(stem, "[_-]+", " "))).alias("title"))


@query(_WF + "SELECT id, trim(regexp_replace(regexp_replace(lower(path), '(z-lib|libgen|www[.][a-z]+|[(][^)]*[)])', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS terms FROM files")
def t50_search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.regexp_replace(F.lower("path"), "(z-lib|libgen|www[.][a-z]+|[(][^)]*[)])", " ")
    return D.files(spark, sf_dir).select("id", F.trim(F.regexp_replace(bad, "[^a-z0-9]+", " ")).alias("terms"))


@query(_W + "SELECT id, 'Copyright © ' || year || ' ' || publisher || chr(10) || 'ISBN ' || isbn_13 AS section, contains(lower(publisher), 'reilly') AS oreilly FROM books JOIN documents ON doc_id = id")
def t52_copyright_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copyright section within the whole text of each book, a document with the book's own section amid its lines; and whether the house's name stands within 100 characters of the ISBN."""
    b, d = D.books(spark, sf_dir), D.read(spark, sf_dir, "documents")
    section = F.concat(F.lit("Copyright © "), "year", F.lit(" "), "publisher", F.lit("\nISBN "), "isbn_13")
    half = F.floor(F.length("text") / 2).cast("int")
    text = F.concat(F.substring("text", F.lit(1), half), F.lit("\n\n"), section, F.lit("\n\n"), F.substring("text", half + 1, F.length("text")))
    rows = b.join(d, F.col("id") == F.col("doc_id")).select("id", "isbn_13", text.alias("text"))
    at = F.instr("text", F.col("isbn_13"))
    near = F.substring("text", F.greatest(at - 100, F.lit(1)), F.lit(200))
    return rows.select("id", F.regexp_extract("text", r"(?is)((?:copyright|©).*?)(?:\n\n|$)", 1).alias("section"), F.contains(F.lower(near), F.lit("reilly")).alias("oreilly"))


@query(
    _WF + "," + TRUTH + """, seen AS (SELECT id, CASE WHEN ext IN ('pdf', 'epub') THEN (text[1:3000] || chr(10) || 'ISBN ' || isbn_raw || chr(10) || text[3001:])[1:6000] END AS s FROM books LEFT JOIN documents ON doc_id = id),
told AS (SELECT id, nullif(regexp_extract(s, '\\nISBN ([0-9]{13})\\n', 1), '') AS i, nullif(trim(regexp_extract(s, '^([^\\n]{6,120})(?:\\n|$)', 1)), '') AS st, nullif(regexp_extract(s, '((?:19|20)[0-9]{2})', 1), '') AS sy, nullif("""
    + _first("lower(coalesce(s, ''))", N.INTERNATIONAL | N.BRAZILIAN) + """, '') AS sp FROM seen)
SELECT id, coalesce(st, t) AS title, coalesce(sp, p) AS publisher, coalesce(sy, y) AS year, i AS isbn, CASE WHEN i IS NOT NULL THEN 0.55 WHEN st IS NOT NULL THEN 0.45 ELSE 0.35 END::DOUBLE AS confidence FROM truth JOIN told USING (id)"""
)
def z8_fast_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the beginning of each readable file's text says (6,000 characters are the feature), a document with the book's ISBN amid its
    lines, overrides what the file name says, field by field."""
    f, d = D.files(spark, sf_dir), D.read(spark, sf_dir, "documents").select("doc_id", "text")
    whole = F.concat(F.substring("text", 1, 3000), F.lit("\nISBN "), "isbn_raw", F.lit("\n"), F.substring("text", F.lit(3001), F.length("text")))
    said = N.ground_truth(F.col("path"))
    rows = f.join(d, F.col("id") == F.col("doc_id"), "left").select("id", *[said[k].alias(f"x_{k}") for k in ("title", "publisher", "year")], F.when(F.col("ext").isin("pdf", "epub"), F.substring(whole, 1, 6000)).alias("s"))
    found = lambda rx: F.nullif(F.trim(F.regexp_extract("s", rx, 1)), F.lit(""))
    told = {"title": found(r"^([^\n]{6,120})(?:\n|$)"), "publisher": F.nullif(N.first_of(F.lower(F.coalesce("s", F.lit(""))), N.INTERNATIONAL | N.BRAZILIAN), F.lit("")), "year": found("((?:19|20)[0-9]{2})")}
    isbn_of = found(r"\nISBN ([0-9]{13})\n")
    confidence = F.when(isbn_of.isNotNull(), 0.55).when(told["title"].isNotNull(), 0.45).otherwise(0.35)
    return rows.select("id", *[F.coalesce(told[k], F.col(f"x_{k}")).alias(k) for k in told], isbn_of.alias("isbn"), confidence.alias("confidence"))


@query(_W + "SELECT id, round(least(0.75, 0.45 + CASE WHEN len(authors) > 0 THEN 0.15 ELSE 0 END + CASE WHEN publisher <> 'Unknown' THEN 0.1 ELSE 0 END + 0.05), 6)::DOUBLE AS confidence FROM books WHERE title IS NOT NULL AND confidence < 0.5")
def z9_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows not yet successful (left anti), rebuilt; those without a title go."""
    b = D.books(spark, sf_dir)
    left = b.join(b.filter("confidence >= 0.5").select("id"), "id", "left_anti").filter("title is not null")
    score = 0.45 + F.when(F.size("authors") > 0, 0.15).otherwise(0.0) + F.when(F.col("publisher") != "Unknown", 0.1).otherwise(0.0) + 0.05
    return left.select("id", F.round(F.least(F.lit(0.75), score), 6).alias("confidence"))


@query(_W + "SELECT ext, count(*) FILTER (confidence < 0.5) AS attempted, count(*) FILTER (confidence < 0.5 AND title IS NOT NULL) AS recovered FROM books GROUP BY ext")
def z10_recovery_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tried = F.col("confidence") < 0.5
    return D.books(spark, sf_dir).groupBy("ext").agg(F.count_if(tried).alias("attempted"), F.count_if(tried & F.col("title").isNotNull()).alias("recovered"))


@query(_W + "SELECT id, regexp_replace('ISBN ' || isbn_13 || ' (pbk) X', '[^0-9X -]', '', 'g') AS cleaned FROM books")
def z12_isbn_text_aggressive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.books(spark, sf_dir).select("id", F.regexp_replace(F.concat(F.lit("ISBN "), "isbn_13", F.lit(" (pbk) X")), "[^0-9X -]", "").alias("cleaned"))


@query(_WF + "SELECT id, path, coalesce(title, '') || '.' || ext AS target FROM files WHERE title IS NOT NULL")
def z17_rename_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rename plan: old path, new name with its extension; rows without a name go."""
    name = T.formatted("{title}", title=F.col("title"))
    return D.files(spark, sf_dir).filter(name != "").select("id", "path", F.concat(name, F.lit("."), "ext").alias("target"))


@query(_W + """SELECT a.id, CASE WHEN split_part(a.title, ' ', 2) = split_part(b.title, ' ', 2) THEN 2 ELSE 0 END + CASE WHEN list_has_any(a.authors, b.authors) THEN 2 ELSE 0 END + CASE WHEN a.publisher = b.publisher THEN 3 ELSE 0 END >= 3 AS same,
coalesce(length(b.title) > length(a.title), b.title IS NOT NULL AND a.title IS NULL) AS better FROM books a JOIN books b ON b.id = a.id + 1""")
def z24_match_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record beside the next one: title word 2, an author 2, publisher 3, the same at 3; and whether the other's title is better: there at all, or longer."""
    b = D.books(spark, sf_dir).select("id", "title", "authors", "publisher")
    other = b.select((F.col("id") - 1).alias("id"), F.col("title").alias("t"), F.col("authors").alias("a"), F.col("publisher").alias("p"))
    second = lambda c: F.split_part(c, F.lit(" "), F.lit(2))
    points = F.when(second(F.col("title")) == second(F.col("t")), 2).otherwise(0) + F.when(F.arrays_overlap("authors", "a"), 2).otherwise(0) + F.when(F.col("publisher") == F.col("p"), 3).otherwise(0)
    return b.join(other, "id").select("id", (points >= 3).alias("same"), F.coalesce(F.length("t") > F.length("title"), F.col("t").isNotNull() & F.col("title").isNull()).alias("better"))


#: Pairs that stand for one book, and their closure: what is a class is a component.
_PAIRS = """named AS (SELECT id, isbn_13, lower(coalesce(title, '')) AS t, lower(coalesce(authors[1], '')) AS x FROM books),
pairs AS (SELECT a.id AS a, b.id AS b FROM named a JOIN named b ON a.id <> b.id AND (a.isbn_13 = b.isbn_13 OR (a.t <> '' AND b.t <> '' AND (contains(a.t, b.t) OR contains(b.t, a.t) OR abs(length(a.t) - length(b.t)) <= 3)
 AND a.x <> '' AND b.x <> '' AND (contains(a.x, b.x) OR contains(b.x, a.x))))),
reach(id, r) AS (SELECT id, id FROM books UNION SELECT reach.id, pairs.b FROM reach JOIN pairs ON reach.r = pairs.a),
classes AS (SELECT id, min(r) AS class, count(*) AS size FROM reach GROUP BY id)"""
CLASSES = D.BOOKS + ",\n" + _PAIRS


@query("WITH RECURSIVE " + CLASSES + "\nSELECT id, class, size FROM classes")
def q27_duplicate_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that stand for one book, by chains of links: each one's class (its least id) and how many are in it."""
    return duplicates.classes(D.books(spark, sf_dir))


@query(_W + "SELECT isbn_13, count(*) AS n, arg_max(id, confidence * 10000000 - id) AS best, round(avg(confidence), 6) AS score FROM books GROUP BY isbn_13")
def q27_groups_by_isbn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate groups in their native form: records of one ISBN."""
    return D.books(spark, sf_dir).groupBy("isbn_13").agg(F.count("*").alias("n"), F.max_by("id", F.struct("confidence", -F.col("id"))).alias("best"), F.round(F.avg("confidence"), 6).alias("score"))


@query(_W + """SELECT a.id, count(*) FILTER (b.isbn_13 = a.isbn_13) AS same_isbn, count(*) FILTER (a.authors[1] = b.authors[1] AND abs(length(a.title) - length(b.title)) <= 3) AS similar,
count(*) FILTER (a.authors[1] = b.authors[1] AND abs(length(a.title) - length(b.title)) > 3 AND (contains(lower(a.title), lower(b.title)) OR contains(lower(b.title), lower(a.title)))) AS contained FROM books a LEFT JOIN books b ON a.id <> b.id GROUP BY a.id""")
def q26_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many other records each may duplicate: of one ISBN; of one first author with a title that differs by three characters in
    length at most; or of one first author with a title that holds the other's. Counted by a group, by a window over lengths, and by
    the rarest trigram of the shorter title: pairs of the first two kinds are never made, and equal titles are one row."""
    b = D.books(spark, sf_dir).select("id", "isbn_13", F.lower("title").alias("t"), F.lower(F.get("authors", F.lit(0))).alias("author"))
    n = F.length("t")
    isbn = b.groupBy("isbn_13").agg((F.count("*") - 1).alias("same_isbn"))
    # lengths are few, so counts by length come before the window
    sizes = b.filter("t is not null and author is not null").groupBy("author", n.alias("n")).agg(F.count("*").alias("c"))
    near = sizes.withColumn("near", F.sum("c").over(Window.partitionBy("author").orderBy("n").rangeBetween(-3, 3))).select("author", "n", "near")
    titles = written(duplicates.titles_of(D.books(spark, sf_dir)))
    held = duplicates.holding(titles.select("id", F.col("author").alias("g"), "t"))
    pairs = held.unionByName(held.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(titles.select(F.col("id").alias("b"), F.col("n").alias("k")), "b")
    contained = pairs.groupBy(F.col("a").alias("id")).agg(F.sum("k").alias("contained")).join(titles.select("id", "author", "t"), "id").drop("id")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    rows = b.withColumn("n", n).join(isbn, "isbn_13", "left").join(near, ["author", "n"], "left").join(contained, ["author", "t"], "left")
    return rows.select("id", zero(F.col("same_isbn")).alias("same_isbn"), zero(F.col("near") - 1).alias("similar"), zero(F.col("contained")).alias("contained"))


@query(_W + "SELECT id, CASE WHEN len(authors) = 0 THEN 0.0 WHEN list_contains(authors, 'Supplier#000000001') THEN 1.0 ELSE round(1.0 * len(list_intersect(authors, ['Supplier#000000002', 'Supplier#000000003'])) / len(list_distinct(list_concat(authors, ['Supplier#000000002', 'Supplier#000000003']))), 6) END::DOUBLE AS score FROM books")
def q12_author_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.array(F.lit("Supplier#000000002"), F.lit("Supplier#000000003"))
    score = F.when(F.size("authors") == 0, 0.0).when(F.array_contains("authors", "Supplier#000000001"), 1.0).otherwise(S.jaccard(F.col("authors"), other))
    return D.books(spark, sf_dir).select("id", F.round(score, 6).alias("score"))


_LEX = "(0.4 * len(list_intersect(w, ['red', 'ring', 'economy'])) / 3 + CASE WHEN contains(t, 'ring') THEN 0.35 ELSE 0 END + 0.3 * len(list_intersect(w, ['red', 'ring', 'economy'])) / len(list_distinct(list_concat(w, ['red', 'ring', 'economy']))) + CASE WHEN publisher = 'Brand#1' THEN 0.15 ELSE 0.05 END)"


@query(_W + f"SELECT id, round(least(1.0, {_LEX}), 6)::DOUBLE AS score FROM (SELECT id, publisher, lower(coalesce(title, '')) AS t, list_distinct(string_split(lower(coalesce(title, '')), ' ')) AS w FROM books)")
def q18_lexical_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted overlap, category, keywords and publisher; no threshold."""
    t = F.lower(F.coalesce("title", F.lit("")))
    w, want = F.array_distinct(F.split(t, " ")), F.array(F.lit("red"), F.lit("ring"), F.lit("economy"))
    score = 0.4 * F.size(F.array_intersect(w, want)) / 3 + F.when(t.contains("ring"), 0.35).otherwise(0.0) + 0.3 * S.jaccard(w, want) + F.when(F.col("publisher") == "Brand#1", 0.15).otherwise(0.05)
    return D.books(spark, sf_dir).select("id", F.round(F.least(F.lit(1.0), score), 6).alias("score"))


@query()
def q38_record_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book's answers folded in order of confidence: each new source raises the confidence, 1 at most. The fold runs over one array of at most eight sources."""
    rows = D.source_records(spark, sf_dir).groupBy("book").agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("o"), "source", "confidence"))).alias("a"))
    merged = F.aggregate(F.slice("a", 2, 8), F.get("a", F.lit(0))["confidence"], lambda acc, x: F.least(F.lit(1.0), acc + F.when(x["confidence"] > 0.8, 0.05).otherwise(0.02)))
    return rows.select("book", F.round(merged, 6).alias("confidence"), F.concat(F.get("a", F.lit(0))["source"], F.when(F.size("a") > 1, "+merged").otherwise("")).alias("source"))


_T = TRUTH + r""",
scored AS (SELECT *, least(1.0, 0.2 + tt * 0.3 + ta * 0.3 + tp * 0.15 + ty * 0.05) AS basic,
least(1.0, 0.25 + tt * 0.25 + ta * 0.25 + tp * 0.15 + ty * 0.1 + least(0.02 * """ + _count("low", N.TECHNICAL) + r""", 0.1) + CASE WHEN contains(path, ' - ') AND ta * tt = 1 THEN 0.05 ELSE 0 END) AS enhanced,
CASE WHEN tp = 1 THEN p ELSE """ + _first("low", N.INFERRED) + r""" END AS inferred, """ + _first("low", N.BRAZILIAN) + r""" AS national FROM (
SELECT *, CAST(t <> '' AS INTEGER) AS tt, CAST(a <> '' AS INTEGER) AS ta, CAST(p <> '' AS INTEGER) AS tp, CAST(y <> '' AS INTEGER) AS ty FROM truth)),
judged AS (SELECT *, least(1.0, enhanced + CASE WHEN inferred <> '' AND tp = 0 THEN 0.05 ELSE 0 END + CASE WHEN TRY_CAST(y AS INTEGER) BETWEEN 2000 AND 2025 THEN 0.02 ELSE 0 END) AS smart, CASE WHEN national <> '' THEN national ELSE p END AS house,
CASE WHEN national <> '' THEN 2 ELSE 0 END + CASE WHEN ta = 1 AND """ + _any("lower(a)", N.NAMES) + r""" THEN 1 ELSE 0 END + """ + _count("low", N.PORTUGUESE) + r""" + CASE WHEN regexp_matches(low, '[0-9]+[aª]\s*edi[cç][aã]o') THEN 2 ELSE 0 END AS signs FROM scored)"""


@query(
    _WF + "," + _T + """ SELECT id, t AS title, a AS author, y AS year, unnest(['basic', 'enhanced', 'smart', 'hybrid', 'brazilian']) AS algorithm, unnest([p, p, inferred, inferred, house]) AS publisher,
round(unnest([basic, enhanced, smart, least(1.0, 0.2 * basic + 0.3 * enhanced + 0.5 * smart + 0.05), least(1.0, (0.3 + tt * 0.25 + ta * 0.25 + CASE WHEN house <> '' THEN 0.15 ELSE 0 END + ty * 0.05 + least(0.05 * signs, 0.3)) * CASE WHEN signs = 0 THEN 0.7 ELSE 1 END)]), 6)::DOUBLE AS confidence FROM judged"""
)
def q42_filename_algorithms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five algorithms over each file name, side by side: projections exploded from one scan, no union of scans."""
    rows = D.files(spark, sf_dir)
    rows = rows.select("id", "path", *[c.alias(k) for k, c in N.ground_truth(F.col("path")).items()])
    found = N.filename_algorithms(F.col("path"), {k: F.col(k) for k in ("title", "author", "publisher", "year")})
    each = F.array(*[F.struct(F.lit(n).alias("algorithm"), p.alias("publisher"), F.round(c, 6).alias("confidence")) for n, (p, c) in found.items()])
    return rows.select("id", "title", "author", "year", F.explode(each).alias("x")).select("id", "title", "author", "year", "x.*")


@query(_WF + "," + TRUTH + " SELECT id, t AS title, a AS author, p AS publisher, y AS year FROM truth")
def t9_ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, author, publisher and year by the rules that other readings are measured against."""
    return D.files(spark, sf_dir).select("id", *[c.alias(k) for k, c in N.ground_truth(F.col("path")).items()])


@query(_W + "SELECT id, confidence FROM books WHERE isbn_13 IN ('9780000000170', '9780000000033') OR isbn_10 = '0000000019'")
def z16_update_by_isbn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that an update of some ISBNs touches, by a semi-join on either key, normalized first."""
    keys = spark.createDataFrame([("9780000000170",), ("9780000000033",), ("0000000019",)], "k string")
    b = D.books(spark, sf_dir)
    either = b.select("id", F.explode(F.array("isbn_13", "isbn_10")).alias("k")).join(F.broadcast(keys), "k", "left_semi").select("id").distinct()
    return b.join(either, "id", "left_semi").select("id", "confidence")


@query(_W + "SELECT count(*) AS renamed, round(100.0 * count(*) FILTER (title IS NOT NULL) / count(*), 6)::DOUBLE AS success_rate FROM books")
def z34_batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.books(spark, sf_dir).agg(F.count("*").alias("renamed"), F.round(100.0 * F.count("title") / F.count("*"), 6).alias("success_rate"))


@query(_W + "SELECT round(avg(confidence), 6) AS mean, round(avg(CASE WHEN confidence > 0.5 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS improved, round(avg(CASE WHEN confidence >= 0.8 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS consolidated FROM books")
def a22_iteration_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return D.books(spark, sf_dir).agg(F.round(F.avg("confidence"), 6).alias("mean"), share(F.col("confidence") > 0.5).alias("improved"), share(F.col("confidence") >= 0.8).alias("consolidated"))


@query(_W + "SELECT id, title, rn AS place FROM (SELECT id, title, row_number() OVER (ORDER BY confidence DESC, id) AS rn FROM books) WHERE rn <= 15")
def l1_stable_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 15 by score, ties by id: a top-k before the window, so that one task never sorts all rows."""
    top = D.books(spark, sf_dir).orderBy(F.desc("confidence"), "id").limit(15)
    return top.select("id", "title", F.row_number().over(Window.orderBy(F.desc("confidence"), "id")).cast("long").alias("place"))


@query(_W + "SELECT id FROM books WHERE isbn_13 NOT IN (SELECT isbn_13 FROM books WHERE confidence >= 0.5)")
def j6_retry_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = D.books(spark, sf_dir)
    return b.join(b.filter("confidence >= 0.5").select("isbn_13"), "isbn_13", "left_anti").select("id")


@query(_W + "SELECT id, CASE WHEN id % 7 <> 0 THEN true ELSE false END AS acceptable FROM books")
def z4_answer_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer is refused if it names ISBNs and none is a variant of the one asked for."""
    named = F.when(F.col("id") % 7 == 0, F.array(F.lit("9781111111113"))).otherwise(F.array("isbn_13", "isbn_10"))
    return D.books(spark, sf_dir).select("id", ((F.size(named) == 0) | F.exists(named, lambda x: isbn.is_variant(F.col("isbn_13"), x))).alias("acceptable"))


@query(_WF + "SELECT path FROM files WHERE title IS NULL")
def f3_rows_to_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.files(spark, sf_dir).filter(C.is_missing(F.col("title"))).select("path")

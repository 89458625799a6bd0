"""Text queries (inventory 2.4) and page sources (2.1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.sources import derived as D

from .registry import query

_W = D.over(D.BOOKS)
_WF = D.over(D.FILES)
_WQ = D.over(D.SEARCH_QUERIES)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.read(spark, sf_dir, "documents")


_ASCII_SPACE = "[ \\t\\n\\x0B\\f\\r]+"


@query(r"""SELECT doc_id, md5(trim(regexp_replace(translate(text, '‘’“”–—', chr(39) || chr(39) || '""--'), '\s+', ' ', 'g'))) AS h FROM documents""")
def t1_normalize_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.spaces(F.col("text")).cast("binary")).alias("h"))


_CMP = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({_CMP.format('text')}) AS h FROM documents")
def t2_compare_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.compare_form(F.col("text")).cast("binary")).alias("h"))


@query(f"SELECT doc_id, md5(translate(text, '{T.ACCENTED}', '{T.PLAIN}')) AS h FROM documents")
def t3_strip_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.strip_accents(F.col("text")).cast("binary")).alias("h"))


@query("SELECT doc_id, CASE WHEN length(f) <= 120 THEN f ELSE regexp_replace(substr(f, 1, 120), ' [^ ]*$', '') END AS trimmed FROM (SELECT doc_id, array_to_string(string_split(text, ' ')[1:14], ' ') AS f FROM documents)")
def t4_trim_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.trimmed(F.col("text"), "title").alias("trimmed"))


_STEM = r"trim(regexp_replace(regexp_replace(replace(path, '_', ' '), '\.[A-Za-z0-9]+$', ''), '\(?((?:19|20)[0-9]{2})\)?', '', 'g'))"


@query(
    _WF + f"""SELECT id, CASE WHEN strpos(s, ' - ') > 0 THEN trim(substr(s, 1, CAST(strpos(s, ' - ') AS BIGINT) - 1)) END AS author,
CASE WHEN strpos(s, ' - ') > 0 THEN trim(substr(s, CAST(strpos(s, ' - ') AS BIGINT) + 3)) ELSE s END AS title, nullif(regexp_extract(path, '((?:19|20)[0-9]{{2}})', 1), '') AS year FROM (SELECT id, path, {_STEM} AS s FROM files)"""
)
def t7_filename_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    author, title, year = T.from_filename(F.col("path"))
    return D.files(spark, sf_dir).select("id", author.alias("author"), title.alias("title"), year.alias("year"))


@query(_WF + "SELECT id, coalesce(title, 'from file') AS title, CASE WHEN len(authors) = 0 THEN ['from file'] ELSE authors END AS authors FROM files")
def t8_fallback_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.files(spark, sf_dir).select("id", F.coalesce("title", F.lit("from file")).alias("title"), F.when(F.size("authors") == 0, F.array(F.lit("from file"))).otherwise(F.col("authors")).alias("authors"))


@query(_WF + "SELECT id, round(greatest(0.1, least(0.8, 0.1 + CASE WHEN strpos(path, ' - ') > 0 THEN 0.3 ELSE 0 END + CASE WHEN regexp_matches(path, '(19|20)[0-9]{2}') THEN 0.2 ELSE 0 END + 0.2)), 6)::DOUBLE AS confidence FROM files")
def t10_guess_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.files(spark, sf_dir).select("id", F.round(T.guess_confidence(F.col("path")), 6).alias("confidence"))


_SCORE = r"""1.0 + CASE WHEN i < 6 THEN 0.6 ELSE 0 END + CASE WHEN t = upper(t) THEN 0.2 ELSE 0 END + CASE WHEN len(w) >= 3 THEN 0.3 ELSE 0 END + CASE WHEN length(t) BETWEEN 10 AND 80 THEN 0.1 ELSE 0 END - CASE WHEN length(t) > 100 THEN 0.1 ELSE 0 END
- CASE WHEN t LIKE '%.' THEN 0.25 ELSE 0 END + CASE WHEN len(list_filter(w, lambda x: regexp_matches(x, '^\p{Lu}'))) >= 0.6 * len(w) THEN 0.4 ELSE 0 END - CASE WHEN regexp_matches(t, '[:-]$') THEN 0.2 ELSE 0 END"""


@query(
    rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents), s AS (SELECT doc_id, i, trim(line) AS t, regexp_split_to_array(trim(line), '\s+') AS w FROM l WHERE i <= 200),
r AS (SELECT doc_id, i, t, round({_SCORE}, 6)::DOUBLE AS score FROM s WHERE length(t) BETWEEN 5 AND 140) SELECT doc_id, t AS title, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS rn FROM r) WHERE rn = 1"""
)
def t19_title_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best title line of each document; the first of equal ones. max_by needs no window and combines before the shuffle."""
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).filter("i <= 200")
    scored = lines.select("doc_id", "i", F.trim("line").alias("t"), F.round(T.title_score(F.col("line"), F.col("i")), 6).alias("score")).filter("score is not null")
    best = F.max(F.struct(F.col("score"), (-F.col("i")).alias("o"), F.col("t"))).alias("b")
    return scored.groupBy("doc_id").agg(best).select("doc_id", F.col("b.t").alias("title"), F.col("b.score").alias("score"))


@query("SELECT doc_id, coalesce(nullif(regexp_extract(text, '(?i)(?:copyright|©)[^0-9]{0,20}((?:19|20)[0-9]{2})', 1), ''), nullif(regexp_extract(text, '(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)', 1), '')) AS year FROM documents")
def t23_year_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = lambda rx: F.nullif(F.regexp_extract("text", rx, 1), F.lit(""))
    return _docs(spark, sf_dir).select("doc_id", F.coalesce(x("(?i)(?:copyright|©)[^0-9]{0,20}((?:19|20)[0-9]{2})"), x("(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)")).alias("year"))


_EXACT = "CASE " + " ".join(f"WHEN upper(trim(publisher)) = '{r.replace(chr(39), chr(39) * 2)}' THEN '{n.replace(chr(39), chr(39) * 2)}'" for r, n in T.PUBLISHERS) + " WHEN upper(trim(publisher)) IN ('', 'UNKNOWN') THEN '' ELSE trim(publisher) END"
_HELD = "CASE " + " ".join(f"WHEN contains(upper(trim(publisher)), '{r.replace(chr(39), chr(39) * 2)}') THEN '{n.replace(chr(39), chr(39) * 2)}'" for r, n in T.PUBLISHERS) + " WHEN upper(trim(publisher)) IN ('', 'UNKNOWN') THEN '' ELSE trim(publisher) END"


@query(_W + f"SELECT id, {_EXACT} AS publisher FROM books")
def t29_publisher_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.books(spark, sf_dir).select("id", T.canonical_publisher(F.col("publisher")).alias("publisher"))


@query(_W + f"SELECT id, {_HELD} AS publisher FROM books")
def t30_publisher_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.books(spark, sf_dir).select("id", T.canonical_publisher(F.col("publisher"), contains=True).alias("publisher"))


@query(_W + f"SELECT id, publisher AS old, {_EXACT} AS new FROM books WHERE publisher <> {_EXACT}")
def m7_publisher_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = T.canonical_publisher(F.col("publisher"))
    return D.books(spark, sf_dir).select("id", F.col("publisher").alias("old"), new.alias("new")).filter("old <> new")


@query(_W + "SELECT id, array_to_string(list_filter([trim(x) FOR x IN authors], lambda a: a <> ''), '; ') AS authors FROM books")
def t32_author_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.books(spark, sf_dir).select("id", F.array_join(F.array_distinct(F.filter(F.transform("authors", lambda a: F.trim(a)), lambda a: a != "")), "; ").alias("authors"))


_NAMES = ("Ana Maria Silva", "Knuth", "Donald Ervin Knuth", "Jane Doe")


@query(_W + "SELECT id, CASE id % 4 WHEN 0 THEN 'Ana Maria Silva|Ana Silva|Silva, Ana|A. M. Silva|AM Silva|Silva' WHEN 1 THEN 'Knuth' WHEN 2 THEN 'Donald Ervin Knuth|Donald Knuth|Knuth, Donald|D. E. Knuth|DE Knuth|Knuth' ELSE 'Jane Doe|Doe, Jane|J. Doe|J Doe|Doe' END AS variants FROM books")
def t33_author_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.get(F.array(*map(F.lit, _NAMES)), (F.col("id") % 4).cast("int"))
    return D.books(spark, sf_dir).select("id", F.array_join(T.name_variants(name), "|").alias("variants"))


_STOPS = ", ".join(f"'{w}'" for w in T.STOP)
_TOK = rf"list_filter(regexp_split_to_array(lower({{0}}), '[^\p{{{{L}}}}\p{{{{N}}}}]+'), lambda w: length(w) >= 2 AND w NOT IN ({_STOPS}))".replace("{{{{", "{{").replace("}}}}", "}}")


@query(f"SELECT doc_id, len({_TOK.format('text')}) AS n, md5(array_to_string({_TOK.format('text')}, ' ')) AS h FROM documents")
def t35_index_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.tokens(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ").cast("binary")).alias("h"))


@query(_WQ + r"SELECT item_id, array_to_string([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))], '|') AS bigrams FROM (SELECT item_id, string_split(q, ' ') AS w FROM search_queries)")
def t36_word_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.search_queries(spark, sf_dir).select("item_id", F.array_join(T.ngrams(F.split("q", " "), 2), "|").alias("bigrams"))


@query(_WQ + r"SELECT item_id, regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace('please find ' || q || ' pdf', '(?i)\b(please|find|search for|looking for|book about|livro sobre)\b', ' ', 'g'), '(?i)\b(pdf|epub|mobi|download|free)\b', ' ', 'g'), '[\[\]{}]', ' ', 'g'), '\s+', ' ', 'g')), '^[\s.,;:!?-]+|[\s.,;:!?-]+$', '', 'g') AS cleaned FROM search_queries")
def t37_query_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.search_queries(spark, sf_dir).select("item_id", T.cleaned_query(F.concat(F.lit("please find "), "q", F.lit(" pdf"))).alias("cleaned"))


_TYPED = "replace(replace(coalesce(title, ''), 'ring', 'rign'), 'small', 'smal')"
_CORRECT = "array_to_string(list_transform(string_split({0}, ' '), lambda w: coalesce(map_from_entries([" + ", ".join(f"('{a}', '{b}')" for a, b in T.TYPOS.items()) + "])[lower(w)], w)), ' ')"


@query(_W + f"SELECT id, {_CORRECT.format(_TYPED)} AS corrected FROM books")
def t38_typo_suggestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles as a hasty reader types them, word by word set right by the dictionary."""
    typed = F.replace(F.replace(F.coalesce("title", F.lit("")), F.lit("ring"), F.lit("rign")), F.lit("small"), F.lit("smal"))
    return D.books(spark, sf_dir).select("id", T.corrected(typed).alias("corrected"))


@query(_WQ + r"""SELECT item_id, round(0.2 * least(length(q) / 100.0, 1.0) + 0.3 * least(len(regexp_split_to_array(trim(q), '\s+')) / 20.0, 1.0) + 0.2 * least(len(regexp_extract_all(q, '[^\p{L}\p{N}\s]')) / 10.0, 1.0) + CASE WHEN regexp_matches(q, '[0-9]{9}') THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(q, '["'']') THEN 0.05 ELSE 0 END + CASE WHEN regexp_matches(q, '(?i)\b(and|or)\b') THEN 0.1 ELSE 0 END, 6)::DOUBLE AS complexity FROM search_queries""")
def t39_query_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.search_queries(spark, sf_dir).select("item_id", F.round(T.query_complexity(F.col("q")), 6).alias("complexity"))


_N = {k: rf"len(list_intersect(w, [{', '.join(repr(x) for x in v)}]))" for k, v in T.FUNCTION_WORDS.items()}
_TIES = " + ".join(f"CAST({k}_n = m AS INTEGER)" for k in _N)


@query(
    rf"WITH w AS (SELECT doc_id, list_distinct(regexp_split_to_array(lower(text), '[^\p{{L}}]+')) AS w FROM documents), n AS (SELECT doc_id, " + ", ".join(f"{x} AS {k}_n" for k, x in _N.items()) + " FROM w), g AS (SELECT *, greatest(" + ", ".join(f"{k}_n" for k in _N) + ") AS m FROM n) SELECT doc_id, CASE WHEN m = 0 OR " + f"({_TIES}) > 1 THEN 'unknown' " + " ".join(f"WHEN {k}_n = m THEN '{k}'" for k in _N) + " END AS language FROM g"
)
def t40_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.language(F.col("text")).alias("language"))


@query(D.over(D.ASKED) + """SELECT id, CASE WHEN regexp_matches(q, '[0-9]{9}[0-9Xx]') THEN 'isbn' WHEN regexp_matches(q, '\\bby [A-Z]') THEN 'author' WHEN regexp_matches(q, '"[^"]+"') THEN 'title' ELSE 'text' END AS kind FROM asked""")
def t42_query_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """isbn, then author, then title, else text."""
    q = F.col("q")
    return D.asked(spark, sf_dir).select("id", F.when(q.rlike("[0-9]{9}[0-9Xx]"), "isbn").when(q.rlike(r"\bby [A-Z]"), "author").when(q.rlike('"[^"]+"'), "title").otherwise("text").alias("kind"))


@query(_W + "SELECT title FROM (SELECT DISTINCT title FROM books WHERE title ILIKE '%red b%') ORDER BY length(title), title LIMIT 5")
def t44_autocomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.books(spark, sf_dir).filter(F.col("title").ilike("%red b%")).select("title").distinct().orderBy(F.length("title"), "title").limit(5)


@query(_WF + r"""SELECT id, substr(trim(regexp_replace(regexp_replace('a/b: ' || path || '?*', '[\\/:*?"<>|]', '', 'g'), '\s+', ' ', 'g')), 1, 150) AS name FROM files""")
def t45_sanitize_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.files(spark, sf_dir).select("id", T.sanitized(F.concat(F.lit("a/b: "), "path", F.lit("?*"))).alias("name"))


@query(_W + "SELECT id, coalesce(title, '') || ' - ' || coalesce(authors[1], '') || ' (' || year || ') [' || isbn_13 || ']' AS name FROM books")
def t46_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.books(spark, sf_dir).select("id", T.formatted("{title} - {author} ({year}) [{isbn}]", title=F.col("title"), author=F.get("authors", F.lit(0)), year=F.col("year"), isbn=F.col("isbn_13")).alias("name"))


@query(_W + "SELECT id, array_to_string(list_filter([replace(publisher, ' ', '_'), year, replace(title, ' ', '_'), replace(array_to_string(authors[1:2], '_'), ' ', '_'), isbn_13], lambda x: x IS NOT NULL AND x <> ''), '_') AS name FROM books")
def t48_name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    under = lambda c: F.replace(c, F.lit(" "), F.lit("_"))
    parts = F.array(under(F.col("publisher")), F.col("year"), under(F.col("title")), under(F.array_join(F.slice("authors", 1, 2), "_")), F.col("isbn_13"))
    return D.books(spark, sf_dir).select("id", F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), "_").alias("name"))


@query(_W + "SELECT id, CASE WHEN len(authors) > 1 THEN authors[1] || ' et al - ' WHEN len(authors) = 1 THEN authors[1] || ' - ' ELSE '' END || coalesce(title, 'Unknown') || ' (' || year || ').' || ext AS name FROM books")
def t49_et_al_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.get("authors", F.lit(0))
    head = F.when(F.size("authors") > 1, F.concat(first, F.lit(" et al - "))).when(F.size("authors") == 1, F.concat(first, F.lit(" - "))).otherwise("")
    return D.books(spark, sf_dir).select("id", F.concat(head, F.coalesce("title", F.lit("Unknown")), F.lit(" ("), "year", F.lit(")."), "ext").alias("name"))


@query("SELECT doc_id, md5(lower(source)) AS key, sha256(text) AS content FROM documents")
def t51_hash_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(F.lower("source").cast("binary")).alias("key"), F.sha2(F.col("text").cast("binary"), 256).alias("content"))


_TITLE, _H1 = "(?is)<title[^>]*>(.*?)</title>", "(?is)<h1[^>]*>(.*?)</h1>"


@query(f"SELECT page_id, regexp_extract(html, '{_TITLE}', 1) AS title, regexp_extract(html, '{_H1}', 1) AS heading FROM pages")
def s7_page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", _TITLE, 1).alias("title"), F.regexp_extract("html", _H1, 1).alias("heading"))


@query(r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\s+', ' ', 'g'))) AS h FROM pages")
def z3_strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.read(spark, sf_dir, "pages").select("page_id", F.md5(F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]+>", ""), r"\s+", " ")).cast("binary")).alias("h"))


@query(_W + "SELECT id, array_to_string(list_filter([substr(title, 1, 50), substr(array_to_string(authors[1:2], ', '), 1, 30), year, isbn_13], lambda x: x IS NOT NULL AND x <> ''), ' - ') AS preview FROM books")
def z14_preview_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array(F.substring("title", 1, 50), F.substring(F.array_join(F.slice("authors", 1, 2), ", "), 1, 30), F.col("year"), F.col("isbn_13"))
    return D.books(spark, sf_dir).select("id", F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), " - ").alias("preview"))

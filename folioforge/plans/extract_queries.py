"""Further extraction, scoring and merge queries (inventory 2.1, 2.4, 2.5, 2.6, 2.14)."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import filenames as N
from folioforge.functions import isbn
from folioforge.functions import similarity as S
from folioforge.functions import text as T
from folioforge.operators import ranking as R
from folioforge.sources import derived as D

from .registry import query
from .search_queries import _WR, _ranked
from .source_queries import TRUTH

_W = D.over(D.BOOKS)
_WF = D.over(D.FILES)
_WS = D.over(D.SOURCE_RECORDS)
_WQ = D.over(D.SEARCH_QUERIES)


def _on(c: Column, w: float) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0)


#: Titles as a bad scan gives them: vowels doubled, and words torn before "ing" and "edg".
_TORN = r"regexp_replace(regexp_replace(coalesce(title, ''), '([aeiou])', '\1\1', 'g'), '(iing|iidg|eedg)', ' \1', 'g')"


def _torn() -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce("title", F.lit("")), "([aeiou])", "$1$1"), "(iing|iidg|eedg)", " $1")


@query()
def t5_collapse_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubled letters collapse; a lower-case fragment is glued to a word of four letters or more, by a fold over the words."""
    t = F.regexp_replace(_torn(), r"(?i)([a-z])\1+", "$1")
    words = F.split(t, " ")
    glue = lambda a, w: F.when((F.length(a) > 0) & w.rlike("^[a-z]{2,4}$") & (F.length(F.substring_index(a, " ", -1)) >= 4), F.concat(a, w)).when(a == "", w).otherwise(F.concat(a, F.lit(" "), w))
    return D.books(spark, sf_dir).select("id", F.aggregate(words, F.lit(""), glue).alias("collapsed"))


@query()
def t6_artifact_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of the cleaned text, and whether it looked broken."""
    from folioforge.operators import quality as Q

    t = F.col("text")
    cleaned = F.regexp_replace(T.spaces(t), r"(?i)([a-z])\1+", "$1")
    return D.read(spark, sf_dir, "documents").select("doc_id", F.md5(cleaned.cast("binary")).alias("h"), (Q.many_singles(t) | Q.repeated_letters(t)).alias("flagged"))


_FLAGS = "(CAST(strpos(path, ' - ') > 0 AS INTEGER) + CAST(regexp_matches(path, '(19|20)[0-9]{2}') AS INTEGER) + CAST(length(path) > 20 AS INTEGER) + CAST(regexp_matches(path, '^[A-Z]') AS INTEGER) + 1)"


@query(_WF + f"SELECT id, round(CASE WHEN regexp_matches(path, '^.+ - .+ [(][0-9]{{4}}[)]') THEN 0.15 WHEN strpos(path, ' - ') > 0 THEN 0.12 WHEN strpos(path, '_') > 0 THEN 0.1 ELSE 0.08 END * (0.5 + 0.5 * {_FLAGS} / 5), 6)::DOUBLE AS boost FROM files")
def t11_filename_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boost of the first pattern that fits, scaled by five quality flags."""
    p = F.col("path")
    flags = (F.instr(p, " - ") > 0).cast("int") + p.rlike("(19|20)[0-9]{2}").cast("int") + (F.length(p) > 20).cast("int") + p.rlike("^[A-Z]").cast("int") + 1
    boost = F.when(p.rlike("^.+ - .+ [(][0-9]{4}[)]"), 0.15).when(F.instr(p, " - ") > 0, 0.12).when(F.instr(p, "_") > 0, 0.1).otherwise(0.08)
    return D.files(spark, sf_dir).select("id", F.round(boost * (0.5 + 0.5 * flags / 5), 6).alias("boost"))


_CLUES = {"Ring House": ("ring", "red ring volume"), "Bolt Press": ("bolt", "blue bolt edition")}


@query(_W + "SELECT id, CASE WHEN a = 0 AND b = 0 THEN NULL WHEN a >= b THEN 'Ring House' ELSE 'Bolt Press' END AS publisher FROM (SELECT id, coalesce(CAST(contains(title, 'ring') AS INTEGER) + 2 * CAST(contains(title, 'red ring volume') AS INTEGER), 0) AS a, coalesce(CAST(contains(title, 'bolt') AS INTEGER) + 2 * CAST(contains(title, 'blue bolt edition') AS INTEGER), 0) AS b FROM books)")
def t12_publisher_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The publisher of the greatest clue weight: long clues weigh 2, others 1; the first of equal ones."""
    has = lambda w: F.coalesce(F.col("title").contains(w), F.lit(False)).cast("int") * (2 if len(w) > 10 else 1)
    best = F.array_max(F.array(*[F.struct(sum((has(w) for w in v), F.lit(0)).alias("w"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, (k, v) in enumerate(_CLUES.items())]))
    return D.books(spark, sf_dir).select("id", F.when(best["w"] > 0, best["k"]).alias("publisher"))


@query(_WF + "SELECT id, coalesce(title, 'file ' || CAST(id AS VARCHAR)) AS title, CASE WHEN publisher = 'Unknown' THEN 'from file' ELSE publisher END AS publisher, coalesce(nullif(confidence, 0.0), 0.6)::DOUBLE AS confidence FROM files")
def t18_fill_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.files(spark, sf_dir).select("id", F.coalesce("title", F.concat(F.lit("file "), F.col("id").cast("string"))).alias("title"), F.when(F.col("publisher") == "Unknown", "from file").otherwise(F.col("publisher")).alias("publisher"), F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(0.6)).alias("confidence"))


_NAMED = D._person("coalesce(title, 'no title')") + " || ' - The Guide of ' || year || '_' || " + D._person("source || ' Author'") + " || ' - ' || path"


@query(_WF + f"""SELECT id, array_to_string(list_filter(list_transform(regexp_split_to_array({_NAMED}, '[-_]'), lambda p: trim(p)),
lambda p: len(string_split(p, ' ')) BETWEEN 2 AND 4 AND NOT regexp_matches(p, '[0-9]') AND NOT regexp_matches(lower(p), '\\b(the|guide|edition)\\b'))[1:2], '|') AS authors FROM files""")
def t21_authors_from_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a file name that read as names: two to four words, no digit, no stop word; two at most."""
    person = lambda s: F.initcap(F.array_join(F.slice(F.split(s, " "), 1, 2), " "))
    name = F.concat(person(F.coalesce("title", F.lit("no title"))), F.lit(" - The Guide of "), "year", F.lit("_"), person(F.concat("source", F.lit(" Author"))), F.lit(" - "), "path")
    parts = F.transform(F.split(name, "[-_]"), lambda x: F.trim(x))
    good = F.filter(parts, lambda p: F.size(F.split(p, " ")).between(2, 4) & ~p.rlike("[0-9]") & ~F.lower(p).rlike(r"\b(the|guide|edition)\b"))
    return D.files(spark, sf_dir).select("id", F.array_join(F.slice(good, 1, 2), "|").alias("authors"))


@query()
def t25_title_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first window of one to three lines, of the first twelve, that reads as a title."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    starts = F.sequence(F.lit(1), F.least(F.lit(12), F.greatest(F.size(lines), F.lit(1))))
    windows = F.flatten(F.transform(starts, lambda i: F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.array_join(F.slice(lines, i, n), " "))))
    letters = lambda w: F.regexp_count(w, F.lit(r"\p{L}"))
    good = F.filter(windows, lambda w: F.length(w).between(6, 160) & (letters(w) >= 6) & (letters(w) >= 0.35 * F.length(w)))
    return D.read(spark, sf_dir, "documents").select("doc_id", F.get(good, F.lit(0)).alias("title"))


@query(r"""SELECT doc_id, md5(array_to_string(list_transform(string_split(regexp_replace(translate(text, '•·', '**'), '[^[:print:]\n]', '', 'g'), ' '),
lambda w: CASE WHEN regexp_matches(w, '^[0-9OIlS-]{9,}$') AND regexp_matches(w, '[0-9]') THEN translate(w, 'OIlS', '0115') ELSE w END), ' ')) AS h FROM documents""")
def t27_printable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of the cleaned whole text: characters of PDF fonts mapped, others that can't be printed dropped, letters read for digits set right in long tokens."""
    cleaned = F.regexp_replace(F.translate("text", "•·", "**"), r"[^\p{Print}\n]", "")
    token = lambda w: F.when(w.rlike("^[0-9OIlS-]{9,}$") & w.rlike("[0-9]"), F.translate(w, "OIlS", "0115")).otherwise(w)
    cleaned = F.array_join(F.transform(F.split(cleaned, " "), token), " ")
    return D.read(spark, sf_dir, "documents").select("doc_id", F.md5(cleaned.cast("binary")).alias("h"))


_WHOLE = functools.reduce(lambda x, kv: f"replace({x}, '{kv[0]}', '{kv[1]}')", N.WHOLE.items(), "text")


@query(f"SELECT doc_id, md5(regexp_replace(strip_accents({_WHOLE}), '[^\\x00-\\x7F]', '', 'g')) AS h FROM documents")
def t28_ascii_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of the whole text, its Latin letters folded to ASCII; other letters go."""
    folded = F.regexp_replace(N.folded(F.col("text")), r"[^\x00-\x7F]", "")
    return D.read(spark, sf_dir, "documents").select("doc_id", F.md5(folded.cast("binary")).alias("h"))


@query(_W + "SELECT id, CASE upper(trim(publisher)) " + " ".join(f"WHEN '{r.replace(chr(39), chr(39) * 2)}' THEN '{n.replace(chr(39), chr(39) * 2)}'" for r, n in T.PUBLISHERS) + " END AS publisher FROM books")
def t31_publisher_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact lookup in a map; null where there is none."""
    names = F.create_map(*[F.lit(x) for pair in T.PUBLISHERS for x in pair])
    return D.books(spark, sf_dir).select("id", F.try_element_at(names, F.upper(F.trim("publisher"))).alias("publisher"))


#: Abbreviations that search tokens spell out.
_SHORT = {"js": "javascript", "ml": "learning", "db": "database"}


_SHORT_SQL = "map_from_entries([" + ", ".join(f"('{a}', '{b}')" for a, b in _SHORT.items()) + "])"
_STOP_SQL = ", ".join(f"'{w}'" for w in T.STOP)


@query(D.over(D.ASKED) + f"""SELECT id, array_to_string(list_filter(list_transform(regexp_split_to_array(lower(q), '[^\\w-]+'), lambda w: coalesce({_SHORT_SQL}[w], w)), lambda w: length(w) > 2 AND w NOT IN ({_STOP_SQL})), ' ') AS tokens FROM asked""")
def t34_search_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower case, abbreviations spelled out, stop words and short words dropped."""
    known = F.create_map(*[F.lit(x) for pair in _SHORT.items() for x in pair])
    words = F.transform(F.split(F.lower("q"), r"[^\w-]+"), lambda w: F.coalesce(F.try_element_at(known, w), w))
    return D.asked(spark, sf_dir).select("id", F.array_join(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*T.STOP)), " ").alias("tokens"))


@query(D.over(D.ASKED) + "SELECT id, array_to_string(list_sort(list_distinct(regexp_extract_all(q, '(?:by|author:) ([A-Z][a-z]+ [A-Z][a-z]+)', 1)))[1:3], '|') AS people FROM asked")
def t41_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalized runs after an indicator, sorted, three at most."""
    found = F.regexp_extract_all("q", F.lit(r"(?:by|author:) ([A-Z][a-z]+ [A-Z][a-z]+)"), F.lit(1))
    return D.asked(spark, sf_dir).select("id", F.array_join(F.slice(F.array_sort(F.array_distinct(found)), 1, 3), "|").alias("people"))


@query(D.over(D.ASKED) + """SELECT id, round(CASE WHEN len(p) > 0 THEN list_avg(p) ELSE 0.1 END, 6)::DOUBLE AS confidence FROM (SELECT id, list_filter([CASE WHEN regexp_matches(q, '[0-9]{10}') THEN 0.95::DOUBLE END,
CASE WHEN len(n) > 0 THEN least(0.9::DOUBLE, 0.3::DOUBLE + 0.2::DOUBLE * list_avg(list_transform(n, lambda x: len(string_split(x, ' '))))) END, CASE WHEN regexp_matches(q, '"[^"]+"') THEN 0.7::DOUBLE END], lambda x: x IS NOT NULL) AS p
FROM (SELECT id, q, regexp_extract_all(q, 'by ([A-Z][a-z]+(?: [A-Z][a-z]+)*)', 1) AS n FROM asked))""")
def t43_query_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISBN 0.95; authors min(0.9, 0.3 + 0.2 words of a name on average); title 0.7; nothing 0.1; else the mean of what was found."""
    q = F.col("q")
    names = F.regexp_extract_all(q, F.lit("by ([A-Z][a-z]+(?: [A-Z][a-z]+)*)"), F.lit(1))
    words = F.aggregate(names, F.lit(0), lambda a, x: a + F.size(F.split(x, " "))) / F.size(names)
    parts = F.array_compact(F.array(F.when(q.rlike("[0-9]{10}"), 0.95), F.when(F.size(names) > 0, F.least(F.lit(0.9), 0.3 + 0.2 * words)), F.when(q.rlike('"[^"]+"'), 0.7)))
    mean = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts)
    return D.asked(spark, sf_dir).select("id", F.round(F.when(F.size(parts) > 0, mean).otherwise(0.1), 6).alias("confidence"))


_CUT = "CASE WHEN length(t) <= 50 THEN t ELSE regexp_replace(substr(t, 1, 50), '_[^_]*$', '') END"


@query(_W + f"SELECT id, {_CUT} || '_' || replace(array_to_string(authors[1:2], '_'), ' ', '_') || '_' || year || '.' || ext AS name FROM (SELECT *, replace(coalesce(title, 'untitled') || ' of the great collection of catalogues', ' ', '_') AS t FROM books)")
def t47_suggest_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.translate(F.concat(F.coalesce("title", F.lit("untitled")), F.lit(" of the great collection of catalogues")), " ", "_")
    cut = F.when(F.length(t) <= 50, t).otherwise(F.regexp_replace(F.substring(t, 1, 50), "_[^_]*$", ""))
    return D.books(spark, sf_dir).select("id", F.concat(cut, F.lit("_"), F.translate(F.array_join(F.slice("authors", 1, 2), "_"), " ", "_"), F.lit("_"), "year", F.lit("."), "ext").alias("name"))


@query(_W + "SELECT id, translate(isbn_raw, 'OIlS', '0115') AS fixed FROM books")
def t53_char_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.books(spark, sf_dir).select("id", F.translate("isbn_raw", "OIlS", "0115").alias("fixed"))


def isbn_ranker(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """Exact hits first; what they miss (left anti) is repaired and looked up again, at 0.85."""
    asked, known = queries.select("query", "isbn_raw"), catalog.select("id", F.col("isbn_13").alias("key"))
    exact = asked.select("query", isbn.normal13(F.col("isbn_raw")).alias("key")).join(known, "key").select("query", "id", F.lit(1.0).alias("score"))
    left = asked.join(exact.select("query"), "query", "left_anti")
    fixed = left.select("query", F.explode(isbn.repaired(F.col("isbn_raw"))[0]).alias("key")).join(known, "key").select("query", "id", F.lit(0.85).alias("score")).distinct()
    return exact.unionByName(fixed)


@query(_W + "SELECT a.id AS query, b.id AS id, CASE WHEN a.isbn_raw = a.isbn_13 THEN 1.0 ELSE 0.85 END::DOUBLE AS score FROM books a JOIN books b ON b.isbn_13 = a.isbn_13 AND a.id % 7 <> 0 WHERE a.id % 10 IN (0, 1)")
def q7_isbn_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = D.books(spark, sf_dir)
    return isbn_ranker(b.filter("id % 10 in (0, 1)").withColumn("query", F.col("id")), b)


_TITLES = "list_distinct(string_split(lower(coalesce(title, '')), ' '))"


_PARTS = """tt AS (SELECT id, 't' AS kind, unnest(string_split(lower(title), ' ')) AS term FROM books WHERE title IS NOT NULL UNION ALL SELECT id, 'a', unnest(list_transform(authors, lambda x: lower(x))) FROM books
 UNION ALL SELECT id, 'c', unnest(string_split(lower(publisher || ' ' || year || ' ' || ext), ' ')) FROM books),
tc AS (SELECT id, kind, term, count(*) AS n FROM tt GROUP BY ALL), ttf AS (SELECT id, kind, term, n / sum(n) OVER (PARTITION BY id, kind) AS tf FROM tc), total AS (SELECT count(*) AS n FROM books),
tidf AS (SELECT kind, term, CASE WHEN ln((SELECT n FROM total) / count(*)) > 0 THEN ln((SELECT n FROM total) / count(*)) ELSE 0.1 END AS idf FROM tc GROUP BY kind, term),
tw AS (SELECT id, kind, term, tf * idf AS w FROM ttf JOIN tidf USING (kind, term)), tn AS (SELECT id, kind, sqrt(sum(w * w)) AS norm FROM tw GROUP BY id, kind),
tu AS (SELECT id, kind, term, w / norm AS u FROM tw JOIN tn USING (id, kind))"""


@query(
    _W + "," + _PARTS + """ SELECT query, id, round(score, 6)::DOUBLE AS score FROM (SELECT a.id AS query, b.id, sum(a.u * b.u * CASE kind WHEN 't' THEN 0.6 WHEN 'a' THEN 0.3 ELSE 0.1 END) AS score
FROM tu a JOIN tu b USING (kind, term) WHERE a.id % 50 = 0 GROUP BY a.id, b.id) WHERE score >= 0.1"""
)
def q11_semantic_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each query, a book whose id is divisible by 50, the books that score 0.1 or more: 0.6 title, 0.3 authors, 0.1 other content, each by the cosine of TF-IDF vectors."""
    b = D.books(spark, sf_dir)
    parts = {
        "title": (F.when(F.col("title").isNotNull(), F.split(F.lower("title"), " ")).otherwise(F.array().cast("array<string>")), 0.6),
        "author": (F.transform("authors", F.lower), 0.3),
        "content": (F.split(F.lower(F.concat_ws(" ", "publisher", "year", "ext")), " "), 0.1),
    }
    found = R.weighted_search(b.filter("id % 50 = 0"), b, parts, "id", "id")
    return found.select("query", "id", F.round("score", 6).alias("score"))


_STRICT = "SELECT id, t, a, p, y, lower(coalesce(title, '')) AS et, lower(coalesce(authors[1], '')) AS ea, lower(publisher) AS ep, lower(t) AS xt, lower(a) AS xa, lower(p) AS xp, year FROM truth JOIN (SELECT id, title, authors, publisher, year FROM books) USING (id)"
_CLEAN = "trim(regexp_replace(regexp_replace({}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_OVER = "len(list_intersect(list_distinct(string_split({0}, ' ')), list_distinct(string_split({1}, ' ')))) / len(list_distinct(list_concat(string_split({0}, ' '), string_split({1}, ' '))))"


@query(
    D.over(D.FILES) + "," + TRUTH + f""", strict AS (SELECT id, y, year, {_CLEAN.format('et')} AS et, {_CLEAN.format('ea')} AS ea, {_CLEAN.format('ep')} AS ep, {_CLEAN.format('xt')} AS xt, {_CLEAN.format('xa')} AS xa, {_CLEAN.format('xp')} AS xp FROM ({_STRICT}))
SELECT id, round(CASE WHEN xt = '' OR et = '' THEN 0 WHEN xt = et THEN 1 WHEN contains(xt, et) OR contains(et, xt) THEN 0.8 ELSE {_OVER.format('xt', 'et')} END, 6)::DOUBLE AS title,
round(CASE WHEN xa = '' OR ea = '' THEN 0 WHEN xa = ea THEN 1 WHEN string_split(xa, ' ')[-1] = string_split(ea, ' ')[-1] THEN 0.7 ELSE {_OVER.format('xa', 'ea')} END, 6)::DOUBLE AS author,
CASE WHEN xp = '' OR ep = '' THEN 0 WHEN xp = ep THEN 1 WHEN contains(xp, 'oreilly') AND contains(ep, 'oreilly') THEN 0.9 WHEN contains(xp, ep) OR contains(ep, xp) THEN 0.6 ELSE 0 END::DOUBLE AS publisher FROM strict"""
)
def q15_strict_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each file name tells against its record: titles 1 if equal, 0.8 if one holds the other, else shared words; authors 1, 0.7 for one surname; publishers 1, 0.9 for an alias, 0.6 if one holds the other."""
    f = D.files(spark, sf_dir)
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))
    said = N.ground_truth(F.col("path"))
    rows = f.select("id", *[clean(said[k]).alias(f"x{k}") for k in ("title", "author", "publisher")], clean(F.col("title")).alias("title"), clean(F.get("authors", F.lit(0))).alias("author"), clean(F.col("publisher")).alias("publisher"))
    words, holds = (lambda c: F.split(c, " ")), (lambda x, y: F.contains(x, y) | F.contains(y, x))
    part = lambda k, *rules: F.when((F.col(f"x{k}") == "") | (F.col(k) == ""), 0.0).when(F.col(f"x{k}") == F.col(k), 1.0)
    t, a, p = (((F.col(f"x{k}"), F.col(k))) for k in ("title", "author", "publisher"))
    alias = F.contains(p[0], F.lit("oreilly")) & F.contains(p[1], F.lit("oreilly"))
    return rows.select(
        "id", F.round(part("title").when(holds(*t), 0.8).otherwise(S.jaccard(words(t[0]), words(t[1]))), 6).alias("title"),
        F.round(part("author").when(F.element_at(words(a[0]), -1) == F.element_at(words(a[1]), -1), 0.7).otherwise(S.jaccard(words(a[0]), words(a[1]))), 6).alias("author"),
        part("publisher").when(alias, 0.9).when(holds(*p), 0.6).otherwise(0.0).alias("publisher"),
    )


@query()
def q17_lexical_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence ratio, 0.5 per shared word, 0.4 for the phrase; what scores over 0.2, ten best."""
    t, want = F.lower("title"), "red ring economy"
    words = F.size(F.array_intersect(F.split(t, " "), F.split(F.lit(want), " ")))
    score = S.ratio_col(t, F.lit(want)) + 0.5 * words + _on(F.contains(t, F.lit(want)), 0.4)
    rows = D.books(spark, sf_dir).filter("title is not null").select(F.lit(0).alias("query"), "id", F.round(score, 6).alias("score"))
    return rows.filter("score > 0.2").orderBy(F.desc("score"), "id").limit(10)


@query(_WR + "SELECT query, id, max(score) AS score FROM ranked GROUP BY query, id")
def q19_max_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).groupBy("query", "id").agg(F.max("score").alias("score"))


@query(_WR + "SELECT query, id, round(avg(score) * (1 + 0.1 * (count(*) - 1)), 6)::DOUBLE AS score FROM ranked GROUP BY query, id")
def q21_consensus_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).groupBy("query", "id").agg(F.round(F.avg("score") * (1 + 0.1 * (F.count("*") - 1)), 6).alias("score"))


@query()
def q34_external_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0.6 source weight times confidence, 0.4 title match; ten best of each source."""
    match = F.least(F.lit(1.0), S.ratio_col(F.lower("title"), F.lit("red ring")) + _on(F.contains(F.lower("title"), F.lit("red ring")), 0.2))
    rows = D.books(spark, sf_dir).filter("title is not null").select(F.col("source").alias("query"), "id", F.round(0.6 * 0.9 * F.col("confidence") + 0.4 * match, 6).alias("score"))
    return R.top_k(rows, 10)


@query(_WS + "SELECT book, arg_max(source, (confidence + CASE WHEN source = 'google_books' THEN 0.1 ELSE 0 END) * 1000 - source_no) AS source FROM source_records WHERE source IN ('google_books', 'crossref') GROUP BY book")
def q35_arbitration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two candidates; one source gets a bonus of 0.1; the first of equal ones."""
    rows = D.source_records(spark, sf_dir).filter(F.col("source").isin("google_books", "crossref"))
    score = F.col("confidence") + F.when(F.col("source") == "google_books", 0.1).otherwise(0.0)
    return rows.groupBy("book").agg(F.max_by("source", F.struct(score, -F.col("source_no"))).alias("source"))


@query("SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4)::DOUBLE AS cosine FROM embeddings a, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) b")
def q46_embedding_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each embedding with the first one, which is one row."""
    e = D.read(spark, sf_dir, "embeddings")
    one = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("b"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda a, v: a + v)
    a, b = F.col("embedding"), F.col("b")
    return e.crossJoin(F.broadcast(one)).select("vec_id", F.round(dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)), 4).alias("cosine"))


@query(_WR + "SELECT algorithm, acc AS accuracy, rank, acc >= 0.4 AS ready FROM (SELECT algorithm, round(avg(score), 6)::DOUBLE AS acc, row_number() OVER (ORDER BY avg(score) DESC, algorithm) AS rank FROM ranked GROUP BY algorithm)")
def a28_algorithm_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window is over one row per algorithm."""
    from pyspark.sql import Window

    s = _ranked(spark, sf_dir).groupBy("algorithm").agg(F.avg("score").alias("m"))
    return s.select("algorithm", F.round("m", 6).alias("accuracy"), F.row_number().over(Window.orderBy(F.desc("m"), "algorithm")).cast("long").alias("rank"), (F.round("m", 6) >= 0.4).alias("ready"))


@query(_WR + "SELECT algorithm, count(*) AS searches, round(avg(score), 6)::DOUBLE AS mean_score FROM ranked GROUP BY algorithm")
def a29_running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).groupBy("algorithm").agg(F.count("*").alias("searches"), F.round(F.avg("score"), 6).alias("mean_score"))


_STORE = ("(?s)<h1[^>]*>([^<]+)</h1>", '(?s)href="([^"]+)"', "(?s)<html[^>]*lang=\"([a-z]+)\"")


@query("SELECT page_id, " + ", ".join(f"regexp_extract(html, '{rx}', 1) AS {n}" for n, rx in zip(("heading", "link", "lang"), _STORE, strict=True)) + ", 0.85::DOUBLE AS confidence FROM pages")
def z2_store_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three fields of a store's page, the first hit each."""
    fields = [F.regexp_extract("html", rx, 1).alias(n) for n, rx in zip(("heading", "link", "lang"), _STORE, strict=True)]
    return D.read(spark, sf_dir, "pages").select("page_id", *fields, F.lit(0.85).alias("confidence"))


@query(
    D.over(D.FILES) + """SELECT id, CASE WHEN contains(w, 'hands-on') OR contains(w, 'packt') THEN 'Packt Publishing' WHEN isbn_13 LIKE '97865%' THEN 'Casa do Código' WHEN isbn_13 LIKE '97885%' AND contains(w, 'novatec') THEN 'Novatec Editora'
WHEN isbn_13 LIKE '97885%' AND contains(w, 'alta books') THEN 'Alta Books' ELSE publisher END AS publisher, CASE WHEN contains(w, 'hands-on') OR contains(w, 'packt') OR isbn_13 LIKE '97865%' OR (isbn_13 LIKE '97885%' AND (contains(w, 'novatec') OR contains(w, 'alta books'))) THEN 0.95 ELSE confidence END::DOUBLE AS confidence
FROM (SELECT *, lower(publisher || '/' || path) AS w FROM files)"""
)
def z11_publisher_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folder and file name, or an ISBN's prefix, set publisher and confidence; each file lies in its publisher's folder."""
    f = D.files(spark, sf_dir).withColumn("where", F.lower(F.concat_ws("/", "publisher", "path")))
    has, prefix = (lambda w: F.contains(F.col("where"), F.lit(w))), (lambda p: F.col("isbn_13").startswith(p))
    house = F.when(has("hands-on") | has("packt"), "Packt Publishing").when(prefix("97865"), "Casa do Código").when(prefix("97885") & has("novatec"), "Novatec Editora").when(prefix("97885") & has("alta books"), "Alta Books")
    return f.select("id", F.coalesce(house, "publisher").alias("publisher"), F.when(house.isNotNull(), 0.95).otherwise(F.col("confidence")).alias("confidence"))


@query(_W + "SELECT id, id AS total, coalesce(title, 'none') AS name FROM books")
def z22_report_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of reports under one of several keys."""
    j = F.when(F.col("id") % 2 == 0, F.to_json(F.struct(F.col("id").alias("total_files"), F.col("title").alias("name")))).otherwise(F.to_json(F.struct(F.struct(F.col("id").alias("total_processed")).alias("summary"), F.col("title").alias("name"))))
    at = lambda p: F.get_json_object(j, p)
    return D.books(spark, sf_dir).select("id", F.coalesce(at("$.total_files"), at("$.summary.total_processed")).cast("long").alias("total"), F.coalesce(at("$.name"), F.lit("none")).alias("name"))


_NAME23 = "coalesce(title, 'untitled') || ' v' || CAST(id % 9 + 1 AS VARCHAR) || ' ' || CAST(id % 7 + 4 AS VARCHAR) || 'th Edition (' || year || ').' || ext"


@query(_W + f"""SELECT id, CAST(id % 9 + 1 AS VARCHAR) AS version, CAST(id % 7 + 4 AS VARCHAR) || 'th' AS edition, regexp_extract(name, '((?:19|20)[0-9]{{2}})', 1) AS year,
trim(split_part(regexp_replace(name, ' v[0-9] ', ' '), ' ' || CAST(id % 7 + 4 AS VARCHAR) || 'th Edition', 1)) AS title FROM (SELECT *, {_NAME23} AS name FROM books)""")
def z23_filename_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version, edition and year of a file name, each removed in turn; what is left is the title."""
    k = F.col("id")
    name, out = F.concat(F.coalesce("title", F.lit("untitled")), F.lit(" v"), (k % 9 + 1).cast("string"), F.lit(" "), (k % 7 + 4).cast("string"), F.lit("th Edition ("), "year", F.lit(")."), "ext"), []
    for key, rx in (("version", r"(?i)\bv([0-9]+)"), ("edition", r"(?i)\b([0-9]+(?:st|nd|rd|th)) edition"), ("year", r"\(?((?:19|20)[0-9]{2})\)?")):
        out.append(F.regexp_extract(name, rx, 1).alias(key))
        name = F.regexp_replace(name, rx, "")
    title = F.trim(F.regexp_replace(F.regexp_replace(name, r"\.[a-z0-9]+$", ""), r"\s+", " "))
    return D.books(spark, sf_dir).select("id", *out, title.alias("title"))


@query(_WF + "SELECT 'remote-' || CAST(id AS VARCHAR) AS remote_id, round(greatest(0.1, least(0.8, 0.1 + CASE WHEN strpos(path, ' - ') > 0 THEN 0.3 ELSE 0 END + CASE WHEN regexp_matches(path, '(19|20)[0-9]{2}') THEN 0.2 ELSE 0 END + 0.2)), 6)::DOUBLE AS confidence FROM files")
def z28_remote_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.files(spark, sf_dir).select(F.concat(F.lit("remote-"), F.col("id").cast("string")).alias("remote_id"), F.round(T.guess_confidence(F.col("path")), 6).alias("confidence"))


@query()
def z33_multi_source_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers of all sources, one per title and publisher, ranked."""
    from .search_queries import q33_external_dedup

    return q34_external_rank(spark, sf_dir).join(q33_external_dedup(spark, sf_dir), "id", "left_semi")

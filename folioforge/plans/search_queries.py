"""Similarity, retrieval, ranking and fusion queries (inventory 2.5), and aggregates over scores."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import filenames as N
from folioforge.functions import isbn
from folioforge.functions import similarity as S
from folioforge.functions import text as T
from folioforge.operators import duplicates, fuzzy
from folioforge.operators import ranking as R
from folioforge.operators.orchestrator import Orchestrator
from folioforge.operators.tables import written
from folioforge.sources import derived as D

from .registry import query
from .source_queries import CLASSES, TRUTH
from .text_queries import _TOK

#: Titles that a block of the fuzzy search holds on average.
BLOCK = 1000

_W = D.over(D.BOOKS)
_WS = D.over(D.SOURCE_RECORDS)


@query(_W + "SELECT id, CAST(levenshtein(coalesce(title, ''), 'small ring economy volume 7') AS INTEGER) AS distance FROM books")
def q1_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.books(spark, sf_dir).select("id", F.levenshtein(F.coalesce("title", F.lit("")), F.lit("small ring economy volume 7")).alias("distance"))


#: Each title beside itself as it is often typed: letters that changed places, or a word cut short.
_TYPED = "CASE id % 3 WHEN 0 THEN replace(t, 'ing', 'nig') WHEN 1 THEN replace(t, 'volume', 'vol') ELSE replace(t, 'ol', 'lo') END"
_PAIR_SQL = f"SELECT id, t AS a, {_TYPED} AS b FROM (SELECT id, lower(coalesce(title, 'untitled')) AS t FROM books)"


def _pair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, k = F.lower(F.coalesce("title", F.lit("untitled"))), F.col("id") % 3
    swap = lambda a, b: F.replace(t, F.lit(a), F.lit(b))
    typed = F.when(k == 0, swap("ing", "nig")).when(k == 1, swap("volume", "vol")).otherwise(swap("ol", "lo"))
    return D.books(spark, sf_dir).select("id", t.alias("a"), typed.alias("b"))


@query(_W + f"SELECT id, round(jaro_similarity(a, b), 6) AS score FROM ({_PAIR_SQL})")
def q2_jaro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pair_rows(spark, sf_dir).select("id", F.round(S.jaro_col(F.col("a"), F.col("b")), 6).alias("score"))


@query(_W + f"SELECT id, round(CASE WHEN jaro_similarity(a, b) < 0.7 THEN jaro_similarity(a, b) ELSE jaro_winkler_similarity(a, b) END, 6) AS score FROM ({_PAIR_SQL})")
def q3_jaro_winkler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pair_rows(spark, sf_dir).select("id", F.round(S.jaro_winkler_col(F.col("a"), F.col("b")), 6).alias("score"))


@query()
def q4_weighted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0.4 title, 0.3 author, 0.2 publisher, 0.1 year; a missing field adds nothing."""
    b = D.books(spark, sf_dir)
    part = lambda c, wanted, w: F.when(c.isNotNull(), w * S.jaro_winkler_col(F.lower(c), F.lit(wanted))).otherwise(0.0)
    score = part(F.col("title"), "small ring economy volume 7", 0.4) + part(F.get("authors", F.lit(0)), "supplier#000000001", 0.3) + part(F.col("publisher"), "manning", 0.2) + F.when(F.col("year") == "1990", 0.1).otherwise(0.0)
    return b.select("id", F.round(F.least(F.lit(1.0), score), 6).alias("score"))


@query()
def q5_author_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean, over the asked authors, of the best candidate's similarity."""
    asked = F.explode(F.array(F.lit("supplier#000000001"), F.lit("supplier#000000042"))).alias("asked")
    pairs = D.books(spark, sf_dir).select("id", F.explode("authors").alias("author")).select("id", "author", asked)
    best = pairs.groupBy("id", "asked").agg(F.max(S.jaro_winkler_col(F.lower("author"), F.col("asked"))).alias("best"))
    return best.groupBy("id").agg(F.round(F.avg("best"), 6).alias("score"))


@query()
def q6_fuzzy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles near each query, cut at 0.8: only blocks of titles, and titles, whose letters allow that score are compared."""
    b = D.books(spark, sf_dir).filter("title is not null").select("id", F.lower("title").alias("text"))
    q = b.filter("id % 50 = 0").select(F.col("id").alias("query"), F.concat("text", F.lit("x")).alias("text"))
    return R.search_texts(q, b, 10, lambda asked, titles: fuzzy.fuzzy_search(asked.withColumnRenamed("text", "asked"), titles, 0.8, BLOCK))


_SCORES = """WITH toks AS (SELECT doc_id AS id, unnest({tok}) AS term FROM documents), c AS (SELECT id, term, count(*) AS n FROM toks GROUP BY ALL),
tf AS (SELECT id, term, n / sum(n) OVER (PARTITION BY id) AS tf FROM c), idf AS (SELECT term, count(*) AS df, CASE WHEN ln((SELECT count(*) FROM documents) / count(*)) > 0 THEN ln((SELECT count(*) FROM documents) / count(*)) ELSE 0.1 END AS idf FROM c GROUP BY term),
w AS (SELECT id, term, tf * idf AS w FROM tf JOIN idf USING (term)), nrm AS (SELECT id, sqrt(sum(w * w)) AS norm FROM w GROUP BY id), {views},
qt AS (SELECT item_id AS query, unnest({qtok}) AS term FROM search_queries), qc AS (SELECT query, term, count(*) AS n FROM qt GROUP BY ALL), qf AS (SELECT query, term, n / sum(n) OVER (PARTITION BY query) AS f FROM qc),
qw AS (SELECT query, term, f * idf AS qw FROM qf JOIN idf USING (term)), qn AS (SELECT query, sqrt(sum(qw * qw)) AS q_norm FROM qw GROUP BY query),
scored AS (SELECT qw.query, w.id, sum(qw * w) / (any_value(norm) * any_value(q_norm)) AS score FROM qw JOIN w USING (term) JOIN nrm ON nrm.id = w.id JOIN qn ON qn.query = qw.query GROUP BY qw.query, w.id HAVING sum(qw * w) / (any_value(norm) * any_value(q_norm)) >= 0.1)
""".format(tok=_TOK.format("text"), qtok=_TOK.format("q"), views=D.SEARCH_QUERIES)


def _scored(spark: SparkSession, sf_dir: str, k: int | None = None) -> DataFrame:
    docs = D.read(spark, sf_dir, "documents")
    return R.scan_search(D.search_queries(spark, sf_dir), docs, T.tokens(F.col("q")), T.tokens(F.col("text")), "item_id", "doc_id", k=k)


@query(_SCORES + "SELECT id, term, round(tf, 9) AS tf FROM tf")
def q8_term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    tf, _ = R.term_weights(D.read(spark, sf_dir, "documents"), "doc_id", T.tokens(F.col("text")))
    return tf.select("id", "term", F.round("tf", 9).alias("tf"))


@query(_SCORES + "SELECT term, df, round(idf, 9) AS idf FROM idf")
def q9_inverse_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, idf = R.term_weights(D.read(spark, sf_dir, "documents"), "doc_id", T.tokens(F.col("text")))
    return idf.select("term", "df", F.round("idf", 9).alias("idf"))


@query(_SCORES + "SELECT query, id, round(score, 6) AS score FROM scored")
def q10_tfidf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("query", "id", F.round("score", 6).alias("score"))


@query(_SCORES + "SELECT query, id, rank FROM (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM scored) WHERE rank <= 10")
def q29_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_k(_scored(spark, sf_dir, 10).withColumn("score", F.round("score", 9)), 10).select("query", "id", F.col("rank").cast("long").alias("rank"))


_WORDS = "string_split(coalesce(lower(title), ''), ' ')"


@query(_W + f"SELECT id, round(len(list_intersect(list_distinct({_WORDS}), ['red', 'ring', 'volume'])) * 1.0 / len(list_distinct(list_concat({_WORDS}, ['red', 'ring', 'volume']))), 6)::DOUBLE AS score FROM books")
def q13_word_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    want = F.array(F.lit("red"), F.lit("ring"), F.lit("volume"))
    return D.books(spark, sf_dir).select("id", F.round(S.jaccard(F.split(F.coalesce(F.lower("title"), F.lit("")), " "), want), 6).alias("score"))


@query(_W + f"SELECT id, CASE WHEN title IS NULL THEN 0.0 WHEN lower(title) = 'red ring' THEN 1.0 WHEN contains(lower(title), 'red ring') OR contains('red ring', lower(title)) THEN 0.8 ELSE round(len(list_intersect(list_distinct({_WORDS}), ['red', 'ring'])) * 1.0 / len(list_distinct(list_concat({_WORDS}, ['red', 'ring']))), 6) END::DOUBLE AS score FROM books")
def q14_text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.books(spark, sf_dir).select("id", F.round(S.text_similarity(F.col("title"), F.lit("red ring")), 6).alias("score"))


@query()
def q16_sequence_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.books(spark, sf_dir).select("id", F.round(S.ratio_col(F.col("title"), F.lit("red ring")), 6).alias("score"))


#: What three rankers said of every query (each book whose id is divisible by 50): lexical, by identifier, and by TF-IDF over titles.
_RANKED = """asking AS (SELECT id AS query, lower(title) AS title, isbn_raw FROM books WHERE id % 50 = 0),
words AS (SELECT DISTINCT id, unnest(string_split(lower(title), ' ')) AS word FROM books WHERE title IS NOT NULL),
sizes AS (SELECT id, count(*) AS n FROM words GROUP BY id), shared AS (SELECT a.id AS query, b.id, count(*) AS common FROM words a JOIN words b USING (word) WHERE a.id % 50 = 0 GROUP BY ALL),
fuzzy AS (SELECT query, shared.id, round(common / (x.n + y.n - common), 6)::DOUBLE AS score FROM shared JOIN sizes x ON x.id = query JOIN sizes y ON y.id = shared.id),
tt AS (SELECT id, unnest(string_split(lower(title), ' ')) AS term FROM books WHERE title IS NOT NULL), tc AS (SELECT id, term, count(*) AS n FROM tt GROUP BY ALL),
ttf AS (SELECT id, term, n / sum(n) OVER (PARTITION BY id) AS tf FROM tc), total AS (SELECT count(*) AS n FROM books WHERE title IS NOT NULL),
tidf AS (SELECT term, CASE WHEN ln((SELECT n FROM total) / count(*)) > 0 THEN ln((SELECT n FROM total) / count(*)) ELSE 0.1 END AS idf FROM tc GROUP BY term),
tw AS (SELECT id, term, tf * idf AS w FROM ttf JOIN tidf USING (term)), tn AS (SELECT id, sqrt(sum(w * w)) AS norm FROM tw GROUP BY id),
tdot AS (SELECT a.id AS query, b.id, sum(a.w * b.w) AS dot FROM tw a JOIN tw b USING (term) WHERE a.id % 50 = 0 GROUP BY ALL),
semantic AS (SELECT query, tdot.id, round(dot / (x.norm * y.norm), 6)::DOUBLE AS score FROM tdot JOIN tn x ON x.id = query JOIN tn y ON y.id = tdot.id WHERE dot / (x.norm * y.norm) >= 0.1),
best AS (SELECT query, id, 'fuzzy' AS algorithm, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rn FROM fuzzy) WHERE rn <= 10
 UNION ALL SELECT query, id, 'semantic', score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rn FROM semantic) WHERE rn <= 10),
ranked AS (SELECT * FROM best UNION ALL SELECT a.id, b.id, 'isbn', CASE WHEN a.isbn_raw = a.isbn_13 THEN 1.0 ELSE 0.85 END::DOUBLE FROM books a JOIN books b ON b.isbn_13 = a.isbn_13 AND a.id % 7 <> 0 WHERE a.id % 50 = 0)"""
_WR = D.over(D.BOOKS, "\n" + _RANKED)


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query, id, algorithm, score: what the registered rankers said of every query."""
    from .extract_queries import isbn_ranker

    rankers = {"fuzzy": lexical_ranker, "isbn": isbn_ranker, "semantic": semantic_ranker}
    catalog = written(D.books(spark, sf_dir).select("id", "title", "isbn_raw", "isbn_13"))
    return R.search_all(rankers, catalog.filter("id % 50 = 0").withColumn("query", F.col("id")), catalog)


def _titled(queries: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    title = F.lower("title").alias("text")
    return queries.filter("title is not null").select("query", title), catalog.filter("title is not null").select("id", title)


def lexical_ranker(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """The ten titles of each query with the greatest share of words in common."""
    words = lambda df, key: df.select(F.col(key).alias("id"), F.array_distinct(F.split("text", " ")).alias("words"))
    search = lambda asked, titles: R.most_shared(words(asked, "query"), words(titles, "id"), 10, share=True)
    return R.search_texts(*_titled(queries, catalog), 10, search).select("query", "id", F.round("score", 6).alias("score"))


def semantic_ranker(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """The ten titles of each query nearest by the cosine of TF-IDF vectors."""
    words = F.split("text", " ")

    def search(asked: DataFrame, titles: DataFrame) -> DataFrame:
        scored = R.tfidf_search(asked, titles, words, words, "query", "id", k=10, copies=F.col("copies"))
        return scored.withColumn("score", F.round("score", 6))

    return R.search_texts(*_titled(queries, catalog), 10, search).drop("rank")


@query(_WR + "SELECT query, id, round(least(1.0, max(score * CASE algorithm WHEN 'fuzzy' THEN 0.9 WHEN 'isbn' THEN 1.0 ELSE 0.8 END) + 0.1 * (count(DISTINCT algorithm) - 1) + CASE WHEN count(DISTINCT algorithm) > 1 THEN 0.05 ELSE 0 END), 6)::DOUBLE AS score FROM ranked GROUP BY query, id")
def q20_weighted_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fuse_weighted(_ranked(spark, sf_dir), {"fuzzy": 0.9, "isbn": 1.0, "semantic": 0.8}).select("query", "id", F.round("score", 6).alias("score"))


@query(_W + "SELECT id, title IS NOT NULL OR len(authors) > 0 AS fuzzy, isbn_13 IS NOT NULL AS isbn, coalesce(length(title), 0) > 10 AS semantic, CASE WHEN CAST(title IS NOT NULL OR len(authors) > 0 AS INTEGER) + 1 + CAST(coalesce(length(title), 0) > 10 AS INTEGER) <= 1 THEN 'best_match' ELSE 'parallel' END AS strategy FROM books")
def q24_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rankers suit a query (Q23), and the strategy that their number asks for."""
    fuzzy, isbn, semantic = F.col("title").isNotNull() | (F.size("authors") > 0), F.col("isbn_13").isNotNull(), F.coalesce(F.length("title"), F.lit(0)) > 10
    n = fuzzy.cast("int") + isbn.cast("int") + semantic.cast("int")
    return D.books(spark, sf_dir).select("id", fuzzy.alias("fuzzy"), isbn.alias("isbn"), semantic.alias("semantic"), F.when(n <= 1, "best_match").when(n <= 3, "parallel").otherwise("adaptive").alias("strategy"))


@query(_WR + "SELECT query, algorithm, id, score FROM (SELECT *, max(CASE WHEN score >= 0.9 THEN 1 ELSE 0 END) OVER (PARTITION BY query ORDER BY CASE algorithm WHEN 'isbn' THEN 0 WHEN 'fuzzy' THEN 1 ELSE 2 END RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ranked) WHERE coalesce(before, 0) = 0")
def q25_early_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankers run in order; none runs for a query after one has reached 0.9: it is given the queries that are left open only."""
    catalog = written(D.books(spark, sf_dir).select("id", "title", "isbn_raw", "isbn_13"))
    answers, _, _ = orchestrator(suits=F.lit(True)).staged(_asking(catalog).withColumn("suited", F.array(F.lit("isbn"), F.lit("fuzzy"), F.lit("semantic"))), catalog, ["isbn", "fuzzy", "semantic"], 0.9)
    return functools.reduce(DataFrame.unionByName, answers).select("query", "algorithm", "id", "score")


def _asking(catalog: DataFrame) -> DataFrame:
    return catalog.filter("id % 50 = 0").withColumn("query", F.col("id"))


def orchestrator(suits: Column | None = None) -> Orchestrator:
    """The three rankers, with the queries that suit them: a title or authors; a valid ISBN; more than ten characters of text."""
    from .extract_queries import isbn_ranker

    text = F.trim(F.concat_ws(" ", "title", F.array_join("authors", " ")))
    out = Orchestrator()
    out.register("fuzzy", lexical_ranker, suits if suits is not None else F.col("title").isNotNull() | (F.size("authors") > 0))
    out.register("isbn", isbn_ranker, suits if suits is not None else isbn.valid13(isbn.clean(F.col("isbn_raw"))))
    out.register("semantic", semantic_ranker, suits if suits is not None else F.length(text) > 10)
    return out


def _searched(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    catalog = written(D.books(spark, sf_dir))
    return orchestrator().search(_asking(catalog), catalog, strategy).withColumns({"score": F.round("score", 6), "algorithms": F.array_join("algorithms", ",")})


@query()
def q25_parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suitable rankers, their answers put together by book."""
    return _searched(spark, sf_dir, "parallel")


@query()
def q25_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranker after ranker until one is sure (0.8); else all answers put together."""
    return _searched(spark, sf_dir, "sequential")


@query()
def q25_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best ranker; where it is not very sure (0.9), the first three put together."""
    return _searched(spark, sf_dir, "adaptive")


@query()
def u1_orchestrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query by the strategy that the number of its suitable rankers asks for."""
    return _searched(spark, sf_dir, "auto")


@query("WITH RECURSIVE " + CLASSES + ",\n" + _RANKED + "\nSELECT query, class, arg_max(id, score * 100000000 - id) AS id, round(avg(score), 4)::DOUBLE AS score, array_to_string(list_sort(list_distinct(list(algorithm))), ',') AS algorithms FROM ranked JOIN classes USING (id) GROUP BY query, class")
def q28_group_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rankers' answers by class of duplicates: the best one's id, the mean score, and who found it."""
    of = duplicates.classes(D.books(spark, sf_dir)).select("id", "class")
    fused = R.fuse_groups(_ranked(spark, sf_dir).join(of, "id"), "class")
    return fused.select("query", "class", "id", F.round("score", 4).alias("score"), F.array_join("algorithms", ",").alias("algorithms"))


@query(f"WITH t AS (SELECT DISTINCT doc_id, unnest({_TOK.format('text')}) AS term FROM documents) SELECT term, count(*) AS postings, min(doc_id) AS first_doc FROM t GROUP BY term")
def q30_inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = D.read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("postings"), F.min("doc_id").alias("first_doc"))


@query(f"WITH t AS (SELECT DISTINCT doc_id, unnest({_TOK.format('text')}) AS term FROM documents), s AS (SELECT DISTINCT item_id AS query, unnest({_TOK.format('text')}) AS term FROM benchmark), h AS (SELECT query, doc_id AS id, count(*) AS terms FROM s JOIN t USING (term) GROUP BY ALL) SELECT query, id, terms FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY terms DESC, id) AS rn FROM h) WHERE rn <= 100")
def q31_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each query the 100 documents with most of its terms: rare terms first, and the commonest only for documents that may be among them."""
    words = lambda df, key: df.select(F.col(key).alias("id"), F.array_distinct(T.tokens(F.col("text"))).alias("words"))
    docs = written(words(D.read(spark, sf_dir, "documents"), "doc_id"))
    found = R.most_shared(words(D.read(spark, sf_dir, "benchmark"), "item_id"), docs, 100)
    return found.select("query", "id", F.col("score").cast("long").alias("terms"))


@query(f"WITH t AS (SELECT DISTINCT doc_id, unnest({_TOK.format('text')}) AS term FROM documents) SELECT term, count(*) AS n FROM t GROUP BY term ORDER BY n DESC, term LIMIT 10")
def q32_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q30_inverted_index(spark, sf_dir).select("term", F.col("postings").alias("n")).orderBy(F.desc("n"), "term").limit(10)


@query(f"WITH t AS (SELECT DISTINCT doc_id, unnest({_TOK.format('text')}) AS term FROM documents) SELECT (SELECT count(*) FROM documents) AS docs, count(DISTINCT term) AS vocabulary FROM t")
def z32_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = D.read(spark, sf_dir, "documents")
    terms = docs.select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).agg(F.count_distinct("term").alias("vocabulary"))
    return docs.agg(F.count("*").alias("docs")).crossJoin(terms)  # one row each


@query(_W + "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY lower(coalesce(title, '')) || ':' || lower(publisher) ORDER BY id) AS rn FROM books) WHERE rn = 1")
def q33_external_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lower(F.coalesce("title", F.lit(""))), F.lit(":"), F.lower("publisher"))
    return D.books(spark, sf_dir).groupBy(key.alias("k")).agg(F.min("id").alias("id")).select("id")


_GROUP = "CASE WHEN source_no < 3 THEN 1 WHEN source_no < 6 THEN 2 ELSE 3 END"
_LEAST = "CASE WHEN source_no < 3 THEN 0.75 WHEN source_no < 6 THEN 0.8 ELSE 0.9 END"


@query(_WS + f"SELECT book, source, confidence, accepted FROM (SELECT *, confidence >= {_LEAST} AS good, max(confidence >= {_LEAST}) OVER (PARTITION BY book) AS accepted, row_number() OVER (PARTITION BY book ORDER BY CASE WHEN confidence >= {_LEAST} THEN -({_GROUP}) ELSE -1000 END DESC, confidence DESC, source_no) AS rn FROM source_records) WHERE rn = 1")
def q36_source_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("source_no")
    group, least = F.when(n < 3, 1).when(n < 6, 2).otherwise(3), F.when(n < 3, 0.75).when(n < 6, 0.8).otherwise(0.9)
    return R.cascade(D.source_records(spark, sf_dir), "book", group, least).select("book", "source", "confidence", "accepted")


@query(_WS + "SELECT book, source, round(confidence + CASE WHEN elapsed < 1 THEN 0.05 ELSE 0 END, 6)::DOUBLE AS raised FROM source_records")
def q37_latency_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.source_records(spark, sf_dir).select("book", "source", F.round(F.col("confidence") + F.when(F.col("elapsed") < 1, 0.05).otherwise(0.0), 6).alias("raised"))


@query(_WS + "SELECT source, round(avg(confidence) * avg(CASE WHEN elapsed < 1.5 THEN 1.0 ELSE 0.0 END) / avg(elapsed) * CASE WHEN source = 'mercado_editorial' THEN 2 ELSE 1 END, 6)::DOUBLE AS health FROM source_records GROUP BY source")
def q39_source_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.avg(F.when(F.col("elapsed") < 1.5, 1.0).otherwise(0.0))
    h = D.source_records(spark, sf_dir).groupBy("source").agg((F.avg("confidence") * ok / F.avg("elapsed")).alias("h"))
    return h.select("source", F.round(F.col("h") * F.when(F.col("source") == "mercado_editorial", 2).otherwise(1), 6).alias("health"))


_SIM = "CASE WHEN lower(trim({0})) = lower(trim({1})) THEN 1.0 WHEN contains(lower(trim({0})), lower(trim({1}))) OR contains(lower(trim({1})), lower(trim({0}))) THEN 0.8 ELSE len(list_intersect(list_distinct(string_split(lower(trim({0})), ' ')), list_distinct(string_split(lower(trim({1})), ' ')))) / len(list_distinct(list_concat(string_split(lower(trim({0})), ' '), string_split(lower(trim({1})), ' ')))) END"
_EXPECTED = (("t", "et", 0.4), ("a", "ea", 0.3), ("p", "ep", 0.2), ("y", "ey", 0.1))


@query(
    D.over(D.FILES) + "," + TRUTH + ", met AS (SELECT id, t, a, p, y, coalesce(title, '') AS et, coalesce(authors[1], '') AS ea, publisher AS ep, year AS ey FROM truth JOIN (SELECT id, title, authors, publisher, year FROM books) USING (id)) SELECT id, round(("
    + " + ".join(f"CASE WHEN {e} <> '' THEN {w} * CASE WHEN {x} = '' THEN 0 ELSE {_SIM.format(x, e)} END ELSE 0 END" for x, e, w in _EXPECTED) + ") / (" + " + ".join(f"CASE WHEN {e} <> '' THEN {w} ELSE 0 END" for _, e, w in _EXPECTED) + "), 6)::DOUBLE AS accuracy FROM met"
)
def q40_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How near what each file name tells comes to its record: the weighted mean of the similarities of the fields that the record has."""
    said = N.ground_truth(F.col("path"))
    rows = D.files(spark, sf_dir).select("id", *[said[k].alias(f"x{k}") for k in said], F.coalesce("title", F.lit("")).alias("title"), F.coalesce(F.get("authors", F.lit(0)), F.lit("")).alias("author"), "publisher", "year")
    weights = {"title": 0.4, "author": 0.3, "publisher": 0.2, "year": 0.1}
    got = sum((F.when(F.col(k) != "", w * S.text_similarity(F.nullif(f"x{k}", F.lit("")), F.col(k))).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    return rows.select("id", F.round(got / sum((F.when(F.col(k) != "", w).otherwise(0.0) for k, w in weights.items()), F.lit(0.0)), 6).alias("accuracy"))


@query(_W + "SELECT id, arg_max(v, length(v) * 10 - o) AS chosen FROM (SELECT id, unnest([coalesce(title, ''), publisher, source]) AS v, unnest([0, 1, 2]) AS o FROM books) WHERE v <> '' GROUP BY id")
def q41_field_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest non-empty value; the first of equally long ones."""
    values = F.filter(F.array(F.coalesce("title", F.lit("")), "publisher", "source"), lambda v: v != "")
    best = F.array_max(F.transform(values, lambda v, i: F.struct(F.length(v).alias("n"), (-i).alias("o"), v.alias("v"))))
    return D.books(spark, sf_dir).select("id", best["v"].alias("chosen"))


@query(_WR + "SELECT id, round(sum(score * w) / sum(w), 6)::DOUBLE AS confidence FROM (SELECT *, CASE algorithm WHEN 'fuzzy' THEN 2.0 WHEN 'isbn' THEN 1.5 ELSE 0.8 END AS w FROM ranked) GROUP BY id")
def q44_weighted_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.when(F.col("algorithm") == "fuzzy", 2.0).when(F.col("algorithm") == "isbn", 1.5).otherwise(0.8)
    return _ranked(spark, sf_dir).groupBy("id").agg(F.round(F.sum(F.col("score") * w) / F.sum(w), 6).alias("confidence"))


@query(_W + "SELECT publisher, round(max(n) * 1.0 / sum(n), 6)::DOUBLE AS agreement FROM (SELECT publisher, source, count(*) AS n FROM books GROUP BY ALL) GROUP BY publisher")
def q45_field_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = D.books(spark, sf_dir).groupBy("publisher", "source").agg(F.count("*").alias("n"))
    return n.groupBy("publisher").agg(F.round(F.max("n") / F.sum("n"), 6).alias("agreement"))


@query(_WR + "SELECT algorithm, round(avg(score), 6)::DOUBLE AS mean_score, round(avg(CASE WHEN score > 0.6 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS success FROM ranked GROUP BY algorithm")
def a20_algorithm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).groupBy("algorithm").agg(F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg(F.when(F.col("score") > 0.6, 1.0).otherwise(0.0)), 6).alias("success"))


@query(_WR + "SELECT id, algorithm FROM (SELECT id, algorithm, row_number() OVER (PARTITION BY id ORDER BY score DESC, algorithm) AS rn FROM ranked) WHERE rn = 1")
def a21_best_algorithm(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("id").orderBy(F.desc("score"), "algorithm")
    return _ranked(spark, sf_dir).withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("id", "algorithm")


@query(_WR + "SELECT wf, wi, round(avg(least(1.0, s)), 4)::DOUBLE AS accuracy FROM (SELECT query, id, wf, wi, max(score * CASE algorithm WHEN 'fuzzy' THEN wf WHEN 'isbn' THEN wi ELSE 0.8 END) AS s FROM ranked CROSS JOIN (SELECT unnest([0.8, 0.9, 1.0]) AS wf) CROSS JOIN (SELECT unnest([0.9, 1.0]) AS wi) GROUP BY ALL) GROUP BY wf, wi")
def a27_weight_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean fused score at each point of a small grid of weights, exploded beside each row."""
    grid = F.explode(F.array(*[F.struct(F.lit(a).alias("wf"), F.lit(b).alias("wi")) for a in (0.8, 0.9, 1.0) for b in (0.9, 1.0)])).alias("g")
    r = _ranked(spark, sf_dir).select("query", "id", "algorithm", "score", grid).select("*", "g.wf", "g.wi")
    w = F.when(F.col("algorithm") == "fuzzy", F.col("wf")).when(F.col("algorithm") == "isbn", F.col("wi")).otherwise(0.8)
    best = r.groupBy("query", "id", "wf", "wi").agg(F.max(F.col("score") * w).alias("s"))
    return best.groupBy("wf", "wi").agg(F.round(F.avg(F.least(F.lit(1.0), F.col("s"))), 4).alias("accuracy"))


@query(_WR + "SELECT algorithm, round(0.3 * greatest(0, 1 - 120 / 1000.0) + 0.4 * avg(score) + 0.3 * avg(CASE WHEN score > 0.6 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS performance, (SELECT max(t) FROM (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9]) AS t) WHERE t <= avg(score))::DOUBLE AS target FROM ranked GROUP BY algorithm")
def z20_performance_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The performance score (Z19), and the highest target that the mean score meets."""
    targets = F.array(*map(F.lit, (0.1, 0.3, 0.5, 0.7, 0.9)))
    s = _ranked(spark, sf_dir).groupBy("algorithm").agg(F.avg("score").alias("acc"), F.avg(F.when(F.col("score") > 0.6, 1.0).otherwise(0.0)).alias("ok"))
    return s.select("algorithm", F.round(0.3 * (1 - 120 / 1000.0) + 0.4 * F.col("acc") + 0.3 * F.col("ok"), 6).alias("performance"), F.array_max(F.filter(targets, lambda t: t <= F.col("acc"))).alias("target"))

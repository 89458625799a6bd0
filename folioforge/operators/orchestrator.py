"""Rankers registered by name with the queries that suit them, and strategies that run them in stages.

A stage gives a ranker only the queries that the stages before left open: those are written, and the next ranker's own plan starts
from them, so that what is settled costs no further search. A ranker that no query is left for is not run at all. `trace` tells how
many queries each ranker was given.

Strategies: parallel, all suitable rankers, their answers put together; sequential, by name until one answers with 0.8 or more,
else all answers put together; best, the first suitable one by name; adaptive, that one, and where it stays below 0.9 the first
three suitable ones as registered, put together; auto, best for up to one suitable ranker, parallel for up to three, else adaptive.

Answers are put together by book: in order of the rankers and their answers, each goes to the first book that it resembles (one ISBN, or
similar titles and first authors), or is a book of its own. A book has the mean score, and the id of its best answer. At most k answers of
each ranker meet in a query's group.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import Ranker, top_k
from .tables import written

#: Scores from which on an answer settles a query.
SURE, VERY_SURE = 0.8, 0.9
#: Rankers that the adaptive strategy puts together.
LIMITED = 3

_BOOK = "array<struct<isbn:string,title:string,author:string,best:double,id:bigint,total:double,n:int,algorithms:array<string>>>"


def similar(a: Column, b: Column) -> Column:
    """Two answers that stand for one book: one ISBN; or one title holds the other, or they differ by three characters at most, and one first author holds the other."""
    both = lambda x, y: (F.coalesce(x, F.lit("")) != "") & (F.coalesce(y, F.lit("")) != "")
    holds = lambda x, y: F.contains(x, y) | F.contains(y, x)
    titles = both(a["title"], b["title"]) & (holds(a["title"], b["title"]) | (F.abs(F.length(a["title"]) - F.length(b["title"])) <= 3))
    authors = both(a["author"], b["author"]) & holds(a["author"], b["author"])
    return F.coalesce((both(a["isbn"], b["isbn"]) & (a["isbn"] == b["isbn"])) | (titles & authors), F.lit(False))


def put_together(answers: DataFrame, catalog: DataFrame, order: list[str], k: int) -> DataFrame:
    """query, rank, id, score, algorithms: the answers (query, id, algorithm, place, score) by book; catalog: id, isbn_13, title, authors."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("algorithm"))
    known = catalog.select("id", F.col("isbn_13").alias("isbn"), F.lower("title").alias("title"), F.lower(F.get("authors", F.lit(0))).alias("author"))
    row = F.struct(place.alias("r"), "place", "id", "algorithm", "score", "isbn", "title", "author")
    rows = answers.join(known, "id").groupBy("query").agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def add(books: Column, x: Column) -> Column:
        found = F.array_position(F.transform(books, lambda b: similar(b, x)), F.lit(True))
        own = F.struct(x["isbn"].alias("isbn"), x["title"].alias("title"), x["author"].alias("author"), x["score"].alias("best"), x["id"].cast("long").alias("id"), x["score"].alias("total"), F.lit(1).alias("n"), F.array(x["algorithm"]).alias("algorithms"))
        better = lambda b: x["score"] > b["best"]
        joined = lambda b: F.struct(
            b["isbn"].alias("isbn"), b["title"].alias("title"), b["author"].alias("author"), F.greatest(b["best"], x["score"]).alias("best"), F.when(better(b), x["id"]).otherwise(b["id"]).cast("long").alias("id"),
            (b["total"] + x["score"]).alias("total"), (b["n"] + 1).alias("n"), F.array_union(b["algorithms"], F.array(x["algorithm"])).alias("algorithms"),
        )
        put = lambda at: F.when(at == 0, F.concat(books, F.array(own))).otherwise(F.transform(books, lambda b, i: F.when(i + 1 == at, joined(b)).otherwise(b))).cast(_BOOK)
        return F.get(F.transform(F.array(found), put), F.lit(0))  # the place is worked out once, not for each book

    books = rows.select("query", F.posexplode(F.aggregate("rows", F.array().cast(_BOOK), add)).alias("o", "b"))
    scored = books.select("query", "o", F.col("b.id").alias("id"), F.least(F.lit(1.0), F.col("b.total") / F.col("b.n")).alias("score"), F.array_sort("b.algorithms").alias("algorithms"))
    return top_k(scored, k, order=(F.col("o"),)).select("query", "rank", "id", "score", "algorithms")


@dataclass
class Orchestrator:
    """Rankers by name; each answers (queries, catalog) with query, id, score, and suits is a condition over the queries' columns."""

    k: int = 10
    rankers: dict[str, tuple[Ranker, Column]] = field(default_factory=dict)
    trace: list[tuple[str, int]] = field(default_factory=list)

    def register(self, name: str, ranker: Ranker, suits: Column) -> None:
        self.rankers[name] = (ranker, suits)

    def unregister(self, name: str) -> bool:
        return self.rankers.pop(name, None) is not None

    def prepared(self, queries: DataFrame) -> DataFrame:
        """The queries with `suited`, the names of the rankers that suit each, by name."""
        names = [F.when(F.coalesce(self.rankers[n][1], F.lit(False)), F.lit(n)) for n in sorted(self.rankers)]
        return written(queries.withColumn("suited", F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")))

    def ask(self, name: str, queries: DataFrame, catalog: DataFrame) -> DataFrame | None:
        """The k best answers of one ranker (query, id, algorithm, place, score), or None if there is no query for it."""
        n = queries.count()
        if not n:
            return None
        self.trace.append((name, n))
        found = top_k(self.rankers[name][0](queries.drop("suited"), catalog).select("query", "id", F.col("score").cast("double").alias("score")), self.k)
        return written(found.select("query", "id", F.lit(name).alias("algorithm"), F.col("rank").alias("place"), "score"))

    def staged(self, queries: DataFrame, catalog: DataFrame, order: list[str], least: float, suits: Callable[[str], Column] | None = None) -> tuple[list[DataFrame], DataFrame, DataFrame | None]:
        """Ranker after ranker, each given the queries that no earlier one answered with `least` or more: the answers of each, the queries that are left, and
        those that are settled, with the ranker that did."""
        suits = suits or (lambda name: F.array_contains("suited", name))
        answers, settled = [], None
        for name in order:
            found = self.ask(name, queries.filter(suits(name)), catalog)
            if found is None:
                continue
            answers.append(found)
            sure = found.groupBy("query").agg(F.max("score").alias("s")).filter(F.col("s") >= least).select("query", F.lit(name).alias("by"))
            queries = written(queries.join(sure, "query", "left_anti"))
            settled = sure if settled is None else settled.unionByName(sure)
        return answers, queries, settled

    def search(self, queries: DataFrame, catalog: DataFrame, strategy: str = "auto") -> DataFrame:
        """query, rank, id, score, algorithms: the k best of each query."""
        queries = self.prepared(queries)
        if not self.rankers:
            return self._all([], queries)
        if strategy != "auto":
            return self._by(strategy, queries, catalog)
        n = F.size("suited")
        parts = (("best", n <= 1), ("parallel", (n > 1) & (n <= LIMITED)), ("adaptive", n > LIMITED))
        return self._all([self._by(s, queries.filter(c), catalog) for s, c in parts], queries)

    def _by(self, strategy: str, queries: DataFrame, catalog: DataFrame) -> DataFrame:
        names, first = sorted(self.rankers), lambda name: F.get("suited", F.lit(0)) == name
        if strategy == "parallel":
            found = [self.ask(n, queries.filter(F.array_contains("suited", n)), catalog) for n in self.rankers]
            return self._together(found, catalog, queries)
        if strategy == "best":
            return self._all([self._plain(self.ask(n, queries.filter(first(n)), catalog)) for n in names], queries)
        if strategy == "sequential":
            answers, left, settled = self.staged(queries, catalog, names, SURE)
            rest = self._together([a.join(left, "query", "left_semi") for a in answers], catalog, queries, names)
            return self._all([self._settled(answers, settled), rest], queries)
        if strategy == "adaptive":
            answers, left, settled = self.staged(queries, catalog, names, VERY_SURE, first)
            limited = F.slice(F.filter(F.array(*map(F.lit, self.rankers)), lambda x: F.array_contains("suited", x)), 1, LIMITED)
            left = left.withColumn("limited", limited)
            among = [left.filter(F.array_contains("limited", n)) for n in self.rankers]
            more = [self.ask(n, mine.filter(~first(n)).drop("limited"), catalog) for n, mine in zip(self.rankers, among, strict=True)]
            # what the first ranker said already is not asked for again
            again = [a.join(left.filter(F.array_contains("limited", F.get("suited", F.lit(0)))), "query", "left_semi") for a in answers]
            return self._all([self._settled(answers, settled), self._together([*again, *more], catalog, queries)], queries)
        raise ValueError(f"no such strategy: {strategy}")

    def _settled(self, answers: list[DataFrame], settled: DataFrame | None) -> DataFrame | None:
        if settled is None:
            return None
        rows = self._union(answers).join(settled.withColumnRenamed("by", "algorithm"), ["query", "algorithm"], "left_semi")
        return self._plain(rows)

    @staticmethod
    def _plain(found: DataFrame | None) -> DataFrame | None:
        return None if found is None else found.select("query", F.col("place").alias("rank"), "id", "score", F.array("algorithm").alias("algorithms"))

    @staticmethod
    def _union(parts: list[DataFrame | None]) -> DataFrame | None:
        out = None
        for p in parts:
            out = p if out is None else out if p is None else out.unionByName(p)
        return out

    def _all(self, parts: list[DataFrame | None], queries: DataFrame) -> DataFrame:
        out = self._union(parts)
        none = queries.select("query", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("score"), F.array(F.lit("")).alias("algorithms")).limit(0)
        return none if out is None else out.select("query", F.col("rank").cast("int").alias("rank"), F.col("id").cast("long").alias("id"), "score", "algorithms")

    def _together(self, parts: list[DataFrame | None], catalog: DataFrame, queries: DataFrame, order: list[str] | None = None) -> DataFrame:
        found = self._union(parts)
        return self._all([None if found is None else put_together(found, catalog, order or list(self.rankers), self.k)], queries)

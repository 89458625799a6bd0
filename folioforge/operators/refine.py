"""Predictors registered by name, and the iterative refinement of a table of predictions by them.

A predictor is a set of column expressions: how confident it is of a row, and what it says of its fields. All registered ones are
compiled into one projection, so a row is read once however many there are.

Refinement takes, again and again, the rows of least confidence, lets the predictors judge them and keeps what they say, until
enough iterations or seconds have passed, a target is met or no rows are left. Its state stands in numbered Parquet versions: version
0 is the table as it was given, each further one holds the rows of one iteration only. The table as it is now is version 0
without the rows of later versions, and the last of those. A version counts once its metrics are in place, so a run that was
broken off goes on after the last whole iteration and gives the same table.
"""

from __future__ import annotations

import json
import time
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Files

#: From this confidence on, a prediction counts as consolidated; above the other one, a predictor's fields are taken.
CONSOLIDATED, TRUSTED = 0.8, 0.5


@dataclass(frozen=True)
class Predictor:
    """confidence: null where the predictor has nothing to say; fields: what it says of each field."""

    confidence: Column
    fields: Mapping[str, Column] = field(default_factory=dict)
    weight: float = 1.0


class Registry:
    """Predictors by name, in the order of their registration."""

    def __init__(self):
        self.predictors: dict[str, Predictor] = {}

    def register(self, name: str, confidence: Column, fields: Mapping[str, Column] | None = None, weight: float = 1.0) -> None:
        self.predictors[name] = Predictor(confidence, fields or {}, weight)

    def unregister(self, name: str) -> bool:
        return self.predictors.pop(name, None) is not None

    def apply(self, rows: DataFrame, fields: list[str], confidence: str = "confidence") -> DataFrame:
        """The rows with a new confidence, the weighted mean of what the predictors say, and with empty fields filled by the first one
        that is trusted. A row of which no predictor says anything stays as it is."""
        if not self.predictors:
            return rows
        said = {n: F.col(f"__said.{n}") for n in self.predictors}
        each = F.struct(*[F.struct(p.confidence.cast("double").alias("c"), *[v.cast("string").alias(f) for f, v in p.fields.items()]).alias(n) for n, p in self.predictors.items()])
        total = sum((F.coalesce(said[n]["c"] * p.weight, F.lit(0.0)) for n, p in self.predictors.items()), F.lit(0.0))
        weight = sum((F.when(said[n]["c"].isNotNull(), p.weight).otherwise(0.0) for n, p in self.predictors.items()), F.lit(0.0))
        new = {confidence: F.when(weight > 0, total / weight).otherwise(F.col(confidence))}
        for f in fields:
            found = [F.when(said[n]["c"] > TRUSTED, F.nullif(said[n][f], F.lit(""))) for n, p in self.predictors.items() if f in p.fields]
            new[f] = F.coalesce(F.nullif(f, F.lit("")), *found)
        return rows.withColumn("__said", each).select(*[new.get(c, F.col(c)).alias(c) for c in rows.columns])


@dataclass(frozen=True)
class Plan:
    """How long to go on. metric: accuracy (mean confidence), improvement or completeness, of an iteration's rows; every: results of each n-th iteration are kept."""

    batch: int = 50
    iterations: int | None = None
    seconds: float | None = None
    target: float | None = None
    metric: str = "accuracy"
    every: int = 1


class Refinement:
    """A table of predictions with columns confidence and the given fields, and its versions below a shared folder."""

    def __init__(self, spark: SparkSession, folder: str, key: str, fields: list[str]):
        self.spark, self.folder, self.key, self.fields = spark, folder, key, fields
        self.files = Files(spark, folder)

    def start(self, predictions: DataFrame) -> None:
        """Version 0, unless a run has begun already."""
        if not self.files.names("version=0/_SUCCESS"):
            predictions.withColumn("updated", F.lit(0)).write.mode("overwrite").parquet(f"{self.folder}/version=0")

    def metrics(self) -> list[dict]:
        """What each whole iteration did, in order."""
        return sorted((json.loads(self.files.read(n)) for n in self.files.names("metrics-*.json")), key=lambda m: m["iteration"])

    def current(self) -> DataFrame:
        """The table as it is now."""
        base = self.spark.read.parquet(f"{self.folder}/version=0")
        kept = [f"{self.folder}/version={m['iteration']}" for m in self.metrics() if m["kept"]]
        if not kept:
            return base
        later = self.spark.read.schema(base.schema).parquet(*kept)
        last = later.groupBy(self.key).agg(F.max_by(F.struct(*base.columns), "updated").alias("r")).select("r.*")
        return base.join(last.select(self.key), self.key, "left_anti").select(*base.columns).unionByName(last)

    def run(self, registry: Registry, plan: Plan, file_filter: Column | None = None) -> DataFrame:
        """Iterates until the plan says stop; the table as it then is. file_filter: which of the chosen rows are judged."""
        began, done = time.monotonic(), self.metrics()
        best = max((m["performance"] for m in done), default=0.0)
        number = len(done)
        while self._goes_on(plan, number, time.monotonic() - began, best):
            number += 1
            chosen = self.current().orderBy("confidence", "updated", self.key).limit(plan.batch)
            chosen = chosen if file_filter is None else chosen.filter(file_filter)
            judged = registry.apply(chosen.withColumn("__old", F.col("confidence")), self.fields)
            judged.withColumn("updated", F.lit(number)).write.mode("overwrite").parquet(f"{self.folder}/version={number}")
            rows = self.spark.read.parquet(f"{self.folder}/version={number}")
            share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
            of = {"accuracy": F.avg("confidence"), "improvement": share(F.col("confidence") > F.col("__old")), "completeness": share(F.col("confidence") >= CONSOLIDATED)}[plan.metric]
            found = rows.agg(F.count("*").alias("n"), of.alias("performance")).first()
            if not found.n:
                self.files.delete(f"version={number}")
                break
            best = max(best, found.performance)
            told = {"iteration": number, "rows": found.n, "performance": found.performance, "kept": number % plan.every == 0}
            self.files.publish(f"metrics-{number:06d}.json", json.dumps(told))
        return self.current()

    @staticmethod
    def _goes_on(plan: Plan, number: int, seconds: float, best: float) -> bool:
        if plan.iterations is not None and number >= plan.iterations:
            return False
        if plan.seconds is not None and seconds >= plan.seconds:
            return False
        return plan.target is None or best < plan.target

    def consolidated(self) -> DataFrame:
        """The rows that some kept iteration found sure enough, as the last such iteration left them."""
        kept = [f"{self.folder}/version={m['iteration']}" for m in self.metrics() if m["kept"]]
        base = self.spark.read.parquet(f"{self.folder}/version=0")
        rows = self.spark.read.schema(base.schema).parquet(*kept) if kept else base.limit(0)
        return rows.filter(F.col("confidence") >= CONSOLIDATED).groupBy(self.key).agg(F.max_by(F.struct(*base.columns), "updated").alias("r")).select("r.*")


def boosted(boost: Column) -> Column:
    """The confidence a row has, raised, 1 at most."""
    return F.least(F.lit(1.0), F.col("confidence") + boost)


def adapters() -> Registry:
    """The six adapters with their weights, over columns path, available (whether the file itself can be read), what a reader finds in it
    (in_title, in_author, in_year, in_publisher) and the fields title, author and year."""
    out, there = Registry(), F.col("available")
    full = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    count = lambda *cs: sum((full(F.col(c)).cast("int") for c in cs), F.lit(0))
    inside = {f: F.when(there, F.col(f"in_{f}")) for f in ("title", "author", "year")}
    stem = F.trim(F.regexp_replace("path", r"\.[A-Za-z0-9]+$", ""))
    part = lambda n: F.trim(F.regexp_extract(stem, r"^([^-]+)\s*-\s*([^(]+)\s*(?:\(([0-9]{4})\))?", n))
    named = {"author": part(1), "title": part(2), "year": part(3)}
    agreed = there & (F.lower(part(2)) == F.lower(F.trim("in_title")))
    out.register("comparison", boosted(F.when(agreed, 0.3).when(there, 0.15).otherwise(0.05)), inside, 2.0)
    out.register("extractor", boosted(F.when(there, F.least(F.lit(0.25), 0.1 + count("in_title", "in_author", "in_year") / 5 * 0.15)).otherwise(0.05)), inside, 1.8)
    out.register("rename", boosted(F.when(F.instr("path", " - ") > 0, 0.2).otherwise(0.1)), named, 1.5)
    out.register("basic", boosted(F.when(there, F.least(F.lit(0.15), 0.03 * count("in_title", "in_author", "in_year", "in_publisher"))).otherwise(0.05)), inside, 1.0)
    missing = lambda f: (~full(F.col(f)) & full(F.col(f"in_{f}"))).cast("int")
    out.register("enricher", boosted(F.least(F.lit(0.18), 0.04 * (missing("title") + missing("author") + missing("year")))), inside, 1.3)
    words = F.size(F.filter(F.split(stem, r"\s+"), lambda w: w != ""))
    signs = [F.instr("path", " - ") > 0, F.col("path").rlike("[0-9]{4}"), words >= 3, ~F.col("path").rlike(r"_{2,}|\.{2,}"), F.col("path").rlike(r"^\p{Lu}")]
    quality = sum((s.cast("int") for s in signs), F.lit(0)) / len(signs)
    pattern = F.when(part(3) != "", 0.15).when(part(2) != "", 0.12).when(stem.rlike(r"\([0-9]{4}\)"), 0.1).otherwise(0.08)
    out.register("filename", boosted(pattern * (0.5 + quality * 0.5)), named, 0.8)
    return out

"""Predictors and iterative refinement (inventory 2.11, 2.12): the file names' predictions, judged again and again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import refine
from folioforge.operators.tables import shared_folder
from folioforge.sources import derived as D

from .registry import query

_WF = D.over(D.FILES)
#: How long the registered query refines: its share of rows an iteration, and its iterations.
SHARE, ITERATIONS = 0.2, 6


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the file names alone tell, and what a reader would find within the files: PDF files can be read."""
    f = D.files(spark, sf_dir)
    none = F.lit(None).cast("string")
    return f.select(
        "id", "path", (F.col("ext") == "pdf").alias("available"), F.col("title").alias("in_title"), F.get("authors", F.lit(0)).alias("in_author"), F.col("year").alias("in_year"), F.col("publisher").alias("in_publisher"),
        none.alias("title"), none.alias("author"), none.alias("year"), F.round(T.guess_confidence(F.col("path")), 6).alias("confidence"),
    )


@query()
def x2_refined_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predictions after six iterations over the fifth of them that is least sure, and the iteration that last judged each."""
    rows = predictions(spark, sf_dir)
    run = refine.Refinement(spark, shared_folder(spark), "id", ["title", "author", "year"])
    run.start(rows)
    plan = refine.Plan(batch=max(1, int(SHARE * rows.count())), iterations=ITERATIONS)
    return run.run(refine.adapters(), plan).select("id", "title", "author", "year", F.round("confidence", 6).alias("confidence"), "updated")


_STEM = r"trim(regexp_replace(path, '\.[A-Za-z0-9]+$', ''))"
_PART = r"trim(regexp_extract(" + _STEM + r", '^([^-]+)\s*-\s*([^(]+)\s*(?:\(([0-9]{{4}})\))?', {}))"
_FULL = "CAST(coalesce(trim({}) <> '', false) AS INTEGER)"


@query(
    _WF
    + f"""SELECT id, unnest(['basic', 'comparison', 'enricher', 'extractor', 'filename', 'rename']) AS adapter, unnest([
CASE WHEN pdf THEN least(0.15, 0.03 * (t + a + 1 + p)) ELSE 0.05 END, CASE WHEN pdf AND lower(part2) = lower(trim(title)) THEN 0.3 WHEN pdf THEN 0.15 ELSE 0.05 END, least(0.18, 0.04 * (t + a + 1)),
CASE WHEN pdf THEN least(0.25, 0.1 + (t + a + 1) / 5 * 0.15) ELSE 0.05 END,
(CASE WHEN part3 <> '' THEN 0.15 WHEN part2 <> '' THEN 0.12 WHEN regexp_matches(stem, '\\([0-9]{{4}}\\)') THEN 0.1 ELSE 0.08 END) * (0.5 + 0.5 * signs / 5), CASE WHEN contains(path, ' - ') THEN 0.2 ELSE 0.1 END])::DOUBLE AS boost
FROM (SELECT id, path, title, ext = 'pdf' AS pdf, {_STEM} AS stem, {_PART.format(2)} AS part2, {_PART.format(3)} AS part3, {_FULL.format("title")} AS t, {_FULL.format("authors[1]")} AS a, {_FULL.format("publisher")} AS p,
CAST(contains(path, ' - ') AS INTEGER) + CAST(regexp_matches(path, '[0-9]{{4}}') AS INTEGER) + CAST(len(list_filter(regexp_split_to_array({_STEM}, '\\s+'), lambda w: w <> '')) >= 3 AS INTEGER) + CAST(NOT regexp_matches(path, '_{{2,}}|\\.{{2,}}') AS INTEGER) + CAST(regexp_matches(path, '^[A-Z]') AS INTEGER) AS signs FROM files)"""
)
def u3_adapter_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By how much each of the six adapters would raise the confidence of each prediction: one projection, exploded."""
    rows = predictions(spark, sf_dir).withColumn("confidence", F.lit(0.0))
    all_of = F.array(*[F.struct(F.lit(n).alias("adapter"), p.confidence.alias("boost")) for n, p in refine.adapters().predictors.items()])
    return rows.select("id", F.explode(all_of).alias("a")).select("id", "a.adapter", F.round("a.boost", 9).alias("boost"))

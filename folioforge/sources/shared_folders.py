"""Files of shared folders: listings of folders, and what a shared folder's page tells of its files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators.tables import Files, written

#: Extensions of a scan, of a wide scan, and of files on pages.
SCAN, WIDE, ON_PAGES = ("pdf", "epub", "mobi"), ("pdf", "epub", "mobi", "azw", "azw3"), ("pdf", "epub", "mobi", "doc", "docx", "txt")
#: How pages name files, and the keys below which their JSON holds more.
PATTERNS = (r'"name":\s*"([^"]+\.(?:{}))"', r'data-file-name="([^"]+\.(?:{}))"', r'title="([^"]+\.(?:{}))"')
CONFIG, INNER = r"(?s)window\._cfg\s*=\s*(\{.*?\});", ("files", "items", "children", "content")


def collect_files(spark: SparkSession, folder: str, subdirs: Sequence[str] | None = None, recursive: bool = False, extensions: Sequence[str] = SCAN) -> DataFrame:
    """path, ext, length, modified of a folder's files: at any depth; or of the named folders in it that exist; or of the folder alone. Spark
    lists them, in parallel where there are many; contents are not read."""
    files = Files(spark, folder)
    glob = "*.{" + ",".join(extensions) + "}"
    source = spark.read.format("binaryFile")
    if recursive:
        found = source.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    else:
        there = [f"{folder}/{d}/{glob}" for d in subdirs if files.names(f"{d}/{glob}")] if subdirs is not None else [f"{folder}/{glob}"] if files.names(glob) else []
        found = source.load(there) if there else spark.createDataFrame([], "path string, modificationTime timestamp, length bigint")
    return found.select("path", F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).alias("ext"), "length", F.col("modificationTime").alias("modified"))


def extension_counts(files: DataFrame, extensions: Sequence[str] = SCAN) -> DataFrame:
    """ext and total: how many files there are of each of the extensions, 0 included."""
    all_of = files.sparkSession.createDataFrame([(e,) for e in extensions], "ext string")
    return all_of.join(files.groupBy("ext").agg(F.count("*").alias("n")), "ext", "left").select("ext", F.coalesce("n", F.lit(0)).alias("total"))


def named_on_pages(pages: DataFrame, key: str, html: Column) -> DataFrame:
    """key, name, size (null), ext and source: the distinct file names that the patterns find on each page."""
    found = [F.regexp_extract_all(html, F.lit("(?i)" + p.format("|".join(ON_PAGES))), F.lit(1)) for p in PATTERNS]
    names = pages.select(key, F.explode(F.array_distinct(F.concat(*found))).alias("name"))
    return names.select(key, "name", F.lit(None).cast("long").alias("size"), _extension(F.col("name")).alias("ext"), F.lit("web_scraping").alias("source"))


def _extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))


def in_json(pages: DataFrame, key: str, json: Column) -> DataFrame:
    """key, name, size, ext and source: every object with a name and a size, and a name of a file, at any depth below the inner keys.

    Values are walked level by level: a level's objects give their files and the values below their inner keys, lists their elements. Each
    level is one map over what is left of the documents; texts that are no JSON give nothing. An object stands once for each time it is met.
    """
    level = written(pages.select(key, F.try_parse_json(json).alias("v")).filter("v is not null"))
    files = None
    while not level.isEmpty():
        kind = F.schema_of_variant("v")
        objects, lists = level.filter(kind.startswith("OBJECT")), level.filter(kind.startswith("ARRAY"))
        name, size = F.try_variant_get("v", "$.name", "string"), F.try_variant_get("v", "$.size", "variant")
        found = objects.select(key, name.alias("name"), F.try_variant_get("v", "$.size", "long").alias("size"), size.isNotNull().alias("sized"))
        found = found.filter(F.col("sized") & F.lower("name").rlike(r"\.(" + "|".join(ON_PAGES) + ")$"))
        found = found.select(key, "name", F.coalesce("size", F.lit(0)).alias("size"), _extension(F.col("name")).alias("ext"), F.lit("json_extraction").alias("source"))
        files = found if files is None else files.unionByName(found)
        below = objects.select(key, F.explode(F.array(*[F.try_variant_get("v", f"$.{k}", "variant") for k in INNER])).alias("v"))
        elements = lists.select(key, F.explode(F.try_variant_get("v", "$", "array<variant>")).alias("v"))
        level = written(below.unionByName(elements).filter("v is not null"))
    none = pages.select(key, F.lit("").alias("name"), F.lit(0).cast("long").alias("size"), F.lit("").alias("ext"), F.lit("").alias("source")).limit(0)
    return none if files is None else files


def folder_files(pages: DataFrame, key: str, html: Column) -> DataFrame:
    """What both ways find on each page of a shared folder: names by the patterns, and the objects of the page's settings."""
    config = F.nullif(F.regexp_extract(html, CONFIG, 1), F.lit(""))
    return named_on_pages(pages, key, html).unionByName(in_json(pages, key, config))

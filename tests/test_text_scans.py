"""Whole texts are scanned by few expressions, not letter by letter, and not twice for the same words."""

import re

from __spark_entry__ import queries
from folioforge.functions import filenames as N
from folioforge.operators import quality as Q
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_broken_lines_are_not_taken_apart(spark):
    lines = ["", " ", "a b c d", "a b c de fgh", " a b c d ", "\ta b c\x0b d ", "a  b\tc 😀", "aab bcc dd", "aaaaaa", "AAbbÀÀ cc", "a-a-a-a-a-a", "abcabc", "aabbcd", "aabbccd", "x y z\r", "KKkk kk", None]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, s string").select("i", Q.many_singles(F.col("s")).alias("a"), Q.repeated_letters(F.col("s")).alias("b"))

    def singles(s):
        t = re.split(r"[ \t\n\x0b\f\r]+", s.strip(" "))
        return len(t) >= 4 and sum(len(w) == 1 for w in t) >= 0.6 * len(t)

    def repeated(s):
        t = re.findall("[a-z]", s.lower())
        return len(t) >= 6 and sum(x == y for x, y in zip(t, t[1:])) >= 0.45 * (len(t) - 1)

    got = {r.i: (r.a, r.b) for r in df.collect()}
    assert got == {i: (s is not None and singles(s), s is not None and repeated(s)) for i, s in enumerate(lines)}
    for name in ("f18_broken_text", "t6_artifact_cleanup"):
        assert "lambda" not in plan_of(queries()[name](spark, SF))


def test_categories_from_the_terms_that_were_found(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select(F.lower("text").alias("low")).limit(100)
    rows = rows.unionByName(spark.createDataFrame([(w + " " + x,) for w, x in zip(N.TERMS, N.TERMS[7:])] + [("",)], "low string"))
    both = rows.withColumn("found", N.keywords(F.col("low"))).select(N.category(F.col("low")).alias("a"), N.category(F.col("low"), F.col("found")).alias("b"))
    assert both.filter("not (a <=> b)").isEmpty() and both.select("a").distinct().count() > 3


def test_one_scan_finds_the_terms_of_a_text(spark):
    texts = [a + b for a in N.TERMS for b in ("", " ", "s", *N.TERMS[::23])] + ["javascripting", "xjavax", "machine\nlearning", "", "a😀ai", "...net core", "c++c#", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, low string").select("i", N.keywords(F.col("low")).alias("found"))
    assert {r.i: r.found for r in df.collect()} == {i: None if s is None else [w for w in N.TERMS if w in s] for i, s in enumerate(texts)}
    for name in ("t13_category", "t14_keywords"):
        plan = plan_of(queries()[name](spark, SF))
        assert plan.count("regexp_extract_all") == 1 and (name != "t13_category" or "Contains(" not in plan)

"""Folding, file names and word lists on small cases; eviction within one day and one second."""

import random

from pyspark.sql import functions as F

from folioforge.functions import filenames as N
from folioforge.operators import catalog


def values(spark, f, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.v for r in df.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_letters_are_folded(spark):
    cases = {"Zażółć gęślą jaźń": "Zazolc gesla jazn", "İstanbul ığdır çağ şey": "Istanbul igdir cag sey", "Ærøskøbing Straße œuvre": "AEroskobing Strasse oeuvre", "Ho Chí Minh Đà Nẵng": "Ho Chi Minh Da Nang", "été": "ete", "日本 αβγ": "日本 αβγ", "": ""}
    assert values(spark, N.folded, cases) == list(cases.values())
    assert values(spark, N.folded, [None]) == [None]
    assert len(N.FOLDS) > 300


def test_ground_truth_of_names(spark):
    names = ["Jane Doe - Mastering Clean Code (2019).pdf", "João Silva - Guia Completo.epub", "1984 - Title here.pdf", "www site - Title here.pdf", "No author in this name (2001).mobi", "ab - Short author.pdf", "x.pdf", None]
    df = spark.createDataFrame(list(enumerate(names)), "i int, p string")
    rows = df.select("i", *[c.alias(k) for k, c in N.ground_truth(F.col("p")).items()]).orderBy("i").collect()
    assert tuple(rows[0])[1:] == ("Mastering Clean Code", "Jane Doe", "Packt", "2019")
    assert tuple(rows[1])[1:] == ("Guia Completo", "Joao Silva", "", "")
    assert [r.author for r in rows[2:6]] == ["", "", "", ""] and rows[4].title == "No author in this name" and rows[4].year == "2001"
    assert rows[6].title == ""


def test_category_subcategory_and_language(spark):
    df = spark.createDataFrame([(0, "python and java"), (1, "nothing here"), (2, "machine learning"), (3, "guia de malware forensics"), (4, "docker")], "i int, t string")
    main = N.category(F.col("t"))
    rows = df.select("i", main.alias("m"), N.subcategory(F.col("t"), main).alias("s"), N.keywords(F.col("t")).alias("k"), N.language(F.col("t")).alias("l")).orderBy("i").collect()
    assert [r.m for r in rows] == ["Programming", "General", "AI_ML", "Security", "DevOps"]  # docker: the first of equal ones
    assert [r.s for r in rows] == ["Python", "", "", "Malware", ""]
    assert rows[2].k == ["machine learning"] and rows[3].l == "Portuguese" and rows[0].l == "English"


def test_eviction_within_a_day_and_a_second(spark):
    rng = random.Random(1)
    rows = [(f"k{i}", rng.randrange(1, 50), 86_400 * 3 + (7 if i < 200 else rng.randrange(86_400))) for i in range(500)]
    got = {r.k: r for r in catalog.evict(spark.createDataFrame(rows, "k string, size bigint, at bigint"), "size", "at", "k", 4000).collect()}
    assert len(got) == 500
    order = sorted(got.values(), key=lambda r: r.running)
    assert [r.at for r in order] == sorted((r[2] for r in rows), reverse=True)
    total = 0
    for r in order:
        total += r["size"]
        assert r.running == total and r.kept == (total <= 4000)

"""Unit vectors of functions and sources: nulls, empties, accents, ties."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from folioforge.functions import isbn, similarity, text
from folioforge.operators import catalog, metrics, quality, ranking
from folioforge.sources import formats


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_isbn_vectors(spark):
    c = F.col("s")
    rows = [("978-0-13-235088-4",), ("9780132350885",), ("0-13-235088-2",), ("080442957X",), ("080442957x",), ("",), (None,), ("97801323508",), ("978O13235O884",)]
    got = values(spark, rows, "s string", isbn.valid13(c), isbn.valid10(c), isbn.normal13(c))
    assert got == [(True, False, "9780132350884"), (False, False, None), (False, True, "9780132350884"), (False, True, "9780804429573"), (False, True, "9780804429573"), (False, False, None), (False, False, None), (False, False, None), (False, False, None)]
    good, raw = isbn.repaired(c)
    assert values(spark, [("978O13235O884",), (None,)], "s string", good)[0] == (["9780132350884"],)
    assert values(spark, [("see ISBN 978-0-13-235088-4 and 0132350882.",), ("none",), (None,)], "s string", isbn.extract_all(c)) == [(["0132350882", "9780132350884"],), ([],), (None,)]


def test_missing_and_dates(spark):
    c = F.col("s")
    rows = [(None,), ("",), ("Unknown",), ("N/A",), ("1899",), ("1900",), ("2026",), ("2020-13",), ("2020-02-30",), ("2020-02-29",), ("8400",)]
    assert values(spark, rows, "s string", catalog.is_missing(c), catalog.is_missing(c, wide=True), quality.valid_date(c, 2025)) == [
        (True, True, False), (True, True, False), (True, True, False), (False, True, False), (False, False, False), (False, False, True), (False, False, False), (False, False, False), (False, False, False), (False, False, True), (False, False, False),
    ]


def test_text_vectors(spark):
    c = F.col("s")
    assert values(spark, [("“Café”  –  x",), (None,)], "s string", text.spaces(c), text.strip_accents(c)) == [('"Café" - x', "“Cafe”  –  x"), (None, None)]
    assert values(spark, [("Jane Doe - My_Book (2001).pdf",), ("plain",), ("",)], "s string", *text.from_filename(c)) == [("Jane Doe", "My Book", "2001"), (None, "plain", None), (None, "", None)]
    assert values(spark, [("a b c",), ("a",), ("",)], "s string", text.ngrams(F.filter(F.split(c, " "), lambda x: x != ""), 2)) == [(["a b", "b c"],), ([],), ([],)]


def test_similarities():
    assert similarity.jaro("martha", "marhta") == pytest.approx(0.944444, abs=1e-6)
    assert similarity.jaro("abcxyz", "bcaxyz") == pytest.approx(0.916667, abs=1e-6)
    assert similarity.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert similarity.jaro("", "x") == 0.0 and similarity.jaro("", "") == 1.0


def test_upserts_and_eviction(spark):
    old = spark.createDataFrame([("a", 0.5), ("b", None)], "k string, s double")
    new = spark.createDataFrame([("a", 0.4), ("b", 0.1), ("c", 0.9)], "k string, s double")
    assert sorted(map(tuple, catalog.upsert(old, new, ["k"]).collect())) == [("a", 0.4), ("b", 0.1), ("c", 0.9)]
    assert sorted(map(tuple, catalog.insert_or_ignore(old, new, ["k"]).collect()), key=str) == [("a", 0.5), ("b", None), ("c", 0.9)]
    assert sorted((r.k, r.s) for r in catalog.improve_only(old, new, "k", "s").collect()) == [("a", 0.5), ("b", 0.1)]
    entries = spark.createDataFrame([("x", 10, 5), ("y", 10, 86400 * 3), ("z", 10, 86400 * 3 + 1)], "k string, size bigint, at bigint")
    assert {r.k: r.kept for r in catalog.evict(entries, "size", "at", "k", 20).collect()} == {"x": False, "y": True, "z": True}


def test_top_k_ties(spark):
    scored = spark.createDataFrame([(1, 3, 0.5), (1, 1, 0.5), (1, 2, 0.9)], "query int, id int, score double")
    assert sorted((r.rank, r.id) for r in ranking.top_k(scored, 2).collect()) == [(1, 2), (2, 1)]


def epub(path, **fields):
    opf = '<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata>' + "".join(f"<dc:{k}>{v}</dc:{k}>" for k, v in fields.items()) + "</metadata></package>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("content.opf", opf)


def test_formats(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    epub(tmp_path / "a.epub", title="Main: Sub", creator="Jane Doe", publisher="House", date="2001-05", identifier="urn:isbn:9780132350884")
    (tmp_path / "sub" / "broken.epub").write_bytes(b"no zip")
    (tmp_path / "sub" / "b.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "note.txt").write_text("x")
    assert sorted(r.ext for r in formats.book_files(spark, str(tmp_path)).collect()) == ["epub", "epub", "pdf"]
    assert sorted((tuple(r)[1:7] for r in formats.read_epubs(spark, str(tmp_path)).collect()), key=str)[0] == ("Main", "Sub", "Jane Doe", "House", "2001", "9780132350884")
    (tmp_path / "new.json").write_text(json.dumps({"successful_extractions": [{"title": "T", "authors": ["A"], "published_date": "2001-05", "file_path": "p"}]}))
    (tmp_path / "old.json").write_text(json.dumps([{"path": "q", "metadata": {"title": "U", "published_date": "1999"}}]))
    got = [(r.title, r.year, r.file_path) for f in ("new.json", "old.json") for r in formats.read_report(spark, str(tmp_path / f)).collect()]
    assert got == [("T", "2001", "p"), ("U", "1999", "q")]
    (tmp_path / "r.csv").write_text("Arquivo,Proposto\na.pdf,b.pdf\nc.pdf,c.pdf\n")
    assert [tuple(r) for r in formats.read_rename_csv(spark, str(tmp_path / "r.csv")).collect()] == [("a.pdf", "b.pdf")]
    assert formats.epub_fields(None) == (None,) * 6 and isinstance(io.BytesIO(), io.BytesIO)


def test_rows_of_one_path_are_all_promoted(spark, monkeypatch):
    from folioforge.plans import catalog_queries

    rows = [("a", 0.9), ("a", 0.8), ("a", 0.8), ("b", 0.7), ("c", 0.95)]
    monkeypatch.setattr(catalog_queries.D, "files", lambda *_: spark.createDataFrame(rows, "path string, confidence double"))
    assert sorted(map(tuple, catalog_queries.m8_promote(spark, "").collect())) == [("a", 0.8), ("a", 0.8), ("a", 0.9), ("c", 0.95)]
    old = spark.createDataFrame([("a", 0.1), ("d", 0.2)], "path string, confidence double")
    new = spark.createDataFrame(rows[:2], old.schema)
    assert sorted(map(tuple, catalog.replace_keys(old, new, ["path"]).collect())) == [("a", 0.8), ("a", 0.9), ("d", 0.2)]


def test_slow_calls_that_took_twice_the_mean_are_no_ties_of_rounding(spark):
    times = {"a": [8.6, 3.85, 24.9], "b": [8.6, 3.85, 24.91], "c": [1 / 3, 2 / 3, 9.0], "d": [1.0, None, 4.0], "e": [0.0, 0.0]}
    rows = [(100 * i + j, api, x) for i, (api, xs) in enumerate(times.items()) for j, x in enumerate(xs)]
    events = spark.createDataFrame(rows, "event_id long, api string, response_time double").withColumn("ts", F.timestamp_seconds("event_id"))
    assert sorted(r.event_id for r in metrics.slow(events).collect()) == [102, 202]
    assert (8.6 + 3.85 + 24.9) / 3 * 2 < 24.9  # as doubles


def test_slow_operations_at_twice_the_mean_and_without_a_time_equal_their_sql(spark, tmp_path):
    import random

    import duckdb

    from folioforge.plans import registry

    rng, rows = random.Random(5), []
    for api in range(120):
        before = 2 + api % 60
        cents = [rng.randrange(1, 20000) for _ in range(before)]
        cents[-1] += -2 * sum(cents) % (before - 1)
        cents.append(2 * sum(cents) // (before - 1))  # exactly twice the mean of all
        rows += [(1000 * api + i, None if api > 100 and i % 7 == 3 else 60 * i, str(api), c / 100) for i, c in enumerate(cents)]
    events = spark.createDataFrame(rows, "event_id long, at long, event_type string, value double")
    events.select("event_id", F.timestamp_seconds("at").alias("ts"), F.lit(1).cast("long").alias("user_id"), "event_type", "value").write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(r.event_id for r in registry.queries()["a26_slow_operations"](spark, str(tmp_path)).collect())
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == sorted(r[0] for r in duck.execute(registry.oracle_sql()["a26_slow_operations"]).fetchall())

"""Files as they lie in folders, and the streams' sinks."""

import zlib

from pyspark.sql import functions as F

from folioforge.plans import file_queries
from folioforge.sources import formats
from folioforge.streaming import jobs

#: Queries over files without a SQL twin.
FILE_QUERIES = ()


def test_pdfs_of_a_folder(spark, tmp_path):
    lines = [f"line {i} é (x)" for i in range(60)]
    (tmp_path / "a.pdf").write_bytes(file_queries.make_pdf(lines, "9780132350884"))
    page = b"BT (plain \\(text\\) \\101) Tj T* [(two) -250 ( parts)] TJ ET"
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4\n4 0 obj << /Type /Page /Contents [5 0 R 6 0 R] >> endobj\n5 0 obj << /Length 9 >> stream\n" + page + b"\nendstream endobj\n6 0 obj << /Filter /FlateDecode >> stream\n" + zlib.compress(b"(more) Tj") + b"\nendstream endobj")
    (tmp_path / "c.pdf").write_bytes(b"not a pdf")
    (tmp_path / "d.txt").write_bytes(b"")
    got = {r.path.rsplit("/")[-1]: r for r in formats.read_pdfs(spark, str(tmp_path), 2).collect()}
    assert set(got) == {"a.pdf", "b.pdf", "c.pdf"} and got["c.pdf"].text == ""
    assert [x for x in got["a.pdf"].text.split("\n") if x] == lines[:50] and "ISBN 9780132350884" in got["a.pdf"].info
    assert got["b.pdf"].text == "plain (text) A\ntwo parts\nmore"


def test_epubs_of_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.epub").write_bytes(file_queries.make_epub("A & B: the rest", "Ann Poe", "House", "2020-05", "9780132350884"))
    (tmp_path / "b.epub").write_bytes(b"no zip")
    got = {r.path.rsplit("/")[-1]: r for r in formats.read_epubs(spark, str(tmp_path)).collect()}
    assert tuple(got["a.epub"])[1:7] == ("A & B", "the rest", "Ann Poe", "House", "2020", "9780132350884")
    assert got["a.epub"].text == "A & B: the rest\nISBN 9780132350884" and got["b.epub"].title is None and got["b.epub"].text is None


def test_html_report_escapes(spark):
    rows = spark.createDataFrame([(1, "<b> & c"), (2, None)], "id bigint, title string")
    got = [r.value for r in formats.html_report(rows, "x").collect()]
    assert "<tr><td>1</td><td>&lt;b&gt; &amp; c</td></tr>" in got and "<tr><td>2</td><td></td></tr>" in got


def test_upserts_go_on_from_the_table(spark, tmp_path):
    source, table = tmp_path / "in", str(tmp_path / "table")
    rows = lambda *x: spark.createDataFrame(x, "path string, ts timestamp, v bigint")
    at = lambda n: __import__("datetime").datetime(2024, 1, n)
    schema = rows().schema if False else spark.createDataFrame([], "path string, ts timestamp, v bigint").schema
    stream = lambda: spark.readStream.schema(schema).parquet(str(source))
    rows(("a", at(1), 1), ("b", at(1), 1), ("a", at(2), 2)).write.mode("append").parquet(str(source))
    jobs.upsert_batches(stream(), table, ["path"], str(tmp_path / "c1")).awaitTermination()
    rows(("b", at(3), 3), ("c", at(1), 1)).write.mode("append").parquet(str(source))
    jobs.upsert_batches(stream(), table, ["path"], str(tmp_path / "c1")).awaitTermination()
    want = [("a", 2), ("b", 3), ("c", 1)]
    version, held = jobs.upserted(spark, table)
    assert version == 1 and sorted((r.path, r.v) for r in held.collect()) == want
    jobs.upsert_batches(stream(), table, ["path"], str(tmp_path / "c2")).awaitTermination()  # a new checkpoint: all again
    version, held = jobs.upserted(spark, table)
    assert version == 2 and sorted((r.path, r.v) for r in held.collect()) == want
    assert jobs.upserted(spark, str(tmp_path / "none")) is None


def test_stream_results_are_files(spark, tmp_path):
    events = spark.createDataFrame([(i, i % 3) for i in range(30)], "id bigint, k bigint")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = jobs.run_now(stream.groupBy("k").agg(F.count("*").alias("n")), "complete", str(tmp_path / "a"))
    assert sorted(map(tuple, got.collect())) == [(0, 10), (1, 10), (2, 10)]
    assert jobs.run_now(stream.filter("k = 1"), "append", str(tmp_path / "b")).count() == 10


def test_files_are_handed_on_in_pieces():
    import pandas as pd
    from folioforge.sources import formats

    frame = pd.DataFrame({"path": [str(i) for i in range(1200)], "content": [None if i % 7 == 0 else b"x" * (5_000_000 if i % 400 == 5 else 10 * i) for i in range(1200)]}, index=range(50, 1250))
    cut = list(formats.pieces(iter([frame, frame[:0]])))
    assert pd.concat(cut).equals(frame) and max(map(len, cut)) <= formats.FILES
    sizes = [sum(len(c) for c in f["content"] if c) for f in cut]
    assert all(n <= formats.FILE_BYTES or len(f) == 1 for n, f in zip(sizes, cut))

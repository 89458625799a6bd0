"""Listings by mode, and pages of shared folders against a recursive walk."""

import json
import random
import re

from pyspark.sql import functions as F

from folioforge.sources import shared_folders as X
from folioforge.streaming import jobs


def test_listing_modes(spark, tmp_path):
    for name in ("a.pdf", "b.epub", "B.PDF", "note.txt", "one/c.pdf", "one/d.azw3", "two/deep/e.mobi", "two/f.pdf"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * len(name))
    names = lambda df: sorted(r.path.split(f"{tmp_path.name}/")[1] for r in df.collect())
    root = f"file://{tmp_path}"
    assert names(X.collect_files(spark, root)) == ["a.pdf", "b.epub"]
    assert names(X.collect_files(spark, root, ["one", "none", "two"])) == ["one/c.pdf", "two/f.pdf"]
    assert names(X.collect_files(spark, root, ["none"])) == [] == names(X.collect_files(spark, root, []))
    every = X.collect_files(spark, root, recursive=True, extensions=X.WIDE)
    assert names(every) == ["a.pdf", "b.epub", "one/c.pdf", "one/d.azw3", "two/deep/e.mobi", "two/f.pdf"]
    assert {r.ext: r.total for r in X.extension_counts(every, X.WIDE).collect()} == {"pdf": 3, "epub": 1, "mobi": 1, "azw": 0, "azw3": 1}
    assert {r.length for r in every.collect()} == {5, 6, 9, 10, 15}


def tree(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return rng.choice([1, "x.pdf", None, True, {"name": "leaf.pdf", "size": 3}, {"name": "no size.pdf"}, {"name": "a.exe", "size": 1}, {"name": "Up.EPUB", "size": 2}])
    if rng.random() < 0.4:
        return [tree(rng, depth - 1) for _ in range(rng.randrange(4))]
    out = {k: tree(rng, depth - 1) for k in rng.sample(["files", "items", "children", "content", "other"], rng.randrange(4))}
    return out | ({"name": f"n{rng.randrange(9)}.txt", "size": rng.randrange(9)} if rng.random() < 0.3 else {})


def walk(v):
    if isinstance(v, dict):
        if "name" in v and "size" in v and re.search(r"\.(pdf|epub|mobi|doc|docx|txt)$", v["name"].lower()):
            yield v["name"], v["size"]
        for k in v:
            if k in X.INNER:
                yield from walk(v[k])
    elif isinstance(v, list):
        for x in v:
            yield from walk(x)


def test_pages_against_a_recursive_walk(spark):
    rng = random.Random(11)
    trees = [tree(rng, rng.randrange(7)) for _ in range(120)]
    rows = [(i, f"<p data-file-name='no.pdf' data-file-name=\"Some file.PDF\" title=\"t.doc\"> window._cfg =\n{json.dumps(t)};</p>") for i, t in enumerate(trees)]
    rows += [(900, None), (901, ""), (902, "window._cfg = {not json};"), (903, '"name": "a.pdf" "name":"a.pdf" "name": "b.exe"')]
    got = X.folder_files(spark.createDataFrame(rows, "id int, html string"), "id", F.col("html")).collect()
    found = sorted((r["id"], r["name"], r["size"]) for r in got if r.source == "json_extraction")
    # only settings that are an object stand on a page
    assert found == sorted((i, *f) for i, t in enumerate(trees) if isinstance(t, dict) for f in walk(t)) and len(found) > 60
    pages = {(r["id"], r["name"], r.ext) for r in got if r.source == "web_scraping"}
    assert {(0, "Some file.PDF", ".pdf"), (0, "t.doc", ".doc"), (903, "a.pdf", ".pdf")} <= pages
    assert sum(p[0] == 903 for p in pages) == 1 and not any(p[0] in (900, 901, 902) for p in pages)


def test_alerts_call_back(spark, tmp_path):
    import datetime

    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    rows = [(1, "a", True, 5.0, at(1), 1), (2, "a", False, 5.0, at(2), 1), (3, "b", True, 500.0, at(3), 1), (4, "c", True, 5.0, at(4), 1)]
    schema = "event_id bigint, api string, success boolean, response_time double, ts timestamp, user_id bigint"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    jobs.alerts(stream, lambda batch, number: seen.extend((r.api, r.errors) for r in batch.collect()), str(tmp_path / "c")).awaitTermination()
    assert sorted(seen) == [("a", 1), ("b", 0)]

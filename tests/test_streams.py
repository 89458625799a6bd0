"""Streams against batch for events in any order, late events, and tables of which upserts rewrite few buckets."""

import datetime
import os
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from folioforge.operators import metrics
from folioforge.operators.buckets import BucketTable
from folioforge.streaming import jobs

SCHEMA = "event_id bigint, api string, success boolean, response_time double, ts timestamp, user_id bigint"
START = datetime.datetime(2024, 1, 1)


def events(n, seed=4):
    rng = random.Random(seed)
    return [(i, rng.choice(["a", "b"]), rng.random() < 0.6, float(rng.randrange(100)), START + datetime.timedelta(seconds=rng.randrange(6 * 3600)), rng.randrange(4)) for i in range(n)]


def stream_of(spark, rows, folder, files):
    """The rows as a stream, file after file."""
    for k in range(files):
        spark.createDataFrame(rows[k::files] or [], SCHEMA).coalesce(1).write.parquet(f"{folder}/{k}")
        os.utime(f"{folder}/{k}", (1000 + k, 1000 + k))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_trailing_hour_of_shuffled_events_equals_batch(spark, tmp_path):
    rows = events(400)
    whole = spark.createDataFrame(rows, SCHEMA)
    # the delay is longer than any event is out of order
    got = jobs.run_now(jobs.trailing(stream_of(spark, rows, tmp_path / "in", 5), "7 hours"), "append", str(tmp_path / "out"))
    assert got.count() == 0  # no window is closed yet
    closing = [*rows, (9999, "a", True, 1.0, START + datetime.timedelta(hours=30), 1)]
    got = jobs.run_now(jobs.trailing(stream_of(spark, closing, tmp_path / "in2", 1), "7 hours"), "append", str(tmp_path / "out2"))
    want = jobs.trailing(whole).filter(F.col("until") <= START + datetime.timedelta(hours=23))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 60
    for r in want.collect()[:5]:
        own = [e for e in rows if e[1] == r.api and r.until - datetime.timedelta(hours=1) <= e[4] < r.until]
        assert len(own) == r.calls and sum(not e[2] for e in own) == r.errors


def test_breaker_of_shuffled_events_equals_batch_and_drops_late_ones(spark, tmp_path):
    rows = events(200, 8)
    flush = (9999, "a", True, 1.0, START + datetime.timedelta(hours=30), 77)
    want = sorted((r.user_id, r.event_id, r.failures, r.cooldown) for r in metrics.breaker(spark.createDataFrame(rows, SCHEMA)).collect())
    with jobs.with_rocksdb(spark):
        source = stream_of(spark, [*rows, flush], tmp_path / "in", 3)
        got = jobs.run_now(jobs.breaker(source, "7 hours"), "append", str(tmp_path / "out"))
        assert sorted(map(tuple, got.collect())) == want
        # an event from before the watermark comes in a later batch: it is dropped, and changes no count
        late = (5, "a", False, 1.0, START, rows[0][5])
        for k, part in enumerate([[*rows, flush], [late, (10_000, "a", True, 1.0, START + datetime.timedelta(hours=60), 77)]]):
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/late/{k}")
            for name in os.listdir(f"{tmp_path}/late/{k}"):
                os.utime(f"{tmp_path}/late/{k}/{name}", (1000 + k, 1000 + k))
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/late/*")
        got = jobs.run_now(jobs.breaker(source, "7 hours"), "append", str(tmp_path / "out2"))
        assert sorted(r for r in map(tuple, got.collect()) if r[0] != 77) == want


def times(folder):
    return {p: os.path.getmtime(os.path.join(d, p)) for d, _, names in os.walk(folder) for p in names if p.endswith(".parquet") for p in [os.path.join(d, p)]}


def test_an_upsert_rewrites_the_buckets_it_touches(spark, tmp_path):
    table = BucketTable(spark, f"file://{tmp_path}/t", ["k"], buckets=8)
    assert table.read() is None and table.manifest() is None
    rows = lambda *x: spark.createDataFrame(x, "k string, v bigint, ts bigint")
    table.upsert(rows(*[(f"k{i}", i, 1) for i in range(100)], (None, 7, 1)))
    before, named = times(tmp_path), table.manifest()["folders"]
    assert table.upsert(rows(("k5", 500, 2), ("new", 1, 2), (None, 8, 2)), source="s", batch=3)
    after = table.manifest()["folders"]
    changed = [b for b in after if after[b] != named.get(b)]
    assert 1 <= len(changed) <= 3 < len(after)
    assert all(times(tmp_path)[p] == t for p, t in before.items())  # other buckets keep their files and times
    held = {r.k: r.v for r in table.read().collect()}
    assert len(held) == 102 and held["k5"] == 500 and held[None] == 8 and held["k6"] == 6
    # the same batch again, and an older one, change nothing; an older row does not win by order; keep="old" only adds
    version = table.manifest()["version"]
    assert not table.upsert(rows(("k5", 1, 9)), source="s", batch=3) and not table.upsert(rows(("k5", 1, 9)), source="s", batch=2)
    assert table.manifest()["version"] == version
    table.upsert(rows(("k5", 2, 1), ("k6", 600, 5)), order=[F.desc("ts")])
    table.upsert(rows(("k5", 3, 9), ("newer", 4, 9)), keep="old")
    table.upsert(rows())
    held = {r.k: r.v for r in table.read().collect()}
    assert (held["k5"], held["k6"], held["newer"]) == (500, 600, 4) and len(held) == 103
    # an upsert that broke off before its manifest leaves the table as it was
    rows(("k5", 0, 9)).write.parquet(f"file://{tmp_path}/t/data/version={table.manifest()['version'] + 1}/__bucket=0")
    assert {r.k: r.v for r in table.read().collect()} == held
    table.upsert(rows(("k7", 700, 9)))
    assert {r.k: r.v for r in table.read().collect()} == held | {"k7": 700}
    assert len(os.listdir(tmp_path / "t")) < 8  # two manifests with their checksums, and the data


@pytest.mark.parametrize("name", ["x3_stream_trailing_hour", "w9_stream_breaker", "k4_bucket_upsert"])
def test_registered(name):
    from folioforge.plans import registry

    assert name in registry.oracle_sql()


def test_breaker_calls_its_state_by_batches_of_a_user_not_by_events():
    calls = []

    class State:
        held = None

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name in ("appendList", "put", "update"):
                    self.held = [*(self.held or []), *args[0]] if name == "appendList" else args[0]
                return self.held if name == "get" else self.held is not None

            return call

    class Handle:
        def registerTimer(self, at):
            calls.append(at)

        def getValueState(self, *_):
            return State()

        getListState = getMapState = getValueState

    class Mark:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    breaker = jobs.Breaker()
    breaker.init(Handle())
    rows = [Row(at=1000 * at, event_id=at, success=at % 3 == 0) for at in random.Random(1).sample(range(1, 1001), 1000)]
    assert list(breaker.handleInputRows((7,), iter(rows), Mark(0))) == []
    first = [r.event_id for r in breaker.handleExpiredTimer((7,), Mark(600), None)]
    again = list(breaker.handleExpiredTimer((7,), Mark(600), None))
    rest = [(r.event_id, r.failures) for r in breaker.handleExpiredTimer((7,), Mark(2000), None)]
    assert first == list(range(1, 601)) and again == [] and [i for i, _ in rest] == list(range(601, 1001)) and rest[-1][1] == 667
    assert [c for c in calls if isinstance(c, int)] == [1, 601] and len(calls) < 20

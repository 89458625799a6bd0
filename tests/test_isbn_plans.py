"""ISBNs are worked out once for each row, in long arithmetic."""

from __spark_entry__ import queries
from folioforge.functions import isbn
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_isbns_of_a_text_are_extracted_once(spark):
    plan = queries()["i9_extract_first_with_isbn13"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2 and "to_number" not in plan


def test_check_digits_of_odd_strings(spark):
    rows = ["978000000017", "97800000001", "9780000000O1", "+97800000001", "080442957X", "", None, "978000000017\n"]
    found = spark.createDataFrame([(s,) for s in rows], "s string").select("s", isbn.check13(F.col("s")).alias("a"), isbn.check10(F.col("s")).alias("b"))
    got = {r.s: (r.a, r.b) for r in found.collect()}

    def total(s, weights):
        return sum(int(c) * w for c, w in zip(s, weights)) if s and s[: len(weights)].isdecimal() and len(s) >= len(weights) else None

    for s in rows:
        a, b = total(s, (1, 3) * 6), total(s, range(10, 1, -1))
        assert got[s] == (None if a is None else str(-a % 10), None if b is None else "0123456789X"[-b % 11])

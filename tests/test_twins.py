"""Queries that SQL cannot express, against plain Python over the same rows."""

import difflib
import hashlib
import math
import re

import pytest

from folioforge.functions import similarity as S
from folioforge.plans import registry
from folioforge.sources import derived as D

SF = "/root/testdata/sf0.001"


def ratio(a, b):
    return difflib.SequenceMatcher(None, a or "", b or "").ratio()


def collapsed(t):
    return re.sub(r"(?i)([a-z])\1+", r"\1", t, flags=re.A)


@pytest.fixture(scope="module")
def books(spark):
    return {r.id: r for r in D.books(spark, SF).collect()}


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def t5(books, texts, spark):
    out = set()
    for b in books.values():
        torn = re.sub("(iing|iidg|eedg)", r" \1", re.sub("([aeiou])", r"\1\1", b.title or ""))
        done = ""
        for w in collapsed(torn).split(" "):
            if done and re.fullmatch("[a-z]{2,4}", w) and len(done.split(" ")[-1]) >= 4:
                done += w
            else:
                done = w if not done else f"{done} {w}"
        out.add((b.id, done))
    return out


def t6(books, texts, spark):
    spaces = lambda t: re.sub(r"\s+", " ", t.translate(str.maketrans("‘’“”–—", "''\"\"--")), flags=re.A).strip(" ")
    return {(i, hashlib.md5(collapsed(spaces(t)).encode()).hexdigest()) for i, t in texts.items()}


def t25(books, texts, spark):
    out = set()
    for i, t in texts.items():
        lines = [x for x in t.split("\n") if x.strip(" ")]
        windows = [" ".join(lines[k : k + n]) for k in range(min(12, max(len(lines), 1))) for n in (1, 2, 3)]
        letters = lambda w: sum(c.isalpha() for c in w)
        good = [w for w in windows if 6 <= len(w) <= 160 and letters(w) >= 6 and letters(w) >= 0.35 * len(w)]
        out.add((i, good[0] if good else None))
    return out


def q4(books, texts, spark):
    out = set()
    for b in books.values():
        score = 0.4 * S.jaro_winkler(b.title.lower(), "small ring economy volume 7") if b.title else 0
        score += 0.3 * S.jaro_winkler(b.authors[0].lower(), "supplier#000000001") if b.authors else 0
        score += 0.2 * S.jaro_winkler(b.publisher.lower(), "manning") + (0.1 if b.year == "1990" else 0)
        out.add((b.id, round(min(1.0, score), 6)))
    return out


def q5(books, texts, spark):
    asked = ("supplier#000000001", "supplier#000000042")
    return {(b.id, round(sum(max(S.jaro_winkler(a.lower(), x) for a in b.authors) for x in asked) / 2, 6)) for b in books.values() if b.authors}


def q16(books, texts, spark):
    return {(b.id, round(ratio(b.title, "red ring"), 6)) for b in books.values()}


def q17(books, texts, spark):
    want, out = "red ring economy", []
    for b in books.values():
        if b.title is not None:
            t = b.title.lower()
            score = round(ratio(t, want) + 0.5 * len(set(t.split(" ")) & set(want.split(" "))) + 0.4 * (want in t), 6)
            out.append((-score, b.id))
    return {(i, -s) for s, i in sorted(x for x in out if -x[0] > 0.2)[:10]}


def q34(books, texts, spark):
    by = {}
    for b in books.values():
        if b.title is not None:
            t = b.title.lower()
            match = min(1.0, ratio(t, "red ring") + (0.2 if "red ring" in t else 0))
            by.setdefault(b.source, []).append((-round(0.6 * 0.9 * b.confidence + 0.4 * match, 6), b.id))
    return {(i, -s) for rows in by.values() for s, i in sorted(rows)[:10]}


def q38(books, texts, spark):
    by = {}
    for r in D.source_records(spark, SF).collect():
        by.setdefault(r.book, []).append((-r.confidence, r.source))
    out = set()
    for book, rows in by.items():
        rows.sort()
        c = -rows[0][0]
        for other, _ in rows[1:]:
            c = min(1.0, c + (0.05 if -other > 0.8 else 0.02))
        out.add((book, round(c, 6), rows[0][1] + ("+merged" if len(rows) > 1 else "")))
    return out


def z33(books, texts, spark):
    first = {}
    for b in sorted(books.values(), key=lambda b: b.id):
        first.setdefault((b.title or "").lower() + ":" + b.publisher.lower(), b.id)
    return {x for x in q34(books, texts, spark) if x[0] in set(first.values())}


#: The columns that are compared, and the twin.
TWINS = {
    "t5_collapse_repeats": (("id", "collapsed"), t5), "t6_artifact_cleanup": (("doc_id", "h"), t6), "t25_title_window": (("doc_id", "title"), t25), "q4_weighted_fields": (("id", "score"), q4), "q5_author_lists": (("id", "score"), q5),
    "q16_sequence_ratio": (("id", "score"), q16), "q17_lexical_ratio": (("id", "score"), q17), "q34_external_rank": (("id", "score"), q34), "q38_record_merge": (("book", "confidence", "source"), q38), "z33_multi_source_search": (("id", "score"), z33),
}


@pytest.mark.parametrize("name", sorted(TWINS))
def test_query_equals_its_twin(spark, books, texts, name):
    columns, twin = TWINS[name]
    got = registry.queries()[name](spark, SF).select(*columns).collect()
    want = sorted(twin(books, texts, spark), key=repr)
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=repr), want, strict=True):
        assert all(math.isclose(x, y, abs_tol=2e-6) if isinstance(x, float) else x == y for x, y in zip(a, b, strict=True)), (a, b)


#: Queries whose rows other modules hold against brute force.
ELSEWHERE = {
    "q6_fuzzy_search": "test_fuzzy_search.py", "x2_refined_predictions": "test_refine.py",
    "q25_parallel": "test_orchestrator.py", "q25_sequential": "test_orchestrator.py", "q25_adaptive": "test_orchestrator.py", "u1_orchestrated": "test_orchestrator.py",
}


def test_every_query_has_a_twin():
    tested = set(TWINS) | set(ELSEWHERE) | set(registry.oracle_sql())
    from tests.test_sources import FILE_QUERIES

    assert set(registry.queries()) - tested <= set(FILE_QUERIES)

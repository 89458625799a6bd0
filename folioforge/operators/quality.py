"""Record quality: validators and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that no author's name holds.
STOP_NAMES = ("edition", "press", "publisher", "university", "chapter", "volume", "guide", "manual", "unknown")
#: Signs of a manual or documentation.
MANUAL_SIGNS = ("user guide", "user manual", "reference manual", "installation", "getting started", "table of contents", "documentation", "release notes", "quick start", "troubleshooting", "api reference", "administrator", "configuration", "datasheet")


def valid_date(c: Column, as_of_year: int) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD, a real date, and a year from 1900 to the given one."""
    year = F.substring(c, 1, 4).try_cast("int")
    shape = c.rlike(r"^[0-9]{4}$") | (c.rlike(r"^[0-9]{4}-[0-9]{2}$") & F.try_to_date(F.concat(c, F.lit("-01")), "yyyy-MM-dd").isNotNull()) | (c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(c, "yyyy-MM-dd").isNotNull())
    return F.coalesce(shape & year.between(1900, as_of_year), F.lit(False))


def valid_record(title: Column, authors: Column, publisher: Column) -> Column:
    """A title of 3 characters, an author that is not blank, a publisher of 2."""
    return F.coalesce((F.length(F.trim(title)) >= 3) & F.exists(authors, lambda a: F.trim(a) != "") & (F.length(F.trim(publisher)) >= 2), F.lit(False))


def valid_author(c: Column) -> Column:
    """Two words or more, no digit, no stop word, all capitalized."""
    words = F.split(F.trim(c), r"\s+")
    return F.coalesce((F.size(words) >= 2) & ~c.rlike("[0-9]") & ~F.exists(words, lambda w: F.lower(w).isin(*STOP_NAMES)) & F.forall(words, lambda w: w.rlike("^[A-Z]")), F.lit(False))


def author_line(c: Column) -> Column:
    """Two to five tokens with letters, nearly all capitalized, without a stop word."""
    t = F.split(F.trim(c), r"\s+")
    n = F.size(t)
    capital = F.size(F.filter(t, lambda w: w.rlike("^[A-Z]")))
    return F.coalesce(n.between(2, 5) & F.forall(t, lambda w: w.rlike("[A-Za-z]")) & (capital >= F.greatest(F.lit(2), n - 1)) & ~F.exists(t, lambda w: F.lower(w).isin(*STOP_NAMES)), F.lit(False))


def errors(title: Column, authors: Column, publisher: Column, year: Column, isbn_ok: Column, as_of_year: int) -> Column:
    """The strict validators' findings, in order."""
    y = year.try_cast("int")
    checks = (
        ("title: missing", F.coalesce(F.length(F.trim(title)), F.lit(0)) == 0),
        ("title: short", F.length(F.trim(title)).between(1, 2)),
        ("author: missing", F.size(authors) == 0),
        ("author: digits", F.exists(authors, lambda a: a.rlike("[0-9]"))),
        ("publisher: missing", F.coalesce(F.lower(F.trim(publisher)).isin("", "unknown"), F.lit(True))),
        ("year: range", ~F.coalesce(y.between(1900, as_of_year), F.lit(False))),
        ("isbn: checksum", ~isbn_ok),
    )
    return F.array_compact(F.array(*[F.when(bad, name) for name, bad in checks]))


def strict_score(title: Column, authors: Column, publisher: Column, year: Column, isbn_ok: Column, as_of_year: int) -> Column:
    """0.3 author, 0.3 title, 0.2 publisher, 0.1 year, 0.1 ISBN."""
    on = lambda c, w: F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0)
    return on(F.size(authors) > 0, 0.3) + on(F.length(F.trim(title)) >= 3, 0.3) + on(~F.lower(F.trim(publisher)).isin("", "unknown"), 0.2) + on(year.try_cast("int").between(1900, as_of_year), 0.1) + on(isbn_ok, 0.1)


def corrupted(text: Column) -> Column:
    """Too many special characters, digits, or runs of capitals."""
    n = F.length(text)
    count = lambda rx: F.regexp_count(text, F.lit(rx))
    words = F.size(F.split(F.trim(text), r"\s+"))
    return F.coalesce((count(r"[^A-Za-z0-9\s.,;:!?'\"()-]") > 0.3 * n) | (count("[A-Z]{3,}") > words / 4) | (count("[0-9]") > 0.15 * n), F.lit(False))


def is_manual(text: Column, name: Column) -> Column:
    """Two signs or more in the text, or a telling file name."""
    signs = sum((F.coalesce(F.lower(text).contains(s), F.lit(False)).cast("int") for s in MANUAL_SIGNS), F.lit(0))
    return (signs >= 2) | F.coalesce(F.lower(name).rlike(r"_(sg|lg)\.pdf$"), F.lit(False))


def many_singles(text: Column) -> Column:
    """Of four tokens or more, 60 % are single characters."""
    t = F.trim(text)
    n = F.regexp_count(t, F.lit(r"\s+")) + 1
    singles = F.regexp_count(t, F.lit(r"(?<!\S)\S(?!\S)"))
    return F.coalesce((n >= 4) & (singles >= 0.6 * n), F.lit(False))


def repeated_letters(text: Column) -> Column:
    """Of six letters or more, 45 % of neighbours are equal."""
    letters = F.regexp_replace(F.lower(text), "[^a-z]+", "")
    n = F.length(letters)
    same = n - F.length(F.regexp_replace(letters, r"(.)\1+", "$1"))  # a run of k letters has k - 1 equal neighbours
    return F.coalesce((n >= 6) & (same >= 0.45 * (n - 1)), F.lit(False))


def quality(title: Column, authors: Column, publisher: Column, date: Column, isbn: Column, missing) -> Column:
    """0 to 100: 2.0 title (by length up to 50), 1.5 authors (up to 3), 1.0 publisher, 1.0 date, 2.0 ISBN, 0.5 for all."""
    on = lambda c, w: F.when(c, w).otherwise(0.0)
    t = F.coalesce(2.0 * F.least(F.length(title) / 50.0, F.lit(1.0)), F.lit(0.0))
    a = 1.5 * F.least(F.size(authors) / 3.0, F.lit(1.0))
    p, d, i = ~missing(publisher), ~missing(date), ~missing(isbn)
    return (t + a + on(p, 1.0) + on(d, 1.0) + on(i, 2.0) + on(p & d & i & title.isNotNull() & (F.size(authors) > 0), 0.5)) / 8.0 * 100.0

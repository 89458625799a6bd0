"""ISBN functions as column expressions: cleaning, checksums, conversion, repair and extraction."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that scanners confuse with digits, in the order in which they are replaced.
OCR = (("O", "0"), ("o", "0"), ("I", "1"), ("l", "1"), ("S", "5"), ("s", "5"), ("Z", "2"), ("z", "2"), ("B", "8"), ("G", "6"))

#: Publishers by the prefix of a Brazilian ISBN-13.
PREFIX_PUBLISHERS = {"97865": "Casa do Codigo", "97885": "Novatec"}


def clean(c: Column) -> Column:
    """Upper-cased digits and X only."""
    return F.regexp_replace(F.upper(c), "[^0-9X]", "")


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once for all places where the body names it, those under a condition too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _weighted(c: Column, weights: tuple[int, ...]) -> Column:
    """The sum of the first digits times their weights, in long arithmetic; null where these are not all digits 0-9."""
    n = len(weights)
    number = F.regexp_extract(c, f"^[0-9]{{{n}}}", 0).try_cast("long")
    digit = lambda x, i: F.call_function("div", x, F.lit(10 ** (n - 1 - i))) % 10
    return _let(number, lambda x: functools.reduce(operator.add, (digit(x, i) * w for i, w in enumerate(weights))).cast("int"))


def check13(c: Column) -> Column:
    """The check digit of a string that starts with 12 digits."""
    return ((10 - _weighted(c, (1, 3) * 6) % 10) % 10).cast("string")


def check10(c: Column) -> Column:
    """The check character of a string that starts with 9 digits."""
    return _let((11 - _weighted(c, tuple(range(10, 1, -1))) % 11) % 11, lambda rest: F.when(rest == 10, "X").otherwise(rest.cast("string")))


def _right13(s: Column, strict: bool = False) -> Column:
    """valid13() of a cleaned string."""
    shape = s.rlike("^97[89][0-9]{10}$" if strict else "^[0-9]{13}$")
    return F.coalesce(F.when(shape, check13(s) == F.substring(s, 13, 1)), F.lit(False))


def _right10(s: Column) -> Column:
    return F.coalesce(F.when(s.rlike("^[0-9]{9}[0-9X]$"), check10(s) == F.substring(s, 10, 1)), F.lit(False))


def _right(s: Column) -> Column:
    return _right13(s) | _right10(s)


def valid13(c: Column, strict: bool = False) -> Column:
    """Whether a string, once cleaned, is 13 digits with the right check digit; strict: with prefix 978 or 979."""
    return _let(clean(c), lambda s: _right13(s, strict))


def valid10(c: Column) -> Column:
    return _let(clean(c), _right10)


def valid(c: Column) -> Column:
    return _let(clean(c), _right)


def _as13(s: Column) -> Column:
    return F.when(_right10(s), _let(F.concat(F.lit("978"), F.substring(s, 1, 9)), lambda core: F.concat(core, check13(core))))


def to13(c: Column) -> Column:
    """An ISBN-10 as ISBN-13; null where it is not valid."""
    return _let(clean(c), _as13)


def normal13(c: Column) -> Column:
    """Any valid ISBN as ISBN-13, else null: the key that ISBN joins use."""
    return _let(clean(c), lambda s: F.when(_right13(s), s).otherwise(_as13(s)))


def ocr_fixed(c: Column) -> Column:
    """Look-alike letters replaced by digits, one after the other."""
    for bad, good in OCR:
        c = F.replace(c, F.lit(bad), F.lit(good))
    return c


def candidates(c: Column) -> Column:
    """Strings that repair may mean: the cleaned one, one look-alike replaced, all replaced, and 12 digits completed."""

    def of(plain: Column) -> Column:
        single = [F.replace(plain, F.lit(bad), F.lit(good)) for bad, good in OCR]
        completed = lambda full: F.array(full, F.when(full.rlike("^[0-9]{12}$"), F.concat(full, check13(full))))
        # what a replacement leaves as it was is cleaned once
        some = F.transform(F.array_distinct(F.array(plain, *single)), clean)
        return F.array_distinct(F.array_compact(F.concat(some, _let(clean(ocr_fixed(plain)), completed))))

    return _let(F.regexp_replace(c, "[\\s-]", ""), of)


def repaired(c: Column) -> tuple[Column, Column]:
    """The valid ISBNs among the candidates, sorted, and the raw candidates of right length that are not valid."""
    judged = F.transform(candidates(c), lambda x: F.struct(x.alias("x"), _right(x).alias("ok")))
    of = lambda keep: F.array_sort(F.transform(F.filter(judged, keep), lambda j: j["x"]))
    return of(lambda j: j["ok"]), of(lambda j: ~j["ok"] & F.length(j["x"]).isin(10, 13))


def extract_all(text: Column) -> Column:
    """All valid ISBNs in a text, cleaned, distinct, sorted."""
    thirteen = F.regexp_extract_all(text, F.lit(r"(?<![0-9])97[89][- ]?(?:[0-9][- ]?){9}[0-9](?![0-9])"), F.lit(0))
    ten = F.regexp_extract_all(text, F.lit(r"(?<![0-9])(?:[0-9][- ]?){9}[0-9Xx](?![0-9])"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.concat(thirteen, ten), clean), _right)))


def first_in(text: Column) -> Column:
    """The first valid ISBN of a text; 13 digits, with prefix 978 or 979, go first."""
    strict = lambda x: (F.length(x) == 13) & x.rlike("^97[89]")
    return _let(extract_all(text), lambda found: F.coalesce(F.get(F.filter(found, strict), F.lit(0)), F.get(F.filter(found, lambda x: F.length(x) == 10), F.lit(0))))


def quick(c: Column) -> Column:
    """Length and prefix only."""
    s = clean(c)
    return F.coalesce(s.rlike("^97[89][0-9]{10}$") | s.rlike("^[0-9]{9}[0-9X]$"), F.lit(False))


def text_cleanup(c: Column) -> Column:
    """Blanks and hyphens folded, and the label written one way."""
    c = F.regexp_replace(F.regexp_replace(c, r"[\s]+", " "), "[‐‑‒–—]", "-")
    return F.regexp_replace(c, r"(?i)ISBN[: ]*", "ISBN: ")


def is_variant(a: Column, b: Column) -> Column:
    """Equal, equal as ISBN-13, or equal but for the last character."""
    x, y = clean(a), clean(b)
    near = (F.length(x) == F.length(y)) & (F.length(x) > 1) & (F.substring(x, F.lit(1), F.length(x) - 1) == F.substring(y, F.lit(1), F.length(y) - 1))
    return F.coalesce((x == y) | (normal13(a) == normal13(b)) | near, F.lit(False))


def accepts_variant(a: Column, b: Column) -> Column:
    """Whether b is valid and shares a's first seven characters."""
    return valid(b) & F.coalesce(F.substring(clean(a), 1, 7) == F.substring(clean(b), 1, 7), F.lit(False))


def prefix_publisher(c: Column) -> Column:
    out = F.lit(None).cast("string")
    for prefix, name in PREFIX_PUBLISHERS.items():
        out = F.when(clean(c).startswith(prefix), name).otherwise(out)
    return out


def loose_in_query(text: Column) -> Column:
    """Strings in a query that look like ISBNs; no checksum."""
    found = F.regexp_extract_all(text, F.lit(r"[0-9][0-9Xx -]{8,16}[0-9Xx]"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, clean), lambda x: F.length(x).isin(10, 13)))

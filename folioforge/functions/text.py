"""Text functions as column expressions: normalization, names, file names, titles, queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin letters and what stands for them.
ACCENTED, PLAIN = "áàâãäåéèêëíìîïóòôõöúùûüçñýÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ", "aaaaaaeeeeiiiiooooouuuucnyAAAAAAEEEEIIIIOOOOOUUUUCNY"
#: publishers' spellings (upper case) and canonical names, in order.
PUBLISHERS = (
    ("O'REILLY MEDIA", "O'Reilly"), ("O'REILLY", "O'Reilly"), ("OREILLY MEDIA", "O'Reilly"), ("OREILLY", "O'Reilly"), ("MANNING PUBLICATIONS", "Manning"), ("MANNING", "Manning"),
    ("PACKT PUBLISHING", "Packt"), ("PACKT", "Packt"), ("CASA DO CODIGO", "Casa do Código"), ("NOVATEC EDITORA", "Novatec"), ("NOVATEC", "Novatec"),
)
#: Function words by language.
FUNCTION_WORDS = {"en": ("the", "of", "and", "to", "in", "is"), "pt": ("de", "da", "do", "para", "com", "uma"), "fr": ("le", "la", "et", "les", "des", "dans"), "de": ("der", "die", "und", "das", "ein", "zu"), "es": ("el", "los", "las", "que", "y", "del")}
#: Words that no index holds, and typing errors with what is meant.
STOP = ("the", "of", "and", "for", "with", "from", "that", "this")
TYPOS = {"pyhton": "python", "pythno": "python", "javscript": "javascript", "progamming": "programming", "machin": "machine", "learing": "learning", "algoritm": "algorithm", "databse": "database", "rign": "ring", "blot": "bolt"}
#: Limits of trimmed fields as (words, characters).
LIMITS = {"title": (14, 120), "subtitle": (18, 140), "author": (8, 80), "publisher": (8, 80)}


def spaces(c: Column) -> Column:
    """Curly quotes and dashes folded, whitespace collapsed."""
    return F.trim(F.regexp_replace(F.translate(c, "‘’“”–—", "''\"\"--"), r"\s+", " "))


def compare_form(c: Column) -> Column:
    """Lower case, one blank between words, letters, digits and underscores only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def strip_accents(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def trimmed(c: Column, field: str) -> Column:
    """At most so many words and characters; a cut word goes."""
    words, chars = LIMITS[field]
    few = F.array_join(F.slice(F.split(c, " "), 1, words), " ")
    return F.when(F.length(few) <= chars, few).otherwise(F.regexp_replace(F.substring(few, 1, chars), " [^ ]*$", ""))


def tokens(c: Column, least: int = 2) -> Column:
    """Index tokens: lower case, letters and digits, not too short, no stop words."""
    words = F.split(F.lower(c), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*STOP))


def ngrams(words: Column, n: int) -> Column:
    """All runs of n words."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))


def canonical_publisher(c: Column, contains: bool = False) -> Column:
    """The canonical name: by exact spelling, or by the first spelling that is contained."""
    upper = F.upper(F.trim(c))
    out = F.when(upper.isin("", "UNKNOWN"), "").otherwise(F.trim(c))
    for raw, name in reversed(PUBLISHERS):
        out = F.when(upper.contains(raw) if contains else upper == raw, name).otherwise(out)
    return F.coalesce(out, F.lit(""))


def name_variants(c: Column) -> Column:
    """The name, first and last, 'last, first', initials with and without dots, and the last name."""
    p = F.split(F.trim(c), r"\s+")
    first, last = F.get(p, F.lit(0)), F.get(p, F.size(p) - 1)
    two = F.size(p) >= 2
    initials = F.transform(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), lambda x: F.substring(x, 1, 1))
    all_of = F.array(
        F.trim(c), F.when(two, F.concat_ws(" ", first, last)), F.when(two, F.concat(last, F.lit(", "), first)),
        F.when(two, F.concat(F.array_join(initials, ". "), F.lit(". "), last)), F.when(two, F.concat(F.array_join(initials, ""), F.lit(" "), last)), F.when(two, last),
    )
    return F.array_distinct(F.array_compact(all_of))


def from_filename(path: Column) -> tuple[Column, Column, Column]:
    """author, title, year of 'Author - Title (YYYY).ext'; without ' - ' all is title."""
    stem = F.trim(F.regexp_replace(F.regexp_replace(F.translate(path, "_", " "), r"\.[A-Za-z0-9]+$", ""), r"\(?((?:19|20)[0-9]{2})\)?", ""))
    year = F.nullif(F.regexp_extract(path, "((?:19|20)[0-9]{2})", 1), F.lit(""))
    at = F.instr(stem, " - ")
    author = F.when(at > 0, F.trim(F.substring(stem, F.lit(1), at - 1)))
    title = F.when(at > 0, F.trim(F.substring(stem, at + 3, F.length(stem)))).otherwise(stem)
    return author, title, year


def guess_confidence(path: Column) -> Column:
    """0.1, +0.3 for ' - ', +0.2 for a year, +0.2 for a known extension, -0.1 if short; from 0.1 to 0.8."""
    on = lambda c, w: F.when(c, w).otherwise(0.0)
    raw = 0.1 + on(F.instr(path, " - ") > 0, 0.3) + on(path.rlike("(19|20)[0-9]{2}"), 0.2) + on(path.rlike(r"\.(pdf|epub|mobi)$"), 0.2) - on(F.length(path) < 10, 0.1)
    return F.greatest(F.lit(0.1), F.least(F.lit(0.8), raw))


def sanitized(c: Column, limit: int = 150) -> Column:
    """Characters that file systems refuse go; blanks collapse."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(c, r'[\\/:*?"<>|]', ""), r"\s+", " ")), 1, limit)


def formatted(template: str, **fields: Column) -> Column:
    """A template with {placeholders}; nulls are empty."""
    out = F.lit(template)
    for name, value in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def language(c: Column) -> Column:
    """The language with most distinct function words in the text; ties and none: unknown."""
    words = F.array_distinct(F.split(F.lower(c), r"[^\p{L}]+"))
    n = {k: F.size(F.array_intersect(words, F.array(*map(F.lit, v)))) for k, v in FUNCTION_WORDS.items()}
    most = F.greatest(*n.values())
    ties = sum(((x == most).cast("int") for x in n.values()), F.lit(0))
    out = F.lit("unknown")
    for k, x in n.items():
        out = F.when((x == most) & (ties == 1) & (most > 0), k).otherwise(out)
    return out


def corrected(c: Column) -> Column:
    """Each known typing error replaced."""
    known = F.create_map(*[F.lit(x) for pair in TYPOS.items() for x in pair])
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.coalesce(F.try_element_at(known, F.lower(w)), w)), " ")


def cleaned_query(c: Column) -> Column:
    """Noise words and edge punctuation go."""
    for rx in (r"(?i)\b(please|find|search for|looking for|book about|livro sobre)\b", r"(?i)\b(pdf|epub|mobi|download|free)\b", r"[\[\]{}]", r"\s+"):
        c = F.regexp_replace(c, rx, " ")
    return F.regexp_replace(F.trim(c), r"^[\s.,;:!?-]+|[\s.,;:!?-]+$", "")


def query_complexity(c: Column) -> Column:
    """0.2 length/100, 0.3 words/20, 0.2 special/10, 0.1 for digits of an ISBN, 0.05 for quotes, 0.1 for and/or; each capped."""
    part = lambda x, w: w * F.least(x, F.lit(1.0))
    on = lambda rx, w: F.when(c.rlike(rx), w).otherwise(0.0)
    return part(F.length(c) / 100.0, 0.2) + part(F.size(F.split(F.trim(c), r"\s+")) / 20.0, 0.3) + part(F.regexp_count(c, F.lit(r"[^\p{L}\p{N}\s]")) / 10.0, 0.2) + on("[0-9]{9}", 0.1) + on("[\"']", 0.05) + on(r"(?i)\b(and|or)\b", 0.1)


def title_score(line: Column, index: Column) -> Column:
    """How much a line looks like a title."""
    t = F.trim(line)
    words = F.split(t, r"\s+")
    on = lambda c, w: F.when(c, w).otherwise(0.0)
    titled = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}"))) >= 0.6 * F.size(words)
    n = F.length(t)
    score = 1.0 + on(index < 6, 0.6) + on(t == F.upper(t), 0.2) + on(F.size(words) >= 3, 0.3) + on(n.between(10, 80), 0.1) - on(n > 100, 0.1) - on(t.endswith("."), 0.25) + on(titled, 0.4) - on(t.rlike("[:-]$"), 0.2)
    return F.when(n.between(5, 140), score)

"""What file names and texts tell by fixed lists of words: publishers, categories, languages; five ways of reading a file name."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Publishers with the words that name them, in order; international ones, then Brazilian ones.
INTERNATIONAL = {
    "Manning": "manning; meap; exploring; action; month; grokking", "Packt": "packt; cookbook; hands-on; mastering; learning", "OReilly": "oreilly; o'reilly; learning; definitive; pocket",
    "NoStarch": "nostarch; no starch; black hat; ethical; hacking", "Wiley": "wiley; sybex; wrox", "Addison": "addison; wesley; pearson", "MIT": "mit press", "Apress": "apress; pro ; beginning",
    "Microsoft": "microsoft; press", "Springer": "springer", "Elsevier": "elsevier", "McGraw": "mcgraw; hill",
}
BRAZILIAN = {
    "Casa do Código": "casa do codigo; casadocodigo; cdc", "Novatec": "novatec; nova tec", "Érica": "erica; editora erica", "Brasport": "brasport", "Alta Books": "alta books; altabooks", "Bookman": "bookman; grupo a",
    "Pearson BR": "pearson brasil; pearson br", "Cengage": "cengage; thomson", "FCA": "fca editora", "Saraiva": "saraiva; editora saraiva", "Campus": "campus; editora campus", "LTC": "ltc; livros tecnicos", "Makron": "makron; makron books",
}
#: Words by which a publisher is inferred, words of technical and of Brazilian books, and names.
INFERRED = {"Packt": "cookbook; mastering; packt", "OReilly": "learning; pocket; definitive", "Manning": "manning; action; month; grokking", "NoStarch": "hacking; security; black"}
TECHNICAL = (
    "python; java; javascript; typescript; react; vue; angular; programming; programacao; codigo; desenvolvimento; software; algoritmo; machine learning; ai; inteligencia artificial; "
    "ciencia de dados; seguranca; hacking; cyber; banco de dados; sql; web; mobile"
)
NAMES = (
    "joão; josé; antônio; francisco; carlos; paulo; pedro; lucas; maria; ana; francisca; antônia; adriana; juliana; márcia; silva; santos; oliveira; souza; rodrigues; ferreira; alves; "
    "pereira; lima; gomes; ribeiro; carvalho; almeida; lopes; soares; fernandes; vieira; barbosa; rocha; dias; nunes"
)
PORTUGUESE = (
    "programacao; desenvolvimento; algoritmos; estruturas de dados; banco de dados; engenharia de software; ciencia da computacao; inteligencia artificial; aprendizado de maquina; seguranca da informacao"
)
NO_AUTHOR = "www; com; pdf; book"
#: Categories and subcategories with their words, in order; words of more than one word weigh 3, the SPECIFIC ones 4, all others 1.
CATEGORIES = {
    "Programming": "python; java; javascript; js; typescript; react; vue; angular; programming; code; coding; development; dev; software; algorithm; algorithms; data structures; functional; oop; object oriented; "
    "design patterns; clean code; refactoring; c++; cpp; c#; csharp; golang; go; rust; kotlin; swift; php; ruby; perl; scala; clojure; haskell",
    "Security": "security; hacking; hack; cyber; cybersecurity; malware; forensics; forensic; penetration; pentest; ethical; bug bounty; vulnerability; exploitation; incident; analysis; investigation; cryptography; "
    "encryption; privacy; authentication; authorization; firewall; intrusion; detection; threat",
    "Database": "database; db; sql; mysql; postgresql; postgres; mongo; mongodb; redis; cassandra; data; analytics; analysis; warehouse; engineering; oracle; sqlite; mariadb; nosql; big data; hadoop; spark; kafka; elasticsearch",
    "AI_ML": "machine learning; ml; ai; artificial intelligence; data science; deep learning; neural; tensorflow; pytorch; scikit; pandas; numpy; statistics; computer vision; nlp; natural language; chatbot; recommendation; "
    "clustering; classification; regression",
    "Web": "web; website; html; css; frontend; backend; full stack; fullstack; responsive; ui; ux; design; user experience; bootstrap; jquery; ajax; api; rest; graphql; http; https",
    "DevOps": "devops; docker; kubernetes; k8s; cloud; aws; azure; gcp; infrastructure; deployment; automation; ci/cd; continuous integration; jenkins; ansible; terraform; vagrant; puppet",
    "Mobile": "mobile; android; ios; app; application; swift; kotlin; react native; flutter; xamarin; cordova; phonegap",
    "Systems": "linux; windows; unix; system; systems; network; networking; server; administration; bash; shell; powershell; ubuntu; debian; centos; redhat; sysadmin",
    "Cloud": "cloud; aws; amazon web services; azure; gcp; google cloud; serverless; lambda; ec2; s3; kubernetes; docker; containers; microservices",
}
SPECIFIC = ("python", "java", "javascript")
SUBCATEGORIES = {
    "Programming": {"Python": "python", "JavaScript": "javascript; js; react; vue; angular", "Java": "java", "C/C++": "c++; cpp; c programming", "Go": "golang; go", "Rust": "rust", "Functional": "functional; haskell; lisp; scala"},
    "Security": {"Ethical Hacking": "ethical; penetration; pentest", "Malware": "malware; virus; trojan", "Forensics": "forensic; investigation; incident", "Cryptography": "cryptography; encryption; crypto"},
    "Database": {"SQL": "sql; mysql; postgresql", "NoSQL": "mongo; redis; cassandra", "Analytics": "analytics; analysis; science", "Big Data": "hadoop; spark; kafka"},
}
MORE_TERMS = (
    "api; rest; graphql; microservices; container; kubernetes; docker; cloud; aws; azure; gcp; tensorflow; pytorch; pandas; numpy; scipy; react; vue; angular; node; express; mysql; postgresql; mongodb; redis; "
    "linux; windows; ubuntu; debian"
)
PORTUGUESE_SIGNS = "aprenda; programar; com; desenvolvimento; orientacao; objetos; conceitos; aplicabilidades; guia; completo; pratico"
#: Letters that have no decomposition, and what stands for them.
WHOLE = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th", "ı": "i", "ħ": "h", "Ħ": "H", "ŧ": "t", "Ŧ": "T", "ŋ": "n", "Ŋ": "N"}


def words(text: str) -> list[str]:
    """A fixed list; blanks within and at the end of a word count."""
    return text.split("; ")


def _folds() -> dict[str, str]:
    """Every Latin letter with marks and the letter that it decomposes to."""
    ranges = [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]
    found = {chr(c): "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)) for c in ranges}
    return {c: x for c, x in found.items() if len(x) == 1 and x.isascii()}


FOLDS = _folds()


def folded(c: Column) -> Column:
    """Latin letters without their marks, composed or not; letters such as ß, æ, ø and ł by what stands for them."""
    one = {**FOLDS, **{k: v for k, v in WHOLE.items() if len(v) == 1}}
    out = F.translate(F.regexp_replace(c, r"\p{Mn}", ""), "".join(one), "".join(one.values()))
    for k, v in WHOLE.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


def any_of(low: Column, text: str) -> Column:
    found = F.lit(False)
    for w in words(text):
        found = found | F.contains(low, F.lit(w))
    return found


def first_of(low: Column, table: dict[str, str]) -> Column:
    """The first name of a table that some of its words tell; empty if none."""
    out = F.lit("")
    for name, text in reversed(table.items()):
        out = F.when(any_of(low, text), name).otherwise(out)
    return out


def count_of(low: Column, text: str) -> Column:
    return sum((F.contains(low, F.lit(w)).cast("int") for w in words(text)), F.lit(0))


def ground_truth(path: Column) -> dict[str, Column]:
    """title, author, publisher and year of 'Author - Title (YYYY).ext', empty where there is none."""
    name = F.trim(F.regexp_replace(F.regexp_replace(folded(path), r"[^\p{L}\p{N}_\s\-().,]", " "), r"\s+", " "))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    year = F.regexp_extract(stem, r"\(([0-9]{4})\)", 1)
    clean = F.when(year != "", F.trim(F.regexp_replace(stem, r"\([0-9]{4}\)", ""))).otherwise(stem)
    at = F.instr(clean, " - ")
    who = F.trim(F.substring(clean, F.lit(1), at - 1))
    fits = (at > 0) & (F.length(who) > 2) & ~who.rlike("^[0-9]") & ~any_of(F.lower(who), NO_AUTHOR)
    rest = F.when(fits, F.trim(F.substring(clean, at + 3, F.length(clean)))).otherwise(clean)
    title = F.regexp_replace(F.regexp_replace(F.trim(rest), r"^-\s*", ""), r"\s+", " ")
    return {"title": F.when(F.length(title) > 3, title).otherwise(""), "author": F.when(fits, who).otherwise(""), "publisher": first_of(F.lower(clean), INTERNATIONAL | BRAZILIAN), "year": year}


def filename_algorithms(path: Column, truth: dict[str, Column]) -> dict[str, tuple[Column, Column]]:
    """publisher and confidence by each of the five algorithms; truth: ground_truth() of the path, as columns."""
    low = F.lower(path)
    has = {k: c != "" for k, c in truth.items()}
    parts = lambda base, t, a, p, y: F.lit(base) + sum((F.when(has[k], w).otherwise(0.0) for k, w in (("title", t), ("author", a), ("publisher", p), ("year", y))), F.lit(0.0))
    one = lambda c: F.least(F.lit(1.0), c)
    basic = one(parts(0.2, 0.3, 0.3, 0.15, 0.05))
    bonus = F.least(0.02 * count_of(low, TECHNICAL), F.lit(0.1)) + F.when((F.instr(path, " - ") > 0) & has["author"] & has["title"], 0.05).otherwise(0.0)
    enhanced = one(parts(0.25, 0.25, 0.25, 0.15, 0.1) + bonus)
    inferred = F.when(has["publisher"], truth["publisher"]).otherwise(first_of(low, INFERRED))
    recent = has["year"] & F.coalesce(truth["year"].try_cast("int").between(2000, 2025), F.lit(False))
    smart = one(enhanced + F.when((inferred != "") & ~has["publisher"], 0.05).otherwise(0.0) + F.when(recent, 0.02).otherwise(0.0))
    hybrid = one(0.2 * basic + 0.3 * enhanced + 0.5 * smart + 0.05)
    national = first_of(low, BRAZILIAN)
    house = F.when(national != "", national).otherwise(truth["publisher"])
    signs = F.when(national != "", 2).otherwise(0) + F.when(has["author"] & any_of(F.lower(truth["author"]), NAMES), 1).otherwise(0) + count_of(low, PORTUGUESE) + F.when(low.rlike(r"[0-9]+[aª]\s*edi[cç][aã]o"), 2).otherwise(0)
    base = F.lit(0.3) + sum((F.when(c, w).otherwise(0.0) for c, w in ((has["title"], 0.25), (has["author"], 0.25), (house != "", 0.15), (has["year"], 0.05))), F.lit(0.0))
    brazilian = one((base + F.least(0.05 * signs, F.lit(0.3))) * F.when(signs == 0, 0.7).otherwise(1.0))
    own = truth["publisher"]
    return {"basic": (own, basic), "enhanced": (own, enhanced), "smart": (inferred, smart), "hybrid": (inferred, hybrid), "brazilian": (house, brazilian)}


def weight(word: str) -> float:
    return 4.0 if word in SPECIFIC else 3.0 if len(word.split()) > 1 else 1.0


def category(low: Column, found: Column | None = None) -> Column:
    """The category of the greatest weight, the first of equal ones; General if no word is there. found: the keywords() of the text, for long
    texts a column of its own, so that they are searched once for all words."""
    there = lambda w: F.contains(low, F.lit(w)) if found is None else F.array_contains(found, w)
    none = F.struct(F.lit(0.0).alias("s"), F.lit(1).alias("o"), F.lit("General").alias("name"))
    scored = [F.struct(sum((F.when(there(w), weight(w)).otherwise(0.0) for w in words(text)), F.lit(0.0)).alias("s"), F.lit(-i).alias("o"), F.lit(name).alias("name")) for i, (name, text) in enumerate(CATEGORIES.items())]
    return F.array_max(F.array(none, *scored))["name"]


def subcategory(low: Column, main: Column) -> Column:
    out = F.lit("")
    for name, table in SUBCATEGORIES.items():
        out = F.when(main == name, first_of(low, table)).otherwise(out)
    return out


TERMS = sorted({w for text in CATEGORIES.values() for w in words(text)} | set(words(MORE_TERMS)))


def _tree(terms: list[str]) -> str:
    """A regular expression of the longest of some terms that stands at a place: letters that terms have in common are looked at once."""
    longer: dict[str, list[str]] = {}
    for w in terms:
        if w:
            longer.setdefault(w[0], []).append(w[1:])
    rest = "|".join(re.escape(c) + _tree(ends) for c, ends in longer.items())
    return f"(?:{rest})" + ("?" if "" in terms else "") if rest else ""


def keywords(low: Column) -> Column:
    """The terms that stand in a text, sorted. One scan finds the longest term of each place; the others of that place are its beginnings."""
    longest = F.array_distinct(F.regexp_extract_all(low, F.lit(f"(?=({_tree(TERMS)}))"), F.lit(1)))
    terms = F.array(*map(F.lit, TERMS))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(longest, lambda m: F.filter(terms, lambda w: F.startswith(m, w))))))


def language(low: Column) -> Column:
    return F.when(any_of(low, PORTUGUESE_SIGNS), "Portuguese").otherwise("English")

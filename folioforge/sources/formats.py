"""Sources of other formats: file listings, listings in text, JSON reports, rename CSVs, EPUB packages."""

from __future__ import annotations

import html
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions of books.
BOOK_EXTENSIONS = ("pdf", "epub", "mobi", "azw", "azw3")
REPORT = "title string, authors array<string>, publisher string, published_date string, isbn_10 string, isbn_13 string, confidence_score double, source string, file_path string"


def book_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """path, ext, length of the books under a folder; contents are not read."""
    glob = "*.{" + ",".join(BOOK_EXTENSIONS) + "}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob).load(folder)
    return found.select("path", F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).alias("ext"), "length", "modificationTime")


def epub_fields(content: bytes | None) -> tuple[str | None, ...]:
    """title, subtitle, authors, publisher, year, isbn of an EPUB's Dublin Core; nulls if it can't be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            opf = next(n for n in z.namelist() if n.endswith(".opf"))
            root = ElementTree.fromstring(z.read(opf))
    except (zipfile.BadZipFile, StopIteration, ElementTree.ParseError, KeyError):
        return (None,) * 6
    of = lambda tag: [e.text.strip() for e in root.iter(f"{{http://purl.org/dc/elements/1.1/}}{tag}") if e.text and e.text.strip()]
    title, _, sub = (of("title") or [""])[0].partition(":")
    digits = ["".join(c for c in x if c.isdigit() or c in "xX") for x in of("identifier")]
    return title.strip() or None, sub.strip() or None, ", ".join(of("creator")) or None, next(iter(of("publisher")), None), next((d[:4] for d in of("date")), None), next((d for d in digits if len(d) in (10, 13)), None)


def epub_text(content: bytes | None) -> str | None:
    """The text of an EPUB's documents in the order of their names, without tags; null if it can't be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            pages = [z.read(n).decode("utf-8", "replace") for n in sorted(z.namelist()) if n.endswith((".xhtml", ".html", ".htm"))]
    except (zipfile.BadZipFile, KeyError):
        return None
    return "\n".join(html.unescape(re.sub(r"<[^>]*>", "", p)).strip() for p in pages)


#: Files that a Python worker holds at a time, beside the batch that Spark sent, and bytes of their contents.
FILES, FILE_BYTES = 250, 4_000_000


def pieces(frames: Iterator[pd.DataFrame], column: str = "content") -> Iterator[pd.DataFrame]:
    """The frames, cut to FILES rows, and where contents add up to FILE_BYTES: what is made of a piece is handed on before the next one."""
    for frame in frames:
        size = frame[column].map(lambda c: len(c) if isinstance(c, (bytes, str)) else 0).to_numpy().cumsum()
        at = 0
        while at < len(frame):
            to = int(size.searchsorted((size[at - 1] if at else 0) + FILE_BYTES, "right"))
            to = min(max(at + 1, to), at + FILES)
            yield frame.iloc[at:to]
            at = to
        del frame


def epub_rows(files: DataFrame) -> DataFrame:
    """One row per EPUB (path, content) with its fields and text; files are parsed on the executors, one at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in pieces(frames):
            rows = [(p, *epub_fields(c), epub_text(c)) for p, c in zip(frame["path"], frame["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "title", "subtitle", "authors", "publisher", "year", "isbn", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, title string, subtitle string, authors string, publisher string, year string, isbn string, text string")


def read_epubs(spark: SparkSession, folder: str) -> DataFrame:
    return epub_rows(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.epub").load(folder))


_PDF_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_PDF_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_PDF_SHOWN = re.compile(rb"\[((?:\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|[^\]])*)\]\s*TJ|(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>)\s*(?:Tj|'|\")|(T\*|\bTd\b|\bTD\b|\bET\b)", re.S)
_PDF_STRING = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>", re.S)
#: What stands after a backslash in a PDF string.
_PDF_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _PDF_ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")


def pdf_pages(content: bytes | None, pages: int = 10) -> list[str]:
    """The text that the first pages' content streams show; [] if it can't be read. Streams are plain or deflated; fonts with encodings of their own give other characters."""
    objects = {int(k): body for k, body in _PDF_OBJECT.findall(content or b"")}
    out = []
    for body in objects.values():
        if len(out) == pages:
            break
        if re.search(rb"/Type\s*/Page\b", body):
            refs = re.search(rb"/Contents\s*(?:\[([^\]]*)\]|(\d+\s+\d+\s+R))", body)
            shown = []
            for ref in re.findall(rb"(\d+)\s+\d+\s+R", refs[0]) if refs else ():
                found = _PDF_STREAM.search(objects.get(int(ref), b""))
                if found:
                    try:
                        data = zlib.decompressobj().decompress(found[1]) if b"/FlateDecode" in objects[int(ref)] else found[1]  # a last byte that reads as a line end may be gone
                    except zlib.error:
                        continue
                    for many, one, move in _PDF_SHOWN.findall(data):
                        shown.append("\n" if move else "".join(map(_pdf_string, _PDF_STRING.findall(many or one))))
            out.append("".join(shown).strip("\n"))
    return out


#: The fields of a PDF's information dictionary that are read.
PDF_INFO = ("Title", "Author", "Subject", "Keywords", "Producer")


def pdf_info(content: bytes | None) -> str:
    """The information dictionary's fields, one by line."""
    out = []
    for key in PDF_INFO:
        found = re.search(rb"/" + key.encode() + rb"\s*(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>)", content or b"")
        if found:
            out.append(_pdf_string(found[1]))
    return "\n".join(out)


def pdf_rows(files: DataFrame, pages: int = 10) -> DataFrame:
    """path, text of the first pages, info: one row per PDF (path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in pieces(frames):
            yield pd.DataFrame({"path": frame["path"], "text": ["\n".join(pdf_pages(c, pages)) for c in frame["content"]], "info": [pdf_info(c) for c in frame["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, text string, info string")


def read_pdfs(spark: SparkSession, folder: str, pages: int = 10) -> DataFrame:
    return pdf_rows(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(folder), pages)


def html_report(rows: DataFrame, title: str) -> DataFrame:
    """value: the lines of an HTML page with a table of all rows, for write.text(); cells are escaped, nulls are empty."""
    cell = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    line = F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *map(cell, rows.columns)), F.lit("</td></tr>"))
    head = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><table><tr><th>{'</th><th>'.join(map(html.escape, rows.columns))}</th></tr>"
    one = rows.sparkSession.range(1)
    return one.select(F.lit(head).alias("value")).unionAll(rows.select(line)).unionAll(one.select(F.lit("</table></body></html>")))


def read_report(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The records of a scan report: a list of {path, metadata}, or an object with successful_extractions; lines: one object by line."""
    listed = f"path string, metadata struct<{', '.join(f.replace(' ', ':', 1) for f in REPORT.split(', '))}>, successful_extractions array<struct<{', '.join(f.replace(' ', ':', 1) for f in REPORT.split(', '))}>>"
    raw = spark.read.schema(listed).json(path, multiLine=not lines)
    new = raw.filter("successful_extractions is not null").select(F.explode("successful_extractions").alias("r")).select("r.*")
    old = raw.filter("metadata is not null").select("metadata.*", "path").withColumn("file_path", F.coalesce("file_path", "path")).drop("path")
    both = new.unionByName(old)
    return both.withColumn("year", F.get(F.split("published_date", "-"), F.lit(0)))


def read_rename_csv(spark: SparkSession, path: str) -> DataFrame:
    """old, new of a rename table; headers Arquivo or File, Proposto or Proposed, in any case."""
    raw = spark.read.csv(path, header=True)
    of = lambda *names: F.coalesce(*[F.col(f"`{c}`") for c in raw.columns if c.lower() in names], F.lit(None).cast("string"))
    return raw.select(of("arquivo", "file").alias("old"), of("proposto", "proposed").alias("new")).filter("new is not null and new <> '' and old <> new")


def ls_name(line: Column) -> Column:
    """The name in a line of `ls -la`: the ninth field and all after it; null for totals."""
    fields = F.split(F.trim(line), " +")
    return F.when(~line.startswith("total") & (F.size(fields) >= 9), F.array_join(F.slice(fields, F.lit(9), F.size(fields)), " "))


def drive_id(url: Column) -> Column:
    """The id in a shared-drive link, by the first pattern that fits."""
    x = lambda rx: F.nullif(F.regexp_extract(url, rx, 1), F.lit(""))
    return F.coalesce(x(r"/file/d/([A-Za-z0-9_-]+)"), x(r"[?&]id=([A-Za-z0-9_-]+)"), x(r"/folders/([A-Za-z0-9_-]+)"))


#: The part of a catalogue API's answer that is read.
API_ANSWER = "items array<struct<volumeInfo:struct<title:string,subtitle:string,authors:array<string>,publisher:string,publishedDate:string,industryIdentifiers:array<struct<type:string,identifier:string>>>>>"


def api_record(json: Column) -> Column:
    """title, authors, publisher, date, isbn_10, isbn_13, confidence of the first item of a JSON answer."""
    v = F.get(F.from_json(json, API_ANSWER)["items"], F.lit(0))["volumeInfo"]
    identifier = lambda kind: F.get(F.filter(v["industryIdentifiers"], lambda i: i["type"] == kind), F.lit(0))["identifier"]
    return F.struct(
        v["title"].alias("title"), F.array_join(v["authors"], ", ").alias("authors"), v["publisher"].alias("publisher"), F.get(F.split(v["publishedDate"], "-"), F.lit(0)).alias("year"),
        identifier("ISBN_10").alias("isbn_10"), identifier("ISBN_13").alias("isbn_13"), F.lit(0.75).alias("confidence"),
    )

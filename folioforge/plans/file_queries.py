"""Sinks and sources of files (inventory 2.1, 2.2): each query writes the catalogue, or makes the files' contents, and reads them back."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import isbn
from folioforge.operators.tables import shared_folder
from folioforge.sources import derived as D
from folioforge.sources import formats, shared_folders

from .registry import query
from .text_queries import _TOK

_W = D.over(D.BOOKS)
_WF = D.over(D.FILES)
#: Lines of a page of the PDFs, and pages that are read.
LINES, PAGES = 25, 7


def make_epub(title: str | None, authors: str, publisher: str, date: str, number: str) -> bytes:
    """A small EPUB: its package, and two documents."""
    from xml.sax.saxutils import escape

    out = io.BytesIO()
    fields = "".join(f"<dc:{k}>{escape(v)}</dc:{k}>" for k, v in (("title", title or ""), ("creator", authors), ("publisher", publisher), ("date", date), ("identifier", f"urn:isbn:{number}")))
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("content.opf", f"<package xmlns:dc='http://purl.org/dc/elements/1.1/'><metadata>{fields}</metadata></package>")
        z.writestr("text/1.xhtml", f"<html><body><h1>{escape(title or '')}</h1></body></html>")
        z.writestr("text/2.xhtml", f"<html><body><p>ISBN {number}</p></body></html>")
    return out.getvalue()


def make_pdf(lines: list[str], number: str) -> bytes:
    """A small PDF of LINES lines by page, deflated; strings are UTF-16."""
    pages = [lines[i : i + LINES] for i in range(0, len(lines), LINES)]
    parts = [f"1 0 obj << /Title (a text) /Subject (ISBN {number}) >> endobj".encode()]
    for n, page in enumerate(pages):
        shown = zlib.compress("\n".join(["BT", *(f"<FEFF{x.encode('utf-16-be').hex()}> Tj T*" for x in page), "ET"]).encode())
        parts.append(f"{2 * n + 2} 0 obj << /Type /Page /Contents {2 * n + 3} 0 R >> endobj".encode())
        parts.append(f"{2 * n + 3} 0 obj << /Length {len(shown)} /Filter /FlateDecode >> stream\n".encode() + shown + b"\nendstream endobj")
    return b"%PDF-1.4\n" + b"\n".join(parts) + b"\n%%EOF"


def _epubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: an EPUB of each book."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in formats.pieces(frames, "title"):
            yield pd.DataFrame({"path": f["path"], "content": [make_epub(t if isinstance(t, str) else None, a, p, d, i) for t, a, p, d, i in zip(f["title"], f["authors"], f["publisher"], f["published_date"], f["isbn_13"], strict=True)]})

    rows = D.books(spark, sf_dir).select(F.col("id").cast("string").alias("path"), "title", F.array_join("authors", ", ").alias("authors"), "publisher", "published_date", "isbn_13")
    return rows.mapInPandas(run, "path string, content binary")


def _pdfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: a PDF of each document's whole text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in formats.pieces(frames, "text"):
            yield pd.DataFrame({"path": f["path"], "content": [make_pdf((t or "").split("\n"), n) for t, n in zip(f["text"], f["isbn"], strict=True)]})

    core = F.lpad((F.col("doc_id") % 1000000000).cast("string"), 9, "0")
    twelve = F.concat(F.lit("978"), core)
    rows = D.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text", F.concat(twelve, isbn.check13(twelve)).alias("isbn"))
    return rows.mapInPandas(run, "path string, content binary")


@query(_W + """SELECT id, nullif(title, '') AS title, nullif(array_to_string(authors, ', '), '') AS authors, publisher, substr(published_date, 1, 4) AS year, isbn_13 AS isbn, coalesce(title, '') || chr(10) || 'ISBN ' || isbn_13 AS text FROM books""")
def s5_epub_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of each EPUB's Dublin Core, and the text of its documents."""
    found = formats.epub_rows(_epubs(spark, sf_dir))
    year = F.substring("year", 1, 4)
    return found.select(F.col("path").cast("long").alias("id"), "title", "authors", "publisher", F.when(year.rlike("^[0-9]{4}$"), year).otherwise("Unkn").alias("year"), "isbn", "text")


@query(f"SELECT doc_id, md5(rtrim(array_to_string(string_split(text, chr(10))[1:{LINES * PAGES}], chr(10)), chr(10))) AS h FROM documents")
def s3_pdf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of the text of each PDF's first pages; how many is the feature."""
    return formats.pdf_rows(_pdfs(spark, sf_dir), PAGES).select(F.col("path").cast("long").alias("doc_id"), F.md5(F.regexp_replace("text", "\n+$", "").cast("binary")).alias("h"))


@query(f"SELECT doc_id, c12 || {D.check13_sql('c12')} AS isbn FROM (SELECT doc_id, '978' || lpad(CAST(doc_id % 1000000000 AS VARCHAR), 9, '0') AS c12 FROM documents)")
def z13_pdf_info_isbn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ISBN in the information dictionary of each PDF."""
    found = formats.pdf_rows(_pdfs(spark, sf_dir), 0)
    return found.select(F.col("path").cast("long").alias("doc_id"), F.regexp_extract("info", r"ISBN ([0-9]{13})", 1).alias("isbn"))


@query(_W + "SELECT isbn_13, title, array_to_string(authors, '|') AS authors, publisher, string_split(published_date, '-')[1] AS year, confidence FROM books")
def k1_json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan report: written as JSON, an object with its records by line, and read again by the report reader (S9)."""
    out = shared_folder(spark)
    fields = ["title", "authors", "publisher", "published_date", "isbn_10", "isbn_13", F.col("confidence").alias("confidence_score"), "source", F.lit(None).cast("string").alias("file_path")]
    D.books(spark, sf_dir).select(F.array(F.struct(*fields)).alias("successful_extractions")).write.option("ignoreNullFields", "false").json(out)
    return formats.read_report(spark, out, lines=True).select("isbn_13", "title", F.array_join("authors", "|").alias("authors"), "publisher", "year", F.col("confidence_score").alias("confidence"))


@query(_W + """SELECT '<tr><td>' || CAST(id AS VARCHAR) || '</td><td>' || coalesce(title, '') || '</td><td>' || replace(replace(replace(publisher, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</td></tr>' AS value FROM books""")
def k2_html_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The HTML report of all books, written as text and read again: its rows."""
    out = shared_folder(spark)
    formats.html_report(D.books(spark, sf_dir).select("id", "title", "publisher"), "Books & more").write.text(out)
    return spark.read.text(out).filter(F.col("value").startswith("<tr><td>"))


@query(f"WITH t AS (SELECT DISTINCT doc_id, unnest({_TOK.format('text')}) AS term FROM documents) SELECT term, count(*) AS postings FROM t GROUP BY term")
def k6_index_persist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted index, written once as Parquet and read again: one row per posting, so that no term's list is ever one row."""
    from folioforge.functions import text as T

    out = shared_folder(spark)
    D.read(spark, sf_dir, "documents").select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"), "doc_id").write.parquet(out)
    return spark.read.parquet(out).groupBy("term").agg(F.count("*").alias("postings"))


@query(_WF + "SELECT path AS old, replace(path, ' ', '_') AS new FROM files WHERE path <> replace(path, ' ', '_')")
def s10_rename_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rename table: written as CSV with the other language's headers and read again; names that stay are left out."""
    out = shared_folder(spark)
    D.files(spark, sf_dir).select(F.col("path").alias("Arquivo"), F.translate("path", " ", "_").alias("Proposto")).write.option("header", True).csv(out)
    return formats.read_rename_csv(spark, out)


def _folder_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """publisher, html: the page of a shared folder of each publisher, with its books by year as the JSON of the page's settings. What stands
    under `recent` is not below an inner key, and folders have no size."""
    f = D.files(spark, sf_dir).select("publisher", "year", F.struct(F.col("path").alias("name"), (F.col("id") * 1000).alias("size")).alias("file"))
    years = f.groupBy("publisher", "year").agg(F.array_sort(F.collect_list("file")).alias("files"))
    items = years.groupBy("publisher").agg(F.array_sort(F.collect_list(F.struct(F.col("year").alias("name"), F.struct(F.array("files").alias("items")).alias("content")))).alias("children"))
    tree = F.to_json(F.struct(F.struct("children").alias("items"), F.struct(F.lit("hidden.pdf").alias("name"), F.lit(1).alias("size")).alias("recent")))
    return items.select("publisher", F.concat(F.lit('<a title="Guide.TXT">guide</a><script>window._cfg = '), tree, F.lit(";</script>")).alias("html"))


@query(
    _WF
    + """SELECT DISTINCT publisher, name, NULL::BIGINT AS size, lower(regexp_extract(name, '(\\.[^.]+)$', 1)) AS ext, 'web_scraping' AS source FROM (SELECT publisher, path AS name FROM files UNION ALL SELECT publisher, 'hidden.pdf' FROM files UNION ALL SELECT publisher, 'Guide.TXT' FROM files)
UNION ALL SELECT publisher, path, id * 1000, '.' || ext, 'json_extraction' FROM files"""
)
def s13_shared_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that each shared folder's page names, by its patterns and by walking its JSON."""
    return shared_folders.folder_files(_folder_pages(spark, sf_dir), "publisher", F.col("html"))


@query(_WF + "SELECT 'ext=' || ext AS folder, count(DISTINCT publisher) AS total FROM files GROUP BY ext")
def s1_collect_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the catalogue as Spark wrote them, one by format and publisher: listed again, and counted by folder."""
    out = shared_folder(spark)
    D.files(spark, sf_dir).select("id", "path", "ext", "publisher").repartition("ext", "publisher").write.partitionBy("ext", "publisher").parquet(out)
    found = shared_folders.collect_files(spark, out, recursive=True, extensions=("parquet",))
    return found.groupBy(F.regexp_extract("path", "(ext=[a-z]+)", 1).alias("folder")).agg(F.count("*").alias("total"))

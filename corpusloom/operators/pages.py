"""Paginated documents: page numbers, reference sections, lines that repeat from page to page, chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.masks import anonymize
from corpusloom.functions.text import BLANK, strip, until_match, word_chunks

#: Headings that begin a list of references.
REFERENCES = ["References", "Bibliography", "Bibliografía", "Referencias", "Works Cited", "Fuentes"]
HEADING = rf"(?iu)^(?:{'|'.join(REFERENCES)})$"
PAGE_NUMBER = r"^\p{Nd}{1,4}$"


def clean_page(c: str | Column) -> Column:
    """A page without lines that are only a page number, up to a heading of references."""
    lines = F.split(F.col(c) if isinstance(c, str) else c, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]", -1)
    return F.array_join(until_match(F.filter(lines, lambda s: ~strip(s).rlike(PAGE_NUMBER)), HEADING), "\n")


def repeated_lines(pages: DataFrame, source: str = "source", page: str = "page_no", text: str = "text", threshold: float = 0.3, min_pages: int = 3) -> DataFrame:
    """(source, line): stripped lines on at least `threshold` of a source's pages, for sources of `min_pages` or more.

    With three pages any line reaches 0.3, so such documents lose all their lines; raise `threshold` to avoid it.
    """
    n = pages.groupBy(source).agg(F.count(F.lit(1)).alias("n_pages")).filter(F.col("n_pages") >= min_pages)
    raw = pages.select(source, F.explode(F.array_distinct(F.split(text, "\n", -1))).alias("raw"))
    counted = raw.withColumn("line", strip("raw")).filter("line <> ''").groupBy(source, "line").agg(F.count(F.lit(1)).alias("c"))
    return counted.join(n, source).filter(F.col("c") / F.col("n_pages") >= threshold).select(source, "line")


def drop_repeated(pages: DataFrame, source: str = "source", page: str = "page_no", text: str = "text", threshold: float = 0.3, min_pages: int = 3) -> DataFrame:
    """pages whose repeated lines are gone; lines keep their order. The anti join is on (source, line)."""
    bad = repeated_lines(pages, source, page, text, threshold, min_pages)
    lines = pages.select(source, page, F.posexplode(F.split(text, "\n", -1)).alias("pos", "raw")).withColumn("line", strip("raw"))
    kept = lines.join(bad, [source, "line"], "left_anti")
    body = kept.groupBy(source, page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda x: x["raw"]), "\n").alias("_body"))
    return pages.join(body, [source, page], "left").withColumn(text, F.coalesce("_body", F.lit(""))).drop("_body")


def chunks(pages: DataFrame, source: str = "source", page: str = "page_no", text: str = "text", size: int = 400, overlap: int = 50, min_doc: int = 500, min_chunk: int = 200, mask: Callable[[str], Column] = anonymize) -> DataFrame:
    """(text, source, register, chunk_no): windows of the whole documents, masked by `mask` before and after cutting, each normal
    form once over all sources (the first by source and number); short documents and windows are dropped."""
    whole = pages.groupBy(source).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page, text))), lambda x: x[text]), "\n").alias("doc"))
    cut = whole.filter(F.length(strip("doc")) >= min_doc).select(source, F.posexplode(word_chunks(mask("doc"), size, overlap)).alias("chunk_no", "text"))
    long = cut.filter(F.length("text") >= min_chunk).withColumn("key", F.sha1(F.regexp_replace(F.lower(strip("text")), rf"[{BLANK}]+", " ")))
    first = long.groupBy("key").agg(F.min(F.struct(source, "chunk_no")).alias("f")).select("f.*")
    return long.join(first, [source, "chunk_no"], "left_semi").select(mask("text").alias("text"), source, F.lit("academic").alias("register"), "chunk_no")

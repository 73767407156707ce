"""Documents (DOCX, PDF), JSON lines, prompt catalogues and model streams."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import strip
from corpusloom.session import ship

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str:
    """Non-blank paragraphs, then the tables' rows with their non-blank cells joined by " | "."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t"))
    parts = [t for p in body.findall(f"{_W}p") if (t := said(p)).strip()]
    for row in (r for t in body.findall(f"{_W}tbl") for r in t.findall(f"{_W}tr")):
        cells = ["\n".join(said(p) for p in c.findall(f"{_W}p")).strip() for c in row.findall(f"{_W}tc")]
        if any(cells):
            parts.append(" | ".join(c for c in cells if c))
    return "\n".join(parts)


def docx_bytes(text: str) -> bytes:
    """A document whose paragraphs are the lines of the text; control characters that XML cannot hold become blanks."""
    ElementTree.register_namespace("w", _W[1:-1])
    root = ElementTree.Element(f"{_W}document")
    body = ElementTree.SubElement(root, f"{_W}body")
    for line in re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", " ", text or "").replace("\r", " ").split("\n"):
        run = ElementTree.SubElement(ElementTree.SubElement(body, f"{_W}p"), f"{_W}r")
        ElementTree.SubElement(run, f"{_W}t").text = line
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as packed:
        packed.writestr("word/document.xml", ElementTree.tostring(root, encoding="utf-8"))
    return out.getvalue()


def pdf_pages(content: bytes) -> list[str]:
    """Text of each page, where a PDF library is installed."""
    import pdfplumber

    with pdfplumber.open(io.BytesIO(content)) as pdf:
        return [page.extract_text() or "" for page in pdf.pages]


#: Characters of text after which rows go out.
OUT_CHARS = 1 << 22


def extract_documents(files: DataFrame, pdf: Callable[[bytes], list[str]] = pdf_pages) -> DataFrame:
    """(source, page_no, text, error) of files (path, content); a file that fails is one row with its error."""
    ship(files.sparkSession)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                name = name.as_py()
                try:
                    pages = pdf(content.as_py()) if name.lower().endswith(".pdf") else [docx_text(content.as_py())]
                    rows += [(name, i, t, None) for i, t in enumerate(pages)]
                    size += sum(len(t or "") for t in pages)
                except Exception as failed:  # noqa: BLE001  whatever a damaged file raises is its result
                    rows.append((name, None, None, f"{type(failed).__name__}: {failed}"))
                if len(rows) >= 1024 or size >= OUT_CHARS:
                    yield as_batch(rows)
                    rows, size = [], 0
        if rows:
            yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"source": pa.string(), "page_no": pa.int64(), "text": pa.string(), "error": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

    return files.select("path", "content").mapInArrow(extract, "source string, page_no long, text string, error string")


def read_documents(spark: SparkSession, path: str, pdf: Callable[[bytes], list[str]] = pdf_pages) -> DataFrame:
    """`extract_documents` of all DOCX and PDF files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{pdf,docx}").load(path)
    return extract_documents(files, pdf)


def file_counts(documents: DataFrame) -> DataFrame:
    """(processed, failed) files of `read_documents`."""
    per = documents.groupBy("source").agg(F.max(F.col("error").isNotNull()).alias("bad"))
    return per.agg(F.count_if(~F.col("bad")).alias("processed"), F.count_if("bad").alias("failed"))


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = True) -> DataFrame:
    """JSON lines; blank lines are skipped. A bad line stops the read, or, not `strict`, is kept in `_corrupt_record`."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    kept = T.StructType(list((T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields)).add("_corrupt_record", T.StringType())
    return spark.read.schema(kept).json(path)


def read_test_texts(spark: SparkSession, path: str, registers: tuple[str, ...] = ("casual", "email_prof", "academic")) -> DataFrame:
    """(register, text): the original texts of a test split, a row each; other registers are ignored."""
    rows = read_jsonl(spark, path, "text string, register string, original_text string")
    return rows.filter(F.col("register").isin(*registers)).select("register", F.col("original_text").alias("text"))


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(register, pos, prompt): the non-blank lines of one file per register, stripped, numbered from 0.

    The register is the name of the file, or that of its folder if this is called register=name.
    """
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/register=([^/]+)/", 1)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    whole = files.select(F.when(folder != "", folder).otherwise(stem).alias("register"), "value")
    lines = F.filter(F.transform(F.split("value", "\r\n|\r|\n", -1), strip), lambda s: s != "")
    return whole.select("register", F.posexplode(lines).alias("pos", "prompt"))


TOKEN = "response string, done boolean, eval_count long, eval_duration long"


def ndjson_tokens(stream: DataFrame, call: str, pos: str, line: str) -> DataFrame:
    """(call, pos, token, done, eval_count, eval_duration): tokens of each call up to its first `done`, bad lines skipped."""
    from pyspark.sql import Window

    parsed = stream.select(call, pos, F.from_json(strip(line), TOKEN).alias("j")).filter("j IS NOT NULL AND (j.response IS NOT NULL OR j.done IS NOT NULL)")
    before = F.coalesce(F.sum(F.coalesce(F.col("j.done"), F.lit(False)).cast("int")).over(Window.partitionBy(call).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parsed.withColumn("_b", before).filter("_b = 0").select(call, pos, F.coalesce("j.response", F.lit("")).alias("token"), F.coalesce("j.done", F.lit(False)).alias("done"), "j.eval_count", "j.eval_duration")


def sse_tokens(body: str | Column) -> Column:
    """Tokens of a complete server-sent event stream: data lines up to [DONE]; a partial last line and bad JSON do not count."""
    c = F.col(body) if isinstance(body, str) else body
    lines = F.filter(F.slice(F.split(c, "\n", -1), F.lit(1), F.size(F.split(c, "\n", -1)) - 1), lambda s: s.startswith("data: "))
    data = F.transform(lines, lambda s: strip(F.substring(s, F.lit(7), F.length(s))))
    end = F.array_position(data, "[DONE]")
    open_ = F.when(end > 0, F.slice(data, F.lit(1), (end - 1).cast("int"))).otherwise(data)
    return F.filter(F.transform(open_, lambda s: F.get_json_object(s, "$.token")), lambda t: t.isNotNull())


def sse_event(token: Column, done: Column, eval_count: Column, rate: Column) -> Column:
    """The data line of one token or of the end of a stream."""
    last = F.to_json(F.struct(F.lit(True).alias("done"), eval_count.alias("eval_count"), rate.alias("tokens_per_sec")))
    return F.concat(F.lit("data: "), F.when(done, last).otherwise(F.to_json(F.struct(token.alias("token")))), F.lit("\n\n"))


def generation_key(register: Column, prompt: Column) -> Column:
    """The key of a cached generation: its content, not the generator's address."""
    return F.sha2(F.concat_ws("‖", register, prompt), 256)


def model_names(listing: str) -> list[str]:
    """Names in a model server's listing."""
    return [m["name"] for m in json.loads(listing).get("models", [])]

"""Mailboxes: a data source for mbox files, and the mails of one sender without quotes, signatures and newsletters."""

from __future__ import annotations

import email
import email.header
import email.utils
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.functions.masks import anonymize
from corpusloom.functions.text import contains_any, html_text, strip, until_match
from corpusloom.session import ship

MAX_PART_BYTES = 500_000
PARTS = "from string, subject string, labels string, parts array<struct<ctype:string,charset:string,payload:binary>>"
#: Words of subjects to skip, labels of sent mail, where a mail's own text stops, and quoted blocks.
SKIP_SUBJECTS = ["unsubscribe", "newsletter", "noreply", "no-reply", "automated"]
SENT = ["Sent", "Enviado"]
STOPS = [
    r"(?i)^>",
    r"(?i)^On .+ <.+@.+> wrote:",
    r"(?iu)^El .+ escribió:",
    r"(?i)^-{3,}",
    r"(?i)^_{3,}",
    r"(?i)^--$",
    r"(?i)^Enviado desde mi (?:iPhone|Android|iPad)",
    r"(?i)^Este mensaje y sus adjuntos",
    r"(?i)^This email and any attachments",
    r"(?i)^CONFIDENTIAL(?![\p{L}\p{N}_])",
]
QUOTE = r"(?isu)El .{5,80} escribió:|De:.*\nEnviado:.*\nPara:.*\n"


def decode_header(value: str | None) -> str:
    """An encoded header as text, its parts joined by blanks, errors replaced; nothing for none."""
    out = []
    for part, charset in email.header.decode_header(value) if value else []:
        if isinstance(part, bytes):
            try:
                part = part.decode(charset or "utf-8", errors="replace")
            except LookupError:
                part = part.decode("utf-8", errors="replace")
        out.append(part)
    return " ".join(out)


def parse_message(raw: bytes) -> tuple:
    message = email.message_from_bytes(raw)
    parts = []
    for part in message.walk():
        if part.get_content_type() in ("text/plain", "text/html") and (payload := part.get_payload(decode=True)):
            parts.append({"ctype": part.get_content_type(), "charset": part.get_content_charset() or "utf-8", "payload": payload[:MAX_PART_BYTES]})
    return str(message.get("From", "")), decode_header(str(message.get("Subject", ""))), decode_header(str(message.get("X-Gmail-Labels", ""))), parts


def read_mbox(spark: SparkSession, path: str) -> DataFrame:
    """(from, subject, labels, parts, file, number) of mbox files, read by Spark's readers so that any store works.

    Files are split at lines that begin with "From "; the messages are parsed in batches by the workers.
    """
    ship(spark)
    whole = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                for number, raw in enumerate(re.split(rb"(?m)^From [^\n]*\n", bytes(content))[1:]):
                    rows.append((*parse_message(re.sub(rb"(?m)^>(>*From )", rb"\1", raw)), name, number))
                    if len(rows) >= 256:
                        yield pd.DataFrame(rows, columns=["from", "subject", "labels", "parts", "file", "number"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["from", "subject", "labels", "parts", "file", "number"])

    return whole.mapInPandas(parse, f"{PARTS}, file string, number long")


@F.pandas_udf(StringType())
def address(value: pd.Series) -> pd.Series:
    """The address of a From header."""
    return value.map(lambda v: email.utils.parseaddr(decode_header(v))[1])


@F.pandas_udf(StringType())
def decoded(payload: pd.Series, charset: pd.Series) -> pd.Series:
    def one(p: bytes, c: str) -> str | None:
        if p is None:
            return None
        try:
            return bytes(p).decode(c or "utf-8", errors="replace")
        except LookupError:
            return bytes(p).decode("utf-8", errors="replace")

    return pd.Series([one(p, c) for p, c in zip(payload, charset, strict=True)], dtype=object)


def own_text(body: str):
    """The text before quoted blocks and before the first line that begins a quote, signature or disclaimer."""
    head = F.split(F.col(body), QUOTE, 2)[0]
    return strip(F.array_join(until_match(F.split(head, "\n", -1), "|".join(f"(?:{p})" for p in STOPS)), "\n"))


def mails(messages: DataFrame, sender: str, min_len: int = 100, mask: bool = True) -> DataFrame:
    """(text, subject, register): mails of exactly this sender (any case), sent ones where labels tell, plain text before
    HTML. The cheap conditions come before the bodies are decoded."""
    sent = (F.coalesce(F.col("labels"), F.lit("")) == "") | F.exists(F.array(*[F.lit(s) for s in SENT]), lambda s: F.contains("labels", s))
    few = messages.filter(F.contains(F.lower("from"), F.lit(sender.lower()))).filter(F.lower(address("from")) == sender.lower()).filter(sent).filter(~contains_any("subject", SKIP_SUBJECTS))
    parts = few.select("file", "number", "subject", F.posexplode("parts").alias("pos", "part"))
    texts = parts.withColumn("t", decoded("part.payload", "part.charset"))
    texts = texts.withColumn("t", F.when(F.col("part.ctype") == "text/html", html_text("t")).otherwise(F.col("t")))
    joined = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part.ctype") == kind, F.struct("pos", "t")))), lambda x: x["t"]), "\n")
    bodies = texts.groupBy("file", "number", "subject").agg(joined("text/plain").alias("p"), joined("text/html").alias("h"), F.max(F.col("part.ctype") == "text/plain").alias("plain"))
    out = bodies.withColumn("body", F.when(F.col("plain"), F.col("p")).otherwise(F.col("h"))).withColumn("text", own_text("body")).filter(F.length("text") >= min_len)
    return out.select((anonymize("text") if mask else F.col("text")).alias("text"), "subject", F.lit("email_prof").alias("register"))


__all__ = ["address", "decode_header", "mails", "own_text", "parse_message", "read_mbox"]

"""Chat exports: lines in order, messages assembled from them, those of one author kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.masks import anonymize
from corpusloom.functions.text import BLANK, casefold, strip

#: How a message line begins, and what marks a line of the app itself.
LINE = (
    rf"(?i)^\[?(\p{{Nd}}{{1,2}}/\p{{Nd}}{{1,2}}/\p{{Nd}}{{2,4}}),?[{BLANK}]+"
    rf"(\p{{Nd}}{{1,2}}:\p{{Nd}}{{2}}(?::\p{{Nd}}{{2}})?(?:[{BLANK}]*[ap]\.?[{BLANK}]*m\.?)?)"
    rf"\]?[{BLANK}]*[–\-]?[{BLANK}]*(.+?):[{BLANK}]+(.*)"
)
SYSTEM = ["<Multimedia omitido>", "imagen omitida", "audio omitido", "video omitido", "sticker omitido", "Se cifran los mensajes", "Los mensajes y las llamadas", "cambió el asunto", "añadió a", "eliminó a", "salió del grupo"]
SYSTEM_LINE = "(?iu)" + "|".join(SYSTEM)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, line) of text files, in order: a file is read whole, as only that keeps lines in place."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"^\x{FEFF}", "").alias("value"))
    return whole.select("file", F.posexplode(F.split("value", "\r\n|\r|\n", -1)).alias("pos", "line"))


def messages(lines: DataFrame, author: str, file: str = "file", pos: str = "pos", line: str = "line", min_len: int = 30, mask: bool = True) -> DataFrame:
    """(text, register, file, pos): messages of the author (any case), system messages and short ones dropped.

    A line that begins a message opens an island; lines up to the next one belong to it, joined by blanks if not blank.
    """
    clean = lines.select(file, pos, strip(F.regexp_replace(line, "[‎‏]", "")).alias("l"))
    parsed = clean.select(file, pos, "l", F.col("l").rlike(LINE).alias("starts"), strip(F.regexp_extract("l", LINE, 3)).alias("author"), strip(F.regexp_extract("l", LINE, 4)).alias("body"))
    island = F.sum(F.col("starts").cast("int")).over(Window.partitionBy(file).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    parts = parsed.withColumn("island", island).filter("island > 0 AND (starts OR l <> '')")
    piece = F.struct(pos, F.when(F.col("starts"), F.col("body")).otherwise(F.col("l")).alias("t"), F.when(F.col("starts"), F.col("author")).alias("a"))
    grouped = parts.groupBy(file, "island").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    made = grouped.select(file, F.col("p")[0][pos].alias(pos), F.col("p")[0]["a"].alias("author"), strip(F.array_join(F.transform("p", lambda x: x["t"]), " ")).alias("text"))
    own = made.filter(casefold("author") == casefold(strip(F.lit(author))))
    kept = own.filter((F.length("text") >= min_len) & ~F.col("text").rlike(SYSTEM_LINE))
    return kept.select((anonymize("text") if mask else F.col("text")).alias("text"), F.lit("casual").alias("register"), file, pos)


def match_rate(lines: DataFrame, line: str = "line") -> DataFrame:
    """(total_lines, matched_lines)"""
    l = strip(F.regexp_replace(line, "[‎‏]", ""))
    return lines.agg(F.count(F.lit(1)).alias("total_lines"), F.count_if(l.rlike(LINE)).alias("matched_lines"))

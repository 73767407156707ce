"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and is written as Parquet before the
next one reads it. All but the last return the columns of documents; n_chars follows the text where a stage changes it.
Rows whose text is null or empty pass through like others: such a text has a score, no lines, no copies among others and
no words to be mixed, so the mixing stage is where it goes.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, linededup, minhash, mixing, quality
from corpusloom.session import checkpoint_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the ranking learned from `labels` puts below its threshold."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs.select(*COLUMNS), model).filter(F.col("quality_score") >= quality.THRESHOLD).drop("quality_score")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines covered by later occurrences of three-line windows; a text of which nothing is left goes."""
    out = linededup.dedup_lines(docs.select(*COLUMNS))
    # lines are counted, not looked for in the new text, which is thus made once
    left = out.filter("line_dedup.n_removed = 0 OR line_dedup.n_removed < line_dedup.n_lines")
    text = F.col("line_dedup.text")
    return left.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    return minhash.keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents, some more than once, so that the sources come near their target shares."""
    return mixing.mixed(docs.select(*COLUMNS)).select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every text; the ids decode to its bytes, of which the digest is kept."""
    out = bpe.tokenize(docs.select(*COLUMNS), public_tokenizers.path("byte_bpe_50k.tiktoken"), keep=["doc_id", "lang", "source"])
    return out.select("doc_id", "lang", "source", "bpe.n_tokens", "bpe.ids", F.sha2("bpe.decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("source_mixing", source_mixing),
    ("byte_bpe", byte_bpe),
]

#: SQL can express neither the learned ranking nor byte-level merges; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents, each written to a folder of the shared checkpoint folder and read again.

    The folder of a stage goes once the next one is written, that of the last with the application; if a stage fails, what
    was written stays.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/pipeline-{jvm.java.util.UUID.randomUUID()}")
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.deleteOnExit(folder)
    past = None
    for number, (name, stage) in enumerate(STAGES):
        now = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(now)
        docs = spark.read.parquet(now)
        if past:
            store.delete(jvm.org.apache.hadoop.fs.Path(past), True)
        past = now
    return docs

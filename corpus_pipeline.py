"""A corpus from raw documents to piece ids, in five stages.

Every stage takes all documents that the one before kept and, but for the
last, returns them with the columns of ``documents``, whatever other columns and
names it has.  An empty table goes through every stage and stays empty.  No SQL
can express the compression ratios, the singular vectors or the piece ids, so
there is none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeframe.llm.latent import benchmark_leaks
from edgeframe.llm.near_dups import BROADCAST_IDS, near_duplicates
from edgeframe.llm.pieces import encode_pieces
from edgeframe.llm.quality import quality_report
from edgeframe.llm.secrets import redact_secrets
from edgeframe.llm.shared import stored


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` whose ``doc_id`` is not among ``ids``; rows without an id stay."""
    ids = stored(ids.select("doc_id").distinct(), "pipeline-dropped")
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti").select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and compression bands reject go.

    Null, empty and wordless texts are rejected; repeated rows are judged alike.
    """
    # own names, so that no column of the documents clashes with the report's
    own = {c: c if c == "text" else f"doc:{c}" for c in docs.columns}
    report = quality_report(docs.select(*(F.col(c).alias(x) for c, x in own.items()))).filter("kept")
    return report.select(*(F.col(f"`{x}`").alias(c) for c, x in own.items()))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.

    Rows without an id and texts without words stay; rows of a repeated id stay or go together.
    """
    return _without(docs, near_duplicates(docs).filter(~F.col("kept")))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go.

    Rows without an id or text stay; all rows of an id go if one of them holds a passage.
    """
    return _without(docs, benchmark_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every reported secret is masked; ``n_chars`` follows the text.

    Null texts stay null, their ``n_chars`` becomes null; repeated rows stay as many.
    """
    masked = redact_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of each document, and a digest of the text they decode to.

    Null and empty texts have no pieces; repeated rows stay as many.
    """
    import public_tokenizers

    return encode_pieces(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), decoded=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mask_secrets", mask_secrets),
    ("tokenize", tokenize),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one keeps is written before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

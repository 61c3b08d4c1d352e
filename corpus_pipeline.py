"""A corpus pipeline of five stages; each calls one operator of ``featshift.llm``.

``run`` writes what a stage returns as Parquet and reads it as the next one's ``docs``. A
stage stores its own tables in a scope of its own, which the following stage removes: by
then the stage's result has been written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featshift.catalog.base import Query, table
from featshift.llm import decontaminate, line_dedup, minhash, pieces, quality
from featshift.llm.queries import tokenizer_path
from featshift.llm.shelves import shuffles_removed
from featshift.storage import drop_scope, materialize, scope

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects."""
    with scope("stage-quality"):
        model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
        return quality.score_quality(docs, model).filter("predicted = 1").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines that repeat or nearly repeat an earlier one; a document that loses all of its lines goes."""
    drop_scope(spark, "stage-quality")
    with scope("stage-lines"):
        left = line_dedup.dedup_lines(docs.select(*COLUMNS)).filter("n_removed = 0 or n_removed < n_lines")
        return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    drop_scope(spark, "stage-lines")
    with scope("stage-near"):
        classes = minhash.near_duplicates(docs, size=5, percent=80)
        gone = classes.filter("not kept").select("doc_id")
        return docs.select(*COLUMNS).join(gone.hint("merge"), "doc_id", "left_anti").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold ten words in a row of a benchmark item, or a whole shorter one."""
    drop_scope(spark, "stage-near")
    with scope("stage-benchmark"):
        _, spans = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
        hit = spans.select(F.col("doc_id").alias("hit")).distinct()
        return docs.select(*COLUMNS).join(hit.hint("merge"), docs["doc_id"].eqNullSafe(F.col("hit")), "left_anti").select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add the piece ids of each text, how many they are, and the text that they decode to."""
    drop_scope(spark, "stage-benchmark")
    encoded = pieces.encode_pieces(docs.select(*COLUMNS), tokenizer_path("piece_bpe_32k.model"), decoded="decoded")
    return encoded.withColumn("n_tokens", F.size("piece_ids").cast("long"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near-duplicates", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("piece encoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with shuffles_removed(spark):
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs


#: The classifier and the encoder cannot be said in SQL; ``tests/llm/test_pipeline.py`` holds the run against plain Python.
ORACLE_SQL = None

QUERY = Query("pipeline", run, ORACLE_SQL)

"""From raw documents to packed training sequences: five stages, each a written table.

Language ID drops documents without a language and sets ``lang``; line dedup
rewrites texts without lines that many documents share; near-duplicate search
by SimHash keeps one document of each group at five-word Jaccard 0.8; mixing repeats or leaves out documents
so that sources meet their target weights, in curriculum order; packing
encodes the rest into sequences.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

import pulsepanel
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsepanel.llm import langid, lines, mixing, neardups, packing
from pulsepanel.llm.common import written
from pulsepanel.llm.queries import vocabulary

# Ship the package's own functions inside task closures, so that executors need no installation of it.
cloudpickle.register_pickle_by_value(pulsepanel)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.rewritten(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardups.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary())


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixture", mixture), ("pack", pack)]

#: Language ID, fingerprints and token ids have no SQL form; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over ``documents``; every stage is written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return written(STAGES[-1][1](spark, docs, sf_dir), "pipeline-pack")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences without their ids, one row per piece."""
    return run(spark, sf_dir).select(*[F.col(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

"""From raw documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a
DataFrame, which ``run`` writes as Parquet into the cluster's shared folder and reads again.  All but the
last return the columns of documents.  Empty tables pass through every stage; null and empty texts are
scored, grouped, searched and packed like others, as each operator states; of repeated rows one stays; other columns
than those of documents are left out by the first stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from terracell.llm import common, decontam, neardup, packing, pii, quality
from terracell.plans.iterate import shared_folder

DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*[c for c in DOCUMENTS if c in docs.columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    docs = _documents(docs)
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, keep=tuple(docs.columns))
    return scored.where("predicted = 1").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id."""
    return neardup.keep_one(_documents(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold a whole window of a benchmark item, or two short items."""
    docs = _documents(docs)
    found = decontam.find(docs, common.table(spark, sf_dir, "benchmark"), keep=tuple(c for c in docs.columns if c not in ("doc_id", "text")))
    hit = F.aggregate("hits", F.lit(0), lambda n, h: n + h["end"] - h["start"])
    return found.where((F.size("items") < decontam.MIN_ITEMS) & (hit < decontam.WINDOW)).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets."""
    return pii.redact(_documents(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens packed into sequences of 2048."""
    return packing.best_fit_pack(docs, packing.public_tokenizer(), packing.CAPACITY)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL: the classifier's weights, verified similarity groups and token ids can't be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

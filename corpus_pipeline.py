"""A training corpus in five stages: toxicity, near duplicates, decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and gives the rows that it keeps, with the
columns of documents; the last gives tokens. ``run`` writes each stage's rows and
reads them again as the next one's input.

A stage's result reads the tables that the stage made, so it has to be written before
the next stage is called: that one begins by deleting them.

Defined cases, in every stage: rows with a null id are kept unless their own text is
rejected; null and empty texts are no copies of each other and hold nothing; rows with the
same id are judged each by its own text, but of two texts of one id that a class holds
only one row stays; further columns pass through; empty tables give empty tables.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vestigia.llm import bpe, decontamination, jaccard, pii, toxicity
from vestigia.plans.session import apply_memory
from vestigia.plans.storage import discard, materialize, recorded

_made: dict[str, list[DataFrame]] = {}


def _stage(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Deletes what the stages before have left behind, and remembers what this one makes."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for name in [n for n in _made if n != function.__name__]:
            discard(*(t for t in _made.pop(name) if t.sparkSession.sparkContext is spark.sparkContext))
        apply_memory(spark)  # holds for the result too, which the caller writes
        with recorded() as tables:
            out = function(spark, docs, sf_dir)
        _made.setdefault(function.__name__, []).extend(tables)
        return out

    return run_stage



@_stage
def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go; the model learns from labelled rows that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.kept(docs, toxicity.train(docs, labels))


@_stage
def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents linked by five-word sequences at 0.8 the smallest id stays."""
    found = materialize(jaccard.classes(docs, words=5, percent=80), "classes")
    dropped = found.where("doc_id != component_id").select("doc_id")
    kept = docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    repeated = found.where("doc_id is not null and doc_id = component_id and n_shingles > 0").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    # Of rows with one id the one of the least text stays, so that every run keeps the same.
    rows = kept.join(repeated, "doc_id", "left_semi").select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    one = rows.groupBy(F.col("row.doc_id").alias("id")).agg(F.min_by("row", F.struct(F.col("row.text").isNull(), "row.text", F.xxhash64(F.to_json("row")))).alias("row"))
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).union(one.select("row.*"))


@_stage
def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item's template go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.clean(docs, benchmark)


@_stage
def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it are replaced; n_chars follows the text."""
    out = pii.masked(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


@_stage
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its number of tokens and their ids, little-endian unsigned 32-bit."""
    ids = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return ids.select("doc_id", F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("personal_data", mask_personal_data),
    ("tokens", tokenize),
]

#: No stage can be told in SQL; tests/llm hold stages against plain Python, the README says which.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

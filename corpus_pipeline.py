"""Training-data pipeline: five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Toxic documents go; one document of each
near-duplicate group stays; later copies of long passages are cut from texts; documents are sampled to the target mix; what is
left is packed. All stages but the last return the columns of documents.

Null texts are empty: they are clean, copies of one another (one stays), have nothing to cut, and are sampled like their cell. Null ids are later
than any id. Repeated rows are copies. Columns of any name are carried, also those that an operator uses itself. Empty tables pass as such."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstide.llm import lpf_dedup, mixing, near_copies, packing, toxicity
from crosstide.llm.common import Scratch, table, unused


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4, learned from all documents' labels; rows that score the threshold or more go."""
    model = toxicity.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    score = unused("__score", docs.columns)
    return toxicity.scored(docs, model, score).filter(F.col(score) < toxicity.THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7 on five-word shingles: its close fingerprints are the first candidates; tensored keys add the copies whose fingerprints differ
    in more than two bits. Links need an exact similarity of 0.8 or more, and one row of each component stays."""
    return near_copies.distinct_documents(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3; n_chars is counted anew."""
    kept = lpf_dedup.removed(docs, keep=True)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*[F.col(f"`{c}`") for c in docs.columns])


def sample_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10; the sampled documents stay. Columns named like the operator's own go by another name meanwhile."""
    held = {c: unused(f"held_{i}", docs.columns) for i, c in enumerate(docs.columns) if c.startswith("__")}
    kept = mixing.mixed(docs.withColumnsRenamed(held)).filter("__sampled")
    return kept.select(*[F.col(f"`{held.get(c, c)}`").alias(c) for c in docs.columns])


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2; one row per piece."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("repeats", drop_repeats), ("mix", sample_mix), ("packing", pack_windows)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over documents."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(name, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Near copies: of documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, the first stays.

Candidates come from SimHash (fingerprints of five-word shingles that differ in at most two bits, by pigeonhole blocks) and from the
tensored keys of set_links, since two bits find few copies with several changed words. Each candidate is confirmed on the full sets, and
all links join components: no cap, and no pair is left out. Of each component the row with the smallest (doc_id, nulls last, row key) is
first. Null and empty texts equal each other, so one of them stays; repeated rows are copies. An empty table gives none. Columns of any
name are carried; only doc_id and text are read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstide.llm import simhash
from crosstide.llm.common import Scratch, unused
from crosstide.llm.set_links import HOT, PERCENT, linked

WORDS = 5


def close_fingerprints(scratch: Scratch, rows: DataFrame, words: int = WORDS) -> DataFrame:
    """Pairs (a, b) of row keys whose SimHash fingerprints are equal or close, enough to connect all of them."""
    prints = scratch.table("fingerprints", simhash.fingerprints(rows.select(F.col("__row").alias("doc_id"), "text"), words))
    firsts = scratch.table("distinct", prints.groupBy("f").agg(F.min("id").alias("node")))
    equal = prints.join(firsts, "f").filter("id <> node").select(F.col("node").alias("a"), F.col("id").alias("b"))
    return equal.union(simhash.links(scratch, firsts))


def distinct_documents(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, hot: int = HOT) -> DataFrame:
    """The first row of each component, with all columns of docs."""
    scratch, key = Scratch(docs.sparkSession), unused("__row", docs.columns)
    rows = scratch.table("rows", docs.withColumn(key, F.monotonically_increasing_id()))
    texts = rows.select(F.col(f"`{key}`").alias("__row"), "doc_id", "text")
    _, nodes = linked(scratch, texts, words, percent, hot, more=close_fingerprints(scratch, texts, words))
    firsts = nodes.groupBy("component").agg(F.min(F.struct("id", "row")).alias("first")).select(F.col("first.row").alias(key))
    return rows.join(firsts, key, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])

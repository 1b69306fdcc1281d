"""MinHash near duplicates with tensored banding: a row per document with its component over links of similarity 0.8 or more.

Keys, candidates and the check on full sets are in set_links. Texts of equal sets are one node, so copies are never expanded into pairs.
A document without a word has an empty set and is its own component. Rows with a null doc_id take part and stand as later than any id;
a component of such rows only has a null component_id, and all its rows are kept, since none of them is an earlier document. Repeated
rows are copies with one id, so each of them is kept where the id is its component's. An empty table gives none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstide.llm.common import LAST_ID, Scratch
from crosstide.llm.set_links import HOT, PERCENT, linked

WORDS = 4


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, hot: int = HOT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.table("rows", docs.select("doc_id", "text", F.monotonically_increasing_id().alias("__row")))
    marks, nodes = linked(scratch, rows, words, percent, hot)
    least = nodes.groupBy("component").agg(F.min("id").alias("first"))
    named = nodes.join(least, "component").select("node", "first")
    missing = F.lit(int(LAST_ID))
    own = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("first"))
    found = marks.join(named, "node").select(F.nullif("id", missing).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(own, missing).alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


ORACLE = r"""WITH RECURSIVE cut AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
  sets AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS s FROM cut),
  nodes AS (SELECT s, len(s) AS n, min(doc_id) AS node FROM sets WHERE len(s) > 0 GROUP BY s),
  words AS (SELECT node, n, unnest(s) AS shingle FROM nodes),
  pairs AS (SELECT a.node AS a, b.node AS b FROM words a JOIN words b ON a.shingle = b.shingle AND a.node <> b.node
    GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
  reached AS (SELECT node AS a, node AS b FROM nodes UNION SELECT r.a, p.b FROM reached r JOIN pairs p ON p.a = r.b),
  named AS (SELECT n.s, min(r.b) AS component_id FROM nodes n JOIN reached r ON r.a = n.node GROUP BY n.s, n.node)
  SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept
  FROM sets LEFT JOIN named ON sets.s = named.s"""

"""Mixing to target weights by iterative proportional fitting.

Token counts are summed over cells (source, language, topic). Cell weights are raked in turn to the target share of each margin
for `rounds` turns (the margin raked last holds exactly, the others ever closer), by sums over the cell table alone; every fourth turn is a
stored table. A document's ratio is its cell's raked
weight over the cell's tokens; it is sampled with probability min(1, fraction * ratio) by a hash of its id, and carries the weight
fraction * ratio / probability, so weighted tokens meet the targets in expectation.

Tokens are blank-separated words. Without a topic column the length band of the text stands in for a topic. Missing targets: the
observed share to the power `flatten`, normalised over the margin. Targets are normalised over the values that have tokens; a value they do not name gets none.
Null texts have no tokens and ratio 0, hence are never sampled when their whole cell is empty; a document without tokens in a
cell with tokens has the cell's ratio. A null source, language or topic is a value of its own ('' after a null mark). A null id hashes
like the text 'null'. Repeated rows share their fate. An empty table gives none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crosstide.llm.common import Scratch

MARGINS = ("source", "lang", "topic")
FRACTION, FLATTEN, ROUNDS = 0.5, 0.7, 12
BANDS = ((64, "short"), (512, "medium"), (2048, "long"))


def with_margins(docs: DataFrame, topic: str | None = None) -> DataFrame:
    """n_tokens and the three margins of every row, beside all its columns (names with two underscores are this module's)."""
    text = F.trim(F.translate(F.coalesce(F.col("text"), F.lit("")), "\t\n\x0b\x0c\r", " " * 5))
    words = F.array_size(F.filter(F.split(text, " "), lambda w: w != ""))
    docs = docs.withColumn("__tokens", words.cast("long"))
    band = F.lit("huge")
    for limit, name in reversed(BANDS):
        band = F.when(F.col("__tokens") < limit, name).otherwise(band)
    value = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    return docs.withColumns({"__source": value(F.col("source")), "__lang": value(F.col("lang")), "__topic": value(F.col(topic)) if topic else value(band)})


def raked(scratch: Scratch, cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, flatten: float = FLATTEN, rounds: int = ROUNDS) -> DataFrame:
    """Cells with the raked weight w (shares of all tokens). Each margin's goal is a share; raking multiplies by goal / sum."""
    for m in MARGINS:
        share = cells.groupBy(f"__{m}").agg(F.sum("__tokens").cast("double").alias("t")).filter("t > 0")
        given = (targets or {}).get(m)
        if given:
            goal = F.coalesce(*[F.when(F.col(f"__{m}") == f"={k}", F.lit(float(v))) for k, v in given.items()], F.lit(0.0))
        else:
            goal = F.pow("t", F.lit(flatten))
        share = share.select(f"__{m}", goal.alias("g"))
        sums = share.agg(F.sum("g").alias("all"))
        share = share.crossJoin(F.broadcast(sums)).select(f"__{m}", F.coalesce(F.try_divide("g", "all"), F.lit(0.0)).alias(f"goal_{m}"))  # one row
        cells = cells.join(share, f"__{m}", "left")
    cells = scratch.table("goals", cells.filter("__tokens > 0").withColumn("w", F.col("__tokens").cast("double")))
    for turn in range(rounds):
        for m in MARGINS:
            cells = cells.withColumn("w", F.coalesce(F.try_divide(F.col("w") * F.col(f"goal_{m}"), F.sum("w").over(Window.partitionBy(f"__{m}"))), F.lit(0.0)))
        if turn % 4 == 3 or turn + 1 == rounds:
            cells = scratch.table(f"raked{turn}", cells)
    return cells


def mixed(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, fraction: float = FRACTION, flatten: float = FLATTEN, rounds: int = ROUNDS, topic: str | None = None) -> DataFrame:
    """Every column of docs, and __tokens, __topic, __ratio, __probability, __weight, __sampled."""
    scratch = Scratch(docs.sparkSession)
    rows = with_margins(docs, topic)
    keys = [f"__{m}" for m in MARGINS]
    cells = scratch.table("cells", rows.groupBy(*keys).agg(F.sum("__tokens").alias("__tokens")))
    all_tokens = cells.agg(F.sum("__tokens")).first()[0] or 0
    fitted = raked(scratch, cells, targets, flatten, rounds).select(*keys, F.round(F.col("w") * all_tokens / F.col("__tokens"), 6).alias("__ratio"))
    rows = rows.join(fitted, keys, "left").withColumn("__ratio", F.coalesce("__ratio", F.lit(0.0)))
    chance = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    rows = rows.withColumn("__probability", F.round(F.least(F.lit(1.0), fraction * F.col("__ratio")), 8))
    return rows.withColumns({"__weight": F.when(F.col("__probability") > 0, F.round(fraction * F.col("__ratio") / F.col("__probability"), 6)).otherwise(0.0), "__sampled": chance < F.col("__probability")})


def oracle(fraction: float = FRACTION, flatten: float = FLATTEN, rounds: int = ROUNDS) -> str:
    parts = [f"""d AS (SELECT doc_id, coalesce('=' || source, '') AS "__source", coalesce('=' || lang, '') AS "__lang",
        CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
    r AS (SELECT *, CASE {' '.join(f"WHEN n_tokens < {n} THEN '={b}'" for n, b in BANDS)} ELSE '=huge' END AS "__topic" FROM d),
    c AS (SELECT "__source", "__lang", "__topic", CAST(sum(n_tokens) AS DOUBLE) AS t FROM r GROUP BY ALL HAVING sum(n_tokens) > 0)"""]
    for m in MARGINS:
        parts.append(f'p_{m} AS (SELECT "__{m}", pow(sum(t), {flatten}) AS g FROM c GROUP BY 1), g_{m} AS (SELECT "__{m}", g / (SELECT sum(g) FROM p_{m}) AS goal_{m} FROM p_{m})')
    parts.append("k_0 AS MATERIALIZED (SELECT *, t AS w FROM c " + " ".join(f'JOIN g_{m} USING ("__{m}")' for m in MARGINS) + ")")
    n = 0
    for _ in range(rounds):
        for m in MARGINS:
            parts.append(f'k_{n + 1} AS MATERIALIZED (SELECT * REPLACE (w * goal_{m} / sum(w) OVER (PARTITION BY "__{m}") AS w) FROM k_{n})')
            n += 1
    parts.append(f"""f AS (SELECT "__source", "__lang", "__topic", round(w * (SELECT sum(t) FROM c) / t, 6) AS ratio FROM k_{n}),
    x AS (SELECT r.*, coalesce(ratio, 0.0) AS token_ratio FROM r LEFT JOIN f USING ("__source", "__lang", "__topic")),
    y AS (SELECT *, round(least(1.0, {fraction} * token_ratio), 8) AS probability, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8)) AS BIGINT) / 4294967296.0 AS u FROM x)""")
    return "WITH " + ",\n".join(parts) + f"""
    SELECT doc_id, n_tokens, substr("__topic", 2) AS topic, token_ratio, probability,
           CASE WHEN probability > 0 THEN round({fraction} * token_ratio / probability, 6) ELSE 0.0 END AS weight, u < probability AS sampled FROM y"""

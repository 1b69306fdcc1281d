"""Quality rules with host verdicts, in DataFrame functions only.

Document rules count inside the row, with array functions. Failures are then summed by host (here: `source`), the failure rates
are shrunk with a beta prior fitted to all hosts by moments, and documents of a host whose shrunk rate is above `limit` are not
kept. Features are narrow and stored once, so texts are read once; one row per host is joined back.

Null texts have no word and fail. A null host is a host of its own. Repeated rows count each; a null id stays null. An empty table
gives none. Columns other than doc_id, text and the host column are not read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstide.llm.common import Scratch

LIMIT = 0.6
SPACES = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"


def features(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the base counts of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), text.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split(F.translate("text", SPACES, " " * 6), " "), ""))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda line: F.length(F.translate(line, SPACES, "")) > 0))
    rows = rows.select(
        "doc_id", "host", F.size("words").cast("long").alias("n_words"), F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") < 3, F.array().cast("array<bigint>")).otherwise(
            F.expr("transform(sequence(0, greatest(size(words) - 3, 0)), i -> xxhash64(words[i], words[i + 1], words[i + 2]))")).alias("windows"))
    # windows in order of (hash, place); equal neighbours stand in windows found twice or more
    rows = rows.withColumn("sorted", F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.array().cast("array<struct<h: bigint, i: int>>")).otherwise(
        F.expr("sort_array(transform(windows, (h, i) -> named_struct('h', h, 'i', i)))")))
    rows = rows.withColumn("places", F.expr("""sort_array(transform(filter(transform(sorted, (w, k) -> named_struct('i', w.i, 'twice',
        (k > 0 AND sorted[greatest(k - 1, 0)].h = w.h) OR (k + 1 < size(sorted) AND sorted[least(k + 1, size(sorted) - 1)].h = w.h))), w -> w.twice), w -> w.i))"""))
    repeat = F.expr("aggregate(places, named_struct('n', 0L, 'end', 0), (s, i) -> named_struct('n', s.n + CAST(i + 3 - greatest(i, s.end) AS BIGINT), 'end', i + 3), s -> s.n)")
    return rows.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeat.alias("n_repeat_words"))


def hosts(rows: DataFrame) -> DataFrame:
    """host, documents, failures and the shrunk failure rate. The prior's mean is the overall rate and its size comes from the
    spread of the hosts' rates beyond binomial noise, held between 1 and 1000 documents."""
    each = rows.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("f"))
    prior = each.agg(F.sum("f").alias("sf"), F.sum("n").alias("sn"), F.count("*").alias("k"),
                     F.sum(F.col("f") * F.col("f") / F.col("n")).alias("sff"), F.sum(F.col("n") * F.col("n")).cast("double").alias("snn"))
    prior = prior.select((F.col("sf") / F.col("sn")).alias("m"), "sn", "k", "sff", "snn")
    # weighted moments: between-host variance v of the rates from the weighted sum of squares
    square = F.col("sff") - F.col("sn") * F.col("m") * F.col("m")
    noise = F.col("m") * (1 - F.col("m"))
    spread = (square - (F.col("k") - 1) * noise) / F.when(F.col("sn") - F.col("snn") / F.col("sn") > 0, F.col("sn") - F.col("snn") / F.col("sn"))
    size = F.when(spread > 0, F.least(F.lit(1000.0), F.greatest(F.lit(1.0), noise / spread - 1))).otherwise(1000.0)
    prior = prior.select("m", size.alias("size"))
    return each.crossJoin(F.broadcast(prior)).select("host", "n", "f", ((F.col("f") + F.col("m") * F.col("size")) / (F.col("n") + F.col("size"))).alias("rate"))  # one row


def host_rules(docs: DataFrame, host: str = "source", limit: float = LIMIT) -> DataFrame:
    """Base counts, base_failed, host_rate and kept of every row."""
    scratch = Scratch(docs.sparkSession)
    rows = features(docs, host).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    rows = scratch.table("features", rows)
    verdict = hosts(rows).select(F.col("host").alias("of"), F.round("rate", 6).alias("host_rate"))
    joined = rows.join(verdict, F.col("host").eqNullSafe(F.col("of")), "left")
    return joined.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", (~F.col("base_failed") & (F.col("host_rate") <= limit)).alias("kept"))


ORACLE = f"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, row_number() OVER () AS rid, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win
      FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
t AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM g) WHERE c > 1),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM t, (SELECT unnest(range(3)) AS k) GROUP BY rid),
f AS (SELECT doc_id, host, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM f),
h AS (SELECT host, count(*) AS n, CAST(sum(CAST(base_failed AS INT)) AS DOUBLE) AS fl FROM b GROUP BY host),
p AS (SELECT sum(fl) / sum(n) AS m, CAST(sum(n) AS DOUBLE) AS sn, count(*) AS k, sum(fl * fl / n) AS sff, CAST(sum(n * n) AS DOUBLE) AS snn FROM h),
q AS (SELECT m, m * (1 - m) AS noise, (sff - sn * m * m - (k - 1) * m * (1 - m)) / (CASE WHEN sn - snn / sn > 0 THEN sn - snn / sn END) AS v FROM p),
s AS (SELECT m, CASE WHEN v > 0 THEN least(1000.0, greatest(1.0, noise / v - 1)) ELSE 1000.0 END AS size FROM q),
x AS (SELECT host, round((fl + m * size) / (n + size), 6) AS host_rate FROM h, s)
SELECT doc_id, b.host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rate,
       (NOT base_failed AND host_rate <= {LIMIT}) AS kept
FROM b JOIN x ON b.host IS NOT DISTINCT FROM x.host
"""

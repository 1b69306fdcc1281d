"""The thin registered queries op1 to op13: each applies its operator to its whole table and returns the contract's columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosstide.llm import filter_audit, host_rules, licenses, lpf_dedup, mixing, packing, ppm, simhash, tensor_minhash, token_alignment, token_counts, topk, toxicity
from crosstide.llm.common import table


def op1_license_scan(spark, folder):
    return licenses.license_scan(table(spark, folder, "documents")).drop("spans")


def op2_lexical_packing(spark, folder):
    return packing.pack(table(spark, folder, "documents"))


def op3_suffix_dedup(spark, folder):
    return lpf_dedup.removed(table(spark, folder, "documents"))


def op4_toxicity(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, folder, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return toxicity.scored(docs, model).select("doc_id", held_out.alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op5_host_rules(spark, folder):
    return host_rules.host_rules(table(spark, folder, "documents"))


def op6_ppm_score(spark, folder):
    return ppm.score_documents(table(spark, folder, "documents"))


def op7_simhash(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op8_token_counts(spark, folder):
    return token_counts.token_counts(table(spark, folder, "documents")).withColumn("over_limit", F.col("n_tokens") > 512)


def op9_exact_topk(spark, folder):
    return topk.top_k(table(spark, folder, "embeddings"))


def op10_mixing(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mixed(docs).select(
        "doc_id", F.col("__tokens").alias("n_tokens"), F.expr("substr(__topic, 2)").alias("topic"), F.col("__ratio").alias("token_ratio"),
        F.col("__probability").alias("probability"), F.col("__weight").alias("weight"), F.col("__sampled").alias("sampled"))


def op11_token_alignment(spark, folder):
    return token_alignment.align(table(spark, folder, "documents"))


def op12_tensor_minhash(spark, folder):
    return tensor_minhash.near_duplicates(table(spark, folder, "documents"))


def op13_filter_audit(spark, folder):
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_lexical_packing, op3_suffix_dedup, op4_toxicity, op5_host_rules, op6_ppm_score, op7_simhash, op8_token_counts, op9_exact_topk, op10_mixing, op11_token_alignment, op12_tensor_minhash, op13_filter_audit)}
ORACLES = {"op5_host_rules": host_rules.ORACLE, "op9_exact_topk": topk.ORACLE, "op10_mixing": mixing.oracle(), "op12_tensor_minhash": tensor_minhash.ORACLE, "op13_filter_audit": filter_audit.ORACLE}

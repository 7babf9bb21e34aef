"""Thin queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelflow.llm import (bit_planes, decontamination, fuzzy_lines, line_labels, lm_scoring, minhash_dedup, packing,
                          periodic_runs, ranked_search, secrets_ledger, token_counts, vector_topk, warc)
from reelflow.llm.oracle import ORACLE
from reelflow.llm.shared import read
from reelflow.llm.tokenizing import vocabulary


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm_scoring.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scores.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")])


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    _, findings = secrets_ledger.scan(docs)
    return secrets_ledger.report(secrets_ledger.findings_of_paths(docs, findings))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = warc.write_bundles(read(spark, sf_dir, "pages"))
    return warc.read_bundles(folder, index).drop("record_id")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_line_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return line_labels.quality(docs, line_labels.train(docs, read(spark, sf_dir, "labels")))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op9_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = bit_planes.write_planes(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return bit_planes.read_planes(folder, manifest)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.label_lines(read(spark, sf_dir, "documents")).drop("of")


def repeated_tails(docs: DataFrame) -> DataFrame:
    """The documents of which a tenth, by the hash of the id, repeat a stretch of their words to the end."""
    h, words = F.crc32(F.col("doc_id").cast("string").cast("binary")), F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    some = (docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).alias("g"))
            .withColumn("a", F.when(F.size("w") > 0, F.col("g") % F.size("w")))
            .withColumn("p", F.expr("1 + (size(w) - a) div (3 + g % 8)")))
    tail = F.expr("array_join(transform(w, (x, i) -> if(i >= a, element_at(w, cast(a + (i - a) % p AS int) + 1), x)), ' ')")
    return some.select("doc_id", F.when(F.col("a").isNotNull(), tail).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(repeated_tails(read(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    greatest = F.expr("aggregate(runs, runs[0], (x, r) -> if(r.length * x.period > x.length * r.period, r, x))")   # runs are ordered
    return (found.withColumn("best", F.when(F.size("runs") > 0, greatest))
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                    F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                    F.sha2(F.array_join(F.transform(lines, lambda t: F.concat(t, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
                    F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_lm_scoring, op2_secret_scan, op3_token_counts, op4_warc_bundles, op5_best_fit_packing,
                            op6_decontamination, op7_line_labels, op8_minhash_dedup, op9_bit_planes, op10_line_dedup,
                            op11_periodic_runs, op12_ranked_search, op13_vector_topk)}

__all__ = ["QUERIES", "ORACLE"]

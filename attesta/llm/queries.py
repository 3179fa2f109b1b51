"""The registered query of each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontaminate, html, knn, langid, lmscore, mixing, periodic, pii, simhash, tokencounts, tokens, warc
from .common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", "taken")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    got = langid.predict(docs.select("text", "doc_id", langid.held_out(F.col("doc_id")).alias("held_out")), model, carry=["doc_id", "held_out"])
    return got.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(spark, sf_dir, "embeddings"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.archive(table(spark, sf_dir, "pages"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_index(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    counts = [pii.count(F.col("spans"), k).alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"), F.transform("spans", lambda s: s["score"]).alias("scores"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = conversations.Repair(conversations.damage(rows)).report()
    every = rows.select(F.col("conv_id").alias("_conv")).distinct()
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    held = every.join(found, F.col("_conv").eqNullSafe(F.col("conv_id")), "left")
    return held.select(F.col("_conv").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session may name a lasting cache folder (``attesta.tokenCache``); without it every run counts anew."""
    return tokencounts.count(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), spark.conf.get("attesta.tokenCache", None))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find(periodic.repeated_tails(table(spark, sf_dir, "documents")))
    key = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("a"), (-r["period"]).alias("b")))
    rows = found.withColumn("_best", F.array_max(key))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    best = [(-F.col("_best.a")).alias("start"), F.col("_best.length").alias("length"), (-F.col("_best.b")).alias("period"), F.floor(1000 * F.col("_best.length") / -F.col("_best.b")).alias("exponent_milli")]
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return found | {"pipeline": corpus_pipeline.run}

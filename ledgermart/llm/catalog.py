"""The thin queries over the test tables, and their SQL where it exists."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermart.llm import bpe
from ledgermart.llm import chat_format as chat
from ledgermart.llm import decontaminate
from ledgermart.llm import license_scan as licenses
from ledgermart.llm import line_quality as lines
from ledgermart.llm import ngram_join as ngrams
from ledgermart.llm import pii, simhash_pivots, substring_dedup, term_pipeline, url_rules, whitening
from ledgermart.llm import quality_classifier as quality
from ledgermart.llm.common import table
from ledgermart.llm.sql import ORACLE_SQL  # noqa: F401

#: The public vocabulary file; a parameter of the operator.
VOCABULARY = "word_bpe_49k.json"
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                      F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.license_scan(table(spark, sf_dir, "documents"))
    return out.withColumn("base_labels", F.array_join("base_labels", ",")).withColumn("labels", F.array_join("labels", ","))


def held_out(doc_id):
    return F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 5 == 0


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), learn=~held_out(F.col("id")))
    scored = quality.score(docs, model, name="score")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.ngram_join(table(spark, sf_dir, "documents"), shingle=4, percent=85)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = pii.pii_spans(docs, pii.fit(docs))

    def said(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(
            ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def of(kind):
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["base"])
    counts = [of(kind) for kind in pii.BASE_KINDS]
    return out.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).alias("turn"), F.lit(role).alias("role"),
                 F.lit(CONTROL_TEXT).alias("text")) for i, role in enumerate(("user", "assistant"))])))
    out = chat.chat_format(chat.records_of(rows.unionByName(extra)))
    back = out.select("conv_id", "layout", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
                      chat.read_loss(F.col("formatted"), F.col("mask")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


def vocabulary_path() -> str:
    return public_tokenizers.path(VOCABULARY)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op9_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_removed_lines", "n_removed_words")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.passage_report(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_passages", "repeated_words", "removed_words", F.array_join(F.transform(
        "passages", lambda p: F.concat_ws(":", p["start"].cast("string"), p["end"].cast("string"))), ",").alias("passages"), "owners")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whitened_components(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_pivots.simhash_components(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_pipeline.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_url_rules": op2_url_rules,
    "op3_license_scan": op3_license_scan,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_ngram_join": op5_ngram_join,
    "op6_pii": op6_pii,
    "op7_chat_format": op7_chat_format,
    "op8_bpe": op8_bpe,
    "op9_line_quality": op9_line_quality,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_simhash_dedup": op12_simhash_dedup,
    "op13_ranked_search": op13_ranked_search,
}

"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on every row that its
predecessor kept; all but the last return the columns of ``documents`` (and
any further columns the input has).  Stages are written as Parquet and read
again between one another.

Defined cases, for every stage: an empty table stays empty; null texts are
empty texts (and stay null where text is returned); null ids are kept, and
in ``near_duplicates`` a row with or without an id goes only for its own
text; unlike texts of one id stay, of rows with one id and no words one
stays; columns with unlike names pass through untouched.

SQL cannot express the compression classifier, the PII model or the BPE
tables, so there is no oracle; the pipeline is tested against a brute-force
version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermart.llm import bpe, decontaminate, pii
from ledgermart.llm import ngram_join as ngrams
from ledgermart.llm import quality_classifier as quality
from ledgermart.llm.catalog import held_out, vocabulary_path
from ledgermart.llm.common import table, text_of
from ledgermart.session import materialize

ORACLE_SQL = None

_SCORE = "__quality_score"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose compression score is below the threshold."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), learn=~held_out(F.col("id")))
    scored = quality.score(docs, model, name=_SCORE)
    return scored.filter(F.col(_SCORE) >= quality.THRESHOLD).drop(_SCORE)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of every group of texts linked by word 5-grams with a
    Jaccard similarity of 0.8 or more: that of the least id (a null id comes
    last), then of the least text hash and row hash.  Rows without words are
    linked to none; one of every id stays, and all without an id."""
    doc, text_key = F.coalesce(F.col("doc_id").cast("long"), F.lit(ngrams.NO_ID)), F.xxhash64(text_of())
    joined = materialize(ngrams.labelled_rows(docs), "components")
    texts = joined.groupBy("label", "doc", "text_key").agg(F.count(F.lit(1)).alias("rows")).withColumn("no_id", F.col("doc") == ngrams.NO_ID)
    texts = materialize(texts.filter("label IS NOT NULL OR NOT no_id"), "texts")

    def least(part, key):
        first = part.groupBy(F.col(key).alias("of")).agg(F.min(F.struct("no_id", "doc", "text_key")).alias("first"))
        both = part.join(first, part[key] == first["of"])
        return both.select("doc", "text_key", "rows", (F.struct("no_id", "doc", "text_key") == F.col("first")).alias("stays"))
    ruled = materialize(least(texts.filter("label IS NOT NULL"), "label").unionByName(
        least(texts.filter("label IS NULL"), "doc")), "ruled")

    def keys(which):
        return ruled.filter(which).select(F.col("doc").alias("__doc"), F.col("text_key").alias("__key"))
    keyed = docs.withColumns({"__doc": doc, "__key": text_key})
    kept = keyed.join(keys("NOT stays"), ["__doc", "__key"], "left_anti")
    twice = keys("stays AND rows > 1")
    once = kept.join(twice, ["__doc", "__key"], "left_anti").drop("__doc", "__key")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    again = kept.join(twice, ["__doc", "__key"], "left_semi").groupBy("__doc", "__key").agg(F.min_by(row, F.xxhash64(row)).alias("__row"))
    return once.unionByName(again.select("__row.*"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    _, spans, _ = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    hit = spans.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["__id"]) & (F.xxhash64(text_of()) == hit["__key"]), "left_anti")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; ``n_chars`` follows the text."""
    out = pii.mask(docs, pii.fit(docs))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return out


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of every document."""
    out = bpe.bpe(docs, vocabulary_path())
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids",
                      F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("bpe", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs

"""Quality rules with cross-document line frequency (operator 9).

Every line is normalised (white space collapsed, lower case) and hashed.
A line that stands in more than ``max_line_docs`` distinct documents of its
host is boilerplate of that host, however large the host; on a host too
small for that limit (``max_line_docs / max_line_share`` documents or fewer)
so is a line in more than ``max_line_share`` of its documents and in
``LEAST_DOCS`` at least.  Boilerplate lines are removed; a document that loses more than
``max_removed`` of its words is rejected as depleted.  Documents with the
same text count once for a host, so a group of copies does not make its own
lines boilerplate.

Plan: one scan computes the row metrics and the hashed lines, written once
to the shared checkpoint folder; counts are made by pre-aggregated distinct
(host, line, text) triples, so that a host, line or text with a third of
all rows is spread over every task; the few boilerplate lines are joined
back (a splittable join) and only sums per row return.

Defined cases: null or blank text has no words and fails the base rule;
null host is a host of its own; null ids are kept; repeated rows each get
a row; an empty table gives an empty result; other columns are ignored, so
their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermart.llm.common import SPACES, col, space_words, text_of
from ledgermart.session import materialize

MIN_WORDS = 50
MAX_REPEAT_PCT = 50
MAX_LINE_DOCS = 20
MAX_LINE_SHARE = 0.1
LEAST_DOCS = 3
MAX_REMOVED = 0.8


def normal_line(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, SPACES, " ")))


def row_metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Counts of each row, and its lines with a word as (hash, words)."""
    d = docs.select(col(id_col).alias("doc_id"), col(host_col).cast("string").alias("host"),
                    text_of(text_col).alias("body"))
    d = d.select("doc_id", "host", F.xxhash64("body").alias("text_key"), "body",
                 space_words(F.col("body")).alias("words"),
                 F.filter(F.split("body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    n = F.size("words")
    d = d.select("*", n.cast("long").alias("n_words"),
                 F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(
                     F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))).alias("windows"))
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    d = d.select("*", F.when(repeated, F.sort_array(
        F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("s"))
    m = F.size("s") - 1
    spans = F.zip_with(F.slice("s", 1, m), F.slice("s", 2, m), lambda a, b: F.when(
        a["h"] == b["h"], F.array(a["i"], a["i"] + 1, a["i"] + 2, b["i"], b["i"] + 1, b["i"] + 2)).otherwise(
        F.array().cast("array<int>")))
    return d.select(
        "doc_id", "host", "text_key", "n_words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("s").isNull(), 0).otherwise(F.size(F.array_distinct(F.flatten(spans)))).cast("long")
        .alias("n_repeat_words"),
        F.transform("lines", lambda x: F.struct(F.xxhash64(normal_line(x)).alias("h"),
                                                F.size(space_words(x)).alias("n"))).alias("lines"))


def boilerplate(rows: DataFrame, max_line_docs: int = MAX_LINE_DOCS,
                max_line_share: float = MAX_LINE_SHARE) -> DataFrame:
    """(host, h) of the lines above the limit of their host."""
    seen = rows.select("host", "text_key", F.explode(F.array_distinct("lines.h")).alias("h")).distinct()
    often = seen.groupBy("host", "h").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") >= min(LEAST_DOCS, max_line_docs + 1))
    hosts = (rows.select(F.col("host").alias("of_host"), "text_key").distinct()
             .groupBy("of_host").agg(F.count(F.lit(1)).alias("host_docs")))
    return (often.join(hosts, F.col("host").eqNullSafe(F.col("of_host")))
            .filter((F.col("docs") > max_line_docs) | (
                (max_line_share * F.col("host_docs") <= max_line_docs) & (F.col("docs") >= LEAST_DOCS)
                & (F.col("docs") > max_line_share * F.col("host_docs")))).select("host", "h"))


def line_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", *,
                 max_line_docs: int = MAX_LINE_DOCS, max_line_share: float = MAX_LINE_SHARE,
                 max_removed: float = MAX_REMOVED) -> DataFrame:
    """One row per document row: base counts, ``base_failed``, the removed
    lines and words, the hashes of the removed lines and ``kept``."""
    rows = row_metrics(docs, id_col, text_col, host_col).withColumn("uid", F.monotonically_increasing_id())
    rows = materialize(rows, "line-quality")
    bad = boilerplate(rows, max_line_docs, max_line_share).select(
        F.col("host").alias("bad_host"), F.col("h").alias("bad_h"))
    lines = rows.select("uid", "host", F.explode("lines").alias("line"))
    hit = lines.join(bad, (lines["line.h"] == bad["bad_h"]) & lines["host"].eqNullSafe(bad["bad_host"]))
    lost = hit.groupBy("uid").agg(F.count(F.lit(1)).alias("n_removed_lines"), F.sum("line.n").alias("n_removed_words"),
                                  F.collect_set("line.h").alias("removed_lines"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    out = rows.drop("lines", "text_key").join(lost, "uid", "left").withColumns({
        "base_failed": failed,
        "n_removed_lines": F.coalesce("n_removed_lines", F.lit(0)).cast("long"),
        "n_removed_words": F.coalesce("n_removed_words", F.lit(0)).cast("long"),
    })
    return out.withColumn("kept", ~F.col("base_failed") & (
        F.col("n_removed_words") <= max_removed * F.col("n_words"))).drop("uid")


def remove_lines(text: Column, removed_lines: Column) -> Column:
    """The text without the lines whose hashes are in ``removed_lines``."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.coalesce(
        F.array_contains(removed_lines, F.xxhash64(normal_line(x))), F.lit(False))), "\n")

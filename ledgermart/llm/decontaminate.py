"""Benchmark decontamination by winnowing (operator 1).

A window is ``window`` consecutive words of a benchmark item (a shorter
item is one window of its own length).  Of the k-grams in a window the one
with the least hash is its fingerprint, the last one on ties.  Equal
windows have equal fingerprints at equal places, so every shared span of at
least ``window`` words shares a fingerprint: nothing is missed.

1. fingerprints of all documents are joined with those of the items;
2. hits are extended in the documents that have one: every window whose
   fingerprint hit is written out and joined with the items' windows on the
   words themselves, so that nothing false is left;
3. neighbouring windows become spans.

The benchmark is joined, not assumed small: Spark broadcasts it only when
its size allows, and otherwise splits hot fingerprints in a shuffled join.
Only positions that hit leave step 1; a document's own positions are the
largest group anywhere, and equal windows and equal item sets are reduced
before they are joined.

Defined cases: null and blank texts have no words, no windows and no hits;
items without words are ignored; null ids are kept (an item's null id reads
as empty); repeated (doc_id, text) rows give one row, rows of one doc_id
with unlike texts one row each; an empty benchmark gives no hits, an empty
corpus no rows; other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgermart.llm import words as W
from ledgermart.llm.common import col, map_in_arrow, text_of
from ledgermart.session import materialize

WINDOW = 10
GRAM = 5


def _winnow(w: W.Words, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows of ``length`` words inside one text, the place
    of each one's fingerprint, and the gram hashes."""
    k = min(gram, length)
    g = W.grams(w.hash, k, seed=length)
    n = max(0, len(w.hash) - length + 1)
    best, place = g[:n].copy(), np.arange(n)
    for j in range(1, length - k + 1):
        other = g[j:j + n]
        better = other <= best
        best = np.where(better, other, best)
        place = np.where(better, np.arange(j, j + n), place)
    text = w.text_of_word()
    ok = np.flatnonzero(text[:n] == text[length - 1:length - 1 + n]) if n else np.zeros(0, int)
    return ok, place[ok], g


def _document_prints(lengths: list[int], gram: int):
    """Per document one row with its word count (``pos`` -1), then its fingerprints."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("text_key")
            for w in W.words(batch.column("body"), letters=True):
                base = w.rows.start
                count = len(w.first) - 1
                rows, pos = [np.arange(count)], [np.full(count, -1)]
                value, size = [W.mix(np.arange(count, dtype=np.uint64) + w.hash[:1].sum())], [np.diff(w.first)]
                text = w.text_of_word()
                for length in lengths:
                    _, place, g = _winnow(w, length, gram)
                    place = np.unique(place)
                    rows.append(text[place])
                    pos.append(place - w.first[text[place]])
                    value.append(g[place])
                    size.append(np.full(len(place), length))
                at = pa.array(np.concatenate(rows) + base)
                yield pa.RecordBatch.from_arrays([
                    ids.take(at), keys.take(at), pa.array(np.concatenate(pos).astype(np.int32)),
                    pa.array(np.concatenate(size).astype(np.int32)),
                    pa.array(np.concatenate(value).view(np.int64))], ["doc_id", "text_key", "pos", "size", "print"])
    return run


def _item_windows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item_id")
            for w in W.words(batch.column("body"), letters=True):
                out_id, size, value, said = [], [], [], []
                counts = np.diff(w.first)
                for length in sorted({min(window, int(c)) for c in counts if c}):
                    start, place, g = _winnow(w, length, gram)
                    text = w.text_of_word()[start]
                    mine = np.minimum(counts, window)[text] == length
                    for s, p, t in zip(start[mine], place[mine], text[mine]):
                        out_id.append(t + w.rows.start)
                        size.append(length)
                        value.append(g[p])
                        said.append(w.string(s, s + length))
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(out_id, pa.int64())), pa.array(size, pa.int32()),
                    pa.array(np.array(value, dtype=np.uint64).view(np.int64)), pa.array(said, pa.string())],
                    ["item_id", "size", "print", "said"])
    return run


def _extend(lengths: list[int], gram: int):
    """The windows whose fingerprint stands at one of the hit places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, hits = batch.column("doc_id"), batch.column("text_key"), batch.column("hits").to_pylist()
            for w in W.words(batch.column("body"), letters=True):
                row, begin, size, said = [], [], [], []
                text = w.text_of_word()
                for length in lengths:
                    start, place, _ = _winnow(w, length, gram)
                    hit = np.zeros(len(w.hash), dtype=bool)
                    for i in range(len(w.first) - 1):
                        own = [h["pos"] for h in hits[i + w.rows.start] if h["size"] == length]
                        hit[w.first[i] + np.array(own, dtype=np.int64)] = True
                    for s in start[hit[place]]:
                        row.append(text[s] + w.rows.start)
                        begin.append(s - w.first[text[s]])
                        size.append(length)
                        said.append(w.string(s, s + length))
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([ids.take(at), keys.take(at), pa.array(begin, pa.int32()),
                                                  pa.array(size, pa.int32()), pa.array(said, pa.string())],
                                                 ["doc_id", "text_key", "start", "size", "said"])
    return run


def _same(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text", *, window: int = WINDOW,
                       gram: int = GRAM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables keyed by (doc_id, text_key): ``counts`` with the words of
    each document, ``spans`` with the hit word ranges (end exclusive), and
    ``items`` with the sorted ids of the items that occur in it."""
    d = docs.select(col(id_col).alias("doc_id"), text_of(text_col).alias("body"))
    d = d.withColumn("text_key", F.xxhash64("body"))
    kind = d.schema["doc_id"].dataType.simpleString()
    b = items.select(F.coalesce(col(item_col).cast("string"), F.lit("")).alias("item_id"),
                     text_of(item_text_col).alias("body"))
    tests = materialize(map_in_arrow(b, _item_windows(window, gram), "item_id string, size int, print long, said string"),
                        "test-windows")
    lengths = sorted(r["size"] for r in tests.select("size").distinct().collect())  # at most ``window`` numbers

    prints = map_in_arrow(d, _document_prints(lengths, gram), f"doc_id {kind}, text_key long, pos int, size int, print long")
    wanted = tests.select(F.col("print").alias("t_print"), F.col("size").alias("t_size")).distinct()
    found = prints.join(wanted, (prints["print"] == wanted["t_print"]) & (prints["size"] == wanted["t_size"])
                        & (prints["pos"] >= 0), "left")
    found = materialize(found.filter((F.col("pos") < 0) | F.col("t_print").isNotNull())
                        .select("doc_id", "text_key", "pos", "size"), "prints")
    counts = found.filter("pos < 0").groupBy("doc_id", "text_key").agg(F.max("size").cast("long").alias("n_words"))

    hits = (found.filter("pos >= 0").groupBy("doc_id", "text_key")
            .agg(F.collect_set(F.struct("pos", "size")).alias("hits")))
    suspects = d.join(hits, _same(d, hits)).select(d["doc_id"], d["text_key"], "body", "hits")
    wide = map_in_arrow(suspects, _extend(lengths, gram), f"doc_id {kind}, text_key long, start int, size int, said string")
    windows = tests.groupBy("said").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    true = materialize(wide.distinct().join(windows, "said").select("doc_id", "text_key", "start", "size", "item_ids"), "hits")

    of_doc = Window.partitionBy("doc_id", "text_key").orderBy("start", "size")
    reach = F.max(F.col("start") + F.col("size")).over(of_doc.rowsBetween(Window.unboundedPreceding, -1))
    spans = (true.select("doc_id", "text_key", "start", "size")
             .withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1))
             .withColumn("span", F.sum("new").over(of_doc.rowsBetween(Window.unboundedPreceding, 0)))
             .groupBy("doc_id", "text_key", "span")
             .agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("end")).drop("span"))
    sets = true.select("doc_id", "text_key", "item_ids").distinct()
    per_doc = sets.groupBy("doc_id", "text_key").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    return counts, spans, per_doc


def contamination_report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row per document: words, hit words, hit spans and item ids."""
    counts, spans, per_doc = find_contamination(docs, items, **options)
    hit = spans.groupBy("doc_id", "text_key").agg(
        F.sum(F.col("end") - F.col("start")).cast("long").alias("n_hit"),
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    hit = hit.join(per_doc, _same(hit, per_doc)).select(hit["doc_id"], hit["text_key"], "n_hit", "spans", "item_ids")
    return counts.join(hit, _same(counts, hit), "left").select(
        counts["doc_id"], counts["text_key"], "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))

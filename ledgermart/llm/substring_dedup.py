"""Substring deduplication by content-defined chunking (operator 10).

A gear rolling hash runs over the bytes of a text; a word end where its top
``CUT_BITS`` bits are zero is a cut.  Cuts depend only on the last
``GEAR_BYTES`` bytes, so an insertion moves the cuts near it and no others.
From every cut a chunk runs to the first cut at least ``min_chunk`` words
on (chunks overlap, so two copies of a passage need not fall into step).
Chunks are compared by the digest of their words; the document with the
least id that has a chunk owns it.  Neighbouring repeated chunks form runs,
and a run of at least ``min_run`` words is a repeated passage.  A word of it
belongs to this document if one of the chunks over it does, or else to the
least owner of these; words of others are removed.  So an owner keeps all
of a chunk, and nothing vanishes from every document.

A document is an id and the hash of its text; of unlike texts of one id, or
without an id, the one of least hash comes first.

Plan: chunk digests are reduced to (least, greatest document) with map-side
combining, so a passage in a third of all documents is no hot spot; the
repeated digests are joined back with a join whose hot keys Spark can
split; only the distinct chunks of one document ever meet in one task.

Defined cases: null and blank texts have no chunks; a text of fewer than
``min_chunk`` words has none; a null id counts as less than all others;
rows with the same id (or none) and text are one document, unlike texts of
one id are documents of their own; white space and the case of A-Z do
not matter; an empty table gives an empty result; other columns are
ignored, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermart.llm import words as W
from ledgermart.llm.common import col, text_of
from ledgermart.session import materialize

GEAR_BYTES, CUT_BITS = 8, 2
MIN_CHUNK, MAX_CUTLESS, MIN_RUN = 8, 64, 24
#: Stands for a null id inside the operator.
NO_ID = -(2 ** 63)

_GEAR = W.constants(256, 77)
_STEP = W.constants(1, 78)[0]


def gear(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Gear hash at every byte over the last ``GEAR_BYTES`` bytes of its
    text: h = h * 2 + g[byte], unrolled by doubling the reach."""
    h = _GEAR[data]
    reach = 1
    while reach < GEAR_BYTES:
        before = np.zeros_like(h)
        before[reach:] = h[:-reach] << np.uint64(reach)
        before[place < reach] = 0
        h = h + before
        reach *= 2
    return h


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def chunks(w: W.Words, offsets: np.ndarray, min_chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words, digest) of every chunk of the texts."""
    place = np.arange(len(w.data)) - np.repeat(offsets[:-1], np.diff(offsets))
    ends = gear(np.where(np.isin(w.data, (9, 10, 11, 12, 13)), np.uint8(32), w.data), place)[w.end - 1] if len(w.end) else np.zeros(0, np.uint64)
    cut = np.flatnonzero((ends >> np.uint64(64 - CUT_BITS)) == 0) + 1
    cuts = np.unique(np.concatenate([cut, w.first]))
    gaps = np.diff(cuts)
    extra = [np.arange(cuts[i] + MAX_CUTLESS, cuts[i + 1], MAX_CUTLESS) for i in np.flatnonzero(gaps > MAX_CUTLESS)]
    if extra:
        cuts = np.unique(np.concatenate([cuts, *extra]))
    start = cuts[cuts < len(w.hash)]
    text = np.searchsorted(w.first, start, side="right") - 1
    at = np.searchsorted(cuts, start + min_chunk)
    ok = at < len(cuts)
    start, text = start[ok], text[ok]
    stop = cuts[at[ok]]
    ok = stop <= w.first[text + 1]
    start, stop, text = start[ok], stop[ok], text[ok]
    n = len(w.hash)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hash * _powers(n, int(_STEP)), dtype=np.uint64)])
    back = _powers(n + 1, pow(int(_STEP), -1, 2 ** 64))
    digest = W.mix((total[stop] - total[start]) * back[start] + (stop - start).astype(np.uint64))
    return text, start - w.first[text], stop - start, digest


def _chunk_rows(min_chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, _ = W.utf8(batch.column("body"))
            for w in W.words(batch.column("body"), letters=False):
                own = offsets[w.rows.start:w.rows.stop + 1]
                text, start, size, digest = chunks(w, own - own[0], min_chunk)
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c).take(pa.array(text + w.rows.start)) for c in ("doc", "text_key")), pa.array(start.astype(np.int32)),
                    pa.array(size.astype(np.int32)), pa.array(digest.view(np.int64))], ["doc", "text_key", "start", "size", "digest"])
    return run


def _owned_ranges(min_run: int):
    """Runs of each document's hits, cut where the owner of the words changes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            hits = batch.column("hits")
            many = np.diff(hits.offsets.to_numpy())
            start, end, owner, own = (x.to_numpy(zero_copy_only=False) for x in hits.flatten().flatten())
            row = np.repeat(np.arange(len(many)), many)
            docs = batch.column("doc").to_numpy()
            reach = np.maximum.reduceat(end, np.cumsum(many) - many).astype(np.int64) + 1  # documents do not touch
            base = np.cumsum(reach) - reach
            points = np.unique(np.concatenate([start + base[row], end + base[row]]))
            first, last = np.searchsorted(points, start + base[row]), np.searchsorted(points, end + base[row])
            over = last - first  # a chunk lies over few pieces between points
            piece = np.repeat(first - (np.cumsum(over) - over), over) + np.arange(over.sum())
            mine, least = np.zeros(len(points), bool), np.full(len(points), np.iinfo(np.int64).max)
            covered = np.zeros(len(points), bool)
            covered[piece] = True
            mine[piece[np.repeat(own, over)]] = True
            np.minimum.at(least, piece, np.repeat(owner, over))
            of = np.searchsorted(base, points, side="right") - 1
            least[mine] = docs[of[mine]]
            at = np.flatnonzero(covered)
            new_run = np.append(True, ~covered[at[1:] - 1])
            new = new_run | np.append(True, (mine[at[1:]] != mine[at[:-1]]) | (least[at[1:]] != least[at[:-1]]))

            def ends(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                return points[at[new]], points[at[np.append(new[1:], True)] + 1]
            (run_start, run_end), (a, b) = ends(new_run), ends(new)
            in_run = (np.cumsum(new_run) - 1)[new]
            long = (run_end - run_start >= min_run)[in_run]
            in_run, a, b, at = in_run[long], a[long], b[long], at[new][long]
            back = base[of[at]]
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c).take(pa.array(of[at])) for c in ("doc", "text_key")), *(pa.array((x - back).astype(np.int32)) for x in (run_start[in_run], run_end[in_run], a, b)),
                pa.array(mine[at]), pa.array(least[at])],
                ["doc", "text_key", "passage_start", "passage_end", "start", "end", "owned", "owner"])
    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, doc, body, text_key): ``doc`` and ``text_key`` are the document."""
    d = docs.select(col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("body"))
    return d.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "body", F.xxhash64("body").alias("text_key"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chunk: int = MIN_CHUNK,
                      min_run: int = MIN_RUN) -> DataFrame:
    """(doc_id, text_key, passage_start, passage_end, start, end, owned, owner): word
    ranges (end exclusive) of one owner, which together make up a passage
    that stands in other documents too; ``owned`` where it is kept here."""
    d = _keyed(docs, id_col, text_col).select("doc", "text_key", "body")
    rows = d.mapInArrow(_chunk_rows(min_chunk), "doc long, text_key long, start int, size int, digest long")
    key = F.struct("doc", "text_key")
    owners = (rows.groupBy("digest").agg(F.min(key).alias("owner"), F.max(key).alias("last"))
              .filter("owner < last").select("digest", F.col("owner.doc").alias("owner"), F.col("owner.text_key").alias("owner_key")))
    owners = materialize(owners, "chunk-owners")  # a stored side lets Spark split hot digests in the join
    hits = rows.join(owners, "digest").select(
        "doc", "text_key", "start", (F.col("start") + F.col("size")).alias("end"), "owner",
        ((F.col("doc") == F.col("owner")) & (F.col("text_key") == F.col("owner_key"))).alias("own"))
    of_doc = hits.groupBy("doc", "text_key").agg(F.collect_set(F.struct("start", "end", "owner", "own")).alias("hits"))
    ranges = of_doc.mapInArrow(_owned_ranges(min_run), "doc long, text_key long, passage_start int, passage_end int, start int, end int, "
                               "owned boolean, owner long")
    return ranges.withColumn("doc", F.when(F.col("doc") != NO_ID, F.col("doc"))).withColumnRenamed("doc", "doc_id").withColumn(
        "owner", F.when(F.col("owner") != NO_ID, F.col("owner")))


def passage_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document (id and text) with a repeated passage."""
    p = repeated_passages(docs, **options)
    n = F.col("end") - F.col("start")
    whole = F.collect_set(F.struct(F.col("passage_start").alias("start"), F.col("passage_end").alias("end")))
    return p.groupBy("doc_id", "text_key").agg(
        F.size(whole).cast("long").alias("n_passages"), F.sum(n).cast("long").alias("repeated_words"),
        F.sum(F.when(F.col("owned"), 0).otherwise(n)).cast("long").alias("removed_words"),
        F.sort_array(whole).alias("passages"),
        F.sort_array(F.collect_list(F.struct("start", "end", "owned"))).alias("ranges"),
        F.sort_array(F.collect_set("owner")).alias("owners"))


def drop_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) without the parts of passages that other documents own."""
    cuts = passages.filter(~F.col("owned")).groupBy(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("doc"), "text_key").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    d = _keyed(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, said = [], batch.column("body").to_pylist()
            cut = batch.column("cuts").to_pylist()
            for w in W.words(batch.column("body"), letters=False):
                offsets = np.cumsum([0, *(len(x.encode()) for x in said[w.rows])])
                for i in range(len(w.first) - 1):
                    raw, base, done, kept, last = said[w.rows.start + i].encode(), offsets[i], 0, [], -1
                    for c in cut[w.rows.start + i] or []:
                        if c["start"] != last:
                            kept.append(raw[done:w.start[w.first[i] + c["start"]] - base])
                        last, done = c["end"], w.end[w.first[i] + c["end"] - 1] - base
                    out.append(b"".join([*kept, raw[done:]]).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return d.join(cuts, ["doc", "text_key"], "left").select("doc_id", "body", "cuts").mapInArrow(run, "doc_id long, text string")

"""Ranked lexical search by pipelined term partitioning (operator 13).

Every term has an owner stage.  An item's bundle starts empty and travels
through the stages one after another; at each stage it meets the postings of
the terms that the stage owns (cogroup), and the stage adds its integer
contributions to the sparse document accumulators in the bundle.  After the
last stage every shard selects its best documents, and the best of all
shards are the result.

1. The items are the query set.  They are taken in blocks whose terms fit
   ``BLOCK_TERMS`` and whose items fit ``BLOCK_ITEMS``; there is one block
   unless the query set is very large.  Blocks are dealt by hash, so a very
   long item can exceed the first number by its own terms.
2. One pass over the documents counts each document's terms and writes the
   postings of the block's terms, apart for each owner stage: a row per
   document and stage, with term numbers and frequencies.
3. Document counts, lengths and document frequencies are sums over that
   table, over all documents; weights follow from them.
4. Documents are dealt to shards by a hash of their row, about
   ``SHARD_DOCS`` each, so a bundle (item, shard) holds at most that many
   accumulators however common a term is, and postings of a very common
   term are spread over all shards.
5. Stage by stage, bundles and postings of a shard are cogrouped.

Scores are sums of 64-bit integers, so the order of stages and tasks does
not matter.  Only the terms of a block (``BLOCK_TERMS`` at most, checked by
counting) go to the driver and with the tasks.  Each stage's output is
durable only as shuffle files; the postings are a table, and a lost executor
makes Spark repeat the stages from it.

Defined cases: null and empty texts have no terms and are not counted as
documents; items without a term, and items whose terms occur nowhere, give
no rows; items that are repeated or have a null id are ranked each for
itself; every row of the documents is a document of its own, also those of
one id, with null ids (which come last among equal scores) and repeated
ones; empty tables give an empty result; other columns are ignored, so
their names cannot clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgermart.llm import words as W
from ledgermart.llm.common import col, letter_words, text_of
from ledgermart.session import materialize

#: Owner stages, documents per shard, results per item.
STAGES, SHARD_DOCS, TOP = 4, 2048, 50
#: Terms and items that one block of the query set may have (a larger item is a block alone).
BLOCK_TERMS, BLOCK_ITEMS = 200_000, 500
#: Length normalisation in hundredths, frequency saturation in thousandths.
LENGTH_SHARE, SATURATION, UNIT = 50, 20, 1_000_000_000

_SPLIT = np.arange(256, dtype=np.uint8)
_SPLIT[[b for b in range(128) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)]] = 32
_SPLIT[65:91] += 32
_SPLIT = _SPLIT.tobytes()


def terms_of(text: bytes) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII bytes."""
    return text.translate(_SPLIT).split()


# --- the query set ----------------------------------------------------------

def query_items(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id, terms) of items with a term; ``item`` numbers the rows."""
    lowered = F.translate(text_of(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = items.select(col(id_col).alias("item_id"), F.array_distinct(letter_words(lowered)).alias("terms"))
    numbered = rows.filter(F.size("terms") > 0).select(F.monotonically_increasing_id().alias("item"), "item_id", "terms")
    return materialize(numbered, "items")


def blocks_of(items: DataFrame, block_terms: int = BLOCK_TERMS, block_items: int = BLOCK_ITEMS) -> list[DataFrame]:
    """The items in blocks, dealt by a hash of their number; two counts go
    to the driver.  With more than one block, blocks are half full on average."""
    size = items.agg(F.count(F.lit(1)).alias("items"), F.sum(F.size("terms")).alias("terms")).first()
    if not size["items"]:
        return []
    full = max(size["terms"] / block_terms, size["items"] / block_items)
    blocks = 1 if full <= 1 else -int(-2 * full // 1)
    return [items.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k) for k in range(blocks)]


# --- postings ---------------------------------------------------------------

def _postings(numbers: dict[bytes, int], stages: int):
    """Per document: its length, and a row per owner stage with the numbers
    and frequencies of the block's terms.  Stage -1 stands for the document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = W.utf8(batch.column("body"))
            for rows in W.pieces(at):
                row, stage, length, ends, terms, counts = [], [], [], [0], [], []
                for i in range(rows.start, rows.stop):
                    said = Counter(terms_of(data[at[i]:at[i + 1]].tobytes()))
                    if not said:
                        continue
                    n = sum(said.values())
                    of = [[] for _ in range(stages)]
                    for word in said.keys() & numbers.keys():
                        number = numbers[word]
                        of[number % stages].append((number, said[word]))
                    for s, found in [(-1, []), *enumerate(of)]:
                        if found or s < 0:
                            row.append(i)
                            stage.append(s)
                            length.append(n)
                            found.sort()
                            terms.extend(t for t, _ in found)
                            counts.extend(c for _, c in found)
                            ends.append(len(terms))
                ends = pa.array(ends, pa.int32())
                taken = batch.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([
                    taken.column("row"), taken.column("doc"), pa.array(stage, pa.int32()), pa.array(length, pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64()))],
                    ["row", "doc", "stage", "n", "terms", "tf"])
    return run


def postings(docs: DataFrame, numbers: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text", *,
             stages: int = STAGES) -> DataFrame:
    """(row, doc, stage, n, terms, tf), written once; a row per document and
    owner stage, and one with stage -1 per document that has terms."""
    d = docs.select(F.monotonically_increasing_id().alias("row"), col(id_col).cast("long").alias("doc"), text_of(text_col).alias("body"))
    out = d.mapInArrow(_postings(numbers, stages), "row long, doc long, stage int, n long, terms array<int>, tf array<long>")
    return materialize(out, "postings", partition_by=("stage",))


# --- stages -----------------------------------------------------------------

_BUNDLE = "shard long, item long, at binary, score binary"


def _stage(weights: dict[int, int], owned: dict[int, list[int]]):
    """Adds the contributions of a stage's terms to the bundles of a shard.
    A bundle has the rows it has met (``at``) and their scores, packed."""
    def run(bundles: pd.DataFrame, posted: pd.DataFrame) -> pd.DataFrame:
        if bundles.empty or posted.empty:
            return bundles
        many = posted["terms"].map(len).to_numpy()
        owner = np.repeat(posted["row"].to_numpy(), many)
        m = np.repeat(posted["m"].to_numpy(), many)
        term = np.concatenate(posted["terms"].to_numpy())
        tf = np.concatenate(posted["tf"].to_numpy()).astype(np.int64)
        order = np.argsort(term, kind="stable")
        owner, m, term, tf = owner[order], m[order], term[order], tf[order]
        kinds, first = np.unique(term, return_index=True)
        part = (UNIT * tf) // (1000 * tf + SATURATION * m) * np.repeat(
            np.array([weights[int(t)] for t in kinds], dtype=np.int64), np.diff(np.append(first, len(term))))
        ranges = {int(t): (a, b) for t, a, b in zip(kinds, first, np.append(first[1:], len(term)))}
        met_before = [np.frombuffer(x, dtype=np.int64) for x in bundles["at"]]
        every = np.unique(np.concatenate([owner, *met_before]))
        place = np.searchsorted(every, owner)
        out = []
        for (shard, item, at, score), rows in zip(bundles.itertuples(index=False), met_before):
            mine = [ranges[t] for t in owned.get(item, ()) if t in ranges]
            if mine:
                total = np.zeros(len(every), dtype=np.int64)
                total[np.searchsorted(every, rows)] = np.frombuffer(score, dtype=np.int64)
                for a, b in mine:
                    total[place[a:b]] += part[a:b]  # a term stands once in a document
                met = np.flatnonzero(total)
                at, score = every[met].tobytes(), total[met].tobytes()
            out.append((shard, item, at, score))
        return pd.DataFrame(out, columns=["shard", "item", "at", "score"])
    return run


def _best(top: int):
    """The accumulators of a bundle that can be among the best: those that
    reach the ``top``-th score of the shard (all of its ties)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, rows, scores = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for item, at, score in zip(batch.column("item").to_pylist(), batch.column("at"), batch.column("score")):
                s = np.frombuffer(score.as_buffer(), dtype=np.int64)
                least = 1 if len(s) <= top else max(1, int(np.partition(s, len(s) - top)[len(s) - top]))
                keep = np.flatnonzero(s >= least)
                items.extend([item] * len(keep))
                rows.append(np.frombuffer(at.as_buffer(), dtype=np.int64)[keep])
                scores.append(s[keep])
            yield pa.RecordBatch.from_arrays([
                pa.array(items, pa.int64()), pa.array(np.concatenate(rows)), pa.array(np.concatenate(scores))], ["item", "row", "score"])
    return run


def _search_block(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, stages: int, shard_docs: int, top: int) -> DataFrame:
    """(item, rank, doc, score) of the items of one block."""
    words = {r["item"]: r["terms"] for r in items.select("item", "terms").collect()}
    numbers = {t.encode(): k for k, t in enumerate(sorted({t for said in words.values() for t in said}))}
    index = postings(docs, numbers, id_col, text_col, stages=stages)
    one = index.filter("stage < 0").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    n_docs, length = one["docs"], max(1, one["length"])
    posted = index.filter("stage >= 0")
    df = posted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2 * n_docs + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))))
    weights = {r["term"]: r["w"] for r in df.select("term", weight.cast("long").alias("w")).collect()}
    shards = max(1, -(-n_docs // shard_docs))
    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard")
    m = (F.lit(100 - LENGTH_SHARE) + F.expr(f"({LENGTH_SHARE} * n * {n_docs}L) div {length}L")).alias("m")
    bundles = items.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), "item",
                           F.lit(b"").alias("at"), F.lit(b"").alias("score"))
    for stage in range(stages):
        owned = {item: [k for k in (numbers[t.encode()] for t in said) if k % stages == stage] for item, said in words.items()}
        mine = posted.filter(F.col("stage") == stage).select(shard, "row", m, "terms", "tf")
        bundles = bundles.groupBy("shard").cogroup(mine.groupBy("shard")).applyInPandas(_stage(weights, owned), _BUNDLE)
    best = bundles.select("item", "at", "score").mapInArrow(_best(top), "item long, row long, score long")
    # all rows that tie with the last one stay until their documents are known
    first = best.withColumn("place", F.rank().over(Window.partitionBy("item").orderBy(F.col("score").desc()))).filter(F.col("place") <= top)
    named = first.join(index.filter("stage < 0").select("row", "doc"), "row")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    return named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("item", "rank", "doc", "score")


def ranked_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", *, top: int = TOP, stages: int = STAGES, shard_docs: int = SHARD_DOCS,
                  block_terms: int = BLOCK_TERMS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of every item."""
    query = query_items(items, item_col, item_text_col)
    found = docs.sparkSession.createDataFrame([], "item long, rank int, doc long, score long")
    blocks = blocks_of(query, block_terms, block_items)
    for block in blocks:
        part = _search_block(docs, block, id_col, text_col, stages, shard_docs, top)
        found = found.unionByName(materialize(part, "ranked") if len(blocks) > 1 else part)
    return found.join(query.select("item", "item_id"), "item").select(
        "item_id", "rank", F.col("doc").alias("doc_id"), "score")

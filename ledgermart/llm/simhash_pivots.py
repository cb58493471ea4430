"""SimHash near-duplicates by pivot distance tables (operator 12).

A fingerprint has one bit per bit of the 64-bit shingle hashes, set where
over half of the hashes have it.  Two fingerprints link at ``RADIUS`` (2)
or fewer differing bits.

Pivots are the 65 staircase fingerprints P_0 ... P_64 (P_k has its first k
bits set).  The distance table of x holds d(x, P_k) for all k.  By the
triangle inequality |d(x, P_k) - d(y, P_k)| <= d(x, y), so a pair whose
table rows differ by more than the radius in any coordinate is discarded;
what is left is verified by its exact distance.

To meet only where it can matter, the table is cut into five blocks of
pivots.  The steps d(x, P_k+1) - d(x, P_k) of a block depend on its bits
alone, so two differing bits leave the steps of three blocks equal.  A cell
is a choice of three blocks and their steps; each fingerprint stands in ten
cells, and every linked pair shares one.  Where more than ``CROWD``
fingerprints share a cell (near copies of one origin), they only differ in
the blocks outside it; that range of pivots is cut into five blocks again,
and once more if need be.  After three cuts a cell holds 32 fingerprints at
the most, so no cell is ever large, none is cut short and no pair is lost.

Each cell becomes one row of at most ``CROWD`` fingerprints; their tables are
compared inside the task, and only links that join two parts of the cell are
returned (at most one a fingerprint): the components are those of all links.

Copies become one node before anything is joined (partial minima, so a
fingerprint that a third of all rows has is split over tasks).

Defined cases: null, empty and blank texts have the fingerprint zero and
link like any other; fewer than three words are one shingle; repeated rows
each get a row; null ids are kept but never name a component unless all its
ids are null; a bit set in exactly half of the hashes is 0; an empty table
gives an empty result; other columns are ignored, so their names cannot
clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermart.llm import words as W
from ledgermart.llm.common import col, text_of
from ledgermart.llm.ngram_join import components
from ledgermart.session import materialize

SHINGLE, SEED, RADIUS, BITS = 3, 42, 2, 64
#: Blocks of a cut, those of a cell, and the fingerprints that one cell may hold.
BLOCKS, KEPT, CROWD = RADIUS + 3, 3, 64
#: Hashes whose bits are counted at once.
COUNTED = 1 << 16


# --- fingerprints -----------------------------------------------------------

def shingle_hashes(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of every run of ``shingle`` words, or of all words if fewer."""
    words = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    k = min(shingle, len(words))
    return np.array([digest(joined[a:b], seed) for a, b in zip(start[:len(words) - k + 1].tolist(), end[k - 1:].tolist())], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The majority of every bit."""
    ones = np.zeros(BITS, dtype=np.int64)
    for a in range(0, len(hashes), COUNTED):
        part = hashes[a:a + COUNTED].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(b) for b in np.flatnonzero(2 * ones > len(hashes))))


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = W.utf8(batch.column("body"))
            marks = [fingerprint(shingle_hashes(data[a:b].tobytes(), shingle)) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(np.array(marks, dtype=np.uint64).view(np.int64))], ["doc", "mark"])
    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE) -> DataFrame:
    """(doc, mark) of every row; the mark is the fingerprint as a signed long."""
    d = docs.select(col(id_col).cast("long").alias("doc"), text_of(text_col).alias("body"))
    return d.mapInArrow(_fingerprints(shingle), "doc long, mark long")


# --- pivot tables -----------------------------------------------------------

PIVOTS = np.array([(1 << k) - 1 for k in range(BITS + 1)], dtype=np.uint64)


def distance_table(marks: np.ndarray) -> np.ndarray:
    """Hamming distances to all pivots, a row per fingerprint."""
    return np.bitwise_count(marks.astype(np.uint64)[:, None] ^ PIVOTS[None, :]).astype(np.int8)


@lru_cache(maxsize=None)
def cuts(path: tuple[int, ...]) -> tuple[tuple[tuple[int, ...], tuple[int, ...]], ...]:
    """The ten (steps in the cell, steps left outside) of a cut; ``path``
    holds the choices of the cuts before."""
    left = tuple(range(BITS))
    for choice in path:
        left = _cut(left)[choice][1]
    return _cut(left)


@lru_cache(maxsize=None)
def _cut(left: tuple[int, ...]):
    blocks = [tuple(b.tolist()) for b in np.array_split(np.array(left, dtype=int), BLOCKS)]
    out = []
    for kept in combinations(range(BLOCKS), KEPT):
        inside = sum((blocks[b] for b in kept), ())
        out.append((inside, tuple(k for k in left if k not in set(inside))))
    return tuple(out)


def _path_of(number: int) -> tuple[int, ...]:
    """The choices that a path number stands for (1 is the start)."""
    path, many = [], len(list(combinations(range(BLOCKS), KEPT)))
    while number > 1:
        number, choice = divmod(number, many)
        path.append(choice)
    return tuple(reversed(path))


_SALT = W.constants(BITS, 77)


def _cells():
    """Rows (cell, path, mark) to the rows of the next cut."""
    many = len(list(combinations(range(BLOCKS), KEPT)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, path, mark = (np.asarray(batch.column(c)) for c in ("cell", "path", "mark"))
            for a in range(0, len(mark), 20_000):
                own, way, m = cell[a:a + 20_000].view(np.uint64), path[a:a + 20_000], mark[a:a + 20_000].view(np.uint64)
                steps = np.diff(distance_table(m).astype(np.int64), axis=1).astype(np.uint64)  # +1 or -1 each
                out = []
                for number in np.unique(way):
                    mine = np.flatnonzero(way == number)
                    for choice, (inside, _) in enumerate(cuts(_path_of(int(number)))):
                        at = list(inside)
                        key = W.mix(own[mine] * np.uint64(31) + W.mix(steps[np.ix_(mine, at)] @ _SALT[at] + np.uint64(choice)))
                        out.append((key.view(np.int64), np.full(len(mine), int(number) * many + choice, dtype=np.int64), m[mine].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["cell", "path", "mark"])
    return run


def _links(radius: int):
    """Per cell: the linked pairs that join two parts of it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a_side, b_side = [], []
            marks = batch.column("marks")
            at, flat = np.asarray(marks.offsets), np.asarray(marks.values)
            for a, b in zip(at[:-1], at[1:]):
                m = np.sort(flat[a:b])
                table = distance_table(m.view(np.uint64))
                near = np.abs(table[:, None, :] - table[None, :, :]).max(axis=2) <= radius  # all pivots
                x, y = np.nonzero(np.triu(near, 1))
                close = np.bitwise_count(m[x].view(np.uint64) ^ m[y].view(np.uint64)) <= radius  # exact distance
                root = list(range(len(m)))

                def find(i):
                    while root[i] != i:
                        root[i] = root[root[i]]
                        i = root[i]
                    return i
                for i, j in zip(x[close].tolist(), y[close].tolist()):
                    p, q = find(i), find(j)
                    if p != q:  # the pair joins two parts
                        root[max(p, q)] = min(p, q)
                        a_side.append(int(m[j]))
                        b_side.append(int(m[i]))
            yield pa.RecordBatch.from_arrays([pa.array(a_side, pa.int64()), pa.array(b_side, pa.int64())], ["a", "b"])
    return run


def linked_marks(marks: DataFrame, *, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """(a, b) among distinct fingerprints (column ``mark``), whose components
    are those of all pairs within the radius."""
    spark = marks.sparkSession
    rows = marks.select(F.lit(0).cast("long").alias("cell"), F.lit(1).cast("long").alias("path"), "mark")
    found = spark.createDataFrame([], "a long, b long")
    for level in range(3):
        placed = rows.mapInArrow(_cells(), "cell long, path long, mark long")
        if level:
            placed = placed.distinct()
        counts = materialize(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "cells")
        # three cuts leave at most 2 + 2 blocks of one bit or 4 to 5 bits: 32 fingerprints
        small = counts.filter(F.col("n") <= crowd) if level < 2 else counts
        cells = placed.join(small.select("cell"), "cell").groupBy("cell").agg(F.collect_list("mark").alias("marks"))
        found = found.union(materialize(cells.select("marks").mapInArrow(_links(radius), "a long, b long").distinct(), "links"))
        if level == 2:
            break
        crowded = counts.filter(F.col("n") > crowd).select("cell")
        if crowded.isEmpty():
            break
        rows = materialize(placed.join(crowded, "cell"), "crowded")
    return found.distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE,
                       radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    if radius > RADIUS:
        raise ValueError(f"cells are cut for a radius of up to {RADIUS}")
    rows = materialize(fingerprints(docs, id_col, text_col, shingle=shingle), "fingerprints")
    nodes = materialize(rows.groupBy("mark").agg(F.min("doc").alias("least")), "marks")
    links = linked_marks(nodes.select("mark"), radius=radius, crowd=crowd)
    label = components(links)
    named = nodes.join(label, nodes["mark"] == label["node"], "left").select("mark", "least", F.coalesce("label", "mark").alias("label"))
    named = materialize(named, "labels")
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    names = named.join(least, "label").select("mark", "component_id")
    return rows.join(names, "mark").select(
        F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id")

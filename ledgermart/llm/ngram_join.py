"""N-gram Jaccard self-join by PartEnum signatures (operator 5).

A document's set holds the 64-bit hashes of its word shingles.  Two sets of
Jaccard similarity s or more differ in at most k elements, k depending on
their sizes, and their sizes lie in the same or in neighbouring bands of a
geometric scale; a set carries the tag of its band, and of the next one if
a partner can be there.  Under a tag the feature domain is cut into groups,
and each group into parts.  If there are more groups than k / (m + 1), two
similar sets differ in at most m elements in some group, hence in at most m
of its parts; so signatures are made of all choices of parts - m parts of a
group, and similar sets share one.  ``slack`` further groups guarantee
1 + slack groups that share one.

1. Documents with equal sets become one node.
2. Signatures that two different nodes share are kept, of nodes that share
   them in 1 + slack groups or more: documents that only quote a common
   passage go here.  A signature shared by more than ``CROWD`` nodes is
   crowded; a node with crowded signatures in no more than ``slack`` groups
   leaves them, as a partner must meet it in another group.  This loses
   nothing: if both nodes stay, they still meet.
3. In every signature each node is compared with one centre, the node with
   most company, and linked nodes become components; again with another
   centre (``CENTRES`` in all), only where a signature still spans several components.  What is
   left is compared pair by pair in signatures of up to ``CROWD`` nodes, and
   joined by its differences from a home elsewhere, rare elements first
   (rest_pairs).  So a group of copies costs about one comparison a copy, not
   one a pair, and every candidate pair is compared, ruled out by a bound or
   already joined: the components are exact.
4. A pair must share signatures in 1 + slack groups to be compared at all.
   Comparisons are exact, on the whole sets, in 100 * |a & b| >= pct * |a | b|.

Defined cases: null, empty and blank texts have no shingles, link with
nothing and are their own component; repeated rows each get a row; rows of
one id are linked only by their texts, and report the least id of their
component; null ids are kept but never a component's name unless all are
null; ties between centres go to the least node; an empty table gives an
empty result; other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermart.llm import words as W
from ledgermart.llm.common import col, map_in_arrow, text_of
from ledgermart.session import materialize, scratch

SHINGLE, PERCENT = 5, 80
BAND_RATIO, COVERAGE, SLACK_SHARE, CROWD, CENTRES = 1.3, 2.2, 0.2, 64, 1
#: Nodes of a home whose differences are counted, and the frequent elements kept of them; both only order elements.
SAMPLED, FREQUENT = 64, 1000
#: The low bits of a signature hold its tag.
TAGS = 127
#: Stands for a null id inside the operator.
NO_ID = -(2 ** 63)
#: Sets of copies that a task remembers so as not to sign them again.
SEEN_SETS = 50_000


# --- PartEnum ---------------------------------------------------------------

@lru_cache(maxsize=None)
def bands(percent: int) -> list[tuple[int, int]]:
    """Size bands (least, greatest) on a geometric scale."""
    out, low = [], 1
    while low < 2 ** 40:
        high = max(low, int(low * BAND_RATIO))
        out.append((low, high))
        low = high + 1
    return out


def most_apart(size: int, percent: int) -> int:
    """The greatest difference of two similar sets of up to ``size`` elements."""
    return 2 * size * (100 - percent) // (100 + percent)


@lru_cache(maxsize=None)
def plan(tag: int, percent: int) -> tuple[int, int, int, int]:
    """(groups, parts, m, slack) for a tag: the fewest signatures that cover
    ``COVERAGE`` elements each, or else the widest of a few."""
    low, high = bands(percent)[tag]
    least, k = max(1, math.ceil(low * percent / 100)), most_apart(high, percent)
    slack = int(k * SLACK_SHARE)
    best, widest = None, None
    for m in range(4):
        groups = math.ceil((k + 1) / (m + 1)) + slack
        for parts in range(m + 1, m + 5):
            cost, cover = groups * math.comb(parts, m), least / groups * (parts - m) / parts
            if cover >= COVERAGE and (best is None or cost < best[0]):
                best = (cost, groups, parts, m)
            if cost <= 40 and (widest is None or cover > widest[0]):
                widest = (cover, groups, parts, m)
    _, groups, parts, m = best or widest
    return groups, parts, m, slack


def tags_of(sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, tag) pairs of all sets that can have a partner."""
    highs = np.array([b[1] for b in bands(percent)])
    own = np.searchsorted(highs, sizes)
    some = (sizes > 0) & (np.array([most_apart(int(highs[t]), percent) for t in range(int(own.max(initial=0)) + 2)])[own] > 0)
    up = (100 * sizes >= percent * (highs[own] + 1)) & (sizes > 0)
    at, tag = np.concatenate([np.flatnonzero(some), np.flatnonzero(up)]), np.concatenate([own[some], own[up] + 1])
    return at, tag


def signatures(sizes: np.ndarray, hashes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, place, signature) of sets given one after another; a place is
    the tag and group, as one number."""
    first = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    at, tag = tags_of(sizes, percent)
    for t in np.unique(tag):
        groups, parts, m, _ = plan(int(t), percent)
        mine = at[tag == t]
        n = sizes[mine]
        pick = np.repeat(first[mine] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        h = W.mix(hashes[pick] ^ np.uint64(0xA5A5 + int(t)))
        cell = ((h >> np.uint64(32)) * np.uint64(groups * parts)) >> np.uint64(32)
        slot = np.repeat(np.arange(len(mine)), n) * (groups * parts) + cell.astype(np.int64)
        total = np.zeros(len(mine) * groups * parts, dtype=np.uint64)
        np.add.at(total, slot, W.mix(h))
        total = total.reshape(len(mine), groups, parts)
        group = np.arange(groups, dtype=np.uint64) + np.uint64(int(t) << 24)
        for c, chosen in enumerate(combinations(range(parts), parts - m)):
            salt = W.constants(parts, 31 + c)
            value = sum(total[:, :, p] * salt[p] for p in chosen)
            value = W.mix(value + W.mix(group * np.uint64(64) + np.uint64(c))[None, :])
            out.append((np.repeat(mine, groups), np.tile(group.view(np.int64), len(mine)), value.ravel()))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


# --- sets -------------------------------------------------------------------

def sets(w: W.Words, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, hashes, node) of the texts: sorted distinct shingle hashes
    one set after another; the node is a hash of the whole set."""
    texts, counts = len(w.first) - 1, np.diff(w.first)
    text = w.text_of_word()
    g = W.grams(w.hash, shingle)
    inside = np.flatnonzero(text[:len(g)] == text[shingle - 1:shingle - 1 + len(g)]) if len(g) else np.zeros(0, int)
    owner, value = [text[inside]], [g[inside]]
    for n in range(1, shingle):
        short = np.flatnonzero(counts == n)
        if len(short):
            owner.append(short)
            value.append(W.grams(w.hash, n)[w.first[short]])
    owner, value = np.concatenate(owner), np.concatenate(value)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    owner, value = owner[new], value[new]
    sizes = np.bincount(owner, minlength=texts)
    node = np.zeros(texts, dtype=np.uint64)
    np.add.at(node, owner, W.mix(value ^ np.uint64(0x5EED)))
    return sizes, value, W.mix(node + sizes.astype(np.uint64))


def _nodes(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in W.words(batch.column("body"), letters=False):
                sizes, _, node = sets(w, shingle)
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c).slice(w.rows.start, len(sizes)) for c in ("doc", "text_key")), pa.array(sizes.astype(np.int64)),
                    pa.array(node.view(np.int64), mask=sizes == 0)], ["doc", "text_key", "n_shingles", "node"])
    return run


def _signed(shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: OrderedDict[int, None] = OrderedDict()
        for batch in batches:
            for w in W.words(batch.column("body"), letters=False):
                sizes, value, node = sets(w, shingle)
                fresh = np.zeros(len(sizes), dtype=bool)
                for i, k in enumerate(node.tolist()):
                    fresh[i] = k not in seen
                    seen[k] = None
                    seen.move_to_end(k)
                    if len(seen) > SEEN_SETS:
                        seen.popitem(last=False)
                at, place, signature = signatures(np.where(fresh, sizes, 0), value[np.repeat(fresh, sizes)], percent)
                tag = place >> 24
                signature = (signature & ~np.uint64(TAGS)) | tag.astype(np.uint64)
                own = tag == np.searchsorted([b[1] for b in bands(percent)], sizes)[at]
                yield pa.RecordBatch.from_arrays([
                    pa.array(signature.view(np.int64)), pa.array(node[at].view(np.int64)), pa.array(own)],
                    ["signature", "node", "own"])
    return run


def _whole_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in W.words(batch.column("body"), letters=False):
                sizes, value, node = sets(w, shingle)
                last = np.cumsum(sizes)
                data = [value[b - n:b].tobytes() for b, n in zip(last, sizes)]
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(data, pa.binary())], ["node", "elements"])
    return run


def _similar(percent: int):
    """Exact comparison of pairs whose sets stand in the row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                a, b = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = np.concatenate([a, b])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])
    return run


def _apart(x, y) -> np.ndarray:
    """The elements in which two sets differ."""
    x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
    return np.setxor1d(x, y, assume_unique=True)


def _exploded(rows, at: list[int], elements: list[np.ndarray], names: list[str], **more) -> pa.RecordBatch:
    """Rows with one element each; ``at`` says which row an array belongs to."""
    many = np.array([len(e) for e in elements], dtype=np.int64)
    place = pa.array(np.repeat(np.array(at, dtype=np.int64), many))
    flat = np.concatenate([*elements, np.zeros(0, np.uint64)]).view(np.int64)
    kept = [rows.column(c).take(place) for c in names]
    extra = [pa.array(np.repeat(np.array(v, dtype=np.int64), many)) for v in more.values()]
    rank = np.concatenate([np.arange(1, m + 1) for m in many] or [np.zeros(0, np.int64)])
    return pa.RecordBatch.from_arrays([*kept, *extra, pa.array(rank), pa.array(flat)], [*names, *more, "rank", "element"])


def _all_differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_apart(x, y) for x, y in zip(batch.column("x"), batch.column("y"))]
        yield _exploded(batch, list(range(len(found))), found, ["home"]).select(["home", "element"])


def _differences(percent: int):
    """The first elements in which a node's set (y) and its home's (x)
    differ, those that the home's sample has not often first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part, prefixes, sizes = batch.slice(a, 256), [], []
                for x, y, often in zip(part.column("x"), part.column("y"), part.column("often")):
                    apart, n = _apart(x, y), len(y.as_buffer()) // 8
                    often = np.array(often.as_py() or [], dtype=np.int64).view(np.uint64)
                    order = np.argsort(often)
                    spot = np.searchsorted(often, apart, sorter=order)
                    known = np.zeros(len(apart), dtype=np.int64)  # 0: rare; else its place among the frequent, rarest first
                    if len(often):
                        hit = order[np.minimum(spot, len(often) - 1)]
                        known = np.where(often[hit] == apart, hit + 1, 0)
                    apart = apart[np.lexsort((apart, known))]
                    most = (n + n * 100 // percent) * (100 - percent) // (100 + percent)
                    prefixes.append(apart[:most + 1])
                    sizes.append(len(apart))
                yield _exploded(part, list(range(len(sizes))), prefixes, ["home", "node", "label", "n"], size=sizes)
    return run


# --- components -------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes on edges (a, b); the label is the least
    node of the component.  Alternating star contraction: every round joins
    each node's neighbours to its least one, by joins and minima only.
    Only the result of the last round stays on disk."""
    with scratch() as keep:
        now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
        while True:
            # done when every node has one edge down and none of these leads to a node that has one
            ends = now.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
                now.select("b", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
            if ends.filter("up > 1 OR (up > 0 AND down > 0)").isEmpty():
                break
            both = now.union(now.select("b", "a"))
            least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
            large = both.join(least, both["a"] == least["u"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
            least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
            joined = large.join(least, large["a"] == least["u"])
            small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("u", "m")).distinct()
            now = materialize(small, "edges")
        return keep(now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select("b", "b").distinct()), "components")


# --- the join ---------------------------------------------------------------

def _shared(rows: DataFrame, key: str = "signature", of: str = "node") -> DataFrame:
    """Rows of signatures that hold at least two different values."""
    ends = rows.groupBy(key).agg(F.min(of).alias("lo"), F.max(of).alias("hi")).filter("lo < hi").select(key)
    return rows.join(ends, key)


def _tag() -> Column:
    return F.col("signature").bitwiseAND(F.lit(TAGS)).cast("int")


def _slack(percent: int) -> Column:
    """The slack of a signature's tag."""
    return F.get(F.array(*[F.lit(plan(t, percent)[3]) for t in range(len(bands(percent)))]), F.col("tag"))


def live_signatures(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(signature, node) shared by two nodes, one at least of the tag's own
    band (two of the band before meet under their own tag), of nodes that
    share more signatures of the tag than the slack, as a partner must.

    Texts are signed twice: minima and maxima per signature combine in each
    task, so no signature is gathered anywhere however many documents share
    it, and the semi-join with what is left can be split by Spark."""
    signed = map_in_arrow(docs, _signed(shingle, percent), "signature long, node long, own boolean")
    ends = signed.groupBy("signature").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.max("own").alias("own"))
    shared = materialize(ends.filter("lo < hi AND own").select("signature"), "shared")
    again = map_in_arrow(docs, _signed(shingle, percent), "signature long, node long, own boolean")
    live = materialize(again.join(shared, "signature", "left_semi").select("signature", "node"), "signatures")
    live = live.distinct().withColumn("tag", _tag())
    enough = live.groupBy("node", "tag").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > _slack(percent))
    return materialize(_shared(live.join(enough.select("node", "tag"), ["node", "tag"]).select("signature", "node")), "signatures")


def candidates(live: DataFrame, percent: int) -> DataFrame:
    """(signature, node) without the crowded ones that the slack allows to leave."""
    crowd = live.groupBy("signature").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD).select("signature")
    crowded = live.join(crowd, "signature").withColumn("tag", _tag())
    pressed = crowded.groupBy("node", "tag").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > _slack(percent))
    stay = crowded.join(pressed.select("node", "tag"), ["node", "tag"]).select("signature", "node")
    calm = live.join(crowd, "signature", "left_anti")
    return materialize(_shared(calm.union(stay)), "candidates")


def promising(pairs: DataFrame, vectors: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, tag) that share more signatures than the slack."""
    with_a = pairs.join(vectors.select(F.col("node").alias("a"), "tag", F.col("own").alias("x")), ["a", "tag"])
    with_b = with_a.join(vectors.select(F.col("node").alias("b"), "tag", F.col("own").alias("y")), ["b", "tag"])
    return with_b.filter(F.size(F.array_intersect("x", "y")) > _slack(percent)).select("a", "b").distinct()


def similar_pairs(pairs: DataFrame, elements: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar, by their whole sets."""
    e = elements.select("node", "elements", F.length("elements").alias("n"))
    left = pairs.join(e.select(F.col("node").alias("b"), F.col("elements").alias("y"), F.col("n").alias("ny")), "b")
    wide = left.join(e.select(F.col("node").alias("a"), F.col("elements").alias("x"), F.col("n").alias("nx")), "a")
    near = wide.filter((100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny"))).select("a", "b", "x", "y")
    return map_in_arrow(near, _similar(percent), "a long, b long")


def rest_pairs(left: DataFrame, homes: DataFrame, elements: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that can still be similar, across components, for nodes
    (signature, node, label) in crowded signatures.

    Nodes that share a crowded signature, directly or through others, form a
    cluster; its home c is the centre that most of them meet (``homes`` has
    the centre of every signature).  Let D(a) be the elements in which a and
    c differ.  a and b differ in |D(a)| + |D(b)| - 2 |D(a) & D(b)| elements,
    and similar ones in k = r (|a| + |b|) at the most, with
    r = (100 - percent) / (100 + percent); so they share t =
    (|D(a)| + |D(b)| - k) / 2 elements of D or more.

    * t <= 0: then a and b are both similar to c (the shorter difference is
      at most k / 2, and the other at most k less the first); every node is
      paired with its home.
    * t >= 1: in any one order of the elements, a and b meet on one of the
      first |D| - t + 1 of both, which is k + 1 at the most as
      |D(a)| <= |D(b)| + k; and what follows the first shared element must
      still reach t.

    The order decides the cost only: elements that a sample of ``SAMPLED``
    nodes of the home has often come last, the more frequent the later, so
    what many copies share is seldom in a prefix."""
    home = homes.select("signature", "centre")
    met = materialize(left.join(home, "signature").select("centre", "node", "label").distinct(), "met")
    cluster = components(met.select(F.col("node").alias("a"), F.col("centre").alias("b")))
    of = met.join(cluster.withColumnRenamed("label", "cluster"), "node")
    busy = of.groupBy("cluster", "centre").agg(F.count(F.lit(1)).alias("n"))
    seat = busy.groupBy("cluster").agg(F.max(F.struct("n", "centre"))["centre"].alias("home"))
    near = materialize(_shared(of.join(seat, "cluster").select("home", "node", "label").distinct(), key="home", of="label"), "near")
    x = elements.select(F.col("node").alias("home"), F.col("elements").alias("x"))
    y = elements.select("node", F.col("elements").alias("y"), (F.length("elements") / 8).cast("long").alias("n"))

    size = near.groupBy("home").agg(F.count(F.lit(1)).alias("nodes"))
    drawn = near.join(size, "home").filter(F.pmod(F.xxhash64("node"), F.greatest(F.lit(1).cast("long"), F.floor(F.col("nodes") / SAMPLED))) == 0)
    told = map_in_arrow(drawn.join(y, "node").join(x, "home").select("home", "x", "y"), _all_differences, "home long, element long")
    counts = told.groupBy("home", "element").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    last = Window.partitionBy("home").orderBy(F.col("n").desc(), "element")
    often = counts.withColumn("place", F.row_number().over(last)).filter(F.col("place") <= FREQUENT).groupBy("home").agg(
        F.sort_array(F.collect_list(F.struct("n", "element")))["element"].alias("often"))   # rarest first
    prefix = materialize(map_in_arrow(near.join(y, "node").join(x, "home").join(often, "home", "left").select(
        "home", "node", "label", "n", "x", "y", "often"), _differences(percent),
        "home long, node long, label long, n long, size long, rank long, element long"), "differences")
    other = prefix.select(F.col("home").alias("home_b"), F.col("element").alias("element_b"), F.col("node").alias("b"),
                          F.col("label").alias("other"), F.col("n").alias("n_b"), F.col("size").alias("size_b"),
                          F.col("rank").alias("rank_b"))
    allowed = F.floor((F.col("n") + F.col("n_b")) * (100 - percent) / (100 + percent))
    follow = F.least(F.col("size") - F.col("rank"), F.col("size_b") - F.col("rank_b"))
    pairs = prefix.join(other, (F.col("home") == F.col("home_b")) & (F.col("element") == F.col("element_b")) & (F.col("node") > F.col("b"))
                        & (F.col("label") != F.col("other")) & (2 * (1 + follow) >= F.col("size") + F.col("size_b") - allowed)
                        & (100 * F.least("n", "n_b") >= percent * F.greatest("n", "n_b")))
    # a label is a node of its component: who has the home's is joined to it
    own = near.filter("home <> node AND home <> label").select(F.greatest("node", "home").alias("a"), F.least("node", "home").alias("b"))
    return pairs.select(F.col("node").alias("a"), "b").union(own).distinct()


def link_nodes(rows: DataFrame, vectors: DataFrame, elements: DataFrame, percent: int, centres: int = CENTRES) -> DataFrame:
    """(node, label) of all nodes linked to another one."""
    size = rows.groupBy("signature").agg(F.count(F.lit(1)).alias("n"))
    company = rows.join(size, "signature").groupBy("node").agg(F.sum("n").alias("company"))
    left = materialize(rows.join(company, "node").select("signature", "node", "company", F.col("node").alias("label")), "left")
    edges = labels = homes = None
    for turn in range(centres):  # everyone with the centre of the signature: most company, then least node
        best = left.groupBy("signature").agg(F.max(F.struct(
            F.col("company"), F.bitwise_not("node").alias("not_node"), F.col("label"))).alias("c"))
        best = materialize(best.select("signature", F.bitwise_not("c.not_node").alias("centre"), F.col("c.label").alias("of_centre")), "centres")
        homes = best if homes is None else homes
        pairs = left.join(best, "signature").filter("label <> of_centre").select(
            F.greatest("node", "centre").alias("a"), F.least("node", "centre").alias("b"), _tag().alias("tag"))
        edges, labels = _linked(edges, labels, promising(pairs.distinct(), vectors, percent), elements, percent)
        # a centre has met everyone in its signature and leaves it
        met = best.select("signature", F.col("centre").alias("node"))
        known = left.drop("label").join(met, ["signature", "node"], "left_anti").join(labels, "node", "left")
        left = materialize(_shared(known.withColumn("label", F.coalesce("label", "node")), of="label"), "left")
        if left.isEmpty():
            return labels
    # what is left: pair by pair where a signature has few nodes, by their differences from the centre elsewhere
    full = left.groupBy("signature").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD).select("signature")
    few = left.join(full, "signature", "left_anti").select("signature", "node", "label")
    other = few.select("signature", F.col("node").alias("b"), F.col("label").alias("other"))
    pairs = few.join(other, "signature").filter("node > b AND label <> other").select(
        F.col("node").alias("a"), "b", _tag().alias("tag"))
    pairs = promising(pairs.distinct(), vectors, percent)
    many = left.join(full, "signature", "left_semi")
    if not many.isEmpty():
        pairs = pairs.union(rest_pairs(many, homes, elements, percent)).distinct()
    return _linked(edges, labels, pairs, elements, percent)[1]


def _linked(edges: DataFrame | None, labels: DataFrame | None, pairs: DataFrame, elements: DataFrame,
            percent: int) -> tuple[DataFrame, DataFrame]:
    """All links so far with those among ``pairs``, and the components."""
    found = materialize(similar_pairs(materialize(pairs, "pairs"), elements, percent), "links")
    if edges is None:
        return found, components(found)
    if found.isEmpty():
        return edges, labels
    edges = edges.union(found)
    return edges, components(edges)


def labelled_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE,
                  percent: int = PERCENT) -> DataFrame:
    """(doc, text_key, n_shingles, node, label) of every row: ``doc`` is
    ``NO_ID`` without an id, ``text_key`` the hash of the text (null as
    empty), ``label`` the component, null for texts without a shingle."""
    d = docs.select(F.coalesce(col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), text_of(text_col).alias("body"))
    keyed = d.withColumn("text_key", F.xxhash64("body"))
    with scratch() as keep:   # of all intermediate tables only the result stays
        rows = materialize(map_in_arrow(keyed, _nodes(shingle), "doc long, text_key long, n_shingles long, node long"), "nodes")
        live = live_signatures(d.select("body"), shingle, percent)
        if live.isEmpty():
            return keep(rows.withColumn("label", F.col("node")), "labelled")
        shared = candidates(live, percent)
        # one set's own signatures
        vectors = materialize(live.withColumn("tag", _tag()).groupBy("node", "tag").agg(F.collect_list("signature").alias("own")), "vectors")
        # one text of each node in question: the least document's
        firsts = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc").alias("doc"))
        wanted = materialize(firsts.join(shared.select("node").distinct(), "node").select("doc").distinct(), "wanted")
        texts = d.join(wanted, "doc", "left_semi").withColumn("text_key", F.xxhash64("body")).dropDuplicates(["doc", "text_key"])
        elements = materialize(map_in_arrow(texts.select("body"), _whole_sets(shingle), "node long, elements binary"), "sets")
        labels = link_nodes(shared, vectors, elements, percent)
        return keep(rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE,
               percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    labelled = labelled_rows(docs, id_col, text_col, shingle=shingle, percent=percent)
    names = labelled.filter("label IS NOT NULL").groupBy("label").agg(
        F.min(F.when(F.col("doc") != NO_ID, F.col("doc"))).alias("component_id"))
    doc_id = F.when(F.col("doc") != NO_ID, F.col("doc"))
    return labelled.join(names, "label", "left").select(
        doc_id.alias("doc_id"), "n_shingles", F.coalesce("component_id", doc_id).alias("component_id"))

"""Quality by compression (operator 4).

Two zstandard dictionaries are built, one from good and one from bad
labelled texts.  A text that looks like the good ones is shorter when
compressed with their dictionary: the difference of the two sizes, divided
by their sum, is the raw score.  Texts are compressed whole, in blocks, so
that a long text cannot outgrow a dictionary.  A logistic curve over the
raw score, the plain compressed size per byte and the length turns it into
a probability of label 1.

The fit is bounded: at most ``sample`` labelled rows a class, those with
the least hash of their id, and of these texts up to ``sample_chars``.
Half of them build the dictionaries, the other half the curve (weighted
back to the true class sizes).  Ids are chosen from the labels alone, so
the documents are only scanned, not shuffled.  Scoring covers every row in
one scan without a shuffle.

Defined cases: null text is empty; the empty text has raw score 0 and gets
the curve's value there; rows with null labels or ids do not teach; with
labels of one class only (or none) every score is the share of label 1 (or
0.5); repeated rows are scored each; an empty table gives an empty result;
other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermart.llm.common import col, map_in_arrow, text_of

SAMPLE, SAMPLE_CHARS = 2000, 20_000
DICTIONARY_BYTES, BLOCK_BYTES, LEVEL = 65_536, 512, 3
THRESHOLD = 0.3


@dataclass
class Model:
    good: bytes
    bad: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    constant: float | None = None


class Compressors:
    """One task's compressors; made from a broadcast model."""

    def __init__(self, model: Model):
        options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.model, self.with_dict = model, []
        for content in (model.good, model.bad):
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=LEVEL)
            self.with_dict.append(zstandard.ZstdCompressor(dict_data=d, **options).compress)
        self.plain = zstandard.ZstdCompressor(**options).compress

    def features(self, text: str) -> list[float]:
        data = text.encode("utf-8", "replace")
        blocks = [data[i:i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        good, bad = (sum(map(len, map(c, blocks))) for c in self.with_dict)
        raw = (bad - good) / (bad + good) if blocks else 0.0
        size = math.log(len(self.plain(data)) / (len(data) + 20))
        n = math.log1p(len(data))
        return [raw, size, n, raw * raw, size * size, raw * size, raw * n]

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.model.constant is not None or not texts:
            return np.full(len(texts), self.model.constant or 0.0)
        x = (np.array([self.features(t) for t in texts]) - self.model.mean) / self.model.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.model.weights[1:] + self.model.weights[0], -30, 30)))


def _dictionary(texts: list[str]) -> bytes:
    samples = [t.encode("utf-8", "replace") for t in texts]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"\n".join(samples)[-DICTIONARY_BYTES:]


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Penalised logistic fit by Newton steps that never lose likelihood."""
    x = np.c_[np.ones(len(x)), x]
    ridge = penalty * np.eye(x.shape[1])
    ridge[0, 0] = 1e-6

    def loss(w):
        z = x @ w
        return float(weight @ (np.logaddexp(0, z) - y * z) + w @ ridge @ w / 2)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge @ w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, slope)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        *, learn: Column | None = None, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fit on labelled rows for which ``learn`` (over the labels) holds."""
    known = labels.select(col(id_col).alias("id"), col(label_col).cast("int").alias("y")).filter(
        "id IS NOT NULL AND y IN (0, 1)")
    if learn is not None:
        known = known.filter(learn)
    total = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(total) < 2:
        share = float(next(iter(total))) if total else 0.5
        return Model(b"", b"", np.zeros(7), np.ones(7), np.zeros(8), share)
    order = F.xxhash64(F.col("id").cast("string"))
    # at most ``sample`` ids a class, so the broadcast is bounded
    chosen = [known.filter(F.col("y") == y).distinct().orderBy(order, "id").limit(sample) for y in (0, 1)]
    texts = docs.select(col(id_col).alias("id"), text_of(text_col).alias("body")).filter(F.length("body") <= sample_chars)
    rows = texts.join(F.broadcast(chosen[0].union(chosen[1])), "id").select("y", "body", order.alias("o")).collect()
    rows.sort(key=lambda r: (r["o"], r["body"]))
    teach, tune = rows[::2], rows[1::2]
    if min(len({r["y"] for r in teach}), len({r["y"] for r in tune})) < 2:
        return Model(b"", b"", np.zeros(7), np.ones(7), np.zeros(8), total[1] / (total[0] + total[1]))
    model = Model(*(_dictionary([r["body"] for r in teach if r["y"] == y]) for y in (1, 0)),
                  np.zeros(7), np.ones(7), np.zeros(8))
    use = Compressors(model)
    x, y = np.array([use.features(r["body"]) for r in tune]), np.array([float(r["y"]) for r in tune])
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    each = [total[k] / max(1, (y == k).sum()) for k in (0, 1)]
    weight = np.where(y == 1, each[1], each[0])
    model.weights = _curve((x - model.mean) / model.scale, y, weight * len(y) / weight.sum())
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "quality_score") -> DataFrame:
    """``docs`` with the column ``name``; all other columns and rows as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != name]
    d = docs.select(*map(col, kept), text_of(text_col).alias("__body"))
    schema = d.drop("__body").schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = Compressors(shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                scores = use.scores(part.column("__body").to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(scores, pa.float64())],
                                                 [*kept, name])

    return map_in_arrow(d, run, schema)

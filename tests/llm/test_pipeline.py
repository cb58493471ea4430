"""The pipeline against a version in plain Python, stage by stage."""

import hashlib
import re
from array import array

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from ledgermart.llm import pii
from ledgermart.llm import quality_classifier as quality
from ledgermart.llm.common import BATCH_BYTES, BATCH_KEY, map_in_arrow
from tests.llm.test_corpus_operators import LOWER, brute_components
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def letter_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(spark, sf_dir):
    """{stage: rows after it} for distinct ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn=~P.held_out(F.col("id")))
    rows = [tuple(r) for r in docs.collect()]
    scores = quality.Compressors(model).scores([r[1] or "" for r in rows])
    rows = [r for r, s in zip(rows, scores) if s >= quality.THRESHOLD]
    out = {"quality_classifier": rows}
    least = brute_components([(r[0], r[1]) for r in rows], 5, 80)
    rows = [r for r in rows if least[r[0]] == r[0]]
    out["near_duplicates"] = rows
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = letter_words(r["text"])
        n = min(10, len(w))
        windows |= {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()

    def clean(text):
        w = letter_words(text)
        return not any(tuple(w[i:i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))
    rows = [r for r in rows if clean(r[1])]
    out["decontamination"] = rows
    model = pii.fit(spark.createDataFrame(rows, docs.schema))
    said = [None if r[1] is None else pii.masked(r[1], pii.find_spans(r[1], model)) for r in rows]
    rows = [(r[0], t, r[2], r[3], r[4] if t is None else len(t)) for r, t in zip(rows, said)]
    out["pii"] = rows
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [lib.encode(r[1] or "", add_special_tokens=False).ids for r in rows]
    out["bpe"] = [(r[0], len(x), hashlib.sha256(array("I", x).tobytes()).hexdigest()) for r, x in zip(rows, ids)]
    return out


def test_every_stage_equals_plain_python(spark, tmp_path):
    want, docs = plain(spark, SF), spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in P.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "bpe":
            assert docs.columns == COLUMNS
            got = [tuple(r) for r in docs.collect()]
        else:
            got = [tuple(r) for r in docs.select("doc_id", "n_tokens", "ids_sha256").collect()]
        assert sorted(got) == sorted(want[name]), name
        assert 0 < len(got) <= 200
    run = P.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256").collect()
    assert sorted(tuple(r) for r in run) == sorted(want["bpe"])


def test_stages_on_odd_and_empty_tables(spark, odd, empty):
    names = [n for n, _ in P.STAGES]
    assert 4 <= len(names) <= 5 and "near_duplicates" in names
    for folder, some in ((odd, True), (empty, False)):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for name, stage in P.STAGES:
            out = stage(spark, docs, folder)
            rows = out.collect()
            assert bool(rows) == some or (some and name != "bpe")
            if name != "bpe":
                assert out.columns == docs.columns and out.schema["text"].dataType == docs.schema["text"].dataType
            if name == "near_duplicates" and some:
                kept = [r["doc_id"] for r in rows]
                assert len([k for k in kept if k is not None]) == len({k for k in kept if k is not None})
                assert not {17} & set(kept) and {16, 18} <= set(kept)  # copies go, the least id stays
            if name == "decontamination" and some:
                assert not {8, 9} & {r["doc_id"] for r in rows}
            if name == "pii" and some:
                text = next(r["text"] for r in rows if r["doc_id"] == 10)
                assert "<EMAIL>" in text and "<IP>" in text and "<CARD>" in text and "<PHONE>" in text and "300.1.1.1" in text


def test_near_duplicates_with_null_and_repeated_ids(spark):
    def prose(seed, n=60):
        return " ".join(f"w{seed}x{i * 7919 % 1000}" for i in range(n))
    rows = [(None, prose(1)), (4, prose(1) + " more"), (None, prose(2)), (None, prose(3)),  # one of four is a copy
            (None, prose(4)), (None, prose(4)), (None, prose(4) + " end"),  # copies that have no id
            (5, prose(1) + " and"), (5, prose(5)), (6, prose(6)), (6, prose(7)),  # unlike texts of one id
            (8, ""), (8, None), (9, " "), (None, ""), (None, "")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, `n.k` int")
    out = P.near_duplicate_stage(spark, docs, SF)
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert out.columns == docs.columns
    assert [i for i, t in got if t and "w1x" in t] == [4]
    assert sum("w4x" in (t or "") for _, t in got) == 1
    for row in ((None, prose(2)), (None, prose(3)), (5, prose(5)), (6, prose(6)), (6, prose(7)), (9, " ")):
        assert got.count(row) == 1
    assert [i for i, t in got if not (t or "").strip()].count(8) == 1 and got.count((None, "")) == 2
    assert len(got) == 11


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stage_functions_take_a_frame_of_their_own(spark, name):
    docs = spark.createDataFrame([(5, "just one text", "en", "s", 13)], "doc_id long, text string, lang string, source string, n_chars long")
    assert dict(P.STAGES)[name](spark, docs, SF).count() in (0, 1)


def test_texts_reach_python_in_batches_bounded_in_bytes(spark, tmp_path):
    """Rows alone do not bound a batch: 200 texts of 100,000 characters were one of 20 MB."""
    path = str(tmp_path / "long")
    spark.range(200).select(F.col("id").alias("doc_id"), F.repeat(F.lit("long text "), 10_000).alias("text")).coalesce(1).write.parquet(path)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])
    docs = spark.read.parquet(path)
    got = [tuple(r) for r in map_in_arrow(docs, sizes, "n long, size long").collect()]
    assert sum(n for n, _ in got) == 200 and max(size for _, size in got) <= BATCH_BYTES + 200_000
    # and so the stages' own batches
    P.near_duplicate_stage(spark, docs, SF)
    assert spark.conf.get(BATCH_KEY) == str(BATCH_BYTES)

"""Operators on single texts against plain Python and public libraries."""

import hashlib
import math
import random
import re
import zlib
from array import array

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgermart.llm import bpe, pii
from ledgermart.llm import quality_classifier as quality
from ledgermart.llm.catalog import QUERIES

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tables():
    return bpe.Tables(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(data):
    out = array("I")
    out.frombytes(data)
    return out.tolist()


TRICKY = ["", "  ", "a" * 5000, "ab" * 3000, "<|endoftext|>hi<|startoftext|>", "\u0130stanbul \u03a3\u0391\u03a3 \u03c2", "e\u0301x",
          "\u65e5\u672c\u8a9e \ud55c\uad6d", "\U0001F602" * 330, "\x1c a\x85b\xa0c\u180ed\u200be", "don't we'll 'S", "\u0663 \u00bd",
          "\u0130" * 400, "!?" * 600, "\u1e9b\u0323", "a\x00b \x01", "the " * 40_000]


@pytest.mark.parametrize("text", TRICKY, ids=range(len(TRICKY)))
def test_bpe_equals_library(tables, library, text):
    got = bpe.Encoder(tables).encode(text)
    want = library.encode(text, add_special_tokens=False).ids
    assert ids_of(got) == want
    assert "".join(bpe.Decoder(tables).spellings([got])) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(max_codepoint=0x2FF) | st.sampled_from("the and ing er\u0301'|<>"), max_size=60))
def test_bpe_equals_library_on_any_text(text):
    t, lib = _once()
    assert ids_of(bpe.Encoder(t).encode(text)) == lib.encode(text, add_special_tokens=False).ids


def _once(cache=[]):  # noqa: B006
    if not cache:
        cache += [bpe.Tables(PATH), Tokenizer.from_file(PATH)]
    return cache


def test_stream_is_the_same_in_any_pieces_and_early(tables):
    word, e = "theandinger" * 200, bpe.Encoder(tables)
    whole = list(e.stream([word]))
    rng = random.Random(3)
    cuts = sorted(rng.sample(range(len(word)), 50))
    assert list(e.stream(word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)]))) == whole
    read = [0]

    def letters():
        for c in word:
            read[0] += 1
            yield c
    first = next(e.stream(letters()))
    assert first == whole[0] and read[0] < len(word)  # emitted long before the word ends


def test_text_decoder_round_trip_and_unfinished_bytes(tables):
    e, d = bpe.Encoder(tables), bpe.Decoder(tables)
    said = e.encode("hello w\u00f6rld \U0001F602 ok")
    single = [said[i:i + 4] for i in range(0, len(said), 4)]  # id by id: characters arrive in parts
    assert "".join(d.text(single)) == "hello w\u00f6rld \U0001F602 ok "


def test_bpe_query_equals_library(spark, library, odd):
    import hashlib
    for folder in (SF, odd):
        docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").toPandas()
        want = []
        for i, t in zip(docs.doc_id, docs.text):
            ids = library.encode(t or "", add_special_tokens=False).ids
            want.append((repr(i), len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(),
                         hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        got = QUERIES["op8_bpe"](spark, folder).toPandas()
        assert sorted(want) == sorted((repr(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.itertuples())


# --- personal data ---

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_base(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    for kind, pattern, low, high in (("card", CARD, 13, 19), ("phone", PHONE, 9, 15)):
        for m in pattern.finditer(t):
            d = [int(c) for c in m.group() if "0" <= c <= "9"]
            check = sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])
            if low <= len(d) <= high and (kind == "phone" or check % 10 == 0):
                out.append((kind, *m.span()))
    return out


@settings(max_examples=1500, deadline=None)
@given(st.text(st.sampled_from("a1.@+-%2 9()\n4"), max_size=40))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == plain_base(text)


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(spark.read.parquet(f"{SF}/documents.parquet"), sample=200)


def test_pii_keeps_base_and_adds_secrets(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = docs.filter("text LIKE '%token = %'").select("text").toPandas().text
    named = found = 0
    for t in rows:
        spans = pii.find_spans(t, model)
        assert [s[:3] for s in spans if s[3]] == plain_base(t)
        for m in re.finditer(r'token = "([0-9a-f]{40})"', t):
            named += 1
            found += ("secret", *m.span(1), False) in spans
    assert named > 50 and found >= 0.95 * named


def test_pii_sample_is_of_distinct_lines_and_every_kind(spark, monkeypatch):
    secret = [f'token = "{hashlib.sha1(bytes([i])).hexdigest()}"' for i in range(5)]
    prose = [f"page {i} of the book" for i in range(600)]
    text = [("\n".join([x] * (300 if i < 3 else 1)),) for i, x in enumerate(prose)] + [(x,) for x in secret]
    docs = spark.createDataFrame([(None, *x) for x in text], "doc_id long, text string")
    monkeypatch.setattr(pii, "train", list)
    got = pii.fit(docs, sample=60)
    assert len(got) == len(set(got)) == 60 and set(secret) <= set(got)
    assert sorted(pii.fit(docs.filter("text LIKE 'page 1%' OR text LIKE 'token%'").limit(30))) == sorted(set(
        line for row in docs.filter("text LIKE 'page 1%' OR text LIKE 'token%'").limit(30).collect() for line in row["text"].split("\n")))


def test_pii_leaves_plain_prose(spark, model):
    texts = ["There is no number here.", "In 1999, 12 of 30 people came; see page 7.", "", "Version 2.0 costs 15 euros."]
    assert [pii.find_spans(t, model) for t in texts] == [[]] * 4


def test_posteriors_sum_to_one(model):
    text = "call +1 (702) 555-0742 or mail x@y.org"
    for atoms in pii.regions(text):
        edges = model.lattice(text, atoms)
        sure, _ = pii.Model.marginals(edges, len(atoms))
        for k in range(len(atoms)):  # every atom lies in exactly one segment
            assert sum(p for p, e in zip(sure, edges) if e[0] <= k < e[1]) == pytest.approx(1)


def test_best_segmentation_equals_enumeration(model):
    text = "to 64.147.79.24 x"
    atoms = next(iter(pii.regions(text)))
    edges = model.lattice(text, atoms)

    def paths(at):
        if at == len(atoms):
            yield 0.0, []
        for e in edges:
            if e[0] == at:
                for s, rest in paths(e[1]):
                    yield s + e[4], [e, *rest]
    best = max(paths(0), key=lambda p: p[0])[1]
    want = [(pii.KINDS[e[2]], atoms[e[0]][0], atoms[e[1] - 1][1]) for e in best if e[2] >= 0]
    assert model.spans(text, atoms) in (want, [])  # or too unsure to be reported


def test_masking_replaces_overlaps_once():
    assert pii.masked("ab1234cd", [("ip", 2, 5, True), ("card", 3, 6, True)]) == "ab<IP>cd"
    assert pii.masked("x", []) == "x"


# --- quality ---

def test_quality_on_held_out_rows(spark):
    got = QUERIES["op4_quality_classifier"](spark, "/root/testdata/sf0.1").toPandas()
    assert len(got) == 10_000 and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    labels = pd.read_parquet("/root/testdata/sf0.1/labels.parquet")
    held = got[got.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.95
    assert held[held.quality == 1].predicted.mean() > 0.98


def test_quality_without_both_classes(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    for labels, want in (([], 0.5), ([(1, 1)], 1.0), ([(1, 0), (2, None)], 0.0)):
        model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert [r["quality_score"] for r in quality.score(docs, model).collect()] == [want, want]


def test_quality_keeps_all_columns(spark):
    docs = spark.createDataFrame([(1, "a", "x", 2)], "doc_id long, text string, y string, n_chars int")
    model = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.score(docs, model).columns == ["doc_id", "text", "y", "n_chars", "quality_score"]


def test_quality_score_of_a_fixed_model_equals_brute_force(spark):
    """Sizes counted block by block with fresh compressors, the curve by hand."""
    rng = random.Random(12)
    good, bad = b"the quick brown fox jumps over the lazy dog " * 40, b"buy cheap pills now click here win win win " * 40
    model = quality.Model(good, bad, np.array([.01, -.5, 6, .001, .3, 0, .05]), np.array([.02, .2, 1, .01, .1, .05, .2]),
                          np.array([.3, 1.5, -.2, .1, -.4, .2, .05, .6]))
    texts = [None, "", "fox", "\u00e4\u00df\u4e2d" * 300] + [" ".join(rng.choice("the fox jumps over buy cheap pills win dog now".split())
                                                                for _ in range(rng.randrange(1, 900))) for _ in range(40)]

    def size(data, content=None):
        d = zstandard.ZstdCompressionDict(content) if content else None
        return len(zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(data))

    def want(text):
        data = (text or "").encode()
        cut = [data[i:i + 512] for i in range(0, len(data), 512)]
        with_good, with_bad = (sum(size(b, c) for b in cut) for c in (good, bad))
        raw = (with_bad - with_good) / (with_bad + with_good) if cut else 0.0
        plain, n = math.log(size(data) / (len(data) + 20)), math.log(1 + len(data))
        z = model.weights[0]
        for w, m, s, x in zip(model.weights[1:], model.mean, model.scale, [raw, plain, n, raw * raw, plain * plain, raw * plain, raw * n]):
            z += w * (x - m) / s
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    got = {r["doc_id"]: r["quality_score"] for r in quality.score(d, model).collect()}
    assert all(got[i] == pytest.approx(want(t), abs=1e-9) for i, t in enumerate(texts))


def test_pii_query_columns_equal_the_patterns(spark):
    """The query's own counts, digest and spans over the whole test table."""
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op6_pii"](spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        base = plain_base(texts[r["doc_id"]])
        kinds = ["email", "ip", "card", "phone"]
        assert [r[f"n_{k}"] for k in kinds] == [sum(b[0] == k for b in base) for k in kinds]
        said = ",".join(f"{k}:{a}:{z}" for k, a, z in sorted(base, key=lambda b: (kinds.index(b[0]), b[1])))
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        spans = [tuple(x.split(":")) for x in r["spans"].split(",") if x]
        assert {(k, str(a), str(z)) for k, a, z in base} <= set(spans)
        order = [(["email", "ip", "card", "phone", "secret"].index(k), int(a)) for k, a, _ in spans]
        assert order == sorted(order) and all(int(a) < int(z) <= len(texts[r["doc_id"]]) for _, a, z in spans)

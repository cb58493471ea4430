"""Odd tables: nulls in every column, empty and long texts, ties, repeated
rows, clashing extra columns; and the same tables without rows."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards boil jugs of mead"
LONG = " ".join(f"word{i % 997} of{i % 13}" + (".\n" if i % 17 == 0 else "") for i in range(20_000))
TEXTS = [
    (1, ""), (2, None), (3, " \n\t \x0b "), (4, LONG), (5, LONG.replace("word500", "other")),
    (6, "CC by cc by, All Rights Reserved.\nGNU General Public License version 3; all rights reserved"),
    (7, "\u212a \u0130 \u1e9e a\u0085b \U0001F600 x \u00a0y\u2028z"), (7, "\u212a \u0130 \u1e9e a\u0085b \U0001F600 x \u00a0y\u2028z"),
    (None, "no id but words enough to be a document of its own kind, said once"),
    (8, f"Before it all. {PASSAGE.upper()} and after."), (9, f"x {PASSAGE} y {PASSAGE} z short item"),
    (10, "Mail a.b+c@d-e.f.org or 192.168.0.1, 300.1.1.1, card 4111 1111 1111 1111, phone +1 (702) 555-0742 ok"),
    (11, "a" * 50_000), (12, "same line\n" * 300 + "one\ntwo"), (13, "<|startoftext|>hi</s>[INST]<|endoftext|>"),
    (14, "Licensed under the Apache License, Version 2.0.\nreleased UNDER the mit license"), (15, "9" * 20_000 + "." + "@" * 3000),
    (16, "d e f " * 40), (17, "d e f " * 40), (18, "one two three"), (19, "One  two\nthree"), (20, "#*$%&|<> # * $"),
]
VECTORS = [(1, [0.5, -1.0, 0.25]), (1, [0.5, -1.0, 0.25]), (None, [3.0, 2.0, 0.25]), (2, None), (3, [None, 1.0, 1.0]), (4, []),
           (5, [float("nan"), 0.0, 0.0]), (6, [1.0, float("-inf"), 0.0]), (7, [1.0, 2.0]), (8, [3e38, 0.0, 0.0]), (9, [-7.5, 0.125, 0.25])]


def _write(folder, documents, benchmark, labels, pages, conversations):
    extra = {"words": pa.string(), "n_words": pa.int32(), "body": pa.string(), "signature": pa.int64(), "label": pa.string(),
             "uid": pa.string(), "digest": pa.string(), "score": pa.string(), "spans": pa.string(), "node": pa.string()}
    n = len(documents)
    docs = pa.table({"doc_id": pa.array([d for d, _ in documents], pa.int64()),
                     "text": pa.array([t for _, t in documents], pa.string()),
                     "lang": pa.array([None if i % 3 else "en" for i in range(n)], pa.string()),
                     "source": pa.array([None if i % 5 == 0 else "src" for i in range(n)], pa.string()),
                     "n_chars": pa.array([None if t is None else len(t) for _, t in documents], pa.int64()),
                     **{k: pa.array([None if i % 2 else 7 if v == pa.int32() or v == pa.int64() else "x" for i in range(n)], v)
                        for k, v in extra.items()}})
    tables = {
        "documents": docs,
        "benchmark": pa.table({"item_id": pa.array([b[0] for b in benchmark], pa.int64()),
                               "text": pa.array([b[1] for b in benchmark], pa.string()),
                               "said": pa.array([None] * len(benchmark), pa.string())}),
        "labels": pa.table({k: pa.array([r[i] for r in labels], pa.int64()) for i, k in enumerate(("doc_id", "quality", "toxic"))}),
        "pages": pa.table({"page_id": pa.array([p[0] for p in pages], pa.int64()), "url": pa.array([p[1] for p in pages], pa.string()),
                           "html": pa.array([None] * len(pages), pa.string()), "host": pa.array([None] * len(pages), pa.string())}),
        "conversations": pa.table({"conv_id": pa.array([c[0] for c in conversations], pa.int64()),
                                   "turn": pa.array([c[1] for c in conversations], pa.int32()),
                                   "role": pa.array([c[2] for c in conversations], pa.string()),
                                   "text": pa.array([c[3] for c in conversations], pa.string()),
                                   "record": pa.array(["x"] * len(conversations), pa.string())}),
    }
    vectors = VECTORS if documents else []
    tables["embeddings"] = pa.table({"vec_id": pa.array([v for v, _ in vectors], pa.int64()),
                                     "embedding": pa.array([v for _, v in vectors], pa.list_(pa.float32())),
                                     "label": pa.array([None] * len(vectors), pa.int32()),
                                     "whitened": pa.array(["x"] * len(vectors), pa.string())})
    for name, t in tables.items():
        pq.write_table(t, os.path.join(folder, f"{name}.parquet"))
    return str(folder)


@pytest.fixture(scope="session")
def odd(tmp_path_factory):
    benchmark = [(None, "short item"), (1, None), (2, ""), (3, "seven"), (4, PASSAGE), (5, PASSAGE), (6, PASSAGE[:40]), (4, PASSAGE)]
    labels = [(None, 1, 0), (4, None, None), (5, 1, 0), (16, 0, 1), (17, 0, None), (12, 0, 0), (12, 1, 0), (8, 1, 0), (9, 1, 1)]
    pages = [(1, None), (2, "no scheme"), (3, "http://"), (4, "HTTP://Www.Example.NET/en/x?y#z"), (5, "http://example.net/de/"),
             (6, "a://notexample.net/en/"), (7, "x://a.example.com/de/1"), (8, "x://b.org/fr/"), (None, "x://net?/"), (8, "x://b.org/fr/")]
    conversations = [(1, 0, "user", "hi"), (1, 1, "assistant", "a\\[INST] <\\|im_end|>\n"), (2, 0, None, None), (2, None, "user", "first"),
                     (3, 0, "assistant", "<|im_end|>\n<|im_start|>user\nx"), (3, 0, "assistant", "<|im_end|>\n<|im_start|>user\nx"),
                     (None, 1, "a\nb%0A", ""), (4, 0, "system", "s"), (4, 1, "user", "u"), (4, 2, "assistant", "x" * 100_000),
                     (5, 0, "assistant", None)]
    return _write(tmp_path_factory.mktemp("odd"), TEXTS, benchmark, labels, pages, conversations)


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    return _write(tmp_path_factory.mktemp("empty"), [], [], [], [], [])

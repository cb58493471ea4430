"""Operators across documents against brute force."""

import collections
import json
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgermart.llm import chat_format as chat
from ledgermart.llm import decontaminate, license_scan, line_quality, ngram_join, substring_dedup, url_rules
from ledgermart.llm import words as W
from ledgermart.llm.catalog import QUERIES

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]


def shingles(text, n):
    w = spaced(text)
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(rows, n, percent):
    """{doc_id: least id} by comparing all sets."""
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[shingles(t, n)].append(i)
    sets = [s for s in groups if s]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                parent[find(a)] = find(b)
    out, least = {}, {}
    for k, s in enumerate(sets):
        least[find(k)] = min([least.get(find(k), 1 << 60), *groups[s]])
    for k, s in enumerate(sets):
        out.update({i: least[find(k)] for i in groups[s]})
    out.update({i: i for i in groups.get(frozenset(), [])})
    return out


def near_copies(seed, originals=12, copies=12):
    """Originals of unlike lengths, copies with more and more changed words."""
    rng, rows = random.Random(seed), []
    shared = [f"q{k}" for k in range(40)]
    for o in range(originals):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([1, 3, 4, 6, 8, 12, 20, 40, 90, 200]))]
        if o % 3 == 0:
            base = shared + base
        for c in range(copies):
            words = list(base)
            for _ in range(rng.randrange(0, 1 + len(words) // 12 + c // 3)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10_000)}"
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80)])
def test_ngram_join_equals_brute_force(spark, n, percent):
    rows = near_copies(n)
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), shingle=n, percent=percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(rows, n, percent)
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(shingles(t, n)) for i, t in rows}


def test_ngram_join_with_crowded_signatures(spark, monkeypatch):
    """Small limits force the crowd rule, several centres and the last comparison."""
    monkeypatch.setattr(ngram_join, "CROWD", 3)
    monkeypatch.setattr(ngram_join, "CENTRES", 1)
    rows = near_copies(9, originals=5, copies=40)
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4, percent=85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(rows, 4, 85)


@pytest.mark.parametrize("percent", [80, 85])
def test_rest_pairs_loses_no_similar_pair(spark, percent):
    """Sets around a centre, many of them copies of one another's changes."""
    rng = random.Random(percent)
    centre = set(range(1, 121))
    sets = {1: centre}
    for k in range(2, 120):
        base = set(sets[rng.choice(list(sets))]) if rng.random() < 0.7 else set(centre)
        base -= set(rng.sample(sorted(base), rng.randrange(0, 14)))
        sets[k] = base | {rng.randrange(1000, 10**9) for _ in range(rng.randrange(0, 14))}

    def similar(x, y):
        return 100 * len(x & y) >= percent * len(x | y)
    label = {k: 1 if similar(s, centre) else k for k, s in sets.items()}
    elements = spark.createDataFrame([(k, np.array(sorted(s), dtype=np.uint64).tobytes()) for k, s in sets.items()],
                                     "node long, elements binary")
    left = spark.createDataFrame([(5, k, label[k]) for k in sets if k != 1], "signature long, node long, label long")
    homes = spark.createDataFrame([(5, 1)], "signature long, centre long")
    pairs = ngram_join.rest_pairs(left, homes, elements, percent)
    got = {(r["a"], r["b"]) for r in ngram_join.similar_pairs(pairs, elements, percent).collect()}
    want = {(a, b) for a in sets for b in sets if a > b > 1 and label[a] != label[b] and similar(sets[a], sets[b])}
    assert want and got == want


def test_ngram_join_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = QUERIES["op5_ngram_join"](spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(rows, 4, 85)


def test_ngram_join_null_ids(spark):
    d = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (None, "z y"), (3, None), (3, None)], "doc_id long, text string")
    got = sorted((repr(r["doc_id"]), repr(r["component_id"])) for r in ngram_join.ngram_join(d).collect())
    assert got == sorted([("None", "5"), ("5", "5"), ("None", "None"), ("3", "3"), ("3", "3")])


@pytest.mark.parametrize("percent", [80, 85])
def test_similar_sets_share_a_signature(percent):
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        k = int(rng.integers(0, max(1, n * (100 - percent) // 100) + 1))
        b = np.concatenate([a[k // 2:], rng.integers(0, 2**63, k - k // 2, dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        common = len(np.intersect1d(a, b))
        if len(b) == 0 or 100 * common < percent * (len(a) + len(b) - common) or (len(a) == len(b) == common):
            continue
        at, place, sig = ngram_join.signatures(np.array([len(a), len(b)]), np.concatenate([a, b]), percent)
        mine, theirs = ({(p, s) for p, s, x in zip(place.tolist(), sig.tolist(), at) if x == i} for i in (0, 1))
        groups = {p for p, _ in mine & theirs}
        slacks = [ngram_join.plan(p >> 24, percent)[3] for p in groups]
        assert groups and max(collections.Counter(p >> 24 for p in groups).values()) >= 1 + min(slacks)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 150)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 150)}


# --- substring dedup ---

def test_long_repeats_are_caught_and_clean_texts_left(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], spaced(r["text"])) for r in docs.collect()]
    flagged = {r["doc_id"] for r in QUERIES["op10_substring_dedup"](spark, SF).collect()}

    def repeated(n):
        seen, out = {}, set()
        for i, w in rows:
            for k in range(len(w) - n + 1):
                first = seen.setdefault(tuple(w[k:k + n]), i)
                if first != i:
                    out |= {first, i}
        return out
    must = repeated(51)
    assert len(must) > 100 and len(must - flagged) <= 0.01 * len(must)
    assert not flagged - repeated(20)


def test_passages_survive_insertions_and_are_dropped_once(spark):
    rng = random.Random(5)

    def prose(n, seed):
        r = random.Random(seed)
        return [f"{r.choice('abcdefgh')}{r.randrange(9999)}" for _ in range(n)]
    passage = prose(120, 1)
    rows = [(i, " ".join(prose(rng.randrange(5, 60), 100 + i) + passage + prose(20, 500 + i))) for i in range(5)]
    rows += [(9, " ".join(prose(300, 77))), (10, None), (11, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    p = substring_dedup.repeated_passages(d)
    assert {r["doc_id"] for r in p.collect()} == set(range(5))
    assert [r["doc_id"] for r in p.filter("owned").collect()] == [0]
    left = {r["doc_id"]: r["text"] for r in substring_dedup.drop_passages(d, p).collect()}
    middle = " ".join(passage[40:80])
    assert [middle in left[i] for i in range(5)] == [True, False, False, False, False]
    assert left[9] == rows[5][1] and left[10] == "" and left[11] == ""


def _prose(n, seed):
    r = random.Random(seed)
    return [f"{r.choice('abcdefgh')}{r.randrange(9999)}" for _ in range(n)]


def test_near_copies_with_other_edits_keep_every_part_once(spark):
    text = _prose(300, 1)
    edited = text[:100] + _prose(60, 2) + text[160:]
    other = text[:230] + _prose(30, 3) + text[260:]
    rows = [(1, " ".join(edited)), (5, " ".join(text)), (7, " ".join(text)), (8, " ".join(other))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    p = substring_dedup.repeated_passages(d)
    left = [(r["doc_id"], spaced(r["text"])) for r in substring_dedup.drop_passages(d, p).collect()]
    middle = text[110:150]
    holds = {i for i, w in left if " ".join(middle) in " ".join(w)}
    assert holds == {5} and not dict(left)[7]  # the edit of 1 stands in 5 alone; 7 has nothing of its own
    assert dict(left)[1] == edited and _prose(30, 3)[10:20] == [w for w in dict(left)[8] if w in _prose(30, 3)[10:20]]
    report = {r["doc_id"]: r for r in substring_dedup.passage_report(d).collect()}
    assert report[7]["removed_words"] == 300 and 0 < report[5]["removed_words"] < 300 and report[1]["removed_words"] == 0
    assert report[5]["owners"] == [1, 5]


def test_passages_of_two_owners_in_one_run(spark):
    text = _prose(160, 11)
    rows = [(1, " ".join(_prose(40, 13) + text[:100])), (5, " ".join(text)), (7, " ".join(text[60:] + _prose(40, 14)))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r["doc_id"]: r["text"] for r in substring_dedup.drop_passages(d, substring_dedup.repeated_passages(d)).collect()}
    late, early = " ".join(text[115:145]), " ".join(text[15:85])
    assert late in left[5] and late not in left[7]
    assert early in left[1] and early not in left[5]


def test_unlike_texts_of_one_id_are_documents_of_their_own(spark):
    one, two, three = _prose(70, 21), _prose(70, 22), _prose(70, 23)
    clean = _prose(90, 24)
    rows = [(None, " ".join(_prose(30, 25) + one)), (None, " ".join(_prose(50, 26) + one)),  # only among rows without an id
            (3, " ".join(two + clean)), (3, " ".join(_prose(45, 27) + two)), (3, " ".join(_prose(4, 28))),  # only within one id
            (1, " ".join(_prose(20, 29) + three)), (8, " ".join(three + _prose(140, 30))), (8, " ".join(_prose(200, 31)))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    p = substring_dedup.repeated_passages(d)
    left = [(r["doc_id"], r["text"]) for r in substring_dedup.drop_passages(d, p).collect()]
    assert len(left) == len(rows)
    for passage in (one, two, three):
        assert sum(" ".join(passage[12:58]) in t for _, t in left) == 1
    for words in (clean, _prose(30, 25), _prose(50, 26), _prose(45, 27), _prose(4, 28), _prose(140, 30)):
        assert sum(" ".join(words[8:-8] or words) in t for _, t in left) == 1
    assert (8, rows[-1][1]) in left
    report = substring_dedup.passage_report(d).collect()
    assert sorted((r["doc_id"] or 0, r["removed_words"] > 0) for r in report) == [
        (0, False), (0, True), (1, False), (3, False), (3, True), (8, True)]


def test_gear_equals_the_rolling_loop():
    data = np.frombuffer(b"some bytes that roll along, and on" * 3, dtype=np.uint8)
    place = np.arange(len(data))
    got = substring_dedup.gear(data, place)
    for i in range(len(data)):
        h = 0
        for b in data[max(0, i - substring_dedup.GEAR_BYTES + 1):i + 1]:
            h = (h * 2 + int(substring_dedup._GEAR[b])) % 2**64
        assert h == int(got[i])


# --- shared word hashing ---

def test_words_equal_the_patterns():
    import pyarrow as pa
    texts = ["", None, "Ab cD", "x\u00e9-Y 12\t\u0085z", "a\nb\x0bc", "\U0001F600 k", "tail "]
    for letters, pattern in ((True, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (False, r"[^\x20\x09-\x0D]+")):
        for limit in (1, 10, 10**6):
            got, hashes = [], {}
            for w in W.words(pa.array(texts), letters, limit):
                for i in range(len(w.first) - 1):
                    a, b = w.first[i], w.first[i + 1]
                    got.append(w.string(a, b).split(" ") if b > a else [])
                    for k in range(a, b):
                        hashes.setdefault(w.string(k, k + 1), set()).add(int(w.hash[k]))
            assert got == [re.findall(pattern, (t or "").translate(LOWER)) for t in texts]
            assert all(len(h) == 1 for h in hashes.values()) and len({min(h) for h in hashes.values()}) == len(hashes)


# --- decontamination ---

def test_winnowing_misses_no_window(spark):
    rng = random.Random(2)
    vocab = [f"v{i}" for i in range(12)]  # few words: many ties and repeats
    items = [(i, " ".join(rng.choices(vocab, k=rng.randrange(1, 25)))) for i in range(15)]
    docs = [(i, " ".join(rng.choices(vocab, k=300)) + " " + items[i % 15][1]) for i in range(30)]
    got = decontaminate.contamination_report(spark.createDataFrame(docs, "doc_id long, text string"),
                                             spark.createDataFrame(items, "item_id long, text string")).collect()
    windows = collections.defaultdict(set)
    for i, t in items:
        w = t.split()
        n = min(10, len(w))
        for k in range(len(w) - n + 1):
            windows[tuple(w[k:k + n])].add(str(i))
    for r in got:
        w, hit, ids = docs[r["doc_id"]][1].split(), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit |= set(range(k, k + n))
                    ids |= windows[tuple(w[k:k + n])]
        assert (r["n_words"], r["n_hit"], r["item_ids"]) == (len(w), len(hit), sorted(ids))
        assert {k for s in r["spans"] for k in range(s["start"], s["end"])} == hit


# --- URL rules ---

def test_planted_rules_are_mined_and_matched(spark):
    rng = random.Random(4)
    pages, labels = [], []
    for i in range(1500):
        bad = i % 5 == 0
        host = "buy-pills.test" if bad else rng.choice(["a.test", "b.test", "pills.test"])
        pages.append((i, f"http://{host}/x{rng.randrange(99)}/{rng.choice('pqr')}?id={i}"))
        if i % 2:
            labels.append((i, 0 if bad else 1, 0))
    p = spark.createDataFrame(pages, "page_id long, url string")
    out = url_rules.judge_urls(p, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rules=[]).collect()
    assert {r["page_id"] for r in out if r["verdict"] == "block"} == {i for i in range(0, 1500, 5)}


def test_matches_equal_brute_force(spark):
    rng = random.Random(8)
    urls = [(i, rng.sample("abcdefgh", rng.randrange(0, 7))) for i in range(200)]
    rules = [(k, t, t[0]) for k, t in enumerate([["a"], ["b", "c"], ["c", "d", "e"], ["h", "a"]])]
    got = url_rules.matches(spark.createDataFrame(urls, "url_key long, tokens array<string>"),
                            spark.createDataFrame(rules, "rule long, tokens array<string>, key string")).collect()
    assert sorted((r["url_key"], r["rule"]) for r in got) == [(i, k) for i, t in urls for k, s, _ in rules if set(s) <= set(t)]


def test_hand_rules_on_odd_urls(spark, odd):
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in QUERIES["op2_url_rules"](spark, odd).collect()}
    assert got == {(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"),
                   (4, "www.example.net", "/en/x", "example.net/en/", "allow"), (5, "example.net", "/de/", "net/", "block"),
                   (6, "notexample.net", "/en/", "net/", "block"), (7, "a.example.com", "/de/1", "example.com/de/", "block"),
                   (8, "b.org", "/fr/", "org/fr/", "allow"), (None, "net", "", None, "allow")}


# --- license scan ---

def test_containment_join_equals_brute_force(spark):
    rng = random.Random(6)
    words = license_scan.vocabulary(license_scan.TEMPLATES)
    blocks = [(i, rng.sample(words, rng.randrange(1, 30))) for i in range(300)]
    blocks += [(300 + k, sorted(set(t.split()) | set(rng.sample(words, 3)) - {rng.choice(t.split())})) for k, (_, t) in enumerate(license_scan.TEMPLATES * 3)]
    for threshold in (0.5, 0.7, 0.9, 1.0):
        got = license_scan.contained_templates(spark.createDataFrame(blocks, "uid long, tokens array<string>"), threshold=threshold)
        want = set()
        for uid, b in blocks:
            for label, t in license_scan.TEMPLATES:
                t = set(t.split())
                if len(t & set(b)) >= round(threshold * len(t), 9):
                    want.add((uid, label, round(len(t & set(b)) / len(t), 9)))
        assert {(r["uid"], r["label"], round(r["containment"], 9)) for r in got.collect()} == want


def test_notices_in_windows_equal_brute_force(spark):
    """Notices wrapped over lines at every offset against the segments, with
    lost and inserted words; words scattered over a long line."""
    rng, docs = random.Random(9), []
    longest = max(license_scan.window_words(t, 0.9) for _, t in license_scan.TEMPLATES)
    for i in range(260):
        said = [rng.choice(["the", "and", "is", f"x{rng.randrange(500)}"]) for _ in range(rng.randrange(0, 90))]
        t = rng.choice(license_scan.TEMPLATES)[1].split()
        if i % 3 == 0:
            del t[rng.randrange(len(t))]
        if i % 4 == 0:
            t.insert(rng.randrange(len(t)), "odd")
        at = rng.randrange(len(said) + 1)
        words = said[:at] + t + said[at:]
        docs.append((i, "".join(w.upper() + rng.choice([" ", "\n", ", "]) for w in words)))
    scattered = [w for u in license_scan.TEMPLATES[-1][1].split() for w in [u] + [f"y{k}" for k in range(6)]]
    docs += [(900, " ".join(scattered)), (901, " ".join(f"z{k}" for k in range(longest - 3)) + "\nreleased under\nthe MIT\n\nlicense")]
    got = {r["doc_id"]: r for r in license_scan.license_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, text in docs:
        words, labels, best = [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w], set(got[i]["base_labels"]), 0.0
        for label, t in license_scan.TEMPLATES:
            size, kinds = license_scan.window_words(t, 0.9), set(t.split())
            most = max((len(kinds & set(words[a:a + size])) for a in range(len(words))), default=0) / len(kinds)
            if most >= 0.9 - 1e-9:
                labels.add(label)
                best = max(best, most)
        assert set(got[i]["labels"]) == labels, text
        assert got[i]["score"] == pytest.approx(1.0 if got[i]["n_base"] else best)
    assert got[900]["labels"] == [] and got[901]["labels"] == ["mit"]


# --- chat formatting ---

def test_layouts_become_the_same_turns(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "completion": "a"}, {"data": {"question": "q", "answer": "a"}},
    ]
    d = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "conv_id long, record string")
    got = chat.canonical_turns(d).orderBy("conv_id").collect()
    assert [r["layout"] for r in got] == ["messages", "conversations", "prompt", "question"]
    assert all([tuple(t) for t in r["turns"]] == [("user", "q"), ("assistant", "a")] for r in got)


def test_unknown_and_broken_records_have_no_layout(spark):
    d = spark.createDataFrame([(1, "{\"foo\": 1}"), (2, "not json"), (3, None), (4, "{\"messages\": []}")], "conv_id long, record string")
    got = {r["conv_id"]: (r["layout"], r["formatted"]) for r in chat.chat_format(d).collect()}
    assert got[1] == got[2] == got[3] == (None, None) and got[4] == ("no_messages", "")


def test_nulls_optional_and_further_paths_keep_a_layout(spark):
    cases = [
        ({"prompt": "q", "completion": None}, "prompt", [("user", "q"), ("assistant", "")]),
        ({"messages": [{"role": "user", "content": "a", "name": "n"}, None]}, "messages", [("user", "a")]),
        ({"id": 1, "prompt": "a", "completion": "b", "meta": {"x": [1]}}, "prompt", [("user", "a"), ("assistant", "b")]),
        ({"instruction": "i", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
        ({"system": "s", "instruction": "i", "output": "o"}, "instruction", [("system", "s"), ("user", "i"), ("assistant", "o")]),
        ({"messages": [{"role": "user", "content": None}, {"role": "assistant"}]}, "messages", [("user", ""), ("assistant", "")]),
        ({"data": {"question": "q", "answer": "a", "more": {"y": 1}}}, "question", [("user", "q"), ("assistant", "a")]),
        ({"prompt": 1, "completion": "b"}, None, None), ({"messages": [{"role": "u", "content": 5}]}, None, None),
        ({"messages": [{"role": "u"}]}, None, None), ({"messages": "m"}, None, None), ([1], None, None)]
    d = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _, _) in enumerate(cases)], "conv_id long, record string")
    for r in chat.canonical_turns(d).collect():
        record, layout, turns = cases[r["conv_id"]]
        assert (r["layout"], r["turns"] if r["turns"] is None else [tuple(t) for t in r["turns"]]) == (layout, turns), record


def test_one_conversation_of_many_turns(spark):
    """In proportion to its turns: a hundred thousand take seconds."""
    n = 100_000
    i = F.col("id")
    rows = spark.range(n).select(F.lit(1).alias("conv_id"), i.cast("int").alias("turn"), F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"),
                                 F.concat(F.lit("[INST] <|im_end|>\n"), i.cast("string")).alias("text"))
    out = chat.chat_format(chat.records_of(rows))
    start = time.time()
    got = out.select(F.size(chat.read_turns(F.col("formatted"))).alias("n"), chat.read_loss(F.col("formatted"), F.col("mask")).alias("loss")).first()
    assert time.time() - start < 120
    assert got["n"] == n and got["loss"] == "".join(f"[INST] <|im_end|>\n{k}" for k in range(1, n, 2))


def test_escapes_round_trip(spark):
    rng = random.Random(1)
    parts = ["<", "[", "\\", "|im_end|>", "\n", "s>", "/s>", "INST]", "/INST]", "<SYS>>", "x", "|a|>"]
    texts = [("".join(rng.choices(parts, k=8)),) for _ in range(3000)]
    d = spark.createDataFrame(texts, "t string").withColumn("e", chat.escape(F.col("t"))).withColumn("u", chat.unescape(F.col("e")))
    rows = d.collect()
    assert all(r["u"] == r["t"] for r in rows)
    assert not any(re.search(r"<\|im_(start|end)\|>|</?s>|\[/?INST\]", r["e"]) for r in rows)


# --- line frequency ---

def test_boilerplate_is_removed_and_depleted_documents_rejected(spark):
    prose = " ".join(f"w{i}" for i in range(60))
    menu = " ".join(f"menu{i}" for i in range(60))
    rows = [(i, f"{menu}\n{prose} d{i}", "h") for i in range(60)] + [(100 + i, f"{menu}\nbye d{i}", "h") for i in range(30)]
    rows += [(200, f"{menu}\n{prose}", "elsewhere"), (201, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in line_quality.line_quality(d).collect()}
    assert all(got[i]["kept"] and got[i]["n_removed_lines"] == 1 for i in range(60))
    assert not any(got[100 + i]["kept"] or got[100 + i]["base_failed"] for i in range(30))
    assert got[200]["kept"] and got[200]["n_removed_lines"] == 0 and not got[201]["kept"]
    text = spark.createDataFrame([(rows[0][1], got[0]["removed_lines"])], "t string, r array<long>").select(
        line_quality.remove_lines(F.col("t"), F.col("r")).alias("x")).first()["x"]
    assert text == f"{prose} d0"


def test_boilerplate_of_large_and_small_hosts(spark):
    """Two percent of a large host, and fifteen percent of a small one."""
    def prose(i):
        return " ".join(f"w{i}x{k}" for k in range(55))
    rows = [(i, prose(i) + ("\nShare this page" if i % 50 == 0 else ""), "large") for i in range(2000)]
    rows += [(5000 + i, prose(5000 + i) + ("\nRead more" if i < 6 else "\nTwo only" if i < 8 else ""), "small") for i in range(40)]
    got = {r["doc_id"]: r for r in line_quality.line_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i]["n_removed_lines"] == (i % 50 == 0) for i in range(2000))
    assert all(got[5000 + i]["n_removed_lines"] == (i < 6) for i in range(40))
    assert all(r["kept"] for r in got.values())

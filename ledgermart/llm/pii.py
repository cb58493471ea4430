"""Personal data by a semi-Markov conditional random field (operator 6).

Base spans come from fixed patterns and always stay.  Beside them a
semi-Markov CRF segments the surroundings of digits and @ signs: text is
cut into atoms (runs of letters or digits, single marks), a segment is a
run of up to ``MAX_ATOMS`` atoms with one kind, and its score is a sum of
weights of features of the whole span (its shape, digits, check sums, the
words before it).  Dynamic programming over segment ends picks boundaries
and kinds at once; a segment is added if its posterior is high and it does
not touch a base span.  An entity must hold a digit or an @, so text
without them needs no work.

The weights are learned here by conditional likelihood from a bounded
sample of ``SAMPLE`` regions; their labels come from the base patterns and
from assignments to names of secrets, so no table of labels is needed.

Spans are found in one scan of whole texts; nothing is shuffled but the few
lines that tasks offer for the sample.

Defined cases: null text is empty and has no spans; null ids are kept; ties
of segmentations go to the earlier and shorter segment; repeated rows each
get a row; an empty table gives an empty result; other columns are ignored,
so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermart.llm.common import col, map_in_arrow, text_of
from ledgermart.session import materialize

#: Kinds in the order in which spans are listed; the method adds the last one.
BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "secret"]

MAX_ATOMS = 14
SAMPLE, SAMPLE_ATOMS = 400, 60
GAP, MARGIN, WORD = 40, 24, 200
MIN_POSTERIOR = 0.6

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base patterns, kind by kind, leftmost first.  Every pattern is
    read in time linear in the text: an address is read outwards from its @
    (no local part holds one), numbers start where a run of digits starts."""
    found = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append(("email", start, domain.end()))
            done = domain.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = digits_of(m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(digits_of(m.group())) <= 15:
                found.append(("phone", *m.span()))
    return found


# --- atoms and regions -------------------------------------------------------

_ATOM = re.compile(r"[A-Za-z]*[0-9][A-Za-z0-9]*|[^\W\d_]+|[^\w\s]|_|\d+")
_TRIGGER = re.compile(r"[0-9@]")
_SECRET_NAME = re.compile(r"(?:token|secret|api[_-]?key|passw(?:or)?d|key)\W{1,4}\Z", re.I)


def regions(text: str) -> Iterator[list[tuple[int, int]]]:
    """The atoms around triggers of one line: triggers up to ``GAP``
    characters apart share a region, which is widened by ``MARGIN``
    characters and then to whole words (of up to ``WORD`` characters)."""
    begin = 0
    if not _TRIGGER.search(text):
        return
    for line in text.split("\n"):
        hits = [m.start() for m in _TRIGGER.finditer(line)]
        first = 0
        for k, hit in enumerate(hits):
            if k + 1 < len(hits) and hits[k + 1] - hit <= GAP:
                continue
            low, high = max(0, hits[first] - MARGIN), min(len(line), hit + MARGIN)
            low = max(line.rfind(" ", 0, low) + 1, hits[first] - WORD, 0)
            blank = line.find(" ", high)
            high = min(len(line) if blank < 0 else blank, hit + WORD)
            yield [(m.start() + begin, m.end() + begin) for m in _ATOM.finditer(line, low, high)]
            first = k + 1
        begin += len(line) + 1


def shape(piece: str) -> str:
    """Letters as a, digits as 9, runs shortened to their length class."""
    out = []
    for m in re.finditer(r"([0-9]+)|([A-Za-z]+)|([^\W\d_]+)|(\s+)|(.)", piece, re.S):
        n = len(m.group())
        if m.group(1):
            out.append("9" * min(n, 4) + ("+" if n > 4 else ""))
        elif m.group(2) or m.group(3):
            out.append("a")
        elif m.group(4):
            out.append(" ")
        else:
            out.append(m.group())
    return "".join(out)


@lru_cache(maxsize=50_000)
def _own_features(piece: str) -> tuple[str, ...]:
    digits = digits_of(piece)
    out = [f"n{min(len(digits), 20)}", f"shape:{shape(piece)[:40]}", f"first:{shape(piece[0])}", f"last:{shape(piece[-1])}"]
    if "@" in piece:
        out.append("at")
        if re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", piece):
            out.append("address")
    if re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", piece):
        out.append("quad" if max(map(int, piece.split("."))) <= 255 else "bigquad")
    if 13 <= len(digits) <= 19 and re.fullmatch(r"[0-9 -]+", piece):
        out.append("luhn" if luhn(digits) else "noluhn")
    if piece[0] == "+":
        out.append("plus")
    if re.fullmatch(r"[A-Za-z0-9]{16,}", piece):
        kinds = len(set(piece))
        out.append("mixed" if digits and len(digits) < len(piece) else "one")
        out.append("rich" if kinds >= 8 else "poor")
        out.append(f"len{min(len(piece) // 8, 8)}")
    if re.search(r"\s", piece):
        out.append("blank")
    return tuple(out)


def features(text: str, start: int, end: int) -> tuple[str, ...]:
    """Features of a whole span."""
    out = _own_features(text[start:end])
    before = text[max(0, start - 16):start]
    if _SECRET_NAME.search(before):
        out += ("named",)
    left, right = text[start - 1:start], text[end:end + 1]
    if left and (left.isalnum() or left in "._%+-@"):
        out += ("leftmore",)
    if right and (right.isalnum() or right == "@"):
        out += ("rightmore",)
    return out


def segments(text: str, atoms: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Candidate entities as atom ranges: they hold a digit or @, begin with
    a letter, digit or +, end with a letter or digit."""
    n = len(atoms)
    for i in range(n):
        c = text[atoms[i][0]]
        if not (c.isalnum() or c == "+"):
            continue
        some = False
        for j in range(i, min(n, i + MAX_ATOMS)):
            if j > i and atoms[j][0] - atoms[j - 1][1] > 1:
                break
            piece = text[atoms[j][0]:atoms[j][1]]
            some = some or bool(_TRIGGER.search(piece))
            if some and piece[-1].isalnum() and not (j > i and _plain_words(text, atoms, i, j)):
                yield i, j + 1


def _plain_words(text: str, atoms, i: int, j: int) -> bool:
    """A blank between two words of letters only inside the span: no entity has it."""
    return any(atoms[k][0] > atoms[k - 1][1] and text[atoms[k][0]].isalpha() for k in range(i + 1, j + 1))


class Model:
    """Weights by (kind, feature); scores, best segmentation, posteriors."""

    def __init__(self, weights: dict[tuple[int, str], float] | None = None, outside: float = 0.0):
        self.weights, self.outside = weights or {}, outside
        self.bias = [weights.get((k, "bias"), 0.0) if weights else 0.0 for k in range(len(KINDS))]

    def score(self, feats: tuple[str, ...], kind: int) -> float:
        get = self.weights.get
        return get((kind, "bias"), 0.0) + sum(get((kind, f), 0.0) for f in feats)

    def lattice(self, text: str, atoms) -> list[tuple[int, int, int, tuple[str, ...], float]]:
        """Edges (from, to, kind or -1, features, score), sorted by end."""
        edges = [(i, i + 1, -1, (), self.outside) for i in range(len(atoms))]
        for i, j in segments(text, atoms):
            feats = features(text, atoms[i][0], atoms[j - 1][1])
            edges += [(i, j, k, feats, self.score(feats, k)) for k in range(len(KINDS))]
        return sorted(edges, key=lambda e: (e[1], e[0], e[2]))

    @staticmethod
    def marginals(edges, n: int) -> tuple[np.ndarray, float]:
        fore, back = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
        fore[0] = back[n] = 0.0
        for i, j, _, _, s in edges:
            fore[j] = _logadd(fore[j], fore[i] + s)
        for i, j, _, _, s in sorted(edges, key=lambda e: -e[0]):
            back[i] = _logadd(back[i], back[j] + s)
        total = fore[n]
        return np.array([math.exp(min(0.0, fore[i] + s + back[j] - total)) for i, j, _, _, s in edges]), total

    def spans(self, text: str, atoms) -> list[tuple[str, int, int]]:
        """The best segmentation's entities whose posterior is high."""
        edges, n = self.lattice(text, atoms), len(atoms)
        if len(edges) == n:
            return []
        best, via = [0.0] + [-math.inf] * n, [None] * (n + 1)
        for k, (i, j, _, _, s) in enumerate(edges):
            if best[i] + s > best[j]:
                best[j], via[j] = best[i] + s, k
        chosen, at = [], n
        while at:
            chosen.append(via[at])
            at = edges[via[at]][0]
        chosen = [k for k in reversed(chosen) if edges[k][2] >= 0]
        if not chosen:
            return []
        sure, _ = self.marginals(edges, n)
        return [(KINDS[edges[k][2]], atoms[edges[k][0]][0], atoms[edges[k][1] - 1][1])
                for k in chosen if sure[k] >= MIN_POSTERIOR]


def _logadd(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def silver(text: str) -> list[tuple[str, int, int]]:
    """Labels for training: base spans, and values given to names of secrets."""
    out = base_spans(text)
    for m in re.finditer(r"[A-Za-z0-9]{16,}", text):
        if _SECRET_NAME.search(text[max(0, m.start() - 16):m.start()]) and re.search(r"[0-9]", m.group()):
            out.append(("secret", *m.span()))
    return out


def train(texts: list[str], rounds: int = 60, rate: float = 0.3, penalty: float = 0.01) -> Model:
    """Conditional likelihood over the sample by adaptive gradient steps."""
    plan = []
    blank = Model()
    for text in texts:
        gold = {(a, b): k for k, a, b in silver(text)}
        for atoms in regions(text):
            if len(atoms) > SAMPLE_ATOMS:
                continue
            edges = blank.lattice(text, atoms)
            taken = np.zeros(len(edges))
            covered = np.zeros(len(atoms), dtype=bool)
            for e, (i, j, k, _, _) in enumerate(edges):
                if k >= 0 and gold.get((atoms[i][0], atoms[j - 1][1])) == KINDS[k] and not covered[i:j].any():
                    taken[e] = 1
                    covered[i:j] = True
            for e, (i, _, k, _, _) in enumerate(edges):
                if k < 0 and not covered[i]:
                    taken[e] = 1
            plan.append((edges, taken, len(atoms)))
    names: dict[tuple[int, str], int] = {}
    for edges, _, _ in plan:
        for _, _, k, feats, _ in edges:
            if k >= 0:
                for f in ("bias", *feats):
                    names.setdefault((k, f), len(names) + 1)
    size = len(names) + 1  # weight 0 is the outside weight
    slots = [[[0] if k < 0 else [names[k, f] for f in ("bias", *feats)] for _, _, k, feats, _ in edges]
             for edges, _, _ in plan]
    w, seen = np.zeros(size), np.full(size, 1e-6)
    for _ in range(rounds if plan else 0):
        slope = -penalty * w
        for (edges, taken, n), own in zip(plan, slots):
            scored = [(*e[:4], float(w[s].sum())) for e, s in zip(edges, own)]
            sure, _ = Model.marginals(scored, n)
            for s, d in zip(own, taken - sure):
                if abs(d) > 1e-9:
                    slope[s] += d
        seen += slope * slope
        w += rate * slope / np.sqrt(seen)
    return Model({key: float(w[i]) for key, i in names.items()}, float(w[0]))


def find_spans(text: str, model: Model) -> list[tuple[str, int, int, bool]]:
    """All spans: base ones, and the model's that touch none of them; by
    kind as listed, then start."""
    base = base_spans(text)
    ranges = sorted((a, b) for _, a, b in base)
    added = []
    for atoms in regions(text):
        for kind, a, b in model.spans(text, atoms):
            if not any(x < b and a < y for x, y in ranges):
                added.append((kind, a, b, False))
                ranges.append((a, b))
    out = [(*s, True) for s in base] + added
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


@lru_cache(maxsize=4096)
def stratum(line: str) -> str:
    """The last kind of which the line has a silver span."""
    return max((k for k, _, _ in silver(line)), key=KINDS.index, default="none")


def _least_lines(sample: int):
    """The ``sample`` distinct lines of least hash of every stratum of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, dict[int, str]] = {k: {} for k in [*KINDS, "none"]}
        edge = {k: 2 ** 63 for k in best}
        for batch in batches:
            for h, line in zip(batch.column("h").to_pylist(), batch.column("line").to_pylist()):
                k = stratum(line)
                if h < edge[k]:
                    best[k][h] = line
                    if len(best[k]) >= 2 * sample:
                        best[k] = dict(sorted(best[k].items())[:sample])
                        edge[k] = max(best[k])
        rows = [(k, h, line) for k in best for h, line in sorted(best[k].items())[:sample]]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(
            (pa.string(), pa.int64(), pa.string()))], ["kind", "h", "line"])
    return run


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, sample: int = SAMPLE) -> Model:
    """Train on ``sample`` distinct lines with a trigger (of up to 2,000
    characters): of every stratum an equal share of half the sample, those of
    least hash, or all it has; then the least hashes of the rest.  A task
    sends no more than the sample of each stratum, so nothing is thinned."""
    lines = docs.select(F.explode(F.split(text_of(text_col), "\n")).alias("line")).filter(
        F.col("line").rlike("[0-9@]") & (F.length("line") <= 2000)).select(F.xxhash64("line").alias("h"), "line")
    least = materialize(map_in_arrow(lines, _least_lines(sample), "kind string, h long, line string"), "pii-lines")
    by_kind = {k: [(r["h"], r["line"]) for r in least.filter(F.col("kind") == k).select("h", "line").distinct()
                   .orderBy("h", "line").limit(sample).collect()] for k in [*KINDS, "none"]}
    share = max(1, sample // (2 * len(by_kind)))
    chosen = [x for rows in by_kind.values() for x in rows[:share]]
    rest = sorted(x for rows in by_kind.values() for x in rows[share:])
    return train([line for _, line in sorted([*chosen, *rest[:max(0, sample - len(chosen))]])])


SPANS = "array<struct<kind: string, start: int, end: int, base: boolean>>"


def pii_spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of every row; code points, end exclusive."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    d = docs.select(col(id_col).alias("doc_id"), text_of(text_col).alias("body"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b, "base": base} for k, a, b, base in find_spans(x.as_py(), shared.value)]
                     for x in batch.column("body")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    return map_in_arrow(d, run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def masked(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """The text with every span replaced by its kind; overlapping spans are
    replaced together, by the kind that starts first."""
    out, done = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"<{kind.upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def mask(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in the text replaced; all other columns,
    and null texts, as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [None if x is None else masked(x, find_spans(x, shared.value)) for x in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(said, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return map_in_arrow(docs, run, docs.schema)


def listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in spans)


def digest(spans) -> str:
    return hashlib.sha256(listed(spans).encode()).hexdigest()

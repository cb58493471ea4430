"""BPE encoding and decoding with a streaming transducer (operator 8).

The encoder reads symbols from left to right.  For every prefix it knows
the last token of the prefix's encoding; two tokens may stand side by side
only if no merge crosses their border before both are complete, which the
merge list decides.  A later token reaches back at most ``lookahead``
symbols (the longest token), so tokens on which all prefixes within that
reach agree are final and are emitted; memory stays constant however long
a word or text is.  Texts are read in slices that end before white space.

The decoder is a state machine over ids: token spellings as the tokenizer
file defines them, or bytes to text with an incremental UTF-8 reader that
holds back an unfinished character.

The vocabulary file is a parameter; the driver reads it and broadcasts the
tables (the size of one vocabulary, whatever the corpus).  Words already
seen are kept in a table of bounded size per task.

Defined cases: null text is empty; empty texts have no tokens and decode to
the empty text; null ids are kept; repeated rows each get a row; special
tokens written in a text become their ids; an empty table gives an empty
result; other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

import codecs
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermart.llm.common import col, map_in_arrow, text_of

#: Words kept per generation of a task's table of seen words.
SEEN_WORDS = 200_000
#: Token pairs whose border is remembered per task.
SEEN_PAIRS = 400_000
#: Characters of a slice of a long text, and rows of a returned batch.
SLICE_CHARS, OUT_ROWS = 65_536, 64
#: Words of so many symbols are encoded as a stream and not kept.
STREAM_SYMBOLS = 256


def byte_letters() -> list[str]:
    """The printable letter for every byte, by the rule of byte-level BPE:
    printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Tables:
    """What the merge list says, ready to be broadcast."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        vocab = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: rank, left, right
        for rank, (a, b) in enumerate(merges):
            made = vocab[a + b]
            self.rank[vocab[a], vocab[b]] = rank
            self.parts[made] = (rank, vocab[a], vocab[b])
        self.spelling = {i: s for s, i in vocab.items()} | {i: s for s, i in self.specials.items()}
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        for s, i in vocab.items():
            end = bool(self.suffix) and s.endswith(self.suffix) and s != self.suffix
            body = s[:-len(self.suffix)] if end else s
            if i in self.parts or len(body) == 1:
                if self._alone(i):
                    (self.final if end else self.inner)[body] = i
        if not self.suffix:
            self.final = self.inner
        #: beginnings of tokens: the token itself, or -1
        self.begins = {s[:k]: -1 for s in self.inner for k in range(1, len(s))} | self.inner
        #: symbols that a token can reach back: the sufficient lookahead
        self.lookahead = max(map(len, [*self.inner, *self.final]))

    def _alone(self, token: int) -> bool:
        """Whether the merges make this token when its letters stand alone."""
        stack, leaves = [token], []
        while stack:
            t = stack.pop()
            if t in self.parts:
                stack += [self.parts[t][2], self.parts[t][1]]
            else:
                leaves.append(t)
        return self.merged(leaves) == [token]

    def merged(self, ids: list[int]) -> list[int]:
        """Plain merging, lowest rank first, leftmost on ties."""
        ids = list(ids)
        made = {v[0]: t for t, v in self.parts.items()} if not hasattr(self, "_made") else self._made
        self._made = made
        while len(ids) > 1:
            rank, at = min((self.rank.get(p, len(self.rank)), i) for i, p in enumerate(zip(ids, ids[1:])))
            if rank == len(self.rank):
                break
            ids[at:at + 2] = [made[rank]]
        return ids

    def side_by_side(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border of two complete tokens.

        The pieces at the border are the right ends of ``left`` and the left
        ends of ``right`` at each moment; a crossing merge happens if its
        rank comes before both pieces are taken up by their own tokens (on
        equal ranks the leftmost place goes first)."""
        until_a, a = len(self.rank), left
        rights = []
        until = len(self.rank)
        b = right
        while True:
            rights.append((b, until))
            if b not in self.parts:
                break
            until, b = self.parts[b][0], self.parts[b][1]
        while True:
            for b, until_b in rights:
                rank = self.rank.get((a, b))
                if rank is not None and rank < until_a and rank <= until_b and rank < len(self.rank):
                    return False
            if a not in self.parts:
                return True
            until_a, a = self.parts[a][0], self.parts[a][2]


class Encoder:
    """The transducer of one task."""

    def __init__(self, tables: Tables, seen_words: int = SEEN_WORDS):
        self.t = tables
        self.letters = byte_letters()
        self.to_letters = {b: c for b, c in enumerate(self.letters)}
        self.split = regex.compile(tables.pattern).findall
        ascii_only = tables.pattern.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9")
        # the same pattern over plain ASCII text, where the faster engine does
        self.split_ascii = self.split if r"\p" in ascii_only else re.compile(ascii_only, re.ASCII).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(tables.specials, key=len, reverse=True))) + ")") \
            if tables.specials else None
        self.pairs: dict[int, bool] = {}
        self.seen = _Seen(self._word, seen_words)

    def _fits(self, left: int, right: int) -> bool:
        key = left << 32 | right
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > SEEN_PAIRS:
                self.pairs.clear()
            ok = self.pairs[key] = self.t.side_by_side(left, right)
        return ok

    def _word(self, word: str) -> bytes:
        """A short word at once: the rule of :meth:`stream` without its
        buffer, going forward while some token begins with the letters."""
        plain = word.isascii() and word.isprintable()
        text = word if plain else word.encode().decode("latin-1").translate(self.to_letters)
        t, pairs, fits, n = self.t, self.pairs, self._fits, len(text)
        whole = t.final.get(text)
        if whole is not None:
            return array("I", (whole,)).tobytes()
        begins, last, back = t.begins.get, [None] * (n + 1), [0] * (n + 1)
        for start in range(n):
            before = last[start]
            for end in range(start + 1, n):
                token = begins(text[start:end])
                if token is None:
                    break
                if token >= 0 and last[end] is None and (
                        not start or pairs.get(before << 32 | token) or fits(before, token)):
                    last[end], back[end] = token, start
        for start in range(max(0, n - t.lookahead), n):
            token = t.final.get(text[start:])
            if token is not None and (not start or fits(last[start], token)):
                last[n], back[n] = token, start
                break
        out = []
        while n:
            out.append(last[n])
            n = back[n]
        out.reverse()
        return array("I", out).tobytes()

    def stream(self, symbols: Iterable[str]) -> Iterator[int]:
        """Token ids of one word whose byte letters come in pieces; ids are
        yielded as soon as they are final."""
        t, reach = self.t, self.t.lookahead
        inner, final, fits = t.inner.get, t.final.get, self._fits
        text, last, back = "", [-1], [0]  # of the prefixes since the last final border
        before = None  # the final token before that border

        def extend(upto: int) -> None:
            for end in range(len(last), upto + 1):
                for start in range(max(0, end - reach), end):
                    token = inner(text[start:end])
                    if token is not None:
                        prev = last[start] if start else before
                        if prev is None or fits(prev, token):
                            last.append(token)
                            back.append(start)
                            break

        def path(end: int) -> list[int]:
            out = []
            while end:
                out.append(last[end])
                end = back[end]
            return out[::-1]

        for piece in symbols:
            text += piece
            while len(text) > max(STREAM_SYMBOLS, 4 * reach) and len(text) - 1 >= len(last):
                upto = min(len(text) - 1, len(last) + 4 * reach)
                extend(upto)
                live = set(range(max(0, upto - reach), upto + 1))  # a later token starts at one of these
                while len(live) > 1:  # the border all of them go back to
                    far = max(live)
                    live.discard(far)
                    live.add(back[far])
                border = live.pop()
                if border:
                    done = path(border)
                    yield from done
                    before = done[-1]
                    text = text[border:]
                    last = [-1] + last[border + 1:]
                    back = [0] + [x - border for x in back[border + 1:]]
        n = len(text)
        if not n:
            return
        extend(n - 1)
        for start in range(max(0, n - reach), n):
            token = final(text[start:])
            if token is not None:
                prev = last[start] if start else before
                if prev is None or fits(prev, token):
                    yield from path(start)
                    yield token
                    return

    def pieces(self, text: str) -> Iterator[bytes]:
        """Little-endian ids of a text, slice after slice."""
        if self.special and "<" in text:
            parts = self.special.split(text)
        else:
            parts = [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield array("I", [self.t.specials[part]]).tobytes()
                continue
            for piece in slices(part):
                words = (self.split_ascii if piece.isascii() else self.split)(normal(piece))
                if max(map(len, words), default=0) < STREAM_SYMBOLS:
                    yield b"".join(map(self.seen.__getitem__, words))
                else:
                    for w in words:
                        yield self.seen[w] if len(w) < STREAM_SYMBOLS else self._long(w)

    def _long(self, word: str) -> bytes:
        cut = (word[i:i + STREAM_SYMBOLS] for i in range(0, len(word), STREAM_SYMBOLS))
        return array("I", self.stream(c.encode().decode("latin-1").translate(self.to_letters) for c in cut)).tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(self.pieces(text))


class _Seen(dict):
    """Words and their ids in two generations of bounded size."""

    def __init__(self, make, limit: int):
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        got = self.old.get(word)
        if got is None:
            got = self.make(word)
        self[word] = got
        return got


def normal(text: str) -> str:
    """NFC, then lower case letter by letter (white space is dropped by the pattern)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def slices(text: str, chars: int = SLICE_CHARS) -> Iterator[str]:
    """Slices that end before a blank or a line end, where no word and no
    composed character can cross."""
    at, n, blank = 0, len(text), re.compile(r"[ \n]")
    while n - at > chars:
        cut = blank.search(text, at + chars)
        if not cut:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


class Decoder:
    """Ids to text, id after id; ``finish`` ends the text."""

    def __init__(self, tables: Tables):
        self.t = tables
        self.byte_of = {c: b for b, c in enumerate(byte_letters())}
        self.spelled = [tables.spelling.get(i, "") for i in range(max(tables.spelling) + 1)]

    def spellings(self, pieces: Iterable[bytes]) -> Iterator[str]:
        """Token spellings separated by one blank, as a file without a decoder has it."""
        first = True
        for piece in pieces:
            ids = array("I")
            ids.frombytes(piece)
            if ids:
                yield ("" if first else " ") + " ".join(map(self.spelled.__getitem__, ids))
                first = False

    def text(self, pieces: Iterable[bytes]) -> Iterator[str]:
        """Readable text: bytes through an incremental UTF-8 reader, one blank after a word end."""
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        suffix, specials = self.t.suffix, set(self.t.specials.values())
        for piece in pieces:
            ids = array("I")
            ids.frombytes(piece)
            for i in ids:
                s = self.spelled[i]
                if i in specials:
                    yield reader.decode(b"", True) + s
                    reader.reset()
                    continue
                end = bool(suffix) and s.endswith(suffix)
                body = s[:-len(suffix)] if end else s
                yield reader.decode(bytes(self.byte_of[c] for c in body)) + (" " if end else "")
        yield reader.decode(b"", True)


def bpe(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): ids as little-endian unsigned 32-bit integers,
    and the decoded spelling of these ids."""
    d = docs.select(col(id_col).alias("doc_id"), text_of(text_col).alias("body"))
    tables = d.sparkSession.sparkContext.broadcast(Tables(path))
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(tables.value), Decoder(tables.value)
        for batch in batches:
            for a in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(a, OUT_ROWS)
                ids = [encoder.encode(x.as_py()) for x in part.column("body")]
                said = ["".join(decoder.spellings([x])) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()),
                                                  pa.array(said, pa.string())], ["doc_id", "ids", "decoded"])

    return map_in_arrow(d, run, f"doc_id {kind}, ids binary, decoded string")


def bpe_digests(docs: DataFrame, path: str, **columns) -> DataFrame:
    out = bpe(docs, path, **columns)
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))

"""SentencePiece encoding and decoding, merge-type (BPE) models.

Exact encoding without a merge queue. An Aho-Corasick automaton over the
pieces gives, at each position, the longest piece and its shorter prefixes. The
encoder takes the longest piece, checks that it is compatible with the piece
before it, and else tries the next shorter one or steps back; a bitfield marks
positions from which no encoding exists, so none is tried twice and the work
stays linear. Two adjacent pieces are compatible if merging their characters
anew, by the model's own priorities, gives back exactly the two.

No piece has a space mark after another character, hence no merge crosses
such a place, nor a character that occurs in no piece of several characters:
texts are cut there, and cuts that recur are encoded once, and their ids
decoded once (a cache of bounded bytes, given up at the end of a task's rows).
Which pairs of pieces are compatible is remembered for the worker's next tasks.
Decoding works from the ids alone.

Only the model file is read, with a small parser of its own; no library
encodes or decodes. Models with a normalisation table, unigram models and
user-defined pieces are refused.

Defined results: a null text counts as empty; an empty text has no ids and
decodes to the empty text; texts are encoded whole, whatever their length;
repeated rows give a row each. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
from collections.abc import Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, spread, table

MARK = "▁"  # stands for a space
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Bytes of remembered cuts and number of remembered pairs (about 100 bytes each), of each worker.
CACHE = 64 << 20
PAIRS = 400_000


def _varint(b: bytes, i: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (b[i] & 127) << shift
        shift += 7
        i += 1
        if b[i - 1] < 128:
            return n, i


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol buffer message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        elif kind == 5:
            value, i = struct.unpack("<f", b[i : i + 4])[0], i + 4
        else:
            value, i = b[i : i + 8], i + 8
        yield key >> 3, value


class Cuts(dict):
    """What is known of cuts: cut -> (number of ids, ids joined by commas, text decoded from the ids).

    At most about ``most`` bytes; then it begins anew, and what the generation
    before still has moves on as it recurs.
    """

    def __init__(self, codec: Codec, most: int):
        super().__init__()
        self.codec, self.most, self.spent = codec, most, 0
        self.old: dict[str, tuple[int, str, str]] = {}

    def __missing__(self, cut: str) -> tuple[int, str, str]:
        got = self.old.get(cut)
        if got is None:
            ids = self.codec.ids_of_cut(cut)
            got = (len(ids), ",".join([self.codec.digits[i] for i in ids]), self.codec.plain(ids))
        if len(cut) <= 40:
            cost = 400 + 4 * len(cut) + len(got[1])  # a slot, a tuple and three strings
            if self.spent + cost > self.most // 2:
                self.old, self.spent = dict(self), 0
                self.clear()
            self.spent += cost
            self[cut] = got
        return got

    def forget(self) -> None:
        self.clear()
        self.old, self.spent = {}, 0


class Codec:
    """An encoder and decoder for one model file; ``cache`` bounds the bytes of remembered cuts."""

    def __init__(self, model: bytes, cache: int = CACHE):
        self.pieces: list[tuple[str, float, int]] = []
        settings: dict[int, dict[int, object]] = {}
        for number, value in _fields(model):
            if number == 1:
                p = dict(_fields(value))
                self.pieces.append((p.get(1, b"").decode(), p.get(2, 0.0), p.get(3, NORMAL)))
            elif number in (2, 3):
                settings[number] = dict(_fields(value))
        trainer, normal = settings.get(2, {}), settings.get(3, {})
        if trainer.get(3, 1) != 2 or normal.get(2) or any(k in (USER, UNUSED) for _, _, k in self.pieces):
            raise ValueError("not a plain merge-type model without normalisation")
        self.prefix, self.trim = bool(normal.get(3, 1)), bool(normal.get(4, 1))
        self.id = {p: i for i, (p, _, k) in enumerate(self.pieces) if k == NORMAL}
        self.rank = {p: -self.pieces[i][1] for p, i in self.id.items()}
        self.byte = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(self.pieces) if k == BYTE}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        self.unknown_surface = trainer.get(44, " ⁇ ".encode()).decode()
        joined = {c for p in self.id if len(p) > 1 for c in p}
        inner = "".join(re.escape(c) for c in "\n\t\r\x0b\x0c" if c not in joined)
        if any(a != MARK and b == MARK for p in self.id for a, b in zip(p, p[1:], strict=False)):
            self.cut = re.compile(r"(?s).+")
        else:
            self.cut = re.compile(f"{MARK}*[^{MARK}{inner}]+|{MARK}+" + (f"|[{inner}]" if inner else ""))
        self.cuts, self.pairs = Cuts(self, cache), {}
        self.machine = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.machine.add_word(p, i)
        self.machine.make_automaton()
        self.length = [len(p) for p, _, _ in self.pieces]
        self.digits = [str(i) for i in range(len(self.pieces))]
        shown = {CONTROL: lambda p: "", UNKNOWN: lambda p: self.unknown_surface, BYTE: lambda p: None}
        self.surface = [shown.get(k, lambda p: p.replace(MARK, " "))(p) for p, _, k in self.pieces]
        self.lead = [n - 1 for n in self.length]  # from a piece's last character back to its first

    @cached_property
    def shorter(self) -> list[int]:
        """By piece id, the longest piece that is a proper prefix of the piece, or -1."""
        out = [-1] * len(self.pieces)
        for p, i in self.id.items():
            q = p[:-1]
            while q and q not in self.id:
                q = q[:-1]
            if q:
                out[i] = self.id[q]
        return out

    def merged(self, text: str, edge: int = -1) -> list[str]:
        """The pieces of a short string by merging anew: best rank first, leftmost first.

        With an ``edge``, a merge over this place ends it: nothing comes back.
        """
        get, none = self.rank.get, math.inf
        parts = list(text)
        ranks = [get(x + y, none) for x, y in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            if edge >= 0 and sum(map(len, parts[: at + 1])) == edge:
                return []
            both = parts[at] + parts[at + 1]
            parts[at : at + 2] = [both]
            del ranks[at]
            if at:
                ranks[at - 1] = get(parts[at - 1] + both, none)
            if at < len(ranks):
                ranks[at] = get(both + parts[at + 1], none)
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the characters of two adjacent pieces anew gives the two back."""
        x, y = self.pieces[a][0], self.pieces[b][0]
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        ok = self.pairs[a << 32 | b] = self.merged(x + y, len(x)) == [x, y]
        return ok

    def split(self, text: str) -> list[int]:
        """The piece ids of one cut; a character that begins no piece stands as -1 - its code point."""
        n = len(text)
        longest = [-1] * n
        lead, length, shorter, known = self.lead, self.length, self.shorter, self.pairs
        for end, i in self.machine.iter(text):
            longest[end - lead[i]] = i  # ends go up, so the longest piece comes last
        if n and longest[0] >= 0 and length[longest[0]] == n:
            return [longest[0]]
        dead = bytearray(n // 8 + 1)  # bits of positions from which no encoding exists
        some = False  # whether any is set
        out: list[int] = []
        at = 0
        nxt = longest[0] if n else -1
        while at < n:
            if longest[at] < 0:  # no piece begins here: the character goes to bytes
                out.append(-1 - ord(text[at]))
                at += 1
                nxt = longest[at] if at < n else -1
                continue
            last = out[-1] if out else -1
            while nxt >= 0:
                end = at + length[nxt]
                if not some or not dead[end >> 3] >> (end & 7) & 1:
                    if last < 0:
                        break
                    ok = known.get(last << 32 | nxt)
                    if ok is None:
                        ok = self.compatible(last, nxt)
                    if ok:
                        break
                nxt = shorter[nxt]
            if nxt >= 0:
                out.append(nxt)
                at = end
                nxt = longest[at] if at < n else -1
                continue
            dead[at >> 3] |= 1 << (at & 7)
            some = True
            if not out:
                raise ValueError("the model has no encoding of a text of its own characters")
            back = out.pop()
            at -= length[back] if back >= 0 else 1
            nxt = shorter[back] if back >= 0 else -1
        return out

    def ids_of_cut(self, cut: str) -> list[int]:
        found = self.split(cut)
        if not found or min(found) >= 0:
            return found
        ids = []
        for i in found:
            if i >= 0:
                ids.append(i)
            elif self.byte:
                ids.extend(self.byte[b] for b in chr(-1 - i).encode("utf-8", "surrogatepass"))
            elif not ids or ids[-1] != self.unknown:  # unknown characters in a row are one
                ids.append(self.unknown)
        return ids

    def prepared(self, text: str) -> str:
        if self.trim:
            text = re.sub(" +", " ", text.strip(" "))
        text = text.replace(" ", MARK)
        return MARK + text if text and self.prefix else text

    def encoded(self, text: str) -> list[tuple[int, str, str]]:
        """(number of ids, ids joined by commas, their text) of each cut of a whole text."""
        return list(map(self.cuts.__getitem__, self.cut.findall(self.prepared(text))))

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for _, s, _ in self.encoded(text or "") for i in s.split(",")]

    def plain(self, ids: list[int]) -> str:
        """Decoded text of ids, the space that the first mark stands for included."""
        parts = [self.surface[i] for i in ids]
        if None not in parts:
            return "".join(parts)
        out, raw = [], bytearray()
        for i, part in zip(ids, parts, strict=True):
            if part is None:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(_bytes_text(bytes(raw)))
                raw.clear()
            out.append(part)
        if raw:
            out.append(_bytes_text(bytes(raw)))
        return "".join(out)

    def _leads(self, i: int) -> bool:
        """Whether a text that begins with this id begins with the mark put before each text."""
        return self.prefix and self.pieces[i][2] == NORMAL and self.pieces[i][0].startswith(MARK)

    def decode(self, ids: list[int]) -> str:
        shown = [i for i in ids if self.pieces[i][2] != CONTROL]
        return self.plain(ids)[1 if shown and self._leads(shown[0]) else 0 :]

    def decoded(self, got: list[tuple[int, str, str]]) -> str:
        """The text of encoded cuts: what their ids, each cut's of whole characters, decode to."""
        lead = bool(got) and self._leads(int(got[0][1].partition(",")[0]))
        return "".join([text for _, _, text in got])[1 if lead else 0 :]

    def forget(self) -> None:
        """Give up what is remembered of texts; pairs tell of the model alone and stay, up to ``PAIRS``."""
        self.cuts.forget()


def _bytes_text(raw: bytes) -> str:
    """UTF-8 of byte pieces; each byte that is part of no valid character becomes U+FFFD."""
    out, i = [], 0
    while i < len(raw):
        for k in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + k].decode())
                i += k
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each model and worker process."""
    if path not in _codecs:
        with open(path, "rb") as f:
            _codecs[path] = Codec(f.read())
    return _codecs[path]


def encode(text: Column, path: str) -> Column:
    """Ids of a text column as array<int>."""
    return F.pandas_udf(lambda s: s.map(codec(path).encode), T.ArrayType(T.IntegerType()))(text)


def decode(ids: Column, path: str) -> Column:
    """Text of an id array column; null gives the empty text."""
    return F.pandas_udf(lambda s: s.map(lambda x: codec(path).decode([] if x is None else list(x))), T.StringType())(ids)


def _hex(s: str) -> str:
    return hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()


def encoded(text: Column, path: str) -> Column:
    """Struct of n_tokens, ids and whether the decoded ids give the text back."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for texts in parts:
            rows = []
            for t in texts:
                got = c.encoded(t or "")
                ids = np.fromstring(",".join([s for _, s, _ in got]), np.int32, sep=",") if got else np.zeros(0, np.int32)
                rows.append((len(ids), ids, c.decoded(got) == (t or "")))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids", "exact"])
            rows = got = ids = None
        c.forget()
        give_back()

    kind = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("exact", T.BooleanType())])
    return F.pandas_udf(run, kind)(text)


def digests(text: Column, path: str) -> Column:
    """Struct of n_tokens, ids_sha256 and decoded_sha256: encodes, then decodes the ids."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for texts in parts:
            rows = []
            for t in texts:
                got = c.encoded(t or "")
                rows.append((sum([n for n, _, _ in got]), _hex(",".join([s for _, s, _ in got])), _hex(c.decoded(got))))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
        c.forget()
        give_back()

    kind = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return F.pandas_udf(run, kind)(text)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    return spread(docs.select("doc_id", "text")).select("doc_id", digests(F.col("text"), path).alias("d")).select("doc_id", "d.*")


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))

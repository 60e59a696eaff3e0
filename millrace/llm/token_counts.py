"""Token counts by a compiled finite-state transducer (byte-level BPE).

The last token of the encoding of a prefix is the one token ending there that
is compatible with the last token of the prefix before it. So a state needs,
for each suffix that may still grow into a token, the last token before it and
how many tokens fewer there were then: a finite amount. Reading a byte moves to
another state, and the transition carries by how much the number of emitted
tokens changes. The deterministic transducer is compiled on demand from the
vocabulary file, as lazy automata are, into flat tables that numpy reads.

Texts run as chunks side by side, all chunks one byte further at a time. A
pre-token boundary sets any state to the start state, hence from its first
boundary on the map of a chunk from incoming to outgoing state is a constant.
Maps are composed by a scan over the chunks: every chunk whose incoming state
is known runs its bytes before the boundary, all in parallel; only pre-tokens
longer than a chunk take further rounds.

The boundaries follow the byte-level pattern (contractions, letters, numbers,
others, white space with its last character going to the next word), found on
whole arrays of character classes.

Defined results: a null text counts as empty (0 bytes, 0 tokens); the added
special tokens of the file are one token wherever their string stands in a
text; repeated rows give a row each; very long texts are taken in pieces cut
where a boundary is certain. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

LETTER, NUMBER, BLANK, SPACE, OTHER = 0, 1, 2, 3, 4  # BLANK is U+0020, SPACE other white space
START, LOST = 0, 1  # states: at a pre-token's begin; not known
CHUNK = 256
PIECE = 1 << 20  # characters at a time


def _byte_names() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Transducer:
    """The compiled vocabulary; ``most`` bounds the states kept between batches."""

    def __init__(self, path: str, most: int = 200_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("not a byte-level BPE file without normaliser")
        names = _byte_names()
        raw = lambda s: bytes(names[c] for c in s)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.tokens = {raw(s) for s in spec["model"]["vocab"] if all(c in names for c in s)}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        # trie of the tokens: node 0 is empty
        self.child: list[dict[int, int]] = [{}]
        self.token_at: list[bytes | None] = [None]
        for t in self.tokens:
            node = 0
            for b in t:
                if b not in self.child[node]:
                    self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.token_at.append(None)
                node = self.child[node][b]
            self.token_at[node] = t
        self.pairs: dict[tuple[bytes | None, bytes], bool] = {}
        self.most = most
        self.kinds = character_classes(path)
        self.cut_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.reset()

    def reset(self) -> None:
        #: state: for each suffix that may grow, (trie node, last token before it, tokens then less tokens now)
        self.states: list[tuple] = [((0, None, 0),), ()]
        self.number: dict[tuple, int] = {self.states[0]: START}
        #: columns of the tables: the bytes met so far, in order; the width is a power of two
        self.column, self.byte_of, self.shift = np.full(256, -1, np.int64), [], 6
        self.next, self.emit = np.zeros((0, 0), np.int32), np.zeros((0, 0), np.int8)
        self.enlarge(1024)

    def enlarge(self, rows: int) -> None:
        old, n = self.next, self.next.shape
        self.next = np.full((rows, 1 << self.shift), -1, np.int32)
        self.next[: n[0], : n[1]] = old
        self.next[LOST] = LOST
        emit = np.zeros((rows, 1 << self.shift), np.int8)
        emit[: n[0], : n[1]] = self.emit
        self.emit = emit
        self.flat_next, self.flat_emit = self.next.ravel(), self.emit.ravel()

    def columns(self, data: np.ndarray) -> np.ndarray:
        """The table columns of bytes; new bytes get new columns."""
        for b in np.flatnonzero(np.bincount(data, minlength=256)).tolist():
            if self.column[b] < 0:
                self.column[b] = len(self.byte_of)
                self.byte_of.append(b)
        if len(self.byte_of) > 1 << self.shift:
            self.shift = (len(self.byte_of) - 1).bit_length()
            self.enlarge(len(self.next))
        return self.column[data]

    def merged(self, text: bytes) -> list[bytes]:
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            found = [(self.rank[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.rank]
            if not found:
                break
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def compatible(self, last: bytes | None, token: bytes) -> bool:
        key = (last, token)
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            ok = self.pairs[key] = self.merged((last or b"") + token) == ([token] if last is None else [last, token])
        return ok

    def compile(self, state: int, column: int) -> None:
        """Add the transition of a state at the byte of a column."""
        byte = self.byte_of[column]
        alive, last, count = [], None, None
        for node, before, less in self.states[state]:  # longest suffix first
            to = self.child[node].get(byte)
            if to is None:
                continue
            token = self.token_at[to]
            if last is None and token is not None and self.compatible(before, token):
                last, count = token, less + 1
            if self.child[to]:
                alive.append((to, before, less))
        if last is None:
            raise ValueError("the vocabulary lacks single bytes")
        key = (*((node, before, less - count) for node, before, less in alive), (0, last, 0))
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
            if to >= len(self.next):
                self.enlarge(len(self.next) + min(len(self.next), 1 << 15))
        self.next[state, column] = to
        self.emit[state, column] = count

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (state << self.shift) + byte
        to = self.flat_next.take(at)
        if to.min(initial=0) < 0:
            for k in np.unique(at[to < 0]).tolist():
                self.compile(k >> self.shift, k & (1 << self.shift) - 1)
            to = self.flat_next.take(at)
        return to, self.flat_emit.take(at)

    def emitted(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Change in the number of emitted tokens at each byte; ``begins`` marks pre-token starts, the first byte one."""
        n = len(data)
        width = min(CHUNK, max(1, n))
        lanes = -(-n // width)
        full = np.zeros(lanes * width, np.int64)
        full[:n] = self.columns(data)
        mark = np.zeros(lanes * width, bool)
        mark[:n] = begins
        mark[n:] = True
        byte, mark = np.ascontiguousarray(full.reshape(lanes, width).T), mark.reshape(lanes, width)
        free = np.ascontiguousarray(~mark.T).astype(np.int64)  # 0 at a boundary: the state becomes START
        out = np.zeros((width, lanes), np.int8)
        state = np.full(lanes, LOST, np.int64)
        for j in range(width):
            to, out[j] = self.step(state * free[j], byte[j])
            state = to.astype(np.int64)
        # the scan: a chunk's bytes before its first boundary, once the state before is known
        lead = np.where(mark.any(axis=1), mark.argmax(axis=1), width)
        ends = state  # LOST where the chunk has no boundary
        waiting = np.flatnonzero(lead > 0)
        while len(waiting):
            ready = waiting[ends[waiting - 1] != LOST]
            waiting = waiting[ends[waiting - 1] == LOST]
            ready = ready[np.argsort(-lead[ready], kind="stable")]
            now, todo = ends[ready - 1], lead[ready]
            for j in range(int(todo[0])):
                k = int(np.searchsorted(-todo, -j, side="left"))  # those with more than j bytes
                to, out[j, ready[:k]] = self.step(now[:k], byte[j, ready[:k]])
                now[:k] = to
            whole = todo == width
            ends[ready[whole]] = now[whole]
        return out.T.reshape(-1)[:n]

    def begins(self, cp: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Pre-token starts among code points; ``first`` marks where texts begin."""
        n = len(cp)
        kind = self.kinds[cp]
        blank = kind == BLANK
        kind[blank] = SPACE
        run = first.copy()
        run[1:] |= kind[1:] != kind[:-1]
        begin = run.copy()
        space = kind == SPACE
        # the last of a white-space run that something follows in the same text
        last = np.flatnonzero(space[:-1] & run[1:] & ~first[1:])
        begin[last] = True
        begin[last[blank[last]] + 1] = False
        # contractions: an apostrophe alone in its run, at a pre-token's start, letters after it
        q = np.flatnonzero((cp == 39) & run & begin)
        q = q[q + 1 < n]
        q = q[(kind[q + 1] == LETTER) & ~first[q + 1]]
        if len(q):
            a = cp[q + 1]
            one = (a == 115) | (a == 116) | (a == 109) | (a == 100)  # s t m d
            after = np.minimum(q + 2, n - 1)
            b = np.where((q + 2 < n) & ~first[after], cp[after], 0)
            two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)  # re ve ll
            for hit, k in ((one, 2), (two, 3)):
                h = q[hit]
                begin[h + 1] = False
                h = h[h + k < n] + k
                begin[h[(kind[h] == LETTER)]] = True
        return begin

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        if len(self.states) > self.most:
            self.reset()
        total = np.zeros(len(texts), np.int64)
        parts, of = [], []
        for i, t in enumerate(texts):
            if self.cut_special:
                pieces = self.cut_special.split(t)
                total[i] += len(pieces) - 1
            else:
                pieces = [t]
            for p in pieces:
                if p:
                    parts.append(p)
                    of.append(i)
        if not parts:
            return total
        joined = "".join(parts)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        starts = np.cumsum(lengths) - lengths
        first = np.zeros(len(cp), bool)
        first[starts] = True
        begin = self.begins(cp, first)
        data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        if len(data) == len(cp):
            at = starts
        else:
            lead = np.flatnonzero((data & 0xC0) != 0x80)
            at = lead[starts]
            wide = np.zeros(len(data), bool)
            wide[lead[begin]] = True
            begin = wide
        sums = np.add.reduceat(self.emitted(data, begin).astype(np.int64), at)
        np.add.at(total, np.array(of), sums)
        return total

    def count_all(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text, in batches of about PIECE characters; longer texts in pieces."""
        total = np.zeros(len(texts), np.int64)
        batch, of, size = [], [], 0

        def flush() -> None:
            np.add.at(total, np.array(of, np.int64), self.counts(batch))
            batch.clear()
            of.clear()

        for i, t in enumerate(texts):
            for p in self.pieces(t):
                batch.append(p)
                of.append(i)
                size += len(p)
                if size >= PIECE:
                    flush()
                    size = 0
        if batch:
            flush()
        return total

    def pieces(self, text: str) -> Iterator[str]:
        """A text in pieces of about PIECE characters, cut between a letter and a white space."""
        at = 0
        while len(text) - at > 2 * PIECE:
            m = _CUT.search(text, at + PIECE)
            if not m:
                break
            yield text[at : m.start() + 1]
            at = m.start() + 1
        yield text[at:]


#: Between the two a pre-token ends, whatever stands around them; no special token holds them.
_CUT = re.compile(r"[A-Za-z](?=[ \n])")


def character_classes(path: str) -> np.ndarray:
    """Class of each code point, as the file's own pre-tokenizer has it.

    Letters, numbers and white space come from Unicode tables; the tables of
    two libraries differ on code points assigned lately, and for those, some
    thousands, the pre-tokenizer is asked.
    """
    points = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    kinds = np.full(0x110000, OTHER, np.uint8)
    skip = 0xE000 - 0xD800
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, points):
            a, b = (x if x <= 0xD800 else x + skip for x in (m.start(), m.end()))
            kinds[a:b] = kind
    kinds[32] = BLANK
    doubtful = [c for c in np.flatnonzero(kinds <= NUMBER).tolist() if unicodedata.category(chr(c)) == "Cn"]
    if doubtful:
        from tokenizers import Tokenizer

        split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        kinds[doubtful] = OTHER
        for kind, before in ((LETTER, "a"), (NUMBER, "1")):
            for k in range(0, len(doubtful), 4096):
                part = doubtful[k : k + 4096]
                ends = dict(x[1] for x in split("".join(f"{before}{chr(c)}\n" for c in part)))
                kinds[[c for i, c in enumerate(part) if ends.get(3 * i) == 3 * i + 2]] = kind
    return kinds


_made: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One for each file and worker process."""
    if path not in _made:
        _made[path] = Transducer(path)
    return _made[path]


def token_counts(text: Column, path: str) -> Column:
    """Struct of n_bytes (UTF-8) and n_tokens of a text column."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        t = transducer(path)
        for texts in parts:
            own = [x or "" for x in texts]
            n = [len(x.encode("utf-8", "surrogatepass")) for x in own]
            yield pd.DataFrame({"n_bytes": np.array(n, np.int64), "n_tokens": t.count_all(own)})

    kind = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return F.pandas_udf(run, kind)(text)


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether a text has more than ``limit`` tokens."""
    counted = docs.select("doc_id", token_counts(F.col("text"), path).alias("c")).select("doc_id", "c.*")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

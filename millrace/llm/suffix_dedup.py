"""Exact substring dedup with suffix arrays.

Every byte covered by a ``SPAN``-byte string that also starts in a document of
smaller id is removed; strings are judged on the input.

All suffixes of a corpus do not fit a bounded share of its size, so only those
that can matter are sorted:

1. Winnowing. In every SPAN-byte window the 16-byte gram of least hash is an
   anchor, so two equal windows hold equal anchors at equal places. An anchor
   is described by the hash of its gram and the hash of all bytes that windows
   around it can reach (its context).
2. A task that reads texts combines its anchors first: places whose whole
   context it has already in a smaller document are settled there and then,
   so a passage in a third of all documents sends on one anchor a context and
   ``HELD`` anchors read. The rest meet by gram hash, packed in arrays. If the
   whole context also occurs in a smaller document, all of it is removed; this
   is decided by the hashes of gram and context, not by comparing bytes. If a
   gram has several
   different contexts, one anchor of each (in its smallest document) goes on;
   the context's other places in that document wait for what is found for it.
3. The contexts that go on are put into shards, and per shard a suffix array
   is refined by Larsson and Sadakane's doubling (numpy), with Kasai's common
   prefixes, run in lanes side by side. Suffixes that share SPAN bytes learn
   their smallest document; shards of the same grams are merged by binary
   search of their distinct strings. What is found in a context holds at all
   its places in its smallest document.
4. Documents get their spans back, by buckets of documents. A set of bits tells
   which documents go there; the others stay where they are, and one that goes
   for nothing comes back whole. No join moves texts.

Gram and context hashes have 32 and 64 bits, on top of the bin; the spans of
step 3 compare bytes. Groups are bins of about ``BIN_BYTES`` of text, whatever
one key weighs: a passage in many documents is one context.

Defined results: a null text counts as empty; a null doc_id loses nothing and
is no source; rows of one doc_id are no smaller document to each other; texts
under SPAN bytes lose nothing; an empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import time
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, settle, small_batches, table

SPAN = 50
GRAM = 16
SIDE = SPAN - GRAM  # bytes that a window reaches beyond the gram on either side
REACH = SPAN + SIDE  # a whole context
BIN_BYTES = 8 << 20
BATCH_BYTES = 512 << 10
#: Anchors that a task holds before it combines and deals them (32 bytes each).
HELD = 600_000
SHARD_BYTES = 2 << 20
#: Bits a document, and at most in all, of the set that tells which documents are sent to their buckets.
SET_BITS = 8
MOST_BITS = 1 << 30
U = np.uint64
PRIME = U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    return x ^ (x >> U(29))


# ---- step 1: anchors ----


def _grams(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hashes of all windows of 1, 2, 4, ... 64 bytes."""
    out, m = [_mix(data.astype(np.uint64) + U(1))], PRIME
    k = 1
    while 2 * k <= 64 and len(out[-1]) > k:
        h = out[-1]
        out.append(h[:-k] * m + h[k:])
        with np.errstate(over="ignore"):
            m = m * m
        k *= 2
    return tuple(out)


def _slide(f, x: np.ndarray, w: int) -> np.ndarray:
    k, y = 1, x
    while 2 * k <= w:
        y = f(y[:-k], y[k:])
        k *= 2
    n = len(x) - w + 1
    return f(y[:n], y[w - k : w - k + n])


def _ranges(g: tuple, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of bytes [begin, begin + length), length at most 127, by its binary digits."""
    out = _mix(length.astype(np.uint64) + U(77))
    at = begin.copy()
    for k in range(6, -1, -1):
        has = (length >> k & 1).astype(bool)
        if has.any():
            part = g[k][at[has]]
            out[has] = _mix(out[has] * PRIME + part)
            at[has] += 1 << k
    return out


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place in text, gram hash, context hash) of the anchors of texts of SPAN bytes and more."""
    lens = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.cumsum(lens) - lens
    g = _grams(data)
    h = _mix(g[4])
    w = SPAN - GRAM + 1
    least = _slide(np.minimum, h, w)
    edge = np.zeros(w - 1, np.uint64)
    # an anchor is least in some window; windows across texts only add anchors
    p = np.flatnonzero(_slide(np.maximum, np.concatenate([edge, least, edge]), w) == h)
    of = np.searchsorted(starts, p, side="right") - 1
    inside = p + GRAM <= starts[of] + lens[of]
    p, of = p[inside], of[inside]
    # but each text's own first and last windows count as well
    begin = np.maximum(p - SIDE, starts[of])
    length = np.minimum(p + SPAN, starts[of] + lens[of]) - begin
    wide = length >= SPAN
    p, of, begin, length = p[wide], of[wide], begin[wide], length[wide]
    context = _ranges(g, begin, length) ^ (p - begin).astype(np.uint64) * PRIME
    return of, p - starts[of], h[p], context


def pack(columns: list[np.ndarray]) -> bytes:
    """Arrays of one length as bytes: hashes as they are, the rest deflated."""
    out = [np.array([len(columns[0]), len(columns)], np.int64).tobytes()]
    for c in columns:
        raw = c.tobytes() if c.dtype.itemsize == 8 and c.dtype.kind == "u" else zlib.compress(c.tobytes(), 1)
        out += [np.array([len(raw)], np.int64).tobytes(), c.dtype.str.encode().ljust(4), raw]
    return b"".join(out)


def unpack(blob: bytes, most: int = 99) -> list[np.ndarray]:
    """The arrays, or the first ``most`` of them."""
    n, k = np.frombuffer(blob[:16], np.int64).tolist()
    at, out = 16, []
    for _ in range(min(k, most)):
        size = int(np.frombuffer(blob[at : at + 8], np.int64)[0])
        kind = np.dtype(blob[at + 8 : at + 12].decode().strip())
        raw = blob[at + 12 : at + 12 + size]
        if kind != np.dtype(np.uint64):
            raw = zlib.decompress(raw)
        out.append(np.frombuffer(raw, kind, n))
        at += 12 + size
    return out


def _deal(key: np.ndarray, columns: list[np.ndarray], kind: int = 0) -> pd.DataFrame:
    """One packed row for each value of ``key``."""
    if not len(key):
        return pd.DataFrame({"bin": [], "kind": [], "blob": []}).astype({"bin": "int64", "kind": "int32"})
    order = np.argsort(key, kind="stable")
    key = key[order]
    cuts = np.flatnonzero(_heads(key))
    ends = np.r_[cuts[1:], len(key)]
    rows = [(int(key[a]), kind, pack([c[order[a:b]] for c in columns])) for a, b in zip(cuts, ends, strict=True)]
    return pd.DataFrame(rows, columns=["bin", "kind", "blob"])


def _together(blobs) -> list[np.ndarray]:
    parts = [unpack(b) for b in blobs]
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def _anchor_rows(bins: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[list[np.ndarray]] = []
        size = 0

        def flush() -> pd.DataFrame:
            doc, tag, pos, gram, context = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((doc, context, gram))
            new = _heads(gram[order], context[order])
            least = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
            told = doc[order] > least  # the same context stands in a smaller document of this task
            sure, rest = order[told], order[~told]
            # settled places only pass through the bins, dealt by document
            return pd.concat([
                _deal(_bucket(doc[sure], bins), [x[sure] for x in (doc, tag, pos)], 0),
                _deal(((gram[rest] >> U(32)) % U(bins)).astype(np.int64), [x[rest] for x in (doc, tag, pos, gram, context)], 1),
            ])

        def take(ids: list, texts: list) -> None:
            nonlocal size
            of, pos, gram, context = anchors(texts)
            tag = np.array([zlib.crc32(t) for t in texts], np.uint32)
            held.append([np.array(ids, np.int64)[of], tag[of], pos.astype(np.uint32), gram, context])
            size += len(of)

        for df in parts:
            ids, texts, n = [], [], 0
            for d, t in zip(df["doc_id"], df["text"], strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                if len(raw) < SPAN:
                    continue
                ids.append(d)
                texts.append(raw)
                n += len(raw)
                if n >= BATCH_BYTES:
                    take(ids, texts)
                    ids, texts, n = [], [], 0
                    if size >= HELD:
                        yield flush()
                        size = 0
            if texts:
                take(ids, texts)
        if held:
            yield flush()
        give_back()

    return run


# ---- step 2: anchors of one bin ----


def _heads(*keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _meet(buckets: int):
    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        settled = [pd.DataFrame({"bin": key[0], "kind": 0, "blob": df["blob"][df["kind"] == 0]})]
        blobs = df["blob"][df["kind"] == 1].tolist()
        del df
        if not blobs:
            return settled[0]
        doc, tag, pos, gram, context = _together(blobs)
        blobs.clear()
        order = np.lexsort((doc, context, gram))
        doc, tag, pos, gram, context = (x[order] for x in (doc, tag, pos, gram, context))
        new = _heads(gram, context)
        at = np.flatnonzero(new)
        least = doc[at][np.cumsum(new) - 1]
        covered = doc > least
        heads = _heads(gram)
        many = np.bincount((np.cumsum(heads) - 1)[at]) > 1  # several contexts of a gram
        open_ = ~covered & many[np.cumsum(heads) - 1]
        go, more = open_ & new, open_ & ~new
        bucket = _bucket(doc, buckets)
        out = pd.concat(settled + [
            _deal(bucket[covered], [doc[covered], tag[covered], pos[covered]], 0),
            _deal(bucket[go], [doc[go], tag[go], pos[go], gram[go], context[go]], 1),
            _deal(np.full(more.sum(), key[0], np.int64), [doc[more], tag[more], pos[more], gram[more], context[more]], 3),
        ])
        give_back()
        return out

    return run


def _bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(doc.astype(np.uint64) * PRIME) % U(buckets)).astype(np.int64)


# ---- step 3: suffix arrays ----


def suffix_array(data: np.ndarray) -> np.ndarray:
    """All suffixes in order, by Larsson and Sadakane.

    Each round sorts only the groups that are still equal, by the rank of the
    place ``h`` on, and doubles h. The order is complete: Kasai's pass needs it.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    wide = np.zeros(n + 8, np.uint64)
    wide[:n] = data.astype(np.uint64) + U(0)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = key << U(8) | wide[k : k + n]
    sa = np.argsort(key, kind="stable")
    sorted_key = key[sa]
    # places within 8 bytes of the end are told apart by what is missing
    tail = np.minimum(n - sa, 8)
    order = np.lexsort((tail, sorted_key))
    sa, sorted_key, tail = sa[order], sorted_key[order], tail[order]
    new = _heads(sorted_key, tail)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[sa] = head
    h = 8
    while True:
        last = np.r_[new[1:], True]
        open_ = np.flatnonzero(~(new & last))  # in groups of two and more
        if not len(open_):
            break
        group = head[open_]
        then = rank[np.minimum(sa[open_] + h, n)]
        order = np.lexsort((then, group))
        sa[open_] = sa[open_][order]
        then = then[order]
        cut = _heads(group, then)
        new[open_] = cut
        head[open_] = np.maximum.accumulate(np.where(cut, open_, 0))
        rank[sa[open_]] = head[open_]
        h *= 2
    return sa


def kasai(data: np.ndarray, sa: np.ndarray, limit: int, lane: int = 128) -> np.ndarray:
    """Common prefix of each entry of ``sa`` with the one before, at most ``limit``.

    Kasai's pass over the text, from one place to the next with one byte less,
    in lanes of ``lane`` places that move on together.
    """
    n = len(data)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    inverse = np.empty(n, np.int64)
    inverse[sa] = np.arange(n)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.r_[data.astype(np.int16), np.full(limit + 1, -1, np.int16)]
    lanes = -(-n // lane)
    length = np.zeros(lanes, np.int64)
    for j in range(lane):
        place = np.arange(lanes) * lane + j
        if place[-1] >= n:
            place = place[:-1]
            length = length[: len(place)]
        if not len(place):
            break
        other = before[place]
        length[other < 0] = 0
        live = np.flatnonzero((other >= 0) & (length < limit))
        while len(live):
            a, b = place[live] + length[live], other[live] + length[live]
            same = (a < n) & (b < n)
            same &= padded[np.minimum(a, n)] == padded[np.minimum(b, n)]
            live = live[same]
            length[live] += 1
            live = live[length[live] < limit]
        out[inverse[place]] = length
        length = np.maximum(length - 1, 0)
    return out


def shard_strings(data: np.ndarray, left: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, run number of each, least document of each run) of the places with SPAN bytes left in their context.

    Runs are places that share SPAN bytes, in order of the strings.
    """
    sa = suffix_array(data)
    common = kasai(data, sa, SPAN)
    valid = np.flatnonzero(left[sa] >= SPAN)
    if not len(valid):
        return valid, valid, valid
    reach = np.minimum.reduceat(common[: valid[-1] + 1], np.r_[0, valid[:-1] + 1])
    run = np.cumsum(np.r_[True, reach[1:] < SPAN]) - 1
    place = sa[valid]
    least = np.minimum.reduceat(doc[place], np.flatnonzero(np.r_[True, run[1:] != run[:-1]]))
    return place, run, least


def merge_shards(strings: list[np.ndarray], least: list[np.ndarray]) -> list[np.ndarray]:
    """Least documents of each shard's sorted distinct strings over all shards, by binary search."""
    out = [x.copy() for x in least]
    for i, s in enumerate(strings):
        for j, t in enumerate(strings):
            if i != j and len(t):
                k = np.minimum(np.searchsorted(t, s), len(t) - 1)
                hit = t[k] == s
                out[i][hit] = np.minimum(out[i][hit], least[j][k[hit]])
    return out


def spans_of_contexts(context: list[bytes], doc: np.ndarray, shard_bytes: int = SHARD_BYTES) -> list[tuple[int, int, int]]:
    """(context number, begin, end) of the bytes whose SPAN-byte string also is in a context of a smaller document."""
    lens = np.array([len(c) for c in context], np.int64)
    cut = np.cumsum(lens) // shard_bytes
    made = []
    for s in np.unique(cut).tolist():
        own = np.flatnonzero(cut == s)
        size = lens[own]
        data = np.frombuffer(b"".join(context[i] for i in own), np.uint8)
        of = np.repeat(own, size)
        starts = np.cumsum(size) - size
        ends = np.repeat(starts + size, size)
        place, run, least = shard_strings(data, ends - np.arange(len(data)), doc[of])
        # all shards are held until they are merged: four bytes a number, each is below the bytes of a shard or the contexts of a bin
        made.append((data, of.astype(np.int32), np.repeat(starts.astype(np.int32), size), place.astype(np.int32), run.astype(np.int32), least))
        del of, starts, ends, place, run, least
    if len(made) > 1:
        strings = []
        for data, _, _, place, run, _ in made:
            head = place[np.flatnonzero(np.r_[True, run[1:] != run[:-1]])] if len(place) else place
            strings.append(np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, SPAN)[head]).view(f"S{SPAN}").ravel() if len(head) else np.zeros(0, f"S{SPAN}"))
        merged = merge_shards(strings, [m[5] for m in made])
        made = [(*m[:5], x) for m, x in zip(made, merged, strict=True)]
    out = []
    for data, of, begin, place, run, least in made:
        if not len(place):
            continue
        hit = place[least[run] < doc[of[place]]]
        hit.sort()
        if len(hit):
            # runs of places within one context become one span
            new = np.r_[True, (np.diff(hit) > 1) | (of[hit[1:]] != of[hit[:-1]])]
            first = np.flatnonzero(new)
            last = np.r_[first[1:], len(hit)] - 1
            out += zip(of[hit[first]].tolist(), (hit[first] - begin[hit[first]]).tolist(), (hit[last] - begin[hit[last]] + SPAN).tolist(), strict=True)
    return out


def _contexts(key: tuple, docs: pd.DataFrame, lists: pd.DataFrame, bins: int) -> pd.DataFrame:
    """Bytes of the contexts that go on, packed by the bin of their gram."""
    if not len(lists) or not len(docs):
        return _deal(np.zeros(0, np.int64), [])
    doc, tag, pos, gram, context = _together(lists["blob"])
    raws = [t.encode("utf-8", "surrogatepass") for t in docs["text"]]
    text = {(int(d), zlib.crc32(r)): r for d, r in zip(docs["doc_id"], raws, strict=True)}
    del docs, lists, raws
    rows = [(text[d, t], p) for d, t, p in zip(doc.tolist(), tag.tolist(), pos.tolist(), strict=True)]
    begin = np.array([max(0, p - SIDE) for _, p in rows], np.int64)
    parts = [r[b : p + SPAN] for (r, p), b in zip(rows, begin.tolist(), strict=True)]
    size = np.array([len(x) for x in parts], np.uint8)
    flat = np.zeros((len(parts), REACH), np.uint8)
    flat[np.arange(REACH) < size[:, None]] = np.frombuffer(b"".join(parts), np.uint8)
    columns = [doc, tag, pos, gram, context, size, flat.view(f"V{REACH}").ravel()]
    del text, rows, parts
    out = _deal(((gram >> U(32)) % U(bins)).astype(np.int64), columns, 2)
    give_back()
    return out


def _search(buckets: int):
    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        waiting = df["blob"][df["kind"] == 3]
        if len(waiting) == len(df):
            return _deal(np.zeros(0, np.int64), [])
        doc, tag, pos, gram, context, size, flat = _together(df["blob"][df["kind"] == 2])
        rows = flat.view(np.uint8).reshape(-1, REACH)
        # a window around the gram holds 17 more bytes of one side of it: contexts alone with both of theirs go no further
        before = np.minimum(pos, SIDE).astype(np.int64)
        half = SIDE // 2
        alone = np.ones(len(doc), bool)
        for shift in (-half, 0):
            ok = (before + shift >= 0) & (before + shift + GRAM + half <= size)
            every, h = np.arange(len(doc)), gram.copy()
            for k in range(GRAM + half):
                h = _mix(h * PRIME + rows[every, np.clip(before + shift + k, 0, REACH - 1)])
            h = np.where(ok, h, U(0))
            _, which, count = np.unique(h, return_inverse=True, return_counts=True)
            alone &= ~ok | (count[which] < 2)
        go = np.flatnonzero(~alone)
        found = spans_of_contexts([rows[i, : size[i]].tobytes() for i in go], doc[go])
        if not found:
            return _deal(np.zeros(0, np.int64), [doc[:0]], 0)
        i, a, b = (np.array(c, np.int64) for c in zip(*found, strict=True))
        i = go[i]
        at = pd.DataFrame({"gram": gram[i], "context": context[i], "a": a - before[i], "b": b - before[i]})
        doc, tag, pos = doc[i], tag[i], pos[i].astype(np.int64)
        if len(waiting):
            # equal contexts have their gram at the same place
            others = pd.DataFrame(dict(zip(("doc", "tag", "pos", "gram", "context"), _together(waiting), strict=True)))
            others = others.merge(at, on=["gram", "context"])
            doc, tag, pos = (np.r_[x, others[c].to_numpy(x.dtype)] for x, c in ((doc, "doc"), (tag, "tag"), (pos, "pos")))
            at = pd.concat([at, others[["a", "b"]]])
        a, b = (at[c].to_numpy(np.int64) for c in "ab")
        return _deal(_bucket(doc, buckets), [doc, tag, (pos + a).astype(np.uint32), (pos + b).astype(np.uint32)], 2)

    return run


# ---- step 4: documents ----


def _cut(docs: pd.DataFrame, lists: pd.DataFrame, bytes_too: bool) -> pd.DataFrame:
    """The maximal removed runs of the documents of one bucket, the remaining bytes' digest and, if asked for, those bytes."""
    edges: dict[tuple, list] = {}
    for kind, rows in lists.groupby("kind"):
        doc, tag, a, *b = _together(rows["blob"])
        lo = np.maximum(a.astype(np.int64) - SIDE, 0) if kind == 0 else a.astype(np.int64)
        hi = a.astype(np.int64) + SPAN if kind == 0 else b[0].astype(np.int64)
        order = np.lexsort((tag, doc))
        doc, tag, lo, hi = doc[order], tag[order], lo[order], hi[order]
        at = np.flatnonzero(_heads(doc, tag))
        for x, y in zip(at.tolist(), np.r_[at[1:], len(doc)].tolist(), strict=True):
            edges.setdefault((int(doc[x]), int(tag[x])), []).append((lo[x:y], hi[x:y]))
    out = []
    for d, t in zip(docs["doc_id"], docs["text"], strict=True):
        raw = t.encode("utf-8", "surrogatepass")
        n = len(raw)
        spans = edges.get((int(d), zlib.crc32(raw)))
        kept, starts, ends = raw, [], []
        if spans:
            level = np.zeros(n + 1, np.int64)
            for lo, hi in spans:
                np.add.at(level, lo, 1)
                np.add.at(level, np.minimum(hi, n), -1)
            gone = np.cumsum(level[:-1]) > 0
            turns = np.flatnonzero(np.diff(np.r_[False, gone, False]))
            starts, ends = turns[::2], turns[1::2]
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((d, n, starts, ends, hashlib.sha256(kept).hexdigest(), kept if bytes_too else None))
    del edges
    give_back()
    return pd.DataFrame(out, columns=["doc_id", "n_bytes", "starts", "ends", "kept_sha256", "kept"]).astype({"n_bytes": "int64"})


ROW = "bin long, kind int, blob binary"


def _named(lists: DataFrame, bits: int) -> np.ndarray:
    """A set of the documents that lists of buckets name, as ``bits`` bits by the hash of the id; others may seem to be in it."""

    def ids(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            yield pd.DataFrame({"bin": df["bin"], "ids": [pack([np.unique(unpack(b, 1)[0])]) for b in df["blob"]]})
        give_back()

    def slots(df: pd.DataFrame) -> pd.DataFrame:
        # all places of a document are in its bucket, so a document goes to the driver once
        own = np.unique(np.concatenate([unpack(b)[0] for b in df["ids"]]))
        return pd.DataFrame({"slots": [_bucket(own, bits).astype(np.uint32).tobytes()]})

    out = np.zeros(bits >> 6, np.uint64)
    with small_batches(lists.sparkSession):
        found = lists.select("bin", "blob").mapInPandas(ids, "bin long, ids binary").groupBy("bin").applyInPandas(slots, "slots binary").collect()
    for r in found:
        slot = np.frombuffer(r["slots"], np.uint32)
        np.bitwise_or.at(out, slot >> 6, U(1) << (slot & 63).astype(U))
    return out


def _released(df: DataFrame) -> DataFrame:
    """``df``; shuffle files of what is written already go now, not when the driver's memory happens to run short.

    The first collection only frees what still names them (measured: none gone
    after it, all after the second).
    """
    for wait in (1, 0):
        df.sparkSession._jvm.System.gc()
        time.sleep(wait)
    return df


def removed_spans(docs: DataFrame, bytes_too: bool = False) -> DataFrame:
    """doc_id, n_bytes, spans, kept_sha256, kept, a row per row of ``docs`` (doc_id, text).

    spans are the maximal removed runs in order, as (start, end) in bytes, end
    excluded; kept are the remaining bytes, null unless ``bytes_too``. They
    are bytes because a run may begin or end inside a character.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    every = docs.select("doc_id", text.alias("text"))
    total, n = every.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    bits = min(MOST_BITS, 1 << max(6, (SET_BITS * n).bit_length()))
    bins = max(1, -(-total // BIN_BYTES))
    named = every.where("doc_id is not null")

    found = named.mapInPandas(_anchor_rows(bins), ROW)
    lists = _released(settle(found.groupBy("bin").applyInPandas(_meet(bins), ROW), "suffix-lists"))

    def of(names: DataFrame) -> Column:
        """The bucket of a row whose document the lists may name, else -1: rows stay where they are until they go to their bucket."""
        seen = named.sparkSession.sparkContext.broadcast(_named(names, bits))

        def bucket(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            words = seen.value
            for d in parts:
                doc = d.to_numpy(np.int64)
                slot = _bucket(doc, bits)
                there = (words[slot >> 6] >> (slot & 63).astype(U) & U(1)).astype(bool)
                yield pd.Series(np.where(there, _bucket(doc, bins), -1))

        given = F.pandas_udf(bucket, "long")(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)))
        return F.when(F.col("doc_id").isNull(), -1).otherwise(given)

    going = lists.where("kind = 1")
    mine = named.withColumn("bin", of(going)).where("bin >= 0")
    contexts = mine.groupBy("bin").cogroup(going.groupBy("bin")).applyInPandas(lambda k, a, b: _contexts(k, a, b, bins), ROW)
    more = _released(settle(contexts.union(lists.where("kind = 3")).groupBy("bin").applyInPandas(_search(bins), ROW), "suffix-spans"))

    spans = lists.where("kind = 0").union(more)
    told = of(spans)
    cut = every.withColumn("bin", told).where("bin >= 0").groupBy("bin").cogroup(spans.groupBy("bin")).applyInPandas(
        lambda docs, lists: _cut(docs, lists, bytes_too), "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept_sha256 string, kept binary"
    )
    runs = F.zip_with("starts", "ends", lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    hit = cut.select("doc_id", "n_bytes", runs.alias("spans"), "kept_sha256", "kept")
    rest = every.withColumn("bin", told).where("bin < 0")
    raw = F.encode("text", "utf-8")
    plain = rest.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.array().cast("array<struct<start:long,end:long>>").alias("spans"),
        F.sha2(raw, 256).alias("kept_sha256"),
        (raw if bytes_too else F.lit(None).cast("binary")).alias("kept"),
    )
    return hit.union(plain)


def dedup_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, a row per row of ``docs`` (doc_id, text)."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return removed_spans(docs).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_spans(table(spark, sf_dir, "documents"))

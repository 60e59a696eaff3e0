import hashlib
import random

import numpy as np

from millrace.llm import suffix_dedup as sd


def test_suffix_array_and_common_prefixes():
    rng = random.Random(2)
    for _ in range(150):
        x = bytes(rng.choice(b"ab\x00") for _ in range(rng.randrange(90)))
        a = np.frombuffer(x, np.uint8)
        sa = sd.suffix_array(a)
        assert sa.tolist() == sorted(range(len(x)), key=lambda i: x[i:])
        got = sd.kasai(a, sa, 10, 7)
        for i in range(1, len(x)):
            p, q = x[sa[i - 1] :], x[sa[i] :]
            m = next((k for k in range(min(len(p), len(q), 10)) if p[k] != q[k]), min(len(p), len(q), 10))
            assert got[i] == m


def test_shards_merge():
    rng = random.Random(4)
    for _ in range(60):
        contexts = [bytes(rng.choice(b"ab") for _ in range(3)) * 30 for _ in range(12)]
        doc = np.array([rng.randrange(9) for _ in contexts])
        assert sorted(sd.spans_of_contexts(contexts, doc)) == sorted(sd.spans_of_contexts(contexts, doc, 150))


def brute(rows):
    raws = [(d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, r in raws:
        if d is not None:
            for p in range(len(r) - 49):
                s = r[p : p + 50]
                first[s] = min(first.get(s, d), d)
    out = []
    for d, r in raws:
        gone = bytearray(len(r))
        if d is not None:
            for p in range(len(r) - 49):
                if first[r[p : p + 50]] < d:
                    gone[p : p + 50] = b"\1" * 50
        kept = bytes(b for b, z in zip(r, gone) if not z)
        runs = sum(1 for j in range(len(gone)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((str(d), len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_against_brute_force(docs, monkeypatch):
    monkeypatch.setattr(sd, "BIN_BYTES", 4000)
    monkeypatch.setattr(sd, "BATCH_BYTES", 3000)
    monkeypatch.setattr(sd, "SHARD_BYTES", 2000)
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    passages = [" ".join(rng.choice(words) for _ in range(n)) for n in (9, 10, 12, 14, 20, 40, 80)]
    passages.append("ab" * 70)
    rows = []
    for k in range(150):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(passages)
            if rng.random() < 0.5:
                a = rng.randrange(len(p))
                p = p[a : a + rng.randrange(40, 90)]
            parts += [p, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))]
        rows.append((rng.choice([k, k, 1000 - k]), rng.choice(["", " "]).join(parts)))
    rows += [(2000, rows[0][1]), (2000, rows[1][1]), (2000, rows[0][1]), (None, rows[0][1]), (3000, None), (3001, ""), (3002, "x" * 49), (3003, "y" * 500), (3004, "y" * 60)]
    got = sorted((str(r[0]), *r[1:]) for r in sd.dedup_spans(docs(rows)).collect())
    assert got == brute(rows)


def test_every_place_in_the_smallest_document(docs):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    sentence = word(60)
    paragraph = word(90) + sentence + word(90)
    rows = [(1, "y" * 60), (2, "y" * 500), (3, word(40) + sentence + word(40)), (4, paragraph + word(70) + paragraph + word(9) + paragraph)]
    rows += [(4, paragraph), (5, word(30) + "-" * 60 + word(30)), (6, "-" * 300 + word(99) + "-" * 300), (7, paragraph + "-" * 200)]
    got = sorted((str(r[0]), *r[1:]) for r in sd.dedup_spans(docs(rows)).collect())
    assert got == brute(rows)
    assert [r for r in got if r[0] == "2"][0][2] == 500


def test_odd(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    small = [(d, t) for d, t in rows if len(t or "") < 50_000]
    got = sorted((str(r[0]), *r[1:]) for r in sd.dedup_spans(odd).collect() if r["n_bytes"] < 50_000)
    assert got == brute(small)
    assert sd.dedup_spans(none).count() == 0


def test_one_passage_in_a_third_of_the_documents(docs, monkeypatch):
    monkeypatch.setattr(sd, "BIN_BYTES", 4000)
    monkeypatch.setattr(sd, "BATCH_BYTES", 1000)
    monkeypatch.setattr(sd, "HELD", 200)
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefghijkl ") for _ in range(n))
    passage = word(160)
    rows = []
    for k in range(120):
        own = [word(rng.randrange(30, 120)), word(rng.randrange(30, 120))]
        rows.append((rng.choice([k, 500 - k]), passage.join(own) if k % 3 == 0 else "".join(own)))
    got = sorted((str(r[0]), *r[1:]) for r in sd.dedup_spans(docs(rows)).collect())
    assert got == brute(rows)


def test_spans_and_remaining_bytes(docs):
    rng = random.Random(14)
    word = lambda n: "".join(rng.choice("abcdéfghij ") for _ in range(n))
    passages = [word(70), word(55), "é" * 40]
    rows = [(k, word(20).join([word(30), *rng.sample(passages, 2), word(10)])) for k in range(12)] + [(20, None), (21, ""), (None, passages[0]), (22, word(80))]
    text = {d: (t or "").encode() for d, t in rows}
    got = sd.removed_spans(docs(rows), True).collect()
    assert len(got) == len(rows)
    for r in got:
        raw, at, left = text[r["doc_id"]], 0, b""
        for a, b in r["spans"]:
            assert (at < a or a == 0) and b - a >= 50  # maximal: runs neither touch nor overlap
            left, at = left + raw[at:a], b
        left += raw[at:]
        assert (r["n_bytes"], bytes(r["kept"]), r["kept_sha256"]) == (len(raw), left, hashlib.sha256(left).hexdigest())
    assert sum(len(r["spans"]) for r in got) > 12
    assert all(r["kept"] is None for r in sd.removed_spans(docs(rows)).collect())


def test_no_join_moves_texts(docs, monkeypatch):
    monkeypatch.setattr(sd, "BIN_BYTES", 2000)
    rng = random.Random(16)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = word(90)
    rows = [(2**60 + k, passage.join([word(60), word(60)]) if k % 3 else word(150)) for k in range(40)] + [(None, passage), (-5, passage)]
    for most in (64, 1 << 30):  # a set of so few bits also sends documents without spans
        monkeypatch.setattr(sd, "MOST_BITS", most, raising=False)
        out = sd.dedup_spans(docs(rows))
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
        assert sorted((str(r[0]), *r[1:]) for r in out.collect()) == brute(rows)

import hashlib
import io
import random
import zlib

from millrace.llm import warc
from millrace.llm.warc import _gzip, record


def archive(n=8, plain=False):
    parts = []
    for k in range(n):
        html = (b"<p>%d</p>" % k) * random.Random(k).randrange(1, 400)
        r = record("response", f"urn:page:{k}", "http://x/é ?\r\n", html, hashlib.sha1(html).digest())
        parts.append(r if plain else _gzip(r))
    return parts


def read(data):
    return list(warc.salvage(io.BytesIO(data), len(data)))


def test_round_trip():
    for plain in (False, True):
        got = read(b"".join(archive(plain=plain)))
        assert [x[0] for x in got] == ["record"] * 8
        assert [x[2]["warc-record-id"] for x in got] == [f"<urn:page:{k}>" for k in range(8)]
    assert read(b"") == []


def test_salvage():
    for plain in (False, True):
        parts = archive(plain=plain)
        starts = [sum(map(len, parts[:k])) for k in range(9)]
        data = bytearray(b"".join(parts))
        data[starts[3] + len(parts[3]) // 2] ^= 0x5A  # a bad record: skipped, later ones found
        got = read(bytes(data))
        gaps = [x for x in got if x[0] == "gap"]
        assert [(g[1], g[2]) for g in gaps] == [(starts[3], len(parts[3]))]
        assert len(got) == 8
        # junk before, between and a cut end
        junk = b"junk\x1f\x8b\x08junk" + parts[0] + b"WARC/1.9 no\r\n" + parts[1] + parts[2][: len(parts[2]) // 2]
        got = read(junk)
        assert [x[0] for x in got] == ["gap", "record", "gap", "record", "gap"]
        assert sum(x[2] for x in got if x[0] == "gap") + len(parts[0]) + len(parts[1]) == len(junk)


def test_every_damaged_byte_is_survived():
    parts = archive(3)
    whole = b"".join(parts)
    rng = random.Random(5)
    for _ in range(150):
        data = bytearray(whole)
        data[rng.randrange(len(data))] ^= 1 << rng.randrange(8)
        got = read(bytes(data))
        assert sum(x[0] == "record" for x in got) >= 2


def ids(got):
    return [x[2]["warc-record-id"] for x in got if x[0] == "record"]


def urns(ks):
    return [f"<urn:page:{k}>" for k in ks]


def test_many_records_in_a_member(monkeypatch):
    plain = archive(6, plain=True)
    for step in (64, 1 << 18):
        monkeypatch.setattr(warc, "STEP", step)
        # a record that was damaged before it was packed: the member's own check passes
        bad = bytearray(plain[2])
        bad[-8] ^= 0x5A
        data = _gzip(b"".join([*plain[:2], bytes(bad), *plain[3:]])) + _gzip(plain[0])
        got = read(data)
        assert ids(got) == urns([0, 1, 3, 4, 5, 0])
        gaps = [x for x in got if x[0] == "gap"]
        begin = len(plain[0]) + len(plain[1])
        assert [(g[1], g[2]) for g in gaps] == [(0, len(bad))] and f"{begin} to {begin + len(bad)}" in gaps[0][3]
        assert not any("salvaged" in x[2] for x in got if x[0] == "record")
        # junk between records
        assert ids(read(_gzip(plain[0] + b"WARC/1. junk" + plain[1]))) == urns([0, 1])


def test_cut_member(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefghijklmnop \n") for _ in range(3000)).encode() for _ in range(6)]
    plain = [record("response", f"urn:page:{k}", None, t, hashlib.sha1(t).digest()) for k, t in enumerate(texts)]
    for step in (512, 1 << 18):
        monkeypatch.setattr(warc, "STEP", step)
        whole = _gzip(b"".join(plain))
        got = read(whole[:-20])  # a member cut short: all but the record at the cut
        assert ids(got) == urns(range(5)) and got[-1][0] == "gap"
        assert all(x[2]["salvaged"] == "member without end" for x in got if x[0] == "record")
        # then a whole one: found again
        got = read(whole[:-20] + _gzip(plain[3]))
        assert ids(got)[:5] == urns(range(5)) and ids(got)[-1] == urns([3])[0]
        # a sum that does not hold while every record does: any header may be wrong
        data = bytearray(whole + _gzip(plain[1]))
        data[len(whole) - 6] ^= 1
        assert ids(read(bytes(data))) == urns([1])


def test_sum_and_record_fail_together():
    plain = archive(5, plain=True)
    c = zlib.compressobj(0, zlib.DEFLATED, 31)
    data = bytearray(c.compress(b"".join(plain)) + c.flush())
    data[data.index(plain[2]) + len(plain[2]) - 9] ^= 1
    got = read(bytes(data) + _gzip(plain[0]) + _gzip(plain[1]))
    assert ids(got) == urns([0, 1, 3, 4, 0, 1]) and [x[0] for x in got].count("gap") == 1
    assert ["salvaged" in x[2] for x in got if x[0] == "record"] == [True] * 4 + [False] * 2


def test_damage_is_searched_once():
    class Counted(io.BytesIO):
        n = 0

        def read(self, k=-1):
            out = super().read(k)
            Counted.n += len(out)
            return out

    data = (b"WARC/1.0 no\r\n" * 2_000) + archive(1)[0]
    got = list(warc.salvage(Counted(data), len(data)))
    assert [x[0] for x in got] == ["gap", "record"] and got[0][2] == 2_000 * 13
    assert Counted.n < 40 * (len(data) + warc.STEP)


def test_query(spark):
    big, other = "é" * 600, "b" * 1000
    rows = [(1, "http://a", big), (2, None, big), (5, "u\n", big), (3, "", "small"), (4, "", "small"), (6, "u", None), (7, "u", ""), (None, "u", other), (None, "u", other), (8, "u", other), (8, "u", other), (9, "u", "z" * 200_000)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, n int")
    got = warc.read_archives(warc.write_archives(warc.revisits(pages)))
    have = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got.collect())
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        last = max((p for p, _, h in rows if h == html and p is not None), default=None) if len(raw) >= 1000 else None
        again = last is not None and page is not None and page != last
        want.append((str(page), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", last if again else None))
    assert have == sorted(want)
    assert warc.read_archives(warc.write_archives(warc.revisits(pages.where("false")))).count() == 0

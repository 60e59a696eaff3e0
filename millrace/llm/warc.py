"""WARC archives: a writer, and a reader that salvages damaged files.

The writer puts one record per page into gzip members of archives in the
shared folder. Equal payloads of at least ``REVISIT_LEAST`` bytes are stored
once: the page with the largest id is the response, the others are revisit
records that refer to it. The reader checks each member's sum, each record's
version line, header, length and payload digest. After a failed check it
searches for the next valid member (or version line in a plain file), goes on
from there, and reports the bytes between as a quarantined gap.

A member may hold many records. It is inflated as a stream, and only the record
at hand is kept. A record that fails inside a member costs itself alone: the
next version line is searched in the inflated bytes, and the gap is reported
with its inner offsets. What a cut or broken member gave before its damage comes
back too. Records of a member whose own check failed say so (``reason``): their
payload digests hold, but nothing vouches for their headers. A member whose
sum fails though each of its records passes is quarantined as a whole, since
any header may be the damaged one.

A write task names its files after its own attempt and lists them in a
manifest once they are whole; only listed files are read, so a repeated task
does no harm. Archives are rolled at ``ROLL`` bytes and read a file a task, in
bounded buffers.

Defined results: a null html is an empty payload; pages of any size are
stored whole; a null url writes no target; a null page_id comes back as null
and is never referred to; repeated rows are records of their own, and all rows
of the largest page_id are responses; an empty table writes no archive and
reads back no row. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, give_back, settle, table

REVISIT_LEAST = 1000
ROLL = 32 << 20
VERSION = b"WARC/1.1"
MAGIC = b"\x1f\x8b\x08"
STEP = 1 << 18
#: The longest header that is looked for.
HEAD = 16 << 20
#: What zlib says of a member that inflates to its end but has another sum or length.
SUM = ("bad member: Error -3 while decompressing data: incorrect data check", "bad member: Error -3 while decompressing data: incorrect length check")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(kind: str, record_id: str, uri: str | None, payload: bytes, digest: bytes, refers_to: str | None = None) -> bytes:
    """The bytes of one record. A revisit keeps the HTTP header only; digest and length are of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    head = [
        VERSION.decode(),
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id}>",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if uri is not None:
        head.append(f"WARC-Target-URI: {quote(uri, safe='/:?#[]@!$&()*+,;=%~-._' + chr(39))}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class Damage(Exception):
    """A failed check."""


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(header, block, end) of the record at ``at``; raises Damage."""
    if not data.startswith(b"WARC/1.", at):
        raise Damage("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damage("header without end")
    header = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damage("bad header line")
        header[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    try:
        n = int(header["content-length"])
    except (KeyError, ValueError):
        raise Damage("no length") from None
    block = data[end + 4 : end + 4 + n]
    if n < 0 or len(block) < n or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
        raise Damage("length does not fit")
    if header.get("warc-type") == "response":
        said = header.get("warc-payload-digest", "")
        payload = block.partition(b"\r\n\r\n")[2]
        if said.startswith("sha1:") and said[5:] != base64.b32encode(hashlib.sha1(payload).digest()).decode():
            raise Damage("payload digest differs")
    return header, block, end + 8 + n


class Source:
    """Random access to an open file through a buffer of ``STEP`` bytes and more."""

    def __init__(self, f, size: int):
        self.f, self.size = f, size
        self.start, self.held = 0, b""
        self.found: dict[bytes, tuple[int, int]] = {}  # mark -> (searched from, place)

    def read(self, at: int, n: int) -> bytes:
        n = min(n, max(0, self.size - at))
        if not self.start <= at <= at + n <= self.start + len(self.held):
            self.f.seek(at)
            self.start, self.held = at, self.f.read(min(max(n, STEP), max(0, self.size - at)))
        return self.held[at - self.start : at - self.start + n]

    def find(self, what: bytes, at: int) -> int:
        """The next place of ``what`` from ``at``, or the end of the file. A place found stays known until it is passed."""
        since, place = self.found.get(what, (at, -1))
        if not since <= at <= place:
            since, place = at, self._search(what, at)
        self.found[what] = since, place
        return place

    def _search(self, what: bytes, at: int) -> int:
        while at < self.size:
            part = self.read(at, STEP)
            k = part.find(what)
            if k >= 0:
                return at + k
            at += max(1, len(part) - len(what) + 1) if at + len(part) < self.size else len(part)
        return self.size


class Member:
    """The inflated bytes of the gzip member at ``at``, as a stream that forgets what is behind."""

    def __init__(self, src: Source, at: int):
        self.src, self.pos, self.z = src, at, zlib.decompressobj(31)
        self.base, self.data, self.why = 0, b"", ""  # data begins at the inflated place base
        self.done = False

    def _more(self) -> bool:
        """Inflate a step; at the end, ``why`` says what failed and pos is where the member ends."""
        if self.done:
            return False
        part = self.z.unconsumed_tail or self.src.read(self.pos, STEP)
        if not self.z.unconsumed_tail:
            self.pos += len(part)
        if not part:
            self.done, self.why = True, "member without end"
            return True
        before = self.z.copy()
        try:
            self.data += self.z.decompress(part, 4 * STEP)
        except zlib.error:
            # again byte by byte, so that what comes before the damage is not lost
            self.z, out = before, []
            try:
                for k in range(len(part)):
                    out.append(self.z.decompress(part[k : k + 1]))
            except zlib.error as e:
                self.done, self.why = True, f"bad member: {e}"
                if self.why.startswith(SUM):
                    self.pos += k + 1 - len(part) + (4 if self.why == SUM[0] else 0)  # the length follows the sum
            self.data += b"".join(out)
        if self.z.eof:
            self.done = True
            self.pos -= len(self.z.unused_data)
        return True

    def reach(self, k: int) -> bool:
        """Whether there are bytes up to the inflated place k."""
        while self.base + len(self.data) < k and self._more():
            pass
        return self.base + len(self.data) >= k

    def find(self, what: bytes, k: int) -> int:
        """The next place of ``what`` from k, or -1 at the end."""
        while True:
            at = self.data.find(what, max(0, k - self.base))
            if at >= 0:
                return self.base + at
            k = max(k, self.base + len(self.data) - len(what) + 1)
            if not self._more():
                return -1

    def forget(self, k: int) -> None:
        self.data, self.base = self.data[max(0, k - self.base) :], max(k, self.base)

    def record(self, k: int) -> tuple[dict[str, str], bytes, int]:
        """(header, block, end) of the record at the inflated place k."""
        self.forget(k)
        if not self.reach(k + 7) or not self.data.startswith(b"WARC/1."):
            raise Damage("no version line")
        while self.data.find(b"\r\n\r\n") < 0:
            if len(self.data) > HEAD or not self._more():
                raise Damage("header without end")
        head = self.data.find(b"\r\n\r\n") + 4
        self.reach(k + head + _length(self.data[:head]) + 4)
        header, block, end = parse_record(self.data)
        return header, block, k + end


def _length(head: bytes) -> int:
    """The content length that a header states, else 0."""
    said = (x.split(b":")[1].strip() for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return next((int(x) for x in said if x.isdigit()), 0)


def _inner(member: Member) -> Iterator[tuple]:
    """("record", header, block) and ("gap", from, to, reason) of a member's inflated bytes, in order."""
    k = 0
    while member.reach(k + 1):
        try:
            header, block, end = member.record(k)
        except Damage as e:
            begin = k
            k = member.find(b"WARC/1.", k + 1)
            if k < 0:
                yield "gap", begin, member.base + len(member.data), str(e)
                return
            member.forget(k)
            yield "gap", begin, k, str(e)
            continue
        yield "record", header, block
        k = end


def _vouched(src: Source, at: int) -> tuple[str, int, int, int]:
    """(what failed, end, records, records that failed) of the member at ``at``; keeps no record."""
    member, whole, failed = Member(src, at), 0, 0
    for what, *_ in _inner(member):
        whole += what == "record"
        failed += what == "gap"
    return member.why, member.pos, whole, failed


def _plain(src: Source, at: int) -> tuple[dict[str, str], bytes, int]:
    """The record at ``at`` of a plain file: reads as much as its header asks for."""
    data = src.read(at, STEP)
    if not data.startswith(b"WARC/1."):
        raise Damage("no version line")
    while data.find(b"\r\n\r\n") < 0:
        more = src.read(at + len(data), STEP)
        if not more or len(data) > HEAD:
            raise Damage("header without end")
        data += more
    head = data.find(b"\r\n\r\n") + 4
    n = head + _length(data[:head]) + 4
    if len(data) < n:
        data += src.read(at + len(data), n - len(data))
    header, block, end = parse_record(data)
    return header, block, at + end


def salvage(f, size: int) -> Iterator[tuple]:
    """("record", offset, header, block) and ("gap", offset, length, reason) of one archive, in order.

    A gap inside a member has the member's offset, its inflated length, and its
    inner places in the reason. Headers of records from a member whose own check
    failed have an entry ``salvaged`` with what failed.
    """
    src, at, gap, why = Source(f, size), 0, None, ""
    while at < size:
        found: Iterator[tuple] = iter(())
        note, broken = "", False
        try:
            if src.read(at, 3) == MAGIC:
                note, end, whole, failed = _vouched(src, at)
                broken = bool(note) and not note.startswith(SUM)
                if not whole or note.startswith(SUM) and not failed:
                    raise Damage(note or "member without a record")
                found = _inner(Member(src, at))
            else:
                header, block, end = _plain(src, at)
                found = iter([("record", header, block)])
        except Damage as e:
            if gap is None:
                gap, why = at, str(e)
            at = min(src.find(MAGIC, at + 1), src.find(b"WARC/1.", at + 1))
            continue
        if gap is not None:
            yield "gap", gap, at - gap, why
            gap = None
        for what, a, b, *reason in found:
            if what == "record":
                yield "record", at, a | {"salvaged": note} if note else a, b
            else:
                yield "gap", at, b - a, f"inflated bytes {a} to {b}: {reason[0]}"
        if broken:  # where it ends is unknown: what follows its start is searched
            gap, why = at, f"{note}, after {whole} records"
            at = min(src.find(MAGIC, at + 1), src.find(b"WARC/1.", at + 1))
        else:
            at = end
    if gap is not None:
        yield "gap", gap, size - gap, why


def write_archives(pages: DataFrame) -> DataFrame:
    """Write (page_id, uri, payload, digest, refers_to) rows; the manifest (path, n_records, n_bytes)."""
    where = fresh_path(pages.sparkSession, "warc")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, folder = fs.FileSystem.from_uri(where)
        store.create_dir(folder, recursive=True)
        out, done = None, []

        def close() -> None:
            nonlocal out
            if out is not None:
                out[1].close()
                done.append((out[0], out[2], out[3]))
            out = None

        for df in parts:
            for page, uri, html, digest, refers in zip(df["page_id"], df["url"], df["html"], df["digest"], df["refers_to"], strict=True):
                if out is None:
                    name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    out = [name, store.open_output_stream(name, compression=None), 0, 0]
                kind = "response" if pd.isna(refers) else "revisit"
                raw = (html or "").encode("utf-8", "surrogatepass")
                data = _gzip(record(kind, _urn(page), uri, raw, bytes.fromhex(digest), None if kind == "response" else _urn(refers)))
                out[1].write(data)
                out[2] += 1
                out[3] += len(data)
                if out[3] >= ROLL:
                    close()
        close()
        yield pd.DataFrame(done, columns=["path", "n_records", "n_bytes"]).astype({"n_records": "int64", "n_bytes": "int64"})

    made = pages.mapInPandas(run, "path string, n_records long, n_bytes long")
    return settle(made.withColumn("root", F.lit(where)), "warc-manifest")


def _urn(page) -> str:
    return "urn:page:none" if pd.isna(page) else f"urn:page:{int(page)}"


def _page(urn: str | None) -> int | None:
    last = (urn or "").strip("<>").rpartition(":")[2]
    return int(last) if last.lstrip("-").isdigit() else None


def read_archives(manifest: DataFrame) -> DataFrame:
    """Records and gaps of the listed archives, a file a task.

    Columns: path, offset, page_id, record_type ("gap" for quarantined bytes),
    payload_bytes, payload_digest, refers_to, length of gaps, and reason of gaps and
    of records from damaged members.
    """
    kind = "path string, offset long, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, length long, reason string"
    names = [x.split()[0] for x in kind.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            for root, path in zip(df["root"], df["path"], strict=True):
                store, _ = fs.FileSystem.from_uri(root)
                rows = []
                with store.open_input_file(path) as f:
                    for what, at, a, b in salvage(f, f.size()):
                        if what == "gap":
                            rows.append((path, at, None, "gap", None, None, None, a, b))
                        else:
                            head, _, payload = b.partition(b"\r\n\r\n")
                            n = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
                            digest = a.get("warc-payload-digest", "")
                            digest = base64.b32decode(digest[5:]).hex() if digest.startswith("sha1:") else None
                            rows.append((path, at, _page(a.get("warc-record-id")), a.get("warc-type"), n, digest, _page(a.get("warc-refers-to")), None, a.get("salvaged")))
                        if len(rows) >= 5000:
                            yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64", "length": "Int64"})
                            rows = []
                yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64", "length": "Int64"})
        give_back()

    n = max(1, manifest.count())
    return manifest.repartition(n, "path").mapInPandas(run, kind)


def revisits(pages: DataFrame, least: int = REVISIT_LEAST) -> DataFrame:
    """page_id, url, html with digest (SHA-1, hex) and refers_to (null for responses)."""
    raw = F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8")
    own = pages.select("page_id", "url", "html", F.sha1(raw).alias("digest"), F.octet_length(raw).cast("long").alias("n"))
    same = own.where(F.col("n") >= least).groupBy("digest", "n").agg(F.max("page_id").alias("last"), F.count("*").alias("copies")).where("copies > 1")
    # copies of one page may be a third of all rows: each of 16 salts has its own share of them
    salts = same.select("digest", "n", "last", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    found = own.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(16)).cast("int")).join(salts, ["digest", "n", "salt"], "left")
    return found.select("page_id", "url", "html", "digest", F.when(F.col("page_id") != F.col("last"), F.col("last")).alias("refers_to"))


def op8_warc(spark, sf_dir: str) -> DataFrame:
    manifest = write_archives(revisits(table(spark, sf_dir, "pages")))
    return read_archives(manifest).where("record_type != 'gap'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB: digests, sizes and the larger page that a revisit refers to.
ORACLE_SQL = {
    "op8_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages
), m AS (
  SELECT page_id, n, sha1(html) AS digest,
         CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS last
  FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN last IS NOT NULL AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last IS NOT NULL AND page_id <> last THEN last END AS refers_to
FROM m
"""
}

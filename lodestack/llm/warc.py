"""WARC archives on any Hadoop file system: a writer of one gzip member a record, and a splittable reader.

Writing. Tasks build gzip members; Spark's text sink writes their bytes. The sink ends each row with a
line separator, and here that is an empty gzip member (20 bytes, as block-gzip files end with), so the
file stays a plain sequence of gzip members.

Reading. Tasks own byte ranges. Within its range a task scans for the gzip magic (Spark's text source does
the scan, with the magic as line separator, and reads the last record to its end, past the range). Each
magic is a candidate: it is a member only if its header is valid, it inflates, and it starts with a WARC
version line; otherwise the bytes belong to the member before. A member is owned by the range it starts in.
Where a magic inside a member happens to fall past the range's end, the rest lies in the next range; such
members (one in some millions) are completed in a second step, by file.

Names must not end in .gz: Hadoop's line reader would then inflate the file as one stream.
"""
from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.workspace import Workspace, attach

MAGIC = b"\x1f\x8b\x08"
#: An empty gzip member.
EMPTY_MEMBER = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 3, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
URN = "urn:page:"
FIELDS = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, intact boolean, payload binary"


def _clean(value: str | None) -> str:
    """A header value: control characters and spaces are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) <= 32 or ord(c) == 127 else c for c in value or "")


def member(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, level: int = 6) -> bytes:
    """One record as a gzip member. A record that refers to another is a revisit and leaves the payload out."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.0", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{URN}{'null' if page_id is None else page_id}>",
        f"WARC-Target-URI: {_clean(url)}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n") + z.compress(block + b"\r\n\r\n") + z.flush()


def write_warc(pages: DataFrame, path: str, least: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a record for every row. Of equal payloads of `least` bytes or more the largest id is the response.

    Null html is an empty payload. Smaller payloads are always responses, and so are all rows of a repeated
    largest id. A null id is written as null; it answers for a group only if no row of the group has an id, and
    then all of its rows are responses. An empty table gives an archive without records.
    """
    ws = Workspace(pages.sparkSession, "warc")
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).cast("string").alias("_url"), html.alias("_payload"))
    rows = rows.withColumn("_sha", F.unhex(F.sha1("_payload")))
    large = rows.where(F.octet_length("_payload") >= least).select("_sha", "_id")
    groups = large.groupBy("_sha").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_copies")).where("_copies > 1")
    groups = ws.save(groups, "groups")
    keyed = rows.withColumn("_key", F.when(F.octet_length("_payload") >= least, F.col("_sha")))
    spread = F.concat(F.lit(b"-"), F.unhex(F.sha2(F.concat_ws(":", F.hex("_sha"), F.col("_id").cast("string")), 256)))
    keyed = keyed.withColumn("_key", F.coalesce("_key", spread))  # rows without a group join nothing
    total = pages.count()
    found = attach(keyed, groups.withColumnRenamed("_sha", "_key"), "_key", "_copies", total, "_id")
    refers = F.when(~F.col("_id").eqNullSafe(F.col("_keep")), F.col("_keep"))
    found = found.select("_id", "_url", "_payload", F.lower(F.hex("_sha")).alias("_sha"), refers.alias("_refers"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            ids, urls, shas, refers = (rb.column(i).to_pylist() for i in (0, 1, 3, 4))
            for at in range(0, rb.num_rows, 256):
                part = slice(at, at + 256)
                payloads = rb.column(2).slice(at, 256)
                out = [member(i, u, p.as_py(), d, r) for i, u, p, d, r in zip(ids[part], urls[part], payloads, shas[part], refers[part], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    members = found.mapInArrow(build, "value binary").select(F.col("value").cast("string").alias("value"))
    members.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)


class _Candidate:
    """A place where a member may begin, inflated as far as its bytes have come."""

    def __init__(self):
        self.z = zlib.decompressobj(31)
        self.out = b""

    def add(self, raw: bytes) -> _Candidate | None:
        """This candidate with more bytes; None if it can't be a member."""
        new = _Candidate.__new__(_Candidate)
        new.z = self.z.copy()
        try:
            new.out = self.out + new.z.decompress(raw)
        except zlib.error:
            return None
        start = new.out[:7]
        if not (b"WARC/1.".startswith(start) or b"WARC/0.".startswith(start) or not start):
            return None
        if new.z.eof and new.z.unused_data.strip(b"\x00\r\n"):
            return None
        return new

    @property
    def is_record(self) -> bool:
        return len(self.out) >= 7

    @property
    def whole(self) -> bool:
        return self.z.eof


class _Stitcher:
    """Takes the pieces between magics, in order, and gives the content of whole members.

    loose: the pieces before the first whole record and after the last, which may belong to other ranges.
    """

    def __init__(self):
        self.open: _Candidate | None = None
        self.since = 0  # pieces in loose before the open candidate
        self.head: list[bytes] | None = None
        self.loose: list[bytes] = []

    def add(self, raw: bytes) -> bytes | None:
        more = self.open.add(raw) if self.open is not None else None
        sure = self.open is not None and self.open.is_record
        if not (sure and more is not None):  # a record that goes on comes first; then what begins here
            own = _Candidate().add(raw)
            if own is not None and (more is None or own.is_record or own.whole):
                more, self.since = own, len(self.loose)
        self.open = more
        self.loose.append(raw)
        if more is None or not more.whole:
            return None
        if more.is_record:
            if self.head is None:
                self.head = self.loose[: self.since]
            self.loose = []
        else:  # an empty member is no proof
            self.since = len(self.loose)
        self.open = None
        return more.out

    def rest(self) -> list[bytes]:
        return [*(self.head or []), *self.loose]


def _parse(data: bytes, with_payload: bool) -> tuple | None:
    """A record's fields in the order of FIELDS; None for an empty member."""
    if not data:
        return None
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        fields[k.strip().lower()] = v.strip()
    length = int(fields.get("content-length", len(rest)))
    block = rest[:length]
    kind, http, payload = fields.get("warc-type"), b"", block
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
    size = len(payload)
    if kind == "revisit":
        for line in http.split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            if k.strip().lower() == b"content-length":
                size = int(v)
    algorithm, _, value = fields.get("warc-payload-digest", "").partition(":")
    digest = base64.b32decode(value).hex() if algorithm == "sha1" and len(value) == 32 else value or None
    intact = len(block) == length
    if algorithm == "sha1" and kind != "revisit":
        import hashlib

        intact = intact and hashlib.sha1(payload).hexdigest() == digest
    strip = lambda v: v[1:-1] if v and v[0] == "<" else v
    return (
        strip(fields.get("warc-record-id")), kind, fields.get("warc-target-uri"), strip(fields.get("warc-refers-to")), digest, size, intact,
        payload if with_payload and kind != "revisit" else None,
    )


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row for every record of the archives at path, with the columns FIELDS.

    payload_digest is lower-case hex for SHA-1, as given for others; intact says that the block has its full
    length and a SHA-1 digest agrees with the payload. payload is null for revisits, whose payload_bytes is
    that of the response they stand for. Archives without records, and empty ones, give no rows.
    """
    ws = Workspace(spark, "warc-read")
    pieces = (
        spark.read.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).text(path)
        .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("piece"))
    )
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def table(rows: list[tuple]) -> list[pa.Array]:
        kinds = [pa.string()] * 5 + [pa.int64(), pa.bool_(), pa.binary()]
        return [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(rows: list[tuple], rest: list[tuple]) -> pa.RecordBatch:
            whole = table([*rows, *[(None,) * 8] * len(rest)])
            left = [*[(None, None, None, None)] * len(rows), *rest]
            more = [pa.array([x[i] for x in left], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int32(), pa.binary()))]
            return pa.RecordBatch.from_arrays([*whole, *more], [*names, "file", "start", "part", "rest"])

        def leftovers(at: tuple, s: _Stitcher) -> list[tuple]:
            rest = s.rest()
            if all(r == EMPTY_MEMBER for r in rest):
                return []
            return [(*at, i, r) for i, r in enumerate(rest)]

        at, s = None, _Stitcher()
        for rb in batches:
            rows, rest = [], []
            for file, start, piece in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), rb.column(2), strict=True):
                if (file, start) != at:
                    if at is not None:
                        rest += leftovers(at, s)
                    at, s = (file, start), _Stitcher()
                    if start == 0:
                        continue  # what stands before the first magic
                content = s.add(MAGIC + piece.as_py())
                if content is not None and (row := _parse(content, with_payload)) is not None:
                    rows.append(row)
                if len(rows) >= 256:
                    yield given(rows, rest)
                    rows, rest = [], []
            yield given(rows, rest)
        if at is not None:
            yield given([], leftovers(at, s))

    found = ws.save(pieces.mapInArrow(stitch, f"{FIELDS}, file string, start long, part int, rest binary"), "members")

    def complete(pdf: pd.DataFrame) -> pd.DataFrame:
        """Members that run on into the next ranges of their file. Only what ranges could not place comes here."""
        out, s = [], _Stitcher()
        for rest in pdf.sort_values(["start", "part"])["rest"]:
            content = s.add(bytes(rest))
            if content is not None and (row := _parse(content, with_payload)) is not None:
                out.append(row)
        return pd.DataFrame(out, columns=names)

    whole = found.where("record_type IS NOT NULL").select(*names)
    rest = found.where("file IS NOT NULL").groupBy("file").applyInPandas(complete, FIELDS)
    return whole.unionByName(rest)


def round_trip(pages: DataFrame, path: str, least: int = 1000) -> DataFrame:
    """Write pages to path and read them back: (page_id, payload_bytes, payload_digest, record_type, refers_to, intact)."""
    write_warc(pages, path, least)
    number = lambda c: F.expr(f"try_cast(substring({c}, {len(URN) + 1}) AS LONG)")
    back = read_warc(pages.sparkSession, path, with_payload=False)
    return back.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "intact"
    )

"""Archives (tar.gz and zip) as a Spark data source: members as rows, and rows written as archives, a file a task.

Register with `spark.dataSource.register(Archives)`, then `spark.read.format("archive").load(path)` and
`df.write.format("archive").mode("append").save(path)`. Files are opened by pyarrow's file systems, so paths are
those that pyarrow knows (file, hdfs, s3, gs).
"""
from __future__ import annotations

import gzip
import io
import json
import tarfile
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of a zip file that one task answers for, of members in one Arrow batch, and of the largest member that is read.
SPLIT, BATCH, LARGEST = 64 << 20, 8 << 20, 256 << 20
TAR, ZIP = (".tar.gz", ".tgz"), (".zip",)
MEMBERS = "archive string, member string, size bigint, status string, content binary"
_ARROW = pa.schema([("archive", pa.string()), ("member", pa.string()), ("size", pa.int64()), ("status", pa.string()), ("content", pa.binary())])
_BROKEN = (tarfile.TarError, zipfile.BadZipFile, zlib.error, gzip.BadGzipFile, EOFError, NotImplementedError, RuntimeError, pa.ArrowInvalid)


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


@dataclass
class Range(InputPartition):
    """The members of an archive whose headers begin in a range of its bytes."""

    path: str
    start: int
    end: int


def unsafe(member: str) -> bool:
    """Whether a member would leave the folder that it is unpacked in."""
    return member.startswith("/") or ".." in member


class ArchiveReader(DataSourceReader):
    """A row for each file in each archive below a path. status: ok, unsafe (not read: a name with .. or a leading slash, a link or
    a device), large (not read), and for an archive that can't be read on, one row corrupt without a member.

    A gzip stream has no places to begin at, so a tar.gz is one task's, which streams it and holds a member at a time; a zip file is parted by bytes.
    """

    def __init__(self, options: dict):
        self.path, self.largest, self.split = options["path"], int(options.get("largest", LARGEST)), int(options.get("split", SPLIT))

    def partitions(self) -> list[InputPartition]:
        fs, root = _open(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else [f for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.is_file and not any(p.startswith("_") for p in f.path.removeprefix(root).split("/"))]
        out: list[InputPartition] = []
        for f in sorted(found, key=lambda f: f.path):
            if f.path.lower().endswith(TAR):
                out.append(Range(f.path, 0, -1))
            elif f.path.lower().endswith(ZIP):
                out += [Range(f.path, at, at + self.split) for at in range(0, max(f.size, 1), self.split)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for row in self._rows(partition) if partition.path else ():
            rows.append((partition.path, *row))
            held += len(row[3] or b"")
            if held >= BATCH or len(rows) >= 1000:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _rows(self, at: Range) -> Iterator[tuple]:
        fs, _ = _open(self.path)
        try:
            if at.end < 0:
                with fs.open_input_stream(at.path, compression=None) as raw, tarfile.open(fileobj=raw, mode="r|gz") as tar:
                    for m in tar:
                        if not m.isdir():
                            yield self._member(m.name, m.size, m.isfile(), lambda m=m: tar.extractfile(m))
            else:
                with fs.open_input_file(at.path) as raw, zipfile.ZipFile(raw) as z:
                    for m in z.infolist():
                        if at.start <= m.header_offset < at.end and not m.is_dir():
                            yield self._member(m.filename, m.file_size, True, lambda m=m: z.open(m))
        except _BROKEN:
            yield None, None, "corrupt", None

    def _member(self, name: str, size: int, plain: bool, read) -> tuple:
        if unsafe(name) or not plain:
            return name, size, "unsafe", None
        with read() as f:
            content = f.read(self.largest + 1) if size <= self.largest else None  # a zip file's sizes may lie
        ok = content is not None and len(content) <= self.largest
        return name, size, "ok" if ok else "large", content if ok else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types, strict=True)], schema=_ARROW)


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    entries: int


class ArchiveWriter(DataSourceArrowWriter):
    """Rows (name, version, hash, content, manifest) as skills/name@version/SKILL.md and skill.yaml, with an index.json in each archive.

    Tasks write below a folder of the job's own, whose name readers pass over; the driver moves whole files out of it once all
    tasks are done, and else deletes it. A null content or manifest has no member.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.kind, self.overwrite, self.job = options["path"], options.get("kind", "tar.gz"), overwrite, uuid.uuid4().hex
        if self.kind not in ("tar.gz", "zip"):
            raise ValueError(f"no such kind of archive: {self.kind}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _open(self.path)
        fs.create_dir(f"{root}/_{self.job}", recursive=True)
        file, index = f"{root}/_{self.job}/{uuid.uuid4().hex}.{self.kind}", []
        out = None
        for batch in iterator:
            for r in batch.to_pylist():
                out = out or _Pack(fs.open_output_stream(file, compression=None), self.kind)
                folder = f"skills/{r['name']}@{r['version']}"
                for name, data in (("SKILL.md", r["content"]), ("skill.yaml", r["manifest"])):
                    if data is not None:
                        out.add(f"{folder}/{name}", bytes(data))
                index.append({k: r[k] for k in ("name", "version", "hash")})
        if out is None:
            return Written(None, 0)
        out.add("index.json", json.dumps(index, indent=2).encode())
        out.close()
        return Written(file, len(index))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(root)):
                if f.is_file:
                    fs.delete_file(f.path)
        for i, m in enumerate(m for m in messages if m and m.file):
            fs.move(m.file, f"{root}/part-{i:05d}-{self.job}.{self.kind}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _open(self.path)
        if fs.get_file_info(f"{root}/_{self.job}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/_{self.job}")


class _Pack:
    """An archive under way, with equal bytes for equal members."""

    def __init__(self, raw, kind: str):
        self.raw, self.zip, self.gz = raw, None, None
        if kind == "zip":
            self.zip = zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED)
        else:
            self.gz = gzip.GzipFile(fileobj=raw, mode="wb", mtime=0)
            self.tar = tarfile.open(fileobj=self.gz, mode="w|")

    def add(self, name: str, data: bytes) -> None:
        if self.zip:
            self.zip.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED)
        else:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            self.tar.addfile(info, io.BytesIO(data))

    def close(self) -> None:
        if self.zip:
            self.zip.close()
        else:
            self.tar.close()
            self.gz.close()
        self.raw.close()


class Archives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ArchiveWriter(self.options, overwrite)


def read_archives(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(Archives)
    return spark.read.format("archive").options(**options).load(path)


def export_archives(entries: DataFrame, path: str, kind: str = "tar.gz", overwrite: bool = False) -> DataFrame:
    """Write entries (name, version, hash, content, manifest) as archives under path; one row (skill_count, total_size) of what was written, the indexes not counted."""
    entries.sparkSession.dataSource.register(Archives)
    rows = entries.select("name", "version", "hash", F.col("content").cast("binary").alias("content"), F.col("manifest").cast("binary").alias("manifest"))
    rows.write.format("archive").option("kind", kind).mode("overwrite" if overwrite else "append").save(path)
    size = F.coalesce(F.octet_length("content"), F.lit(0)) + F.coalesce(F.octet_length("manifest"), F.lit(0))
    return rows.agg(F.count(F.lit(1)).alias("skill_count"), F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("total_size"))

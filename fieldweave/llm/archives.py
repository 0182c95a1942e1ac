"""Media columns: payloads as image members of ZIP archives, and a data source that reads them.

Writing: each task packs its rows as greyscale PNG files (8-bit samples, 192 a line, lossless) into
archives of bounded size in the shared folder. Reading: the data source ``media_archive`` lists the
archives, plans a partition for every byte range of them, and each task takes the members that begin
in its range from the archive's directory and streams them, by one open file, as Arrow batches of bounded size. A
member that can't be read is retried alone: the file is opened anew and the member's offset sought. One that stays
unreadable comes back with a null payload and the error's text; it never takes its neighbours with it. An archive that an
index lists has to be there with as many members as the index says; where it isn't, the read fails rather than lose rows.

Scale: both ways are maps without a shuffle; the driver sees the list of archives only, never their
members. An attempt that fails leaves an archive that no index row names, so reruns cannot double rows.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .scratch import new_path

#: Fixed values of the stored form.
UNIT, PAD, TAIL, SIGNATURE = 192, 32, 16, b"\x89PNG\r\n\x1a\n"
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES, TRIES = 64 << 20, 16 << 20, 4 << 20, 3
MEMBER_SCHEMA = "archive string, member string, doc_id long, n_bytes long, payload binary, media_bytes long, media_sha256 string, error string"
_OUT = pa.schema([("archive", pa.string()), ("member", pa.string()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("error", pa.string())])


def pad(data: bytes) -> bytes:
    """Filled with bytes 32 up to a positive multiple of 192."""
    return data + bytes([PAD]) * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_media(data: bytes) -> bytes:
    """The stored form of a payload; it depends on ``data`` alone."""
    lines = np.frombuffer(pad(data), np.uint8).reshape(-1, UNIT)
    rows = np.zeros((len(lines), UNIT + 1), np.uint8)  # each line starts with filter 0
    rows[:, 1:] = lines
    head = struct.pack(">IIBBBBB", UNIT, len(lines), 8, 0, 0, 0, 0)
    size = _chunk(b"tEXt", b"bytes\x00" + str(len(data)).encode())
    return SIGNATURE + _chunk(b"IHDR", head) + size + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode_media(media: bytes) -> tuple[int, bytes]:
    """Unpadded size and payload from the stored form; every checksum is compared."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, n, lines, packed = 8, None, None, b""
    while at < len(media):
        (length,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + length]
        if struct.pack(">I", zlib.crc32(kind + body)) != media[at + 8 + length : at + 12 + length]:
            raise ValueError(f"bad checksum in {kind!r}")
        if kind == b"IHDR":
            lines = struct.unpack(">II", body[:8])[1]
        elif kind == b"tEXt":
            n = int(body.partition(b"\x00")[2])
        elif kind == b"IDAT":
            packed += body
        at += 12 + length
    rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(lines, UNIT + 1)
    if rows[:, 0].any():
        raise ValueError("unknown line filter")
    return n, rows[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and the mean step between neighbours."""
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    seen = share[share > 0]
    step = np.abs(np.diff(x.astype(np.int16))).mean()
    values = {"lines": len(x) // UNIT, "mean": x.mean(), "std": x.std(), "entropy": -(seen * np.log2(seen)).sum(), "step": step}
    return json.dumps({k: v if isinstance(v, int) else round(float(v), 6) for k, v in values.items()})


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class _Archive:
    """A ZIP file of stored members being written to any file system that Arrow knows."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.zip"
        system, at = _open(self.path)
        self.sink = system.open_output_stream(at)
        self.zip, self.done, self.members = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED), 0, 0

    def add(self, doc_id: int | None, media: bytes) -> str:
        name = f"{self.members}-{'null' if doc_id is None else doc_id}.png"
        self.zip.writestr(zipfile.ZipInfo(name), media)
        self.members, self.done = self.members + 1, self.done + len(media)
        return name

    def close(self) -> None:
        self.zip.close()
        self.sink.close()


def write_archives(docs: DataFrame, folder: str, text: str = "text", key: str = "doc_id", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Store every text; the index ``archive, member`` has a row for each. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            index = []
            for doc_id, data in zip(batch.column(0), batch.column(1), strict=True):
                archive = archive or _Archive(folder)
                index.append((archive.path, archive.add(doc_id.as_py(), encode_media((data.as_py() or "").encode()))))
                if archive.done >= archive_bytes:
                    archive.close()
                    archive = None
            yield pa.RecordBatch.from_pydict({"archive": [a for a, _ in index], "member": [m for _, m in index]})
        if archive:
            archive.close()

    _open(folder)[0].create_dir(_open(folder)[1], recursive=True)
    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, "archive string, member string")


class ByteRange(InputPartition):
    """Members that begin in a range of an archive's bytes; ``members``: how many the whole archive has, if known."""

    def __init__(self, path: str, first: int, last: int, members: int | None = None):
        self.path, self.first, self.last, self.members = path, first, last, members


class MediaReader(DataSourceReader):
    """Byte ranges of all archives below ``path``; ``tries`` bounds the attempts at one member or directory.

    ``live`` may name a Parquet table whose columns ``archive, members`` say which archives count and how many
    members each has: others are leftovers of lost attempts. Without it, what is no whole archive is skipped.
    """

    def __init__(self, options: dict):
        self.path, self.live, self.range_bytes = options["path"], options.get("live"), int(options.get("rangebytes", RANGE_BYTES))
        self.batch_bytes, self.tries = int(options.get("batchbytes", BATCH_BYTES)), int(options.get("tries", TRIES))

    def partitions(self) -> list[InputPartition]:
        system, at = _open(self.path)
        scheme = self.path[: len(self.path) - len(at)]
        found = system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith(".zip"))
        members = {}
        if self.live:
            index_system, index = _open(self.live)
            for batch in ds.dataset(index, filesystem=index_system, format="parquet").to_batches(columns=["archive", "members"]):
                members.update(zip((n.rpartition("/")[2] for n in batch.column(0).to_pylist()), batch.column(1).to_pylist(), strict=True))
            files = [f for f in files if f[0].rpartition("/")[2] in members]
            if len(files) < len(members):
                raise OSError(f"{len(members) - len(files)} archives that {self.live} lists are not in {self.path}")
        return [ByteRange(scheme + p, a, min(a + self.range_bytes, size), members.get(p.rpartition("/")[2])) for p, size in files for a in range(0, size, self.range_bytes)]

    def _directory(self, system, part: ByteRange, at: str) -> list[zipfile.ZipInfo]:
        """Members of an archive; none of one that isn't whole, unless an index lists it."""
        for left in range(self.tries - 1, -1, -1):
            try:
                with system.open_input_file(at) as source:
                    if source.size() < zipfile.sizeEndCentDir:
                        raise zipfile.BadZipFile("too short")
                    found = zipfile.ZipFile(source).infolist()
                if part.members is not None and len(found) != part.members:
                    raise OSError(f"{part.path} has {len(found)} members instead of {part.members}")
                return found
            except (zipfile.BadZipFile, OSError) as e:
                if part.members is None and isinstance(e, zipfile.BadZipFile):  # an attempt that was lost before it closed its archive
                    return []
                if not left:
                    raise OSError(f"{part.path} can't be read: {e}") from e
        return []

    def read(self, part: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # there are no archives
            return
        system, at = _open(part.path)
        rows, size, source = [], 0, None
        for m in self._directory(system, part, at):
            if part.first <= m.header_offset < part.last:
                row, source = self._member(system, at, part.path, m, source)
                rows.append(row)
                size += len(row[4] or b"")
                if size >= self.batch_bytes:
                    yield self._batch(rows)
                    rows, size = [], 0
        if source:
            source.close()
        if rows:
            yield self._batch(rows)

    def _member(self, system, at: str, path: str, m: zipfile.ZipInfo, source) -> tuple:
        """The row of a member, and the open file for the next one; a try that fails opens the file anew."""
        owner = m.filename.partition("-")[2].removesuffix(".png")
        doc_id, error = None if owner == "null" else int(owner), ""
        for _ in range(self.tries):
            try:
                source = source or system.open_input_file(at)
                media = self._bytes_at(source, m)
                n, payload = decode_media(media)
                return (path, m.filename, doc_id, n, payload, len(media), hashlib.sha256(media).hexdigest(), None), source
            except (OSError, ValueError, zlib.error, struct.error) as e:
                error, source = f"{type(e).__name__}: {e}", None
        return (path, m.filename, doc_id, None, None, None, None, error), None

    @staticmethod
    def _bytes_at(source, m: zipfile.ZipInfo) -> bytes:
        """A stored member's bytes, by its offset alone."""
        source.seek(m.header_offset)
        head = source.read(30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("no member at this offset")
        source.seek(m.header_offset + 30 + sum(struct.unpack("<HH", head[26:30])))
        media = source.read(m.file_size)
        if zlib.crc32(media) != m.CRC:
            raise ValueError("the member's checksum differs")
        return media

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)


class MediaSource(DataSource):
    """``spark.read.format("media_archive").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return MEMBER_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return MediaReader({k.lower(): v for k, v in self.options.items()})


def read_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(MediaSource)
    return spark.read.format("media_archive").options(**options).load(folder)


def store_media(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every text stored and read back: the columns of the data source.

    Archives that a lost or a second attempt left are in no task's result, and are left out. A null text is an empty
    one, a null key stays null, repeated rows are members of their own, a text of any length is one member, columns of
    ``docs`` but these two are left out, whatever their names; an empty table stores nothing.
    """
    spark = docs.sparkSession
    folder, live = new_path(spark, "media"), new_path(spark, "live")
    write_archives(docs, folder, text, key).groupBy("archive").agg(F.count("*").alias("members")).write.parquet(live)
    return read_archives(spark, folder, live=live)


def query(spark, sf_dir: str) -> DataFrame:
    """``op3_media_columns``: sizes, digests and features of what was read back."""
    stored = store_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n, payload, size, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), size, digest, features(payload)))
            cols = zip(*rows, strict=True) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2 + [pa.string()] * 2, strict=True)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    whole = stored.select("doc_id", "n_bytes", F.when(F.col("error").isNull(), F.col("payload")).otherwise(F.raise_error(F.col("error")).cast("binary")).alias("payload"), "media_bytes", "media_sha256")
    return whole.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")

"""Media columns: payloads stored as 8-bit images in archives, read back by a data source.

``write_archives`` stores each payload as a grey 8-bit PNG, 64 samples a row, in ZIP archives in a shared folder.
``MediaArchives`` is a Spark data source over such a folder. The driver lists files and cuts them into byte ranges; a
task reads the directory at the end of its archive and takes the members that begin in its range, so that no list of
members passes through the driver. Payloads stream through Arrow in batches of bounded bytes. A member is read on its
own by its offset and checked against its checksum; if that fails, this member alone is read again.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from sitebrief.llm.common import schema_of, scratch

WIDTH = 64
SCHEMA = "doc_id long, n_bytes long, media binary"
TYPES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
_HEAD = b"\x89PNG\r\n\x1a\n"


# --- the stored form ----------------------------------------------------------------------------------------------

def padded(raw: bytes) -> bytes:
    """Bytes 0 are added up to a positive multiple of 64."""
    return raw + bytes(max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """A grey 8-bit image of 64 columns; the samples are the payload's bytes."""
    rows = len(payload) // WIDTH
    lines = bytearray(rows * (WIDTH + 1))  # each row begins with filter kind 0
    for i in range(WIDTH):
        lines[i + 1::WIDTH + 1] = payload[i::WIDTH]
    header = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return _HEAD + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines, 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    if media[:8] != _HEAD:
        raise ValueError("not an image of this form")
    at, data = 8, []
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8:at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged image")
        if kind == b"IDAT":
            data.append(body)
        at += size + 12
    lines = zlib.decompress(b"".join(data))
    out = bytearray(len(lines) // (WIDTH + 1) * WIDTH)
    for i in range(WIDTH):
        out[i::WIDTH] = lines[i + 1::WIDTH + 1]
    return bytes(out)


# --- writing ------------------------------------------------------------------------------------------------------

class _Counted(io.RawIOBase):
    """Lets zipfile write to a stream that cannot seek."""

    def __init__(self, out):
        self.out = out

    def writable(self):
        return True

    def write(self, data):
        self.out.write(bytes(data))
        return len(data)


def write_archives(df: DataFrame, folder: str, key: str = "doc_id", text: str = "text",
                   archive_bytes: int = 64 << 20) -> int:
    """Store each row's text (null: empty) as one member; returns the number of members.

    Each task writes archives of about ``archive_bytes``; a file gets its name when it is whole, so that what a lost
    or repeated task leaves behind is replaced or not seen. Rows with equal keys are separate members.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        store.create_dir(root, recursive=True)
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        opened, number, total = None, 0, 0

        def close():
            archive, out, temporary, name = opened
            archive.close()
            out.close()
            store.move(temporary, name)

        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if opened is None:
                    name = f"{root}/part-{part:06d}-{number:04d}.zip"
                    temporary = f"{root}/.writing-{part}-{number}-{attempt}"
                    out = store.open_output_stream(temporary)
                    opened, number, size = (zipfile.ZipFile(_Counted(out), "w"), out, temporary, name), number + 1, 0
                raw = (value or "").encode("utf-8", "surrogatepass")
                media = to_png(padded(raw))
                opened[0].writestr(zipfile.ZipInfo(f"{total}_{'' if doc_id is None else doc_id}_{len(raw)}.png"), media)
                total += 1
                size += len(media)
                if size >= archive_bytes:
                    close()
                    opened = None
        if opened is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["n"])

    return df.select(df[key].alias("doc_id"), df[text].alias("text")).mapInArrow(run, "n long").agg({"n": "sum"}).first()[0] or 0


# --- reading ------------------------------------------------------------------------------------------------------

class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


class MediaArchives(DataSource):
    """``spark.read.format("media_archives").load(folder)``; options: rangebytes, batchbytes, tries."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return MediaReader(self.options)


class MediaReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", 16 << 20))
        self.batch_bytes = int(options.get("batchbytes", 8 << 20))
        self.tries = int(options.get("tries", 4))

    def store(self):
        uri = self.folder if "://" in self.folder or self.folder.startswith("file:") else f"file://{self.folder}"
        return fs.FileSystem.from_uri(uri)

    def partitions(self) -> list[InputPartition]:
        """Byte ranges over the archives, from the file listing alone."""
        store, root = self.store()
        files = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        return [
            _Range(f.path, at, min(at + self.range_bytes, f.size))
            for f in sorted(files, key=lambda f: f.path)
            if f.type == fs.FileType.File and f.path.endswith(".zip")
            for at in range(0, f.size, self.range_bytes)
        ]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an empty folder is planned as one empty partition
            return
        store, _ = self.store()
        with store.open_input_file(partition.path) as f:
            members = [m for m in zipfile.ZipFile(f).infolist() if partition.start <= m.header_offset < partition.end]
        ids, sizes, media, held = [], [], [], 0
        for member in members:
            doc_id, n_bytes = member.filename[:-4].split("_")[1:]
            ids.append(int(doc_id) if doc_id else None)
            sizes.append(int(n_bytes))
            media.append(read_member(lambda: store.open_input_file(partition.path), member, self.tries))
            held += len(media[-1])
            if held >= self.batch_bytes:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip((ids, sizes, media), TYPES)], schema=TYPES)
                ids, sizes, media, held = [], [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip((ids, sizes, media), TYPES)], schema=TYPES)


def read_member(open_file, member: zipfile.ZipInfo, tries: int, wait: float = 0.2) -> bytes:
    """Read one member at its offset; on an error or a wrong checksum open the file anew and read this one again."""
    for attempt in range(tries):
        try:
            with open_file() as f:
                f.seek(member.header_offset)
                head = f.read(30)
                if len(head) < 30 or head[:4] != b"PK\x03\x04":
                    raise OSError("no member begins here")
                name, extra = struct.unpack_from("<HH", head, 26)
                f.seek(member.header_offset + 30 + name + extra)
                data = f.read(member.compress_size)
                if len(data) != member.file_size or zlib.crc32(data) != member.CRC:
                    raise OSError("wrong checksum")
                return data
        except OSError as e:
            if attempt + 1 == tries:
                raise OSError(f"member at {member.header_offset} cannot be read: {e}") from e
            time.sleep(wait * 2**attempt)
    raise OSError("no tries were allowed")


def media_columns(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """doc_id, n_bytes and the stored media of every member below a folder."""
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").options(**options).load(folder)


# --- features -----------------------------------------------------------------------------------------------------

def feature(payload: bytes) -> str:
    """Mean brightness of each quarter of the image and its number of distinct samples; whole numbers."""
    n = len(payload) // WIDTH
    cuts = [i * n // 4 * WIDTH for i in range(5)]
    means = [sum(payload[a:b]) // max(1, b - a) for a, b in zip(cuts, cuts[1:])]
    return ":".join(map(str, [*means, len(set(payload))]))


def media_digests(documents: DataFrame) -> DataFrame:
    """Store every text of ``documents`` as media, read the stored form back, and describe it.

    One row per row of the input, repeated rows and null ids included; a null or empty text is 64 bytes 0; other
    columns are ignored; an empty table gives no rows.
    """
    spark = documents.sparkSession
    folder = scratch(spark, "media")
    write_archives(documents, folder)
    out = schema_of("doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
                    "media_bytes long, media_sha256 string, feature string")
    types = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media in batch.column(2):
                media = media.as_py()
                payload = from_png(media)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]),
                             len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1)] + [pa.array(c, t.type) for c, t in zip(columns, list(types)[2:])], schema=types)

    return media_columns(spark, folder).mapInArrow(run, out)

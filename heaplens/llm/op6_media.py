"""Media columns: payloads as images in archives, read back by a custom Spark data source.

Each text's UTF-8 bytes, padded with spaces to a multiple of ``WIDTH``, are the samples of an 8-bit grey
PNG image of that width. Tasks pack images into archives; an archive is a row of members (magic, length,
CRC-32, image), then a directory of (doc_id, offset, length), then a footer. The data source reads only
directories' places to plan: it cuts every archive's members into byte ranges. A range streams its members
in Arrow batches; a member that cannot be read or fails its checksum is read again by its own offset, and
no other member with it.

Archives are written to the shared folder through pyarrow's file systems under names of their own for each
task attempt; only those that a successful task reports are in the manifest, so lost executors and repeated
tasks leave no wrong members.

Edge cases: null texts count as empty, which is one row of spaces; repeated rows and null or repeated
doc_ids (ties) are members like others, in no order; a very long text is one member, which its task holds
whole; further columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from heaplens.llm.common import Scratch, filesystem

#: Samples in a row of an image.
WIDTH = 192
#: Bytes of members in an archive, of a planned range, and of an Arrow batch.
ARCHIVE, RANGE, BATCH = 256 << 20, 16 << 20, 4 << 20
#: Partitions that are planned at most: beyond that many ranges, a partition has more bytes or several archives.
PLANNED = 20_000
#: Times that a member is read again.
RETRIES = 3
MEMBER, FOOTER = "<4sII", "<4sQQ"
MEMBER_SIZE, FOOTER_SIZE = struct.calcsize(MEMBER), struct.calcsize(FOOTER)
ENTRY = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("offset", "<u8"), ("length", "<u8")])
SCHEMA = "doc_id long, media binary"
#: Fixed value: the signature of PNG files.
PNG = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, its padded payload)."""
    raw = (text or "").encode()
    return len(raw), raw + b" " * (-len(raw) % WIDTH or (WIDTH if not raw else 0))


def to_png(n_bytes: int, payload: bytes) -> bytes:
    """An 8-bit grey image of the payload; n_bytes goes into a text chunk."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter 0 before each row
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"n_bytes\0%d" % n_bytes) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> tuple[int, bytes]:
    """(n_bytes, payload) of an image that to_png made; anything else is an error."""
    if image[:8] != PNG:
        raise ValueError("not a PNG image")
    at, n_bytes, data, height = 8, None, b"", 0
    while at < len(image):
        (length,), kind = struct.unpack_from(">I", image, at), image[at + 4 : at + 8]
        body = image[at + 8 : at + 8 + length]
        if at + 12 + length > len(image):
            raise ValueError("a chunk is cut off")
        if struct.unpack_from(">I", image, at + 8 + length)[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            width, height = struct.unpack_from(">II", body)
            if (width, body[8:]) != (WIDTH, b"\x08\0\0\0\0"):
                raise ValueError("not an image of this kind")
        elif kind == b"tEXt" and body.startswith(b"n_bytes\0"):
            n_bytes = int(body[8:])
        elif kind == b"IDAT":
            data += body
        at += 12 + length
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, WIDTH + 1)
    if n_bytes is None or lines[:, 0].any():
        raise ValueError("not an image of this kind")
    return n_bytes, lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean and deviation of the samples, an 8-bin histogram, and a hash of 64 blocks above or below the mean."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    level = np.arange(256)
    n, total, square = len(x), int((counts * level).sum()), int((counts * level * level).sum())
    bins = counts.reshape(8, 32).sum(1)
    rows = x.reshape(-1, WIDTH)
    cuts = [len(rows) * k // 8 for k in range(8)]
    sums = np.add.reduceat(rows.reshape(len(rows), 8, WIDTH // 8).sum(2, dtype=np.int64), cuts, 0)
    sizes = np.maximum(np.diff([*cuts, len(rows)]), 1)[:, None] * (WIDTH // 8)
    bits = (sums * n > total * sizes).ravel()
    code = int("".join("1" if b else "0" for b in bits), 2)
    return f"mean={total / n:.6f};var={(square - total * total / n) / n:.6f};hist={'/'.join(map(str, bins))};blocks={code:016x}"


def write_archives(docs: DataFrame, folder: str) -> DataFrame:
    """path, members, size, directory of each archive written below the folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = filesystem(folder)
        system.create_dir(base, recursive=True)
        out, entries, path, size = None, [], "", 0

        def close():
            table = np.array(entries, ENTRY)
            out.write(table.tobytes())
            out.write(struct.pack(FOOTER, b"MDIR", size, len(table)))
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "members": pa.array([len(table)], pa.int64()), "size": pa.array([size + table.nbytes + FOOTER_SIZE], pa.int64()), "directory": pa.array([size], pa.int64())})

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if out is None:
                    path, entries, size = f"{base}/{uuid.uuid4().hex}.mar", [], 0
                    out = system.open_output_stream(path)
                image = to_png(*payload_of(text.as_py()))
                out.write(struct.pack(MEMBER, b"MMBR", len(image), zlib.crc32(image)))
                out.write(image)
                entries.append((0 if doc is None else doc, doc is not None, size, MEMBER_SIZE + len(image)))
                size += MEMBER_SIZE + len(image)
                if size >= ARCHIVE:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "path string, members long, size long, directory long")


class Ranges(InputPartition):
    """Members of archives that begin at offsets from low to high: (path, directory, low, high) of each archive."""

    def __init__(self, pieces: list[tuple[str, int, int, int]]):
        self.pieces = pieces


def planned(archives: list[tuple[str, int]], size: int, most: int) -> list[Ranges]:
    """The archives' bytes in order, cut into partitions of about equal volume."""
    size = max(size, -(-sum(directory for _, directory in archives) // most))
    out, pieces, room = [], [], size
    for path, directory in archives:
        low = 0
        while low < directory:
            high = min(directory, low + room)
            pieces.append((path, directory, low, high))
            room -= high - low
            low = high
            if room == 0:
                out.append(Ranges(pieces))
                pieces, room = [], size
    return [*out, Ranges(pieces)] if pieces else out


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.manifest = options["folder"], options["manifest"]
        self.range, self.planned = int(options.get("range", RANGE)), int(options.get("planned", PLANNED))

    def partitions(self) -> list[Ranges]:
        system, base = filesystem(self.folder)
        with system.open_input_stream(f"{base}/{self.manifest}") as f:
            archives = json.loads(f.read())  # about 100 bytes for each ARCHIVE bytes
        return planned(archives, self.range, self.planned)

    def read(self, partition: Ranges | None) -> Iterator[pa.RecordBatch]:
        system, _ = filesystem(self.folder)
        for path, directory, low, high in partition.pieces if partition else ():  # None without archives
            yield from self._piece(system, path, directory, low, high)

    def _piece(self, system, path: str, directory: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
        end = system.get_file_info(path).size
        with system.open_input_file(path) as f:
            magic, at, count = struct.unpack(FOOTER, f.read_at(FOOTER_SIZE, end - FOOTER_SIZE))
            if magic != b"MDIR" or at != directory or end != directory + count * ENTRY.itemsize + FOOTER_SIZE:
                raise ValueError(f"{path}: not a whole archive")
            table = np.frombuffer(f.read_at(count * ENTRY.itemsize, directory), ENTRY)
        mine = table[(table["offset"] >= low) & (table["offset"] < high)]
        at = 0
        while at < len(mine):
            # As many members as fit into a batch, and one at least.
            upto = max(at + 1, int(np.searchsorted(mine["offset"] + mine["length"], mine["offset"][at] + BATCH, side="right")))
            yield self._batch(system, path, mine[at:upto])
            at = upto

    def _batch(self, system, path: str, entries: np.ndarray) -> pa.RecordBatch:
        low, high = int(entries["offset"][0]), int(entries["offset"][-1] + entries["length"][-1])
        try:
            with system.open_input_file(path) as f:
                data = f.read_at(high - low, low)
        except OSError:
            data = b""
        media = []
        for offset, length in zip(entries["offset"].tolist(), entries["length"].tolist(), strict=True):
            image = member(data[offset - low : offset - low + length])
            media.append(self._again(system, path, offset, length) if image is None else image)
        ids = [int(d) if known else None for d, known in zip(entries["doc_id"], entries["known"], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "media"])

    def _again(self, system, path: str, offset: int, length: int) -> bytes:
        """One member by its own offset."""
        cause: Exception | None = None
        for _ in range(RETRIES):
            try:
                with system.open_input_file(path) as f:
                    image = member(f.read_at(length, offset))
                if image is not None:
                    return image
            except OSError as e:
                cause = e
        raise OSError(f"{path}: the member at {offset} cannot be read") from cause


def member(data: bytes) -> bytes | None:
    """The image of a member, or None if it is damaged."""
    if len(data) < MEMBER_SIZE:
        return None
    magic, length, crc = struct.unpack_from(MEMBER, data)
    image = bytes(data[MEMBER_SIZE :])
    return image if magic == b"MMBR" and len(image) == length and zlib.crc32(image) == crc else None


class ArchiveSource(DataSource):
    """Format `media_archive`: options folder (of the archives) and manifest (a file name in it)."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, media: each text's image, stored in archives and read back."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "media")
    folder = f"{scratch.base}/archives"
    archives = scratch.table(write_archives(docs, folder), "manifest")
    system, base = filesystem(folder)
    system.create_dir(base, recursive=True)
    listed = [(r.path, r.directory) for r in archives.orderBy("path").toLocalIterator()]  # one for each ARCHIVE bytes
    with system.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps(listed).encode())
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").option("folder", folder).option("manifest", "manifest.json").load()


def media_features(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for image in b.column(1):
                image = image.as_py()
                n, payload = from_png(image)
                for c, v in zip(out, (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), feature(payload)), strict=True):
                    out[c].append(v)
            kinds = {c: pa.string() for c in ("payload_sha256", "media_sha256", "feature")}
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items())], ["doc_id", *out])

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")

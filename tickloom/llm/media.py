"""Media columns: content-addressed payloads in tar shards.

A text is stored as an 8-bit grey PNG of fixed width, in a member named by its digest. Rows carry digest,
shard, offset and length. Width and height come from range reads of the PNG's header alone; samples are
read back, shard by shard, only where features of them are asked for.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import shared_path, stored, whole_text

#: Samples of a line; a payload is padded with spaces to whole lines, one at least.
WIDTH = 192
#: A shard is closed once it is this long.
SHARD_BYTES = 64 << 20
#: Bytes of media that one task reads back.
TASK_BYTES = 64 << 20
#: Signature, and the header chunk with width, height, depth and kind: all that a header read takes.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33
LEVEL = 6


def payload_of(text: str) -> bytes:
    raw = text.encode()
    return raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b" ")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    height = len(payload) // WIDTH
    lines = np.zeros((height, WIDTH + 1), np.uint8)  # each line begins with its filter, 0 for none
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, WIDTH)
    header = struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def png_size(head: bytes) -> tuple[int, int]:
    """Width and height out of the first HEADER_BYTES."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">II", head[16:24])


def from_png(media: bytes) -> bytes:
    width, height = png_size(media[:HEADER_BYTES])
    at, data = len(SIGNATURE), b""
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        if kind == b"IDAT":
            data += media[at + 8 : at + 8 + n]
        at += 12 + n
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def features(samples: bytes, width: int, height: int) -> str:
    """Size, mean, deviation and entropy of the samples, and the share of lines that differ from the one above."""
    a = np.frombuffer(samples, np.uint8)
    p = np.bincount(a, minlength=256) / len(a)
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum()
    lines = a.reshape(height, width)
    new = (lines[1:] != lines[:-1]).any(axis=1).mean() if height > 1 else 1.0
    return f"{width}x{height};mean={a.mean():.3f};std={a.std():.3f};entropy={entropy:.4f};new={new:.3f}"


class _Shard:
    """One tar file under a name of its own, so a task that runs twice never writes to another's."""

    def __init__(self, folder: str):
        self.name = f"{uuid.uuid4().hex}.tar"
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path)
        self.out = store.open_output_stream(f"{path}/{self.name}")
        self.tar = tarfile.open(fileobj=self.out, mode="w|", format=tarfile.USTAR_FORMAT)  # noqa: SIM115

    def add(self, digest: str, media: bytes) -> int:
        """The offset of the member's bytes."""
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(media)
        at = self.tar.offset + tarfile.BLOCKSIZE
        self.tar.addfile(info, io.BytesIO(media))
        return at

    def close(self) -> None:
        self.tar.close()
        self.out.close()


def store(docs: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the payloads below ``folder`` (a URI) and return the index: doc_id, n_bytes, digest, shard,
    offset, length. A task stores equal payloads once; of payloads that several tasks stored, the index
    names one place. The index is written before it is used, so it never points to a lost attempt."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, there = None, {}
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                payload = payload_of(text)
                digest = hashlib.sha256(payload).hexdigest()
                if digest not in there:
                    if shard and shard.tar.offset >= shard_bytes:
                        shard.close()
                        shard, there = None, {}
                    shard = shard or _Shard(folder)
                    media = to_png(payload)
                    there[digest] = (shard.name, shard.add(digest, media), len(media))
                rows.append((doc_id, len(text.encode()), digest, *there[digest]))
            out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
            yield out.astype({"doc_id": "Int64"})
        if shard:
            shard.close()

    schema = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"
    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInPandas(pack, schema), "media-index")


def addresses(index: DataFrame) -> DataFrame:
    """One place per digest: digest, shard, offset, length. Combined before it shuffles."""
    place = F.min(F.struct("shard", "offset", "length")).alias("p")
    return index.groupBy("digest").agg(place).select("digest", "p.*")


def _by_shard(places: DataFrame, folder: str, row, schema: str) -> DataFrame:
    """Range reads of every place, in order within its shard; ``row`` gets the file, its name, offset and length and gives columns."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store_, path = fs.FileSystem.from_uri(folder)
        for pdf in batches:
            out = []
            for name, part in pdf.sort_values(["shard", "offset"]).groupby("shard"):
                with store_.open_input_file(f"{path}/{name}") as f:
                    for digest, offset, length in zip(part["digest"], part["offset"], part["length"], strict=True):
                        out.append((digest, *row(f, name, int(offset), int(length))))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return places.mapInPandas(read, schema)


def spread(places: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Places in ranges of (shard, offset), as many as their media need for ``task_bytes`` each."""
    total = places.agg(F.sum("length")).first()[0] or 0
    return places.repartitionByRange(max(1, -(-total // task_bytes)), "shard", "offset")


def headers(places: DataFrame, folder: str) -> DataFrame:
    """digest, width, height: HEADER_BYTES of each member are read and no sample."""
    return _by_shard(places, folder, lambda f, _, at, n: png_size(f.read_at(HEADER_BYTES, at)), "digest string, width long, height long")


def samples(places: DataFrame, folder: str) -> DataFrame:
    """digest, where it is, its size by its header, and what is computed of the bytes read back."""

    def row(f, name: str, at: int, n: int):
        size = png_size(f.read_at(HEADER_BYTES, at))
        media = f.read_at(n, at)
        got = from_png(media)
        sums = len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-16:]), hashlib.sha256(media).hexdigest()
        return (name, at, n, *size, *sums, features(got, *size))

    schema = "digest string, shard string, offset long, length long, width long, height long, payload_bytes long, payload_sha256 string, "
    return _by_shard(places, folder, row, schema + "tail_crc32 long, media_sha256 string, feature string")


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Per document: doc_id, n_bytes, the payload read back (payload_bytes, payload_sha256, tail_crc32), the
    stored form (media_bytes, media_sha256), feature, and its address (shard, offset, width, height).

    Null and empty texts are one line of spaces. Equal texts share one member and all values; repeated
    rows and null ids stay as they are. An empty table writes no shard and gives no rows. Columns other
    than doc_id and text are not read. ``folder`` is a URI that all executors reach; by default one below
    spark.checkpoint.dir.
    """
    spark: SparkSession = docs.sparkSession
    folder = folder or shared_path(spark, "media")
    folder = folder if ":/" in folder else f"file://{folder}"
    index = store(docs, folder)
    # Members of a shard are spread over tasks by the bytes of media, so a large shard is not one task.
    places = stored(addresses(index), "media-places")
    found = samples(spread(places), folder)
    rows = index.select("doc_id", "n_bytes", "digest").hint("merge").join(found, "digest")
    return rows.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.col("length").alias("media_bytes"), "media_sha256", "feature", "shard", "offset", "width", "height",
    )

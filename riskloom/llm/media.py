"""Media columns: content-addressed payloads in tar shards.

A payload is stored as an 8-bit greyscale PNG, 64 samples wide, which is lossless.
Every task writes its payloads to tar shards of its own in the shared folder, one
member for each content (named by its SHA-256 digest), and its rows carry shard,
digest, offset and length. One place is chosen for each digest over all shards,
so equal contents share one address; the few copies that other tasks also wrote
are not addressed. A shard's name holds the attempt that wrote it: a lost task
writes new shards, and only those of the attempt whose rows count are addressed.

Metadata columns are read from the stored file's header by a range read of
``HEADER`` bytes; payload columns by a range read of the member. What is read must
have the digest that it is addressed by, or the read fails. Besides the shards only
the rows with their addresses are stored; columns go from the read to the rows.

Results for odd input: a null text is an empty payload of 64 zero bytes; repeated
rows share an address and each get a row; an empty table gives an empty result.
Columns besides ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.base import slices
from riskloom.scratch import Scratch

WIDTH, HEADER = 64, 33
SHARD_BYTES = 256 << 20
PNG = b"\x89PNG\r\n\x1a\n"


def padded(text: str) -> bytes:
    raw = text.encode()
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line starts with filter type 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a sample."""
    if head[:8] != PNG or head[12:16] != b"IHDR":
        raise ValueError("not a PNG file")
    return struct.unpack(">IIB", head[16:25])


def from_png(data: bytes) -> bytes:
    width, height, _ = png_header(data)
    at, body = 8, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + n])
        at += n + 12
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("a filtered line")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples and a 64-bit sketch of the column means."""
    samples = np.frombuffer(payload, np.uint8)
    share = np.bincount(samples, minlength=256) / len(samples)
    entropy = -sum(p * np.log2(p) for p in share[share > 0].tolist())
    column = samples.reshape(-1, WIDTH).sum(axis=0, dtype=np.int64)
    bits = np.packbits(column * WIDTH > column.sum())
    return f"mean={samples.mean():.4f};std={samples.std():.4f};entropy={entropy:.4f};sketch={bits.tobytes().hex()}"


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:/"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


class Shards:
    """Tar shards of one task."""

    def __init__(self, root: str):
        self._fs, self._root = open_store(root)
        self._fs.create_dir(self._root, recursive=True)
        task = TaskContext.get()
        self._name, self._n, self._tar, self._out = f"{task.partitionId():06d}-{task.taskAttemptId()}", 0, None, None
        self._known: dict[bytes, tuple[str, int, int]] = {}

    def put(self, digest: bytes, payload: bytes) -> tuple[str, int, int]:
        """Shard, offset and length of the content."""
        if digest not in self._known:
            if self._tar is None or self._out.tell() > SHARD_BYTES:
                self.close()
                self._shard = f"{self._name}-{self._n:04d}.tar"
                self._out = self._fs.open_output_stream(f"{self._root}/{self._shard}")
                self._tar = tarfile.open(fileobj=self._out, mode="w|", format=tarfile.GNU_FORMAT, bufsize=1 << 20)
                self._n, self._at = self._n + 1, 0
            data, info = to_png(payload), tarfile.TarInfo(f"{digest.hex()}.png")
            info.size = len(data)
            import io

            self._tar.addfile(info, io.BytesIO(data))
            self._known[digest] = (self._shard, self._tar.offset - (len(data) + -len(data) % 512), len(data))
        return self._known[digest]

    def close(self) -> None:
        if self._tar:
            self._tar.close()
            self._out.close()
            self._tar = None


def write_shards(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = None
        for b in slices(batches, "text"):
            shards = shards or Shards(root)
            payloads = [padded(t) for t in b.column("text").to_pylist()]
            digests = [hashlib.sha256(p).digest() for p in payloads]
            at = [shards.put(d, p) for d, p in zip(digests, payloads, strict=True)]
            cols = [b.column("doc_id"), b.column("n_bytes"), pa.array(digests, pa.binary())]
            cols += [pa.array([x[i] for x in at], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        if shards:
            shards.close()

    return run


def store(docs: DataFrame, root: str) -> DataFrame:
    """doc_id, n_bytes, digest, shard, offset, length; write it before it is used, as it writes the shards."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(write_shards(root), "doc_id long, n_bytes long, digest binary, shard string, offset long, length long")


def read_columns(root: str):
    """Columns of stored members: rows come by shard and offset. digest is that of what was read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = open_store(root)
        name, source = None, None
        for f in frames:
            out = []
            for digest, shard, offset, length in zip(f["digest"], f["shard"], f["offset"], f["length"], strict=True):
                if shard != name:
                    if source:
                        source.close()
                    name, source = shard, fs.open_input_file(f"{base}/{shard}")
                width, height, bits = png_header(source.read_at(HEADER, offset))
                data = source.read_at(length, offset)
                payload = from_png(data)
                found = hashlib.sha256(payload).digest()
                if found != digest:
                    raise ValueError(f"{shard} holds another content at {offset}")
                out.append((found, width, height, bits, len(payload), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).digest(), feature(payload), shard, offset, length))
            yield pd.DataFrame(out, columns=COLUMNS)
        if source:
            source.close()

    return run


READ = "digest binary, width int, height int, sample_bits int, payload_bytes long, tail_crc32 long, media_bytes long, media_digest binary, feature string, shard string, offset long, length long"
COLUMNS = [c.split()[0] for c in READ.split(", ")]


def media_columns(docs: DataFrame) -> DataFrame:
    """Every row with its address and the columns read back from there, anew by each action on the result."""
    scratch = Scratch(docs.sparkSession, "media")
    root = scratch.path("shards")
    rows = scratch.put(store(docs, root), "rows")
    chosen = rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")
    # a shard's members are read in order by one task; shards are of bounded size
    members = chosen.repartition("shard").sortWithinPartitions("shard", "offset")
    # addresses go through the read and digests are hexadecimal last, which spares a join and bytes
    read = members.mapInPandas(read_columns(root), READ)
    out = rows.select("doc_id", "n_bytes", "digest").join(read, "digest")
    return out.select(
        "doc_id", "n_bytes", "width", "height", "sample_bits", "payload_bytes", F.lower(F.hex("digest")).alias("payload_sha256"), "tail_crc32",
        "media_bytes", F.lower(F.hex("media_digest")).alias("media_sha256"), "feature", "shard", "offset", "length",
    )

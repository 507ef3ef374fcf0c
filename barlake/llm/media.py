"""Media columns: content-addressed payloads in tar shards.

A document's bytes, padded with zeros to a positive multiple of 64, are the
samples of an 8-bit grey PNG 64 pixels wide, one row for each 64 bytes.  The
digest of the text's bytes is the address: distinct content is stored once, and
rows carry shard, offset and length.  Width, height and bit depth are read back from the first 33 bytes
alone (``header_columns`` makes range reads and no others); the other features
from the stored member.

Of rows with one digest the smallest doc_id (none counts as the smallest) stands
for all: only digests and ids are shuffled to find it.  Texts stay where they are
read, but for those of contents that several rows have, of which the rows of that
id are reduced to one: each task writes its contents as tar shards of about ``SHARD_BYTES``,
under temporary names that become the shards' names when they are complete, so
a repeated task leaves the same shards.  The index of the shards is a written table, from which the
columns are read back shard by shard.

Null text is stored as empty text (64 zero bytes); equal texts share all values.
Every input row is returned, repeated ones and rows without id too; a content
that only rows without id have is stored like any other.  A text is held in
memory whole.  Further columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SharedFile, new_folder, stored
from .words import row_slices, text_buffer

UNIT = 64
#: Digests and ids are sent to all executors up to this size, at ROW_BYTES a row with its hash entry; beyond it rows are shuffled.
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 100
HEADER_BYTES = 33
#: A tar shard ends with the member that reaches this size.
SHARD_BYTES = 256 << 20
#: Shards of one task have numbers of their own.
SHARDS_A_TASK = 1 << 20
# Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(content: bytes) -> bytes:
    """A grey 8-bit PNG of the padded content."""
    padded = content + bytes(-len(content) % UNIT if content else UNIT)
    rows = np.frombuffer(padded, np.uint8).reshape(-1, UNIT)
    lines = np.zeros((len(rows), UNIT + 1), np.uint8)  # filter type 0 before each row
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 3)) + _chunk(b"IEND", b"")


def header(first: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first bytes of a file."""
    if first[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    return struct.unpack(">IIB", first[16:25])


def decode(media: bytes) -> bytes:
    """The payload: all samples, row by row."""
    width, height, _ = header(media)
    at, body = 8, []
    while at < len(media):
        n = struct.unpack(">I", media[at : at + 4])[0]
        if media[at + 4 : at + 8] == b"IDAT":
            body.append(media[at + 8 : at + 8 + n])
        at += n + 12
    return np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def _writer(folder: str, limit: int):
    """Writes a partition's contents as shards; gives (shard, digest, n_bytes, offset, length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, at, out = TaskContext.get().partitionId() * SHARDS_A_TASK, 0, None
        for batch in batches:
            digests = batch.column(0).to_pylist()
            data, offsets = text_buffer(batch.column(1))
            for a, b in row_slices(offsets, 4 << 20):
                rows = []
                for i in range(a, b):
                    if at >= limit:
                        out.write(bytes(1024))
                        out.close()
                        shard, at, out = shard + 1, 0, None
                    if out is None:
                        out = SharedFile(f"{folder}/{shard}.tar")
                    content = data[offsets[i] : offsets[i + 1]].tobytes()
                    media = encode(content)
                    info = tarfile.TarInfo(f"{digests[i].hex()}.png")
                    info.size = len(media)
                    head = info.tobuf(tarfile.USTAR_FORMAT)
                    out.write(head)
                    out.write(media)
                    out.write(bytes(-len(media) % 512))
                    rows.append((shard, digests[i], len(content), at + len(head), len(media)))
                    at += len(head) + len(media) + -len(media) % 512
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in rows], t) for j, t in enumerate(kinds)], ["shard", "digest", "n_bytes", "offset", "length"])
        if out is not None:
            out.write(bytes(1024))
            out.close()

    return run


def _reader(folder: str):
    """Header columns by range reads, then the features of the stored member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            out = []
            for shard, digest, n_bytes, offset, length in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if shard != name:
                    fs, path = pa.fs.FileSystem.from_uri(f"{folder}/{shard}.tar")
                    file, name = fs.open_input_file(path), shard
                width, height, depth = header(file.read_at(HEADER_BYTES, offset))
                media = file.read_at(length, offset)
                payload = decode(media)
                samples = np.frombuffer(payload, np.uint8)
                levels = np.bincount(samples >> 5, minlength=8)
                feature = f"{width}x{height}x{depth};mean={samples.mean():.6f};levels=" + "/".join(map(str, levels.tolist()))
                out.append(
                    (digest, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), length, hashlib.sha256(media).hexdigest(), feature, shard, offset, width, height, depth)
                )
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), KINDS, strict=True)], NAMES)

    return run


NAMES = ["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard", "media_offset", "width", "height", "bit_depth"]
KINDS = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
_DDL = {pa.binary(): "binary", pa.string(): "string", pa.int64(): "long", pa.int32(): "int"}


def header_columns(places: DataFrame) -> DataFrame:
    """``places`` (media_uri, media_offset) with width, height and bit_depth, from one range read of 33 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            out = []
            for uri, offset in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if uri != name:
                    fs, path = pa.fs.FileSystem.from_uri(uri)
                    file, name = fs.open_input_file(path), uri
                out.append(header(file.read_at(HEADER_BYTES, offset)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([x[i] for x in out], pa.int32()) for i in range(3))], ["media_uri", "media_offset", "width", "height", "bit_depth"])

    places = places.select("media_uri", "media_offset").sortWithinPartitions("media_uri", "media_offset")
    return places.mapInArrow(run, "media_uri string, media_offset long, width int, height int, bit_depth int")


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id and the media columns for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    folder = new_folder(spark, "media")
    # one row of each content is written: of rows without id, and of rows equal in id and text, those with the least number
    keys = stored(docs.select("digest", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id")), "digests")
    first = keys.groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    # contents of several rows; a few of the corpus as a rule, else they are shuffled
    several = stored(first.where("n > 1").select("digest", "id"), "others")
    several = F.broadcast(several) if several.count() * ROW_BYTES <= BROADCAST_BYTES else several
    known = docs.withColumn("_id", F.coalesce("doc_id", F.lit(-(1 << 63)))).join(several.withColumn("_several", F.lit(True)), "digest", "left")
    alone = known.where("_several is null").select("digest", "text")
    # of the others the rows of the least id, equal in it and so in all that is stored: one stays
    shared = known.where("_several and _id = id").select("digest", "text").dropDuplicates(["digest"])
    own = alone.unionByName(shared)
    written = stored(own.mapInArrow(_writer(folder, SHARD_BYTES), "shard long, digest binary, n_bytes long, offset long, length long"), "media-index")
    index = written.select("shard", "digest", "n_bytes", "offset", "length")
    shards = max(1, written.agg(F.countDistinct("shard")).first()[0])
    index = index.repartition(shards, "shard").sortWithinPartitions("shard", "offset")
    ddl = ", ".join(f"{name} {_DDL[kind]}" for name, kind in zip(NAMES, KINDS, strict=True))
    columns = stored(index.mapInArrow(_reader(folder), ddl), "media-columns")
    return docs.select("doc_id", "digest").join(columns, "digest").withColumn("media_uri", F.concat(F.lit(folder + "/"), F.col("shard"), F.lit(".tar"))).select("doc_id", F.lower(F.hex("digest")).alias("digest"), *NAMES[1:], "media_uri").drop("shard")

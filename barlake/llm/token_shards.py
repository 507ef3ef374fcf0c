"""Training-order materialisation of token sequences in fixed-stride shards.

1.  Each input partition is tokenised; its texts, each followed by an end id,
    are packed into sequences of ``length`` ids (the partition's last one is
    padded).  A sequence is known by its partition and its number there, and
    the counts by partition, a few bytes each, give it a global index 0 .. n-1.
    The split of the input thus belongs to the key of the order, like the seed;
    both are written to ``manifest.json`` beside the shards.
2.  A keyed Feistel network permutes the least even number of bits that holds
    n; cycle-walking (encrypting again while the value is n or more) restricts
    it to 0 .. n-1.  The result is the sequence's slot in the training order:
    a bijection that any reader can evaluate or invert without a table.
3.  Slots are dealt by range, one shard to a task; shard s holds slots
    s * per_shard onward at ``stride`` bytes each, so a reader that stopped at
    slot t resumes with one seek (``read_from``).  Shards are written in
    ``waves`` of consecutive ranges, so that shuffle files stand for a part of
    the tokens only; a repeated task writes the same bytes to the same name.

Texts are split into pieces by the tokenizer's own pattern, evaluated for whole
columns with numpy.  Pieces are told apart by a 64-bit hash of their bytes and
length; only pieces that a worker's bounded table lacks are decoded and encoded.

Null or empty text: only the end id.  A null id stands as null in ``doc_ids``.
Repeated rows, with equal ids or not, stay, each with its tokens.  A text of any
length is cut into as many sequences as it fills; its slice is held in memory
whole.  Further columns are not read.  No rows: no shards and a manifest of 0.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SharedFile, dropped, new_folder, stored
from .words import row_slices, span_hashes, text_buffer

LENGTH = 2048
PER_SHARD = 8192
WAVES = 4
ROUNDS = 6
SEED = 20240601
#: Encoded pieces that a worker keeps (about 40 bytes each).
PIECES = 1 << 19


# --- the permutation -------------------------------------------------------


def _round(x: np.ndarray, key: int, mask: int) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) & np.uint64(mask)


def feistel(values: np.ndarray, n: int, seed: int = SEED, inverse: bool = False) -> np.ndarray:
    """The keyed permutation of 0 .. n-1 applied to ``values``."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    keys = np.random.default_rng(seed).integers(0, 1 << 63, ROUNDS).tolist()
    out = np.asarray(values, np.uint64).copy()
    walk = np.arange(len(out))
    while len(walk):
        left, right = out[walk] >> np.uint64(half), out[walk] & np.uint64(mask)
        for key in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ _round(left, key, mask), left
            else:
                left, right = right, left ^ _round(right, key, mask)
        out[walk] = (left << np.uint64(half)) | right
        walk = walk[out[walk] >= n]
    return out.astype(np.int64)


# --- tokens ----------------------------------------------------------------


@lru_cache(None)
def _encoder(path: str, pattern: str):
    import tiktoken

    fs, at = pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)
    with fs.open_input_stream(at) as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


_classes: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    """Code point to 1 letter, 2 number, 3 white space, 4 other, as the pattern sees them."""
    if not _classes:
        import regex

        table = np.full(0x110000, 4, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, every):
                a, b = ord(every[m.start()]), ord(every[m.end() - 1]) + 1
                if a < 0xD800 <= b:
                    table[a:0xD800] = kind
                    table[0xE000:b] = kind
                else:
                    table[a:b] = kind
        _classes.append(table)
    return _classes[0]


def piece_starts(points: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where pieces begin: bool for each code point; ``rows`` are the row bounds.

    The pattern: contractions ('s 't 're 've 'm 'll 'd), an optional space and
    letters, or numbers, or others, and white space without its last character
    if text follows.
    """
    n = len(points)
    kind = _class_table()[points]
    head = np.zeros(n + 1, bool)
    head[rows] = True
    begin = head[:n].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    white = kind == 3
    last_white = white.copy()
    last_white[:-1] &= ~white[1:] | head[1:n]
    follows = np.zeros(n, bool)
    follows[:-1] = ~head[1:n] & ~white[1:]
    last_white &= follows
    begin[last_white] = True  # white space before text gives up its last character
    glue = last_white & (points == 0x20)  # which, if a space, belongs to the text
    begin[1:][glue[:-1]] = False
    # contractions: an apostrophe that begins a piece and is followed by its letters
    for a in np.flatnonzero((points == 0x27) & begin).tolist():
        end = int(rows[np.searchsorted(rows, a, side="right")])
        tail = "".join(map(chr, points[a + 1 : min(a + 3, end)].tolist()))
        size = 1 if tail[:1] in ("s", "t", "m", "d") and tail else 2 if tail in ("re", "ve", "ll") else 0
        if size:
            begin[a + 1] = False
            if a + 1 + size < end:
                begin[a + 1 + size] = True
    return begin


class Tokenizer:
    """Ids of whole columns for one rank file, with the piece pattern below."""

    # Fixed value: the pattern that belongs to the rank file.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        self.path = path
        # encoded pieces: sorted hashes, and where their ids lie in ``ids``
        self.keys, self.first, self.sizes, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def __reduce__(self):
        return Tokenizer, (self.path,)

    def _learn(self, keys: np.ndarray, pieces: list[str], needed: np.ndarray) -> None:
        """Adds pieces; a full table is first cut down to those needed now."""
        if len(self.keys) + len(keys) > PIECES:
            p = np.flatnonzero(np.isin(self.keys, needed, assume_unique=True))
            n, ends = self.sizes[p], np.cumsum(self.sizes[p])
            self.ids = self.ids[np.repeat(self.first[p] - (ends - n), n) + np.arange(int(n.sum()))]
            self.keys, self.sizes, self.first = self.keys[p], n, ends - n
        coded = list(map(_encoder(self.path, self.PATTERN).encode_ordinary, pieces))
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        at = np.searchsorted(self.keys, keys)
        self.first = np.insert(self.first, at, len(self.ids) + np.cumsum(sizes) - sizes)
        self.keys, self.sizes = np.insert(self.keys, at, keys), np.insert(self.sizes, at, sizes)
        self.ids = np.concatenate((self.ids, np.fromiter((i for x in coded for i in x), np.uint32, int(sizes.sum()))))

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, and each row's bounds in them."""
        part = data[int(offsets[0]) : int(offsets[-1])]
        if not len(part):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        bounds = offsets - offsets[0]
        heads = np.flatnonzero((part & 0xC0) != 0x80)  # first byte of each code point
        points = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        starts = heads[piece_starts(points, np.searchsorted(heads, bounds))]
        ends = np.append(starts[1:], len(part))
        keys, first, which = np.unique(span_hashes(part, starts, ends), return_index=True, return_inverse=True)
        p = np.searchsorted(self.keys, keys)
        new = np.flatnonzero(np.append(self.keys, 0)[p] != keys if len(self.keys) else np.ones(len(keys), bool))
        if len(new):
            at = first[new]
            self._learn(keys[new], [part[a:b].tobytes().decode("utf-8") for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], keys)
            p = np.searchsorted(self.keys, keys)
        n = self.sizes[p][which]
        stop = np.cumsum(n)
        ids = self.ids[np.repeat(self.first[p][which] - (stop - n), n) + np.arange(int(stop[-1]))]
        return ids, np.concatenate(([0], stop))[np.searchsorted(starts, bounds)]


def _packer(tokenizer: Tokenizer, length: int, end_id: int, kind: np.dtype):
    """(part, number, ids, n_ids, doc_ids): sequences of one partition, ids compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        rest, rest_docs, rest_ends = np.zeros(0, kind), [], np.zeros(0, np.int64)  # ids left to place, of which documents
        squeeze = zstandard.ZstdCompressor(level=3)

        def cut(ids: np.ndarray, docs: list, ends: np.ndarray, final: bool) -> pa.RecordBatch:
            nonlocal number, rest, rest_docs, rest_ends
            ids, docs, ends = np.concatenate((rest, ids)), rest_docs + docs, np.concatenate((rest_ends, ends + len(rest)))
            n = len(ids) // length + (final and len(ids) % length > 0)
            padded = np.concatenate((ids, np.full(max(0, n * length - len(ids)), end_id, kind)))
            edges = np.arange(n + 1) * length
            low, high = np.searchsorted(ends, edges[:-1], side="right").tolist(), np.searchsorted(ends, edges[1:], side="left").tolist()
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * n, pa.int32()), pa.array(range(number, number + n), pa.int64()), pa.array([squeeze.compress(padded[a : a + length]) for a in edges[:-1].tolist()], pa.binary()),
                    pa.array(np.minimum(edges[1:], len(ids)) - edges[:-1], pa.int32()), pa.array([docs[a : b + 1] for a, b in zip(low, high, strict=True)], pa.list_(pa.int64())),
                ],
                ["part", "number", "ids", "n_ids", "doc_ids"],
            )
            number += n
            done = int(np.searchsorted(ends, n * length, side="right"))
            rest, rest_docs, rest_ends = ids[n * length :], docs[done:], ends[done:] - n * length
            return out

        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            owners = batch.column(0).to_pylist()
            for a, b in row_slices(offsets):
                ids, bounds = tokenizer.rows(data, offsets[a : b + 1])
                yield cut(np.insert(ids, bounds[1:], end_id).astype(kind), owners[a:b], bounds[1:] + np.arange(1, b - a + 1), False)
        yield cut(np.zeros(0, kind), [], np.zeros(0, np.int64), True)

    return run


def _shard_writer(folder: str, length: int, per_shard: int, kind: np.dtype):
    """Writes each shard's sequences, which arrive in order of their slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out = None, None
        unpack = zstandard.ZstdDecompressor()
        stride = length * kind.itemsize
        for batch in batches:
            slots, sums = batch.column(0).to_numpy(), []
            for shard, ids in zip((slots // per_shard).tolist(), batch.column(1).to_pylist(), strict=True):
                if shard != name:
                    if out is not None:
                        out.close()
                    name, out = shard, SharedFile(f"{folder}/{shard:08d}.bin")
                raw = unpack.decompress(ids)
                out.write(raw)
                sums.append(zlib.crc32(raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(slots // per_shard), pa.array(slots % per_shard * stride), pa.array(sums, pa.int64()), *batch.columns[2:]], ["slot", "shard", "byte_offset", "crc32", "n_ids", "doc_ids"])
        if out is not None:
            out.close()

    return run


def materialise(docs: DataFrame, tokenizer: str, end_id: int = 50256, vocabulary: int = 50257, length: int = LENGTH, per_shard: int = PER_SHARD, waves: int = WAVES, seed: int = SEED) -> DataFrame:
    """One row a sequence: slot, shard, byte_offset, crc32, n_ids, doc_ids, uri.

    ``docs`` has doc_id and text; ``tokenizer`` is the path of a rank file that
    all executors can read.
    """
    spark = docs.sparkSession
    kind = np.dtype(np.uint16 if vocabulary <= 1 << 16 else np.uint32)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = docs.mapInArrow(_packer(Tokenizer(tokenizer), length, end_id, kind), "part int, number long, ids binary, n_ids int, doc_ids array<long>")
    packed = stored(packed, "sequences")
    counts = packed.groupBy("part").agg(F.count("*").alias("n")).toArrow()  # one row an input partition
    per_part = np.zeros(max(counts["part"].to_pylist(), default=-1) + 1, np.int64)
    per_part[counts["part"].to_numpy()] = counts["n"].to_numpy()
    n = int(per_part.sum())
    starts = np.cumsum(per_part) - per_part
    folder = new_folder(spark, "tokens")
    manifest = SharedFile(f"{folder}/manifest.json")
    manifest.write(json.dumps({"sequences": n, "length": length, "per_shard": per_shard, "id_bytes": kind.itemsize, "end_id": end_id, "seed": seed, "parts": per_part.tolist()}).encode())
    manifest.close()

    @F.arrow_udf("long")
    def slot_of(part: pa.Array, number: pa.Array) -> pa.Array:
        return pa.array(feistel(starts[part.to_numpy()] + number.to_numpy(), n, seed))

    slot_of = slot_of.asNondeterministic()  # it is not; else the filter below would compute it once more
    n_shards = -(-n // per_shard)
    out = []
    for wave in range(waves := max(1, min(waves, n_shards))):
        low, high = n_shards * wave // waves, n_shards * (wave + 1) // waves
        # only part and number go to Python; every task gets one shard
        own = packed.select(slot_of("part", "number").alias("slot"), "ids", "n_ids", "doc_ids").where((F.col("slot") >= low * per_shard) & (F.col("slot") < high * per_shard))
        ordered = own.repartitionById(max(1, high - low), (F.expr(f"slot div {per_shard}") - low).cast("int")).sortWithinPartitions("slot")
        out.append(stored(ordered.mapInArrow(_shard_writer(folder, length, per_shard, kind), "slot long, shard long, byte_offset long, crc32 long, n_ids int, doc_ids array<long>"), "shard-index"))
    dropped(packed)
    return reduce(DataFrame.union, out).withColumn("uri", F.concat(F.lit(folder + "/"), F.lpad(F.col("shard").cast("string"), 8, "0"), F.lit(".bin")))


def read_from(folder: str, slot: int = 0) -> Iterator[np.ndarray]:
    """The sequences of a folder in training order from ``slot`` on: one seek, then sequential reads."""
    fs, at = pa.fs.FileSystem.from_uri(folder)
    with fs.open_input_stream(f"{at}/manifest.json") as f:
        known = json.loads(f.read())
    stride, per_shard = known["length"] * known["id_bytes"], known["per_shard"]
    while slot < known["sequences"]:
        with fs.open_input_file(f"{at}/{slot // per_shard:08d}.bin") as f:
            f.seek(slot % per_shard * stride)
            for _ in range(min(known["sequences"], (slot // per_shard + 1) * per_shard) - slot):
                yield np.frombuffer(f.read(stride), f"u{known['id_bytes']}")
                slot += 1

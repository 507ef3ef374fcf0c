"""Removal of repeated multi-line passages.

Every two neighbouring non-empty lines of a text are a pair; its key is a
128-bit cryptographic digest of their bytes, blank lines between them included.
A pair that stands earlier, by (doc_id, position), loses both its lines, so a
match reaches from the first to the last line that two texts have in common,
wherever it begins: a repeated passage of ``n >= 2`` lines is ``n - 1`` repeated
pairs and goes whole.  A line that is repeated without a neighbour stays.

Each line stays at its first place: a line that goes stands earlier beside the
same neighbour.  A pair that overlaps its own first place (three equal lines)
stays.  The first place of a pair may lose one of its lines where that line
belongs to another pair that stands still earlier.

Only digests and places are shuffled to find repeats; texts do not move unless
the lines to go exceed ``BROADCAST_BYTES``.

``n_chunks`` counts chunks with content-defined boundaries: a rolling hash over
the last two line hashes closes a chunk where it is 0 modulo ``ONE_IN`` (and
after ``MOST_LINES`` lines).  ``n_removed`` counts the chunks that lose lines.

Null text stays null and has no lines; a row without id is never changed.  Empty lines belong to the line before
them, leading ones to the first line.  A passage that repeats inside one document counts like any other.  Rows
with equal ids take their places in the order of a hash of their text; of rows with one id and one text one comes
first and the others, which cannot be told apart, are copies of it.  What is left of a
text keeps its line order; a text whose lines all go is empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, stored
from .words import Words, line_table, mix, row_slices, text_buffer, words_of

ONE_IN = 3
LEAST_LINES, MOST_LINES = 2, 64
#: Rows with their lists of places are sent to all executors up to this size, at ROW_BYTES a row and 4 bytes a place; beyond it rows are shuffled.
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 120


def chunks(data: np.ndarray, offsets: np.ndarray, lines: Words | None = None) -> Iterator[tuple[int, list[tuple[int, int, int, int]]]]:
    """(row, [(first byte, end byte, lines, hash)]): the chunks of each row with a line, covering all its bytes."""
    w = lines or words_of(data, offsets, line_table())
    rows = offsets - offsets[0]
    h = w.hashes
    roll = mix(h * np.uint64(0xA0761D6478BD642F) + np.concatenate((h[:1], h[:-1])))
    for r in range(len(rows) - 1):
        a, b = int(w.offsets[r]), int(w.offsets[r + 1])
        if a == b:
            continue
        # the first line of a text has no line before it: it never closes a chunk by the rolling hash
        closes = (np.flatnonzero(roll[a + 1 : b] % np.uint64(ONE_IN) == 0) + a + 2).tolist()
        cuts, at = [a], a
        for c in [*closes, b]:
            while c - at > MOST_LINES:
                at += MOST_LINES
                cuts.append(at)
            if c - at >= LEAST_LINES or (c == b and c > at):
                at = c
                cuts.append(at)
        out = []
        for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            first = int(rows[r]) if i == 0 else int(w.starts[x])
            end = int(rows[r + 1]) if y == b else int(w.starts[y])
            key = 0
            for v in h[x:y].tolist():
                key = (key * 0x9E3779B97F4A7C15 + v) & 0xFFFFFFFFFFFFFFFF
            out.append((first, end, y - x, key - (1 << 64) if key >> 63 else key))
        yield r, out


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, row_keys, copies = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
        data, offsets = text_buffer(batch.column(3))
        for a, b in row_slices(offsets):
            w = words_of(data, offsets[a : b + 1], line_table())
            row = np.repeat(np.arange(a, b), np.diff(w.offsets))
            at = np.flatnonzero(row[1:] == row[:-1])
            row, text = row[at], data[offsets[a] : offsets[b]].tobytes()
            keys = [blake2b(text[x:y], digest_size=16).digest() for x, y in zip(w.starts[at].tolist(), w.ends[at + 1].tolist(), strict=True)]
            position = (at - w.offsets[row - a]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(row_keys[row]), pa.array(copies[row]), pa.array(position), pa.array(keys, pa.binary())], ["doc_id", "row_key", "copy", "position", "pair"])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gone = batch.column(2).to_pylist()
        texts = batch.column(1)
        missing = texts.is_null().to_pylist()
        data, offsets = text_buffer(texts)
        for a, b in row_slices(offsets):
            base = int(offsets[a])
            kept = [None if missing[i] else data[offsets[i] : offsets[i + 1]].tobytes() for i in range(a, b)]
            lines, n_chunks, removed, lost = (np.zeros(b - a, np.int64) for _ in range(4))
            w = words_of(data, offsets[a : b + 1], line_table())
            for r, found in chunks(data, offsets[a : b + 1], w):
                lines[r], n_chunks[r] = w.offsets[r + 1] - w.offsets[r], len(found)
                pairs = np.array(gone[a + r] or (), np.int64)
                if len(pairs):
                    drop = np.zeros(lines[r], bool)
                    drop[pairs] = drop[pairs + 1] = True
                    lost[r] = drop.sum()
                    removed[r] = np.logical_or.reduceat(drop, np.cumsum([0, *[x[2] for x in found[:-1]]])).sum()
                    # a line reaches to the next one, so that blank lines go with it
                    cuts = np.concatenate(([offsets[a + r]], base + w.starts[w.offsets[r] + 1 : w.offsets[r + 1]], [offsets[a + r + 1]]))
                    kept[r] = b"".join(data[cuts[i] : cuts[i + 1]].tobytes() for i in np.flatnonzero(~drop)).rstrip(b"\n")
            texts_out = pa.array([None if x is None else x.decode("utf-8") for x in kept], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(x) for x in (lines, n_chunks, removed, lost)), texts_out], ["doc_id", "n_lines", "n_chunks", "n_removed", "n_removed_lines", "text"])


def _numbered(docs: DataFrame) -> DataFrame:
    """Adds ``copy``: 0 but for rows with one id and one text, which are numbered from 0."""
    same = docs.where("doc_id is not null and text is not null").groupBy("doc_id", "row_key").agg(F.count("*").alias("n")).where("n > 1")
    same = stored(same.select("doc_id", "row_key"), "same")
    n = same.count()
    if not n:
        return docs.withColumn("copy", F.lit(0))
    same = F.broadcast(same) if n * ROW_BYTES <= BROADCAST_BYTES else same
    # one row and a count stand for equal rows: no window over them, and they are dealt out again by number
    once = docs.where("text is not null").join(same, ["doc_id", "row_key"], "left_semi").groupBy("doc_id", "row_key", "text").agg(F.count("*").alias("n"))
    copies = once.select("doc_id", "row_key", "text", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("copy")).repartition("doc_id", "row_key", "copy")
    # a null id or text equals nothing: such rows stay on this side
    others = docs.join(same.withColumn("_known", F.lit(True)), ["doc_id", "row_key"], "left").where("_known is null or text is null").drop("_known")
    return others.withColumn("copy", F.lit(0)).unionByName(copies)


def drop_repeated_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_chunks, n_removed, n_removed_lines, text) for every row of ``docs`` (doc_id, text)."""
    text = F.col("text").cast("string")
    row = ["doc_id", "row_key", "copy"]
    docs = _numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row_key"), text.alias("text")))
    pairs = docs.where("doc_id is not null").select(*row, "text").mapInArrow(_pairs, "doc_id long, row_key long, copy int, position int, pair binary")
    pairs = stored(pairs, "pairs")
    first = F.min(F.struct(*row, "position")).alias("first")
    repeats = pairs.groupBy("pair").agg(F.count("*").alias("n"), first).where("n > 1").select("pair", F.struct(*[f"first.{c}" for c in row]).alias("first"), F.col("first.position").alias("at"))
    # written, so that the join below has nothing but rows on both sides and a very common pair can be split
    repeats = stored(repeats, "repeats")
    later = (F.struct(*row) != F.col("first")) | (F.col("position") > F.col("at") + 1)
    gone = pairs.join(repeats, "pair").where(later).groupBy(*row).agg(F.collect_set("position").alias("gone"))
    gone = stored(gone, "gone")
    places = gone.select(F.sum(F.size("gone") * 4 + ROW_BYTES)).first()[0] or 0
    marked = docs.join(F.broadcast(gone) if places <= BROADCAST_BYTES else gone, row, "left")
    dropped(repeats, pairs)
    return marked.select("doc_id", "text", "gone").mapInArrow(_without, "doc_id long, n_lines long, n_chunks long, n_removed long, n_removed_lines long, text string")

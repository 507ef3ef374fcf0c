"""Benchmark decontamination by winnowed fingerprints and hit extension.

Training and test texts are cut into words; of every ``WINDOW - K + 1``
consecutive ``K``-word hashes the least is a fingerprint (the rightmost on
ties).  Any shared run of ``WINDOW`` words therefore shares a fingerprint at
the same place, so a fingerprint hit is extended to the windows around it, of
which those that stand in an item count: that finds every such run, in time
linear in the text however often its words repeat.  Items of fewer than
``WINDOW`` words are fingerprints of their own length (a winnowing window of
one).

The item side is an index of window hashes in blocks of at most ``BLOCK_WORDS``
words, built by tasks and written to the shared folder.  Tasks over documents
take one block after another, so memory is bounded for any number of items and
documents are never shuffled; a worker keeps its last block.

Null or word-less text: no words, no hits.  Null or word-less items match
nothing; an item without id marks words but is not listed.  Repeated rows are
judged alike, a row without id like any other; further columns are not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SharedFile, new_folder
from .words import alnum_table, grams, row_slices, text_buffer, words_of

WINDOW, K = 13, 6
BLOCK_WORDS = 4_000_000
SPAN = "array<struct<start:int,end:int>>"


def winnow(hashes: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """Positions chosen from ``hashes``: the rightmost least of each window within a row."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, where = hashes[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, width):
        here = hashes[j : j + n]
        less = here <= best
        best[less] = here[less]
        where[less] = j
    chosen = np.zeros(len(hashes), bool)
    whole = rows[:n] == rows[width - 1 :][:n]
    chosen[(np.arange(n) + where)[whole]] = True
    return np.flatnonzero(chosen)


def _inside(rows: np.ndarray, k: int) -> np.ndarray:
    """Whether ``k`` consecutive words from each place on belong to one row."""
    n = max(0, len(rows) - k + 1)
    return rows[:n] == rows[k - 1 :][:n]


def _prints(hashes: np.ndarray, rows: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and their places, for rows of at least ``window`` words."""
    g = grams(hashes, k)
    # a gram that leaves its row must never be chosen, nor hide one inside
    at = winnow(g, np.where(_inside(rows, k), rows[: len(g)], -1 - np.arange(len(g))), window - k + 1)
    return g[at], at


def _found(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value stands in the sorted distinct table, and where."""
    if not len(table):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values, at


@dataclass
class Index:
    """One block of items: their fingerprints, and for each window length its hashes and the items that hold them."""

    ids: np.ndarray  # as strings; "" where there is none
    prints: np.ndarray  # sorted
    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # length -> sorted distinct hashes, bounds, items

    @staticmethod
    def of(ids: list, texts: pa.Array, window: int, k: int) -> "Index":
        data, offsets = text_buffer(texts)
        w = words_of(data, offsets, alnum_table())
        sizes = np.diff(w.offsets)
        item = np.repeat(np.arange(len(sizes)), sizes)
        windows = {}
        for n in np.unique(np.minimum(sizes, window)).tolist():
            # items as long as the window or longer, or exactly as long as a short one
            at = np.flatnonzero(_inside(item, n)) if n else np.zeros(0, np.int64)
            at = at[(sizes[item[at]] >= n) if n == window else (sizes[item[at]] == n)]
            if len(at):
                pair = np.unique(np.rec.fromarrays([grams(w.hashes, n)[at], item[at]], names="hash,item"))
                hashes, first = np.unique(pair["hash"], return_index=True)
                windows[n] = hashes, np.append(first, len(pair)), np.ascontiguousarray(pair["item"])
        names = np.array(["" if x is None else str(x) for x in ids], dtype=np.str_)
        return Index(names, np.unique(_prints(w.hashes, item, window, k)[0]), windows)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, prints=self.prints, **{f"w{n}_{i}": a for n, parts in self.windows.items() for i, a in enumerate(parts)})
        return out.getvalue()

    @staticmethod
    def load(raw: bytes) -> "Index":
        z = np.load(io.BytesIO(raw))
        lengths = {int(name[1:].split("_")[0]) for name in z.files if name[0] == "w"}
        return Index(z["ids"], z["prints"], {n: (z[f"w{n}_0"], z[f"w{n}_1"], z[f"w{n}_2"]) for n in lengths})

    def hits(self, w, rows: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first words, lengths) of windows that stand in an item; (rows, items) of which one holds a window of the other."""
        starts, lengths, owners, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, (hashes, bounds, listed) in self.windows.items():
            if n == window:
                prints, at = _prints(w.hashes, rows, window, k)
                at = at[_found(prints, self.prints)[0]]
                # extend a fingerprint to the windows around it
                near = np.zeros(len(rows) + 1, bool)
                for j in range(window - k + 1):
                    near[np.maximum(at - j, 0)] = True
                at = np.flatnonzero(near[: max(0, len(rows) - n + 1)] & _inside(rows, n))
            else:
                at = np.flatnonzero(_inside(rows, n))
            there, place = _found(grams(w.hashes, n)[at], hashes)
            at, place = at[there], place[there]
            starts.append(at)
            lengths.append(np.full(len(at), n))
            # each window of a row once, then its items
            pair = np.unique(rows[at] * len(hashes) + place)
            row, place = pair // max(1, len(hashes)), pair % max(1, len(hashes))
            count = bounds[place + 1] - bounds[place]
            owners.append(np.repeat(row, count))
            items.append(listed[np.repeat(bounds[place] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))])
        pair = np.unique(np.concatenate(owners) * max(1, len(self.ids)) + np.concatenate(items))
        return np.concatenate(starts), np.concatenate(lengths), pair // max(1, len(self.ids)), pair % max(1, len(self.ids))


@lru_cache(1)
def _block(uri: str) -> Index:
    fs, at = pa.fs.FileSystem.from_uri(uri)
    with fs.open_input_stream(at) as f:
        return Index.load(f.read())


class Benchmark:
    """Written blocks of items."""

    def __init__(self, items: DataFrame, window: int = WINDOW, k: int = K, block_words: int = BLOCK_WORDS):
        self.window, self.k = window, k
        items = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
        n_words = items.select(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
        n_blocks = max(1, int(-(-n_words // block_words)))
        folder = new_folder(items.sparkSession, "benchmark")

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            rows = list(batches)
            uri = f"{folder}/{TaskContext.get().partitionId()}.npz"
            out = SharedFile(uri)
            out.write(Index.of([x for b in rows for x in b.column(0).to_pylist()], pa.chunked_array([b.column(1) for b in rows], pa.string()), window, k).dump())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([uri])], ["uri"])

        dealt = items.repartitionById(n_blocks, F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)).cast("int"))
        self.blocks: list[str] = sorted(r.uri for r in dealt.mapInArrow(build, "uri string").collect())  # one row a block

    def marks(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[list[str]]]]:
        """(first row, end row, bounds of rows in words, whether each word is hit, ids of items of each row) by slices."""
        data, offsets = text_buffer(texts)
        pieces = list(row_slices(offsets))
        delta: list = [None] * len(pieces)
        named: list[list[set]] = [[set() for _ in range(b - a)] for a, b in pieces]
        nothing = Index(np.zeros(0, np.str_), np.zeros(0, np.uint64), {})
        for ix in map(_block, self.blocks) if self.blocks else [nothing]:
            for i, (a, b) in enumerate(pieces):
                w = words_of(data, offsets[a : b + 1], alnum_table())
                rows = np.repeat(np.arange(b - a), np.diff(w.offsets))
                start, length, row, item = ix.hits(w, rows, self.window, self.k)
                n = len(rows)
                change = np.bincount(start, minlength=n + 1) - np.bincount(start + length, minlength=n + 1)
                delta[i] = (w.offsets, change) if delta[i] is None else (w.offsets, delta[i][1] + change)
                for r, x in zip(row.tolist(), ix.ids[item].tolist(), strict=True):
                    if x:
                        named[i][r].add(x)
        for (a, b), (first, change), ids in zip(pieces, delta, named, strict=True):
            yield a, b, first, np.cumsum(change[:-1]) > 0, [sorted(x) for x in ids]


def _runs(hit: np.ndarray, first: np.ndarray) -> list[list[dict]]:
    """Runs of hit words by row, cut at row ends."""
    edge = np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))
    inner = first[1:-1]
    cut = inner[(inner > 0) & (inner < len(hit))]
    cut = np.unique(cut[hit[cut] & hit[cut - 1]])
    begin, stop = np.sort(np.concatenate((np.flatnonzero(edge == 1), cut))), np.sort(np.concatenate((np.flatnonzero(edge == -1), cut)))
    spans: list[list] = [[] for _ in range(len(first) - 1)]
    row = np.searchsorted(first, begin, side="right") - 1
    for r, s, e in zip(row.tolist(), begin.tolist(), stop.tolist(), strict=True):
        spans[r].append({"start": s - int(first[r]), "end": e - int(first[r])})
    return spans


def contaminated_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, spans, item_ids) for every row of ``docs`` (doc_id, text).

    ``items`` has item_id and text.  ``spans`` are the hit words, ``item_ids``
    the sorted ids (as strings) of items one of whose windows occurs.
    """
    benchmark = Benchmark(items, window, k, block_words)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, first, hit, ids in benchmark.marks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(first), pa.int64()), pa.array(_runs(hit, first), span), pa.array(ids, pa.list_(pa.string()))], ["doc_id", "n_words", "spans", "item_ids"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, f"doc_id long, n_words long, spans {SPAN}, item_ids array<string>")


def uncontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, whatever else it holds, of whose words fewer than a twentieth (or none) are hit."""
    benchmark, at = Benchmark(items), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, first, hit, _ in benchmark.marks(batch.column(at)):
                n_hit = np.diff(np.concatenate(([0], np.cumsum(hit)))[first])
                yield batch.slice(a, b - a).filter(pa.array(~((n_hit > 0) & (20 * n_hit >= np.diff(first)))))

    return docs.mapInArrow(run, docs.schema)


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Adds n_hit (words in spans), n_items and the verdict: at least a twentieth of the words hit."""
    found = contaminated_spans(docs, items)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    found = found.withColumn("n_hit", n_hit).withColumn("n_items", F.size("item_ids").cast("long"))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))

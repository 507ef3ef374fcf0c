"""A trigram language model as an Elias-Fano trie in memory-mapped shards.

Level 1 is the vocabulary: 64-bit word hashes in ascending order, so that a
word's place is its id, with its exact running counts.  Level 2 holds the
successors of each word and level 3 those of each pair, whose place in level 2
is the context's id: monotone pointers delimit each context's range, successors
are stored relative to the last value of the range before (which keeps the
level monotone), and each has an 8-bit code of its smoothed log-probability.
In level 2 a successor is its word's id; in level 3 it is context-relative: the
w of (u, v, w) is its rank among the successors of v, which is small.
Everything but the codes is Elias-Fano coded.  A lookup maps the context's range
and searches the successor inside it.

Smoothing: p1(w) = (c(w) + 1) / (N + V + 1); p2(w | v) = (c(vw) + MU p1(w)) /
(c(v) + MU); p3(w | uv) = (c(uvw) + MU_3 p2(w | v)) / (c(uv) + MU_3).  Each sums
to one.  Level 2 codes p2, level 3 the part c(uvw) / (c(uv) + MU_3), and what
is in neither follows from the exact counts of the level below.  The end of a
text is a token and also the context of a first word, which has no longer one:
there, and after a pair that training lacks, p3 is p2.

All levels are cut into shards that Spark tasks build from shuffled counts and
write to the shared folder.  Level 2 is cut by C(v) + c(v) C(w) / N, level 3 by
C(uv) + c(uv) C(w) / N, with the running counts C of the level below: monotone
in the key and even in expectation, so the successors of a very frequent
context spread over as many shards as they fill.  Scoring tasks map the shards
(files of a remote store are read one shard at a time) and look up their sorted
distinct pairs and triples, so memory does not grow with the model.

Null or empty text: the end token alone.  Repeated rows count as often as they
stand, and rows without id score like others.  A text of any length is scored
whole, its slice held in memory.  Further columns are not read.  Without
training rows every token is unknown: N = V = 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .elias_fano import EliasFano
from .shared import SharedFile, new_folder, stored
from .words import row_slices, space_table, text_buffer, words_of

MU, MU_3 = 400.0, 20.0
#: Hash of the end token; no word's hash is fixed, so a clash is as unlikely as any other.
END = np.uint64(0x5BD1E995C2B2AE35)
#: Text bytes that a shard of level 1 and of the others stand for.
SHARD_1, SHARD_2 = 96 << 20, 24 << 20
#: Bytes of text a lookup handles at once: larger slices repeat fewer words.
SLICE = 4 << 20


def _write(uri: str, sections: list[np.ndarray]) -> None:
    """One file of 64-bit words; a repeated task writes the same bytes again."""
    out = SharedFile(uri)
    for s in sections:
        out.write(np.ascontiguousarray(s).view(np.uint64).tobytes())
    out.close()


_mapped: dict[str, np.ndarray] = {}


def _map(uri: str) -> np.ndarray:
    """The words of a shard: memory-mapped if the store is a file system, else read."""
    if uri in _mapped:
        return _mapped[uri]
    fs, at = pa.fs.FileSystem.from_uri(uri)
    if isinstance(fs, pa.fs.LocalFileSystem):
        if len(_mapped) > 4096:
            _mapped.clear()
        _mapped[uri] = np.asarray(np.memmap(at, np.uint64, "r"))
        return _mapped[uri]
    with fs.open_input_file(at) as f:
        return np.frombuffer(f.read(), np.uint64)


def _flat(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per slice: its rows, token hashes with the end token after each text, and row bounds."""
    data, offsets = text_buffer(texts)
    for a, b in row_slices(offsets, SLICE):
        parts, sizes = [], []
        for c, d in row_slices(offsets[a : b + 1]):
            w = words_of(data, offsets[a + c : a + d + 1], space_table())
            parts.append(w.hashes)
            sizes.append(np.diff(w.offsets))
        sizes = np.concatenate(sizes)
        yield a, b, np.insert(np.concatenate(parts), np.cumsum(sizes), END), np.concatenate(([0], np.cumsum(sizes + 1)))


def _planes(x: np.ndarray) -> bytes:
    """Compressed byte planes of an integer array."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), 1)


def _from_planes(raw: bytes, kind: type) -> np.ndarray:
    b = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(b.T).view(kind).ravel()


def _small(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.uint8 if not len(counts) or counts.max() < 256 else np.uint64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate((keys[:1] == keys[:1], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts[order].astype(np.int64), first) if len(first) else counts[:0].astype(np.int64)


def _word_shard(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


@dataclass
class Vocabulary:
    """Level 1: shard files, the id and the running count at which each begins, N and V."""

    folder: str
    ids: np.ndarray
    counts: np.ndarray

    @property
    def tokens(self) -> int:
        return int(self.counts[-1])

    @property
    def types(self) -> int:
        return int(self.ids[-1])

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids (-1 if unknown), counts and running counts of ascending hashes."""
        ids, counts, before = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        n = len(self.ids) - 1
        cuts = np.searchsorted(_word_shard(hashes, n), np.arange(n + 1))
        for s in range(n):
            a, b = int(cuts[s]), int(cuts[s + 1])
            if a == b or self.ids[s] == self.ids[s + 1]:
                continue
            words = _map(f"{self.folder}/{s}")
            names, at = EliasFano.read(words, 0)
            runs, _ = EliasFano.read(words, at)
            p = names.index(hashes[a:b])
            there = p >= 0
            q = np.where(there, p, 0)
            low, high = runs.access(q).astype(np.int64), runs.access(q + 1).astype(np.int64)
            ids[a:b] = np.where(there, self.ids[s] + q, -1)
            counts[a:b] = np.where(there, high - low, 0)
            before[a:b] = np.where(there, self.counts[s] + low, 0)
        return ids, counts, before

    def counts_of(self, ids: np.ndarray) -> np.ndarray:
        """Counts of ascending ids."""
        out = np.zeros(len(ids), np.int64)
        cuts = np.searchsorted(ids, self.ids)
        for s in range(len(self.ids) - 1):
            a, b = int(cuts[s]), int(cuts[s + 1])
            if a < b:
                words = _map(f"{self.folder}/{s}")
                runs, _ = EliasFano.read(words, EliasFano.read(words, 0)[1])
                q = ids[a:b] - self.ids[s]
                out[a:b] = runs.access(q + 1).astype(np.int64) - runs.access(q).astype(np.int64)
        return out


def _dealt(before: np.ndarray, count: np.ndarray, word_before: np.ndarray, total: int, n: int) -> np.ndarray:
    """Shard of each (context, word): monotone in the pair, even in expectation."""
    at = before + count * (word_before / max(total, 1))
    return np.minimum(n - 1, (at * (n / max(total, 1))).astype(np.int64))


class _Tokens:
    """The tokens of one slice, looked up in level 1."""

    def __init__(self, hashes: np.ndarray, bounds: np.ndarray, vocabulary: Vocabulary):
        distinct, back = np.unique(hashes, return_inverse=True)
        ids, counts, before = vocabulary.lookup(distinct)
        self.counts, self.total = counts[back], vocabulary.tokens
        self.p1 = (self.counts + 1.0) / (self.total + vocabulary.types + 1.0)
        word, c = ids[back], self.counts
        end = int(np.searchsorted(distinct, END))
        self.start = start = bounds[:-1]
        self.context, self.context_count, self.context_before = (np.concatenate((x[:1], x[:-1])) for x in (word, c, before[back]))
        self.context[start], self.context_count[start], self.context_before[start] = ids[end], counts[end], before[end]
        self.word, self.word_before = word, before[back]

    def shard(self, n: int) -> np.ndarray:
        """Level-2 shard of each (context, word)."""
        return _dealt(self.context_before, self.context_count, self.word_before, self.total, n)

    def keys(self) -> np.ndarray:
        _fits(self.context, self.word)
        return (self.context.astype(np.uint64) << np.uint64(32)) | self.word.astype(np.uint64)


def _fits(*columns: np.ndarray, bits: int = 32) -> None:
    """An error instead of a wrong score where a number would not fit its field."""
    for x in columns:
        if len(x) and int(x.max()) >= 1 << bits:
            raise OverflowError(f"{int(x.max())} does not fit in {bits} bits; use more shards")


@dataclass
class Pairs:
    """Level 2: shard files; the places and the running counts at which each begins; and how many successors of its first context stand in shards before it."""

    folder: str
    places: np.ndarray
    counts: np.ndarray
    heads: np.ndarray

    def counts_of(self, places: np.ndarray) -> np.ndarray:
        """Counts of ascending places."""
        out = np.zeros(len(places), np.int64)
        cuts = np.searchsorted(places, self.places)
        for s in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            a, b = int(cuts[s]), int(cuts[s + 1])
            runs, q = _Successors(f"{self.folder}/{s}").runs(), places[a:b] - self.places[s]
            out[a:b] = runs.access(q + 1).astype(np.int64) - runs.access(q).astype(np.int64)
        return out


class _Followed:
    """The pairs and triples that end at each token of one slice, looked up in level 2.

    ``pair`` and ``triple`` number the distinct ones in the order of their keys
    (-1: the pair is unknown; the triple is none or one of its pairs is unknown).
    """

    def __init__(self, t: _Tokens, pairs: Pairs):
        known = np.flatnonzero((t.word >= 0) & (t.context >= 0))
        keys, first, back = np.unique(t.keys()[known], return_index=True, return_inverse=True)
        first = known[first]
        n = len(pairs.places) - 1
        shard = t.shard(n)[first]
        hit, self.place, self.rank = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        self.count, self.before, self.log = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys))
        cuts = np.searchsorted(shard, np.arange(n + 1))
        for s in np.flatnonzero((np.diff(pairs.places) > 0) & (cuts[1:] > cuts[:-1])).tolist():
            at = slice(int(cuts[s]), int(cuts[s + 1]))
            level, context = _Successors(f"{pairs.folder}/{s}"), t.context[first[at]]  # a missing file is an error
            hit[at], q, rank, self.log[at] = level.find(context, t.word[first[at]])
            runs = level.runs()
            low = runs.access(q).astype(np.int64)
            self.count[at], self.before[at] = runs.access(q + 1).astype(np.int64) - low, pairs.counts[s] + low
            self.place[at], self.rank[at] = pairs.places[s] + q, rank + np.where(context == level.first, pairs.heads[s], 0)
        self.pair = np.full(len(t.word), -1, np.int64)
        self.pair[known] = np.where(hit[back], back, -1)
        last = np.concatenate(([-1], self.pair[:-1]))
        last[t.start] = -1
        self.last = last  # the pair that is the context
        whole = np.flatnonzero((last >= 0) & (self.pair >= 0))
        _fits(last[whole], self.pair[whole])
        # a pair's number is in the order of its place and, after one word, of its rank
        _, first, back, self.triple_count = np.unique((last[whole].astype(np.uint64) << np.uint64(32)) | self.pair[whole].astype(np.uint64), return_index=True, return_inverse=True, return_counts=True)
        self.triple = np.full(len(t.word), -1, np.int64)
        self.triple[whole] = back
        first = whole[first]
        context = last[first]
        self.triple_context, self.triple_rank = self.place[context], self.rank[self.pair[first]]
        self._deal = self.before[context], self.count[context], t.word_before[first], t.total

    def shard(self, n: int) -> np.ndarray:
        """Level-3 shard of each distinct triple."""
        return _dealt(*self._deal, n)


def _vocabulary(texts: DataFrame, n: int) -> Vocabulary:
    spark = texts.sparkSession
    folder = new_folder(spark, "lm1")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, hashes, _ in _flat(batch.column(0)):
                keys, counts = np.unique(hashes, return_counts=True)
                cuts = np.searchsorted(_word_shard(keys, n), np.arange(n + 1))
                rows = [(s, keys[a:b].tobytes(), counts[a:b].astype(np.int32).tobytes()) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["shard", "keys", "counts"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            for s, k, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                keys, counts, waiting = held.get(s, (np.zeros(0, np.uint64), np.zeros(0, np.int64), []))
                waiting.append((np.frombuffer(k, np.uint64), np.frombuffer(c, np.int32)))
                if sum(len(x) for x, _ in waiting) > max(1 << 18, len(keys)):
                    keys, counts = _summed(np.concatenate([keys, *(x for x, _ in waiting)]), np.concatenate([counts, *(y for _, y in waiting)]))
                    waiting = []
                held[s] = keys, counts, waiting
        for s, (keys, counts, waiting) in held.items():
            keys, counts = _summed(np.concatenate([keys, *(x for x, _ in waiting)]), np.concatenate([counts, *(y for _, y in waiting)]))
            runs = np.concatenate(([0], np.cumsum(counts)))
            _write(f"{folder}/{s}", [*EliasFano.of(keys).words(), *EliasFano.of(runs).words()])
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (s, len(keys), int(runs[-1]))], ["shard", "types", "tokens"])

    counted = texts.mapInArrow(count, "shard int, keys binary, counts binary").repartitionById(n, F.col("shard"))
    made = stored(counted.mapInArrow(build, "shard long, types long, tokens long"), "lm1-index").toArrow()
    types, tokens = np.zeros(n, np.int64), np.zeros(n, np.int64)
    types[made["shard"].to_numpy()], tokens[made["shard"].to_numpy()] = made["types"].to_numpy(), made["tokens"].to_numpy()
    return Vocabulary(folder, np.concatenate(([0], np.cumsum(types))), np.concatenate(([0], np.cumsum(tokens))))


def _packed_counts(shard: np.ndarray, n: int, context: np.ndarray, word: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """One row a shard: its counted (context, word) keys, which ascend."""
    cuts = np.searchsorted(shard, np.arange(n + 1))
    rows = []
    for s in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
        a, b = int(cuts[s]), int(cuts[s + 1])
        _fits(np.diff(context[a:b], prepend=context[a]), word[a:b])
        rows.append((s, int(context[a]), _planes(np.diff(context[a:b], prepend=context[a]).astype(np.uint32)), _planes(word[a:b].astype(np.uint32)), _planes(_small(counts[a:b]))))
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(columns, kinds, strict=True)], ["shard", "first", "contexts", "words", "counts"])


COUNTED = "shard int, first long, contexts binary, words binary, counts binary"


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(shard, context, word, count) of all keys of each shard that a task got."""
    held: dict[int, list] = {}
    zero: dict[int, int] = {}
    for batch in batches:
        for s, first, h, w, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            words = _from_planes(w, np.uint32)
            packed = zstandard.decompress(c)
            counts = np.frombuffer(packed, np.uint8) if len(packed) == len(words) else _from_planes(c, np.uint64)
            # contexts of a shard are near one another: their distance from here fits in 32 bits
            shift = first - zero.setdefault(s, first - (1 << 31))
            _fits(np.array([0 if shift >= 0 else 1 << 32]))
            contexts = np.cumsum(_from_planes(h, np.uint32), dtype=np.uint64) + np.uint64(shift)
            _fits(contexts)
            _fits(counts, bits=31)
            held.setdefault(s, []).append(((contexts << np.uint64(32)) | words, counts.astype(np.int32)))
            if len(held[s]) > 64:
                held[s] = [_summed(np.concatenate([x for x, _ in held[s]]), np.concatenate([y for _, y in held[s]]))]
    for s in list(held):
        parts = held.pop(s)
        keys, counts = _summed(np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts]))
        del parts
        yield s, (keys >> np.uint64(32)).astype(np.int64) + zero[s], (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), counts


def _write_level(uri: str, h: np.ndarray, w: np.ndarray, logs: np.ndarray, more: list[np.ndarray]) -> None:
    """A shard of level 2 or 3: the successors ``w`` of contexts ``h``, and coded logs."""
    pointers = np.searchsorted(h, np.arange(h[0], h[-1] + 2))
    book = np.linspace(logs.min(), logs.max(), 256)  # even steps: no value is off by more than half of one
    codes = np.searchsorted((book[1:] + book[:-1]) / 2, logs).astype(np.uint8)
    # values of a range follow the last value of the range before
    steps = np.where(np.diff(pointers) > 0, w[np.maximum(pointers[1:] - 1, 0)] + 1, 0)
    base = np.concatenate(([0], np.cumsum(steps)[:-1]))
    chain = EliasFano.of((base[h - h[0]] + w + 1).astype(np.uint64))
    pad = np.concatenate((codes, np.zeros(-len(codes) % 8, np.uint8)))
    _write(uri, [np.array([h[0], h[-1]], np.uint64), *EliasFano.of(pointers.astype(np.uint64)).words(), *chain.words(), book, np.array([len(pad) // 8], np.uint64), pad, *more])


class _Successors:
    """A mapped shard of level 2 or 3."""

    def __init__(self, uri: str):
        self.words = _map(uri)
        self.first, self.final = int(self.words[0]), int(self.words[1])
        self.pointers, at = EliasFano.read(self.words, 2)
        self.chain, self.at = EliasFano.read(self.words, at)

    def runs(self) -> EliasFano:
        """Running counts, which stand behind the codes of level 2."""
        return EliasFano.read(self.words, self.at + 257 + int(self.words[self.at + 256]))[0]

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Whether ascending (context, word) are here; place (0 if not), rank in the context's range and coded log."""
        inside = (context >= self.first) & (context <= self.final)
        h, back = np.unique(np.where(inside, context, self.first) - self.first, return_inverse=True)
        begin, end = self.pointers.access(h).astype(np.int64), self.pointers.access(h + 1).astype(np.int64)
        base = np.where(begin > 0, self.chain.access(np.maximum(begin - 1, 0)).astype(np.int64), 0)
        begin, end = begin[back], end[back]
        p = self.chain.index((base[back] + word + 1).astype(np.uint64))
        there = inside & (p >= begin) & (p < end)
        q = np.where(there, p, 0)
        book, codes = self.words[self.at : self.at + 256].view(np.float64), self.words[self.at + 257 :].view(np.uint8)
        return there, q, np.where(there, q - begin, 0), book[codes[q]]


def _pairs(texts: DataFrame, vocabulary: Vocabulary, n: int) -> Pairs:
    """Builds level 2."""
    folder = new_folder(texts.sparkSession, "lm2")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, hashes, bounds in _flat(batch.column(0)):
                t = _Tokens(hashes, bounds, vocabulary)
                keys, first, counts = np.unique(t.keys(), return_index=True, return_counts=True)
                yield _packed_counts(t.shard(n)[first], n, t.context[first], t.word[first], counts)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, h, w, counts in _unpacked(batches):
            contexts, back = np.unique(h, return_inverse=True)
            c_h = vocabulary.counts_of(contexts)[back]
            distinct, back = np.unique(w, return_inverse=True)
            p1 = ((vocabulary.counts_of(distinct) + 1.0) / (vocabulary.tokens + vocabulary.types + 1.0))[back]
            runs = np.concatenate(([0], np.cumsum(counts)))
            _write_level(f"{folder}/{s}", h, w, np.log10((counts + MU * p1) / (c_h + MU)), EliasFano.of(runs).words())
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (s, len(h), int(runs[-1]), int(h[0]), int(h[-1]), int((h == h[-1]).sum()))], ["shard", "pairs", "tokens", "first", "final", "tail"])

    counted = texts.mapInArrow(count, COUNTED).repartitionById(n, F.col("shard"))
    made = stored(counted.mapInArrow(build, "shard long, pairs long, tokens long, first long, final long, tail long"), "lm2-index").toArrow().sort_by("shard")
    there = made["shard"].to_numpy()
    pairs, tokens, heads = (np.zeros(n, np.int64) for _ in range(3))
    pairs[there], tokens[there] = made["pairs"].to_numpy(), made["tokens"].to_numpy()
    open_context, running = -1, 0  # the context at the end of the shards so far, and its successors there
    for s, first, final, tail in zip(*(made[c].to_pylist() for c in ("shard", "first", "final", "tail")), strict=True):
        heads[s] = running if first == open_context else 0
        open_context, running = final, tail + (int(heads[s]) if first == final else 0)
    return Pairs(folder, np.concatenate(([0], np.cumsum(pairs))), np.concatenate(([0], np.cumsum(tokens))), heads)


def _triples(texts: DataFrame, vocabulary: Vocabulary, pairs: Pairs, n: int) -> tuple[str, np.ndarray]:
    """Builds level 3; its folder, and which of the ``n`` shards hold anything."""
    folder = new_folder(texts.sparkSession, "lm3")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, hashes, bounds in _flat(batch.column(0)):
                f = _Followed(_Tokens(hashes, bounds, vocabulary), pairs)
                yield _packed_counts(f.shard(n), n, f.triple_context, f.triple_rank, f.triple_count)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, context, rank, counts in _unpacked(batches):
            distinct, back = np.unique(context, return_inverse=True)
            _write_level(f"{folder}/{s}", context, rank, np.log10(counts / (pairs.counts_of(distinct)[back] + MU_3)), [])
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64())], ["shard"])

    counted = texts.mapInArrow(count, COUNTED).repartitionById(n, F.col("shard"))
    made = stored(counted.mapInArrow(build, "shard long"), "lm3-index").toArrow()
    there = np.zeros(n, bool)
    there[made["shard"].to_numpy()] = True
    return folder, there


@dataclass
class TrieModel:
    """A fitted model; its arrays have one entry a shard."""

    vocabulary: Vocabulary
    pairs: Pairs
    folder: str
    there: np.ndarray

    def log_probabilities(self, t: _Tokens) -> np.ndarray:
        """log10 p of each token after its context."""
        f = _Followed(t, self.pairs)
        p = MU * t.p1 / (t.context_count + MU)
        found = f.pair >= 0
        p[found] = 10.0 ** f.log[f.pair[found]]
        n = len(self.there)
        cuts = np.searchsorted(f.shard(n), np.arange(n + 1))
        more = np.zeros(len(f.triple_context))
        for s in np.flatnonzero(self.there & (cuts[1:] > cuts[:-1])).tolist():
            at = slice(int(cuts[s]), int(cuts[s + 1]))
            there, _, _, value = _Successors(f"{self.folder}/{s}").find(f.triple_context[at], f.triple_rank[at])
            more[at] = np.where(there, 10.0**value, 0.0)
        after = f.last >= 0
        p[after] *= MU_3 / (f.count[f.last[after]] + MU_3)
        found = f.triple >= 0
        p[found] += more[f.triple[found]]
        return np.log10(p)


def fit(texts: DataFrame) -> TrieModel:
    """A model of the column ``text`` of all rows."""
    texts = texts.select(F.col("text").cast("string").alias("text"))
    size = texts.select(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    vocabulary = _vocabulary(texts, max(1, math.ceil(size / SHARD_1)))
    shards = max(1, math.ceil(size / SHARD_2))
    pairs = _pairs(texts, vocabulary, shards)
    return TrieModel(vocabulary, pairs, *_triples(texts, vocabulary, pairs, shards))


def scores(docs: DataFrame, model: TrieModel) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, hashes, bounds in _flat(batch.column(1)):
                if END not in hashes:
                    continue
                t = _Tokens(hashes, bounds, model.vocabulary)
                by_row = lambda x: np.add.reduceat(x, bounds[:-1])  # noqa: E731, B023  every row has its end token
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), pa.array(np.diff(bounds)), pa.array(by_row((t.counts > 0).astype(np.int64))), pa.array([model.vocabulary.tokens] * (b - a), pa.int64()),
                        pa.array(by_row(np.log10(t.p1))), pa.array(by_row(model.log_probabilities(t))),
                    ],
                    ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")

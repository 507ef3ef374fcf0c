"""Collocations: phrases of two to five words that stand together more often than their parts would by chance.

Words that are frequent in a language become numbers; texts become arrays of
these, cut where a piece ends or an infrequent word stands.  Phrases are found
level by level.  A phrase of k words can only be frequent if both phrases of k
- 1 words in it are (Apriori), so a shard walks the double-array trie of the
last level at all its positions at once and takes neighbouring accepting states
as candidates, with their numbers there.  Where there are fewer shards than the
threshold a shard leaves out what it has once; a candidate whose named counts,
and the one that every other shard may have left out, don't come to the
threshold goes (the partition algorithm's bound, exact and safe).  The rest form tries, which
every shard walks again: occurrences are a bincount of accepting states, and the
vectors are summed over the shards.

Tries are split by the hash of their phrases into blocks of bounded size that
tasks write to the shared folder and shards read one at a time, so what a task
holds doesn't grow with the corpus.  Words are told apart by 64-bit hashes of
language and word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .double_array import DoubleArray
from .shared import SharedFile, new_folder, stored
from .words import row_slices, text_buffer, words_of

LONGEST, THRESHOLD, BEST = 5, 100, 2000
#: Numbers of a shard, words of a block of the vocabulary, phrases of a block of tries.
SHARD, VOCABULARY, TRIE = 1 << 21, 1 << 21, 1 << 17
#: A block's own numbers: blocks are cut by hash, so they have about the given size and less than this.
BLOCK = 1 << 24
#: Blocks of tries whose sums a task holds, tasks for each core that sum, and parts in which their vectors are added up first.
HELD, TASKS, PARTS = 32, 2, 32
#: Parts into which a language's phrases are split before its best are chosen.
_SALT = 64


@lru_cache(None)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Bytes of words (0 separates, A-Z lowered) and of piece ends."""
    word = np.arange(256, dtype=np.uint8)
    word[65:91] += 32
    word[0] = 0xFF  # NUL is a word byte: a value that UTF-8 text has not
    ends = np.zeros(256, bool)
    ends[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
    word[ends] = 0
    word[[0x20, 0x09]] = 0
    return word, ends


def _parsed(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of texts: hashes of (language, word), rows, starts, ends, where a piece begins, lowered bytes."""
    table, ends = _tables()
    data, offsets = text_buffer(batch.column("text"))
    languages = batch.column("hash").to_numpy(zero_copy_only=False).view(np.uint64)
    for a, b in row_slices(offsets):
        part = data[int(offsets[a]) : int(offsets[b])]
        words = words_of(data, offsets[a : b + 1], table)
        row = np.repeat(np.arange(a, b), np.diff(words.offsets))
        seen = np.concatenate([[0], np.cumsum(ends[part])])
        begins = np.ones(len(row), bool)
        begins[1:] = (row[1:] != row[:-1]) | (seen[words.starts[1:]] > seen[words.ends[:-1]])
        mixed = (words.hashes ^ (languages[row] * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(31)
        low = table[part].copy()
        low[part == 0] = 0
        yield mixed.view(np.int64), row, words.starts, words.ends, begins, low


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each batch by language, with their numbers."""
    for batch in batches:
        for hashes, row, starts, ends, _, low in _parsed(batch):
            found, first, count = np.unique(hashes, return_index=True, return_counts=True)
            size = (ends - starts)[first]
            offsets = np.concatenate([[0], np.cumsum(size)])
            at = np.repeat(starts[first] - offsets[:-1], size) + np.arange(offsets[-1])
            text = pa.LargeStringArray.from_buffers(len(found), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(low[at])).cast(pa.string())
            lang = batch.column("lang").take(pa.array(row[first]))
            yield pa.RecordBatch.from_arrays([pa.array(found), lang, text, pa.array(count)], ["hash", "lang", "word", "n"])


@lru_cache(1)
def _block(uri: str) -> DoubleArray | np.ndarray:
    """A block of the vocabulary (sorted hashes) or of a trie; one is kept."""
    fs, path = pa.fs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path) as f:
        data = f.read()
    return DoubleArray.load(data) if uri.endswith(".trie") else np.frombuffer(data, np.int64)


def _written(uri: str, data: bytes) -> None:
    file = SharedFile(uri)
    file.write(data)
    file.close()


def _numbers(folder: str, blocks: int) -> Callable:
    """Texts as shards of word numbers: runs of two or more frequent words of a piece, -1 after each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for hashes, _, _, _, begins, _ in _parsed(batch):
                number = np.full(len(hashes), -1)
                for b in range(blocks):
                    known = _block(f"{folder}/{b}.words")
                    mine = np.flatnonzero(hashes % blocks == b)
                    at = np.minimum(np.searchsorted(known, hashes[mine]), max(len(known) - 1, 0))
                    if len(known):
                        number[mine] = np.where(known[at] == hashes[mine], b * BLOCK + at, -1)
                joined = (number[1:] >= 0) & (number[:-1] >= 0) & ~begins[1:]
                keep = np.zeros(len(number), bool)
                keep[1:] |= joined
                keep[:-1] |= joined
                last = keep.copy()
                last[:-1] &= ~joined
                kept = np.flatnonzero(keep)
                out = np.full(len(kept) + int(last.sum()), -1)
                out[np.arange(len(kept)) + np.concatenate([[0], np.cumsum(last[kept])[:-1]]) if len(kept) else []] = number[kept]
                held.append(out)
                size += len(out)
                if size >= SHARD:
                    yield _shard(held)
                    held, size = [], 0
        if size:
            yield _shard(held)

    def _shard(held: list[np.ndarray]) -> pa.RecordBatch:
        ids = np.concatenate(held)
        return pa.RecordBatch.from_arrays([pa.array([ids.astype(np.int32 if blocks < 128 else np.int64).tobytes()], pa.binary())], ["ids"])

    return run


def _shards(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for x in batch.column("ids"):
            yield np.frombuffer(x.as_buffer(), f"<i{width}")


def _accepted(ids: np.ndarray, tries: list[str] | None) -> np.ndarray:
    """The number of the phrase that begins at each position, -1 without one; without tries, of the word."""
    if tries is None:
        return ids
    kind = np.int32 if len(tries) < 128 else np.int64
    out = np.full(len(ids), -1, kind)
    for b, uri in enumerate(tries):
        trie = _block(uri)
        number = np.zeros(len(trie.parent), kind)
        number[trie.cells] = b * BLOCK + np.arange(len(trie.cells))
        for at, cell in trie.windows(ids):
            out[at] = number[cell]
    return out


def _neighbours(tries: list[str] | None, width: int, least: int) -> Callable:
    """Pairs of phrases that begin at neighbouring positions, as often as a shard has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids in _shards(batches, width):
            found = _accepted(ids, tries)
            both = np.flatnonzero((found[1:] >= 0) & (found[:-1] >= 0))
            left, pair = np.unique(found[both], return_inverse=True)
            both += 1
            right, b = np.unique(found[both], return_inverse=True)
            del found, both
            pair *= max(len(right), 1)
            pair += b
            del b
            pair, count = np.unique(pair, return_counts=True)
            pair, count = pair[count >= least], count[count >= least]
            columns = [left[pair // max(len(right), 1)], right[pair % max(len(right), 1)], count]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], ["left", "right", "n"])

    return run


def _occurrences(tries: list[str], width: int) -> Callable:
    """Bincounts of the tries' phrases over a task's shards, a vector for each block, for as many blocks as it may hold."""

    def emitted(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() % PARTS
        for b, count in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([part], pa.int32()), pa.array([count.tobytes()], pa.binary())], ["block", "part", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for ids in _shards(batches, width):
            for b, uri in enumerate(tries):
                if b not in sums and len(sums) == HELD:
                    yield from emitted(sums)
                    sums = {}
                count = _block(uri).counts(ids).astype(np.int64)
                sums[b] = sums[b] + count if b in sums else count
        yield from emitted(sums)

    return run


def _summed(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """The sums of the vectors of each key (the first columns); equal keys come one after another."""
    own, total = None, None
    for batch in batches:
        for *key, vector in zip(*batch.columns, strict=True):
            key, vector = tuple(x.as_py() for x in key[:keys]), np.frombuffer(vector.as_buffer(), np.int64)
            if key != own:
                if own is not None:
                    yield own, total
                own, total = key, vector.copy()
            else:
                total += vector
    if own is not None:
        yield own, total


def _totals(vectors: DataFrame, threshold: int) -> DataFrame:
    """(number, n) of the phrases that reach the threshold: vectors are added up in parts and then by block, one at a time in memory."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (block, _), total in _summed(batches, 2):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "counts"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (block,), total in _summed(batches, 1):
            some = np.flatnonzero(total >= threshold)
            yield pa.RecordBatch.from_arrays([pa.array(block * BLOCK + some), pa.array(total[some])], ["number", "n"])

    near = vectors.repartition("block", "part").sortWithinPartitions("block", "part").mapInArrow(parts, "block int, counts binary")
    return near.repartition("block").sortWithinPartitions("block").mapInArrow(whole, "number long, n long")


def _blocks_of(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def _vocabulary(words: DataFrame, folder: str, blocks: int) -> DataFrame:
    """The words with their numbers, and the sorted hashes of each block as a file."""

    def number(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("hash")
        _written(f"{folder}/{key[0].as_py()}.words", table["hash"].to_numpy().astype(np.int64).tobytes())
        at = pa.array(key[0].as_py() * BLOCK + np.arange(len(table)))
        return table.drop_columns("block").append_column("number", at)

    keyed = words.withColumn("block", F.pmod("hash", F.lit(blocks)))
    return keyed.groupBy("block").applyInArrow(number, "hash long, lang string, word string, n long, number long")


def _tries(candidates: DataFrame, folder: str, blocks: int) -> DataFrame:
    """The candidates with their numbers, and the trie of each block as a file."""

    def number(key: tuple, table: pa.Table) -> pa.Table:
        rows = np.stack(table["words"].combine_chunks().to_numpy(zero_copy_only=False))
        order = np.lexsort(rows.T[::-1])
        _written(f"{folder}/{key[0].as_py()}.trie", DoubleArray.of(rows[order]).dump())
        at = np.empty(len(order), np.int64)
        at[order] = key[0].as_py() * BLOCK + np.arange(len(order))
        return table.drop_columns("block").append_column("number", pa.array(at))

    keyed = candidates.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(blocks)))
    return keyed.groupBy("block").applyInArrow(number, "words array<long>, lang string, phrase string, last string, number long")


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """All phrases of one to ``longest`` words with ``threshold`` or more occurrences, and all words a language.

    The first table has (words, lang, phrase, last, n, k), words as numbers;
    the second (lang, total).
    """
    spark = docs.sparkSession
    lang = F.coalesce("lang", F.lit("und"))
    texts = docs.select(lang.alias("lang"), F.xxhash64(lang).alias("hash"), "text")
    counted = texts.mapInArrow(_words, "hash long, lang string, word string, n long").groupBy("hash", "lang", "word").agg(F.sum("n").alias("n"))
    counted = stored(counted, "word-counts")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    common = counted.where(F.col("n") >= threshold)
    blocks = _blocks_of(common.count(), VOCABULARY)
    folder = new_folder(spark, "vocabulary")
    words = stored(_vocabulary(common, folder, blocks), "vocabulary-numbers")
    for empty in set(range(blocks)) - {r["b"] for r in words.select(F.floor(F.col("number") / BLOCK).alias("b")).distinct().collect()}:  # a row a block
        _written(f"{folder}/{empty}.words", b"")
    width = 4 if blocks < 128 else 8
    shards = stored(texts.mapInArrow(_numbers(folder, blocks), "ids binary"), "numbers")
    n_shards = shards.count()
    least = 2 if n_shards < threshold else 1  # with more shards nothing that one of them leaves unnamed can be bounded
    level = words.select(F.array("number").alias("words"), "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "n", "number")
    found, tries = [level.drop("number").withColumn("k", F.lit(1))], None
    for k in range(2, longest + 1):
        near = shards.mapInArrow(_neighbours(tries, width, least), "left long, right long, n long").groupBy("left", "right").agg(F.sum("n").alias("n"), F.count("*").alias("named"))
        near = near.where(F.col("n") + (n_shards - F.col("named")) * (least - 1) >= threshold)
        first = level.select(F.col("number").alias("left"), F.col("words").alias("_w"), "lang", F.col("phrase").alias("_p"))
        then = level.select(F.col("number").alias("right"), F.element_at("words", -1).alias("_n"), "last")
        joined = near.join(first, "left").join(then, "right")
        joined = stored(joined.select(F.concat("_w", F.array("_n")).alias("words"), "lang", F.concat_ws(" ", "_p", "last").alias("phrase"), "last"), f"candidates-{k}")
        count = joined.count()
        if not count:
            break
        blocks, folder = _blocks_of(count, TRIE), new_folder(spark, f"tries-{k}")
        candidates = stored(_tries(joined, folder, blocks), f"phrases-{k}")
        have = {r["b"] for r in candidates.select(F.floor(F.col("number") / BLOCK).alias("b")).distinct().collect()}  # a row a block
        for empty in set(range(blocks)) - have:
            _written(f"{folder}/{empty}.trie", DoubleArray.of(np.zeros((0, k), np.int64)).dump())
        tries = [f"{folder}/{b}.trie" for b in range(blocks)]
        summing = shards.coalesce(max(1, TASKS * spark.sparkContext.defaultParallelism))
        sums = _totals(summing.mapInArrow(_occurrences(tries, width), "block int, part int, counts binary"), threshold)
        level = stored(candidates.join(sums, "number").select("words", "lang", "phrase", "last", "n", "number"), f"frequent-{k}")
        found.append(level.drop("number").withColumn("k", F.lit(k)))
    out = found[0]
    for t in found[1:]:
        out = out.unionByName(t)
    return out, totals


def collocations(docs: DataFrame, best: int = BEST, longest: int = LONGEST, threshold: int = THRESHOLD) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score.

    Texts are lowered (A-Z), cut into pieces at ``.,;:!?`` and line ends and
    into words at spaces and tabs; a null language is ``und``, a null text
    empty.  A phrase's score is floor(1000 a n / (l r)) for its lowest-scoring
    cut, ties to the cut after fewer words: a, l and r are the occurrences of
    the phrase and its two parts, n all words of the language.  Phrases inside a
    longer one that is as frequent go.  Ranks are by score, then a, then the
    phrase's bytes.  Repeated rows count each; other columns are ignored; an
    empty table gives no rows.
    """
    phrases, totals = frequent_phrases(docs, longest, threshold)
    longer = phrases.where("k > 2")
    inside = longer.select(F.slice("words", 1, F.col("k") - 1).alias("words"), "n").unionByName(longer.select(F.slice("words", 2, F.col("k") - 1).alias("words"), "n")).distinct()
    kept = phrases.where("k > 1").join(inside, ["words", "n"], "left_anti")
    cuts = kept.select("words", "lang", "phrase", F.col("n").alias("a"), "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumns({"_left": F.slice("words", 1, F.col("cut")), "_right": F.slice("words", F.col("cut") + 1, F.col("k") - F.col("cut"))})
    cuts = cuts.join(phrases.select(F.col("words").alias("_left"), F.col("n").alias("l")), "_left").join(phrases.select(F.col("words").alias("_right"), F.col("n").alias("r")), "_right")
    cuts = cuts.join(totals.withColumnRenamed("total", "n"), "lang")
    exact = {c: F.col(c).cast("decimal(18,0)").alias(f"_{c}") for c in "alrn"}
    cuts = cuts.select("*", *exact.values()).withColumn("score", F.expr("cast((cast(1000 as decimal(4,0)) * _a * _n) div (_l * _r) as bigint)"))
    lowest = cuts.groupBy("lang", "phrase", "words").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("_c")).select("lang", "phrase", "_c.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = lowest.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALT)))
    some = salted.withColumn("_r", F.row_number().over(W.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_r") <= best)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

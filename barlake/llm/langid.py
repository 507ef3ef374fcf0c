"""Language identification with language-bitmask n-gram filters.

A Bloom filter is kept for each language, bit-sliced: one machine word per
position whose bit L belongs to language L.  The AND of the words at an
n-gram's positions returns, in one lookup, all languages that contain it.  A
text's n-grams are counted by language (a popcount of each bit column); each
count is corrected for that filter's false positives, and the language with
the largest corrected share decides.  The score is that share, 0 to 1.

Filters are fitted on a bounded sample of labelled documents: at most about
``PER_LANGUAGE`` by language, chosen by a hash of the id.  An n-gram
(``N`` code points of lower-case letters, other characters as one space)
belongs to a language if it occurs in at least ``MIN_SHARE`` of the sampled
documents and at least ``MIN_RATIO`` as often as in its strongest language.

Null text, empty text and text without a letter: ``und``, score 0.  Text with
letters but no known n-gram: the most frequent learned language, score 0; of
languages with equal shares (or equally many rows) the first by code point.
Rows without label or text are not learned from; without any label all is
``und``.  Repeated rows count as often as they stand and are judged alike, rows
without id too (they share one place in the sample).  Further columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import grams, mix, row_slices, text_buffer

N = 4
POSITIONS = 1 << 20
HASHES = 3
PER_LANGUAGE = 8_000
MIN_SHARE, MIN_RATIO = 0.003, 0.35
MAX_LANGUAGES = 64
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Code point to its lower-case letter, 0 for anything that is no letter."""
    if not _letters:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _letters.append(table)
    return _letters[0]


def _row_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram hashes, bounds of each row in them, whether each row has a letter)."""
    part = data[int(offsets[0]) : int(offsets[-1])]
    rows = offsets - offsets[0]
    heads = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
    first = heads[rows]
    points = np.frombuffer(part.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = np.insert(_letter_table()[points], first[:-1], 0)  # a space before each text
    first = first + np.arange(len(first))
    held = np.concatenate(([0], np.cumsum(letters != 0)))
    has = np.diff(held[first]) > 0
    keep = letters != 0
    keep[1:] |= letters[:-1] != 0
    keep[first[:-1]] = True
    kept = np.concatenate(([0], np.cumsum(keep)))
    line, bounds = letters[keep].astype(np.uint64), kept[first]
    g = grams(line, N)
    ends = np.maximum(bounds[1:] - N + 1, bounds[:-1])
    inside = np.zeros(len(line) + 1, np.int64)
    np.add.at(inside, bounds[:-1], 1)
    np.add.at(inside, ends, -1)
    inside = np.cumsum(inside)[: len(g)] > 0
    return g[inside], np.concatenate(([0], np.cumsum(ends - bounds[:-1]))), has


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, documents) summed over each batch."""
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        langs = batch.column(0).to_pylist()
        found: dict[str, list] = {}
        for a, b in row_slices(offsets):
            g, at, _ = _row_grams(data, offsets[a : b + 1])
            for i in range(b - a):
                found.setdefault(langs[a + i], []).append(np.unique(g[at[i] : at[i + 1]]))
        for lang, sets in found.items():
            keys, counts = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts, pa.int64())], ["lang", "gram", "docs"])


def _places(g: np.ndarray) -> list[np.ndarray]:
    h = mix(g)
    return [((h >> np.uint64(21 * i)) & np.uint64(POSITIONS - 1)).astype(np.int64) for i in range(HASHES)]


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        mask = batch.column(1)
        for at in _places(batch.column(0).to_numpy().view(np.uint64)):
            yield pa.RecordBatch.from_arrays([pa.array(at), mask], ["place", "mask"])


class LanguageFilters:
    """Fitted filters: the languages by code point and one mask a position."""

    def __init__(self, languages: list[str], masks: np.ndarray, usual: int):
        self.languages, self.masks, self.usual = languages, masks, usual
        fill = [float(((masks >> masks.dtype.type(i)) & masks.dtype.type(1)).mean()) for i in range(len(languages))]
        self.false_rate = np.array(fill) ** HASHES

    def rates(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Corrected share of each row's n-grams in each language; whether a row has letters."""
        g, at, has = _row_grams(data, offsets)
        places = _places(g)
        hit = self.masks[places[0]]
        for p in places[1:]:
            hit &= self.masks[p]
        n = np.maximum(np.diff(at), 1)
        out = np.zeros((len(n), len(self.languages)))
        one = self.masks.dtype.type(1)
        for i in range(len(self.languages)):
            sums = np.concatenate(([0], np.cumsum((hit >> self.masks.dtype.type(i)) & one, dtype=np.int64)))
            out[:, i] = np.diff(sums[at]) / n
        return np.clip((out - self.false_rate) / np.maximum(1 - self.false_rate, 1e-9), 0, 1), has


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageFilters:
    """Filters from (doc_id, text, lang).  Counting runs on Spark; what reaches the driver is one mask a position."""
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; a mask holds {MAX_LANGUAGES}")
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if len(languages) <= t(0).itemsize * 8)
    masks = np.zeros(POSITIONS, kind)
    if not languages:
        return LanguageFilters([], masks, 0)
    part = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(1.0, per_language / n))) for x, n in sizes.items()])
    taken = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < 1_000_000 * part)
    taken_sizes = {x: min(n, per_language) for x, n in sizes.items()}
    index = {x: i for i, x in enumerate(languages)}
    counts = taken.select("lang", "text").mapInArrow(_presence, "lang string, gram long, docs long").groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))
    total = F.coalesce(*[F.when(F.col("lang") == x, F.lit(float(n))) for x, n in taken_sizes.items()])
    bit = F.coalesce(*[F.when(F.col("lang") == x, F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for x, i in index.items()])
    frequent = counts.withColumn("share", F.col("docs") / total).where((F.col("share") >= MIN_SHARE) & (F.col("docs") >= 2))
    by_gram = frequent.groupBy("gram").agg(F.max("share").alias("top"), F.collect_list(F.struct(F.col("share"), bit.alias("bit"))).alias("in"))
    mask = F.aggregate(F.filter("in", lambda x: x["share"] >= MIN_RATIO * F.col("top")), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x["bit"]))
    placed = by_gram.select("gram", mask.alias("mask")).mapInArrow(_placed, "place long, mask long").groupBy("place").agg(F.bit_or("mask").alias("mask")).toArrow()
    masks[placed["place"].to_numpy()] = placed["mask"].to_numpy().view(np.uint64).astype(kind)
    usual = max(languages, key=lambda x: sizes[x])
    return LanguageFilters(languages, masks, index[usual])


def accepted(docs: DataFrame, filters: LanguageFilters, least: float) -> DataFrame:
    """The rows of ``docs``, whatever else it holds, whose text is in a learned language with at least that share of its n-grams."""
    held, at = docs.sparkSession.sparkContext.broadcast(filters), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            data, offsets = text_buffer(batch.column(at))
            for a, b in row_slices(offsets):
                keep = np.zeros(b - a, bool)
                if model.languages:
                    rates, has = model.rates(data, offsets[a : b + 1])
                    keep = has & (rates.max(axis=1) >= least)
                yield batch.slice(a, b - a).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, filters: LanguageFilters) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs`` (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b in row_slices(offsets):
                ids = batch.column(0).slice(a, b - a)
                if not model.languages:
                    yield pa.RecordBatch.from_arrays([ids, pa.array([UNKNOWN] * (b - a)), pa.array([0.0] * (b - a))], ["doc_id", "lang_pred", "score"])
                    continue
                rates, has = model.rates(data, offsets[a : b + 1])
                best, score = rates.argmax(axis=1), rates.max(axis=1)
                best = np.where(score > 0, best, model.usual)
                names = [model.languages[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), has.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(names, pa.string()), pa.array(np.where(has, score, 0.0))], ["doc_id", "lang_pred", "score"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double")

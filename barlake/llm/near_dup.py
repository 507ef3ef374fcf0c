"""Near-duplicate groups by SetSketch registers, bands, likelihood and an exact check.

1.  One pass over the texts turns each document into its set of distinct
    five-word shingles and keeps ``n_shingles``, a 128-bit key of the set and
    ``REGISTERS`` SetSketch registers: exponential minima truncated to integer
    powers of ``BASE``.  Registers of a union are the element-wise maxima.
2.  Rows with equal sets form a class, a node of the graph of links; one row of
    it goes on.  Nodes have numbers of their own, so an id that stands on rows
    with different texts is a node for each of them.
3.  ``ROWS`` consecutive registers form a band.  Classes that share a band meet
    in a bucket.  Each bucket proposes links to one centre (never all pairs);
    a proposal survives if the likelihood of the three register comparison
    counts still rises at a similarity safely below the threshold, and becomes
    a link if the exact sets agree.  Linked classes merge and buckets that
    still hold several components propose again with other centres.
4.  What then remains (classes that share a bucket but no component) is settled
    exactly: a class too few of whose shingles occur in any other remaining
    class cannot reach the threshold and leaves; the others are compared in
    pairs of blocks, by likelihood and then by their sets.

Two texts at similarity 0.75 share no band of 32 with probability 5e-6.

Null or word-less text: empty set, own component, never linked.  Fewer than
five words: the whole sequence is the only shingle.  Every input row is
returned, repeated ones too.  A row's component is the smallest id among the
rows that its own text reaches; of an id on several texts each row has its own.
A row without id takes the smallest id it reaches, or null, and is ``kept`` only
in the latter case.  ``one_of_each`` keeps exactly one row of a component: the
one of the smallest id (rows without id last) and then text hash; of rows equal
in id and text it keeps one.  Further columns are not read, or kept as they are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, stored
from .words import row_slices, shingle_sets, space_table, text_buffer, words_of

K = 5
ROWS, BANDS = 4, 32
REGISTERS = ROWS * BANDS
BASE, RATE = 1.001, 30.0
THRESHOLD = 0.75
#: Similarity at which the likelihood must still rise: 4.5 standard errors of 128 registers below 0.75.
LIKELY = 0.58
#: Star rounds before the remaining classes are compared directly.
ROUNDS = 2
#: Narrow tables are sent to all executors up to this size, at BROADCAST_ROW bytes a row with its hash entry; beyond it rows are shuffled.
BROADCAST_BYTES, BROADCAST_ROW = 64 << 20, 80

_rng = np.random.default_rng(20240601)
_A = (_rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = (_rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers (uint16) of a set of 64-bit hashes; zeros for the empty set."""
    if not len(shingles):
        return np.zeros(REGISTERS, np.uint16)
    low, high = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), 2048):
        x = low[at : at + 2048, None] * _A
        x += high[at : at + 2048, None] * _B
        np.minimum(least, x.min(axis=0), out=least)
    waits = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(waits) / math.log(BASE)), 0, 65535).astype(np.uint16)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffer(batch.column(2))
        for a, b in row_slices(offsets):
            sizes, keys, sketches = [], [], []
            for s in shingle_sets(words_of(data, offsets[a : b + 1], space_table()), K):
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sketches.append(registers(s).tobytes())
            own = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())], ["doc_id", "text_key", "n_shingles", "set_key", "sketch"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Band keys: the band's number and its four registers hashed to 64 bits."""
    from .words import grams

    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            n = part.num_rows
            r = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(n * BANDS, ROWS)
            whole = np.ascontiguousarray(r).view(np.uint64).ravel()
            pair = np.empty(2 * len(whole), np.uint64)
            pair[0::2], pair[1::2] = whole, np.tile(np.arange(BANDS, dtype=np.uint64), n)
            keys = grams(pair, 2)[0::2]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), BANDS), pa.int64()), pa.array(keys.view(np.int64))], ["node", "band"])


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets reach the threshold."""
    for batch in batches:
        left, right = (text_buffer(batch.column(name)) for name in ("text_a", "text_b"))
        for at in range(batch.num_rows):
            sets = []
            for data, offsets in (left, right):
                sets.append(next(shingle_sets(words_of(data, offsets[at : at + 2], space_table()), K)))
            both = len(np.intersect1d(*sets, assume_unique=True))
            union = len(sets[0]) + len(sets[1]) - both
            if union and 100 * both >= 100 * THRESHOLD * union:
                yield batch.select(["a", "b"]).slice(at, 1)


def rising(up: np.ndarray, down: np.ndarray, same: np.ndarray, n_x: np.ndarray, n_y: np.ndarray, at: float = LIKELY) -> np.ndarray:
    """Whether the joint likelihood of two sketches still rises at similarity ``at``.

    With known set sizes the counts of greater, smaller and equal registers are
    multinomial with p(u - vJ), p(v - uJ) and the rest, where
    p(z) = -log_b(1 - z(b - 1)/b); its logarithm is concave in J.
    """
    c, ln_b = (BASE - 1) / BASE, math.log(BASE)
    u = n_x / (n_x + n_y)
    v = 1 - u
    more, less = np.maximum(u - v * at, 1e-9), np.maximum(v - u * at, 1e-9)
    p_up, p_down = -np.log1p(-more * c) / ln_b, -np.log1p(-less * c) / ln_b
    d_up, d_down = -v * c / (1 - more * c) / ln_b, -u * c / (1 - less * c) / ln_b
    slope = up * d_up / p_up + down * d_down / p_down - same * (d_up + d_down) / np.maximum(1 - p_up - p_down, 1e-9)
    return (slope >= 0) & (np.minimum(n_x, n_y) >= THRESHOLD * np.maximum(n_x, n_y))


def _as_matrix(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint16).reshape(-1, REGISTERS)


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (_as_matrix(batch.column(name).to_pylist()) for name in ("s_a", "s_b"))
        up, same = (x > y).sum(axis=1), (x == y).sum(axis=1)
        keep = rising(up, REGISTERS - up - same, same, batch.column("n_a").to_numpy().astype(float), batch.column("n_b").to_numpy().astype(float))
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _hinted(small: DataFrame) -> DataFrame:
    """``small``, a stored narrow table, to be broadcast if its rows are few enough."""
    return F.broadcast(small) if small.count() * BROADCAST_ROW <= BROADCAST_BYTES else small


def components(links: DataFrame, steps: int | None = None) -> DataFrame:
    """(node, component): the smallest node reachable over links (a, b).

    Each step takes the least label among neighbours and then the label of that
    label, and writes the table.  Without ``steps`` this ends when nothing
    changes; with it, labels are nodes of the same component, not yet the least.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.col("node").alias("was"), F.least("node", "b").alias("component")), "labels")
    while steps is None or steps > 0:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").select(F.col("a").alias("node"), "component", F.lit(None).cast("long").alias("was"))
        least = near.union(labels.select("node", "component", F.col("component").alias("was"))).groupBy("node").agg(F.min("component").alias("now"), F.max("was").alias("was"))
        jump = labels.select(F.col("node").alias("now"), F.col("component").alias("next"))
        moved = stored(least.join(jump, "now").select("node", "was", F.least("now", "next").alias("component")), "labels")
        dropped(labels)
        labels = moved
        if steps is not None:
            steps -= 1
        elif moved.where("was <> component").isEmpty():
            break
    dropped(both)
    return labels


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        for a, b in row_slices(offsets):
            sets = [s.tobytes() for s in shingle_sets(words_of(data, offsets[a : b + 1], space_table()), K)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sets, pa.binary())], ["node", "shingles"])


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = batch.column(1).to_pylist()
        flat = np.frombuffer(b"".join(sets), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), [len(x) // 8 for x in sets])), pa.array(flat)], ["node", "shingle"])


#: Bytes of shingle sets in a block of bucket members, and blocks that meet all others of their bucket in one task.
BLOCK_BYTES, STRIPE = 1 << 20, 16


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):  # one pair of blocks in memory
            left, right = (c[at].as_py() for c in batch.columns)
            component, n = np.array([r["component"] for r in right]), np.array([r["n_shingles"] for r in right], float)
            sketch = _as_matrix([r["sketch"] for r in right])
            flat = np.frombuffer(b"".join(r["shingles"] for r in right), np.uint64)
            ends = np.cumsum(n).astype(np.int64)
            met: set[tuple[int, int]] = set()
            for r in left:
                s = np.frombuffer(r["sketch"], np.uint16)
                up, same = (s > sketch).sum(axis=1), (s == sketch).sum(axis=1)
                likely = (component != r["component"]) & rising(up, REGISTERS - up - same, same, np.full(len(n), float(r["n_shingles"])), n)
                if not likely.any():
                    continue
                own = np.frombuffer(r["shingles"], np.uint64)
                place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                both = np.diff(np.concatenate(([0], np.cumsum(own[place] == flat)[ends - 1])))
                for k in np.flatnonzero(likely & (100 * both >= 100 * THRESHOLD * (n + len(own) - both))).tolist():
                    pair = (min(r["component"], int(component[k])), max(r["component"], int(component[k])))
                    if pair not in met:
                        met.add(pair)
                        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in pair], ["a", "b"])


class _Graph:
    """The nodes of one run and the written tables that describe them."""

    def __init__(self, docs: DataFrame):
        text = F.col("text").cast("string")
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
        sketched = self.docs.mapInArrow(_sketch, "doc_id long, text_key long, n_shingles long, set_key binary, sketch binary")
        sketches = stored(sketched.withColumn("row", F.monotonically_increasing_id()), "sketches")
        # only sets that several rows have: a few of the corpus as a rule
        shared = sketches.where("n_shingles > 0").groupBy("set_key").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1")
        self.classes = stored(shared.select("set_key", F.col("first").alias("node")), "classes")
        marked = sketches.join(_hinted(self.classes), "set_key", "left").withColumn("node", F.coalesce("node", "row"))
        #: every row, with its node
        self.members = stored(marked.select("doc_id", "text_key", "n_shingles", "node", (F.col("node") == F.col("row")).alias("first")), "members")
        #: one row a node with words
        self.reps = stored(marked.where("node = row and n_shingles > 0").select("node", "doc_id", "text_key", "n_shingles", "sketch"), "reps")
        dropped(sketches)
        # whether a row that stands for its node has twins, equal in id and text
        other = self.members.where("not first").select("node", F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
        self.twins = not other.join(self.reps.drop("sketch"), "node").where("doc_id <=> _id and text_key = _key").isEmpty()

    def texts(self, nodes: DataFrame) -> DataFrame:
        """(node, text) of distinct ``nodes``."""
        wanted = stored(self.reps.join(nodes, "node", "left_semi").select("node", F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")), "wanted")
        found = self.docs.join(_hinted(wanted), F.col("text_key").eqNullSafe(F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("node", "text")
        return found.dropDuplicates(["node"]) if self.twins else found

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full texts reach the threshold."""
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        texts = self.texts(nodes)
        left, right = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        return stored(pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(_agree, "a long, b long"), "links")

    def buckets(self) -> DataFrame:
        """(band, node) of all bands that several nodes have."""
        banded = self.reps.select("node", "sketch").mapInArrow(_bands, "node long, band long")
        # written, so that the join below has nothing but rows on both sides and a hot band can be split
        several = stored(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band"), "several")
        out = stored(banded.join(several, "band"), "buckets")
        dropped(several)
        return out

    def likely(self, pairs: DataFrame) -> DataFrame:
        s = self.reps.select("node", "n_shingles", "sketch")
        with_a = pairs.join(s.select(F.col("node").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sketch").alias("s_a")), "a")
        with_b = with_a.join(s.select(F.col("node").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sketch").alias("s_b")), "b")
        return stored(with_b.select("a", "b", "n_a", "s_a", "n_b", "s_b").mapInArrow(_likely, "a long, b long"), "pairs")

    def links(self) -> tuple[DataFrame, DataFrame]:
        """(labels (node, component), their parts): links of all classes that share a bucket."""
        buckets = self.buckets()
        spent, done, links = [], None, None
        for turn in range(ROUNDS):
            labels = None if links is None else components(links, steps=1)
            pairs = _star(_labelled(buckets, labels), turn)
            if done is not None:
                pairs = pairs.join(done, ["a", "b"], "left_anti")
            pairs = self.likely(pairs)
            found = self.verified(pairs)
            done = pairs if done is None else done.union(pairs)
            links = found if links is None else links.union(found)
            spent += [x for x in (labels, pairs, found) if x is not None]
        labels = components(links)
        more = self._remaining(_labelled(buckets, labels))
        if not more.isEmpty():
            joined = components(more.union(labels.select("node", "component")))
            dropped(labels)
            labels = joined
        dropped(buckets, more, *spent)
        return labels.select("node", "component"), labels

    def _remaining(self, members: DataFrame) -> DataFrame:
        """Links between different components of a bucket, found exactly; one a pair of components and blocks.

        A link needs at least 3/7 of the two set sizes in common.  The shingles
        of a class that occur in any other remaining class bound what it can
        share, so classes below that bound (for the smallest mate in their
        buckets) leave.  The others are dealt by hash into blocks, and every
        pair of a bucket's blocks is compared in one step.  A task takes a
        stripe of blocks against all: none holds a whole bucket, and neither
        candidates nor links inside a component are emitted.
        """
        sized = stored(members.join(self.reps.select("node", "n_shingles"), "node"), "open")
        if sized.isEmpty():
            return stored(sized.select(F.col("node").alias("a"), F.col("component").alias("b")), "links")
        least = stored(sized.groupBy("band").agg(F.min("n_shingles").alias("least")), "least")
        mates = sized.join(least, "band").groupBy("node", "n_shingles").agg(F.min("least").alias("least"))
        sets = stored(self.texts(sized.select("node").distinct()).mapInArrow(_sets, "node long, shingles binary"), "sets")
        rows = sets.mapInArrow(_shingle_rows, "node long, shingle long")
        shared = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("x"))
        # every occurrence but those that stand alone
        alone = shared.where("n = 1").groupBy(F.col("x").alias("node")).agg(F.count("*").alias("alone"))
        need = (F.col("n_shingles") + F.greatest("least", THRESHOLD * F.col("n_shingles"))) * THRESHOLD / (1 + THRESHOLD)
        able = stored(mates.join(alone, "node", "left").where(F.col("n_shingles") - F.coalesce("alone", F.lit(0)) >= need - 1e-6).select("node"), "able")
        kept = sized.join(able, "node")
        blocks = F.ceil(F.sum("n_shingles") * 8 / BLOCK_BYTES)
        sizes = stored(kept.groupBy("band").agg(blocks.alias("blocks"), F.min("component").alias("u"), F.max("component").alias("v")).where("u < v").select("band", "blocks"), "sizes")
        full = kept.join(self.reps.select("node", "sketch"), "node").join(sets, "node").join(sizes, "band")
        dealt = full.withColumn("block", F.pmod(F.xxhash64("node", "band"), F.col("blocks")).cast("int"))
        packed = stored(dealt.groupBy("band", "blocks", "block").agg(F.collect_list(F.struct("node", "component", "n_shingles", "sketch", "shingles")).alias("rows")), "blocks")
        x = packed.select("band", F.expr(f"block div {STRIPE}").alias("stripe"), F.col("block").alias("i"), F.col("rows").alias("x"))
        y = packed.select("band", F.explode(F.sequence(F.lit(0), F.expr(f"block div {STRIPE}"))).alias("stripe"), F.col("block").alias("j"), F.col("rows").alias("y"))
        out = stored(x.join(y, ["band", "stripe"]).where("i <= j").select("x", "y").mapInArrow(_block_links, "a long, b long").distinct(), "links")
        dropped(members, sized, least, sets, able, sizes, packed)
        return out

    def grouped(self) -> DataFrame:
        """(doc_id, text_key, n_shingles, component_id, chosen) of every row; ``chosen`` is the row that stands for its component, or its twin."""
        labels, held = self.links()
        # nodes with several rows or with links; all others are their own component
        alone = self.classes.select("node").join(labels, "node", "left_anti").withColumn("component", F.col("node"))
        nodes = stored(labels.union(alone), "nodes")
        rank = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
        least = self.members.join(_hinted(nodes), "node").groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min(rank).alias("best"))
        known = stored(nodes.join(least, "component").select("node", "component_id", F.col("best.doc_id").alias("_id"), F.col("best.text_key").alias("_key"), F.lit(True).alias("_grouped")), "components")
        dropped(held, nodes, self.classes, self.reps)
        chosen = F.col("_grouped").isNull() | (F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
        own = F.when(F.col("_grouped"), F.col("component_id")).otherwise(F.col("doc_id"))
        return self.members.join(_hinted(known), "node", "left").select("doc_id", "text_key", "n_shingles", own.alias("component_id"), chosen.alias("chosen"))


def _labelled(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Bucket members (band, node, component) of buckets that hold several components so far."""
    out = buckets.withColumn("component", F.col("node"))
    if labels is not None:
        out = buckets.join(labels.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    out = stored(out, "labelled")
    several = stored(out.groupBy("band").agg(F.min("component").alias("u"), F.max("component").alias("v")).where("u < v").select("band"), "several")
    kept = stored(out.join(several, "band"), "labelled")
    dropped(out, several)
    return kept


def _star(members: DataFrame, turn: int) -> DataFrame:
    """One proposal for each member to its bucket's centre; centres differ by turn and bucket."""
    order = F.xxhash64("component", "band", F.lit(turn)) if turn else F.col("node")
    centre = members.groupBy("band").agg(F.min(F.struct(order.alias("o"), F.col("node").alias("c"), F.col("component").alias("cc"))).alias("m")).select("band", "m.c", "m.cc")
    return members.join(stored(centre, "centres"), "band").where("component <> cc").select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text)."""
    rows = _Graph(docs).grouped()
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, whatever else it holds, without near duplicates: one row of each component stays."""
    rows = stored(_Graph(docs).grouped(), "grouped")
    key = [F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_key")]
    names = [f"_c{i}" for i in range(len(docs.columns))]
    whole = docs.select(F.struct(*[docs[c].alias(n) for c, n in zip(docs.columns, names, strict=True)]).alias("_row"), *key)
    gone = stored(rows.where("not chosen").select("doc_id", "text_key").distinct(), "gone")
    # of chosen rows equal in id and text, one stays; rows without words are never duplicates
    twins = stored(rows.where("chosen and n_shingles > 0").groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "text_key"), "twins")

    def among(few: DataFrame, how: str) -> DataFrame:
        return whole.join(_hinted(few), F.col("_id").eqNullSafe(F.col("doc_id")) & F.col("_key").eqNullSafe(F.col("text_key")), how)

    out = among(gone, "left_anti")
    if not twins.isEmpty():
        out = among(gone.union(twins), "left_anti").union(among(twins, "left_semi").dropDuplicates(["_id", "_key"]))
    return out.select(*[F.col(f"_row.{n}").alias(c) for c, n in zip(docs.columns, names, strict=True)])

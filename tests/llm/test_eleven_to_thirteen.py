"""Merkle manifest, collocations and permutation index against brute force, with odd rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barlake.llm import double_array, merkle, neighbours, phrases, places
from barlake.llm.double_array import DoubleArray

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, i int, hash string, number double"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7, "clash", 1.0) for r in rows], SCHEMA)


# --- places ------------------------------------------------------------------------------------


def test_places_are_dense_and_in_order(spark):
    values = [(int(v),) for v in np.random.default_rng(0).integers(0, 40, 500)]
    got = [(r.place, r.v) for r in places.placed(spark.createDataFrame(values, "v long"), [F.col("v")]).collect()]
    assert [v for _, v in sorted(got)] == sorted(v for (v,) in values)
    assert sorted(p for p, _ in got) == list(range(500))


# --- 11 Merkle manifest ------------------------------------------------------------------------


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def one_leaf(doc_id, text, lang, source, n_chars):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return digest("".join(parts))


def climbed(level):
    levels = [level]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest("".join(last[j : j + 3])) for j in range(0, len(last), 3)])
    return levels


def brute_manifest(rows):
    leaves = sorted([(r[3] is not None, r[3] or "", r[0] is not None, r[0] or 0, one_leaf(*r), r) for r in rows], key=lambda x: (*x[:1], x[1].encode(), *x[2:5]))
    groups = {}
    for known, source, *_, leaf, row in leaves:
        groups.setdefault((known, source), []).append((leaf, row))
    trees = [climbed([leaf for leaf, _ in g]) for g in groups.values()]
    top = climbed([t[-1][0] for t in trees])
    out = []
    for a, (group, tree) in enumerate(zip(groups.values(), trees, strict=True)):
        for b, (leaf, row) in enumerate(group):
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[1] is not None
            at, proof = one_leaf(row[0], row[1].replace("\n", "") if changed else row[1], *row[2:]), ""
            for levels, place in ((tree, b), (top, a)):
                for level in levels[:-1]:
                    first = place // 3 * 3
                    left, right = "".join(level[first:place]), "".join(level[place + 1 : first + 3])
                    at, proof, place = digest(left + at + right), proof + left + right, place // 3
            out.append((row[0], leaf, tree[-1][0], top[-1][0], digest(proof), at, at == top[-1][0]))
    return Counter(out)


def some_rows(n, sources, seed=0):
    rng = np.random.default_rng(seed)
    pick = lambda: sources[int(rng.integers(len(sources)))] if rng.random() < 0.6 else sources[0]
    return [(i if rng.random() < 0.95 else None, None if rng.random() < 0.1 else f"té\nxt {rng.integers(9)}\n", "en" if i % 3 else None, pick(), i if i % 5 else None) for i in range(n)]


@pytest.mark.parametrize(("n", "sources"), [(1, ["a"]), (1, [None]), (4, ["a"]), (40, [None, "", "b", "é", "z"]), (300, ["hot", *map(str, range(30)), None])])
def test_manifest_is_brute_force(spark, monkeypatch, n, sources):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "LEAVES", 16)
    rows = some_rows(n, sources) + some_rows(n, sources)[:2] * 2  # repeated rows and ids
    got = merkle.tamper_check(table(spark, rows))
    assert Counter(map(tuple, got.collect())) == brute_manifest(rows)


def test_manifest_of_nothing(spark):
    assert merkle.tamper_check(table(spark, [])).count() == 0


def test_proofs_of_some_leaves_ask_for_little(spark):
    rows = [(i, f"t{i}", "en", "s", i) for i in range(243)]
    kept = table(spark, rows).select("doc_id", "source", merkle.leaf([F.col("text")]).alias("leaf"))
    manifest = merkle.build(kept, "source", ("doc_id",))
    some = manifest.leaves.where(F.col("doc_id").isin(0, 1, 2, 100))
    got = merkle.proofs(manifest, some).withColumn("root", merkle.fold(F.col("leaf"), F.col("proof")))
    assert {r.root for r in got.collect()} == {manifest.root} and got.count() == 4
    tree = np.zeros(4, np.int64)
    asked = [missing for *_, missing in merkle._levels(tree, np.array([0, 1, 2, 100]), np.full(4, 243), 1)]
    assert [len(x) for x in asked] == [len(set(x)) for x in asked] == [2, 4, 4, 4, 1]  # a run of leaves is whole, the last run is shared
    assert manifest.nodes.count() == 243 + 81 + 27 + 9 + 3 + 1 + 1


# --- 12 collocations ---------------------------------------------------------------------------


def brute_phrases(rows, threshold, best):
    count, total = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            count.update((lang, *w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    found = {p: a for p, a in count.items() if len(p) > 2 and a >= threshold}
    inside = {(q, a) for p, a in found.items() for k in range(2, len(p) - 1) for i in range(1, len(p) - k + 1) for q in [(p[0], *p[i : i + k])] if len(q) < len(p)}
    out = []
    for p, a in found.items():
        if any((p, b) in inside for b in [a]):
            continue
        lang, w, n = p[0], p[1:], total[p[0]]
        score, _, left, right = min((1000 * a * n // (count[lang, *w[:k]] * count[lang, *w[k:]]), k, count[lang, *w[:k]], count[lang, *w[k:]]) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), left, right, n))
    rank, rows = Counter(), []
    for lang, score, a, phrase, left, right, n in sorted(out):
        rank[lang] += 1
        if rank[lang] <= best:
            rows.append((lang, rank[lang], phrase.decode(), -a, left, right, n, -score))
    return rows


def some_texts(n, seed=0):
    rng = np.random.default_rng(seed)
    words = ["a", "B", "b", "c", "new", "york", "city", "é", "x\x00", "漢"]
    ends = [" ", " ", " ", " ", "\t", ", ", ".", "\n", "\x0b "]
    out = []
    for i in range(n):
        text = "".join(str(rng.choice(words)) + ("" if rng.random() < 0.02 else str(rng.choice(ends))) for _ in range(int(rng.integers(0, 40))))
        text += " in New York City hall today." * int(rng.integers(0, 2))
        out.append((i, None if i % 17 == 5 else text, [None, "und", "en", "en", "de", ""][i % 6], "s", 1))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_collocations_are_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in (("SHARD", 64), ("VOCABULARY", 5), ("TRIE", 7)):  # many shards, blocks of words and of tries
            monkeypatch.setattr(phrases, name, value)
    rows = some_texts(600)
    got = phrases.collocations(table(spark, rows), best=25, threshold=12)
    assert sorted(map(tuple, got.collect())) == sorted(brute_phrases(rows, 12, 25)) and got.count() > 60


def test_collocations_of_little(spark):
    assert phrases.collocations(table(spark, [])).count() == 0
    assert phrases.collocations(table(spark, [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "one two three", "en", "s", 3)])).count() == 0
    long = [(1, "to be " * 60_000, "en", "s", 0)] * 3  # repeated rows count each; pieces of any length
    got = phrases.collocations(table(spark, long)).collect()
    assert [(r.phrase, r.a, r.n) for r in got if r.phrase == "to be to be to"] == [("to be to be to", 3 * 119_996 // 2, 360_000)]


def test_scores_beyond_64_bits(spark, monkeypatch):
    big = 10**12
    words = [([i], "en", w, w, n, 1) for i, (w, n) in enumerate((("of", 10 * big), ("the", 20 * big)))]
    pair = [([0, 1], "en", "of the", "the", 7 * big + 3, 2)]
    known = spark.createDataFrame(words + pair, "words array<long>, lang string, phrase string, last string, n long, k int")
    monkeypatch.setattr(phrases, "frequent_phrases", lambda *a: (known, spark.createDataFrame([("en", 90 * big + 1)], "lang string, total long")))
    (r,) = phrases.collocations(known).collect()
    assert r.score == 1000 * (7 * big + 3) * (90 * big + 1) // (10 * big * 20 * big)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4), st.lists(st.lists(st.integers(0, 6), min_size=4, max_size=4), max_size=30), st.lists(st.integers(-1, 8), max_size=60))
def test_double_array_counts(depth, sequences, ids):
    rows = np.unique(np.array([s[:depth] for s in sequences], np.int64).reshape(-1, depth), axis=0)
    trie = DoubleArray.load(DoubleArray.of(rows).dump())
    want = Counter(tuple(ids[i : i + depth]) for i in range(len(ids) - depth + 1))
    whole, double_array.WINDOW = double_array.WINDOW, 7
    try:
        assert trie.counts(np.array(ids, np.int64)).tolist() == [want[tuple(r)] for r in rows.tolist()]
    finally:
        double_array.WINDOW = whole


# --- 13 permutation index ----------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame([(i, x, "clash", 1.0, 2) for i, x in rows], "vec_id long, embedding array<float>, id string, x double, score int")


def brute_nearest(rows, k):
    usable = [(i, np.array(x, np.float32).astype(float)) for i, x in rows if i is not None and x and None not in x and np.isfinite(x).all() and any(x)]
    size = Counter(len(x) for _, x in usable)
    usable = [(i, x) for i, x in usable if len(x) == min(size, key=lambda d: (-size[d], d))]
    out = {}
    for q, y in usable:
        if q % 20 == 0:
            near = sorted([(-(x * y).sum(), i) for i, x in usable if i != q])[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def as_lists(df):
    out = {}
    for r in sorted(df.collect()):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_few_vectors_are_exact(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 50)
    monkeypatch.setattr(neighbours, "BLOCK", 3)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(200)]
    rows += [(i, rows[7][1]) for i in range(200, 290)]  # copies beyond k, ties to smaller ids
    odd = [(300, None), (301, []), (302, [0.0] * 6), (303, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (304, [float("nan")] * 6), (320, [float("inf")] * 6), (None, [1.0] * 6), (306, [1.0, 2.0])]
    got = as_lists(neighbours.nearest(vectors(spark, rows + odd), F.col("vec_id") % 20 == 0, 20))
    want = brute_nearest(rows + odd, 20)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert all(a[1] == pytest.approx(b[1], abs=1e-12) for q in got for a, b in zip(got[q], want[q], strict=True))


def test_fewer_candidates_than_asked(spark):
    assert neighbours.nearest(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours.nearest(vectors(spark, [(0, [1.0, 2.0])]), F.col("vec_id") % 20 == 0).count() == 0
    assert as_lists(neighbours.nearest(vectors(spark, [(0, [1.0, 2.0]), (1, [3.0, -1.0])]), F.col("vec_id") % 20 == 0)) == {0: [(1, 1.0)]}


def test_footrule_is_the_sum_of_shared_places():
    rng = np.random.default_rng(0)
    k, pivots = 5, 12
    a, b = (rng.permutation(pivots)[:k].tolist() for _ in range(2))
    rank = lambda order: {p: r for r, p in enumerate(order)}
    ra, rb = rank(a), rank(b)
    footrule = sum(abs(ra.get(p, k) - rb.get(p, k)) for p in {*a, *b})
    shared = sum(min(k - ra[p], k - rb[p]) for p in {*a} & {*b})
    assert footrule == k * (k + 1) - 2 * shared


@pytest.mark.parametrize("norms", [False, True])
def test_recall(spark, norms):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(12, 24))
    x = centre[rng.integers(12, size=12_000)] + rng.normal(size=(12_000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True) if not norms else 1.0
    df = vectors(spark, [(i, v) for i, v in enumerate(x.tolist())])
    found = neighbours.nearest(df, F.col("vec_id") % 400 == 0)
    assert neighbours.recall(found, df, list(range(0, 12_000, 2400))) >= 0.9


def test_the_blocks_hold_whole_permutations():
    y = np.eye(4)
    assert neighbours._permutations(y, y, 4)[2].tolist() == [2, 0, 1, 3]  # ties to the smaller pivot
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([[1.0], [2.0], [3.0]])], ["id", "x"])
    assert [a.tolist() for a, _ in neighbours._slabs(iter([batch, batch]), 1, 4)] == [[1, 2, 3, 1], [2, 3]]


# --- rows without id in earlier operators --------------------------------------------------------


def test_sources_without_ids_meet_their_targets(spark):
    from barlake.llm import mixing

    rows = [(i if i % 2 and s != "b" else None, f"w{i} " * (1 + i % 7), "en", s, 1) for s in "abc" for i in range(400)]
    got = mixing.mixed(table(spark, rows).select("doc_id", "text", "source")).collect()
    kept = mixing.with_copies(mixing.sizes(table(spark, rows)), mixing.thresholds(mixing.sizes(table(spark, rows))))
    taken = {r.source: (r.taken, r.target) for r in kept.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()}
    assert len(got) == 1200 and all(abs(t - goal) <= 7 / 2 + 1 for t, goal in taken.values())


def test_media_are_stored_once_without_ids(spark, tmp_path):
    import tarfile

    from barlake.llm import media

    rows = [(None, f"text {i % 2}", "en", "s", 1) for i in range(40)] + [(5, "same", "en", "s", 1)] * 30 + [(i, f"own {i}", "en", "s", 1) for i in range(6)] + [(7, "text 1", "en", "s", 1)]
    got = media.media_columns(table(spark, rows).repartition(4)).collect()
    assert len(got) == len(rows) and len({(r.media_uri, r.media_offset) for r in got}) == 9
    assert sum(len(tarfile.open(u.removeprefix("file://")).getmembers()) for u in {r.media_uri for r in got}) == 9
    fields = {r.digest: r.feature for r in got}
    payload = np.frombuffer(b"same".ljust(64, b"\0"), np.uint8)
    levels = "/".join(map(str, np.bincount(payload >> 5, minlength=8).tolist()))
    assert fields[hashlib.sha256(b"same").hexdigest()] == f"64x1x8;mean={payload.mean():.6f};levels={levels}"


def test_a_sample_of_rows_without_ids_is_bounded(spark):
    from barlake.llm import langid

    rows = [(None, f"the cat number {i} sat on the mat", "en", "s", 1) for i in range(3000)] + [(None, f"le chat {i} est sur le tapis", "fr", "s", 1) for i in range(3000)]
    filters = langid.fit(table(spark, rows), per_language=300)
    assert {r.lang_pred for r in langid.identify(table(spark, [(1, "the cat sat", None, None, None)]), filters).collect()} == {"en"}
    part = table(spark, rows).where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < 100_000).count()
    assert 450 < part < 750


def test_numbers_that_do_not_fit_are_errors():
    from barlake.llm import lm

    lm._fits(np.array([2**32 - 1]), np.zeros(0, np.int64))
    with pytest.raises(OverflowError, match="32 bits"):
        lm._fits(np.array([1, 2**32]))

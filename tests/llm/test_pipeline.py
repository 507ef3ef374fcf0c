"""The pipeline's stages: what each keeps, and the whole run against brute force."""

import hashlib
import math
import re
from collections import Counter

import numpy as np

import corpus_pipeline as cp
from barlake.llm import token_shards
from tests.llm.test_operators import brute_components, brute_hits, edited, prose, water


def test_stages_keep_clean_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    junk = spark.createDataFrame([(10**9, "123 456 !!", "en", "src0", 10), (10**9 + 1, None, None, None, None)], docs.schema)
    stages = dict(cp.STAGES)
    kept = stages["language"](spark, docs.union(junk), sf_dir)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()
    marked = docs.limit(20).union(spark.createDataFrame([(10**9, item.text, "en", "src0", len(item.text))], docs.schema))
    clean = stages["decontamination"](spark, marked, sf_dir)
    assert clean.where("doc_id = 1000000000").count() == 0 and clean.count() >= 15
    mixed = stages["mixing"](spark, docs.limit(50), sf_dir)
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id").count().where("count > 3").count() == 0
    assert [n for n, _ in cp.STAGES] == ["language", "near_dup", "decontamination", "mixing", "tokens"]


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def brute_mix(rows):
    """How often each row (doc_id, text, lang, source) is taken: targets by filling, then by the hash of id and text."""
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    target, out = water(sizes), []
    for source, size in sizes.items():
        own = [r for r in rows if r[3] == source]
        base = math.floor(target[source] / size) if size else 0
        rest = target[source] - base * size
        steps = Counter()
        for r in own:
            steps[hashed(r)] += len(words(r[1]))
        ran, edge = 0, 1 << 60
        for h, n in sorted(steps.items()):
            if n and ran + n > rest:
                edge = h + (1 if 2 * (rest - ran) >= n else 0)
                break
            ran += n
        out += [r for r in own for _ in range(min(3, base + (1 if rest > 0 and hashed(r) < edge else 0)))]
    return out


def hashed(r):
    return int(hashlib.md5(f"{'' if r[0] is None else r[0]}:{r[1] or ''}".encode()).hexdigest()[:15], 16)


def brute_run(rows, items):
    """The tokens that the pipeline should write of rows that are all in a known language or have no letters."""
    rows = [r for r in rows if r[1] is not None and re.search("[a-z]", r[1])]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    rows = [rows[i] for i in order]
    component, _ = brute_components([r[1] for r in rows])
    rows = [r for i, r in enumerate(rows) if component[i] == i]
    hits = brute_hits([r[1] for r in rows], items)
    rows = [r for r, (n, hit, _) in zip(rows, hits, strict=True) if not (hit and 20 * hit >= n)]
    encoder = token_shards._encoder(cp.TOKENIZER, token_shards.Tokenizer.PATTERN)
    return rows, Counter(i for r in brute_mix(rows) for i in [*encoder.encode_ordinary(r[1]), 50256])


def given_tables(spark, folder, rows, items):
    made = spark.createDataFrame([(*r, len(r[1] or ""), "clash", 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, h string, copies int").repartition(3)
    made.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return made


def test_the_whole_run_is_brute_force(spark, tmp_path):
    base = [prose(i, 90) for i in range(40)]
    rows = [(i, t, "en", ("a", "b", None, "c")[i % 4]) for i, t in enumerate(base)]
    rows += [(100 + i, edited(base[i], i, 2), "en", "b") for i in range(8)] + [(None, base[9], "en", "a"), (None, prose(77, 60), "en", "a"), (None, prose(78, 70), None, "a")]
    rows += [(50, base[3], "en", "a")] * 2 + [(60, None, None, "a"), (61, "", "en", "b"), (62, "12 34 !", "en", "b"), (63, "alpha beta", "en", None), (64, "alpha beta", "en", None)]
    items = [(1, prose(200, 30)), (2, None)]
    rows += [(70, f"{prose(300, 60)} {items[0][1]}", "en", "a"), (71, f"{prose(301, 900)} {items[0][1]}", "en", "c")]
    given_tables(spark, tmp_path, rows, items)
    kept, want = brute_run(rows, items)
    out = cp.run(spark, str(tmp_path)).collect()
    found = Counter()
    for x in token_shards.read_from(out[0].uri.rpartition("/")[0], 0):
        found.update(np.asarray(x).tolist())
    padding = sum(token_shards.LENGTH - r.n_ids for r in out)
    assert found - Counter({50256: padding}) == want
    ids = {d for r in out for d in r.doc_ids}
    assert ids <= {r[0] for r in kept} and 70 not in ids and 71 in {r[0] for r in kept} and 62 not in ids


def test_stages_bear_any_table(spark, tmp_path):
    rows = [(None, prose(1, 40), "en", None), (None, prose(1, 40), "en", None), (2, prose(2, 40), None, "s"), (2, prose(3, 40), "en", "s"), (3, None, None, None), (4, "", "en", "s"), (5, " ".join(prose(i, 4000) for i in range(5)), "en", "s")]
    docs = given_tables(spark, tmp_path, rows, [(1, prose(2, 40))])
    for name, stage in cp.STAGES:
        empty = stage(spark, docs.where("false"), str(tmp_path))
        assert empty.count() == 0, name
        out = stage(spark, docs, str(tmp_path))
        assert name == "tokens" or out.columns == docs.columns == empty.columns, name
    stages = dict(cp.STAGES)
    near = sorted(map(str, (r.doc_id for r in stages["near_dup"](spark, docs, str(tmp_path)).collect())))
    assert near == ["2", "2", "3", "4", "5", "None"]  # of the equal rows without id one; texts without words stay
    clean = [r.text for r in stages["decontamination"](spark, docs, str(tmp_path)).collect()]
    assert len(clean) == 6 and prose(2, 40) not in clean
    sequences = stages["tokens"](spark, docs, str(tmp_path)).collect()
    assert sum(i is None for r in sequences for i in r.doc_ids) >= 1 and sum(r.n_ids for r in sequences) > 20_000

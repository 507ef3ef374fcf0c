"""Queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(doc_id: str, folds: int) -> Column:
    """crc32 of an id's text modulo the number of folds."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base counts and digest, and all spans."""
    from .pii import KINDS, identifiers

    found = identifiers(_table(spark, sf_dir, "documents"))

    def joined(spans: Column) -> Column:
        rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
        ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], rank[s["kind"]].alias("rank"), s["end"], s["kind"])))
        return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(spans: str, kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    counts = {f"n_{k}": count("base", k) for k in KINDS}
    extra = {f"n_{k}_added": count("added", k) for k in KINDS}
    return found.select(
        "doc_id", *[v.alias(k) for k, v in counts.items()], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"), *[v.alias(k) for k, v in extra.items()]
    )


def op2_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the multi-line chunks that stand elsewhere before."""
    from .line_chunks import drop_repeated_chunks

    return drop_repeated_chunks(_table(spark, sf_dir, "documents"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    from .mixing import mixed

    return mixed(_table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License templates in every document."""
    from .licenses import license_matches

    found = license_matches(_table(spark, sf_dir, "documents"))
    ids = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["template_id"])))
    spans = F.transform("matches", lambda m: F.concat(m["template_id"], F.lit(":"), m["start"].cast("string"), F.lit(":"), m["end"].cast("string")))
    return found.select("doc_id", "n_words", F.size("matches").cast("long").alias("n_matches"), F.array_join(ids, ",").alias("templates"), F.array_join(spans, ",").alias("spans"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    from .decontam import decontaminate

    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    from .near_dup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram and unigram log-probabilities of every document, learned from six of seven folds."""
    from .lm import fit, scores

    docs = _table(spark, sf_dir, "documents")
    held_out = _fold("doc_id", 7) == 2
    model = fit(docs.where(~held_out))
    return scores(docs, model).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as media, and what its stored bytes say."""
    from .media import media_columns

    return media_columns(_table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from four of five folds."""
    from .langid import fit, identify

    docs = _table(spark, sf_dir, "documents")
    held_out = _fold("doc_id", 5) == 0
    filters = fit(docs.where(~held_out))
    return identify(docs, filters).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token sequence of the documents at its slot of the training order."""
    from .token_shards import materialise

    return materialise(_table(spark, sf_dir, "documents"), TOKENIZER)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest's digests, and every document's proof before and after a trial tampering."""
    from .merkle import tamper_check

    return tamper_check(_table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's best phrases of two to five words."""
    from .phrases import collocations

    return collocations(_table(spark, sf_dir, "documents"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found of every twentieth, among all."""
    from .neighbours import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_pii, op2_line_chunks, op3_mix, op4_licenses, op5_decontaminate, op6_near_dup, op7_lm_score, op8_media, op9_language, op10_token_shards, op11_merkle, op12_collocations, op13_neighbours)
}

#: SQL for the same results; the others are tested against brute force, a round trip or held-out accuracy.
ORACLE_SQL: dict[str, str] = {
    "op3_mix": r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight, source_size * 3.0e0 AS cap, (sum(source_size) OVER ())::DOUBLE AS total FROM p),
k AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS i, coalesce(sum(cap) OVER o, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS open_weight FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, max(CASE WHEN (total - capped) / open_weight * weight <= cap THEN (total - capped) / open_weight END) OVER () AS level FROM k),
g AS (SELECT source, source_size, least(cap, coalesce(level * weight, cap)) AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS base FROM g),
r AS (SELECT *, target - base * source_size AS rest FROM b),
hs AS (SELECT source, h, sum(size) AS size FROM d WHERE size > 0 GROUP BY source, h),
hr AS (SELECT hs.source, hs.h, hs.size, r.rest, sum(hs.size) OVER (PARTITION BY hs.source ORDER BY hs.h) AS ran FROM hs JOIN r ON hs.source IS NOT DISTINCT FROM r.source),
e AS (SELECT source, h + CASE WHEN 2 * (rest - (ran - size)) >= size THEN 1 ELSE 0 END AS threshold FROM hr WHERE ran > rest AND ran - size <= rest),
f AS (SELECT r.*, e.threshold FROM r LEFT JOIN e ON r.source IS NOT DISTINCT FROM e.source),
o AS (SELECT d.doc_id, d.size, f.source_size, f.target, least(3, f.base + CASE WHEN f.rest > 0 AND coalesce(d.h < f.threshold, TRUE) THEN 1 ELSE 0 END)::BIGINT AS copies FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM o
""",
    "op5_decontaminate": r"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all(lower_ascii, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
ig AS (SELECT item_id, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i, w FROM iw WHERE len(w) > 0),
ik AS (SELECT DISTINCT item_id::VARCHAR AS item_id, n, list_aggregate(list_slice(w, i, i + n - 1), 'string_agg', ' ') AS k FROM ig),
ns AS (SELECT DISTINCT n FROM ik),
dg AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM dw, ns WHERE len(w) >= n),
dk AS (SELECT doc_id, n, i, list_aggregate(list_slice(w, i, i + n - 1), 'string_agg', ' ') AS k FROM dg),
m AS (SELECT dk.doc_id, dk.i, dk.n, ik.item_id FROM dk JOIN ik ON dk.n = ik.n AND dk.k = ik.k),
hw AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS at FROM m),
hn AS (SELECT doc_id, count(*) AS n_hit FROM hw GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT dw.doc_id, len(dw.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(dw.w) AS contaminated FROM dw LEFT JOIN hn USING (doc_id) LEFT JOIN hi USING (doc_id)
""",
    "op6_near_dup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, least(5, len(w)) AS n, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i, w FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, list_aggregate(list_slice(w, i, i + n - 1), 'string_agg', ' ') AS k FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x AS doc_id, min(y) AS y FROM r GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.y, w.doc_id)) AS component_id, w.doc_id <= coalesce(m.y, w.doc_id) AS kept FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.doc_id = w.doc_id
""",
    "op11_merkle": r"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
raw AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM documents, tab),
e AS (SELECT doc_id, source, concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head, text, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS cut FROM raw),
d AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS id, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) AS changed FROM e)),
low AS (SELECT s, 0 AS level, i, leaf AS h, n FROM d UNION ALL SELECT s, any_value(level) + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM low WHERE n > 1 GROUP BY s, i // 3),
sub AS (SELECT s, h AS subroot, count(*) OVER () AS trees FROM low WHERE n = 1),
up AS (SELECT 0 AS level, s AS i, subroot AS h, trees AS n FROM sub UNION ALL SELECT any_value(level) + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM up WHERE n > 1 GROUP BY i // 3),
root AS (SELECT h AS root FROM up WHERE n = 1),
st AS (SELECT id, level, coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i < d.i // (3 ** level)::BIGINT), '') AS l, coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i > d.i // (3 ** level)::BIGINT), '') AS r FROM d JOIN low x ON x.s = d.s AND x.n > 1 AND x.i // 3 = d.i // (3 ** (level + 1))::BIGINT GROUP BY id, level
UNION ALL SELECT id, level + 1000, coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i < d.s // (3 ** level)::BIGINT), ''), coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i > d.s // (3 ** level)::BIGINT), '') FROM d JOIN up x ON x.n > 1 AND x.i // 3 = d.s // (3 ** (level + 1))::BIGINT GROUP BY id, level),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY level) AS k FROM st),
fold AS (SELECT id, 0 AS k, changed AS h FROM d UNION ALL SELECT fold.id, k.k, sha256(k.l || fold.h || k.r) FROM fold JOIN k ON k.id = fold.id AND k.k = fold.k + 1),
ended AS (SELECT id, arg_max(h, k) AS folded_root FROM fold GROUP BY id),
pr AS (SELECT id, sha256(string_agg(l || r, '' ORDER BY k)) AS proof FROM k GROUP BY id)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified FROM d JOIN sub USING (s) JOIN ended USING (id) LEFT JOIN pr USING (id), root
""",
    "op12_collocations": r"""
WITH RECURSIVE p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
g AS (SELECT lang, k, list_slice(w, i, i + k - 1) AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT lang, w, unnest(range(1, least(5, len(w)) + 1)) AS k FROM p WHERE len(w) > 0))),
f AS (SELECT lang, k, g, count(*) AS a FROM g GROUP BY lang, k, g),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND a >= 100),
i AS (SELECT DISTINCT lang, unnest([list_slice(g, 1, k - 1), list_slice(g, 2, k)]) AS g, a FROM c WHERE k > 2),
t AS (SELECT c.*, unnest(range(1, k)) AS cut FROM c WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.lang = c.lang AND i.g = c.g AND i.a = c.a)),
s AS (SELECT t.lang, t.g, t.a, x.a AS l, y.a AS r, n.n, t.cut, ((1000::HUGEINT * t.a * n.n) // (x.a::HUGEINT * y.a))::BIGINT AS score FROM t JOIN n ON n.lang = t.lang JOIN f x ON x.lang = t.lang AND x.g = list_slice(t.g, 1, t.cut) JOIN f y ON y.lang = t.lang AND y.g = list_slice(t.g, t.cut + 1, t.k)),
m AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) AS j FROM s),
o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM m WHERE j = 1)
SELECT * FROM o WHERE rank <= 2000
""",
}

"""A Merkle manifest of a table: a digest for all of it, and a proof for every row.

Rows are leaves.  Those of a group (a source) form a tree of three-way nodes in
the order of their ids; the groups' own roots form a tree in the order of the
groups, and its root stands for the table.  Every level is kept: a node is
(tree, level, i, digest), where tree counts the groups and ``TOP`` is the tree
above them.

Proofs are made by octopus multiproofs.  A leaf partition is a stretch of
``LEAVES`` leaves.  It computes which siblings its proofs need that its own
leaves don't yield, level by level and each once; these coordinates are joined
with the nodes in one go; then it derives the interiors that its leaves share
and writes out one proof a leaf.  A partition asks for a few nodes a level, so
the join carries a small part of the tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .places import placed
from .shared import stored

WIDTH = 3
#: Levels that one shuffle builds: a group holds ``WIDTH ** LEVELS`` digests at most.
LEVELS = 6
#: Leaves of a leaf partition.
LEAVES = 4096
TOP = -1


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the text; integers in decimal."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: Sequence[Column]) -> Column:
    """The digest of a row: lowercase hex SHA-256 of its encoded columns, one after another."""
    return F.sha2(F.concat(*[encoded(c) for c in columns]), 256)


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf's digest and a proof lead to."""
    return F.aggregate(proof, start, lambda digest, step: F.sha2(F.concat(step["left"], digest, step["right"]), 256))


def siblings(proof: Column) -> Column:
    """All digests of a proof from the leaf to the root, left to right, as one text."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")


@dataclass
class Manifest:
    """Leaves (their columns, tree, i, n, place), nodes (tree, level, i, digest) and the root, None for an empty table."""

    leaves: DataFrame
    nodes: DataFrame
    trees: int
    root: str | None


def _parents(digests: Column) -> Column:
    """The digests of the runs of a list of digests."""
    runs = F.sequence(F.lit(0), F.floor((F.size(digests) - 1) / WIDTH).cast("int"))
    return F.transform(runs, lambda j: F.sha2(F.array_join(F.slice(digests, j * WIDTH + 1, F.lit(WIDTH)), ""), 256))


def _above(rows: DataFrame, most: int, name: str) -> list[DataFrame]:
    """The levels above ``rows`` (tree, i, digest, n) as stored tables (tree, level, i, digest, n).

    ``n`` is the number of nodes of a row's level in its tree, ``most`` the
    largest.  A round takes ``LEVELS`` levels at once, in groups of consecutive
    nodes: a tree of any size is spread over all tasks.
    """
    found, base, size = [], 0, WIDTH**LEVELS
    while most > 1:
        groups = rows.where("n > 1").groupBy("tree", F.floor(F.col("i") / size).alias("_g")).agg(F.array_sort(F.collect_list(F.struct("i", "digest"))).alias("_nodes"), F.first("n").alias("_n0"))
        groups = groups.withColumn("_d0", F.transform("_nodes", lambda x: x["digest"]))
        for k in range(1, LEVELS + 1):
            up = F.when(F.col(f"_n{k - 1}") > 1, _parents(F.col(f"_d{k - 1}")))
            groups = groups.withColumns({f"_d{k}": up, f"_n{k}": F.ceil(F.col(f"_n{k - 1}") / WIDTH)})

        def nodes(k: int, at: int = base) -> Column:
            first = F.col("_g") * WIDTH ** (LEVELS - k)
            made = F.transform(F.col(f"_d{k}"), lambda d, j: F.struct(F.lit(at + k).alias("level"), (first + j).alias("i"), d.alias("digest"), F.col(f"_n{k}").alias("n")))
            return F.coalesce(made, F.array().cast("array<struct<level:int,i:bigint,digest:string,n:bigint>>"))

        made = stored(groups.select("tree", F.explode(F.concat(*[nodes(k) for k in range(1, LEVELS + 1)])).alias("_x")).select("tree", "_x.*"), name)
        found.append(made)
        base, most = base + LEVELS, -(-most // size)
        rows = made.where(F.col("level") == base)
    return found


def build(rows: DataFrame, group: str, order: Sequence[str], digest: str = "leaf") -> Manifest:
    """The manifest of a table of leaves: ``digest`` is a row's own, ``group`` its tree, ``order`` its order there.

    Groups and orders sort nulls first and text by its UTF-8 bytes; rows equal
    in order sort by digest, and rows equal in that too are alike, whichever
    comes first.  ``rows`` should hold little beside digests: it is sorted once.
    """
    kept = stored(rows, "leaves")
    ordered = placed(kept, [F.col(c).asc_nulls_first() for c in (group, *order, digest)])
    groups = ordered.groupBy(F.col(group).alias("_group")).agg(F.min("place").alias("_first"), F.count("*").alias("n"))
    groups = placed(groups, [F.col("_first")], "tree")
    summary = groups.agg(F.count("*").alias("trees"), F.max("n").alias("most")).first()
    leaves = ordered.join(groups, F.col(group).eqNullSafe(F.col("_group"))).withColumn("i", F.col("place") - F.col("_first")).drop("_group", "_first")
    leaves = stored(leaves, "manifest-leaves")
    level = leaves.select("tree", F.lit(0).alias("level"), "i", F.col(digest).alias("digest"), "n")
    tables = [level, *_above(level.drop("level"), summary["most"] or 0, "manifest-nodes")]
    ends = tables[0].where("n = 1")
    for t in tables[1:]:
        ends = ends.unionByName(t.where("n = 1"))
    top = ends.select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("i"), "digest", F.lit(summary["trees"]).cast("long").alias("n"))
    upper = [stored(top, "manifest-roots")]
    upper += _above(upper[0].drop("level"), summary["trees"], "manifest-nodes")
    root = upper[-1].where("n = 1").first()
    nodes = tables[0]
    for t in [*tables[1:], *upper]:
        nodes = nodes.unionByName(t)
    return Manifest(leaves, nodes.drop("n"), summary["trees"], root and root["digest"])


def _levels(tree: np.ndarray, i: np.ndarray, n: np.ndarray, trees: int):  # noqa: ANN202
    """Level by level (tree, level, known positions, their sizes, missing positions), the tree above all last.

    ``tree`` and ``i`` are the known nodes of level 0, each once; a parent is
    known when its run is, and a run's members that are not known are missing.
    """

    def climb(tree: np.ndarray, i: np.ndarray, n: np.ndarray):  # noqa: ANN202
        level = 0
        while len(i := i[n > 1]):
            tree, n = tree[n > 1], n[n > 1]
            _, first = np.unique(np.stack([tree, i // WIDTH]), axis=1, return_index=True)
            run_tree, run, run_n = tree[first], i[first] // WIDTH, n[first]
            members = (run[:, None] * WIDTH + np.arange(WIDTH)).ravel()
            owners, sizes = np.repeat(run_tree, WIDTH), np.repeat(run_n, WIDTH)
            inside = members < sizes
            members, owners = members[inside], owners[inside]
            known = set(zip(tree.tolist(), i.tolist(), strict=True))
            missing = [x for x in zip(owners.tolist(), members.tolist(), strict=True) if x not in known]
            yield level, run_tree, run, run_n, missing
            tree, i, n, level = run_tree, run, -(-run_n // WIDTH), level + 1

    yield from climb(tree, i, n)
    own = np.unique(tree)
    yield from climb(np.full(len(own), TOP), own, np.full(len(own), trees))


_ASKED = "block long, tree long, level int, i long"


def _asks(trees: int):  # noqa: ANN202
    def asks(table: pa.Table) -> pa.Table:
        tree, i, n = (table[c].to_numpy() for c in ("tree", "i", "n"))
        key = np.unique(np.stack([tree, i]), axis=1, return_index=True)[1]
        wanted = [(t, level, j) for level, _, _, _, missing in _levels(tree[key], i[key], n[key], trees) for t, j in missing]
        block = table["block"][0].as_py() if len(table) else 0
        return pa.table({
            "block": pa.array([block] * len(wanted), pa.int64()), "tree": pa.array([x[0] for x in wanted], pa.int64()),
            "level": pa.array([x[1] for x in wanted], pa.int32()), "i": pa.array([x[2] for x in wanted], pa.int64()),
        })

    return asks


def _expands(trees: int, digest: str, columns: Sequence[str]):  # noqa: ANN202
    def expands(leaves: pa.Table, fetched: pa.Table) -> pa.Table:
        tree, i, n = (leaves[c].to_numpy() for c in ("tree", "i", "n"))
        at = {(t, level, j): d for t, level, j, d in zip(*[fetched[c].to_pylist() for c in ("tree", "level", "i", "digest")], strict=True)}
        at.update({(t, 0, j): d for t, j, d in zip(tree.tolist(), i.tolist(), leaves[digest].to_pylist(), strict=True)})
        key = np.unique(np.stack([tree, i]), axis=1, return_index=True)[1]
        steps: dict[tuple[int, int, int], tuple[str, str]] = {}
        for t in np.unique(tree[n == 1]).tolist():
            at[TOP, 0, t] = at[t, 0, 0]
        for level, run_tree, run, run_n, _ in _levels(tree[key], i[key], n[key], trees):
            for t, r, size in zip(run_tree.tolist(), run.tolist(), run_n.tolist(), strict=True):
                first = r * WIDTH
                members = [at[t, level, j] for j in range(first, min(first + WIDTH, size))]
                for j in range(len(members)):
                    steps[t, level, first + j] = "".join(members[:j]), "".join(members[j + 1 :])
                at[t, level + 1, r] = up = hashlib.sha256("".join(members).encode()).hexdigest()
                if size <= WIDTH and t != TOP:
                    at[TOP, 0, t] = up
        lefts, rights, offsets = [], [], [0]
        for t, j in zip(tree.tolist(), i.tolist(), strict=True):
            for own, place in ((t, j), (TOP, t)):
                level = 0
                while (step := steps.get((own, level, place))) is not None:
                    lefts.append(step[0])
                    rights.append(step[1])
                    level, place = level + 1, place // WIDTH
            offsets.append(len(lefts))
        proof = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(lefts, pa.string()), pa.array(rights, pa.string())], ["left", "right"]))
        subroot = pa.array([at[TOP, 0, t] for t in tree.tolist()], pa.string())
        return pa.table([*[leaves[c] for c in columns], subroot, proof], [*columns, "subroot", "proof"])

    return expands


def proofs(manifest: Manifest, leaves: DataFrame | None = None, digest: str = "leaf") -> DataFrame:
    """The leaves (or some of them) with their tree's ``subroot`` and their ``proof``.

    A proof is a list of (left, right): the texts of a node's siblings before
    and after it in its run, from the leaf to the root.  A run of one node has
    two empty texts.  Any choice of the manifest's leaves gets its proofs;
    partitions only ask for what their own leaves don't yield.
    """
    chosen = (manifest.leaves if leaves is None else leaves).withColumn("block", F.floor(F.col("place") / LEAVES))
    columns = [c for c in chosen.columns if c not in ("block", "tree", "i", "n", "place")]
    asked = chosen.select("block", "tree", "i", "n").groupBy("block").applyInArrow(_asks(manifest.trees), _ASKED)
    fetched = asked.join(manifest.nodes, ["tree", "level", "i"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.select(*columns).schema)
    out = f"{schema}, subroot string, proof array<struct<left:string,right:string>>"
    return chosen.groupBy("block").cogroup(fetched.groupBy("block")).applyInArrow(_expands(manifest.trees, digest, columns), out)


def tamper_check(docs: DataFrame) -> DataFrame:
    """A manifest of documents by source and id, and what each row's proof says after a trial tampering.

    Where 2 divides the CRC-32 of the decimal id, line feeds are taken out of
    the text; the proof, made of untampered nodes, then leads to another root
    exactly where that changed the text.  Null texts and ids are leaves like
    others and are not tampered with; rows equal in source and id sort by
    digest.  Of the rows only ids, sources and digests are sorted and
    shuffled.
    """
    names = ("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    plain = [F.col(c) for c in names]
    changed = F.when(F.contains("text", F.lit("\n")), leaf([*plain[:-1], tampered]))
    rows = docs.select("doc_id", "source", leaf(plain).alias("leaf"), changed.alias("tampered"))
    manifest = build(rows, "source", ("doc_id",))
    found = proofs(manifest)
    folded = fold(F.coalesce("tampered", "leaf"), F.col("proof"))
    out = found.select("doc_id", "leaf", "subroot", F.lit(manifest.root).alias("root"), F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))

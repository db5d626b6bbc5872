"""Merkle manifest of a table: a tree for each value of one column, and a tree over their roots.

A leaf is the digest H of a row's fields. H is the lower-case hexadecimal sha256 of its inputs written one
after the other; a field is its UTF-8 byte count, a colon and its value, or `-` if it is null, and a digest goes
in as hexadecimal text. In each tree the leaves ascend by the order column; runs of `arity` consecutive nodes
become the H of their digests, the last run with fewer nodes (even one), until one node remains: the subroot.
The subroots, ordered by the tree column (null first, by UTF-8 bytes), give the root in the same way.

Every level is one table. A node finds the others of its run by an equijoin of the level with itself
on a computed index: the number with its lowest bit flipped for two, else one join for each shift of the slot. The
nodes in slot 0 then emit the parents. Proofs are handed down by joins from the root, each node adding its siblings
to the path of its parent, and written after every few levels; the path of the subroot follows once, at the leaves. Indices come from a range sort whose parts are counted, so no task sees a whole tree.

Defined cases: null fields are `-`. Rows that are equal in the tree and order column are ordered by their leaf, so
equal rows are separate leaves with equal digests. A lone leaf is its subroot, a lone subroot the root. No rows
give no tree and no root. Columns beside the fields play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise

ARITY, CHAIN = 2, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEX_DIGITS = 64
_STEP = "struct<slot: int, siblings: binary>"


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    """The digest of a row's fields, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[_field(v) for v in values]), 256))


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def _numbered(nodes: DataFrame) -> tuple[DataFrame, int]:
    """(tree, idx, n, digest, ..) of nodes (tree, place, digest, ..): the number from 0 inside the tree by place
    and digest, and the nodes of the tree; with the largest n.

    The rows are sorted over all tasks; equal rows are told apart by a number, so that many of them
    are no single part. What is counted for each part and tree is small.
    """
    order = ("tree", "place", "digest", "row")
    ranged = (nodes.withColumn("row", F.monotonically_increasing_id())
              .repartitionByRange(*order).sortWithinPartitions(*order))
    placed = materialise(ranged.withColumn("part", F.spark_partition_id())
                         .withColumn("seq", F.monotonically_increasing_id()), "merkle-order")
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (placed.groupBy("tree", "part").agg(F.count("*").alias("rows"), F.min("seq").alias("first"))
             .withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
             .withColumn("n", F.sum("rows").over(Window.partitionBy("tree")))
             .select("tree", "part", "first", "before", "n"))
    parts = materialise(parts, "merkle-parts")  # read several times below
    return (placed.join(parts, ["tree", "part"])
            .withColumn("idx", F.col("seq") - F.col("first") + F.col("before"))
            .drop("row", "part", "seq", "first", "before", "place")), parts.agg(F.max("n")).first()[0] or 0


def _with_siblings(nodes: DataFrame, arity: int, carry: Sequence[str]) -> DataFrame:
    """Nodes (tree, idx, n, digest, ..) with their slot and the digests of the rest of their run, left to right."""
    slot = F.pmod(F.col("idx"), F.lit(arity))
    if arity == 2:
        at = [F.col("idx").bitwiseXOR(F.lit(1))]
    else:
        at = [F.col("idx") - slot + F.pmod(slot + j, F.lit(arity)) for j in range(1, arity)]
    out = nodes.withColumn("slot", slot.cast("int"))
    for j, index in enumerate(at):
        other = nodes.select(F.col("tree").alias("tree_"), F.col("idx").alias(f"at{j}"), F.col("digest").alias(f"sib{j}"))
        out = out.withColumn("look", index).join(
            other, (F.col("tree") == F.col("tree_")) & (F.col("look") == F.col(f"at{j}")), "left").drop("tree_", "look")
    none = F.lit(b"")
    if arity == 2:
        siblings = F.coalesce("sib0", none)
    else:
        found = F.array_sort(F.array(*[F.struct(F.col(f"at{j}").alias("at"), F.col(f"sib{j}").alias("sib")) for j in range(len(at))]))
        siblings = F.aggregate(found, none, lambda all_, s: F.concat(all_, F.coalesce(s["sib"], none)))
    return out.select("tree", "idx", "n", "digest", "slot", siblings.alias("siblings"), *carry)


def _climb(nodes: DataFrame, most: int, arity: int, carry: Sequence[str] = ()) -> list[DataFrame]:
    """All levels of the trees, the largest of `most` leaves, from the leaves up; the root of a tree is the node with n = 1."""
    levels, cols = [], list(carry)
    while most:
        level = materialise(_with_siblings(nodes, arity, cols), "merkle-level")
        levels.append(level)
        if most == 1:
            break
        joined = F.concat(F.col("digest"), F.col("siblings"))
        nodes = level.filter("slot = 0 AND n > 1").select(
            "tree", F.floor(F.col("idx") / arity).alias("idx"), F.ceil(F.col("n") / arity).alias("n"),
            F.unhex(F.sha2(_hex(joined), 256)).alias("digest"))
        most, cols = -(-most // arity), []
    return levels


def _handed_down(levels: Sequence[DataFrame], arity: int, carry: Sequence[str]) -> DataFrame:
    """(tree, digest, path, carry ..) of the lowest level: the path from each node to the root of its tree.

    A root has no parent in the level above and so an empty path; nothing else ends a path.
    """
    none = F.array().cast(f"array<{_STEP}>")
    own = F.when(F.col("n") > 1, F.array(F.struct("slot", "siblings").cast(_STEP))).otherwise(none)
    paths = None
    for i, level in reversed(list(enumerate(levels))):
        cols = ["tree", "idx", *([] if i else ["digest", *carry])]
        if paths is None:
            paths = level.select(*cols, own.alias("path"))
        else:
            above = paths.select(F.col("tree").alias("tree_"), F.col("idx").alias("parent"), F.col("path").alias("rest"))
            paths = level.join(above, (F.col("tree") == F.col("tree_")) & (
                F.floor(F.col("idx") / arity) == F.col("parent")), "left").select(
                    *cols, F.concat(own, F.coalesce("rest", none)).alias("path"))
        if i and (len(levels) - i) % CHAIN == 0:  # keeps the plan, and what the driver holds of it, small
            paths = materialise(paths, "merkle-paths")
    return paths.drop("idx")


@dataclass(frozen=True)
class Manifest:
    """The written levels of all trees and of the tree over their roots."""

    levels: list[DataFrame]
    top: list[DataFrame]
    arity: int
    carry: tuple[str, ...]

    def root(self) -> str | None:
        """The digest of the whole table; none if it is empty."""
        return self.top[-1].select(_hex(F.col("digest"))).first()[0] if self.top else None

    def proofs(self) -> DataFrame:
        """One row for each leaf: the carried columns, leaf, subroot, root and the path.

        The path has a step for each level: the slot of the node and the digests of the others of its run.
        """
        if not self.levels:
            raise ValueError("an empty table has no proofs")
        root = self.top[-1].select("tree", F.col("digest").alias("root"))
        ends = materialise(_handed_down(self.top, self.arity, ["name"]).join(root, "tree").select(
            F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", F.col("path").alias("rest")),
            "merkle-paths")
        found = _handed_down(self.levels, self.arity, self.carry).join(ends, "tree")
        return found.select(*self.carry, *[_hex(F.col(c)).alias(c) for c in ("subroot", "root")],
                            _hex(F.col("digest")).alias("leaf"), F.concat("path", "rest").alias("path"))


def build(rows: DataFrame, fields: Sequence[str] = FIELDS, tree: str = "lang", order: str = "doc_id",
          arity: int = ARITY, also: Mapping[str, Column] | None = None) -> Manifest:
    """Write all levels; `also` names columns that go with a leaf to its proof."""
    if arity < 2:
        raise ValueError("a run has at least two nodes")
    also = dict(also or {})
    leaves = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit("")).alias("tree"), F.col(order).alias("place"),
        leaf([F.col(f) for f in fields]).alias("digest"),
        F.struct(F.lit(0).alias("_"), *[c.alias(n) for n, c in also.items()]).alias("with"))
    leaves = materialise(leaves, "merkle-leaves")
    levels = _climb(*_numbered(leaves), arity, ["with"])
    if not levels:
        return Manifest([], [], arity, tuple(also))
    subroots = [level.filter("n = 1").select(F.lit("").alias("tree"), F.col("tree").alias("place"), "digest",
                                             F.col("tree").alias("name")) for level in levels]
    every = subroots[0]
    for more in subroots[1:]:
        every = every.union(more)
    top = _climb(*_numbered(every), arity, ["name"])
    levels[0] = levels[0].select("tree", "idx", "n", "digest", "slot", "siblings", *[F.col(f"with.{n}").alias(n) for n in also])
    return Manifest(levels, top, arity, tuple(also))


def proof_digest(path: Column) -> Column:
    """H of all siblings of a path, in its order."""
    none = F.lit(b"")
    return F.sha2(_hex(F.aggregate(path, none, lambda all_, s: F.concat(all_, s["siblings"]))), 256)


def fold(start: Column, path: Column) -> Column:
    """The root that follows from a leaf (hexadecimal) and a path."""
    def up(digest, step):
        others, left = _hex(step["siblings"]), step["slot"] * HEX_DIGITS
        return F.sha2(F.concat(F.substring(others, F.lit(1), left), digest,
                               F.substring(others, left + 1, F.length(others))), 256)
    return F.aggregate(path, start, up)


def audit(docs: DataFrame, fields: Sequence[str] = FIELDS, tree: str = "lang", doc_id: str = "doc_id",
          count: str = "n_chars", every: int = 7, arity: int = ARITY) -> DataFrame:
    """Prove every row, after tampering with those whose crc32(id as text) `every` divides.

    Returns id, leaf, subroot, root, proof_sha256, folded_root and verified. Tampering adds 1 to `count`; a null
    stays null, and a row without an id is never chosen.
    """
    chosen = F.crc32(F.col(doc_id).cast("string").cast("binary")) % every == 0
    changed = [F.col(f) + 1 if f == count else F.col(f) for f in fields]
    manifest = build(docs, fields, tree, doc_id, arity, {
        "_id": F.col(doc_id), "_tampered": F.when(chosen, leaf(changed))})
    if not manifest.levels:
        spark = docs.sparkSession
        kind = docs.schema[doc_id].dataType.simpleString()
        return spark.createDataFrame([], f"`{doc_id}` {kind}, leaf string, subroot string, root string, "
                                         "proof_sha256 string, folded_root string, verified boolean")
    found = manifest.proofs()
    out = found.select(
        F.col("_id").alias(doc_id), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        fold(F.coalesce(_hex(F.col("_tampered")), "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))

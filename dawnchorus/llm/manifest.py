"""Merkle manifest of a dataset: hash trees per source below one root, with an inclusion proof of every row.

Slot pivot: a level's nodes are grouped by parent, and conditional aggregates
spread the children of a parent into ``FANOUT`` columns. The columns joined
are what the parent hashes; the columns before and after a child's own are its
siblings. DataFrame functions only; digests are kept as bytes and hashed as
lower-case hex text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dawnchorus.llm.common import stored

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SLOTS = [f"slot{j}" for j in range(FANOUT)]
_PARENT = f"idx div {FANOUT}"
_PATH = "array<struct<before: binary, after: binary>>"


def _hashed(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each as its UTF-8 length, a colon and its text, or a dash for null."""
    return _hashed(F.concat(*[_field(f) for f in fields]))


def ranked(rows: DataFrame, order: list[str], copies: str) -> DataFrame:
    """Adds ``idx`` (rows of the same ``tree`` before this one) and ``n`` (rows of the tree).

    A row stands for ``copies`` equal rows. Rows are dealt out by ranges of
    (tree, order); a rank is the sum of the ranges before and of the rows before
    within the range, so one tree may hold most rows without ever meeting in
    one task: a window sees one range of one tree, or one sum per range.
    """
    laid = rows.repartitionByRange("tree", *order).withColumn("part", F.spark_partition_id())
    laid = stored(laid, "manifest-rows")
    sums = laid.groupBy("tree", "part").agg(F.sum(copies).alias("here"))
    tree = Window.partitionBy("tree")
    earlier = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        "tree", "part", F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("before"), F.sum("here").over(tree).alias("n")
    )
    within = Window.partitionBy("tree", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        laid.withColumn("inside", F.coalesce(F.sum(copies).over(within), F.lit(0)))
        .join(sums, ["tree", "part"])
        .withColumn("idx", F.col("before") + F.col("inside"))
        .drop("part", "before", "inside")
    )


def pivoted(nodes: DataFrame) -> DataFrame:
    """One row per parent of (tree, n, idx, digest): the children in slot columns, and the parent's own digest.

    ``n`` becomes the number of parents of the tree. Trees with a single node have no parent.
    """
    parents = F.expr(f"ceil(n / {FANOUT})").cast("long").alias("n")
    slots = [F.expr(f"max(if(idx % {FANOUT} = {j}, digest, null))").alias(s) for j, s in enumerate(_SLOTS)]
    wide = nodes.where("n > 1").groupBy("tree", parents, F.expr(_PARENT).alias("idx")).agg(*slots)
    return wide.withColumn("digest", _hashed(_hex(_joined())))


def _joined(chosen: str = "true") -> Column:
    """The slot columns chosen by a condition on {j}, one after the other."""
    parts = [f"coalesce(if({chosen.format(j=j)}, {s}, null), X'')" for j, s in enumerate(_SLOTS)]
    return F.expr(f"concat({', '.join(parts)})")


def _siblings() -> Column:
    """The children before and after the one that ``idx`` names."""
    before, after = _joined(f"idx % {FANOUT} > {{j}}"), _joined(f"idx % {FANOUT} < {{j}}")
    return F.struct(before.alias("before"), after.alias("after"))


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """The pivoted levels above ``nodes`` up to the single top of each tree, written to the shared folder."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels = []
    while most > 1:
        nodes = stored(pivoted(nodes), "manifest-level")
        levels.append(nodes)
        most = -(-most // FANOUT)
    return levels


def _with_paths(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``nodes`` with the columns of ``tops`` (per tree: path, ...), the path led down the levels.

    A path lists the siblings from a node's own level up. Every join is by
    parent, so it meets at most FANOUT children, or by tree for the trees' tops.
    """
    above = None
    for level in [*reversed(levels), nodes]:
        single = level.where("n = 1").join(tops, "tree")
        if above is not None:
            child = level.where("n > 1").withColumn("parent", F.expr(_PARENT))
            given = above.withColumnRenamed("idx", "parent").drop("n", "digest")
            child = child.drop(*_SLOTS) if level is nodes else child.withColumnsRenamed({s: f"own_{s}" for s in _SLOTS})
            led = child.join(given, ["tree", "parent"]).withColumn(
                "path", F.concat(F.array(_siblings()), F.col("path"))
            )
            led = led.drop("parent", *_SLOTS).withColumnsRenamed({f"own_{s}": s for s in _SLOTS})
            single = single.unionByName(led)
        above = single
    return above


def manifest(docs: DataFrame, *, fields: tuple[str, ...] = FIELDS, altered: dict[str, Column] | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, source, leaf, subroot, root, path, altered_leaf (digests as bytes).

    ``fields`` are hashed into the leaf, the first orders the leaves of a
    source (ties by leaf, null first), the second names the source. ``altered``
    replaces fields by other columns for ``altered_leaf``; without it that is the
    leaf. ``path`` has per level from the leaf to the root the digests before and
    after the node. A lone leaf is its source's subroot, a lone subroot the
    root; an empty table gives no rows. Nulls in any field, also the source,
    are values of their own; equal rows are equal leaves, each with its place.
    """
    key, source = f"`{fields[0]}`", f"`{fields[1]}`"
    plain = [F.col(f"`{f}`") for f in fields]
    changed = [(altered or {}).get(f, F.col(f"`{f}`")) for f in fields]
    leaf, other = leaf_digest(plain), leaf_digest(changed) if altered else leaf_digest(plain)
    rows = docs.select(
        F.col(key).alias("doc_id"), F.col(source).alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("tree"),  # keeps the order, null first
        leaf.alias("digest"), other.alias("altered_leaf"),
    ).groupBy("doc_id", "source", "tree", "digest", "altered_leaf").agg(F.count(F.lit(1)).alias("copies"))
    placed = ranked(rows, ["doc_id", "digest"], "copies")
    place = F.explode(F.sequence(F.col("idx"), F.col("idx") + F.col("copies") - 1))
    leaves = stored(placed.withColumn("idx", place).drop("copies"), "manifest-leaves")
    levels = _levels(leaves)
    subroots = leaves.where("n = 1").select("tree", "digest")
    for level in levels:
        subroots = subroots.unionByName(level.where("n = 1").select("tree", "digest"))
    crowns = ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest", F.lit(1).alias("copies")), ["name"], "copies")
    crowns = stored(crowns.drop("copies"), "manifest-subroots")
    upper = _levels(crowns)
    root = (upper[-1] if upper else crowns).select("tree", F.col("digest").alias("root"))
    empty = F.array().cast(_PATH).alias("path")
    tops = _with_paths(crowns.withColumnRenamed("digest", "subroot"), upper, root.select("tree", "root", empty))
    tops = tops.select(F.col("name").alias("tree"), "subroot", "root", "path")
    found = _with_paths(leaves, levels, tops)
    return found.select("doc_id", "source", F.col("digest").alias("leaf"), "subroot", "root", "path", "altered_leaf")


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right; as hex text."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda x: _hex(F.concat(x["before"], x["after"])))), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path; as bytes."""
    return F.aggregate(path, leaf, lambda held, x: _hashed(_hex(F.concat(x["before"], held, x["after"]))))


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else unchanged."""
    return F.translate(text, _UPPER, _LOWER)


def verified(docs: DataFrame, *, every: int = 5) -> DataFrame:
    """The manifest's proofs, checked after tampering: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Where ``every`` divides the CRC-32 of the decimal doc_id, the text's A-Z
    are lower-cased before the leaf is hashed anew; the root is then folded
    from that leaf and the untampered siblings. A null doc_id or text stays.
    """
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    text = F.when(hit, lowered(F.col("text"))).otherwise(F.col("text"))
    found = manifest(docs, altered={"text": text})
    return found.select(
        "doc_id", *[_hex(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")],
        proof_digest(F.col("path")).alias("proof_sha256"), _hex(folded(F.col("altered_leaf"), F.col("path"))).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))

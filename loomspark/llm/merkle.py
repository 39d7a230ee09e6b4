"""A Merkle manifest of a dataset: leaves of rows, a tree for each group, a tree over the groups' roots, proofs.

Leaves are numbered in the order of their group by a range partitioning, so that no group, however large, is one task.
Levels are windows: a partition is a run of consecutive nodes (group and parent index), its full-frame ordered list of
digests is both the parent's preimage and each member's siblings. The windows of some levels share one shuffle, which
deals blocks of neighbouring nodes; a node enters the lists of later levels once, and blocks' parents are one row each
in the next tier. Proofs come down the tiers by joins on the block, at most `arity ** LEVELS` rows a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common as C

#: Levels of a tree that share one shuffle.
LEVELS = 6
#: Rows up to which the table of places of groups within partitions is broadcast.
FEW = 100_000
STEP = "struct<before:binary,after:binary>"


def _nothing() -> Column:
    return F.lit(b"")


def _glued(xs: Column) -> Column:
    """The bytes of an array, one after the other."""
    return F.aggregate(xs, _nothing(), lambda t, x: F.concat(t, x))


def digest(*parts: Column) -> Column:
    """SHA-256 of the concatenation, as 32 bytes; digests among parts are bytes too and enter as lower-case hex text."""
    return F.unhex(F.sha2(F.lower(F.hex(F.concat(*parts))).cast("binary"), 256))


def text_of(x: Column) -> Column:
    return F.lower(F.hex(x))


def leaf_digest(*columns: Column) -> Column:
    """Of a row: each value as `-` if null, else its UTF-8 byte count, `:`, and the value (numbers in decimal)."""
    shown = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in shown]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings, level by level, lead to."""
    return F.aggregate(path, leaf, lambda h, s: digest(F.coalesce(s["before"], _nothing()), h, F.coalesce(s["after"], _nothing())))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path as hex text, level by level, left to right."""
    return F.sha2(F.aggregate(path, F.lit(""), lambda t, s: F.concat(t, text_of(F.coalesce(s["before"], _nothing())), text_of(F.coalesce(s["after"], _nothing())))).cast("binary"), 256)


def _numbered(rows: DataFrame, label: str) -> tuple[DataFrame, int]:
    """rows (with g, rank, hash) and their place `pos` in their group by (rank, hash), the group's size `n`; the largest n.

    Ranges of (g, rank, hash) are sorted task by task; a small table of counts by (range, g) tells where each begins.
    """
    order = ["g", F.col("rank").asc_nulls_first(), "hash"]
    ranged = rows.repartitionByRange(C.parts(rows.sparkSession), *order).sortWithinPartitions(*order)
    ranged = C.materialise(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), label)
    counts = ranged.groupBy("g", "part").agg(F.count("*").alias("c"), F.min("at").alias("low"))
    group = W.partitionBy("g")  # a row for each range that holds rows of g
    before = F.coalesce(F.sum("c").over(group.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = C.materialise(counts.select("g", "part", (before - F.col("low")).alias("shift"), F.sum("c").over(group).alias("n")), label + "-counts")
    many, most = counts.agg(F.count("*"), F.max("n")).first()
    side = F.broadcast(counts) if many <= FEW else counts
    return ranged.join(side, ["g", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift"), most or 0


def _tier(nodes: DataFrame, most: int, arity: int, label: str) -> DataFrame:
    """nodes: g, pos, n, hash; no n is over `most`. Adds `path`, the siblings on up to LEVELS levels, and sets hash to the node reached."""
    block = F.floor(F.col("pos") / F.lit(arity**LEVELS)).cast("long")
    rows = nodes.withColumn("block", block).repartition(C.parts(nodes.sparkSession), "g", "block")
    rows = rows.withColumn("path", F.array().cast(f"array<{STEP}>"))
    for span in (arity**k for k in range(LEVELS) if arity**k < most):
        run = W.partitionBy("g", "block", F.floor(F.col("pos") / F.lit(span * arity)).cast("long")).orderBy("pos").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        # Rows under one node agree on it; its first row alone enters the list: nulls are left out.
        members = F.collect_list(F.when(F.col("pos") % span == 0, F.col("hash"))).over(run)
        own = (F.floor(F.col("pos") / F.lit(span)) % arity).cast("int")
        rows = rows.withColumn("members", members).withColumn("own", own)
        before, after = _glued(F.slice("members", F.lit(1), F.col("own"))), _glued(F.slice("members", F.col("own") + 2, F.lit(arity)))
        step = F.struct(F.when(F.col("own") > 0, before).alias("before"), F.when(F.size("members") > F.col("own") + 1, after).alias("after"))
        more = F.col("n") > span  # else the group's root is reached
        rows = rows.withColumn("path", F.when(more, F.concat("path", F.array(step).cast(f"array<{STEP}>"))).otherwise(F.col("path")))
        rows = rows.withColumn("hash", F.when(more, digest(_glued(F.col("members")))).otherwise(F.col("hash"))).drop("members", "own")
    return C.materialise(rows, label)


def _trees(leaves: DataFrame, most: int, arity: int, label: str) -> tuple[list[DataFrame], DataFrame]:
    """The tiers of all groups' trees, from the leaves up, and (g, hash) of the roots; most: leaves of the largest group."""
    tiers, nodes, size, up = [], leaves, most, arity**LEVELS
    while True:
        tiers.append(_tier(nodes, size, arity, f"{label}-{len(tiers)}"))
        nodes = tiers[-1].where(F.col("pos") % up == 0).select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / F.lit(up)).cast("long").alias("n"), "hash")
        size = -(-size // up)
        if size <= 1:
            return tiers, nodes.select("g", "hash")


def _lowered(tiers: list[DataFrame], tops: DataFrame, extra: list[str]) -> DataFrame:
    """The leaves' rows with their whole path; tops: g, path (above the group's root) and the extra columns."""
    above = tops.withColumn("block", F.lit(0).cast("long"))
    for k, tier in reversed(list(enumerate(tiers))):
        high = above.select("g", "block", F.col("path").alias("high"), *extra)
        joined = tier.join(high, ["g", "block"]).withColumn("path", F.concat("path", "high")).drop("high", "hash", "block")
        above = joined if not k else joined.select("g", F.col("pos").alias("block"), "path", *extra)
    return above


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang", order: str = "doc_id", also: dict[str, Column] | None = None, arity: int = 2) -> DataFrame:
    """The named order column, leaf, subroot, root (32 bytes each), pos, path, and `also`: one row for each row of docs.

    leaf is the digest of the columns. Within each value of `group` leaves ascend by `order`; a null order comes first,
    and ties are ordered by their leaves. While a tree has several nodes, every `arity` consecutive ones, the last run
    with fewer and even one, become their digest; a lone leaf is its group's root itself. The groups' roots, ordered by
    the group as text (null first, then by UTF-8 bytes), make the tree of the root likewise. path holds for each level
    what stands before and after the node among its run (null where nothing does). Rows that repeat another are leaves of
    their own. An empty table gives no rows; long and empty texts are values like others. Other columns of docs, under
    any names, are not read. `also` are further columns reckoned from docs, handed through.
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    # Null and the empty text are groups of their own.
    rows = docs.select(F.coalesce(F.concat(F.lit("="), docs[group].cast("string")), F.lit("")).alias("g"), docs[order].alias("rank"), leaf_digest(*[docs[c] for c in columns]).alias("hash"), *[c.alias(f"also_{k}") for k, c in (also or {}).items()])
    rows = C.materialise(rows, "leaves").withColumn("leaf", F.col("hash"))
    leaves, most = _numbered(rows, "numbered")
    tiers, roots = _trees(leaves, most, arity, "tier")
    roots = C.materialise(roots, "subroots")
    upper, groups = _numbered(roots.select(F.lit("").alias("g"), F.col("g").alias("rank"), "hash", F.col("hash").alias("subroot")), "groups")
    high, root = _trees(upper, groups, arity, "group-tier")
    tops = _lowered(high, root.select("g", F.col("hash").alias("root"), F.array().cast(f"array<{STEP}>").alias("path")), ["root"])
    tops = tops.select(F.col("rank").alias("g"), "path", "subroot", "root")
    out = _lowered(tiers, tops, ["subroot", "root"])
    return out.select(F.col("rank").alias(order), "leaf", "subroot", "root", "pos", "path", *[F.col(f"also_{k}").alias(k) for k in also or {}])


def checked_manifest(docs: DataFrame, claimed: Column | None = None, **kw) -> DataFrame:
    """What manifest gives, with hex texts: order column, leaf, subroot, root, proof_sha256, folded_root, verified.

    claimed is the leaf digest of each row as it is found now (by default the row's own); folded_root is the root that it
    and the manifest's siblings lead to, verified whether that is the root. Nulls, ties, repeats: see manifest.
    """
    order = kw.get("order", "doc_id")
    own = manifest(docs, also={} if claimed is None else {"claimed": claimed}, **kw)
    at = folded(F.col("leaf") if claimed is None else F.col("claimed"), F.col("path"))
    out = own.select(order, "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), at.alias("folded"))
    return out.select(order, *[text_of(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")], "proof_sha256", text_of(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def tampered_leaf(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), changed: str = "n_chars", folds: int = 7) -> Column:
    """The leaf digest of each row after tampering: where `folds` divides the crc32 of the id, the changed column is larger
    by one; null ids and null values stay."""
    one_more = (docs[changed].cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    hit = F.coalesce(C.crc_fold(docs[columns[0]], folds) == 0, F.lit(False)) & docs[changed].isNotNull()
    return F.when(hit, leaf_digest(*[one_more if c == changed else docs[c] for c in columns])).otherwise(leaf_digest(*[docs[c] for c in columns]))

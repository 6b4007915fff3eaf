"""Merkle manifest of a table: a tree of digests per group, one tree over the groups, and proofs by descent from the root.

A leaf is the SHA-256 of a row's fields. Inside a group the leaves are numbered by a range sort; while a group has several
nodes, every ``fanout`` consecutive ones become the digest of their joined hexadecimal digests. The groups' last nodes are
the leaves of one more tree. What is stored is content-addressed: a record maps a digest to its children's digests.

Proofs come from a descent of that graph. Requests for leaves travel together as long as they need the same nodes: from the
root down, each level looks up the records of the nodes in use and follows the requested digits of the ranks (base
``fanout``), and a segment with the children not chosen, left and right of the chosen one, is put behind the path. The last
run of siblings meets its leaves only at the end, so a path is moved once per run, not once per leaf. Folding and hashing
of a proof read the segments in reverse, from the leaf to the root.

A group that holds most rows is spread over ranges, and a node over a million leaves is one row. Reaching the driver: the
greatest depth of a tree, and the root.

Edges: NULL fields are marked ``-``, so they differ from empty ones; rows without an order value come first, the group NULL
first, all others by their bytes; rows with equal order values stand by their digests, and repeated rows are leaves of their own
with equal digests; a group of one row is its leaf, and a table of one group has that group's digest as root; texts
of any length are hashed where they are read, only digests travel; an empty table gives no root and no proofs; columns
beyond those named are left alone, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lilt.session import cut

FANOUT = 8
_TOP = "top"


def leaf_digest(*fields: Column) -> Column:
    """Hexadecimal digest of the fields: ``-`` for NULL, else byte count, colon, value."""

    def framed(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(framed, fields)), 256)


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def _joined(children: Column) -> Column:
    """The bytes of consecutive digests as one value."""
    return F.aggregate(children, F.unhex(F.lit("")), lambda a, x: F.concat(a, x))


def _depth(nodes: Column, fanout: int) -> Column:
    """Levels above the leaves of a tree: digits of the last rank, none for a single leaf."""
    return F.when(nodes == 1, 0).otherwise(F.length(F.conv((nodes - 1).cast("string"), 10, fanout))).cast("int")


def _numbered(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """``nodes`` with their ``rank`` in ``tree`` by ``order`` and the number of ``nodes`` of the tree."""
    rows = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    placed = cut(rows.withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id()), name)
    held = placed.groupBy("tree", "_part").agg(F.count("*").alias("_n"), F.min("_seq").alias("_first"))
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select(
        "tree", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("tree")).alias("nodes")
    )
    ranked = placed.join(starts.hint("rebalance"), ["tree", "_part"])
    return ranked.withColumn("rank", F.col("_before") + F.col("_seq") - F.col("_first")).drop("_part", "_seq", "_first", "_before")


def _grown(leaves: DataFrame, fanout: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Records of all trees, a table per level, and the root of each tree: (tree, depth, digest)."""
    level = leaves.select("tree", "rank", _depth(F.col("nodes"), fanout).alias("depth"), "digest")
    deepest = level.agg(F.max("depth")).first()[0] or 0
    records, roots = [], level.where("depth = 0").select("tree", "depth", "digest")
    for k in range(1, deepest + 1):
        runs = level.where(F.col("depth") >= k).groupBy("tree", F.floor(F.col("rank") / fanout).cast("long").alias("rank"), "depth")
        children = F.transform(F.array_sort(F.collect_list(F.struct("rank", "digest"))), lambda x: x["digest"]).alias("children")
        level = cut(runs.agg(children).withColumn("digest", F.unhex(F.sha2(_hex(_joined(F.col("children"))), 256))), f"{name}-{k}")
        records.append(level.select("digest", "children"))
        roots = roots.union(level.where(F.col("depth") == k).select("tree", "depth", "digest"))
    return records, roots


@dataclass
class Manifest:
    """``leaves(tree, rank, digest, depth, *carried)``, ``groups`` with the trees' roots and their rank in the top tree, and the
    records (digest, children) by height above the leaves, of the groups' trees and of the top tree."""

    leaves: DataFrame
    groups: DataFrame
    records: list[DataFrame]
    top_records: list[DataFrame]
    root: bytes | None
    fanout: int


def manifest(rows: DataFrame, group: str, order: list[str], digest: Column, carried: list[Column], fanout: int = FANOUT) -> Manifest:
    """The tree of ``rows``: one tree per value of ``group``, leaves by ``order``; ``carried`` columns stay beside a leaf."""
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    keys = [F.col(c).alias(f"_o{k}") for k, c in enumerate(order)]
    hashed = cut(rows.select(tree.alias("tree"), *keys, F.unhex(digest).alias("digest"), *carried), "merkle-hashed")
    names = [f"_o{k}" for k in range(len(order))]
    leaves = cut(_numbered(hashed, [*names, "digest"], "merkle-placed").drop(*names), "merkle-leaves")
    records, subroots = _grown(leaves, fanout, "merkle")
    # The top tree keeps the group beside its node, so that its ranks lead back to it.
    tops = _numbered(subroots.select(F.lit(_TOP).alias("tree"), F.col("tree").alias("of"), "digest"), ["of"], "merkle-groups")
    groups = cut(tops, "merkle-subroots")
    upper, root = _grown(groups, fanout, "merkle-top")
    top = root.first()
    leaves = leaves.withColumn("depth", _depth(F.col("nodes"), fanout)).drop("nodes")
    return Manifest(leaves, groups, records, upper, bytes(top["digest"]) if top else None, fanout)


def _digit(rank: Column, level: int, fanout: int) -> Column:
    """Prefix of a rank above ``level`` digits."""
    return F.floor(rank / F.lit(fanout**level)).cast("long")


def _segment(children: Column, digit: Column) -> Column:
    """The children left and right of the chosen one."""
    return F.struct(
        _joined(F.slice(children, F.lit(1), digit)).alias("left"), _joined(F.slice(children, digit + 2, F.size(children))).alias("right")
    )


def _opened(nodes: DataFrame, records: DataFrame) -> DataFrame:
    """The nodes with their children. Equal parts of a table have equal records; one of them serves all."""
    return nodes.join(records.dropDuplicates(["digest"]), "digest")


def _below(nodes: DataFrame, records: DataFrame, wanted: DataFrame, fanout: int) -> DataFrame:
    """From nodes (tree, prefix, digest, path, subroot) to the wanted prefixes one level deeper."""
    asked = wanted.withColumn("parent", F.floor(F.col("prefix") / fanout).cast("long"))
    opened = _opened(nodes, records).select("tree", F.col("prefix").alias("parent"), "path", "children", "subroot")
    digit = F.pmod(F.col("prefix"), F.lit(fanout)).cast("int")
    path = F.concat("path", F.array(_segment(F.col("children"), digit))).alias("path")
    return opened.join(asked, ["tree", "parent"]).select("tree", "prefix", F.get("children", digit).alias("digest"), path, "subroot")


def _no_path() -> Column:
    return F.expr("CAST(array() AS array<struct<left: binary, right: binary>>)")


def proofs(found: Manifest, requests: DataFrame) -> DataFrame:
    """``requests`` (rows of ``found.leaves``) with ``root``, ``subroot`` and ``path``: segments from the root to the leaf."""
    fanout, zero = found.fanout, F.lit(0).cast("long")
    used = requests.groupBy(F.col("tree").alias("of")).agg(F.max("depth").alias("depth"))
    tops = found.groups.select("of", "rank", F.col("digest").alias("subroot")).join(used, "of")
    top = [F.lit(_TOP).alias("tree"), zero.alias("prefix"), F.lit(found.root).cast("binary").alias("digest"), _no_path().alias("path")]
    nodes = found.groups.sparkSession.range(0 if found.root is None else 1).select(*top, F.lit(None).cast("binary").alias("subroot"))
    for k in reversed(range(len(found.top_records))):
        wanted = tops.select(F.lit(_TOP).alias("tree"), _digit(F.col("rank"), k, fanout).alias("prefix")).distinct()
        nodes = _below(nodes, found.top_records[k], wanted, fanout)
    reached = nodes.select(F.col("prefix").alias("rank"), "path")
    starts = cut(tops.join(reached, "rank").select(F.col("of").alias("tree"), "depth", "subroot", "path"), "merkle-starts")
    # Runs of leaves in request, and the prefixes above them.
    runs = cut(requests.where("depth > 0").select("tree", "depth", _digit(F.col("rank"), 1, fanout).alias("prefix")).distinct(), "merkle-runs")
    last = starts.where("depth = 0").select("tree", zero.alias("prefix"), "path", F.array("subroot").alias("children"), "subroot")
    nodes = None
    for k in reversed(range(len(found.records))):  # nodes of height k + 1
        begun = starts.where(F.col("depth") == k + 1).select("tree", zero.alias("prefix"), F.col("subroot").alias("digest"), "path", "subroot")
        if nodes is not None:
            wanted = runs.where(F.col("depth") > k + 1).select("tree", _digit(F.col("prefix"), k, fanout).alias("prefix")).distinct()
            begun = _below(nodes, found.records[k + 1], wanted, fanout).union(begun)
        nodes = begun
    if nodes is not None:
        last = _opened(nodes, found.records[0]).select(*last.columns).union(last)
    digit = F.pmod(F.col("rank"), F.lit(fanout)).cast("int")
    own = F.when(F.col("depth") > 0, F.array(_segment(F.col("children"), digit))).otherwise(_no_path())
    met = requests.withColumn("prefix", _digit(F.col("rank"), 1, fanout)).join(last, ["tree", "prefix"])
    return met.withColumn("path", F.concat("path", own)).drop("prefix", "children").withColumn("root", F.lit(found.root).cast("binary"))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings from the leaf's run to the root's."""
    together = F.aggregate(F.reverse(path), F.lit(""), lambda a, s: F.concat(a, _hex(s["left"]), _hex(s["right"])))
    return F.sha2(together, 256)


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf's digest (binary) and its siblings give."""
    up = F.aggregate(F.reverse(path), _hex(leaf), lambda a, s: F.sha2(F.concat(_hex(s["left"]), a, _hex(s["right"])), 256))
    return up


def document_proofs(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): a proof of each document, checked against a copy of
    the table in which the texts of every third document (by CRC-32 of its id) are lower-cased."""
    fields = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars")]
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    copy = F.when(touched, F.unhex(leaf_digest(*fields, F.translate("text", upper, upper.lower()))))
    found = manifest(docs, "lang", ["doc_id"], leaf_digest(*fields, F.col("text")), [F.col("doc_id"), copy.alias("copy")])
    rows = proofs(found, found.leaves)
    again = folded(F.col("path"), F.coalesce("copy", "digest"))
    return rows.select(
        "doc_id",
        _hex(F.col("digest")).alias("leaf"),
        _hex(F.col("subroot")).alias("subroot"),
        _hex(F.col("root")).alias("root"),
        proof_digest(F.col("path")).alias("proof_sha256"),
        again.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))

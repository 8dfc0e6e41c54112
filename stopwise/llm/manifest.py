"""Merkle manifest of a dataset: a tree for each source, one above them, and a proof for each row.

Rows are leaves in the order of their source and id.  Every ``ARITY`` nodes in a
row become one of the level above, until one is left, the source's subroot;
subroots, in the order of their sources, make the root in the same way.

* Places come from one range partitioning and a sort within it, so no task holds
  a source: a row's index is its place in its partition plus the counts before it.
* Levels are made ``STRIDE`` at a time: a group of ``ARITY ** STRIDE`` nodes in a
  row, of bounded size, gives all levels above it up to one node.  The node table
  holds runs, the children of one node, keyed by (tree, level, run).
* Proofs: each leaf explodes to the coordinates that it needs, which follow from
  its index and the size of its tree alone, these join the node table, and the
  siblings found are ordered by level.  Runs near the top would be asked for by
  every leaf below them; the proofs of the nodes at the lowest level that has at
  most ``TOP_NODES`` of them are made once and joined as a whole.
* ``folded`` takes a leaf up along its proof; ``proof_digest`` is the hash of all siblings.

Defined cases: null sources are one tree, before all others; null values have a
mark of their own in the leaf; rows with a null id come first; rows that agree
in source and id follow the order of their leaves, equal ones have equal proofs
up to their place; a lone leaf is its subroot and a lone subroot the root; an
empty table gives an empty manifest without a root; columns that are not asked
for are dropped, so their names cannot clash.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import stash

ARITY = 3
#: Levels made in one pass; a group of a pass has ARITY ** STRIDE hashes, of 32 bytes each.
STRIDE = 6
#: Nodes whose whole proofs are made once and broadcast, at most (about 1 KB each); with more, they are joined by a shuffle.
TOP_NODES = 10_000
_POWERS = [ARITY**k for k in range(40)]
#: The tree of subroots; sources' trees are "" for null and "=" with the source.
TOP = "/"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the concatenated parts."""
    return F.sha2(F.concat(*parts), 256)


def leaf(*fields: Column) -> Column:
    """Hash of the values in order: byte count, colon and value; a hyphen for null."""
    text = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text])


def _text(hash_: Column) -> Column:
    return F.lower(F.hex(hash_))


def _power(level: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, _POWERS)), (level + 1).cast("int")).cast("long")


def _over(a: Column, b: Column) -> Column:
    """Whole quotient of longs."""
    return F.call_function("div", a.cast("long"), b.cast("long"))


def height(n: Column) -> Column:
    """Levels above the leaves of a tree of n."""
    return F.size(F.filter(F.array(*map(F.lit, _POWERS)), lambda p: p < n)).cast("long")


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with idx, the place in their tree from 0, and n, its size; rows has a column tree."""
    keys = [F.col("tree"), *[F.col(c).asc_nulls_first() for c in order]]
    laid = stash(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id()))
    laid = laid.withColumn("part", F.shiftright("place", 33))
    parts = laid.groupBy("tree", "part").agg(F.min("place").alias("first"), F.count("*").alias("size"))
    each = W.partitionBy("tree")
    parts = parts.select("tree", "part", "first", F.sum("size").over(each).alias("n"), (F.sum("size").over(each.orderBy("part")) - F.col("size")).alias("before"))
    return laid.join(parts, ["tree", "part"]).withColumn("idx", F.col("place") - F.col("first") + F.col("before")).drop("place", "part", "first", "before")


RUN = "tree string, n long, level long, run long, hashes array<binary>, above boolean"


def _parents(nodes: Column) -> Column:
    hashed = lambda j: F.unhex(F.sha2(F.array_join(F.transform(F.slice(nodes, ARITY * j + 1, ARITY), _text), ""), 256))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int")), hashed)


def _stride(level: DataFrame, base: int) -> DataFrame:
    """Runs of the STRIDE levels from base on of nodes (tree, idx, n, hash); rows with above are nodes that the next stride goes on from."""
    block = _over(F.col("idx"), F.lit(_POWERS[STRIDE]))
    grown = level.groupBy("tree", "n", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("idx", "hash")))["hash"].alias("l0"))
    for k in range(STRIDE):
        grown = grown.withColumn(f"l{k + 1}", F.when(_nodes_above(k) > 1, _parents(F.col(f"l{k}"))))

    def runs(k: int) -> Column:
        nodes = F.col(f"l{k}")
        one = lambda j: F.struct(F.lit(base + k).cast("long").alias("level"), (F.col("block") * _POWERS[STRIDE - 1 - k] + j).alias("run"), F.slice(nodes, ARITY * j + 1, ARITY).alias("hashes"), F.lit(False).alias("above"))
        return F.coalesce(F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int")), one), F.array())

    last = F.struct(F.lit(base + STRIDE).cast("long").alias("level"), F.col("block").alias("run"), F.col(f"l{STRIDE}").alias("hashes"), (_nodes_above(STRIDE) > 1).alias("above"))
    rows = F.concat(*[runs(k) for k in range(STRIDE)], F.when(F.col(f"l{STRIDE}").isNull(), F.array()).otherwise(F.array(last)))
    return grown.select("tree", "n", F.explode(rows).alias("r")).select("tree", "n", "r.*")


def _nodes_above(k: int) -> Column:
    return _over(F.col("n") + F.lit(_POWERS[k] - 1), F.lit(_POWERS[k]))


def node_runs(leaves: DataFrame, largest: int) -> DataFrame:
    """The node table (tree, level, run, hashes) of leaves (tree, idx, n, hash); a run of level ``height`` holds the tree's root alone."""
    level, base, tables = leaves.select("tree", "idx", "n", "hash"), 0, []
    while base == 0 or largest > 1:
        made = stash(_stride(level, base))
        tables.append(made.where("not above").select("tree", "level", "run", "hashes"))
        level = made.where("above").select("tree", F.col("run").alias("idx"), _nodes_above(STRIDE).alias("n"), F.col("hashes")[0].alias("hash"))
        base, largest = base + STRIDE, -(-largest // _POWERS[STRIDE])
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def steps(points: DataFrame, runs: DataFrame) -> DataFrame:
    """(tree, idx, steps) of points (tree, idx, base, top), nodes at level base: the siblings left and right of their way up to level top.

    A point without levels to climb has no row.
    """
    asked = points.where("top > base").select("tree", "idx", "base", F.explode(F.sequence("base", F.col("top") - 1)).alias("level"))
    asked = asked.withColumn("at", _over(F.col("idx"), _power(F.col("level") - F.col("base"))))
    asked = asked.select("tree", "idx", "level", _over(F.col("at"), F.lit(ARITY)).alias("run"), (F.col("at") % ARITY).cast("int").alias("pos"))
    joined = lambda x: F.unhex(F.array_join(F.transform(x, F.hex), ""))
    left, right = joined(F.slice("hashes", 1, F.col("pos"))), joined(F.slice("hashes", F.col("pos") + 2, ARITY))
    met = asked.join(runs, ["tree", "level", "run"]).select("tree", "idx", F.struct("level", left.alias("left"), right.alias("right")).alias("step"))
    return met.groupBy("tree", "idx").agg(F.array_sort(F.collect_list("step")).alias("steps"))


def folded(leaf_: Column, way: Column) -> Column:
    """The root that a leaf (hex) reaches along its steps."""
    return F.aggregate(way, leaf_, lambda h, s: F.sha2(F.concat(_text(s["left"]), h, _text(s["right"])), 256))


def proof_digest(way: Column) -> Column:
    """Hash of all siblings from the leaf's level to the root, left to right."""
    return F.sha2(F.array_join(F.transform(way, lambda s: F.concat(_text(s["left"]), _text(s["right"]))), ""), 256)


class Manifest(NamedTuple):
    leaves: DataFrame  # tree, idx, n, leaf and further columns
    runs: DataFrame  # tree, level, run, hashes
    trees: DataFrame  # tree, n, subroot, idx and width (place among the trees and their number)
    top_runs: DataFrame


def manifest(rows: DataFrame, source: str, order: list[str]) -> Manifest:
    """The trees over rows with a source, columns of order and a leaf (32 bytes); rows keep all their columns but source."""
    tree = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))
    leaves = stash(placed(rows.withColumn("tree", tree).drop(source), [*order, "leaf"]))
    largest = leaves.agg(F.max("n")).first()[0] or 0
    runs = node_runs(leaves.withColumn("hash", F.col("leaf")), largest)
    sizes = leaves.where("idx = 0").select("tree", "n")
    roots = runs.join(sizes.withColumn("level", height(F.col("n"))), ["tree", "level"]).select("tree", "n", F.col("hashes")[0].alias("subroot"))
    top = stash(placed(roots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("own"), F.col("n").alias("own_n"), "subroot"), ["own"]))
    trees = top.select(F.col("own").alias("tree"), F.col("own_n").alias("n"), "subroot", "idx", F.col("n").alias("width"))
    return Manifest(leaves, runs, trees, node_runs(top.withColumn("hash", F.col("subroot")), top.count()))


def root(m: Manifest) -> DataFrame:
    """One row with the root; none without leaves."""
    width = m.trees.agg(F.max("width").alias("width"))
    return m.top_runs.join(width, F.col("level") == height(F.col("width"))).select(_text(F.col("hashes")[0]).alias("root"))


def prove(m: Manifest) -> DataFrame:
    """The leaves with their subroot, the root and their proof (steps), lowest level first."""
    # one row: nodes of all trees at each level
    counts = m.trees.agg(*[F.coalesce(F.sum(_nodes_above(k)), F.lit(0)).alias(str(k)) for k in range(len(_POWERS) // 2)]).first()
    few = max(TOP_NODES, 2 * m.trees.count())
    cut = next(k for k in range(len(counts)) if counts[k] <= few)
    top = height(F.col("n"))
    point = lambda idx, base, to: (F.col(idx).alias("idx"), F.lit(base).cast("long").alias("base"), to.alias("top"))
    # nodes at the cut: their way to the subroot, then the subroot's way to the root
    each = m.trees.withColumn("node", F.explode(F.sequence(F.lit(0).cast("long"), _nodes_above(cut) - 1)))
    upper = steps(each.select("tree", *point("node", cut, top)), m.runs.where(F.col("level") >= cut)).withColumnsRenamed({"idx": "node", "steps": "middle"})
    last = steps(m.trees.select(F.lit(TOP).alias("tree"), *point("idx", 0, height(F.col("width")))), m.top_runs).select("idx", F.col("steps").alias("top_steps"))
    none = F.array().cast("array<struct<level:bigint,left:binary,right:binary>>")
    rest = F.concat(F.coalesce("middle", none), F.coalesce("top_steps", none))
    ends = stash(each.join(upper, ["tree", "node"], "left").join(last, "idx", "left").crossJoin(F.broadcast(root(m))).select("tree", "node", _text(F.col("subroot")).alias("subroot"), "root", rest.alias("rest")))
    if counts[cut] <= TOP_NODES:
        ends = F.broadcast(ends)
    lower = steps(m.leaves.select("tree", *point("idx", 0, F.least(top, F.lit(cut)))), m.runs.where(F.col("level") < cut)) if cut else None
    met = m.leaves.join(lower, ["tree", "idx"], "left") if cut else m.leaves.withColumn("steps", none)
    met = met.withColumn("node", _over(F.col("idx"), F.lit(_POWERS[cut]))).join(ends, ["tree", "node"])
    return met.withColumn("steps", F.concat(F.coalesce("steps", none), "rest")).drop("node", "rest")

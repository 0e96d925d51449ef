"""Group identifiers for records that are linked in pairs, directly or through others.

Union-find within edge partitions, of which only the spanning forest is kept;
the forests are merged level by level through partitions of bounded size.

A level takes edges between nodes.  Each partition runs union-find over its own
edges and emits a star per local component: every node with its local root.  A
node that has one root everywhere hangs below it for good.  A node that got
several roots ties them together: these root-to-root edges, and nothing else,
are the next level's edges.  The first level always has several partitions;
when a later level's edges fit into one (``FINAL_EDGES``) it is the last one.
Then the roots are resolved from the top level down, one join per level.  A
partition folds its edges in batch by batch over one parent array, so its time
grows in proportion to its edges and what it holds to its nodes.

Between levels edges are brought together at the endpoint that has the smaller
hash at that level, so every node that is a local maximum disappears: the nodes
shrink by a constant factor per level on any graph, long chains included.  An
endpoint with more edges than a partition may hold is salted.

Records that share a value are tied through a node of the value, so a value
with n holders gives n edges and never pairs; a value that a third of all
records hold is spread over the partitions like any other edges.

Edge cases (tested): edges with a null end are ignored; loops and repeated edges
do no harm; an empty edge list gives no rows; nodes tied to nobody but
themselves are not reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivum.functions.text import is_missing
from archivum.session import Scratch, collect_bounded, table

#: Edges that one task may hold; a level with no more of them is the last.
FINAL_EDGES = 2_000_000
MAX_LEVELS = 200
#: Edges for which the first level takes a partition of its own, up to the session's partitions.
LEAF_EDGES = 100_000


def local_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of one partition's edges, and for each the smallest node of its component."""
    codes, names = pd.factorize(np.concatenate([u, v]), sort=True)
    parent = np.arange(len(names))
    a, b = codes[: len(u)], codes[len(u) :]
    while True:
        ra, rb = parent[a], parent[b]
        differ = ra != rb
        if not differ.any():
            break
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        # Hook the larger root below the smaller one, then halve paths until all point to a root.
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return names, names[parent]


class Forest:
    """Union-find over named nodes, fed batch by batch; a batch costs its own size, not the forest's."""

    def __init__(self):
        self.index: dict = {}
        self.parent = np.zeros(1024, dtype=np.int64)

    def _codes(self, names: np.ndarray) -> np.ndarray:
        index = self.index
        for x in names:
            if x not in index:
                index[x] = len(index)
        if len(index) > len(self.parent):
            self.parent = np.concatenate([self.parent, np.zeros(max(len(self.parent), len(index)), dtype=np.int64)])
        codes = np.fromiter((index[x] for x in names), dtype=np.int64, count=len(names))
        return codes

    def roots(self, at: np.ndarray) -> np.ndarray:
        """The roots of some nodes, which then hang right below them."""
        up = self.parent[at]
        while True:
            higher = self.parent[up]
            if (higher == up).all():
                break
            up = self.parent[higher]
        self.parent[at] = up
        return up

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        codes, names = pd.factorize(np.concatenate([u, v]))
        known = len(self.index)
        nodes = self._codes(names)
        self.parent[known : len(self.index)] = np.arange(known, len(self.index))
        tops = self.roots(nodes)[codes]
        # Only the roots that this batch meets are united.
        low, high = local_roots(tops[: len(u)], tops[len(u) :])
        self.parent[low] = high

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """Every node and the smallest name of its component."""
        names = np.array(list(self.index), dtype=object)
        roots = self.roots(np.arange(len(names)))
        order = np.argsort(names, kind="stable")
        smallest = np.full(len(names), len(names), dtype=np.int64)
        rank = np.empty(len(names), dtype=np.int64)
        rank[order] = np.arange(len(names))
        np.minimum.at(smallest, roots, rank)
        return names, names[order[smallest[roots]]]


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over a partition; only its spanning forest leaves it."""
    forest = Forest()
    for b in batches:
        forest.add(b["u"].to_numpy(dtype=object), b["v"].to_numpy(dtype=object))
    if forest.index:
        names, roots = forest.stars()
        for lo in range(0, len(names), 100_000):
            yield pd.DataFrame({"node": names[lo : lo + 100_000], "root": roots[lo : lo + 100_000]})


def _spread(edges: DataFrame, parts: int, level: int, bound: int) -> DataFrame:
    """Edges brought together at the endpoint with the smaller hash; a crowded endpoint is salted."""
    hu, hv = F.xxhash64("u", F.lit(level)), F.xxhash64("v", F.lit(level))
    owned = edges.select("u", "v", F.when(hu <= hv, F.col("u")).otherwise(F.col("v")).alias("owner"), F.when(hu <= hv, F.col("v")).otherwise(F.col("u")).alias("other"))
    # At most edges/bound owners can be crowded.
    crowded = owned.groupBy("owner").count().where(F.col("count") > bound).select("owner", F.ceil(F.col("count") / bound).cast("int").alias("salts"))
    placed = owned.join(crowded, "owner", "left").withColumn("salt", F.pmod(F.xxhash64("other"), F.coalesce("salts", F.lit(1))))
    return placed.repartition(parts, "owner", "salt").select("u", "v")


def components(edges: DataFrame, final_edges: int = FINAL_EDGES, scratch: Scratch | None = None) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: strings); equal root means one component."""
    scratch = scratch or Scratch(edges.sparkSession, "components")
    edges = scratch.save(edges.where("u is not null and v is not null and u != v").select("u", "v"), "edges0")
    levels: list[DataFrame] = []
    for level in range(MAX_LEVELS):
        n = edges.count()
        last = level > 0 and n <= final_edges
        wide = max(2, min(-(-n // LEAF_EDGES), edges.sparkSession.sparkContext.defaultParallelism))
        placed = edges.coalesce(1) if last else _spread(edges, max(wide if level == 0 else 2, -(-n // final_edges) * 2), level, final_edges)
        stars = scratch.save(placed.mapInPandas(_forest, "node string, root string"), f"stars{level}")
        if last:
            levels.append(stars)
            break
        # The lowest root holds; the others are tied to it on the next level.
        lowest = stars.groupBy("node").agg(F.min("root").alias("root"), F.max("root").alias("most"))
        levels.append(scratch.save(lowest.select("node", "root"), f"level{level}"))
        several = lowest.where("root != most").select("node", F.col("root").alias("u"))
        # A node's forests are as many as the partitions that saw it, so this join is bounded per node.
        edges = scratch.save(stars.join(several, "node").where("root != u").select("u", F.col("root").alias("v")).distinct(), f"edges{level + 1}")
        scratch.drop(f"stars{level}")
        scratch.drop(f"edges{level}")
    else:
        raise RuntimeError("the levels did not come to an end")
    out = levels.pop()
    while levels:
        below = levels.pop()
        up = out.select(F.col("node").alias("root"), F.col("root").alias("top"))
        # Every root is a node of its own level too, so nothing is left out.
        out = below.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return out


def groups_by_shared_value(rows: DataFrame, record: str, value_columns: list[str], final_edges: int = FINAL_EDGES) -> DataFrame:
    """(record, group_id) for every record in a group of two or more; group_id is the smallest record.

    Two records are tied if they hold the same (non-null) tuple of ``value_columns``.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "groups")
    # Records sort before values, so a component's root is its smallest record.
    value = F.concat_ws("\x1f", F.lit("￿"), *[F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)) for c in value_columns])
    ok = F.col(record).isNotNull()
    for c in value_columns:
        ok = ok & F.col(c).isNotNull()
    edges = rows.where(ok).select(F.col(record).alias("u"), value.alias("v")).distinct()
    found = components(edges, final_edges, scratch).where(~F.col("node").startswith("￿"))
    found = scratch.save(found, "found")
    # Partial counts and minima per root; a hot root is one row after the map side.
    sizes = found.groupBy("root").agg(F.count("*").alias("n"), F.min("node").alias("group_id")).where("n > 1").select("root", "group_id")
    return found.join(sizes, "root").select(F.col("node").alias(record), "group_id")


def p7_found(spark, sf_dir):
    ids = table(spark, sf_dir, "format_identifier")
    tokens = [r[0] for r in collect_bounded(table(spark, sf_dir, "null_token").where("token is not null"), 10_000, "the null tokens")]
    strong = ids.where(F.col("identifier_type").isin("puid", "loc", "nara") & ~is_missing(F.col("identifier_value"), tokens))
    strong = strong.select("canonical_id", "identifier_type", F.lower(F.trim("identifier_value")).alias("value"))
    return groups_by_shared_value(strong, "canonical_id", ["identifier_type", "value"])

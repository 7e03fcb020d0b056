"""Connected components on DataFrames, with no collected group and no collected label."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracord.llm.common import cut, dealt_join, release
from veracord.llm.vector import forest, lean


#: Edges that a task joins at a time; edges, after each task has joined its own, up to which one task joins them all.
HELD, FEW = 2_000_000, 1 << 18


def contracted(edges: DataFrame) -> DataFrame:
    """The same components with fewer edges: each task replaces its own by stars of their smallest
    nodes, so that it gives a node one edge, and what is dealt by node after it few more in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size > HELD:
                e = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
                if len(e[0]) > HELD // 2:
                    yield edge_batch(*e)
                    held, size = [], 0
                else:
                    held, size = [e], len(e[0])
        if held:
            yield edge_batch(*forest(*(np.concatenate(x) for x in zip(*held, strict=True))))

    return edges.select("a", "b").mapInArrow(lean(run), "a long, b long")


def edge_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def joined(edges: DataFrame) -> DataFrame:
    """node, component of ``edges(a, b)``, all of them in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
        if held:
            node, root = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
            own = np.unique(root)
            yield edge_batch(np.concatenate([node, own]), np.concatenate([root, own])).rename_columns(["node", "component"])

    return edges.select("a", "b").repartition(1).mapInArrow(lean(run), "node long, component long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component for every node of ``edges(a, b)``; component is its smallest reachable node.

    Each task joins its own edges. Up to FEW that are left go to one task, which costs no
    rounds; for more, it alternates the large-star and small-star steps, each a partial aggregate and a join
    on the node, until the edges are stars. Every round is written to the shared
    folder, the one before is removed. A hub's edges are split by the join, its minimum is
    combined within tasks. Loops and null ends are dropped; an empty table gives no rows.
    """
    e = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    own = cut(contracted(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "edges")
    if own.count() <= FEW:
        out = cut(joined(own), "components")
        release(own)
        return out
    e = cut(contracted(own.repartition("a")).distinct(), "edges")
    release(own)
    for _ in range(max_rounds):
        if _settled(e):
            break
        both = e.union(e.select("b", "a"))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = dealt_join(both.where("b > a"), lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = dealt_join(large, lowest, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, e = e, cut(moved.union(lowest.select("a", F.col("m").alias("b"))).distinct(), "edges")
        release(old)
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    roots = e.select("b").distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select(F.col("b").alias("node"), F.col("b").alias("component")))


def _settled(e: DataFrame) -> bool:
    """Whether every node points to one other, which points to none."""
    ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)").isEmpty()

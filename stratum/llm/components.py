"""Connected components of an edge table.

Edges are first contracted inside each partition by union-find, which also takes
the degree out of hubs. What is left is finished by alternating large-star and
small-star rounds, whose minima are pre-aggregated and whose joins Spark may
split. Up to `small` edges (a checked count) are finished by one bounded task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import saved

SMALL = 200_000


def forest(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Node -> least node of its component, by union-find."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for a, b in pairs:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def _contract(limit: int = 500_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int]] = []

        def flush() -> pa.RecordBatch:
            stars = [(x, r) for x, r in forest(iter(held)).items() if x != r]
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in stars], pa.int64()), pa.array([r for _, r in stars], pa.int64())], names=["a", "b"])

        for b in batches:
            held += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
            if len(held) > limit:
                yield flush()
                held = []
        yield flush()

    return run


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, component) of every node that has an edge to another one; component is the least node reachable.

    `edges`: two long columns. Null ends and loops are ignored; repeated and
    reversed edges do not matter. No edges give an empty table.
    """
    a, b = (F.col(f"`{c}`") for c in edges.columns[:2])
    e = edges.select(a.alias("a"), b.alias("b")).where("a is not null and b is not null and a <> b")
    e = saved(e.mapInArrow(_contract(), "a long, b long"), "edges")
    if e.count() <= small:
        done = e.repartition(1).mapInArrow(_contract(2 * small), "a long, b long")
    else:
        state = None
        while True:
            both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            e = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
            least = e.groupBy("a").agg(F.min("b").alias("m"))
            e = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
            e = saved(e, "edges")
            now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
            if now == state:
                break
            state = now
        done = e
    done = saved(done, "components")
    return done.select(F.col("a").alias("node"), F.col("b").alias("component")).union(done.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

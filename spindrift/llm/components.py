"""Connected components of an edge table: each node's smallest reachable node."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import forget, written

#: Edges that one task contracts at a time.
CONTRACT_ROWS = 1 << 20
_EDGES = pa.schema([("hi", pa.int64()), ("lo", pa.int64())])


def forest(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Union by smallest: each node that is not the smallest of its tree, and that smallest."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x] = top
            x = up
        return top

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int]] = []

    def stars() -> pa.RecordBatch:
        found = forest(held)
        return pa.record_batch([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], schema=_EDGES)

    for batch in batches:
        held += zip(batch["hi"].to_pylist(), batch["lo"].to_pylist(), strict=True)
        if len(held) >= CONTRACT_ROWS:
            yield stars()
            held = []
    if held:
        yield stars()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b), component being the smallest node reachable.

    Each task first contracts its own edges to stars; then large-star and small-star steps alternate until nothing
    changes, or until the edges left are so few that one task contracts them at once (CONTRACT_ROWS, counted first),
    which ends it whatever their shape.  No step gathers a node's neighbours: minima are aggregates and are joined
    back, so a node with very many neighbours only makes a skewed join, which Spark splits.  Loops and null ends are
    left out.
    """
    e = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("a <> b")
    e = written(e.mapInArrow(_contract, "hi long, lo long"), "edges")
    seen = None
    while True:
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if (few := 0 < now[0] <= CONTRACT_ROWS) and now != seen:
            e, old = written(e.coalesce(1).mapInArrow(_contract, "hi long, lo long"), "edges"), e
            forget(old)
        if now[0] == 0 or now == seen or few:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
        seen = now
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(low.select("hi", "m")).distinct()
        e, old = written(small, "edges"), e
        forget(old)

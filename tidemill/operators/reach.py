"""What nodes of a directed graph reach.

A graph of at most `held` edges is counted, then broadcast; tasks take seeds 64 at a time, a bit each, and go out level by level over the whole
graph, so a long chain costs array steps and not jobs. A larger graph is searched by joins, one a hop, over the pairs found last;
only new pairs are written. Neither computes more than what the seeds reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemill.llm.common import staged
from tidemill.session import ROWS, cut, tasks_for

#: Edges that are broadcast at most (8 bytes each, and their nodes' names).
HELD = 2_000_000


class _Graph:
    def __init__(self, rows: list[tuple]):
        self.nodes = sorted({x for r in rows for x in r})
        self.number = {x: i for i, x in enumerate(self.nodes)}
        src = np.array([self.number[a] for a, _ in rows], np.int64)
        dst = np.array([self.number[b] for _, b in rows], np.int64)
        order = np.argsort(src, kind="stable")
        self.to, self.first = dst[order].astype(np.int32), np.searchsorted(src[order], np.arange(len(self.nodes) + 1))

    def levels(self, seeds: list[int], most_hops: int | None, seen: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(hops, seed's place, node) of all that up to 64 seeds reach, level by level. seen, zeros for all nodes, is left as it came, at the cost of what is reached."""
        touched = []
        at, bits = np.array(seeds, np.int64), np.uint64(1) << np.arange(len(seeds), dtype=np.uint64)
        hops = 0
        while len(at) and hops != most_hops:
            hops += 1
            count = self.first[at + 1] - self.first[at]
            edge = np.arange(int(count.sum())) + np.repeat(self.first[at] - (np.cumsum(count) - count), count)
            to, carried = self.to[edge], np.repeat(bits, count)
            order = np.argsort(to, kind="stable")
            at, begin = np.unique(to[order], return_index=True)
            if not len(at):
                break
            bits = np.bitwise_or.reduceat(carried[order], begin) & ~seen[at]
            at, bits = at[bits > 0], bits[bits > 0]
            seen[at] |= bits
            touched.append(at)
            node, seed = np.nonzero((bits[:, None] >> np.arange(len(seeds), dtype=np.uint64)) & np.uint64(1))
            yield hops, seed, at[node]
        for at in touched:
            seen[at] = 0


def reach_from(edges: DataFrame, seeds: DataFrame, src: str = "src", dst: str = "dst", most_hops: int | None = None, held: int = HELD) -> DataFrame:
    """(src, dst, hops): every node that each seed (column src of seeds) reaches by one edge or more, with the least number of edges.

    A seed reaches itself only over a cycle. Edges with a null end and null seeds go; repeated edges and seeds count once. Only a given most_hops bounds the hops.
    """
    one = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null").distinct()
    starts = seeds.select(F.col(src).cast(one.schema["src"].dataType).alias("src")).where("src is not null").distinct()
    if one.limit(held + 1).count() > held:
        return _by_joins(one, starts, most_hops)
    graph = _Graph([tuple(r) for r in one.collect()])
    schema = StructType([StructField("src", one.schema["src"].dataType), StructField("dst", one.schema["src"].dataType), StructField("hops", IntegerType())])
    arrow, shared = to_arrow_schema(schema), edges.sparkSession.sparkContext.broadcast(graph)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g: _Graph = shared.value
        seen = np.zeros(len(g.nodes), np.uint64)
        names = pa.array(g.nodes, arrow.field("src").type)
        known = [g.number[x] for b in batches for x in b.column("src").to_pylist() if x in g.number]
        for i in range(0, len(known), 64):
            block = known[i : i + 64]
            own = names.take(pa.array(block))
            for hops, seed, node in g.levels(block, most_hops, seen):
                cols = [own.take(pa.array(seed)), names.take(pa.array(node)), pa.array(np.full(len(node), hops, np.int32))]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return starts.mapInArrow(run, schema)


def by_start(edges: DataFrame) -> DataFrame:
    """Edges as (_at, _to), bucketed by their start, so that a hop shuffles the pairs found last and not the edges."""
    return staged(edges.select(F.col("src").alias("_at"), F.col("dst").alias("_to")), "edges", by="_at", parts=tasks_for(edges, ROWS))


def _by_joins(one: DataFrame, starts: DataFrame, most_hops: int | None) -> DataFrame:
    ahead = by_start(one)
    step = cut(starts.join(ahead, starts["src"] == ahead["_at"]).select("src", F.col("_to").alias("dst")).distinct())
    found, hops = step.withColumn("hops", F.lit(1)), 1
    while hops != most_hops and not step.isEmpty():
        hops += 1
        nxt = step.join(ahead, step["dst"] == ahead["_at"]).select("src", F.col("_to").alias("dst")).distinct()
        step = cut(nxt.join(found.select("src", "dst"), ["src", "dst"], "left_anti"))
        found = found.unionByName(step.withColumn("hops", F.lit(hops)))
    return found


def reachable(spark: SparkSession, edges: DataFrame, src: str = "src", dst: str = "dst", most_hops: int | None = None) -> DataFrame:
    """(src, dst, hops): what every node reaches. The answer itself may have a row for each pair of nodes; ask reach_from() for some nodes where that is enough."""
    return reach_from(edges, edges.select(src), src, dst, most_hops)

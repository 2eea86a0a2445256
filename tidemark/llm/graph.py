"""Connected components of a distributed set of links, with nothing of it on the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import materialize, ship

#: Edges that one task may finish: about 100 MB in its memory, whatever the size of the input.
IN_ONE_TASK = 200_000


def components(links: DataFrame, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """(node, label) of every node of ``links`` (u, v); the label is the smallest node of its component.

    In each round every node hooks to the neighbour that is smallest by a hash drawn anew,
    and hooked nodes are contracted; the number of nodes shrinks by a constant factor even
    on long chains.  Each round is written to the shared folder, so a lost executor costs
    that round at most.  Once no more than ``in_one_task`` edges are left, one task joins
    them; what it holds is bounded by that number.
    """
    edges = materialize(_distinct(links.where("u <> v")))
    hops = []
    while left := edges.count():
        if left <= in_one_task:
            hops.append(materialize(_at_once(edges)))
            break
        draw = lambda c, k=len(hops): F.struct(F.xxhash64(F.lit(k), F.col(c)).alias("r"), F.col(c).alias("n"))
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min(draw("v")).alias("near"))
        hop = materialize(lowest.select(F.col("u").alias("node"), F.least(draw("u"), F.col("near"))["n"].alias("to")))
        hops.append(hop)
        left = hop.select(F.col("node").alias("u"), F.col("to").alias("pu"))
        right = hop.select(F.col("node").alias("v"), F.col("to").alias("pv"))
        moved = edges.join(left, "u").join(right, "v").where("pu <> pv")
        edges = materialize(_distinct(moved.select(F.col("pu").alias("u"), F.col("pv").alias("v"))))
    if not hops:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    found = hops[0]
    for hop in hops[1:]:
        step = hop.select(F.col("node").alias("to"), F.col("to").alias("next"))
        found = found.join(step, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    found = materialize(found)
    smallest = found.groupBy("to").agg(F.min("node").alias("label"))
    return found.join(smallest, "to").select("node", "label")


def _at_once(edges: DataFrame) -> DataFrame:
    """(node, to) with ``to`` the same for all nodes of a component, by union and find in one task."""
    kind = edges.schema["u"].dataType.simpleString()
    arrow = to_arrow_type(edges.schema["u"].dataType)
    ship(edges.sparkSession)

    def run(batches):
        up: dict = {}

        def find(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                up.setdefault(u, u)
                up.setdefault(v, v)
                a, b = find(u), find(v)
                if a != b:
                    up[max(a, b)] = min(a, b)
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, arrow), pa.array([find(x) for x in nodes], arrow)], names=["node", "to"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, f"node {kind}, to {kind}")


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()

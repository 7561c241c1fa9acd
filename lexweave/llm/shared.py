"""Tables in the folder all executors share, and connected components.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir`` and
reading it back: unlike cached blocks, such a table survives lost executors.
A table stays until ``Scratch.drop`` (loops drop what a later round replaces);
what a returned DataFrame still reads must outlive the call, so the operator of
the cluster clears the folder as they do other checkpoints.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Scratch:
    """Named tables in the shared folder, one sub-folder for each use."""

    def __init__(self, spark: SparkSession):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="lexweave-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.spark, self.root = spark, f"{base.rstrip('/')}/lexweave-{uuid.uuid4().hex}"

    def store(self, df: DataFrame, label: str) -> DataFrame:
        """Write df and return the reading of what was written."""
        path = f"{self.root}/{label}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        vars(out)["_stored_at"] = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete stored tables that nothing reads any more; frames that ``store`` did not return are left alone."""
        jvm = self.spark._jvm
        for df in frames:
            if path := vars(df).pop("_stored_at", None):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def _order(c: str) -> Column:
    return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))


def components(edges: DataFrame, scratch: Scratch, label: str = "cc") -> DataFrame:
    """Connected components of the undirected edges (a, b): one row (node, component) for each
    node that has an edge to another, component being its smallest node.

    Rounds of contraction: each node joins the neighbour (or itself) that comes first in a fixed
    pseudo-random order, edges are renamed and made distinct, until none is left. The expected
    number of rounds is logarithmic. Minima are combined before each shuffle, so a node with a
    third of all edges costs one row per task; joins are plain equi-joins that adaptive execution
    can split. Nulls, self-loops and repeated edges are ignored.
    """
    e = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    pairs = scratch.store(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{label}-pairs-0")
    maps: list[DataFrame] = []
    while not pairs.isEmpty():
        k = len(maps)
        best = pairs.groupBy("a").agg(F.min(_order("b")).alias("n"))
        m = scratch.store(best.select(F.col("a").alias("node"), F.least(_order("a"), F.col("n"))["id"].alias("rep")), f"{label}-map-{k}")
        maps.append(m)
        nxt = pairs.join(m.select(F.col("node").alias("a"), F.col("rep").alias("ra")), "a").join(m.select(F.col("node").alias("b"), F.col("rep").alias("rb")), "b")
        nxt = scratch.store(nxt.where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), f"{label}-pairs-{k + 1}")
        scratch.drop(pairs)
        pairs = nxt
    if not maps:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = maps[0]
    for m in maps[1:]:
        out = out.join(m.select(F.col("node").alias("rep"), F.col("rep").alias("up")), "rep", "left").select("node", F.coalesce("up", "rep").alias("rep"))
    if len(maps) > 1:
        out = scratch.store(out, f"{label}-reps")
        scratch.drop(*maps)
    least = out.groupBy("rep").agg(F.min(F.least("node", "rep")).alias("component"))
    return out.join(least, "rep").select("node", "component")

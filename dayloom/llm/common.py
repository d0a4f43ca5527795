"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset and all run on one machine (tests) a new local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        found = _OWN[0]
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    Cuts lineage as checkpoint() does, but the files hold columns, so later
    reads prune them and know their size, and a lost executor costs nothing.
    """
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def carried(docs: DataFrame, *names: str) -> DataFrame:
    """_doc, a struct of all columns of docs, and the named columns: so that no column of docs can clash with an operator's own."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), *(F.col(n) for n in names))


def released(df: DataFrame, *new: str) -> DataFrame:
    """The columns in _doc and the new ones; a new one takes the place of a column of the same name."""
    taken = {n.lower() for n in new}
    return df.select(*(F.col("_doc").getField(f.name).alias(f.name) for f in df.schema["_doc"].dataType.fields if f.name.lower() not in taken), *(F.col(n) for n in new))


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches to Python hold few rows, as one row may hold a very long text.

    All operators take the same number, so plans made before keep theirs; inside
    a batch slices() bounds the bytes that are worked on at once.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Up to so many edges (a few MB) a graph's components are found by one task; a larger graph takes rounds of joins.
ONE_TASK = 200_000


def union_find(edges: pa.Table) -> pa.Table:
    """(node, label) of the nodes of edges (a, b), by numpy: every round each edge's ends take the smaller label, and labels their labels' labels."""
    nodes, ends = np.unique(np.concatenate([edges["a"].to_numpy(), edges["b"].to_numpy()]), return_inverse=True)
    a, b = ends[: edges.num_rows], ends[edges.num_rows :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (a, b, label[a], label[b]):
            np.minimum.at(new, x, low)
        new = new[new]
        if (new == label).all():
            return pa.table({"node": nodes, "label": nodes[label]})
        label = new


def min_label_components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, label), label the smallest node.

    Nodes without an edge have no row. Nulls are ignored. Up to ONE_TASK edges,
    counted in the written edges, go to one task. Beyond that, every round each
    node takes the smallest label among its own and its neighbours' (a join and
    a grouping with map-side combine), then the label of that label; a round is
    written to the shared folder. The number of rounds is logarithmic for stars
    and short chains, and a round moves one row for each edge end.
    """
    edges = cut(edges.where("a <> b").select("a", "b").distinct())
    if edges.count() <= ONE_TASK:

        def whole(batches):
            found = list(batches)
            if found:
                yield from union_find(pa.Table.from_batches(found)).to_batches()

        return cut(edges.coalesce(1).mapInArrow(whole, "node long, label long"))
    both = cut(edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")))
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "b", "label": "l"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("l").alias("near"))
        met = cut(labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label")))
        onto = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = cut(met.join(onto, "label", "left").select("node", "was", F.least("label", "top").alias("label")))
        if new.where("was <> label").limit(1).count() == 0:
            return new.select("node", "label")
        labels = new.select("node", "label")

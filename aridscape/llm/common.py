"""Shared folder, written intermediate tables and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and every executor reach.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a local
    session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return _LOCAL.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="llm-shared-"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """New path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    file_system = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    file_system.mkdirs(jvm_path)
    file_system.deleteOnExit(jvm_path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a finished intermediate table of this job."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later jobs neither
    repeat what is behind it nor depend on an executor's own disk."""
    path = f"{scratch_path(df.sparkSession, name)}/data"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def boxed(docs: DataFrame, **keys) -> DataFrame:
    """``docs`` as one struct ``row`` beside the given key columns, so that no
    column of a caller's table can clash with a name used inside."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, *[column.alias(name) for name, column in keys.items()])


def _contract(batches):
    """Spanning forest of the links in one task, as (member, smallest member)."""
    import numpy as np
    import pyarrow as pa

    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def forest():
        members = list(parent)
        roots = [find(x) for x in members]
        parent.clear()
        a, b = np.array(members, np.int64), np.array(roots, np.int64)
        keep = a != b
        return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["u", "v"])

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > 500_000:
            yield forest()
    if parent:
        yield forest()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (u long, v long): root is the
    smallest node reachable.

    Each task first replaces its links by a spanning forest. Then large-star
    and small-star rounds alternate until no link changes: a round only takes
    minima per node, so a node with many links is aggregated before the shuffle.
    Null ends are ignored; no links give no rows.
    """
    edges = links.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select("u", "v").mapInArrow(_contract, "u long, v long")
    edges = written(edges.distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == before or not now[0]:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)

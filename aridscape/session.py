"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "aridscape", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators rely on.

    On a cluster the master, memory and shuffle settings come from
    ``spark-submit``; only semantics-bearing options are fixed here.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_FOLDERS: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """New place for stored models and layers in the folder every executor reaches
    (``spark.checkpoint.dir``); a temporary folder only in local mode without one."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if base is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = _FOLDERS.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="aridscape-shared-"))
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. A
    temporary one is used only where nothing is configured (local tests).
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        configured = context.getConf().get("spark.checkpoint.dir")
        if configured is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="aridscape-checkpoint-"))
    return df.checkpoint(eager=True)

"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_SCRATCH: dict[str, str] = {}


def build_session(app_name: str = "faultscope", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on; keyword settings use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for cut lineage and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master may fall back to a
    folder of this machine, because there every task runs on it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    app_id = spark.sparkContext.applicationId
    if configured:
        return f"{configured.rstrip('/')}/faultscope/{app_id}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if app_id not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app_id] = tempfile.mkdtemp(prefix="faultscope-")
    return _LOCAL_SCRATCH[app_id]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write once as Parquet in the scratch folder and read back: reused results survive lost
    executors, are not recomputed, and keep column pruning."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a reader finds anything at a path; every other failure is raised."""
    try:
        spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def broadcast_if_small(df: DataFrame, max_rows: int, max_bytes: int = 256 * 1024 * 1024) -> tuple[DataFrame, bool]:
    """Hint a broadcast only after measuring rows and bytes; the flag tells the caller which join
    it gets. Meant for written tables, as it reads the data once."""
    width = sum((F.coalesce(F.octet_length(f"`{n}`"), F.lit(0)) if t == "string" else F.lit(8) for n, t in df.dtypes), F.lit(0))
    size = df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(width), F.lit(0)).alias("n_bytes")).first()
    small = size["n_rows"] <= max_rows and size["n_bytes"] <= max_bytes
    return (F.broadcast(df) if small else df), small

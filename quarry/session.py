"""Session construction, shared-folder checkpoints and code shipping."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE_ROOT = Path(__file__).resolve().parent


def build_session(app: str = "quarry", master: str | None = None, **conf: object) -> SparkSession:
    """A session with adaptive execution, UTC time and Arrow transfer; ``conf`` overrides any key (``__`` for dots)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    } | {k.replace("__", "."): str(v) for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_code(spark: SparkSession) -> None:
    """Make this package importable in Python workers; nothing to do where PYTHONPATH already names its folder."""
    context = spark.sparkContext
    roots = {os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(PACKAGE_ROOT.parent) in roots or getattr(context, "_quarry_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="quarry-code-"), "quarry_code.zip")
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(PACKAGE_ROOT.rglob("*.py")):
            out.write(path, path.relative_to(PACKAGE_ROOT.parent))
    context.addPyFile(target)
    context._quarry_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where the setting is absent in a local session (tests, a laptop) a folder of this machine is used instead.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not getattr(context, "_quarry_shared", None):
        context._quarry_shared = "file://" + tempfile.mkdtemp(prefix="quarry-shared-")
    return context._quarry_shared


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: columnar, prunable, free of lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/quarry-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    context = spark.sparkContext
    context._quarry_stored = [*getattr(context, "_quarry_stored", []), path]
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def cut_lineage(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """``df`` computed once and written to the shared folder; then the table ``instead_of`` it, if any, is deleted."""
    out = stored(df)
    if instead_of is not None:
        _delete(df.sparkSession, [instead_of._quarry_path])
    return out


def _delete(spark: SparkSession, paths: list[str]) -> None:
    context = spark.sparkContext
    for path in paths:
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
    gone = set(paths)
    context._quarry_stored = [p for p in getattr(context, "_quarry_stored", []) if p not in gone]


def mark(spark: SparkSession) -> int:
    """A point in the sequence of stored tables, for ``release``."""
    return len(getattr(spark.sparkContext, "_quarry_stored", []))


def release(spark: SparkSession, since: int = 0) -> int:
    """Delete the tables stored since a ``mark`` (all by default), once the results built on them have been used. The number deleted."""
    paths = getattr(spark.sparkContext, "_quarry_stored", [])[since:]
    _delete(spark, paths)
    return len(paths)

"""Session construction and shared-folder settings."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every casefile job relies on.  AQE re-plans joins and shuffle
# partition counts at runtime (skew splitting, broadcast of small build sides
# by measured size); the UI stays off because no port may be opened.
_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    # checkpoint files of collected DataFrames are removed from the shared folder
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # evidence folders hold many small files: opening one costs about as much
    # as reading 1 MB, so pack ~128 of them into a 128 MB split (default 4 MB: ~32)
    "spark.sql.files.openCostInBytes": "1m",
    # the evidence table carries inline file bytes (up to several MB per row);
    # smaller vectorized batches bound the memory one scan task decodes at once
    "spark.sql.parquet.columnarReaderBatchSize": "1024",
}


# Initial shuffle width on a cluster when the deployment sets none: AQE merges
# partitions back to the advisory size, so small jobs stay cheap, while a
# billion-file shuffle (~150 B per summary row) still gets ~40 MB partitions.
CLUSTER_SHUFFLE_PARTITIONS = 4096


def get_session(master: str | None = None, app_name: str = "casefile",
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with casefile's defaults.

    ``master`` is only set when given, so spark-submit on a cluster keeps
    control of it.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    on_cluster = not spark.sparkContext.master.startswith("local")
    if on_cluster and not shuffle_partitions and \
            not spark.sparkContext.getConf().contains("spark.sql.shuffle.partitions"):
        spark.conf.set("spark.sql.shuffle.partitions", str(CLUSTER_SHUFFLE_PARTITIONS))
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this folder is provided by the deployment and must be on
    shared storage; if it is missing there, this fails rather than fall back
    to a machine-local folder.  Only a local-mode session without the setting
    (tests) gets a fresh scratch folder.
    """
    configured = (spark.conf.get("spark.checkpoint.dir", None)
                  or spark.sparkContext.getConf().get("spark.checkpoint.dir", None))
    if configured:
        current = spark.sparkContext.getCheckpointDir()
        if not current:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder on shared storage "
                           "(casefile materialises intermediate results there)")
    local = tempfile.mkdtemp(prefix="casefile-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    try:
        spark.conf.set("spark.checkpoint.dir", local)
    except Exception:  # noqa: BLE001 - some deployments reject runtime core settings
        pass
    spark.sparkContext.setCheckpointDir(local)
    return local


def new_folder(spark: SparkSession, label: str) -> str:
    """The path of a fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/casefile/{label}-{uuid.uuid4().hex}"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``casefile`` importable in Python workers (``addPyFile`` of a zip).

    Python data sources and ``mapInPandas`` functions are unpickled in the
    workers, which then import this package.  On a cluster one would pass
    ``--py-files``; this does the same at runtime, once per SparkContext.
    The zip is built on the driver and served to executors by Spark's file
    server, so no shared folder is involved.
    """
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    package_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package_dir)
    target = os.path.join(tempfile.mkdtemp(prefix="casefile-pkg-"), "casefile.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as zf:
        for folder, _, names in os.walk(package_dir):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(target)
    _SHIPPED.add(key)

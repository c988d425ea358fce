"""Session helpers.

``get_spark`` is for tests, the bench and local runs. On a cluster the
caller owns the session; library code only reads settings from it.
"""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """Local session with the settings the library assumes (UTC, AQE, no UI)."""
    master = master or os.environ.get("TXNWATCH_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master)
        .appName("txnwatch")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("TXNWATCH_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there. Only a local master may go without
    it and gets a fresh scratch folder; elsewhere a folder of one machine would
    hide checkpoints from the other executors, so its absence is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server owns the checkpoint folder
        return configured or ""
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="txnwatch-ckpt-")
    sc.setCheckpointDir(local)
    spark.conf.set("spark.checkpoint.dir", local)
    return local


_SHIPPED: set[tuple[int, str]] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``txnwatch`` importable in executor Python workers.

    Operators that run Python on executors (``mapInPandas``,
    ``applyInPandas``, streaming state) pickle functions by module reference,
    so the workers must import this package: it is zipped once per
    SparkContext and shipped with ``addPyFile`` (what ``--py-files`` does).
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect client
        sc = None
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _dirs, files in os.walk(pkg_dir):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(root, name)
                    arc = os.path.relpath(full, os.path.dirname(pkg_dir))
                    zf.write(full, arc)
    data = buf.getvalue()
    digest = hashlib.sha1(data).hexdigest()[:12]
    key = (id(sc._jsc) if sc is not None else id(spark), digest)
    if key in _SHIPPED:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="txnwatch-pkg-"), f"txnwatch_{digest}.zip")
    with open(path, "wb") as fh:
        fh.write(data)
    if sc is not None:
        sc.addPyFile(path)
    else:
        spark.addArtifacts(path, pyfile=True)
    _SHIPPED.add(key)

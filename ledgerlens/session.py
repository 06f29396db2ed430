"""Session construction and checkpoint-directory handling."""

from __future__ import annotations

import tempfile
import warnings

from pyspark.sql import SparkSession

# Settings every session of ours runs with. ANSI stays on (division by zero,
# bad casts and overflow raise); every denominator is guarded by nullif.
SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "ledgerlens", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a SparkSession with the library defaults.

    On a cluster pass ``master=None`` and let spark-submit decide; the
    shuffle partition count should then be sized to the data (roughly
    input bytes / 128 MB), not to the core count.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in SESSION_DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def _scheme(sc, path: str) -> str:
    """The scheme of the file system that a path lies on."""
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(sc._jsc.hadoopConfiguration()).getUri().getScheme()


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory of this session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that
    one is always used. Only a local-mode session without the setting
    (tests, laptops) gets a fresh scratch folder of its own. A cluster
    session without the setting is an error: a machine-local folder would
    not survive the loss of an executor.
    """
    try:
        sc = spark.sparkContext
    except Exception:   # Spark Connect: only the configuration is visible
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder")
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    on_cluster = not sc.master.startswith("local")
    if configured and on_cluster and configured.startswith("file:"):
        raise RuntimeError(
            f"spark.checkpoint.dir is the local folder {configured}; point it at a shared "
            "folder that every executor can reach")
    if configured and on_cluster and _scheme(sc, configured) == "file":
        # a bare path: it may be a mounted share, which only the cluster knows
        warnings.warn(f"spark.checkpoint.dir ({configured}) lies on the machines' own file "
                      "system; it must be a folder that all of them share", stacklevel=2)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS, S3, ABFS, ...) that every executor can reach")
    path = tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


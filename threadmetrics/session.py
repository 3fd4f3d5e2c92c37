"""Session construction and the few session-level settings the engine needs."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

# Settings every job relies on. AQE re-plans joins at run time, coalesces
# small shuffle partitions and splits skewed join partitions; the session
# zone is pinned so calendar functions are reproducible.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Parquet sizes understate in-memory sizes; scale them before the
    # planner compares a side with the broadcast threshold.
    "spark.sql.sources.fileCompressionFactor": "4",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "threadmetrics") -> SparkSession:
    """Build (or reuse) a session with the engine settings.

    On a cluster ``master`` is left to ``spark-submit``; tests pass
    ``local[N]``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM is the only executor
            builder = builder.config("spark.driver.memory", os.environ.get("TM_DRIVER_MEMORY", "16g"))
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for k, v in ENGINE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    apply_engine_conf(spark)
    ensure_checkpoint_dir(spark)
    return spark


def apply_engine_conf(spark: SparkSession) -> None:
    """Apply the runtime-settable engine settings to an existing session."""
    for k, v in ENGINE_CONF.items():
        spark.conf.set(k, v)   # all runtime settings: a refused one would change results, so it raises
    # Python workers import this package from the driver's folder unless the
    # cluster has it installed (then the extra path entry is harmless).
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (env.get("PYTHONPATH", ""), _ROOT) if p)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make ``DataFrame.checkpoint()`` usable.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that is
    used as is. Only when it is unset and the master is local (tests, a
    laptop) is a fresh private folder created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="tm-ckpt-", dir=os.environ.get("TM_SCRATCH", "/tmp"))
    sc.setCheckpointDir(path)
    spark.conf.set("spark.checkpoint.dir", path)
    return path

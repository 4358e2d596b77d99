"""Session construction and the reliable checkpoint folder."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.util import inheritable_thread_target


def build_session(master: str | None = None, app: str = "shipgraph",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """A session tuned for the library: AQE on, UI off, UTC clock.

    ``master`` defaults to ``local[*]`` only when no master is configured
    (spark-submit on a cluster passes its own).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    elif not os.environ.get("SPARK_MASTER") and "spark.master" not in (extra or {}):
        b = b.master("local[*]")
    conf = {
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.scheduler.mode": "FAIR",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, configuring it if needed.

    The cluster names its shared folder in ``spark.checkpoint.dir``; we read
    that setting.  Only a local-mode session with nothing configured (tests,
    the bench) gets a fresh scratch folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="shipgraph-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, unless their Python path has it anyway."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc = spark.sparkContext
    if (os.path.realpath(os.getcwd()) == os.path.realpath(root)
            or root in os.environ.get("PYTHONPATH", "").split(os.pathsep)
            or getattr(sc, "_package_sent", False)):
        return
    folder = tempfile.mkdtemp(prefix="package-")  # read by the driver alone, which serves it
    sc.addPyFile(shutil.make_archive(f"{folder}/package", "zip", root,
                                     os.path.basename(os.path.dirname(os.path.abspath(__file__)))))
    sc._package_sent = True


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss) into the shared folder;
    computed once, as it is cached until written."""
    checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out


def concurrently(spark: SparkSession, jobs: list[Callable], workers: int = 8) -> list:
    """The jobs' results in order, their Spark jobs running side by side (each
    thread has the session's properties, and a pool of its own under FAIR)."""
    def alone(n_job):
        n, job = n_job
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"side-{n % workers}")
        return job()

    with ThreadPoolExecutor(max_workers=max(1, min(workers, len(jobs)))) as pool:
        return list(pool.map(inheritable_thread_target(spark)(alone), enumerate(jobs)))

"""SparkSession helpers."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


#: Checkpoint folders of local applications without the setting.
_OWN: dict[str, str] = {}


def get_session(master: str | None = None, partitions: int | None = None,
                app_name: str = "marketflow") -> SparkSession:
    """Local/test session: UTC, ANSI, AQE with skew handling, no UI.

    On a cluster the session already exists and ``getOrCreate`` returns it
    untouched; only unset settings are filled here.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.pythonUDF.arrow.enabled", "true")
        # Wide feature projections compile to methods above HotSpot's 8000-byte
        # JIT limit; without this flag they run interpreted (several times slower).
        .config("spark.driver.extraJavaOptions", "-XX:-DontCompileHugeMethods")
        .config("spark.executor.extraJavaOptions", "-XX:-DontCompileHugeMethods")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local master may go without it: driver and executors are one process there, so a
    temporary folder is shared.  Anywhere else an unset folder is an error, not a local path.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        # The setting is fixed once a session runs, so the folder is kept by application.
        current = _OWN.get(sc.applicationId) or _OWN.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="marketflow-ckpt-"))
    sc.setCheckpointDir(current)
    return current


#: HotSpot compiles no method of more bytecode than this.
COMPILED_BYTES = 8000


#: Off, a join on (a, b) uses rows that are partitioned by a alone.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
_OFF = "marketflow.placed"     # says in a session that ``prepare`` has turned it off
#: On, a finished SQL execution leaves no shuffle files behind (Spark 4.1; unknown to earlier ones, which ignore it).
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Jobs that run in here, each once and for what it writes or collects, leave no shuffle files to the driver's garbage collection."""
    had = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        if had is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, had)


def prepare(spark: SparkSession, wide: bool = False, placed: bool = False) -> None:
    """What every query asks of the session: the checkpoint folder and, for ``wide`` projections, code that is compiled.

    ``placed`` rows are joined on their place and a value without being moved; other queries get the setting back, if it was
    turned off here.

    Spark's limit on a generated method is 64 kB unless set, HotSpot's is 8 kB without a JVM flag, so wide stages stay
    interpreted.  Beyond a limit of 8 kB they run operator by operator, whose code Spark cuts into small methods.
    Other queries get the limit back that the session had; one that the cluster has set stays.
    """
    ensure_checkpoint_dir(spark)
    if placed and spark.conf.get(ALL_KEYS, "true") == "true":
        spark.conf.set(ALL_KEYS, "false")
        spark.conf.set(_OFF, "true")
    elif not placed and spark.conf.get(_OFF, "false") == "true":
        spark.conf.set(ALL_KEYS, "true")
        spark.conf.set(_OFF, "false")
    name, had = "spark.sql.codegen.hugeMethodLimit", "65535"
    options = " ".join(spark.sparkContext.getConf().get(f"spark.{who}.extraJavaOptions", "") for who in ("driver", "executor"))
    if "-XX:-DontCompileHugeMethods" not in options and spark.conf.get(name) in (had, str(COMPILED_BYTES)):
        spark.conf.set(name, str(COMPILED_BYTES) if wide else had)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"

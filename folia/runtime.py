"""What every operator needs from the session: tables, blank tests, checkpoints, sizes."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of any kind: what Unicode calls separators, and the control characters Python's str.isspace() knows.
BLANK_RE = r"^[\s\p{Z}\x{85}\x{1c}-\x{1f}\x{feff}\x{200b}]*$"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_blank(c: Column) -> Column:
    """True for null, empty, or white space of any kind (no-break spaces too)."""
    return c.isNull() | c.rlike(BLANK_RE)


def not_blank(c: Column) -> Column:
    return c.isNotNull() & ~c.rlike(BLANK_RE)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``.

    Where it is unset: in a local session a folder of this application below Java's temporary folder; on a cluster one below the session's warehouse, if that is no local path. Otherwise there
    is no folder that all executors reach, which is an error. Checkpoints are removed with ``spark.cleaner.referenceTracking.cleanCheckpoints``, a folder of our own when the session ends.
    """
    sc = spark.sparkContext
    if sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().isDefined():
        return
    fs = sc._jvm.org.apache.hadoop.fs
    if sc.master.split("[")[0] == "local":
        base = fs.Path("file:" + sc._jvm.java.lang.System.getProperty("java.io.tmpdir"))
    else:
        base = fs.Path(spark.conf.get("spark.sql.warehouse.dir"))
        scheme = base.toUri().getScheme() or fs.FileSystem.get(sc._jsc.hadoopConfiguration()).getUri().getScheme()
        if scheme == "file":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share: the session runs on a cluster and its warehouse is a local path")
    own = fs.Path(base, f"folia-checkpoints/{sc.applicationId}")
    sc.setCheckpointDir(own.toString())
    own.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(own)


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared checkpoint folder, removed when the session ends."""
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    name = f"{sc._jsc.sc().getCheckpointDir().get()}/scratch-{uuid.uuid4().hex}"
    path = sc._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return name


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: survives lost executors, is computed once."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, limit_rows: int) -> tuple[DataFrame, bool]:
    """A broadcast hint if ``df`` has at most ``limit_rows`` rows (counted with a limit, so never more than that is read); else ``df`` as it is, for a shuffled join."""
    small = df.limit(limit_rows + 1).count() <= limit_rows
    return (F.broadcast(df) if small else df), small


_BUILT: dict[str, object] = {}


def per_worker(name: str, build: Callable[[], object]) -> object:
    """What ``build`` makes, once per Python worker and ``name``: workers outlive tasks, so models are set up and caches filled once. A few of the last are kept."""
    if name not in _BUILT:
        while len(_BUILT) >= 4:
            _BUILT.pop(next(iter(_BUILT)))
        _BUILT[name] = build()
    return _BUILT[name]


def spread(df: DataFrame) -> DataFrame:
    """Spread a *scan* of a few small files over all cores before work that is heavy on CPU.

    A table of many files has enough tasks already and comes back as it is, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= max(2, cores // 2) else df.repartition(cores)

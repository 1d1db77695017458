"""Session helpers: reading tables, spreading small inputs, and cutting lineage in the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

MAIN = "main"
#: Bytes of a table for each core from which on it is left as it comes.
SMALL = 4 << 20
_scope: ContextVar[str] = ContextVar("scope", default=MAIN)
_written: dict[str, list[tuple[SparkSession, str]]] = {}


def session(app: str = "corpusweave", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine expects; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "16")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Repartition a table that is one or a few small files: these are fewer splits than there are cores.

    Looks at the scan's files only, nothing is run. What has a file for each core, or SMALL bytes for each, passes unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= cores * SMALL:
        return df
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where it is unset (tests on one machine) a folder of our own."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="corpusweave-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Tables written inside are removed at its end, and no others: for a query whose results are stored there."""
    token = _scope.set(uuid.uuid4().hex)
    try:
        yield
    finally:
        name = _scope.get()
        _scope.reset(token)
        clear(name)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone; the folder is the cluster's to clean then
        pass


def clear(name: str | None = None) -> None:
    """Remove the tables written in a scope; without a name, those written outside any."""
    for spark, path in _written.pop(name or MAIN, []):
        _remove(spark, path)


@atexit.register
def _clear_all() -> None:
    for name in list(_written):
        clear(name)


def scratch(spark: SparkSession, what: str, ending: str = "") -> str:
    """A place in the shared folder for other than tables, removed as they are."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}{ending}"
    _written.setdefault(_scope.get(), []).append((spark, path))
    return path


def written(df: DataFrame, what: str = "table") -> DataFrame:
    """Cut lineage: write df as Parquet to the shared folder and read it back.

    Unlike a local checkpoint the files outlive any executor. They are removed when their scope or the driver ends, or by free().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.setdefault(_scope.get(), []).append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._corpusweave_path = path
    return out


def free(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more: all that was built on them is written itself."""
    for df in tables:
        if path := getattr(df, "_corpusweave_path", None):
            for entries in _written.values():
                entries[:] = [x for x in entries if x[1] != path]
            _remove(df.sparkSession, path)

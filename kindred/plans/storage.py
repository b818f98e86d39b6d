"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import os
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}
_SCOPES = threading.local()


def shared_root(spark: SparkSession) -> str:
    """A folder under spark.checkpoint.dir.

    Only a session in one process (master local or local[n]) may leave that unset and gets a temporary folder; on a cluster
    the executors would each write to a disk of their own, so there it is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not root:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="kindred-")
        _ROOTS[app] = f"{root.rstrip('/')}/kindred-{app}"
    return _ROOTS[app]


#: Rows of a narrow table (200 bytes each, say) that a task writes at least, where their number is known.
ROWS = 1 << 15


def sized(df: DataFrame, rows: int | None) -> DataFrame:
    """df, to be materialized, in no more tasks than `rows` need: a task for ROWS of them, but two for each core at least.

    Every task writes a file, and a file in a local folder costs several launches of a process, so a small table is not to be
    hundreds of files. `rows` is a bound (wide rows count several times), or None if none is known.
    """
    return df if rows is None else df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS)))


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs no more than the tasks that it ran, and
    values that depend on the order of rows (generated ids) are fixed once and for all.
    """
    path = f"{shared_root(df.sparkSession)}/{tag}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.shared_path = path
    if scopes := getattr(_SCOPES, "open", None):
        scopes[-1].append(out)
    return out


@contextlib.contextmanager
def scratch():
    """Delete the tables that materialize() makes inside when the block ends, but for those handed to what this yields."""
    scopes = _SCOPES.open = getattr(_SCOPES, "open", [])
    own: list[DataFrame] = []
    kept: list[DataFrame] = []
    scopes.append(own)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        scopes.pop()
        for df in own:
            if any(df is k for k in kept):
                if scopes:
                    scopes[-1].append(df)
            else:
                discard(df)


def discard(df: DataFrame) -> None:
    """Delete a table made by materialize() that nothing reads any more."""
    path = getattr(df, "shared_path", None)
    if path:
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (a cluster installs it or gets --py-files)."""
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if here not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (here, known) if x)


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, and keep their batches small.

    Batches of long texts are held several times over, in the JVM and in Python: this session's Arrow batches have 2,000
    rows from now on, where the setting has Spark's default; a setting of the user's own stays.
    """
    importable(spark)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, "2000")

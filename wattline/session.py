"""Session helpers: one place for the runtime configuration."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "wattline", extra: dict | None = None) -> SparkSession:
    """Session for local runs (tests, bench).  On a cluster the platform's
    session is used as-is; only AQE and skew handling are asked for."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.shuffle.partitions", str(parts))
         .config("spark.driver.memory", "16g")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    A private temporary folder is only created when the setting is unset and
    the master is local (tests); on a cluster an unset setting is an error,
    because a machine-local folder would not survive the loss of an executor.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if d:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(d)
        return d
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    d = tempfile.mkdtemp(prefix="wattline-ckpt-")
    spark.sparkContext.setCheckpointDir(d)
    return d


def _storage(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there; storage errors are not hidden."""
    fs, p = _storage(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _storage(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below a path; none if it is not there."""
    fs, p = _storage(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []


def file_versions(spark: SparkSession, path: str) -> tuple:
    """(name, size, time) of a file, or of the files of a folder."""
    fs, p = _storage(spark, path)
    st = fs.getFileStatus(p)
    files = fs.listStatus(p) if st.isDirectory() else [st]
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in files))


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = _storage(spark, path)
    fs.delete(p, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def spread(df, *keys: str):
    """Rows dealt over all cores before work that is dear for each of them: a
    file's row groups may be few, and a task reads at least one of them whole."""
    spark = df.sparkSession
    return df.repartition(max(shuffle_partitions(spark), spark.sparkContext.defaultParallelism), *keys)


def saved_table(df, name: str):
    """A wide table that many plans read in parts: written once as Parquet in
    the shared checkpoint folder, so each plan reads its own columns only."""
    import uuid
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def materialize(df):
    """Cut lineage of a DataFrame that a plan reads several times: a reliable
    checkpoint into the shared checkpoint folder (survives executor loss;
    never a local checkpoint)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

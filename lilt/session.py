"""Session helpers and staged tables.

Long compositions of scans re-read their input once per scan level, so shared intermediate tables are written
to the shared folder that the cluster names in ``spark.checkpoint.dir`` and read back. A written table also
survives the loss of executors.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: A table's shuffle files go as soon as it is written; otherwise they lie on disk until the driver collects garbage.
TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

_STAGED: dict[tuple[str, str, str], str] = {}
_OWN_DIR: dict[str, str] = {}


def build_session(app: str = "lilt", cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench; on a cluster pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings for what is planned inside; the session's own come back afterwards."""
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and staged tables, as the cluster names it.

    Only a local master may fall back to a temporary folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = spark.sparkContext.applicationId
    if own not in _OWN_DIR:
        _OWN_DIR[own] = tempfile.mkdtemp(prefix="lilt-")
    return _OWN_DIR[own]


def staged(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Write ``build()`` once per application and source, then serve it as a parquet scan."""
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _STAGED:
        slot = len(_STAGED)
        path = f"{shared_dir(spark)}/lilt-{key[0]}/{slot:03d}-{name}"
        built = build()
        with settings(spark, TIDY):
            built.write.mode("overwrite").parquet(path)
        _STAGED[key] = path
    return spark.read.parquet(_STAGED[key])


def staged_path(spark: SparkSession, name: str, source: str) -> str:
    return _STAGED[(spark.sparkContext.applicationId, source, name)]


def cut(df: DataFrame, name: str, compression: str = "snappy", tidy: bool = False) -> DataFrame:
    """Write an intermediate result that several branches of a plan read, and continue from the written table.

    With ``tidy`` the shuffle files behind it are deleted at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lilt-{spark.sparkContext.applicationId}/cut-{name}-{uuid.uuid4().hex[:12]}"
    with settings(spark, TIDY if tidy else {}):
        df.write.parquet(path, compression=compression)
    written = spark.read.schema(df.schema).parquet(path)
    written._written = path
    return written


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``cut`` that nothing reads any more; results still to come from them must not be lazy."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._written)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete the tables this application has written to the shared folder; results read from them end here."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{shared_dir(spark)}/lilt-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    for key in [k for k in _STAGED if k[0] == spark.sparkContext.applicationId]:
        del _STAGED[key]

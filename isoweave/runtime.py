"""Session helpers shared by the operators: shared storage, broadcast guards, table access."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a side may be broadcast after it has been measured.
BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 32 << 20


def get_spark(app: str = "isoweave", cores: str = "*", **conf: str) -> SparkSession:
    """A session with adaptive execution; settings given by keyword win (dots written as ``__``)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**base, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local one only where none is set (tests, local mode)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_dir:
        _own_dir.append(os.path.join(tempfile.mkdtemp(prefix="isoweave-")))
    return _own_dir[0]


_tidied: set[str] = set()


def _tidy(spark: SparkSession) -> None:
    """Remove this application's written tables when the driver's Python ends."""
    home = f"{shared_dir(spark)}/isoweave/{spark.sparkContext.applicationId}"
    if home in _tidied:
        return
    _tidied.add(home)

    def remove() -> None:
        local = home.removeprefix("file://").removeprefix("file:")
        if local.startswith("/"):
            shutil.rmtree(local, ignore_errors=True)
            return
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(home)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session has ended; the folder's owner clears it
            pass

    atexit.register(remove)


def own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one, removed when the driver's Python ends."""
    _tidy(spark)
    return f"{shared_dir(spark)}/isoweave/{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and read it back.

    Cuts the lineage, so nothing upstream runs twice, and survives the loss of
    executors: the files belong to no executor. Row groups hold at most ``group_rows``
    rows; readers take up to 4,096 rows of a row group at once, too much where rows are large.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    out = df.write.option("compression", "zstd")
    (out.option("parquet.block.row.count.limit", str(group_rows)) if group_rows else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows of BROADCAST_BYTES in all as JSON; reads no more than that many rows and one."""
    text = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    n, size = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(text), F.lit(0))).first()
    return n <= rows and size <= BROADCAST_BYTES


def guarded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if ``df`` is proven small in rows and bytes; else ``df`` itself, so that the join shuffles."""
    return F.broadcast(df) if small_enough(df, rows) else df


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

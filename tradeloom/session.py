"""Session settings, table access and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import Folder

#: White space as Unicode defines it, plus zero-width marks that editors leave at the ends of values.
SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200d}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session with the settings the engine expects: UTC, AQE, Arrow."""
    return (
        SparkSession.builder.master(master)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables; pruning and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` of the session. Only a local master may
    go without the setting; it then gets a temporary folder that goes with the process."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if where:
        if not current.isDefined():
            sc.setCheckpointDir(where)
        return where
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    where = tempfile.mkdtemp(prefix="tradeloom-")
    atexit.register(shutil.rmtree, where, True)
    sc.setCheckpointDir(where)
    return where


_made: dict[str, SparkSession] = {}
_named: dict[str, SparkSession] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses. Results may still read it after a query returns, so it lasts until
    clear_scratch() or the end of the process."""
    path = os.path.join(shared_dir(spark), "tradeloom", f"{name}-{uuid.uuid4().hex}")
    _made[path] = spark
    return path


def scratch_table(spark: SparkSession) -> str:
    """A name for a table of the catalogue that goes with the scratch tables."""
    name = f"tradeloom_{uuid.uuid4().hex}"
    _named[name] = spark
    return name


def clear_scratch() -> None:
    """Delete all scratch tables this process has made; frames that read them can't be used any more."""
    while _named:
        name, spark = _named.popitem()
        if spark.sparkContext._jsc is not None:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    while _made:
        path, spark = _made.popitem()
        if spark.sparkContext._jsc is not None:
            Folder(spark, path).delete()


@atexit.register
def _clear_at_exit() -> None:
    try:
        clear_scratch()
    except Exception:  # noqa: BLE001
        pass  # the JVM has gone first; its shared folder is the cluster's to clean


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage, survives the loss of executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What is broadcast may hold so many bytes, by the lengths of its values.
BROADCAST_BYTES = 64 << 20


def broadcast_up_to(df: DataFrame, max_rows: int, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it holds at most max_rows rows and max_bytes bytes, otherwise as it is (shuffled join, which
    AQE splits where keys are skewed). Both are measured, on at most max_rows + 1 rows. df should be a stored table or a plain scan."""
    width = F.lit(0).cast("long")
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType | T.BinaryType):
            size = F.octet_length(c)
        else:
            size = F.octet_length(F.to_json(F.struct(c))) if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType) else F.lit(8)
        width = width + F.coalesce(size, F.lit(0)) + 16
    rows, size = df.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df


def trimmed(c: Column) -> Column:
    """c without white space, of any Unicode kind, at its ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def or_null(c: Column) -> Column:
    """c, or null where it is blank."""
    return F.when(F.length(c) > 0, c)



_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, once for each application; they may not have its folder on their path."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tradeloom-package-")
    atexit.register(shutil.rmtree, folder, True)
    archive = shutil.make_archive(os.path.join(folder, "tradeloom"), "zip", os.path.dirname(root), os.path.basename(root))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)

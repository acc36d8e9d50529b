"""Where intermediate tables live, and how a join side earns a broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 * 1024 * 1024

_local_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a cluster a
    machine-local folder would be lost with its machine, so the setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        app = spark.sparkContext.applicationId
        root = _local_roots.setdefault(app, tempfile.mkdtemp(prefix="corpusmill-"))
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, jvm_path = _hadoop(spark, path)
    return fs.exists(jvm_path)


def put_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    fs, jvm_path = _hadoop(spark, path)
    out = fs.create(jvm_path)
    out.write(bytearray(data))
    out.close()


def put_text(spark: SparkSession, folder: str, name: str, text: str) -> None:
    """Write a small file that is not there yet, so that readers see all of it or none."""
    fs, final = _hadoop(spark, f"{folder}/{name}")
    draft_name = f"{folder}/_{uuid.uuid4().hex}-{name}"
    put_bytes(spark, draft_name, text.encode())
    _, draft = _hadoop(spark, draft_name)
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise OSError(f"{folder}/{name} was written by somebody else, or cannot be written")


def newest_text(spark: SparkSession, folder: str) -> tuple[str, str]:
    """Name and text of the last small file of a folder, by name; empty if there is none."""
    fs, path = _hadoop(spark, folder)
    if not fs.exists(path):
        return "", ""
    names = [f.getPath().getName() for f in fs.listStatus(path)]
    last = max((n for n in names if not n.startswith(("_", "."))), default="")
    if not last:
        return "", ""
    opened = spark._jvm.java.util.Scanner(fs.open(_hadoop(spark, f"{folder}/{last}")[1]), "UTF-8")
    text = opened.useDelimiter("\\A").next()
    opened.close()
    return last, text


def write_observed(df: DataFrame, path: str, counters: dict[str, Column],
                   mode: str = "error") -> dict:
    """Write, and return the ``counters``, aggregates that Spark takes on the way."""
    watch = Observation()
    df.observe(watch, *[value.alias(name) for name, value in counters.items()]).write.mode(
        mode).parquet(path)
    return watch.get


def materialise(df: DataFrame, label: str, counters: dict[str, Column] | None = None,
                measured: bool = False) -> DataFrame:
    """Write once, read back: cuts lineage, survives executor loss, and keeps later
    passes from re-running paid model calls. Parquet, so a pass over keys reads only keys.

    ``counters`` are aggregates that Spark takes while it writes; ``observed`` tells them. With
    ``measured`` the rows and bytes are taken too, so that a broadcast is decided without a scan.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    wanted = dict(counters or {})
    if measured:
        wanted |= {"rows": F.count(F.lit(1)), "bytes": F.sum(_width(df))}
    if not wanted:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    counted = write_observed(df, path, wanted)
    return with_counts(spark.read.schema(df.schema).parquet(path), counted)


def with_counts(df: DataFrame, counted: dict) -> DataFrame:
    df.__dict__["_observed"] = counted
    return df


def observed(df: DataFrame) -> dict:
    """What was counted while this table was written; empty for a frame derived from it."""
    return df.__dict__.get("_observed", {})


def _width(df: DataFrame) -> Column:
    """Bytes of a row, about; strings and binary values by their own length."""
    width = F.lit(0).cast("long")
    for field in df.schema:
        value, kind = F.col(f"`{field.name}`"), field.dataType.typeName()
        if kind in ("array", "map", "struct"):
            value, kind = value.cast("string"), "string"
        size = F.coalesce(F.octet_length(value), F.lit(0)) if kind in ("string", "binary") \
            else F.lit(8)
        width = width + size + F.lit(16)
    return width


def measured_bytes(df: DataFrame) -> int:
    """Size of the rows: known for a table written ``measured``, else by one narrow aggregation;
    ``df`` should be a written table."""
    if "bytes" in observed(df):
        return observed(df)["bytes"] or 0
    return df.agg(F.sum(_width(df)).alias("b")).first()["b"] or 0


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES,
                       part_of: DataFrame | None = None) -> DataFrame:
    """Mark ``df`` for broadcast only when its measured size is under ``max_bytes``;
    beyond the bound the join is left to Spark (shuffle join, AQE skew splitting). A ``part_of``
    a measured table is no larger than that, which spares a scan."""
    size = measured_bytes(df if part_of is None else part_of)
    return F.broadcast(df) if size <= max_bytes else df

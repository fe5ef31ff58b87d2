"""Readers and writers with fixed schemas."""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapsekit import spec as S

DOMAIN_SCHEMAS = {
    "labels": S.LABELS_SCHEMA,
    "members": S.MEMBERS_SCHEMA,
    "transactions": S.TRANSACTIONS_SCHEMA,
    "user_logs": S.USER_LOGS_SCHEMA,
    "ledger": S.LEDGER_SCHEMA,
}


def read_table(spark: SparkSession, name: str, path: str, fmt: str | None = None,
               columns: list[str] | None = None) -> DataFrame:
    """Read a domain table with its fixed schema (no inference).

    CSV gets the schema applied at parse time; Parquet is read natively and
    cast to the schema.  ``columns`` prunes early so Catalyst pushes the
    projection into the scan (S4).
    """
    schema = DOMAIN_SCHEMAS[name]
    fmt = fmt or ("csv" if path.endswith(".csv") else "parquet")
    if fmt == "csv":
        df = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    else:
        df = spark.read.parquet(path)
        missing = [f.name for f in schema.fields if f.name not in df.columns]
        if missing:
            raise ValueError(f"{path} lacks columns of {name}: {missing}")
        df = df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    if columns:
        df = df.select(*columns)
    return df


def write_stage(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Overwrite a stage/report table as Parquet."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast to a serving schema, in its column order (missing columns become NULL)."""
    cols = []
    for f in schema.fields:
        src = F.col(f.name) if f.name in df.columns else F.lit(None)
        cols.append(src.cast(f.dataType).alias(f.name))
    return df.select(cols)


def publish(tables: dict[str, DataFrame], root: str, schemas: dict[str, T.StructType] | None = None) -> str:
    """Full-refresh publish of serving tables.

    All tables are written under ``root/v=<version>/<name>``; only after every
    write succeeded the pointer file ``root/CURRENT`` is replaced (write to a
    temp name + atomic rename).  Readers resolve the pointer, so they never
    see a half-written set.  The ledger is not part of ``tables`` and is never
    touched.  Single-writer assumption: one publisher per root at a time.
    """
    version = dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%S") + "-" + uuid.uuid4().hex[:8]
    base = f"{root.rstrip('/')}/v={version}"
    for name, df in tables.items():
        if schemas and name in schemas:
            df = conform(df, schemas[name])
        df.write.mode("errorifexists").parquet(f"{base}/{name}")
        spark = df.sparkSession
    if tables:
        write_text(spark, f"{root.rstrip('/')}/CURRENT", version)
    return version


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file of any Hadoop file system: written beside it, then renamed over it."""
    conf = spark._jsc.hadoopConfiguration()
    target, tmp = _path(spark, path), _path(spark, f"{path}.{uuid.uuid4().hex}")
    fs = target.getFileSystem(conf)
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    files.rename(fs.makeQualified(tmp), fs.makeQualified(target), options)


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def read_published(spark: SparkSession, root: str, name: str) -> DataFrame:
    version = read_text(spark, f"{root.rstrip('/')}/CURRENT").strip()
    return spark.read.parquet(f"{root.rstrip('/')}/v={version}/{name}")


# --------------------------------------------------------------------- J1: bucketed tables
def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` hashed by ``key`` into ``buckets`` files, sorted by it, and return it as a bucketed table.

    Joins and aggregations on ``key`` over tables of one bucket count need no exchange, and those joins no sort. The one shuffle is
    paid when the table is written. Bucketing suits keys of which none holds more than a bucket; a customer's rows are few.
    """
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(_table_name(path))
    return df.sparkSession.table(_table_name(path))


def read_bucketed(spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int) -> DataFrame:
    """A folder of ``write_bucketed`` in a session that doesn't know it yet."""
    name = _table_name(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS "
                  f"LOCATION '{path}'")
    return spark.table(name)


def _table_name(path: str) -> str:
    return "bucketed_" + hashlib.md5(path.rstrip("/").encode()).hexdigest()

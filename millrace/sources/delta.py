"""Tables with a JSON transaction log: the active files of the latest version."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sql.text import NotSupported

ADD = "struct<path:string,partitionValues:map<string,string>,size:bigint,deletionVector:struct<storageType:string>>"
LOG = f"add {ADD}, remove struct<path:string>, metaData struct<schemaString:string,partitionColumns:array<string>,configuration:map<string,string>>"


def read(spark: SparkSession, location: str) -> DataFrame:
    """The rows of the files that were added and not removed since, with the partition values of their entries."""
    log = f"{location}/_delta_log"
    version = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)", 1).cast("long")
    fields = T.StructType.fromDDL(LOG)
    actions = spark.read.schema(fields).option("pathGlobFilter", "*.json").json(log).select("*", version.alias("v"))
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(log)
    names = [f.getPath().getName() for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]
    points = sorted({int(n.split(".")[0]) for n in names if ".checkpoint." in n and n.endswith(".parquet")})
    if points:
        last = points[-1]
        base = spark.read.parquet(*[f"{log}/{n}" for n in names if n.startswith(f"{last:020d}.checkpoint")]).select(*[F.col(f.name).cast(f.dataType) if f.name != "remove" else F.struct(F.col("remove.path").alias("path")).alias("remove") for f in fields], F.lit(last).cast("long").alias("v"))
        actions = base.unionByName(actions.where(F.col("v") > last))
    meta = actions.where("metaData is not null").orderBy(F.desc("v")).select("metaData").first()["metaData"]
    files = actions.select("v", F.coalesce("add.path", "remove.path").alias("path"), F.col("add").alias("add")).where("path is not null")
    live = files.groupBy("path").agg(F.max_by("add", F.struct("v", F.col("add").isNotNull())).alias("add")).where("add is not null")
    if (meta["configuration"] or {}).get("delta.columnMapping.mode", "none") != "none":
        raise NotSupported("column mapping of transaction-log tables")
    if not live.where("add.deletionVector is not null").isEmpty():
        raise NotSupported("deletion vectors of transaction-log tables")
    schema, keys = T.StructType.fromJson(json.loads(meta["schemaString"])), list(meta["partitionColumns"] or [])
    own = T.StructType([f for f in schema if f.name not in keys])
    if not keys:
        paths = [f"{location}/{r['path']}" for r in live.select("path").collect()]
        return spark.read.schema(own).parquet(*paths) if paths else spark.createDataFrame([], schema)
    listed = live.select("path", *[F.col("add.partitionValues")[k].cast(schema[k].dataType).alias(k) for k in keys])
    paths = [f"{location}/{r['path']}" for r in live.select("path").collect()]
    if not paths:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(own).parquet(*paths).select("*", F.col("_metadata.file_name").alias("__file"))
    listed = listed.select(F.regexp_extract("path", "([^/]+)$", 1).alias("__file"), *keys)
    return rows.join(F.broadcast(listed) if len(paths) < 100_000 else listed, "__file").select(*schema.names)

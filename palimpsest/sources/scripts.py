"""Sources and sinks of change histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: NNN_name.sql: digits give the order.
FILE = r"([^/]*?([0-9]+)_[^/]*\.sql)$"

SNAPSHOT = T.StructType(
    [
        T.StructField("contract_version", T.StringType()),
        T.StructField("postgresql_version", T.StringType()),
        T.StructField("signature", T.ArrayType(T.StringType())),
    ]
)


def _shaped(files: DataFrame) -> DataFrame:
    path = F.col("path")
    return files.select(
        F.regexp_extract(path, FILE, 2).try_cast("long").alias("seq"),
        F.regexp_extract(path, FILE, 1).alias("filename"),
        F.col("value").alias("content"),
        F.octet_length("value").cast("long").alias("size"),
    ).where("seq is not null and filename != ''")


def read_scripts(spark: SparkSession, folder: str) -> DataFrame:
    """seq, filename, content, size of the NNN_name.sql files of a folder. Each file is a row; an empty file has none."""
    files = spark.read.option("pathGlobFilter", "*.sql").text(folder, wholetext=True)
    return _shaped(files.withColumn("path", F.col("_metadata.file_path")))


def skipped_scripts(scripts: DataFrame, most_bytes: int) -> DataFrame:
    """seq, filename, size of the scripts over a limit: a caller that passes them over can say so."""
    return scripts.where(F.col("size") > most_bytes).select("seq", "filename", "size")


def stream_scripts(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """The same as a stream of new files; seq comes from the name, never from arrival."""
    reader = spark.readStream.option("pathGlobFilter", "*.sql").option("maxFilesPerTrigger", per_trigger)
    files = reader.text(folder, wholetext=True)
    return _shaped(files.withColumn("path", F.col("_metadata.file_path")))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """contract_version, postgresql_version, line of a catalog snapshot in JSON."""
    rows = spark.read.schema(SNAPSHOT).json(path, multiLine=True)
    return rows.select("contract_version", "postgresql_version", F.explode_outer("signature").alias("line"))


def write_snapshot(lines: DataFrame, path: str, contract: str, version: str) -> None:
    """One JSON document of a catalog's lines, in order (a catalog fits one row; a data table has no place here)."""
    lines.agg(F.array_sort(F.collect_list("line")).alias("signature")).select(
        F.lit(contract).alias("contract_version"), F.lit(version).alias("postgresql_version"), "signature"
    ).coalesce(1).write.mode("errorifexists").json(path)


def event_log(events: DataFrame) -> DataFrame:
    """A change log (key, seq, idx, op, attr, value, props) of the events table: users are objects, signup makes them,
    views and clicks alter an attribute, purchases are data, errors drop."""
    op = (
        F.when(F.col("event_type") == "signup", "CREATE")
        .when(F.col("event_type").isin("view", "click"), "ALTER")
        .when(F.col("event_type") == "purchase", "INSERT")
        .otherwise("DROP")
    )
    return events.select(
        F.col("user_id").alias("key"),
        F.col("ts").alias("seq"),
        F.col("event_id").alias("idx"),
        op.alias("op"),
        F.get_json_object("props", "$.k").alias("attr"),
        "value",
    )


def statement_log(analysed: DataFrame) -> DataFrame:
    """A change log of analysed statements: key is name::type, names folded; statements without a name are left out."""
    from palimpsest.functions.identifiers import name_parts

    name = F.array_join(name_parts(F.col("object_name")), ".")
    op = F.when(F.col("operation").isin("INSERT", "UPDATE", "DELETE"), "INSERT").otherwise(F.col("operation"))
    return analysed.where("object_name is not null").select(
        F.concat_ws("::", name, "object_type").alias("key"), "seq", "idx", op.alias("op"), F.lit(None).cast("string").alias("attr"), F.col("sql").alias("value")
    )

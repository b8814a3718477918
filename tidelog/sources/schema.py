"""Schemas of the operation log and of the manifest."""

from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType, TimestampType

PUT, DELETE = "put", "delete"

OPS = StructType([
    StructField("table_id", LongType()),
    StructField("key", StringType()),
    StructField("seq_no", LongType()),
    StructField("op", StringType()),
    StructField("value", BinaryType()),
])

RUNS = StructType([
    StructField("run_id", StringType()),
    StructField("tier", StringType()),
    StructField("table_id", LongType()),
    StructField("seq_no", LongType()),
    StructField("level", LongType()),
    StructField("min_key", StringType()),
    StructField("max_key", StringType()),
    StructField("size_bytes", LongType()),
    StructField("put_count", LongType()),
    StructField("delete_count", LongType()),
])

CHANGELOG = StructType([
    StructField("id", LongType()),
    StructField("kind", StringType()),
    StructField("runs_added", ArrayType(StringType())),
    StructField("runs_removed", ArrayType(StringType())),
    StructField("table_id", LongType()),
])

TABLES = StructType([StructField("table_id", LongType()), StructField("table_name", StringType()), StructField("deleted_at", TimestampType())])

JOBS = StructType([
    StructField("job_id", LongType()),
    StructField("job_type", StringType()),
    StructField("table_id", LongType()),
    StructField("level", LongType()),
    StructField("status", StringType()),
    StructField("output_seq", LongType()),
])

#: Fixed sizes of the run format: a version byte for each run; a marker and lengths for each operation.
RUN_OVERHEAD, PUT_OVERHEAD, DELETE_OVERHEAD = 1, 9, 5

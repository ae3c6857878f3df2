"""Reading and writing record collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def read_json_collection(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(records, rejected) of a folder with one JSON record per file. The file's name comes along as `_ord`, the order in
    which "first wins" rules take records; a record's own `__file` overrides its file name. A file that doesn't parse is
    rejected and doesn't stop the load; a missing folder is an empty collection."""
    wide = T.StructType([*schema.fields, T.StructField("__file", T.StringType()), T.StructField(CORRUPT, T.StringType())])
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        empty = spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("_ord", T.StringType())]))
        return empty, spark.createDataFrame([], f"_ord string, {CORRUPT} string")
    rows = spark.read.schema(wide).option("multiLine", True).option("pathGlobFilter", "*.json").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    rows = rows.withColumn("_ord", F.coalesce("__file", F.col("_metadata.file_name")))
    good = rows.filter(F.col(CORRUPT).isNull()).select(*schema.fieldNames(), "_ord")
    return good, rows.filter(F.col(CORRUPT).isNotNull()).select("_ord", CORRUPT)


def strip_meta(rows: DataFrame) -> DataFrame:
    """Without the columns that the load added."""
    return rows.drop("_ord", "__file", CORRUPT)


def write_valid(rows: DataFrame, checks: dict[str, object], columns: list[str], path: str, quarantine: str) -> None:
    """Rows that pass every check are written, cut down to the declared columns; the others go to quarantine with the
    checks they fail."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())))
    judged = rows.withColumn("failed_checks", failed)
    judged.filter(F.size("failed_checks") == 0).select(*columns).write.mode("append").parquet(path)
    judged.filter(F.size("failed_checks") > 0).write.mode("append").parquet(quarantine)


def describe_schema(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """(field, type, required, note) of a schema, nested fields by dotted names."""

    def walk(s: T.StructType, before: str = ""):
        for f in s.fields:
            yield before + f.name, f.dataType.simpleString(), not f.nullable, f.metadata.get("note", "")
            inner = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
            if isinstance(inner, T.StructType):
                yield from walk(inner, f"{before}{f.name}.")

    return spark.createDataFrame(list(walk(schema)), "field string, type string, required boolean, note string")

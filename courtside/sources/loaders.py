"""Readers and writers: typed loads, missing-source fallback, documents to tables, schema registry, upserts by partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``; where there is none, an empty one with the declared columns."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.schema(schema).parquet(path) if fs.exists(hadoop) else spark.createDataFrame([], schema)


def load_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def flattened(df: DataFrame, separator: str = "_") -> DataFrame:
    """Nested structs as columns named by their path; arrays and maps are left out."""

    def walk(schema: T.StructType, path: tuple[str, ...]) -> list[Column]:
        out = []
        for field in schema.fields:
            here = (*path, field.name)
            if isinstance(field.dataType, T.StructType):
                out += walk(field.dataType, here)
            elif not isinstance(field.dataType, (T.ArrayType, T.MapType)):
                out.append(F.col(".".join(f"`{p}`" for p in here)).alias(separator.join(here)))
        return out

    return df.select(*walk(df.schema, ()))


def parsed_documents(raw: DataFrame, column: str, schema: str) -> DataFrame:
    """JSON documents as a struct ``doc``, also where a document was quoted as a string once more; ``bad`` tells those that don't parse."""
    unquoted = F.get_json_object(F.concat(F.lit('{"d":'), F.col(column), F.lit("}")), "$.d")
    text = F.when(F.startswith(F.trim(F.col(column)), F.lit('"')), unquoted).otherwise(F.col(column))
    doc = F.from_json(text, schema)
    return raw.withColumn("doc", doc).withColumn("bad", F.col("doc").isNull() | F.get_json_object(text, "$").isNull())


def schema_registry(tables: dict[str, DataFrame]) -> list[tuple[str, str, str]]:
    """(dataset, column, type) of each column."""
    return [(name, f.name, f.dataType.simpleString()) for name, df in tables.items() for f in df.schema.fields]


def overwrite_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replace just those partitions that ``df`` has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)

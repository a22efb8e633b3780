"""Extension: a stream of document files kept indexed, by foreachBatch."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodeseek.functions import text as T


def hash_new_documents(batch: DataFrame, folder: str) -> None:
    """Appends documents whose content the table hasn't got."""
    spark = batch.sparkSession
    fresh = batch.withColumn("content_hash", T.content_hash(F.col("text"))).dropDuplicates(["content_hash"])
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        fresh = fresh.join(spark.read.parquet(folder).select("content_hash"), "content_hash", "left_anti")
    fresh.select("doc_id", "text", "content_hash").write.mode("append").parquet(folder)


def follow(spark: SparkSession, source: str, folder: str, checkpoint: str, schema: str = "doc_id long, text string", **trigger: Any) -> StreamingQuery:
    """Follows a folder of Parquet files; with availableNow=True up to what is there now."""
    stream = spark.readStream.schema(schema).parquet(source)
    write = stream.writeStream.foreachBatch(lambda batch, _: hash_new_documents(batch, folder)).option("checkpointLocation", checkpoint)
    return write.trigger(**(trigger or {"availableNow": True})).start()

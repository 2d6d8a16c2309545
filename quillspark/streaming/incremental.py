"""New files of a folder, catalogued as they come: each run takes what earlier ones haven't seen, then stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import extract


def new_texts(spark: SparkSession, folder: str, schema: str = "doc_path string, text string", form: str = "json", files_a_batch: int = 1000) -> DataFrame:
    """A stream of documents that files bring into a folder."""
    return spark.readStream.schema(schema).format(form).option("maxFilesPerTrigger", files_a_batch).load(folder)


def catalogue_new(stream: DataFrame, out: str, state: str):
    """Appends the fields of each new document to the table ``out``; ``state`` remembers what was read. Returns the query."""
    rows = extract(stream).withColumn("catalogued_at", F.current_timestamp())
    return rows.writeStream.format("parquet").option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start(out)

"""Reading the given tables and keeping intermediate ones."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import vayuspark
from vayuspark.session import cut_lineage, prepare, run_dir

__all__ = ["table", "written", "prepared"]


def prepared(spark: SparkSession) -> SparkSession:
    """The session, its executors supplied with this package, and shuffle files that go when the query that wrote them has ended."""
    prepare(spark)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))  # whole texts are long rows
    context = spark.sparkContext
    if not getattr(context, "_vayuspark_sent", False):
        package = os.path.dirname(os.path.abspath(vayuspark.__file__))
        if os.path.isdir(package):  # else it came as an archive and is on the executors already
            folder = os.path.realpath(tempfile.mkdtemp(prefix="vayuspark-code-"))
            context.addPyFile(shutil.make_archive(os.path.join(folder, "vayuspark"), "zip", os.path.dirname(package), os.path.basename(package)))
        context._vayuspark_sent = True
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, which outlives any executor."""
    prepared(df.sparkSession)
    return cut_lineage(df, f"llm-{name}")


def written_by(df: DataFrame, key: str, parts: int, name: str) -> DataFrame:
    """The same, in `parts` buckets of the key, so that a join by the key moves the other side only."""
    spark = prepared(df.sparkSession)
    table_name = f"llm_{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(parts, key).option("path", run_dir(spark, f"llm-{name}")).saveAsTable(table_name)
    return spark.table(table_name)


def with_text_key(docs: DataFrame) -> DataFrame:
    """doc_id and text only, with a key of the text: rows equal in both are the same to every operator here."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))

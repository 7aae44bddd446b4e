"""Structured Streaming: the batch transformations over a stream of texts, and reloading of lexicon and settings between batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import Detector
from ..config import DEFAULT, Config, ConfigManager
from ..sources import lexicon as lx

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def read_documents(spark: SparkSession, path: str, schema: str = DOCUMENTS, files_per_trigger: int = 25) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def detect_stream(texts: DataFrame, config: Config = DEFAULT, entries: DataFrame | None = None) -> DataFrame:
    """A stream of results, stateless, for append sinks."""
    return Detector(texts.sparkSession, config, entries).analyze(texts)


def write_results(stream: DataFrame, path: str, checkpoint: str):
    """Runs the stream over what is there now into Parquet files, each input row once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


# ---------------------------------------------------------------- reloading


def settings(spark: SparkSession, path: str | None) -> Config:
    """The settings of a JSON file on any file system that Spark reads; the defaults without one."""
    if path is None:
        return DEFAULT
    return ConfigManager().load(spark.read.text(path, wholetext=True).first()[0])


def batch_folder(sink: str, number: int) -> str:
    return f"{sink}/batch={number}"


def detect_reloading(texts: DataFrame, lexicon: str, sink: str, checkpoint: str, config: str | None = None, results: Callable[[DataFrame], DataFrame] | None = None):
    """Results of a stream, whose every micro-batch is analysed with the newest version of a lexicon table and the settings
    that the file holds then, so that changes take hold between batches and never within one.

    A batch's results are a folder of its number (`batch_folder`), written over: a batch that runs again after a failure
    leaves its rows once, and says in `lexicon_version` which version they come from.  A batch is a table of its own, so near words and
    lexicons of any size are matched in it as in any other.  `results` picks what is kept of a result row."""
    spark = texts.sparkSession

    def one(batch: DataFrame, number: int) -> None:
        version = lx.newest_version(spark, lexicon)
        found = Detector(spark, settings(spark, config), lx.read_version(spark, lexicon, version)).analyze(batch)
        out = found if results is None else results(found)
        out.withColumn("lexicon_version", F.lit(version)).write.mode("overwrite").parquet(batch_folder(sink, number))

    return texts.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

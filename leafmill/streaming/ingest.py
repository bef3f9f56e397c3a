"""Drop-in ingestion: files or rows that arrive are linted and measured by the same Columns as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafmill.functions import lint
from leafmill.functions.text import word_count


def arriving(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_batch: int = 1000) -> DataFrame:
    """A stream of the rows in Parquet files that appear in ``folder``."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def measured(docs: DataFrame, lang: str = "pl") -> DataFrame:
    """Stateless statistics and lint counts of each document, from its paragraph array; batch or stream."""
    paras = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    rules = lint.enabled(lang)
    hits = F.transform(paras, lambda t: F.aggregate(lint.counts(t, rules), F.lit(0), lambda a, c: a + c["n"]))
    words = F.transform(paras, word_count)
    return docs.select("doc_id", F.size(paras).alias("paragraphs"), F.aggregate(words, F.lit(0), lambda a, w: a + w).alias("words"), F.length(F.coalesce("text", F.lit(""))).alias("chars"), F.aggregate(hits, F.lit(0), lambda a, n: a + n).alias("n_hits"))


def start(results: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Handles everything that has arrived, appends to Parquet and stops; state survives in ``checkpoint``."""
    return results.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Incremental refresh as a stream: files of terms come in, unseen texts are encoded once, vectors go out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.encode import Encoder
from ..operators.index import new_terms
from ..sources.snapshot import SnapshotStore
from .batch_log import BatchLog

VECTORS = "text_hash string, vector array<float>"


def stream_new_vectors(spark: SparkSession, source: str, vectors: str, checkpoint: str, encoder: Encoder) -> int:
    """Encodes the texts of all files that came into source since the last call and appends (text_hash, vector) of the model.

    Which files were read is the stream's own state; which texts have vectors is what the finished batches of the model hold, so
    a new model encodes everything again.  A batch is named by the stream's id and its number: one that was cut off anywhere
    is written anew, one that was finished adds nothing."""
    terms = spark.readStream.schema("text_hash string, normalized string").parquet(source)
    log, state, done = BatchLog(spark, vectors, VECTORS), SnapshotStore(spark, checkpoint), []

    def batch(df: DataFrame, number: int) -> None:
        name = f"{(state.read_json('metadata') or {})['id']}-{number:09}"  # Spark writes the stream's id before its first batch
        fresh = new_terms(df.dropDuplicates(["text_hash"]), log.read(model=encoder.name).select("text_hash"))
        done.append(log.append(name, encoder.encode(fresh), model=encoder.name))

    stream = terms.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    return sum(done)


def read_vectors(spark: SparkSession, vectors: str, encoder: Encoder) -> DataFrame:
    """(text_hash, vector) of all finished batches of a model."""
    return BatchLog(spark, vectors, VECTORS).read(model=encoder.name)

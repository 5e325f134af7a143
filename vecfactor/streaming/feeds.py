"""File feeds: the service's two POST endpoints as Structured Streaming jobs.

* :func:`center_feed`  posted word lists -> checked, filtered lists -> centres,
                       and the rejected requests with their reason (R2)
* :func:`upload_feed`  rating-upload files -> validated uploads, flattened
                       ratings and rejections (R1); with a store the batch's
                       models are trained and stored, and an optional
                       ``on_accepted(batch_df, batch_id)`` hook may follow

Both are stream-static: each micro-batch is handed to the batch operators by
``foreachBatch``. Output goes to ``<out>/batch_id=<n>`` with overwrite, so a
replayed batch after a failure rewrites the same folder (idempotent sink). Files
are taken oldest first, ``max_files_per_trigger`` at a time. No watermark: every
upload or list is complete in itself. Checkpoints and outputs live in the shared
folder.

**Replays.** What a batch does to the store is committed under the key ``<feed
id>/<batch id>`` (:mod:`vecfactor.sources.store`): a batch that runs again trains
nothing, adds no version and no name. The feed id is the checkpoint folder unless
the caller names one.

**Order.** "The later request wins" is decided by the time a file arrived (its
modification time), then by ``upload_id``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecfactor.operators import centers as C
from vecfactor.plans.sizing import broadcast_limit
from vecfactor.session import drop_path, shared_path
from vecfactor.sources import payloads as P

UPLOAD_SCHEMA = "upload_id string, model_name string, payload string"
FILES_PER_TRIGGER = 1000
FILE_BYTES = 64 * 1024 * 1024


def _write_batch(df: DataFrame, out: str, batch_id: int):
    df.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")


def _start(stream: DataFrame, run, checkpoint: str, available_now: bool):
    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def _files(spark: SparkSession, most: int):
    return spark.readStream.option("maxFilesPerTrigger", most)


def center_feed(spark: SparkSession, in_path: str, vocab: DataFrame, out: str, checkpoint: str,
                available_now: bool = True, max_files_per_trigger: int = FILES_PER_TRIGGER,
                stats: tuple[int, int, int] | None = None):
    """Start the centre feed; returns the ``StreamingQuery``.

    Input: text files, one request per line: ``{"list_id": 7, "payload": "<body>"}``
    (or ``"words": [...]`` in place of an encoded body). The body must be a JSON
    array (:func:`vecfactor.sources.payloads.parse_word_requests`). Writes under one
    batch id ``<out>/centers`` (``list_id, n_words, n_known, center``) and
    ``<out>/rejected`` (``list_id, request, reason``). ``stats`` are the
    vocabulary's (:func:`vecfactor.operators.centers.vocab_stats`); they are read
    once, not per batch.
    """
    stats = stats or C.vocab_stats(vocab)
    small = stats[2] <= broadcast_limit(spark)

    def run(batch: DataFrame, batch_id: int):
        scratch = shared_path(spark, "requests")    # removed with the batch
        request = F.when(F.col("reason").isNotNull(), F.col("request"))     # only a rejected one is answered
        P.parse_word_requests(batch, "value").withColumn("request", request) \
            .write.option("compression", "zstd").parquet(f"{scratch}/parsed")   # read twice
        parsed = spark.read.parquet(f"{scratch}/parsed")
        good = parsed.where(F.col("reason").isNull()).select("list_id", "words")
        _write_batch(C.centers(good, vocab, broadcast=small, stats=stats, scratch=f"{scratch}/lists"),
                     f"{out}/centers", batch_id)
        _write_batch(parsed.where(F.col("reason").isNotNull()).select("list_id", "request", "reason"),
                     f"{out}/rejected", batch_id)
        drop_path(spark, scratch)
    return _start(_files(spark, max_files_per_trigger).text(in_path), run, checkpoint, available_now)


def upload_feed(spark: SparkSession, in_path: str, out: str, checkpoint: str,
                on_accepted: Callable[[DataFrame, int], None] | None = None,
                available_now: bool = True, store=None, feed_id: str | None = None,
                max_files_per_trigger: int = FILES_PER_TRIGGER):
    """Start the upload feed; writes ``<out>/parsed``, ``<out>/ratings``,
    ``<out>/rejected`` per batch, and with a ``store`` trains and stores the
    batch's models (see :func:`vecfactor.sources.store.train_and_store`).
    Returns the ``StreamingQuery``."""
    feed_id = feed_id or checkpoint
    files = _files(spark, max_files_per_trigger).schema(UPLOAD_SCHEMA).json(in_path)
    uploads = files.select("*", F.col("_metadata.file_modification_time").alias("arrived_at"))

    def run(batch: DataFrame, batch_id: int):
        parsed = P.parse_uploads(batch).checkpoint(eager=True)  # parsed once, read three times
        _write_batch(parsed.drop("ratings"), f"{out}/parsed", batch_id)
        _write_batch(P.flatten_ratings(parsed), f"{out}/ratings", batch_id)
        _write_batch(P.rejected(parsed), f"{out}/rejected", batch_id)
        if store is not None:
            from vecfactor.sources.store import train_and_store
            train_and_store(store, parsed, batch_key=f"{feed_id}/{batch_id}")
        if on_accepted is not None:
            on_accepted(P.accepted(parsed), batch_id)
    return _start(uploads, run, checkpoint, available_now)


def read_output(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch_id")


def file_count(df: DataFrame, text_col: str, least: int = 1) -> int:
    """Files for rows that mainly consist of one text: as many as keep each near ``FILE_BYTES``."""
    n = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(least, -(-n // FILE_BYTES))


def stage_files(df: DataFrame, path: str, n_files: int = 4) -> None:
    """Write a DataFrame as JSON-lines files for a feed to pick up."""
    df.repartition(n_files).write.mode("append").json(path)


__all__ = ["center_feed", "upload_feed", "read_output", "file_count", "stage_files"]

"""Streaming forms of the jobs: chunks in, segments, utterances, metrics and states out."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechtables.schemas import CHUNK


def chunk_source(spark: SparkSession, path: str, schema: str = CHUNK, **options) -> DataFrame:
    """Audio chunks arriving as parquet files (a Kafka topic takes the same place)."""
    return spark.readStream.schema(schema).options(**options).parquet(path)


def score_chunks(chunks: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Stateless: every chunk is handed to the user's model, its segments come out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield scorer(batch)

    return chunks.mapInPandas(run, schema)


def result_lines(segments: DataFrame, needs: Sequence[str] = ()) -> DataFrame:
    """One JSON document per segment; the line of one that lacks a field of ``needs`` is null."""
    line = F.to_json(F.struct(*segments.columns), {"ignoreNullFields": "false"})
    lacks = reduce(or_, [F.col(n).isNull() for n in needs], F.lit(False))
    return segments.select(F.when(~lacks, line).alias("value"))


def speech_sessions(regions: DataFrame, threshold: str, late: str, key: str = "recording_id", start: str = "start", length_us: str = "length_us") -> DataFrame:
    """Regions grouped while the pause is at most ``threshold``.

    Each region keeps its session open for its own length plus the threshold (and one microsecond, as
    sessions end exclusively while a pause equal to the threshold still belongs to the group).
    """
    gap = F.concat((F.col(length_us) + F.lit(1)).cast("string"), F.lit(" microseconds ") , F.lit(threshold))
    window = F.session_window(F.col(start), gap)
    return (
        regions.withWatermark(start, late)
        .groupBy(key, window)
        .agg(F.count(F.lit(1)).alias("regions"), F.min(start).alias("start"), F.max(F.unix_micros(start) + F.col(length_us)).alias("end_us"))
        .drop("session_window")
    )


def stage_metrics(timings: DataFrame, value: str, late: str, width: str = "1 minute", ts: str = "ts") -> DataFrame:
    """Tumbling windows of stage times."""
    return (
        timings.withWatermark(ts, late)
        .groupBy(F.window(ts, width), "stage")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(value).alias("highest"))
        .select(F.col("window.start").alias("window_start"), "stage", "n", "total", "highest")
    )


def drop_repeated_events(events: DataFrame, late: str, ts: str = "ts", by: tuple[str, ...] = ("job", "status")) -> DataFrame:
    """First event of every job and status within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(by))


def latest_status(events: DataFrame, known: DataFrame | None = None, ts: str = "ts", key: str = "job") -> DataFrame:
    """Last status per job, over the events and what was known before."""
    columns = [key, "status", ts]
    every = events.select(*columns) if known is None else events.select(*columns).unionByName(known.select(*columns))
    last = F.max_by(F.struct("status", ts), F.struct(F.col(ts), F.col("status")))
    return every.groupBy(key).agg(last.alias("l")).select(key, "l.status", f"l.{ts}")


STATUS_BUCKETS = 64


def upsert_status(path: str, key: str = "job", buckets: int = STATUS_BUCKETS) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer that keeps the last status per job.

    Jobs are dealt into ``buckets`` by hash; a batch writes version ``batch id`` of the buckets it touches
    and leaves the others alone, so a repeated batch writes the same again. See ``read_status``.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        dealt = batch.withColumn("bucket", F.pmod(F.hash(key), F.lit(buckets)))
        touched = [row["bucket"] for row in dealt.select("bucket").distinct().collect()]  # at most ``buckets``
        if not touched:
            return
        known = None
        if number:
            known = read_status(spark, path, F.col("bucket").isin(touched) & (F.col("version") < number))
        last = latest_status(batch, known, key=key).withColumn("bucket", F.pmod(F.hash(key), F.lit(buckets)))
        last.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/version={number}")

    return write


def read_status(spark: SparkSession, path: str, only: Column | None = None) -> DataFrame:
    """The last status per job: every bucket's highest version."""
    every = spark.read.option("basePath", path).parquet(f"{path}/version=*")
    every = every if only is None else every.filter(only)
    newest = every.groupBy("bucket").agg(F.max("version").alias("version"))
    return every.join(newest, ["bucket", "version"]).drop("bucket", "version")


def incremental_utterances(segments: DataFrame, key: str = "recording_id", idle_ms: int | None = None) -> DataFrame:
    """Utterances closed as soon as the speaker changes and, with ``idle_ms``, when a recording stays
    silent that long (timers keep a stream going, so leave them out with ``availableNow``).

    Segments of a batch are put in order of ``seq``; the open utterance waits in a value state, from which
    ``open_utterances`` reads it when the input has ended.
    """
    from pyspark.sql.streaming import StatefulProcessor

    class Utterances(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.open = handle.getValueState("open", "payload string")

        def handleInputRows(self, key, rows, timerValues):  # noqa: N803
            table = pd.concat(list(rows)).sort_values("seq")
            held = json.loads(self.open.get()[0]) if self.open.exists() else None
            done = []
            for row in table.itertuples(index=False):
                if held and held["speaker"] == int(row.speaker):
                    held["end"], held["text"] = int(row.end), held["text"] + row.text + " "
                    continue
                if held:
                    done.append(held)
                held = {"seq": int(row.seq), "start": int(row.start), "end": int(row.end), "speaker": int(row.speaker), "text": row.text + " "}
            self.open.update((json.dumps(held),))
            if idle_ms is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + idle_ms)
            yield self._table(key, done)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N803
            held = json.loads(self.open.get()[0]) if self.open.exists() else None
            self.open.clear()
            yield self._table(key, [held] if held else [])

        @staticmethod
        def _table(key, rows) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["seq", "start", "end", "speaker", "text"])
            out.insert(0, "recording_id", key[0])
            return out

        def close(self) -> None:
            pass

    return segments.groupBy(key).transformWithStateInPandas(
        statefulProcessor=Utterances(),
        outputStructType="recording_id bigint, seq bigint, start bigint, end bigint, speaker int, text string",
        outputMode="Append",
        timeMode="None" if idle_ms is None else "ProcessingTime",
    )


def open_utterances(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The utterances that ``incremental_utterances`` still holds, read from its finished run's state."""
    held = spark.read.format("statestore").option("stateVarName", "open").load(checkpoint)
    payload = F.from_json("value.payload", "seq bigint, start bigint, end bigint, speaker int, text string").alias("u")
    return held.select(F.col("key.recording_id").alias("recording_id"), payload).select("recording_id", "u.*")


def all_utterances(segments: DataFrame, folder: str) -> DataFrame:
    """Every utterance of what is there now: those closed during the run, then the open ones."""
    closed = run_available(incremental_utterances(segments), folder)
    return closed.unionByName(open_utterances(segments.sparkSession, f"{folder}/checkpoint"))


def run_available(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and read its result.

    ``complete`` results replace the table with every batch. ``folder`` must be shared by the cluster.
    """
    spark = stream.sparkSession
    out, checkpoint = f"{folder}/table", f"{folder}/checkpoint"
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").start(out)
    else:
        query = writer.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)

"""From transcripts and turns to the utterances of every job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechtables.operators.jobs import branch, empty_audio
from speechtables.operators.speakers import channel_runs, merge_channels, segments_to_turns
from speechtables.operators.utterances import finish, reconstruct, speaker_runs
from speechtables.plans.intervals import time_block
from speechtables.plans.ordered import with_ordinal
from speechtables.plans.skew import spread_lookup
from speechtables.schemas import OPTIONS

KEYS = ("recording_id",)

# The options a response repeats and their types, in the document's order.
ECHOED = dict(field.split(" ", 1) for field in OPTIONS.split(", "))


def response_documents(jobs: DataFrame, utterances: DataFrame, times: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One nested row per job: its utterances in order, the options it asked for and the stage times.

    ``jobs`` (with ``audio_duration``) have their defaults, ``utterances`` bring ``part, text, start, end,
    speaker, words`` (words are kept where the job wants them), ``times`` the four stage times. A job
    without utterances has an empty list; its text is part of one document, as in the document itself.
    """
    item = F.struct("part", "text", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), F.col("speaker").cast("int").alias("speaker"), "words")
    listed = utterances.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("__u"))
    stages = F.struct(*[F.col(n).cast("double").alias(n) for n in ("total", "transcription", "diarization", "post_processing")])
    clocked = times.select(*keys, stages.alias("process_times"))
    echoed = [(F.col(n) if n in jobs.columns else F.lit(None)).cast(kind).alias(n) for n, kind in ECHOED.items()]
    wanted = F.coalesce("word_timestamps", F.lit(False))
    bare = F.transform(
        F.coalesce("__u", F.array().cast(listed.schema["__u"].dataType)),
        lambda u: F.struct(u["text"].alias("text"), u["start"].alias("start"), u["end"].alias("end"), u["speaker"].alias("speaker"), F.when(wanted, u["words"]).alias("words")),
    )
    return jobs.join(listed, list(keys), "left").join(clocked, list(keys), "left").select(
        bare.alias("utterances"), F.col("audio_duration").cast("double").alias("audio_duration"), *echoed, "process_times"
    )


def _branches(routed: DataFrame, keys: Sequence[str]):
    """``of(rows, branch, spread)``: the rows of the jobs that take a branch."""

    def of(rows: DataFrame, name: str, spread: str) -> DataFrame:
        return spread_lookup(rows, routed.filter(F.col("branch") == name).select(*keys), keys, F.col(spread), "left_semi")

    return of


def _placed_pieces(of, segments: DataFrame, words: DataFrame, turns: DataFrame, threshold: int, width: int, keys: Sequence[str]) -> DataFrame:
    """Pieces of segments that have a speaker, numbered in order."""
    mapped = segments_to_turns(
        of(segments, "speakers", "seq"), of(words, "speakers", "seq"), of(turns, "speakers", "seq"), threshold, width, keys
    )
    return with_ordinal(
        mapped.filter(F.col("speaker").isNotNull()).withColumnRenamed("seq", "segment"), keys, ["segment", "piece"], time_block("segment", 1000)
    )


def job_words(
    jobs: DataFrame,
    segments: DataFrame,
    words: DataFrame,
    turns: DataFrame,
    width: int,
    threshold: int = 300,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Words of the final utterances of jobs that ask for word times, as rows: ``branch`` and ``part`` name the utterance of
    ``job_utterances``, ``place`` orders its words.

    An utterance may be as long as its recording, so its words are not gathered in one value. Times are in seconds,
    neither shifted by the job's offset nor formatted. ``words`` as in ``job_utterances``.
    """
    routed = branch(jobs.filter(F.coalesce("word_timestamps", F.lit(False))))
    of = _branches(routed, keys)
    order = F.struct(F.col("seq").cast("bigint").alias("first"), F.col("pos").cast("bigint").alias("second"))
    said = [*keys, "seq", "pos", "word", "start", "end"]
    plain = of(words, "plain", "seq").select(*said, F.lit("plain").alias("branch"), F.col("seq").cast("bigint").alias("part"), order.alias("place"))

    pieces = speaker_runs(_placed_pieces(of, segments, words, turns, threshold, width, keys), keys).select(
        *keys, F.col("segment").alias("seq"), "first_pos", "last_pos", F.col("run").alias("part")
    )
    diarized = (
        of(words, "speakers", "seq")
        .join(pieces, [*keys, "seq"])
        .filter(F.col("pos").between(F.col("first_pos"), F.col("last_pos")))
        .select(*said, F.lit("speakers").alias("branch"), "part", order.alias("place"))
    )
    channels = channel_runs(of(words, "channels", "seq").select(*said, "channel"), width, keys)
    at = F.struct(F.col("at").cast("bigint").alias("first"), F.lit(0).cast("bigint").alias("second"))
    merged = channels.select(*said, F.lit("channels").alias("branch"), F.col("run").alias("part"), at.alias("place"))
    every = plain.unionByName(diarized).unionByName(merged)
    return every.select(
        *keys, "branch", "part", "place", "word", (F.col("start") / 1000.0).alias("start"), (F.col("end") / 1000.0).alias("end")
    )


def job_utterances(
    jobs: DataFrame,
    segments: DataFrame,
    words: DataFrame,
    turns: DataFrame,
    width: int,
    threshold: int = 300,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Final utterances of checked and routed jobs: the three branches apart, then together.

    Times come in milliseconds and leave in the format the job asks for. ``words`` carry their
    ``channel`` and, for multi-channel jobs, their own blanks in ``spoken``. Diarized jobs without
    turns yield the row that stands for empty audio.
    """
    routed = branch(jobs)
    of = _branches(routed, keys)

    columns = [*keys, "branch", "part", "speaker", "start", "end", "text"]
    plain = of(segments, "plain", "seq").select(
        *keys, F.lit("plain").alias("branch"), F.col("seq").alias("part"), F.lit(None).cast("int").alias("speaker"), "start", "end", "text"
    )
    ordered = _placed_pieces(of, segments, words, turns, threshold, width, keys)
    diarized = reconstruct(ordered, keys).select(*keys, F.lit("speakers").alias("branch"), F.col("run").alias("part"), "speaker", "start", "end", "text")
    channels = of(words, "channels", "seq").select(*keys, "seq", "pos", "channel", "start", "end", F.col("spoken").alias("word"))
    merged = merge_channels(channels, width, keys).select(*keys, F.lit("channels").alias("branch"), F.col("run").alias("part"), "speaker", "start", "end", "text")

    every = plain.select(*columns).unionByName(diarized.select(*columns)).unionByName(merged.select(*columns))
    seconds = every.withColumn("start", F.col("start") / 1000.0).withColumn("end", F.col("end") / 1000.0)
    options = routed.select(*keys, "offset_start", "timestamps")
    done = finish(spread_lookup(seconds, options, keys, F.col("part")), F.col("timestamps"), F.col("offset_start"))
    answer = [*keys, "branch", "part", "speaker", "text", "number_start", "number_end", "text_start", "text_end"]
    formatted = done.select(
        *keys,
        "branch",
        "part",
        "speaker",
        "text",
        F.col("start_fmt.number").alias("number_start"),
        F.col("end_fmt.number").alias("number_end"),
        F.col("start_fmt.text").alias("text_start"),
        F.col("end_fmt.text").alias("text_end"),
    )
    silent = empty_audio(routed, turns, keys).select(
        *keys,
        F.lit("empty").alias("branch"),
        F.lit(0).cast("bigint").alias("part"),
        "speaker",
        "text",
        F.col("start").alias("number_start"),
        F.col("end").alias("number_end"),
        F.lit(None).cast("string").alias("text_start"),
        F.lit(None).cast("string").alias("text_end"),
    )
    return formatted.select(*answer).unionByName(silent.select(*answer))

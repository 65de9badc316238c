"""Job requests: defaults, checks, routing, and the branches of the post-processing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechtables.functions.text import strip
from speechtables.functions.times import FORMATS, FRAMES_PER_SECOND, SAMPLE_RATE
from speechtables.plans.intervals import points_in_intervals
from speechtables.plans.ordered import BLOCK_ROWS
from speechtables.plans.skew import spread_lookup

# What a request means when an option is missing.
DEFAULTS = {
    "num_speakers": -1,
    "diarization": False,
    "multi_channel": False,
    "batch_size": 1,
    "source_lang": "en",
    "num_beams": 1,
    "timestamps": "s",
    "word_timestamps": False,
    "internal_vad": False,
    "repetition_penalty": 1.2,
    "compression_ratio_threshold": 2.4,
    "log_prob_threshold": -1.0,
    "no_speech_threshold": 0.6,
    "condition_on_previous_text": True,
}

# Sub-window lengths, shifts and weights (milliseconds) by recording length (seconds).
SCALE_PROFILES = [
    (0, 3600, [1500, 1250, 1000, 750, 500], [750, 625, 500, 375, 250], [1.0, 1.0, 1.0, 1.0, 1.0]),
    (3600, 10800, [3000, 2500, 2000, 1500, 1000], [750, 625, 500, 375, 250], [1.0, 1.0, 1.0, 1.0, 1.0]),
    (10800, None, [3000, 2000, 1000], [750, 500, 250], [1.0, 1.0, 1.0]),
]
LONGFORM_SCALES = ([1900, 1200, 500], [950, 600, 250])

# Stages an error can come from, text of the row that stands for empty audio.
ERROR_SOURCES = ("add_url", "diarization", "get_url", "post_processing", "remove_url", "transcription")
EMPTY_AUDIO = "<EMPTY AUDIO>"


def with_defaults(jobs: DataFrame) -> DataFrame:
    """Missing options (columns or values) take their defaults; an empty vocabulary becomes null."""
    out = jobs
    for name, value in DEFAULTS.items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in jobs.columns else F.lit(value))
    if "vocab" in jobs.columns:
        out = out.withColumn("vocab", F.when(F.size("vocab") > 0, F.col("vocab")))
    return out


def validate(jobs: DataFrame) -> DataFrame:
    """Adds ``error`` (null for good requests)."""
    bad_time = ~F.col("timestamps").isin(*FORMATS)
    bad_vocab = F.lit(False)
    if "vocab" in jobs.columns:
        bad_vocab = F.coalesce(F.exists("vocab", lambda v: v.isNull()), F.lit(False))
    return jobs.withColumn(
        "error",
        F.when(bad_time, F.concat(F.lit("Invalid timestamps: "), F.col("timestamps"))).when(
            bad_vocab, F.lit("`vocab` must be a list of strings.")
        ),
    )


def check_scales(windows: Sequence[int], shifts: Sequence[int], weights: Sequence[float]) -> None:
    """All three lists must have one length."""
    if not len(windows) == len(shifts) == len(weights):
        raise ValueError(f"scale lists differ in length: {len(windows)}, {len(shifts)}, {len(weights)}")


def route(jobs: DataFrame) -> DataFrame:
    """Mono and multi-channel requests made consistent with the number of channels: several channels
    without ``multi_channel`` are mixed down; one channel with it is diarized instead."""
    to_mono = (F.col("channels") > 1) & ~F.col("multi_channel")
    to_diarized = (F.col("channels") == 1) & F.col("multi_channel")
    return (
        jobs.withColumn("diarization", F.col("diarization") | to_diarized)
        .withColumn("multi_channel", F.col("multi_channel") & ~to_diarized)
        .withColumn("channels", F.when(to_mono | to_diarized, 1).otherwise(F.col("channels")))
    )


def branch(jobs: DataFrame) -> DataFrame:
    """Adds ``branch``: ``channels``, ``speakers`` (diarized) or ``plain``."""
    return jobs.withColumn(
        "branch",
        F.when(F.col("multi_channel"), "channels").when(F.col("diarization"), "speakers").otherwise("plain"),
    )


def empty_audio(jobs: DataFrame, turns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The default row of diarized single-channel jobs without any turn."""
    wanted = jobs.filter(F.col("diarization") & ~F.col("multi_channel"))
    return wanted.join(turns.select(*keys).distinct(), list(keys), "left_anti").select(
        *keys,
        F.lit(EMPTY_AUDIO).alias("text"),
        F.lit(0.0).alias("start"),
        F.col("duration_s").cast("double").alias("end"),
        F.lit(None).cast("int").alias("speaker"),
    )


def clip_frames(frames: DataFrame, jobs: DataFrame, keys: Sequence[str], at: str = "sample", rate: int = SAMPLE_RATE) -> DataFrame:
    """Samples between the job's offsets (open ends allowed)."""
    limits = jobs.select(
        *keys,
        F.coalesce(F.floor(F.col("offset_start") * rate), F.lit(0)).cast("bigint").alias("__from"),
        F.floor(F.col("offset_end") * rate).cast("bigint").alias("__to"),
    )
    joined = spread_lookup(frames, limits, keys, F.col(at))
    inside = (F.col(at) >= F.col("__from")) & (F.col("__to").isNull() | (F.col(at) < F.col("__to")))
    return joined.filter(inside).drop("__from", "__to")


def clip_list(jobs: DataFrame, clips: str = "clip_timestamps", total: str = "n_frames", rate: int = FRAMES_PER_SECOND) -> DataFrame:
    """``"s,e,s,e"`` as rows of frame pairs; an open end closes at the content's end, nothing means all."""
    text = F.coalesce(F.col(clips), F.lit(""))
    points = F.when(text == "", F.array().cast("array<bigint>")).otherwise(
        F.transform(F.split(text, ","), lambda s: F.bround(s.cast("double") * rate).cast("bigint"))
    )
    points = F.when(F.size(points) == 0, F.array(F.lit(0).cast("bigint"))).otherwise(points)
    closed = F.when(F.size(points) % 2 == 1, F.concat(points, F.array(F.col(total).cast("bigint")))).otherwise(points)
    pairs = F.transform(
        F.sequence(F.lit(0), F.floor(F.size("__p") / 2).cast("int") - 1),
        lambda i: F.struct(F.get(F.col("__p"), i * 2).alias("start_frame"), F.get(F.col("__p"), i * 2 + 1).alias("end_frame")),
    )
    out = jobs.withColumn("__p", closed).select(*jobs.columns, F.posexplode(pairs).alias("clip", "__pair"))
    return out.select(*jobs.columns, "clip", "__pair.*")


def frames_in_clips(frames: DataFrame, clips: DataFrame, keys: Sequence[str], width: int = BLOCK_ROWS) -> DataFrame:
    """Frames lying in one of the clips."""
    inside = clips.filter(F.col("end_frame") > F.col("start_frame")).withColumn("__last", F.col("end_frame") - 1)
    return points_in_intervals(frames, "frame", inside.select(*keys, "clip", "start_frame", "__last"), "start_frame", "__last", keys, width).drop("__last")


def channel_duration(files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Duration of a job of several files: their mean."""
    return files.groupBy(*keys).agg(F.avg("duration").alias("duration"))


def scale_profile(duration_s: Column) -> Column:
    """Scales of a recording: array of (scale, window, shift, weight) in milliseconds."""
    out = None
    for low, _, windows, shifts, weights in SCALE_PROFILES:
        check_scales(windows, shifts, weights)
        scales = F.array(
            *[
                F.struct(F.lit(i).alias("scale"), F.lit(w).alias("window"), F.lit(s).alias("shift"), F.lit(x).alias("weight"))
                for i, (w, s, x) in enumerate(zip(windows, shifts, weights))
            ]
        )
        out = scales if out is None else F.when(duration_s >= low, scales).otherwise(out)
    return out


def format_segments(segments: DataFrame) -> DataFrame:
    """Segments as utterances: text, times, words with their four fields."""
    four = F.transform(
        "words", lambda w: F.struct(*[w[c].alias(c) for c in ("word", "start", "end", "probability")])
    )
    return segments.withColumn("words", four)


def shift_times(utterances: DataFrame, offset: Column) -> DataFrame:
    """Utterance times moved by the job's offset; word times stay."""
    by = F.coalesce(offset, F.lit(0.0))
    return utterances.withColumn("start", F.col("start") + by).withColumn("end", F.col("end") + by)


def toggle_words(utterances: DataFrame, wanted: Column) -> DataFrame:
    return utterances.withColumn("words", F.when(wanted, F.col("words")))


def drop_words(responses: DataFrame) -> DataFrame:
    """Responses without the words of their utterances."""
    return responses.withColumn("utterances", F.transform("utterances", lambda u: u.dropFields("words")))


def flat_words(segments: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """All words in order, one row each."""
    return segments.select(*keys, seq, F.posexplode("words").alias("pos", "w")).select(*keys, seq, "pos", "w.*")


def normalise_engine_rows(segments: DataFrame, multi_channel: bool = False) -> DataFrame:
    """Rows of the second engine in the common form: times rounded to 2 digits, a blank before every
    word, constant quality fields; stripped text for multi-channel input."""
    words = F.transform(
        "word_timestamps",
        lambda w: F.struct(
            F.concat(F.lit(" "), w["word"]).alias("word"),
            F.round(w["start"], 2).alias("start"),
            F.round(w["end"], 2).alias("end"),
            w["probability"].alias("probability"),
        ),
    )
    out = segments.withColumn("words", words).withColumn("start", F.round("start_time", 2)).withColumn("end", F.round("end_time", 2))
    if multi_channel:
        out = out.withColumn("text", strip(F.col("text")))
    quality = {"seek": F.lit(1), "id": F.lit(1), "tokens": F.array(F.lit(1)), "temperature": F.lit(0.0), "avg_logprob": F.lit(0.0), "compression_ratio": F.lit(0.0), "no_speech_prob": F.lit(0.0)}
    return out.withColumns(quality).drop("word_timestamps", "start_time", "end_time")


def channels_to_speakers(recordings: DataFrame, channels: str = "channels") -> DataFrame:
    """One row per segment of every channel; the channel's place is the speaker."""
    each = recordings.select(*[c for c in recordings.columns if c != channels], F.posexplode(channels).alias("speaker", "__segments"))
    return each.select(*[c for c in each.columns if c != "__segments"], F.posexplode("__segments").alias("seq", "segment"))


def scatter_results(files: DataFrame, chunks: DataFrame, results: DataFrame) -> DataFrame:
    """Chunk results brought back to their files: one row per chunk in ``seq`` order within the file
    (a file without chunks keeps one row without result)."""
    found = chunks.join(results, ["file_id", "seq"])
    return files.join(found, "file_id", "left")

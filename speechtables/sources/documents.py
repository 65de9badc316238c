"""Readers and writers of request, response, manifest, event and report documents."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechtables.operators import scoring
from speechtables.operators.jobs import ERROR_SOURCES, with_defaults
from speechtables.schemas import JOBS, RESPONSE
from speechtables.session import cut_lineage

# Events stay available this many days; the value a missing name takes in an object key.
RETENTION_DAYS = 5
MISSING = "None"


def read_responses(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Response documents: one (possibly indented) document per file, or else one per line."""
    return spark.read.schema(RESPONSE).json(path, multiLine=one_per_file)


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Job requests (JSON lines) with defaults filled in."""
    return with_defaults(spark.read.schema(JOBS).json(path))


def object_key(task_token: Column, job_name: Column) -> Column:
    """Name a response is stored under."""
    part = [F.coalesce(c, F.lit(MISSING)) for c in (task_token, job_name)]
    return F.concat(F.lit("responses/"), part[0], F.lit("_"), part[1], F.lit(".json"))


def write_responses(responses: DataFrame, path: str, mode: str = "append") -> None:
    """Responses as JSON lines, many to a file, each beside the key it is stored under; null fields are
    written, too."""
    keyed = responses.withColumn("object_key", object_key(F.col("task_token"), F.col("job_name")))
    keyed.write.mode(mode).option("ignoreNullFields", "false").json(path)


def manifest_lines(files: DataFrame) -> DataFrame:
    """Diarization manifest, one JSON line per file; columns of ``files`` override the defaults."""
    defaults = {
        "audio_filepath": F.lit(None).cast("string"),
        "offset": F.lit(0),
        "duration": F.lit(None).cast("double"),
        "label": F.lit("infer"),
        "text": F.lit("-"),
        "rttm_filepath": F.lit(None).cast("string"),
        "uem_filepath": F.lit(None).cast("string"),
    }
    fields = [F.col(n).alias(n) if n in files.columns else d.alias(n) for n, d in defaults.items()]
    return files.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def write_manifest(files: DataFrame, path: str) -> None:
    manifest_lines(files).write.text(path)


def status_events(results: DataFrame, app: str) -> DataFrame:
    """Events for finished and failed jobs (``job_name, task_token, error, at``)."""
    status = F.when(F.col("error").isNull(), "finished").otherwise("error")
    stamp = F.date_format("at", "yyyy_MM_dd_HH_mm_ss_SSSSSS")
    good = F.to_json(F.struct("job_name", "task_token"), {"ignoreNullFields": "false"})
    bad = F.to_json(F.struct("error", "job_name", "task_token"), {"ignoreNullFields": "false"})
    return results.select(
        F.concat(F.lit(f"async_job.{app}."), status).alias("event_type"),
        F.concat_ws("_", F.lit(app), status, F.coalesce("job_name", F.lit(MISSING)), stamp).alias("event_id"),
        F.lit(RETENTION_DAYS).alias("payload_retention_period"),
        F.when(F.col("error").isNull(), good).otherwise(bad).alias("payload"),
    )


def split_errors(results: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Good rows, and the dead letters of a stage: (source, message) kept instead of a result."""
    good = results.filter(F.col(error).isNull()).drop(error)
    bad = results.filter(F.col(error).isNotNull())
    return good, bad


def dead_letters(stages: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """(job, source, message) of the failed rows of several stages: (source, rows, column that names the job)."""
    letters = []
    for source, rows, job in stages:
        if source not in ERROR_SOURCES:
            raise ValueError(f"unknown error source {source}")
        _, bad = split_errors(rows)
        letters.append(bad.select(F.col(job).cast("string").alias("job"), F.lit(source).alias("source"), F.col("error").alias("message")))
    return reduce(DataFrame.unionByName, letters)


def transcript_lines(pairs: DataFrame, key: str = "utt_id") -> DataFrame:
    """Reference and hypothesis of every utterance, a line each."""
    name = F.col(key).cast("string")
    lines = [
        F.struct(F.lit(at).alias("line"), F.concat(name, F.lit(f":\t{side}="), F.array_join(side, " ")).alias("value"))
        for at, side in enumerate(("ref", "hyp"))
    ]
    return pairs.select(key, F.explode(F.array(*lines)).alias("l")).select(key, "l.line", "l.value")


def error_report(pairs: DataFrame, key: str = "utt_id") -> dict[str, DataFrame]:
    """The sections of a word-error report; the words are aligned once, all sections read that table."""
    steps = cut_lineage(scoring.align_words(pairs, key))
    return {
        "summary": scoring.error_summary(steps),
        "utterances": scoring.utterance_details(steps, key),
        "substitutions": scoring.substitutions(steps),
        "deletions": scoring.deletions(steps),
        "insertions": scoring.insertions(steps),
        "words": scoring.word_stats(steps),
    }


def report_lines(sections: dict[str, DataFrame], key: str = "utt_id") -> DataFrame:
    """The sections as lines of text (``section, place, line``); a section reads by falling ``place``, then line."""
    spaced = lambda *parts: F.concat_ws("   ", *parts)
    summary = F.format_string(
        "%d errors: %d insertions, %d deletions, %d substitutions, over %d reference words (%d correct)", "errors", "ins", "del", "sub", "ref_len", "corr"
    )
    counts = F.concat_ws(" ", "corr", "errors", "in_ref", "in_hyp")
    layout = {
        "summary": ("SUMMARY", F.lit(0), summary),
        "utterances": ("PER-UTT DETAILS", F.lit(0), F.concat(F.col(key).cast("string"), F.lit(":\t"), F.col("detail"))),
        "substitutions": ("SUBSTITUTIONS", F.col("n"), spaced("n", F.concat_ws(" -> ", "ref", "hyp"))),
        "deletions": ("DELETIONS", F.col("n"), spaced("n", "ref")),
        "insertions": ("INSERTIONS", F.col("n"), spaced("n", "hyp")),
        "words": ("PER-WORD STATS", F.col("errors"), spaced("word", counts)),
    }
    tables = [
        sections[name].select(F.lit(title).alias("section"), place.cast("bigint").alias("place"), line.alias("line"))
        for name, (title, place, line) in layout.items()
    ]
    return reduce(DataFrame.unionByName, tables)


def write_report(sections: dict[str, DataFrame], path: str, formats: Sequence[str] = ("parquet",)) -> None:
    """Every section as a table of its own."""
    for name, table in sections.items():
        for kind in formats:
            table.write.mode("overwrite").format(kind).save(f"{path}/{name}.{kind}")

"""From segments to utterances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechtables.functions import text as txt
from speechtables.functions import times
from speechtables.plans.ordered import BLOCK_ROWS, neighbours, row_block, run_ids, scan

KEYS = ("recording_id",)


def join_text(text: str, order: Sequence[str], separator: str) -> Column:
    """Aggregate: texts of a group joined in order."""
    pieces = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__t"))))
    return F.array_join(F.transform(pieces, lambda p: p["__t"]), separator)


def join_words(words: str, order: Sequence[str]) -> Column:
    """Aggregate: word arrays of a group put together in order."""
    pieces = F.array_sort(F.collect_list(F.struct(*order, F.col(words).alias("__w"))))
    return F.flatten(F.transform(pieces, lambda p: p["__w"]))


def speaker_runs(
    segments: DataFrame, keys: Sequence[str] = KEYS, seq: str = "seq", speaker: str = "speaker", dense: bool = True, rows: int = BLOCK_ROWS
) -> DataFrame:
    """Adds ``run``, the number of the run of one speaker a segment belongs to."""
    before = {"__ps": F.struct(F.col(speaker).alias("v"))}
    if dense:
        marked = neighbours(segments, keys, seq, prev=before, rows=rows)
    else:
        marked = scan(segments, keys, [seq], row_block(seq, rows), prev=before)
    opens = F.col("__ps").isNull() | ~F.col("__ps.v").eqNullSafe(F.col(speaker))
    return run_ids(marked.withColumn("__opens", opens).drop("__ps"), keys, seq, F.col("__opens"), rows=rows)


def reconstruct(
    segments: DataFrame,
    keys: Sequence[str] = KEYS,
    seq: str = "seq",
    start: str = "start",
    end: str = "end",
    speaker: str = "speaker",
    text: str = "text",
    words: str | None = None,
    dense: bool = True,
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Consecutive segments of one speaker become one utterance (a blank after every segment).

    Within a run the text is first joined per block, then across blocks: a very long run never
    gathers single segments in one task, only their joined pieces.
    """
    runs = speaker_runs(segments, keys, seq, speaker, dense, rows)
    pieces = runs.groupBy(*keys, "run", row_block(seq, rows).alias("__block")).agg(
        F.min(seq).alias(seq),
        F.min_by(start, seq).alias(start),
        F.max_by(end, seq).alias(end),
        F.min(speaker).alias(speaker),
        join_text(text, [seq], " ").alias(text),
        *([join_words(words, [seq]).alias(words)] if words else []),
    )
    return pieces.groupBy(*keys, "run").agg(
        F.min(seq).alias(seq),
        F.min_by(start, seq).alias(start),
        F.max_by(end, seq).alias(end),
        F.min(speaker).alias(speaker),
        F.concat(join_text(text, [seq], " "), F.lit(" ")).alias(text),
        *([join_words(words, [seq]).alias(words)] if words else []),
    )


def finish(
    utterances: DataFrame,
    target: Column,
    offset_start: Column | None = None,
    word_timestamps: Column | None = None,
    start: str = "start",
    end: str = "end",
    text: str = "text",
) -> DataFrame:
    """Last projection: blank utterances dropped, text cleaned, times shifted and formatted, words
    kept only on request (word times are not shifted)."""
    shift = F.lit(0.0) if offset_start is None else F.coalesce(offset_start, F.lit(0.0))
    kept = utterances.filter(~txt.is_blank(F.col(text)))
    begin = times.convert_timestamp(F.col(start) + shift, target)
    stop = times.convert_timestamp(F.col(end) + shift, target)
    out = (
        kept.withColumn(text, txt.format_punct(F.col(text)))
        .withColumn("start_fmt", begin)
        .withColumn("end_fmt", stop)
    )
    if word_timestamps is not None and "words" in utterances.columns:
        out = out.withColumn("words", F.when(word_timestamps, F.col("words")))
    return out


def transcript_lines(
    sentences: DataFrame, keys: Sequence[str] = KEYS, seq: str = "seq", speaker: str = "speaker", text: str = "text", rows: int = BLOCK_ROWS
) -> DataFrame:
    """The transcript as ordered lines, a new paragraph ``Speaker n: `` at every change of speaker.

    Joined in order of ``seq`` the lines give the text of a recording; they stay rows because a
    recording may be too long for one value.
    """
    marked = neighbours(sentences, keys, seq, prev={"__ps": F.col(speaker)}, rows=rows)
    head = F.concat(F.lit("Speaker "), F.col(speaker).cast("string"), F.lit(": "))
    line = F.concat(
        F.when(F.col("__ps").isNull(), head).when(F.col("__ps") != F.col(speaker), F.concat(F.lit("\n\n"), head)).otherwise(""),
        F.col(text),
        F.lit(" "),
    )
    return marked.select(*keys, seq, line.alias("line"))

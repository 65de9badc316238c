"""Speaker turns: overlaps, merging, numbering, grouping by pauses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechtables.plans.ordered import BLOCK_ROWS, neighbours, row_block, run_ids, scan
from speechtables.plans.skew import spread_lookup

KEYS = ("recording_id",)


def resolve_overlaps(
    turns: DataFrame, keys: Sequence[str] = KEYS, seq: str = "seq", start: str = "start", end: str = "end", rows: int = BLOCK_ROWS
) -> DataFrame:
    """Overlapping neighbours both move to the middle of their overlap (dense ``seq``).

    Only original times take part, so the chain has a closed form in the previous end and next start.
    """
    out = neighbours(turns, keys, seq, prev={"__pe": F.col(end)}, next={"__ns": F.col(start)}, rows=rows)
    s, e = F.col(start), F.col(end)
    return out.select(
        *[c for c in turns.columns if c not in (start, end)],
        F.when(F.col("__pe") > s, (s + F.col("__pe")) / F.lit(2.0)).otherwise(s.cast("double")).alias(start),
        F.when(e > F.col("__ns"), (F.col("__ns") + e) / F.lit(2.0)).otherwise(e.cast("double")).alias(end),
    )


def merge_same_speaker(
    turns: DataFrame,
    keys: Sequence[str] = KEYS,
    seq: str = "seq",
    start: str = "start",
    end: str = "end",
    speaker: str = "speaker",
    rows: int = BLOCK_ROWS,
    dense: bool = True,
) -> DataFrame:
    """Touching turns (end equals next start) of the same speaker become one."""
    before = {"__pe": F.col(end), "__ps": F.col(speaker)}
    slim = turns.select(*keys, seq, start, end, speaker)
    if dense:
        marked = neighbours(slim, keys, seq, prev=before, rows=rows)
    else:
        marked = scan(slim, keys, [seq], row_block(seq, rows), prev=before)
    goes_on = F.coalesce((F.col("__pe") == F.col(start)) & (F.col("__ps") == F.col(speaker)), F.lit(False))
    runs = run_ids(marked, keys, seq, ~goes_on, rows=rows)
    return runs.groupBy(*keys, "run").agg(
        F.min_by(start, seq).alias(start),
        F.max_by(end, seq).alias(end),
        F.min(speaker).alias(speaker),
        F.min(seq).alias(seq),
    )


def group_by_gap(
    regions: DataFrame, threshold: float | int, keys: Sequence[str] = KEYS, seq: str = "seq", start: str = "start", end: str = "end", rows: int = BLOCK_ROWS
) -> DataFrame:
    """Adds ``grp``: a new group begins where the pause before a region exceeds ``threshold``."""
    marked = neighbours(regions, keys, seq, prev={"__pe": F.col(end)}, rows=rows)
    opens = F.coalesce(F.col(start) - F.col("__pe") > threshold, F.lit(True))
    return run_ids(marked, keys, seq, opens, name="grp", rows=rows).drop("__pe")


def number_speakers(turns: DataFrame, label: str, keys: Sequence[str] = KEYS, seq: str = "seq") -> DataFrame:
    """Adds ``speaker``: labels numbered 0, 1, 2… in order of first appearance."""
    first = turns.groupBy(*keys, label).agg(F.min(seq).alias("__first"))
    ids = first.select(
        *keys, label, (F.row_number().over(Window.partitionBy(*keys).orderBy("__first")) - 1).cast("int").alias("speaker")
    )
    return spread_lookup(turns, ids, [*keys, label], F.col(seq))


def overlap_threshold(n_speakers: int, threshold: float = 0.7, limit: int = 5) -> float:
    """Score above which a second speaker counts, by number of speakers."""
    return threshold - (n_speakers - 2) * (threshold - 1) / (limit - 2)


def main_and_overlap(windows: DataFrame, scores: str, n_speakers: int, limit: int = 5, threshold: float = 0.7) -> DataFrame:
    """Adds ``speaker`` (highest score, lowest index wins) and ``second`` (the runner-up where at
    least two scores exceed the threshold and there are fewer speakers than ``limit``)."""
    bar = overlap_threshold(n_speakers, threshold, limit)
    ranked = F.array_sort(
        F.transform(scores, lambda x, i: F.struct((-x).alias("neg"), i.cast("int").alias("speaker")))
    )
    overlapped = (F.size(F.filter(scores, lambda x: x > bar)) > 1) & F.lit(n_speakers < limit)
    return windows.withColumn("speaker", ranked[0]["speaker"]).withColumn(
        "second", F.when(overlapped, ranked[1]["speaker"])
    )


def overlap_turns(
    windows: DataFrame, scores: str, n_speakers: int, keys: Sequence[str] = KEYS, seq: str = "seq", rows: int = BLOCK_ROWS
) -> DataFrame:
    """Turns of the main speakers and, apart from them, turns of the overlapping speakers."""
    labelled = main_and_overlap(windows, scores, n_speakers)
    straight = resolve_overlaps(labelled, keys, seq, rows=rows)
    main = merge_same_speaker(straight, keys, seq, rows=rows).withColumn("kind", F.lit("main"))
    second = straight.filter(F.col("second").isNotNull()).select(*keys, seq, "start", "end", F.col("second").alias("speaker"))
    # one list per overlapping speaker: the speaker is part of the key
    parted = second.withColumn("__who", F.col("speaker"))
    overlap = merge_same_speaker(parted, [*keys, "__who"], seq, rows=rows, dense=False).withColumn("kind", F.lit("overlap"))
    columns = [*keys, "kind", "start", "end", "speaker"]
    return main.select(*columns).unionByName(overlap.select(*columns))

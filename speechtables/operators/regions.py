"""From frame scores to speech regions, and from regions to chunks."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechtables.plans.asof import next_mark
from speechtables.plans.carry import fold
from speechtables.plans.intervals import points_in_intervals
from speechtables.plans.jumps import visited
from speechtables.plans.ordered import BLOCK_ROWS, neighbours, row_block, run_ids, scan, with_ordinal
from speechtables.plans.ranges import explode_count
from speechtables.plans.skew import spread_lookup
from speechtables.plans.sliding import least_ahead
from speechtables.session import cut_lineage

KEYS = ("recording_id",)


# ---- frames to regions ---------------------------------------------------------------------


def hysteresis(
    frames: DataFrame, on: Column, off: Column, keys: Sequence[str] = KEYS, frame: str = "frame", rows: int = BLOCK_ROWS
) -> DataFrame:
    """Regions between an ``on`` frame and the frame before the next ``off`` frame (first/last frame).

    Frames that satisfy neither keep the state. All frames of a region share the last ``off`` frame
    before them, which therefore identifies the region.
    """
    marked = scan(
        frames.select(*keys, frame, on.alias("__is_on"), off.alias("__is_off")),
        keys,
        [frame],
        row_block(frame, rows),
        latest={"__on": F.when(F.col("__is_on"), F.col(frame)), "__off": F.when(F.col("__is_off"), F.col(frame))},
        overall={"final_frame": ("max", F.col(frame))},
    )
    active = F.col("__on").isNotNull() & (F.col("__off").isNull() | (F.col("__on") > F.col("__off")))
    return (
        marked.filter(active)
        .groupBy(*keys, F.coalesce("__off", F.lit(-1)).alias("__region"))
        .agg(F.min(frame).alias("start_frame"), F.max(frame).alias("end_frame"), F.max("final_frame").alias("final_frame"))
        .drop("__region")
    )


def speech_regions(frames: DataFrame, bos: float = 0.3, eos: float = 0.3, **kw) -> DataFrame:
    """On at ``prob >= bos``, off at ``prob < eos``."""
    return hysteresis(frames, F.col("prob") >= bos, F.col("prob") < eos, **kw)


def binarize(frames: DataFrame, onset: float, offset: float | None = None, **kw) -> DataFrame:
    """On at ``prob > onset``, off at ``prob < offset``; the off frame closes the region."""
    offset = onset if offset is None else offset
    regions = hysteresis(frames, F.col("prob") > onset, F.col("prob") < offset, **kw)
    return regions.withColumn("end_frame", F.least(F.col("end_frame") + 1, F.col("final_frame")))


def binarize_limited(
    frames: DataFrame,
    onset: float,
    max_frames: int,
    offset: float | None = None,
    keys: Sequence[str] = KEYS,
    frame: str = "frame",
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Like ``binarize``, but a region longer than ``max_frames`` is cut at its lowest score in the second half of what was
    gathered since it opened (the frame that closed the region before counts as gathered) or since its last cut.

    Frames are numbered without gaps. A piece ends at a cut, at a closing frame or with the recording, and which of these
    follows from where it starts: the sliding minimum gives the cut, the next frame below ``offset`` the closing. A
    closing frame that falls on the frame at which the limit is noticed does not close; the piece after that cut
    begins with the knowledge to pass over it. So every frame gets up to four nodes (opens here, cut here, cut here with a
    frame to pass over, closed here), each with one jump, and the pieces are the nodes that the chain visits.
    """
    if max_frames < 1:
        raise ValueError("max_frames must be at least 1")
    offset = onset if offset is None else offset
    keys, block = list(keys), row_block("frame", rows)
    plain = frames.select(*keys, F.col(frame).cast("bigint").alias("frame"), "prob")
    high, below = F.coalesce(F.col("prob") > onset, F.lit(False)), F.coalesce(F.col("prob") < offset, F.lit(False))
    marks = scan(
        plain.withColumn("__high", high).withColumn("__below", below),
        keys,
        ["frame"],
        block,
        latest={"__opened": F.when(F.col("__high"), F.col("frame"))},
        upcoming={"__b": F.when(F.col("__below"), F.col("frame")), "__h": F.when(F.col("__high"), F.col("frame"))},
        overall={"__last": ("max", F.col("frame"))},
    )
    marks = neighbours(marks, keys, "frame", next={"__nb": F.col("__b"), "__nh": F.col("__h")}, rows=rows)
    marks = cut_lineage(
        scan(
            marks,
            keys,
            ["frame"],
            block,
            upcoming={"__closing": F.when(F.col("__below"), F.struct(F.col("frame").alias("one"), F.col("__nb").alias("two")))},
        )
    )
    here = marks.filter("__opened is not null").select(*keys, "frame", "__high", "__below", "__nh", "__last")
    half = (max_frames + 1) // 2
    first = least_ahead(marks, keys, "frame", "prob", half, max_frames - half + 1).withColumnRenamed("least", "__first")
    later = max_frames // 2 + 1
    other = least_ahead(marks, keys, "frame", "prob", later, max_frames - later + 1).withColumnRenamed("least", "__other")
    ahead = marks.select(*keys, (F.col("frame") - 1).alias("frame"), "__closing")
    noticed = marks.select(*keys, (F.col("frame") - max_frames - 1).alias("frame"), F.col("__below").alias("__passed"))
    at = [*keys, "frame"]
    known = here.join(ahead, at, "left").join(noticed, at, "left").join(first, at, "left").join(other, at, "left")

    node = lambda kind, when: F.when(when, F.lit(kind))
    kinds = F.array_compact(
        F.array(node(0, F.col("__high")), node(1, F.lit(True)), node(2, F.lit(True)), node(3, F.col("__below")))
    )
    known = known.withColumn("__kind", F.explode(kinds))
    closing = F.when(F.col("__kind") == 2, F.col("__closing.two")).otherwise(F.col("__closing.one"))
    noticed_at = F.col("frame") + max_frames + 1
    is_cut = (noticed_at <= F.col("__last")) & (closing.isNull() | (noticed_at <= closing))
    cut = F.when(F.col("__kind") == 0, F.col("__first.at")).otherwise(F.col("__other.at"))
    jump = (
        F.when(F.col("__kind") == 3, F.col("__nh") * 4)
        .when(is_cut, cut * 4 + F.when(F.col("__passed"), 2).otherwise(1))
        .otherwise(closing * 4 + 3)
    )
    end = F.when(is_cut, cut).otherwise(F.coalesce(closing, F.col("__last")))
    nodes = cut_lineage(
        known.select(
            *keys,
            (F.col("frame") * 4 + F.col("__kind")).alias("__node"),
            jump.alias("__jump"),
            F.col("frame").alias("start_frame"),
            F.when(F.col("__kind") < 3, end).alias("end_frame"),
        )
    )
    chain = visited(nodes, keys, "__node", "__jump")
    pieces = nodes.filter("end_frame is not null").join(chain, [*keys, "__node"], "left_semi")
    return pieces.select(*keys, "start_frame", "end_frame")


def active_regions(
    frames: DataFrame,
    onset: float,
    offset: float | None = None,
    pad_onset: int = 0,
    pad_offset: int = 0,
    min_off: int = 0,
    min_on: int = 0,
    max_frames: int | None = None,
    keys: Sequence[str] = KEYS,
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Binarisation with all its steps, in frames: regions, padded on both sides, joined where they then overlap or leave no
    more than ``min_off``, and kept from ``min_on`` on. A start may fall before the first frame by the pad.

    ``max_frames`` cuts long regions instead; joining would undo the cuts, so it excludes pads and ``min_off``.
    """
    keys = list(keys)
    if max_frames is not None:
        if pad_onset or pad_offset or min_off:
            raise ValueError("max_frames cannot be combined with pads or min_off")
        found = binarize_limited(frames, onset, max_frames, offset, keys, rows=rows)
        found = found.withColumnsRenamed({"start_frame": "start", "end_frame": "end"})
        return found.filter(F.col("end") - F.col("start") >= min_on)
    found = binarize(frames, onset, offset, keys=keys, rows=rows).select(
        *keys, (F.col("start_frame") - pad_onset).alias("start"), (F.col("end_frame") + pad_offset).alias("end")
    )
    if not (pad_onset or pad_offset or min_off):
        return found.filter(F.col("end") - F.col("start") >= min_on)
    numbered = with_ordinal(found, keys, ["start"], F.expr(f"start div {rows}"))
    return fill_gaps(numbered, min_off, min_on, keys, rows=rows).select(*keys, "start", "end")


def cut_long_regions(
    frames: DataFrame, regions: DataFrame, max_frames: int, cut_factor: int = 2, keys: Sequence[str] = KEYS, rows: int = BLOCK_ROWS
) -> DataFrame:
    """Regions longer than the limit are cut at the lowest score of the second half of the window.

    Only frames of over-long regions are looked at; frames are numbered without gaps. For each of them a sliding minimum
    tells where a piece that begins there would be cut; the pieces are the frames that the chain of cuts visits.
    """
    half = max_frames // cut_factor
    limit = half * cut_factor
    if half < 1 or cut_factor < 2:
        raise ValueError("max_frames must be at least cut_factor, and cut_factor at least 2")
    keys = list(keys)
    span = F.col("end_frame") - F.col("start_frame")
    short = regions.filter(span <= limit).select(
        *keys,
        F.col("start_frame").alias("region_start"),
        "start_frame",
        "end_frame",
        F.lit(True).alias("first"),
        F.lit(True).alias("final"),
    )
    inside = cut_lineage(
        points_in_intervals(
            frames.select(*keys, "frame", "prob"),
            "frame",
            regions.filter(span > limit).select(*keys, "start_frame", "end_frame"),
            "start_frame",
            "end_frame",
            keys,
            rows,
        )
    )
    by = [*keys, "start_frame", "end_frame"]
    cuts = least_ahead(inside, by, "frame", "prob", half, limit - half)
    cut = F.when(F.col("end_frame") - F.col("frame") > limit, F.col("least.at"))
    nodes = cut_lineage(inside.join(cuts, [*by, "frame"], "left").select(*by, "frame", cut.alias("__cut")))
    chain = visited(nodes.withColumn("__next", F.col("__cut") + 1), by, "frame", "__next")
    pieces = nodes.join(chain, [*by, "frame"], "left_semi").select(
        *keys,
        F.col("start_frame").alias("region_start"),
        F.col("frame").alias("start_frame"),
        F.coalesce("__cut", "end_frame").alias("end_frame"),
        (F.col("frame") == F.col("start_frame")).alias("first"),
        F.col("__cut").isNull().alias("final"),
    )
    return short.unionByName(pieces)


def pad_pieces(pieces: DataFrame, frame_ms: int, padding_ms: int) -> DataFrame:
    """Piece times in milliseconds; a region's first start and last end are padded."""
    start = F.col("start_frame") * frame_ms - F.when(F.col("first"), padding_ms).otherwise(0)
    end = (F.col("end_frame") + 1) * frame_ms + F.when(F.col("final"), padding_ms).otherwise(0)
    return pieces.withColumn("start_ms", start).withColumn("end_ms", end)


def clamp_or_default(pieces: DataFrame, recordings: DataFrame, keys: Sequence[str] = KEYS, silent_ms: int = 29_000) -> DataFrame:
    """Times clamped to ``0 … duration_ms``; recordings without speech get one default region."""
    held = spread_lookup(pieces, recordings.select(*keys, "duration_ms"), keys, F.col("start_ms")).select(
        *keys,
        F.greatest(F.col("start_ms"), F.lit(0)).alias("start_ms"),
        F.least(F.col("end_ms"), F.col("duration_ms")).alias("end_ms"),
    )
    silent = recordings.join(pieces.select(*keys).distinct(), list(keys), "left_anti")
    default = silent.select(
        *keys,
        F.lit(0).cast("bigint").alias("start_ms"),
        F.least(F.lit(silent_ms).cast("bigint"), F.col("duration_ms")).alias("end_ms"),
    )
    return held.unionByName(default)


# Samples per score, hysteresis distance, shortest silence that allows a forced cut.
WINDOW_SAMPLES = 512
NEGATIVE_MARGIN = 0.15
FORCED_CUT_MS = 98


def voice_activity(
    frames: DataFrame,
    threshold: float = 0.5,
    min_speech_ms: int = 250,
    max_speech_s: float = float("inf"),
    min_silence_ms: int = 2000,
    pad_ms: int = 400,
    keys: Sequence[str] = KEYS,
    rows: int = BLOCK_ROWS,
    rate: int = 16_000,
) -> DataFrame:
    """Speech in samples: opens at ``threshold``, closes after ``min_silence_ms`` below
    ``threshold - 0.15``; over-long speech is closed at its last real pause, or on the spot.
    Regions are unpadded; see ``pad_regions``."""
    low = threshold - NEGATIVE_MARGIN
    shortest = rate * min_speech_ms / 1000
    longest = rate * max_speech_s - WINDOW_SAMPLES - 2 * rate * pad_ms / 1000
    pause = rate * min_silence_ms / 1000
    cut_pause = rate * FORCED_CUT_MS / 1000

    def step(rows: pd.DataFrame, state: str, last: bool):
        """Walks over runs of frames of one kind (speech, between, silence); inside a run the frame at which
        a limit is passed follows from the times alone."""
        open_at, silent_at, cut_at, resumed = json.loads(state) if state else (None, 0, 0, 0)
        times = WINDOW_SAMPLES * rows["frame"].to_numpy()
        scores = rows["prob"].to_numpy()
        kind = np.where(scores >= threshold, 2, np.where(scores < low, 0, 1))
        found: list[tuple[int, int]] = []

        def passed(limit: float, begin: int, end: int, strict: bool = True) -> int:
            return begin + int(np.searchsorted(times[begin:end], limit, "right" if strict else "left"))

        def forced(at: int) -> None:
            nonlocal open_at, silent_at, cut_at, resumed
            found.append((open_at, cut_at or int(times[at])))
            open_at = resumed if cut_at and resumed >= cut_at else None
            silent_at = cut_at = resumed = 0

        edges = [0, *(np.flatnonzero(np.diff(kind)) + 1).tolist(), len(kind)]
        for at, end in zip(edges[:-1], edges[1:]):
            if kind[at] == 2 and silent_at:
                silent_at = 0
                if resumed < cut_at:
                    resumed = int(times[at])
            while at < end:
                if open_at is None:
                    if kind[at] != 2:
                        break
                    open_at = int(times[at])
                    at += 1
                    continue
                over = passed(open_at + longest, at, end)
                if kind[at]:
                    if over < end:
                        forced(over)
                    at = over + 1
                    continue
                since = silent_at or int(times[at])
                closing = passed(since + pause, at, end, strict=False)
                reach = min(over, closing, end)
                if reach > at:
                    silent_at = since
                    if times[reach - 1] - since > cut_pause:
                        cut_at = since
                if closing < over:
                    if since - open_at > shortest:
                        found.append((open_at, since))
                    open_at, silent_at, cut_at, resumed = None, 0, 0, 0
                elif over < end:
                    forced(over)
                    at = over
                    continue
                break
        if last and open_at is not None:
            total = int(times[-1]) + WINDOW_SAMPLES
            if total - open_at > shortest:
                found.append((open_at, total))
        return pd.DataFrame(found, columns=["start", "end"]), json.dumps([open_at, silent_at, cut_at, resumed])

    return fold(frames.select(*keys, "frame", "prob"), keys, ["frame"], row_block("frame", rows), step, "start bigint, end bigint")


# ---- regions to regions --------------------------------------------------------------------


def pad_regions(
    regions: DataFrame, pad: int, length: Column, keys: Sequence[str] = KEYS, seq: str = "seq", rows: int = BLOCK_ROWS
) -> DataFrame:
    """Both sides padded; a pause shorter than two pads is shared half and half (dense ``seq``)."""
    near = neighbours(regions, keys, seq, prev={"__pe": F.col("end")}, next={"__ns": F.col("start")}, rows=rows)
    before, after = F.col("start") - F.col("__pe"), F.col("__ns") - F.col("end")
    start = F.when(before < 2 * pad, F.col("start") - F.floor(before / 2)).otherwise(F.col("start") - pad)
    end = F.when(after < 2 * pad, F.col("end") + F.floor(after / 2)).otherwise(F.least(length, F.col("end") + pad))
    return near.select(
        *[c for c in regions.columns if c not in ("start", "end")],
        F.greatest(start, F.lit(0)).cast("bigint").alias("start"),
        end.cast("bigint").alias("end"),
    )


def fill_gaps(
    regions: DataFrame, collar: float = 0, min_on: float = 0, keys: Sequence[str] = KEYS, seq: str = "seq", rows: int = BLOCK_ROWS
) -> DataFrame:
    """Regions that overlap or leave less than ``collar`` between them become one; short ones go."""
    reach = scan(
        regions.select(*keys, seq, "start", "end"), keys, [seq], row_block(seq, rows), peak={"__reach": F.col("end")}
    )
    opens = F.coalesce(F.col("start") > F.col("__reach") + collar, F.lit(True))
    runs = run_ids(reach, keys, seq, opens, rows=rows)
    merged = runs.groupBy(*keys, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.filter(F.col("end") - F.col("start") >= min_on)


# How many sizes of a chunk one block of a lookup covers.
LOOKUP_SIZES = 256


def _first_beyond(rows: DataFrame, limit: Column, value: str, size: float, keys: Sequence[str], seq: str) -> DataFrame:
    """Adds ``__hit``, the ``seq`` of the first row whose ``value`` (which must not fall) exceeds ``limit``."""
    marks = rows.select(*keys, seq, value)
    found = next_mark(
        rows.withColumn("__limit", limit), "__limit", marks, value, keys, [seq], max(size, 1) * LOOKUP_SIZES, strict=True, or_last=False
    )
    return found.withColumn("__hit", F.col(f"mark.{seq}")).drop("mark", "__limit")


def _chunks(rows: DataFrame, target: Column, keys: Sequence[str], seq: str, block: int) -> DataFrame:
    """Adds ``chunk``: the ``seq`` of the last row at or before this one that the jumps to ``target`` visit."""
    ready = cut_lineage(rows.withColumn("__to", target))
    heads = visited(ready, keys, seq, "__to").withColumn("__head", F.col(seq))
    marked = ready.join(heads, [*keys, seq], "left")
    return scan(marked, keys, [seq], row_block(seq, block), latest={"chunk": F.col("__head")}).drop("__to", "__head")


def merge_regions(
    regions: DataFrame,
    max_gap: float,
    max_length: float,
    keys: Sequence[str] = KEYS,
    seq: str = "seq",
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Greedy: a region joins the one before it when the gap is below ``max_gap`` and the joined
    span at most ``max_length``. Every region knows where the next one would begin if it began one: at
    the next wide gap or beyond the longest span; ``seq`` is dense and ends do not fall."""
    slim = regions.select(*keys, seq, "start", "end")
    near = neighbours(slim, keys, seq, prev={"__pe": F.col("end")}, rows=rows)
    wide = F.when(F.col("start") - F.col("__pe") >= max_gap, F.col(seq))
    ahead = scan(near, keys, [seq], row_block(seq, rows), upcoming={"__gap": wide})
    after = neighbours(ahead, keys, seq, next={"__next_gap": F.col("__gap"), "__next": F.col(seq)}, rows=rows)
    beyond = _first_beyond(cut_lineage(after), F.col("start") + max_length, "end", max_length, keys, seq)
    over = F.when(F.col("__hit") > F.col(seq), F.col("__hit")).when(F.col("__hit").isNotNull(), F.col("__next"))
    packed = _chunks(beyond, F.least(over, F.col("__next_gap")), keys, seq, rows)
    return packed.groupBy(*keys, "chunk").agg(F.min("start").alias("start"), F.max_by("end", seq).alias("end")).drop("chunk")


def pad_edges(segments: DataFrame, padding: float, keys: Sequence[str] = KEYS, seq: str = "seq", rows: int = BLOCK_ROWS) -> DataFrame:
    """Every segment widened by ``padding``, taken back where neighbours then overlap."""
    wide = segments.withColumn("start", F.greatest(F.col("start") - padding, F.lit(0))).withColumn("end", F.col("end") + padding)
    near = neighbours(wide, keys, seq, prev={"__pe": F.col("end")}, next={"__ns": F.col("start")}, rows=rows)
    left_end = F.when(F.col("__pe") > F.col("start"), F.col("__pe") - padding).otherwise(F.col("__pe"))
    return near.withColumn(
        "start", F.when(F.col("start") < left_end, F.col("start") + padding).otherwise(F.col("start"))
    ).withColumn("end", F.when(F.col("end") > F.col("__ns"), F.col("end") - padding).otherwise(F.col("end"))).select(*segments.columns)


def pack_by_span(segments: DataFrame, size: float, keys: Sequence[str] = KEYS, seq: str = "seq", rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``chunk``, the ``seq`` of the chunk's first segment: a chunk is closed before its span
    would exceed ``size``. ``seq`` is dense, ends do not fall. A chunk that so far only holds segments
    of no length at its origin takes one more."""
    near = neighbours(segments.select(*keys, seq, "start", "end"), keys, seq, next={"__next": F.col(seq)}, rows=rows)
    slim = cut_lineage(near)
    beyond = _first_beyond(slim, F.col("start") + size, "end", size, keys, seq)
    empty = _first_beyond(beyond.withColumnRenamed("__hit", "__over"), F.col("start"), "end", size, keys, seq)
    last = slim.groupBy(*keys).agg(F.max(seq).alias("__last"))
    known = spread_lookup(empty, last, keys, F.col(seq))
    # the first segment past the span, but not before one that follows a segment of some length
    target = F.greatest(F.col("__over"), F.col(seq) + 1, F.col("__hit") + 1)
    target = F.when(F.col("__over").isNotNull() & (target <= F.col("__last")), target)
    return _chunks(known, target, keys, seq, rows).select(*keys, seq, "start", "end", "chunk")


def pack_by_speech(segments: DataFrame, size: float, keys: Sequence[str] = KEYS, seq: str = "seq", rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``chunk``: segments are stitched while their summed speech stays within ``size``. ``seq`` is
    dense; sums are exact for whole numbers."""
    length = F.col("end") - F.col("start")
    near = neighbours(segments.select(*keys, seq, "start", "end"), keys, seq, next={"__next": F.col(seq)}, rows=rows)
    summed = cut_lineage(scan(near, keys, [seq], row_block(seq, rows), total={"__sum": length}))
    beyond = _first_beyond(summed, F.col("__sum") - length + size, "__sum", size, keys, seq)
    target = F.when(F.col("__hit") > F.col(seq), F.col("__hit")).when(F.col("__hit").isNotNull(), F.col("__next"))
    return _chunks(beyond, target, keys, seq, rows).select(*keys, seq, "start", "end", "chunk")


def join_members(chunked: DataFrame, max_gap: float, keys: Sequence[str] = KEYS, seq: str = "seq", rows: int = BLOCK_ROWS) -> DataFrame:
    """Members of a chunk with less than ``max_gap`` between them become one member."""
    near = neighbours(chunked, keys, seq, prev={"__pe": F.col("end"), "__pc": F.col("chunk")}, rows=rows)
    goes_on = (F.col("__pc") == F.col("chunk")) & (F.col("start") - F.col("__pe") < max_gap)
    runs = run_ids(near, keys, seq, ~F.coalesce(goes_on, F.lit(False)), rows=rows)
    return runs.groupBy(*keys, "chunk", "run").agg(
        F.min_by("start", seq).alias("start"), F.max_by("end", seq).alias("end"), F.min(seq).alias(seq)
    )


def chunk_table(members: DataFrame, keys: Sequence[str] = KEYS, seq: str = "seq") -> DataFrame:
    """One row per chunk with its members in order."""
    inside = F.array_sort(F.collect_list(F.struct(seq, "start", "end")))
    return members.groupBy(*keys, "chunk").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.transform(inside, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))).alias("stitched"),
    )


# ---- fixed windows -------------------------------------------------------------------------


def fixed_chunks(recordings: DataFrame, chunk_s: int = 29, duration: str = "duration_s") -> DataFrame:
    """Chunks of ``chunk_s`` seconds, the last one clipped; audio under a second gives one chunk."""
    count = F.greatest(F.lit(1), F.ceil(F.floor(duration) / chunk_s))
    out = explode_count(recordings.filter(F.col(duration) > 0), count, "chunk")
    return out.withColumn("start", F.col("chunk") * chunk_s).withColumn(
        "end", F.when(F.col("chunk") == count - 1, F.least(F.col(duration), (F.col("chunk") + 1) * chunk_s)).otherwise((F.col("chunk") + 1) * chunk_s)
    )


def margin_windows(recordings: DataFrame, size: int, margin: int, total: str = "n_frames") -> DataFrame:
    """Overlapping windows and the frames each contributes once its margins are dropped at seams."""
    stride = size - 2 * margin
    n = F.col(total)
    count = F.when(n < size, F.lit(1)).otherwise(F.floor((n - size) / stride) + 2)
    out = explode_count(recordings.filter(n > 0).withColumn("__count", count), F.col("__count"), "window")
    first, last = F.col("window") == 0, F.col("window") == F.col("__count") - 1
    begin = F.col("window") * stride
    return out.select(
        *recordings.columns,
        "window",
        begin.alias("start_frame"),
        F.least(begin + size, n).alias("end_frame"),
        F.when(first, begin).otherwise(begin + margin).alias("keep_from"),
        F.when(last, n).otherwise(begin + size - margin).alias("keep_to"),
    )


def centred_windows(recordings: DataFrame, window: int, step: int, total: str = "n_samples") -> DataFrame:
    """Windows centred on every ``step``-th sample and the time span each one stands for (clamped)."""
    n = F.col(total)
    out = explode_count(recordings, F.ceil((F.lit(window // 2) + n) / step), "window")
    left = F.col("window") * step - window // 2
    return out.select(
        *recordings.columns,
        "window",
        F.greatest(left, F.lit(0)).alias("from_sample"),
        F.least(left + window, n).alias("to_sample"),
        F.greatest((F.col("window") * 2 - 1) * step / 2, F.lit(0.0)).alias("start"),
        F.least((F.col("window") * 2 + 1) * step / 2, n.cast("double")).alias("end"),
    )


# ---- silence removal and its inverse -------------------------------------------------------


def silence_before(regions: DataFrame, keys: Sequence[str] = KEYS, seq: str = "seq", rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``silence`` (time cut out before the region) and ``packed_end`` (its end once packed)."""
    near = neighbours(regions, keys, seq, prev={"__pe": F.col("end")}, rows=rows)
    gap = F.col("start") - F.coalesce(F.col("__pe"), F.lit(0))
    out = scan(near, keys, [seq], row_block(seq, rows), total={"silence": gap})
    return out.withColumn("packed_end", F.col("end") - F.col("silence")).drop("__pe")


def keep_speech(
    frames: DataFrame, regions: DataFrame, width: int = BLOCK_ROWS, keys: Sequence[str] = KEYS, rows: int = BLOCK_ROWS
) -> DataFrame:
    """Frames inside regions (end exclusive), renumbered without the silence."""
    packed = silence_before(regions, keys, rows=rows).withColumn("__to", F.col("end") - 1)
    hits = points_in_intervals(
        frames, "frame", packed.select(*keys, F.col("start").alias("__from"), "__to", "silence"), "__from", "__to", keys, width
    )
    return hits.select(*frames.columns, (F.col("frame") - F.col("silence")).alias("packed_frame"))


def restore_times(
    words: DataFrame, regions: DataFrame, width: float, keys: Sequence[str] = KEYS, rows: int = BLOCK_ROWS, unit: int = 1
) -> DataFrame:
    """Word times of speech-only audio put back on the original time line.

    A word belongs to the region in which its middle lies (the last region past the end); ``unit``
    is the number of region units per word unit.
    """
    packed = silence_before(regions, keys, rows=rows).select(*keys, "seq", "packed_end", "silence")
    middle = F.floor((F.col("start") + F.col("end")) / 2 * unit)
    found = next_mark(words.withColumn("__mid", middle), "__mid", packed, "packed_end", keys, ["seq"], width, strict=True)
    shift = F.col("mark.silence") / unit
    return found.withColumn("start", F.col("start") + shift).withColumn("end", F.col("end") + shift).drop("mark", "__mid")


def restore_segments(
    segments: DataFrame,
    regions: DataFrame,
    width: float,
    keys: Sequence[str] = KEYS,
    seq: str = "seq",
    rows: int = BLOCK_ROWS,
    unit: int = 1,
    digits: int = 2,
) -> DataFrame:
    """Whole segments (``start, end, words``) of speech-only audio put back on the original time line, times rounded.

    Words go by the region of their middle; a segment then begins with its first and ends with its last word. Without words
    its two edges go each by its own region. A recording without regions keeps its times. Points of all segments are looked
    up at once; what a segment gathers is its own words.
    """
    keys = list(keys)
    packed = silence_before(regions, keys, rows=rows).select(*keys, "seq", "packed_end", "silence")
    spoken = F.coalesce(F.size("words") > 0, F.lit(False))
    point = lambda at, pos: F.struct(pos.cast("int").alias("pos"), F.floor(at * unit).cast("bigint").alias("at"))
    edges = F.array(point(F.col("start"), F.lit(0)), point(F.col("end"), F.lit(1)))
    points = F.when(spoken, F.transform("words", lambda w, i: point((w["start"] + w["end"]) / 2, i))).otherwise(edges)
    known = segments.withColumnRenamed(seq, "__segment")
    asked = known.select(*keys, "__segment", F.explode(points).alias("__p")).select(*keys, "__segment", "__p.pos", "__p.at")
    found = next_mark(asked, "at", packed, "packed_end", keys, ["seq"], width, strict=True)
    entry = F.struct("pos", F.coalesce(F.col("mark.silence") / unit, F.lit(0.0)).alias("by"))
    shifts = found.groupBy(*keys, "__segment").agg(F.array_sort(F.collect_list(entry)).alias("__shifts"))
    moved = lambda value, place: F.round(value + F.get("__shifts", place)["by"], digits)
    words = F.transform(
        "words", lambda w, i: w.withField("start", moved(w["start"], i)).withField("end", moved(w["end"], i))
    )
    out = known.join(shifts, [*keys, "__segment"], "left").withColumn("__words", F.when(spoken, words).otherwise(F.col("words")))
    return out.select(
        *[F.col("__segment").alias(seq) if c == seq else F.col(c) for c in segments.columns if c not in ("start", "end", "words")],
        F.when(spoken, F.get("__words", F.lit(0))["start"]).otherwise(moved(F.col("start"), F.lit(0))).alias("start"),
        F.when(spoken, F.element_at("__words", -1)["end"]).otherwise(moved(F.col("end"), F.lit(1))).alias("end"),
        F.col("__words").alias("words"),
    )


def restore_stitched(words: DataFrame, members: DataFrame, width: float, keys: Sequence[str] = ("recording_id", "chunk"), seq: str = "seq") -> DataFrame:
    """Word times inside a stitched chunk shifted by what lies between its members."""
    inside = Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    packed = members.withColumn("__upto", F.sum(F.col("end") - F.col("start")).over(inside)).select(
        *keys, seq, "__upto", (F.col("end") - F.col("__upto")).alias("__shift")
    )
    found = next_mark(words, "start", packed, "__upto", keys, [seq], width, strict=True)
    shift = F.col("mark.__shift")
    return found.withColumn("start", F.col("start") + shift).withColumn("end", F.col("end") + shift).drop("mark")


# Share of speech, length and level below which a recording counts as silence.
MIN_SPEECH_SHARE = 0.02
MIN_SPEECH_SECONDS = 1.0
MIN_LEVEL = 0.01


def silence_verdict(samples: DataFrame, speech: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per recording: speech share, level, and whether it is silence. ``samples`` has ``x`` and
    ``dur``; ``speech`` has ``start``/``end``. Both sides are aggregated before they meet."""
    level = samples.groupBy(*keys).agg(
        F.sum("dur").alias("duration"), F.max(F.abs("x")).alias("peak"), F.stddev_pop("x").alias("rms")
    )
    spoken = speech.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("speech"))
    both = level.join(spoken, list(keys), "left").fillna(0, ["speech"])
    silent = (
        (F.col("speech") / F.col("duration") < MIN_SPEECH_SHARE)
        | (F.col("speech") < MIN_SPEECH_SECONDS)
        | (F.col("peak") < MIN_LEVEL)
        | (F.col("rms") < MIN_LEVEL)
    )
    return both.withColumn("silence", silent)


def removed_duration(speech: DataFrame, recordings: DataFrame, keys: Sequence[str] = KEYS, duration: str = "duration") -> DataFrame:
    """Duration before and after silence removal."""
    spoken = speech.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("duration_after_vad"))
    return recordings.join(spoken, list(keys), "left").fillna(0, ["duration_after_vad"])

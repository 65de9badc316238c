"""Jobs on frame scores, speech regions and chunks."""

from pyspark.sql import functions as F

from speechtables.catalog import job
from speechtables.catalog import tables as t
from speechtables.operators import regions as op

LENGTHS = "lengths as (select recording_id, max(frame) + 1 as n from frames group by recording_id)"


def _lengths(spark, sf):
    return t.frames(spark, sf).groupBy("recording_id").agg((F.max("frame") + 1).alias("n"))


@job("speech_regions_v1", t.sql("regions", 'select recording_id, seq, start, "end" from regions'))
def speech_regions(spark, sf):
    return t.regions(spark, sf).select("recording_id", "seq", "start", "end")


_GREEDY = """with recursive {prep} walk as (
        select recording_id, seq, start, "end", {first} from items where seq = 0
        union all
        select i.recording_id, i.seq, i.start, i."end", {nxt}
        from walk w join items i on i.recording_id = w.recording_id and i.seq = w.seq + 1)"""


@job(
    "regions_merged_v2_v3",
    t.sql(
        "regions",
        _GREEDY.format(
            prep="items as materialized (select * from regions),",
            first="start as head",
            nxt="""case when i.start - w."end" < 4 and i."end" - w.head <= 12 then w.head else i.start end""",
        )
        + """ select recording_id, head as start, max("end") as "end" from walk group by recording_id, head
              having max("end") - head > 1""",
    ),
)
def merged_regions(spark, sf):
    return op.merge_regions(t.regions(spark, sf), max_gap=4, max_length=12).filter(F.col("end") - F.col("start") > 1)


def _cut_sql(on: float, off: float) -> str:
    """Pieces of regions over eight frames, walked piece by piece, padded by 200 ms."""
    return f"""with recursive states as (select *, coalesce(last_value(case when prob >= {on} then 1 when prob < {off} then 0 end ignore nulls)
            over (partition by recording_id order by frame rows unbounded preceding), 0) as active from frames),
        found as (select recording_id, min(frame) as region_start, max(frame) as region_end
                  from (select *, sum(1 - active) over (partition by recording_id order by frame) as run from states)
                  where active = 1 group by recording_id, run),
        walk as (
            select recording_id, region_start, region_end, region_start as start_frame from found
            union all
            select w.recording_id, w.region_start, w.region_end,
                   (select f.frame from frames f where f.recording_id = w.recording_id and f.frame >= w.start_frame + 4
                    and f.frame < w.start_frame + 8 order by f.prob, f.frame limit 1) + 1
            from walk w where w.region_end - w.start_frame > 8),
        pieces as (select *, lead(start_frame) over (partition by recording_id, region_start order by start_frame) - 1 as cut from walk),
        timed as (select recording_id, region_start, start_frame, coalesce(cut, region_end) as end_frame,
                         start_frame = region_start as first, cut is null as final from pieces),
        padded as (select *, start_frame * 20 - case when first then 200 else 0 end as start_ms,
                          (end_frame + 1) * 20 + case when final then 200 else 0 end as end_ms from timed)"""


@job("long_regions_cut_v4", t.sql("frames", _cut_sql(0.2, 0.05) + " select * from padded"))
def long_regions(spark, sf):
    frames = t.frames(spark, sf)
    found = op.speech_regions(frames, bos=0.2, eos=0.05)
    return op.pad_pieces(op.cut_long_regions(frames, found, max_frames=8), 20, 200)


@job(
    "regions_clamped_v5",
    t.sql(
        "frames",
        _cut_sql(0.6, 0.4)
        + """, lengths as (select recording_id, (max(frame) + 1) * 20 as duration_ms from frames group by recording_id)
        select recording_id, greatest(start_ms, 0) as start_ms, least(end_ms, duration_ms) as end_ms
        from padded join lengths using (recording_id)
        union all select recording_id, 0, least(29000, duration_ms) from lengths
        where recording_id not in (select recording_id from padded)""",
    ),
)
def clamped(spark, sf):
    frames = t.frames(spark, sf)
    found = op.speech_regions(frames, bos=0.6, eos=0.4)
    pieces = op.pad_pieces(op.cut_long_regions(frames, found, max_frames=8), 20, 200)
    recordings = _lengths(spark, sf).select("recording_id", (F.col("n") * 20).alias("duration_ms"))
    return op.clamp_or_default(pieces, recordings)


@job(
    "voice_activity_v6",
    t.sql(
        "frames",
        # frame by frame; q: where the silence began, c: last silence long enough for a cut, r: speech after it
        """with recursive lengths as (select recording_id, (max(frame) + 1) * 512 as total from frames group by recording_id),
        items as materialized (select recording_id, frame, frame * 512 as pos, prob >= 0.25::double as speech,
                                      prob < 0.25::double - 0.15::double as quiet from frames),
        walk as (
            select recording_id, cast(-1 as bigint) as frame, cast(null as bigint) as o, cast(null as bigint) as q, cast(null as bigint) as c,
                   cast(null as bigint) as r, cast(null as bigint) as a, cast(null as bigint) as b from lengths
            union all
            select recording_id, frame, case when ends then null else o2 end, case when ends then null else q2 end,
                   case when ends then null else c2 end, case when ends then null else r1 end,
                   case when forced then o when ends and q2 - o2 > 320 then o2 end,
                   case when forced then coalesce(c, pos) when ends and q2 - o2 > 320 then q2 end
            from (select *, coalesce(quiet and pos - q2 >= 2080, false) as ends from (
                select *, case when quiet and pos - q2 > 1568 then q2 else c1 end as c2 from (
                  select *, case when o2 is not null and not opens and quiet then coalesce(q1, pos) else q1 end as q2 from (
                    select *, case when opens then pos when forced then case when r0 >= c then r0 end else o end as o2,
                           case when forced then null else q0 end as q1, case when forced then null else c end as c1,
                           case when forced then null else r0 end as r1 from (
                      select *, speech and o is null as opens, coalesce(pos - o > 17728, false) as forced from (
                        select w.recording_id, i.frame, i.pos, i.speech, i.quiet, w.o, w.c, case when i.speech then null else w.q end as q0,
                               case when i.speech and w.q is not null and w.c is not null and (w.r is null or w.r < w.c) then i.pos else w.r end as r0
                        from walk w join items i on i.recording_id = w.recording_id and i.frame = w.frame + 1))))))),
        ends as (select recording_id, a, b from walk where a is not null
                 union all select recording_id, o, total from walk join lengths using (recording_id)
                 where (frame + 1) * 512 = total and total - o > 320)
        select recording_id, a as start, b as "end" from ends""",
    ),
)
def voice_activity(spark, sf):
    return op.voice_activity(
        t.frames(spark, sf), threshold=0.25, min_speech_ms=20, max_speech_s=1.2, min_silence_ms=130, pad_ms=30
    )


@job(
    "regions_padded_v7",
    t.sql(
        "regions",
        f"""with {LENGTHS},
        near as (select *, start - lag("end") over w as b, lead(start) over w - "end" as a
                 from regions join lengths using (recording_id) window w as (partition by recording_id order by seq))
        select recording_id, seq, greatest(0, case when b < 4 then start - b // 2 else start - 2 end) as start,
            case when a < 4 then "end" + a // 2 else least(n, "end" + 2) end as "end" from near""",
    ),
)
def padded(spark, sf):
    from speechtables.plans.skew import spread_lookup

    regions = spread_lookup(t.regions(spark, sf), _lengths(spark, sf), ["recording_id"], F.col("seq"))
    return op.pad_regions(regions, 2, F.col("n")).select("recording_id", "seq", "start", "end")


@job(
    "binarized_v8",
    t.sql(
        "frames",
        f"""with {LENGTHS},
        states as (select *, coalesce(last_value(case when prob > 0.3 then 1 when prob < 0.15 then 0 end ignore nulls)
            over (partition by recording_id order by frame rows unbounded preceding), 0) as active from frames)
        select recording_id, min(frame) as start_frame, least(max(frame) + 1, min(n) - 1) as end_frame
        from (select *, sum(1 - active) over (partition by recording_id order by frame) as run from states)
             join lengths using (recording_id)
        where active = 1 group by recording_id, run""",
    ),
)
def binarized(spark, sf):
    return op.binarize(t.frames(spark, sf), 0.3, 0.15).select("recording_id", "start_frame", "end_frame")


@job(
    "binarized_with_limit_v8",
    t.sql(
        "frames",
        # frame by frame; seen: scores gathered and their frames
        """with recursive lengths as (select recording_id, max(frame) as final from frames group by recording_id),
        walk as (
            select recording_id, frame, prob > 0.2 as on_now, frame as s, [{'y': prob, 't': frame}] as seen,
                   cast(null as bigint) as a, cast(null as bigint) as b from frames where frame = 0
            union all
            select recording_id, frame, case when cut then true when closing then false when on_now then true else prob > 0.2 end,
                   case when cut then low.t when closing then frame when on_now then s when prob > 0.2 then frame else s end,
                   case when cut then list_append(list_filter(seen, lambda x: x.t > low.t), now) when closing then [now]
                        when on_now then list_append(seen, now) else seen end,
                   case when cut or closing then s end, case when cut then low.t when closing then frame end
            from (select *, on_now and not cut and prob < 0.05 as closing from (
                select w.recording_id, i.frame, i.prob, w.on_now, w.s, w.seen, {'y': i.prob, 't': i.frame} as now,
                       w.on_now and i.frame - w.s > 6 as cut, list_min(w.seen[len(w.seen) // 2 + 1:]) as low
                from walk w join frames i on i.recording_id = w.recording_id and i.frame = w.frame + 1)))
        select recording_id, a as start_frame, b as end_frame from walk where a is not null
        union all select recording_id, s, frame from walk join lengths using (recording_id) where frame = final and on_now""",
    ),
)
def binarized_limited(spark, sf):
    return op.binarize_limited(t.frames(spark, sf), 0.2, max_frames=6, offset=0.05)


@job(
    "binarized_padded_v8",
    t.sql(
        "frames",
        f"""with {LENGTHS},
        states as (select *, coalesce(last_value(case when prob > 0.3 then 1 when prob < 0.15 then 0 end ignore nulls)
            over (partition by recording_id order by frame rows unbounded preceding), 0) as active from frames),
        found as (select recording_id, min(frame) - 1 as start, least(max(frame) + 1, min(n) - 1) + 2 as "end"
            from (select *, sum(1 - active) over (partition by recording_id order by frame) as run from states)
                 join lengths using (recording_id) where active = 1 group by recording_id, run),
        reach as (select *, max("end") over (partition by recording_id order by start rows between unbounded preceding and 1 preceding) as r from found),
        runs as (select *, sum(case when r is null or start > r + 1 then 1 else 0 end) over (partition by recording_id order by start) as run from reach)
        select recording_id, min(start) as start, max("end") as "end" from runs group by recording_id, run
        having max("end") - min(start) >= 8""",
    ),
)
def binarized_padded(spark, sf):
    return op.active_regions(t.frames(spark, sf), 0.3, 0.15, pad_onset=1, pad_offset=2, min_off=1, min_on=8)


@job(
    "gaps_filled_v9",
    t.sql(
        "turns",
        """with reach as (select *, max(end_us) over (partition by recording_id order by seq rows between unbounded preceding and 1 preceding) as r from turns),
        runs as (select *, sum(case when r is null or start_us > r + 600000000 then 1 else 0 end) over (partition by recording_id order by seq) as run from reach)
        select recording_id, cast(run as bigint) as run, min(start_us) as start, max(end_us) as "end" from runs group by recording_id, run
        having max(end_us) - min(start_us) >= 60000000""",
    ),
)
def gaps_filled(spark, sf):
    turns = t.turns(spark, sf).withColumnsRenamed({"start_us": "start", "end_us": "end"})
    return op.fill_gaps(turns, collar=600_000_000, min_on=60_000_000)


_PADDED = """wide as (select recording_id, seq, greatest(start - 1, 0) as start, "end" + 1 as "end" from regions),
    near as (select *, lag("end") over w as pe, lead(start) over w as ns from wide window w as (partition by recording_id order by seq)),
    items as materialized (select recording_id, seq, case when start < (case when pe > start then pe - 1 else pe end) then start + 1 else start end as start,
                 case when "end" > ns then "end" - 1 else "end" end as "end" from near),"""


@job(
    "chunks_by_span_v10",
    t.sql(
        "regions",
        _GREEDY.format(
            prep=_PADDED,
            first='seq as chunk, start as origin, "end" as reach',
            nxt="""case when i."end" - w.origin > 10 and w.reach - w.origin > 0 then i.seq else w.chunk end,
                   case when i."end" - w.origin > 10 and w.reach - w.origin > 0 then i.start else w.origin end, i."end" """,
        )
        + """ select recording_id, chunk, min(start) as start, max("end") as "end", count(*) as members from walk group by recording_id, chunk""",
    ),
)
def chunks_by_span(spark, sf):
    packed = op.pack_by_span(op.pad_edges(t.regions(spark, sf), 1), 10)
    return packed.groupBy("recording_id", "chunk").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("members")
    )


_STITCH = (
    _GREEDY.format(
        prep="items as materialized (select * from regions),",
        first='seq as chunk, "end" - start as speech',
        nxt="""case when w.speech + i."end" - i.start > 6 then i.seq else w.chunk end,
               case when w.speech + i."end" - i.start > 6 then i."end" - i.start else w.speech + i."end" - i.start end""",
    )
)


@job(
    "stitched_chunks_v11",
    t.sql(
        "regions",
        _STITCH
        + """, marked as (select *, case when start - lag("end") over (partition by recording_id, chunk order by seq) < 3 then 0 else 1 end as opens from walk),
        runs as (select *, sum(opens) over (partition by recording_id, chunk order by seq) as run from marked),
        members as (select recording_id, chunk, min(seq) as seq, arg_min(start, seq) as start, arg_max("end", seq) as "end" from runs group by recording_id, chunk, run)
        select recording_id, chunk, seq, start, "end" from members""",
    ),
)
def stitched(spark, sf):
    return op.join_members(op.pack_by_speech(t.regions(spark, sf), 6), 3).drop("run")


@job(
    "stitched_chunk_rows_v11",
    t.sql(
        "regions",
        _STITCH
        + """ select recording_id, chunk, min(start) as start, max("end") as "end",
            list(struct_pack(start := start, "end" := "end") order by seq) as stitched from walk group by recording_id, chunk""",
    ),
)
def stitched_rows(spark, sf):
    return op.chunk_table(op.pack_by_speech(t.regions(spark, sf), 6))


@job(
    "fixed_chunks_v12",
    t.sql(
        "jobs",
        """select job, chunk, chunk * 29 as start, least((chunk + 1) * 29, duration_s) as "end"
        from (select job, duration_s, unnest(generate_series(0, greatest(ceil(duration_s / 29.0), 1)::bigint - 1)) as chunk
              from jobs where duration_s > 0)""",
    ),
)
def fixed(spark, sf):
    return op.fixed_chunks(t.jobs(spark, sf)).select("job", "chunk", "start", "end")


@job(
    "margin_windows_v13",
    t.sql(
        "frames",
        f"""with {LENGTHS},
        counted as (select *, case when n < 16 then 1 else (n - 16) // 12 + 2 end as c from lengths),
        w as (select *, unnest(generate_series(0, c - 1)) as win from counted)
        select recording_id, n, win as "window", win * 12 as start_frame, least(win * 12 + 16, n) as end_frame,
            case when win = 0 then 0 else win * 12 + 2 end as keep_from, case when win = c - 1 then n else win * 12 + 14 end as keep_to from w""",
    ),
)
def margin(spark, sf):
    return op.margin_windows(_lengths(spark, sf), size=16, margin=2, total="n")


@job(
    "centred_windows_v14",
    t.sql(
        "frames",
        f"""with {LENGTHS}, w as (select *, unnest(generate_series(0, ceil((4 + n) / 3.0)::bigint - 1)) as win from lengths)
        select recording_id, n, win as "window", greatest(win * 3 - 4, 0) as from_sample, least(win * 3 - 4 + 8, n) as to_sample,
            greatest((win * 2 - 1) * 3 / 2, 0.0::double) as start, least((win * 2 + 1) * 3 / 2, n::double) as "end" from w""",
    ),
)
def centred(spark, sf):
    return op.centred_windows(_lengths(spark, sf), window=8, step=3, total="n")


@job(
    "speech_only_frames_v16",
    t.sql(
        "regions",
        """select f.recording_id, frame, row_number() over (partition by f.recording_id order by frame) - 1 as packed_frame
        from frames f join regions r on f.recording_id = r.recording_id and frame >= r.start and frame < r."end" """,
    ),
)
def speech_only(spark, sf):
    return op.keep_speech(t.frames(spark, sf), t.regions(spark, sf)).select("recording_id", "frame", "packed_frame")


_PIECES = """pieces as (select conv_id as recording_id, turn as seq, turn * 12000 + 1000 * (turn % 3) as start,
        turn * 12000 + 1000 * (turn % 3) + 8000 as "end" from conversations)"""


def _pieces(spark, sf):
    start = F.col("turn") * 12000 + F.col("turn") % 3 * 1000
    return t.read(spark, sf, "conversations").select(
        F.col("conv_id").alias("recording_id"), F.col("turn").alias("seq"), start.alias("start"), (start + 8000).alias("end")
    )


def _words(spark, sf):
    return t.words(spark, sf).withColumnsRenamed({"start_ms": "start", "end_ms": "end"})


@job(
    "original_times_v17",
    t.sql(
        "words",
        f"""with {_PIECES},
        packed as (select *, "end" - silence as upto, lag("end" - silence, 1, -1) over w as since, seq = max(seq) over (partition by recording_id) as final
            from (select *, sum(start - coalesce(pe, 0)) over (partition by recording_id order by seq) as silence
                  from (select *, lag("end") over (partition by recording_id order by seq) as pe from pieces))
            window w as (partition by recording_id order by seq))
        select w.recording_id, w.seq, w.pos, w.start_ms + silence::double as start, w.end_ms + silence::double as "end"
        from words w join packed p on w.recording_id = p.recording_id
            and (w.start_ms + w.end_ms) // 2 >= since and ((w.start_ms + w.end_ms) // 2 < upto or final)""",
    ),
)
def original_times(spark, sf):
    return op.restore_times(_words(spark, sf), _pieces(spark, sf), width=600_000).select(
        "recording_id", "seq", "pos", "start", "end"
    )


@job(
    "original_segments_v17",
    t.sql(
        "words",
        f"""with {_PIECES},
        packed as (select *, "end" - silence as upto, lag("end" - silence, 1, -1) over w as since, seq = max(seq) over (partition by recording_id) as final
            from (select *, sum(start - coalesce(pe, 0)) over (partition by recording_id order by seq) as silence
                  from (select *, lag("end") over (partition by recording_id order by seq) as pe from pieces))
            window w as (partition by recording_id order by seq)),
        moved as (select w.recording_id, w.seq, w.pos, w.word, round(w.start_ms + silence::double, -1) as s, round(w.end_ms + silence::double, -1) as e
            from words w join packed p on w.recording_id = p.recording_id
                and (w.start_ms + w.end_ms) // 2 >= since and ((w.start_ms + w.end_ms) // 2 < upto or final) where w.seq % 3 <> 2),
        bare as (select recording_id, seq, min(start_ms) as a, max(end_ms) as b from words where seq % 3 = 2 group by recording_id, seq)
        select recording_id, seq, min(s) as start, arg_max(e, pos) as "end", list({{'word': word, 'start': s, 'end': e}} order by pos) as words
        from moved group by recording_id, seq
        union all select b.recording_id, b.seq, round(a + p.silence::double, -1), round(b.b + q.silence::double, -1), null from bare b
            join packed p on p.recording_id = b.recording_id and a >= p.since and (a < p.upto or p.final)
            join packed q on q.recording_id = b.recording_id and b.b >= q.since and (b.b < q.upto or q.final)""",
    ),
)
def original_segments(spark, sf):
    """Every third segment comes without words; times rounded to ten milliseconds."""
    item = F.struct("pos", "word", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    rows = _words(spark, sf).groupBy("recording_id", "seq").agg(F.array_sort(F.collect_list(item)).alias("w"))
    words = F.transform("w", lambda w: F.struct(w["word"].alias("word"), w["start"].alias("start"), w["end"].alias("end")))
    segments = rows.select(
        "recording_id",
        "seq",
        F.array_min(F.transform("w", lambda w: w["start"])).alias("start"),
        F.array_max(F.transform("w", lambda w: w["end"])).alias("end"),
        F.when(F.col("seq") % 3 != 2, words).alias("words"),
    )
    return op.restore_segments(segments, _pieces(spark, sf), width=600_000, digits=-1)


@job(
    "stitched_times_v18",
    t.sql(
        "words",
        f"""with {_PIECES},
        members as (select recording_id, seq // 3 as chunk, seq, start, "end" from pieces),
        packed as (select *, lag(upto, 1, -1) over w as since, seq = max(seq) over (partition by recording_id, chunk) as final, "end" - upto as shift
            from (select *, sum("end" - start) over (partition by recording_id, chunk order by seq) as upto from members)
            window w as (partition by recording_id, chunk order by seq)),
        rel as (select *, seq // 3 as chunk, start_ms - (seq // 3) * 30000 as s, end_ms - (seq // 3) * 30000 as e from words)
        select r.recording_id, r.seq, r.pos, cast(s + shift as bigint) as start, cast(e + shift as bigint) as "end"
        from rel r join packed p on r.recording_id = p.recording_id and r.chunk = p.chunk and s >= since and (s < upto or final)""",
    ),
)
def stitched_times(spark, sf):
    chunk = F.expr("seq div 3")
    words = _words(spark, sf).withColumn("chunk", chunk)
    words = words.withColumn("start", F.col("start") - F.col("chunk") * 30000).withColumn("end", F.col("end") - F.col("chunk") * 30000)
    members = _pieces(spark, sf).withColumn("chunk", chunk)
    return op.restore_stitched(words, members, width=600_000).select("recording_id", "seq", "pos", "start", "end")


@job(
    "silence_verdict_v19",
    t.sql(
        "regions",
        """with lv as (select recording_id, count(*) as duration, max(abs(prob - 0.1::double)) as peak, stddev_pop(prob - 0.1::double) as rms from frames group by recording_id),
        sp as (select recording_id, sum("end" - start) as speech from regions group by recording_id)
        select recording_id, cast(duration as bigint) as duration, cast(coalesce(speech, 0) as bigint) as speech, peak, round(rms, 9) as rms,
            coalesce(speech, 0) / duration < 0.02 or coalesce(speech, 0) < 1 or peak < 0.01 or rms < 0.01 as silence
        from lv left join sp using (recording_id)""",
    ),
)
def silence(spark, sf):
    samples = t.frames(spark, sf).select("recording_id", (F.col("prob") - 0.1).alias("x"), F.lit(1).cast("bigint").alias("dur"))
    found = op.silence_verdict(samples, t.regions(spark, sf))
    return found.select("recording_id", "duration", "speech", "peak", F.round("rms", 9).alias("rms"), "silence")


@job(
    "removed_duration_v20",
    t.sql(
        "regions",
        f"""with {LENGTHS} select recording_id, n, cast(coalesce(sum("end" - start), 0) as bigint) as duration_after_vad
        from lengths left join regions using (recording_id) group by recording_id, n""",
    ),
)
def removed(spark, sf):
    return op.removed_duration(t.regions(spark, sf), _lengths(spark, sf))

"""Jobs on speaker turns and pauses."""

from pyspark.sql import functions as F

from speechtables.catalog import job
from speechtables.catalog import tables as t
from speechtables.operators import turns as op
from speechtables.plans.ordered import with_ordinal

HOUR_US = 3_600_000_000


def _turns(spark, sf):
    return t.turns(spark, sf).withColumnsRenamed({"start_us": "start", "end_us": "end"})


_RESOLVED = """resolved as (
    select recording_id, seq, speaker,
        case when pe > start_us then (start_us + pe) / 2.0::double else start_us::double end as "start",
        case when end_us > ns then (ns + end_us) / 2.0::double else end_us::double end as "end"
    from (select *, lag(end_us) over w as pe, lead(start_us) over w as ns
          from turns window w as (partition by recording_id order by seq)))"""


@job("turn_overlaps_resolved_g1", t.sql("turns", f'with {_RESOLVED} select recording_id, seq, speaker, "start", "end" from resolved'))
def overlaps(spark, sf):
    return op.resolve_overlaps(_turns(spark, sf)).select("recording_id", "seq", "speaker", "start", "end")


@job(
    "turns_merged_g2",
    t.sql(
        "turns",
        f"""with {_RESOLVED},
        marked as (select *, case when lag("end") over w = "start" and lag(speaker) over w = speaker then 0 else 1 end as opens
                   from resolved window w as (partition by recording_id order by seq)),
        runs as (select *, sum(opens) over (partition by recording_id order by seq) as run from marked)
        select recording_id, cast(run as bigint) as run, arg_min("start", seq) as "start", arg_max("end", seq) as "end",
               min(speaker) as speaker, min(seq) as seq
        from runs group by recording_id, run""",
    ),
)
def merged(spark, sf):
    return op.merge_same_speaker(op.resolve_overlaps(_turns(spark, sf)))


@job(
    "pause_groups_v15",
    t.sql(
        "turns",
        f"""with marked as (select *, case when start_us - lag(end_us) over w > {HOUR_US} then 1
                when lag(end_us) over w is null then 1 else 0 end as opens
            from turns window w as (partition by recording_id order by seq)),
        runs as (select *, sum(opens) over (partition by recording_id order by seq) as grp from marked)
        select recording_id, cast(grp as bigint) as grp, min(start_us) as "start", max(end_us) as "end", count(*) as regions
        from runs group by recording_id, grp""",
    ),
)
def pauses(spark, sf):
    grouped = op.group_by_gap(_turns(spark, sf), HOUR_US)
    return grouped.groupBy("recording_id", "grp").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("regions")
    )


@job(
    "speakers_by_first_appearance_g5",
    t.sql(
        "ev",
        """with firsts as (select recording_id, event_type, min(seq) as f from ev group by all),
        ids as (select *, cast(row_number() over (partition by recording_id order by f) - 1 as integer) as speaker from firsts)
        select ev.recording_id, seq, event_type as label, speaker from ev join ids using (recording_id, event_type)""",
    ),
)
def numbered(spark, sf):
    labelled = t.events(spark, sf).select("recording_id", "seq", F.col("event_type").alias("label"))
    return op.number_speakers(labelled, "label")


def _scores_sql() -> str:
    return ", ".join(f"((event_id * {7919 * (s + 3)} + seq * {s * s + 1}) % 101) / 100.0::double" for s in range(4))


@job(
    "overlap_speech_turns_g25",
    t.sql(
        "ev",
        f"""with turns as (select recording_id, seq, us as start_us, us + cast(floor(value * 200) as bigint) * 1000000 as end_us, 0 as speaker,
                [{_scores_sql()}] as scores from ev),
        {_RESOLVED},
        ranked as (select r.recording_id, r.seq, r."start", r."end", i - 1 as spk, scores[i] as score,
                row_number() over (partition by r.recording_id, r.seq order by scores[i] desc, i) as rk,
                len(list_filter(scores, lambda x: x > {op.overlap_threshold(4)!r}::double)) as above
            from resolved r join turns using (recording_id, seq), range(1, 5) as g(i)),
        lists as (select recording_id, seq, "start", "end", spk, 'main' as kind, -1 as part from ranked where rk = 1
            union all select recording_id, seq, "start", "end", spk, 'overlap', spk from ranked where rk = 2 and above > 1),
        marked as (select *, case when lag("end") over w = "start" and lag(spk) over w = spk then 0 else 1 end as opens
            from lists window w as (partition by recording_id, kind, part order by seq)),
        runs as (select *, sum(opens) over (partition by recording_id, kind, part order by seq) as run from marked)
        select recording_id, kind, arg_min("start", seq) as "start", arg_max("end", seq) as "end", cast(min(spk) as integer) as speaker
        from runs group by recording_id, kind, part, run""",
    ),
)
def overlap_speech(spark, sf):
    scores = F.array(
        *[
            F.expr(f"((event_id * {7919 * (s + 3)} + seq * {s * s + 1}) % 101) / 100.0D")
            for s in range(4)
        ]
    )
    windows = t.events(spark, sf).select(
        "recording_id",
        "seq",
        F.col("us").alias("start"),
        (F.col("us") + F.floor(F.col("value") * 200) * 1_000_000).alias("end"),
        scores.alias("scores"),
    )
    return op.overlap_turns(windows, "scores", 4)


@job(
    "turns_numbered_o2_o7",
    t.sql("ev", "select recording_id, event_id, us, row_number() over (partition by recording_id order by us, event_id) as id from ev"),
)
def turns_numbered(spark, sf):
    rows = t.read(spark, sf, "events").select(
        F.col("user_id").alias("recording_id"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")
    )
    return with_ordinal(rows, ["recording_id"], ["us", "event_id"], F.expr(f"us div {t.MINUTE_US}"), name="id", base=1)

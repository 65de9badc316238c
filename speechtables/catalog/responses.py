"""The whole way from requests, transcripts and turns to final utterances."""

from pyspark.sql import functions as F

from speechtables.catalog import job
from speechtables.catalog import tables as t
from speechtables.catalog.jobs import _FILLED, _ROUTED
from speechtables.catalog.speakers import _CHANNELS, _J2, TEN_MINUTES_MS, TIMES
from speechtables.catalog.text import punct_sql
from speechtables.operators import jobs as request
from speechtables.operators.responses import job_utterances, job_words


def _hms(x: str) -> str:
    return (
        f"printf('%02d:%02d:%02d.%03d', cast(floor({x} / 3600) as bigint), cast(floor(({x} % 3600.0::double) / 60) as bigint), "
        f"cast(floor(({x} % 3600.0::double) % 60.0::double) as bigint), "
        f"cast(floor((({x} % 3600.0::double) % 60.0::double - floor(({x} % 3600.0::double) % 60.0::double)) * 1000) as bigint))"
    )


@job(
    "job_utterances_p11_p4_f1",
    t.sql(
        "words segments conv_turns jobs",
        f"""with {_FILLED}, {_ROUTED},
        picked as (select *, job as recording_id, case when multi_channel then 'channels' when diarization then 'speakers' else 'plain' end as branch from routed where timestamps in ('s', 'ms', 'hms')),
        {_J2},
        m1 as (select *, row_number() over w as nr, case when lag(speaker) over w = speaker then 0 else 1 end as opens from mapped window w as (partition by recording_id order by seq, piece)),
        r1 as (select *, sum(opens) over (partition by recording_id order by nr) as run from m1),
        {_CHANNELS},
        every as (
            select recording_id, 'plain' as branch, seq as part, cast(null as integer) as speaker, start_ms as s, end_ms as e, text from segments
            union all select recording_id, 'speakers', cast(run as bigint), min(speaker), arg_min(start_ms, nr), arg_max(end_ms, nr), string_agg(text, ' ' order by nr) || ' ' from r1 group by recording_id, run
            union all select recording_id, 'channels', cast(run as bigint), min(channel), arg_min(s, nr), arg_max(e, nr), trim(string_agg(word, '' order by nr)) from runs group by recording_id, run),
        timed as (select every.*, timestamps, s / 1000.0::double + coalesce(offset_start, 0.0::double) as a, e / 1000.0::double + coalesce(offset_start, 0.0::double) as b
            from every join picked using (recording_id, branch))
        select recording_id, branch, part, speaker, {punct_sql('text')} as text,
            case timestamps when 's' then round(a, 3) when 'ms' then round(a * 1000, 3) end as number_start, case timestamps when 's' then round(b, 3) when 'ms' then round(b * 1000, 3) end as number_end,
            case timestamps when 'hms' then {_hms('a')} end as text_start, case timestamps when 'hms' then {_hms('b')} end as text_end from timed where trim(text) <> ''
        union all select recording_id, 'empty', 0, null, '<EMPTY AUDIO>', 0.0::double, duration_s::double, null, null from picked
        where branch = 'speakers' and recording_id not in (select recording_id from conv_turns)""",
    ),
)
def utterances(spark, sf):
    return job_utterances(*_inputs(spark, sf))


@job(
    "job_words_p5_p11",
    t.sql(
        "words segments conv_turns jobs",
        f"""with {_FILLED}, {_ROUTED},
        picked as (select *, job as recording_id, case when multi_channel then 'channels' when diarization then 'speakers' else 'plain' end as branch
            from routed where timestamps in ('s', 'ms', 'hms') and word_timestamps),
        {_J2},
        m1 as (select *, row_number() over w as nr, case when lag(speaker) over w = speaker then 0 else 1 end as opens from mapped window w as (partition by recording_id order by seq, piece)),
        r1 as (select *, sum(opens) over (partition by recording_id order by nr) as run from m1),
        {_CHANNELS},
        every as (
            select recording_id, 'plain' as branch, seq as part, seq as first, pos as second, word, start_ms as s, end_ms as e from words
            union all select n.recording_id, 'speakers', cast(run as bigint), n.seq, n.pos, n.word, n.start_ms, n.end_ms
                from numbered n join r1 on r1.recording_id = n.recording_id and r1.seq = n.seq and r1.piece = n.piece
            union all select recording_id, 'channels', cast(run as bigint), nr - 1, 0, trim(word), s, e from runs)
        select recording_id, branch, part, first, second, word, s / 1000.0::double as start, e / 1000.0::double as "end"
        from every join picked using (recording_id, branch)""",
    ),
)
def utterance_words(spark, sf):
    return job_words(*_inputs(spark, sf)).select("recording_id", "branch", "part", "place.first", "place.second", "word", "start", "end")


def _inputs(spark, sf):
    """Checked jobs, segments, words and turns in milliseconds; every second segment of a multi-channel job is the other channel's."""
    checked = request.validate(request.route(request.with_defaults(t.jobs(spark, sf)))).filter(F.col("error").isNull())
    words = t.words(spark, sf).withColumnsRenamed(TIMES)
    shift = F.col("seq") % 2 * 7000
    multi = checked.filter("multi_channel").select(F.col("job").alias("recording_id"), F.lit(True).alias("multi"))
    words = (
        words.join(multi, "recording_id", "left")
        .withColumn("start", F.when(F.col("multi"), F.col("start") - shift).otherwise(F.col("start")))
        .withColumn("end", F.when(F.col("multi"), F.col("end") - shift).otherwise(F.col("end")))
        .withColumn("channel", (F.col("seq") % 2).cast("int"))
        .withColumn("spoken", F.concat(F.lit(" "), F.col("word")))
        .drop("multi")
    )
    return (
        checked.withColumnRenamed("job", "recording_id"),
        t.segments(spark, sf).withColumnsRenamed(TIMES),
        words,
        t.conv_turns(spark, sf).withColumnsRenamed(TIMES),
        TEN_MINUTES_MS,
    )

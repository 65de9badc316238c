"""Jobs on job requests and response rows."""

from pyspark.sql import functions as F

from speechtables.catalog import job
from speechtables.catalog import tables as t
from speechtables.operators import jobs as op

_FILLED = """filled as (select job, job_name, task_token, coalesce(num_speakers, -1) as num_speakers, coalesce(diarization, false) as diarization,
    coalesce(multi_channel, false) as multi_channel, channels, coalesce(timestamps, 's') as timestamps, offset_start,
    case when len(vocab) > 0 then vocab end as vocab, word_timestamps, duration_s, 'en' as source_lang, false as internal_vad,
    1.2::double as repetition_penalty, 2.4::double as compression_ratio_threshold, -1.0::double as log_prob_threshold, 0.6::double as no_speech_threshold,
    true as condition_on_previous_text, cast(1 as integer) as batch_size, cast(1 as integer) as num_beams from jobs)"""
_ROUTED = """routed as (select job, duration_s, offset_start, word_timestamps, timestamps, diarization or (channels = 1 and multi_channel) as diarization,
    multi_channel and not channels = 1 as multi_channel, case when (channels > 1 and not multi_channel) or channels = 1 then 1 else channels end as channels from filled)"""


def _filled(spark, sf):
    return op.with_defaults(t.jobs(spark, sf))


def _routed(spark, sf):
    return op.route(_filled(spark, sf))


@job("job_defaults_s3_p12", t.sql("jobs", f"with {_FILLED} select *, case when timestamps not in ('s', 'ms', 'hms') then 'Invalid timestamps: ' || timestamps end as error from filled"))
def defaults(spark, sf):
    return op.validate(_filled(spark, sf))


@job(
    "job_routing_p10_p11",
    t.sql(
        "jobs",
        f"""with {_FILLED}, {_ROUTED} select job, diarization, multi_channel, cast(channels as integer) as channels,
        case when multi_channel then 'channels' when diarization then 'speakers' else 'plain' end as branch from routed""",
    ),
)
def routing(spark, sf):
    return op.branch(_routed(spark, sf)).select("job", "diarization", "multi_channel", "channels", "branch")


@job(
    "empty_audio_rows_p7",
    t.sql(
        "jobs conv_turns",
        f"""with {_FILLED}, {_ROUTED} select job, '<EMPTY AUDIO>' as text, 0.0::double as start, duration_s::double as "end", cast(null as integer) as speaker
        from routed where diarization and not multi_channel and job not in (select recording_id from conv_turns)""",
    ),
)
def empty(spark, sf):
    turns = t.conv_turns(spark, sf).withColumnRenamed("recording_id", "job")
    return op.empty_audio(_routed(spark, sf), turns, ["job"])


@job(
    "clipped_frames_p8",
    t.sql(
        "frames jobs",
        """select f.recording_id, frame, prob from frames f join jobs j on f.recording_id = j.job
        where frame >= coalesce(floor(offset_start * 3), 0) and (duration_s < 500 or frame < floor(duration_s / 100.0::double * 3))""",
    ),
)
def clipped(spark, sf):
    jobs = t.jobs(spark, sf).select(
        F.col("job").alias("recording_id"), "offset_start", F.when(F.col("duration_s") >= 500, F.col("duration_s") / 100.0).alias("offset_end")
    )
    return op.clip_frames(t.frames(spark, sf), jobs, ["recording_id"], at="frame", rate=3)


_CLIPS = """clip_jobs as (select job as recording_id, greatest(duration_s, 0) * 100 as n_frames,
    case job % 4 when 0 then '' when 1 then '0.05,0.1,0.2' when 2 then '0.02,0.3' else '0.4' end as c from jobs)"""


def _clips(spark, sf):
    text = F.element_at(F.array(F.lit(""), F.lit("0.05,0.1,0.2"), F.lit("0.02,0.3"), F.lit("0.4")), (F.col("job") % 4 + 1).cast("int"))
    jobs = t.jobs(spark, sf).select(
        F.col("job").alias("recording_id"), (F.greatest(F.col("duration_s"), F.lit(0)) * 100).alias("n_frames"), text.alias("clip_timestamps")
    )
    return op.clip_list(jobs)


_CLIP_ROWS = f"""{_CLIPS}, points as (select *, case when c = '' then [0::bigint] else list_transform(string_split(c, ','), lambda x: cast(round_even(x::double * 100, 0) as bigint)) end as p from clip_jobs),
    closed as (select *, case when len(p) % 2 = 1 then list_append(p, n_frames) else p end as q from points),
    clips as (select recording_id, n_frames, c as clip_timestamps, cast(i as integer) as clip, q[2 * i + 1] as start_frame, q[2 * i + 2] as end_frame
        from (select *, unnest(generate_series(0, len(q) // 2 - 1)) as i from closed))"""


@job("clip_list_p9", t.sql("jobs", f"with {_CLIP_ROWS} select * from clips"))
def clips(spark, sf):
    return _clips(spark, sf)


@job(
    "frames_in_clips_p9_j8",
    t.sql("jobs frames", f"with {_CLIP_ROWS} select f.recording_id, frame, prob, clip, start_frame from frames f join clips c on f.recording_id = c.recording_id and frame >= start_frame and frame < end_frame"),
)
def clip_frames(spark, sf):
    return op.frames_in_clips(t.frames(spark, sf), _clips(spark, sf), ["recording_id"])


@job(
    "scale_profiles_p13",
    t.sql(
        "jobs",
        """select job, i as scale, case when duration_s >= 10800 then [3000, 2000, 1000][i + 1] when duration_s >= 3600 then [3000, 2500, 2000, 1500, 1000][i + 1] else [1500, 1250, 1000, 750, 500][i + 1] end as "window",
            case when duration_s >= 10800 then [750, 500, 250][i + 1] else [750, 625, 500, 375, 250][i + 1] end as shift, 1.0::double as weight
        from (select job, duration_s * 2 as duration_s, cast(unnest(generate_series(0, case when duration_s * 2 >= 10800 then 2 else 4 end)) as integer) as i from jobs)""",
    ),
)
def profiles(spark, sf):
    jobs = t.jobs(spark, sf).select("job", F.explode(op.scale_profile(F.col("duration_s") * 2)).alias("p"))
    return jobs.select("job", "p.*")


@job(
    "channel_durations_p14",
    t.sql("words", "select recording_id, avg(d) as duration from (select recording_id, seq, max(end_ms) - min(start_ms) as d from words group by recording_id, seq) group by recording_id"),
)
def durations(spark, sf):
    files = t.words(spark, sf).groupBy("recording_id", "seq").agg((F.max("end_ms") - F.min("start_ms")).alias("duration"))
    return op.channel_duration(files, ["recording_id"])


def word_segments(spark, sf):
    """Segments with word arrays."""
    item = F.struct("pos", "word", (F.col("start_ms") / 1000.0).alias("start"), (F.col("end_ms") / 1000.0).alias("end"), "probability")
    words = t.words(spark, sf).groupBy("recording_id", "seq").agg(F.array_sort(F.collect_list(item)).alias("words"))
    rows = t.segments(spark, sf).join(words, ["recording_id", "seq"])
    return rows.withColumn("start", F.col("start_ms") / 1000.0).withColumn("end", F.col("end_ms") / 1000.0).drop("start_ms", "end_ms")


@job(
    "formatted_segments_p1_p4_p5",
    t.sql(
        "words segments",
        """select s.recording_id, s.seq, s.text, s.start_ms / 1000.0::double + coalesce(nullif(s.recording_id % 5, 0), 0) as start, s.end_ms / 1000.0::double + coalesce(nullif(s.recording_id % 5, 0), 0) as "end",
            case when s.recording_id % 2 = 0 then w.words end as words
        from segments s join (select recording_id, seq, list({'word': word, 'start': start_ms / 1000.0::double, 'end': end_ms / 1000.0::double, 'probability': probability} order by pos) as words
            from words group by recording_id, seq) w using (recording_id, seq)""",
    ),
)
def formatted(spark, sf):
    rows = op.format_segments(word_segments(spark, sf))
    offset = F.when(F.col("recording_id") % 5 != 0, (F.col("recording_id") % 5).cast("double"))
    rows = op.toggle_words(op.shift_times(rows, offset), F.col("recording_id") % 2 == 0)
    return rows.select("recording_id", "seq", "text", "start", "end", "words")


@job(
    "responses_without_words_p6",
    t.sql("segments", """select recording_id, seq, [{'text': text, 'speaker': speaker}] as utterances from segments"""),
)
def without_words(spark, sf):
    responses = word_segments(spark, sf).select("recording_id", "seq", F.array(F.struct("text", "speaker", "words")).alias("utterances"))
    return op.drop_words(responses)


@job(
    "spoken_segments_p15",
    t.sql("words", """select recording_id, seq, pos, word as text, start_ms as start, end_ms as "end" from words where start_ms <> end_ms and trim(word) <> '' """),
)
def spoken(spark, sf):
    from speechtables.operators.words import keep_spoken

    rows = t.words(spark, sf).select("recording_id", "seq", "pos", F.col("word").alias("text"), F.col("start_ms").alias("start"), F.col("end_ms").alias("end"))
    return keep_spoken(rows)


@job(
    "flat_words_p17",
    t.sql("words", 'select recording_id, seq, cast(pos as integer) as pos, word, start_ms / 1000.0::double as start, end_ms / 1000.0::double as "end", probability from words'),
)
def flat(spark, sf):
    return op.flat_words(op.format_segments(word_segments(spark, sf)), ["recording_id"])


@job(
    "engine_rows_p18",
    t.sql(
        "words segments",
        """select s.recording_id, s.seq, trim(s.text) as text, s.start_ms / 1000.0::double as start, s.end_ms / 1000.0::double as "end",
            list({'word': ' ' || word, 'start': w.start_ms // 100 / 10.0::double, 'end': w.end_ms // 100 / 10.0::double, 'probability': probability} order by pos) as words,
            1 as seek, 1 as id, [1] as tokens, 0.0::double as temperature, 0.0::double as avg_logprob, 0.0::double as compression_ratio, 0.0::double as no_speech_prob
        from segments s join words w using (recording_id, seq) group by s.recording_id, s.seq, s.text, s.start_ms, s.end_ms""",
    ),
)
def engine_rows(spark, sf):
    item = F.struct("pos", "word", (F.expr("start_ms div 100") / 10.0).alias("start"), (F.expr("end_ms div 100") / 10.0).alias("end"), "probability")
    words = t.words(spark, sf).groupBy("recording_id", "seq").agg(F.array_sort(F.collect_list(item)).alias("word_timestamps"))
    rows = t.segments(spark, sf).join(words, ["recording_id", "seq"]).select(
        "recording_id", "seq", "text", (F.col("start_ms") / 1000.0).alias("start_time"), (F.col("end_ms") / 1000.0).alias("end_time"), "word_timestamps"
    )
    return op.normalise_engine_rows(rows, multi_channel=True)


@job(
    "channels_to_speakers_p19",
    t.sql(
        "words",
        """select recording_id, seq as part, cast(pos % 2 as integer) as speaker, cast(pos // 2 as integer) as seq, word as text from words""",
    ),
)
def channel_speakers(spark, sf):
    even, odd = (F.filter("words", lambda w, i: i % 2 == 0), F.filter("words", lambda w, i: i % 2 == 1))
    split = word_segments(spark, sf).select("recording_id", F.col("seq").alias("part"), F.array(even, odd).alias("channels"))
    return op.channels_to_speakers(split).select("recording_id", "part", "speaker", "seq", F.col("segment.word").alias("text"))


@job(
    "chunk_results_j7",
    t.sql(
        "segments jobs",
        """select job as file_id, seq, case speaker when 0 then 'A-' when 1 then 'B-' end || seq as result from jobs left join segments on recording_id = job""",
    ),
)
def chunk_results(spark, sf):
    chunks = t.segments(spark, sf).select(F.col("recording_id").alias("file_id"), "seq")
    results = t.segments(spark, sf).select(
        F.col("recording_id").alias("file_id"), "seq", F.concat(F.when(F.col("speaker") == 0, "A-").otherwise("B-"), F.col("seq").cast("string")).alias("result")
    )
    return op.scatter_results(t.jobs(spark, sf).select(F.col("job").alias("file_id")), chunks, results)

"""Jobs on documents that are read or written, and on streams."""

from pyspark.sql import functions as F

from speechtables.catalog import job
from speechtables.catalog import tables as t
from speechtables.catalog.jobs import _FILLED
from speechtables.operators import jobs as request
from speechtables.operators.affinity import labels_to_turns
from speechtables.operators.responses import response_documents
from speechtables.session import run_folder
from speechtables.sources import documents as doc


@job(
    "object_keys_s2",
    t.sql("jobs", "select job, 'responses/' || coalesce(task_token, 'None') || '_' || coalesce(job_name, 'None') || '.json' as object_key from jobs"),
)
def object_keys(spark, sf):
    return t.jobs(spark, sf).select("job", doc.object_key(F.col("task_token"), F.col("job_name")).alias("object_key"))


@job(
    "manifest_lines_s4",
    t.sql("jobs", """select '{"audio_filepath":"' || job_name || '.wav","offset":0,"duration":null,"label":"infer","text":"-","rttm_filepath":null,"uem_filepath":null}' as value from jobs"""),
)
def manifest(spark, sf):
    return doc.manifest_lines(t.jobs(spark, sf).select(F.concat("job_name", F.lit(".wav")).alias("audio_filepath")))


@job(
    "status_events_s7",
    t.sql(
        "jobs",
        """select 'async_job.speechtables.' || st as event_type, 'speechtables_' || st || '_' || job_name || '_2024_01_01_00_00_' || printf('%02d', job % 60) || '_000000' as event_id,
            cast(5 as integer) as payload_retention_period,
            case when st = 'error' then '{"error":"Invalid timestamps: ' || timestamps || '",' else '{' end
                || '"job_name":"' || job_name || '","task_token":' || coalesce('"' || task_token || '"', 'null') || '}' as payload
        from (select *, case when timestamps = 'sec' then 'error' else 'finished' end as st from jobs)""",
    ),
)
def events(spark, sf):
    checked = request.validate(request.with_defaults(t.jobs(spark, sf)))
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("job") % 60)
    return doc.status_events(checked.withColumn("at", at), "speechtables")


@job(
    "dead_letters_s8",
    t.sql(
        "jobs emb",
        """select cast(job as varchar) as job, 'post_processing' as source, 'Invalid timestamps: ' || timestamps as message from jobs where timestamps = 'sec'
        union all select cast(recording_id as varchar), 'diarization', 'Mismatch of length between cluster_labels and timestamps.' from emb where seg_idx % 7 = 3""",
    ),
)
def dead_letters(spark, sf):
    checked = request.validate(request.with_defaults(t.jobs(spark, sf)))
    windows = t.embeddings(spark, sf).select(
        "recording_id", F.col("seg_idx").alias("i"), (F.col("seg_idx") * 250).alias("offset"), F.lit(500).alias("duration"), "label"
    )
    labelled = labels_to_turns(windows.drop("label"), windows.filter("i % 7 <> 3").select("recording_id", "i", "label"))
    return doc.dead_letters([("post_processing", checked, "job"), ("diarization", labelled, "recording_id")])


@job(
    "response_documents_s1_s2_s3",
    t.sql(
        "jobs segments words timings",
        f"""with {_FILLED},
        said as (select recording_id, seq, count(*) as n_words, arg_min(word, pos) as first_word from words group by all),
        parts as (select s.*, n_words, first_word, row_number() over (partition by s.recording_id order by s.seq) - 1 as place from segments s left join said using (recording_id, seq)),
        spent as (select job, sum(centis) / 100.0::double as total, sum(centis) filter (stage = 'click') / 100.0::double as transcription from timings group by job)
        select job_name, 'responses/' || coalesce(task_token, 'None') || '_' || job_name || '.json' as object_key, timestamps, num_speakers, no_speech_threshold,
            duration_s::double as audio_duration, total, transcription, cast(place as integer) as place, text, start_ms / 1000.0::double as start, end_ms / 1000.0::double as "end", speaker,
            case when word_timestamps then cast(n_words as integer) end as n_words, case when word_timestamps then first_word end as first_word
        from filled left join parts on recording_id = job left join spent using (job)""",
    ),
)
def response_files(spark, sf):
    """Requests and responses written as documents and read again."""
    folder = run_folder(spark, "documents")
    t.jobs(spark, sf).drop("job", "duration_s", "channels").write.option("ignoreNullFields", "false").json(f"{folder}/requests")
    asked = doc.read_jobs(spark, f"{folder}/requests")
    known = t.jobs(spark, sf).select(F.col("job").alias("recording_id"), "job_name", F.col("duration_s").alias("audio_duration"))
    word = F.struct("word", (F.col("start_ms") / 1000.0).alias("start"), (F.col("end_ms") / 1000.0).alias("end"), F.lit(1.0).alias("probability"))
    said = t.words(spark, sf).groupBy("recording_id", "seq").agg(F.array_sort(F.collect_list(F.struct("pos", word.alias("w")))).alias("w"))
    parts = t.segments(spark, sf).join(said, ["recording_id", "seq"], "left").select(
        "recording_id",
        F.col("seq").alias("part"),
        "text",
        (F.col("start_ms") / 1000.0).alias("start"),
        (F.col("end_ms") / 1000.0).alias("end"),
        "speaker",
        F.transform("w", lambda w: w["w"]).alias("words"),
    )
    seconds = F.col("centis") / 100.0
    times = t.timings(spark, sf).groupBy(F.col("job").alias("recording_id")).agg(
        (F.sum("centis") / 100.0).alias("total"),
        (F.sum(F.when(F.col("stage") == "click", F.col("centis"))) / 100.0).alias("transcription"),
        F.max(F.when(F.lit(False), seconds)).alias("diarization"),
        F.max(F.when(F.lit(False), seconds)).alias("post_processing"),
    )
    doc.write_responses(response_documents(asked.join(known, "job_name"), parts, times), f"{folder}/responses")
    back = doc.read_responses(spark, f"{folder}/responses", one_per_file=False)
    rows = back.select("*", F.posexplode_outer("utterances").alias("place", "u"))
    return rows.select(
        "job_name",
        doc.object_key(F.col("task_token"), F.col("job_name")).alias("object_key"),
        "timestamps",
        "num_speakers",
        "no_speech_threshold",
        "audio_duration",
        "process_times.total",
        "process_times.transcription",
        "place",
        "u.text",
        "u.start",
        "u.end",
        "u.speaker",
        F.when(F.col("u.words").isNotNull(), F.size("u.words")).alias("n_words"),
        F.element_at("u.words", 1)["word"].alias("first_word"),
    )


@job(
    "transcript_lines_s9",
    t.sql(
        "ref_hyp",
        """select utt_id, cast(0 as integer) as line, utt_id || ':' || chr(9) || 'ref=' || array_to_string(ref, ' ') as value from ref_hyp
        union all select utt_id, cast(1 as integer), utt_id || ':' || chr(9) || 'hyp=' || array_to_string(hyp, ' ') from ref_hyp""",
    ),
)
def transcripts(spark, sf):
    return doc.transcript_lines(t.ref_hyp(spark, sf))


@job("error_report_summary_s10")
def report(spark, sf):
    return doc.error_report(t.ref_hyp(spark, sf))["summary"]

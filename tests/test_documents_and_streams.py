"""Documents on disk, and streams against their batch twins."""

import json

import pytest
from pyspark.sql import functions as F

from speechtables import schemas
from speechtables.operators import jobs as request
from speechtables.operators import turns as turn_op
from speechtables.operators.utterances import reconstruct
from speechtables.sources import documents as doc
from speechtables.streaming import live


def test_responses_read_and_written(spark, tmp_path):
    response = {
        "utterances": [{"text": "Hi.", "start": 0.0, "end": 1.5, "speaker": 1, "words": [{"word": "Hi.", "start": 0.0, "end": 1.5, "probability": 0.9}]}],
        "audio_duration": 1.5,
        "num_speakers": -1,
        "diarization": True,
        "timestamps": "s",
        "vocab": None,
        "process_times": {"total": 0.2, "transcription": 0.1, "diarization": None, "post_processing": 0.0},
        "job_name": "job",
    }
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "r.json").write_text(json.dumps(response, indent=2))
    rows = doc.read_responses(spark, str(tmp_path / "in"))
    row = rows.first()
    assert row.utterances[0].words[0].probability == 0.9 and row.process_times.diarization is None
    doc.write_responses(rows, str(tmp_path / "out"))
    back = doc.read_responses(spark, str(tmp_path / "out"), one_per_file=False)
    assert back.first() == rows.first()
    back = spark.read.json(str(tmp_path / "out"))
    assert back.first()["object_key"] == "responses/None_job.json"
    assert request.drop_words(rows).first().utterances[0].asDict() == {"text": "Hi.", "start": 0.0, "end": 1.5, "speaker": 1}


def test_requests_get_defaults_and_checks(spark, tmp_path):
    lines = [{"job_name": "a"}, {"timestamps": "days", "vocab": []}, {"vocab": ["x", None]}, {"num_speakers": 3, "source_lang": "fr"}]
    (tmp_path / "jobs.json").write_text("\n".join(map(json.dumps, lines)))
    rows = request.validate(doc.read_jobs(spark, str(tmp_path))).collect()
    assert [(r.num_speakers, r.source_lang, r.timestamps, r.no_speech_threshold) for r in rows] == [
        (-1, "en", "s", 0.6),
        (-1, "en", "days", 0.6),
        (-1, "en", "s", 0.6),
        (3, "fr", "s", 0.6),
    ]
    assert [r.error is None for r in rows] == [True, False, False, True] and rows[1].vocab is None
    with pytest.raises(ValueError):
        request.check_scales([1, 2], [1], [1.0])


def test_schemas_are_valid(spark):
    for name in ("SEGMENTS", "TURNS", "FRAMES", "EMBEDDINGS", "JOBS", "RESPONSE", "CHUNK", "STATUS_EVENT", "ERRORS"):
        assert spark.createDataFrame([], getattr(schemas, name)).columns


def test_manifest(spark):
    files = spark.createDataFrame([("a.wav", 3)], "audio_filepath string, offset int")
    line = json.loads(doc.manifest_lines(files).first()["value"])
    assert line == {"audio_filepath": "a.wav", "offset": 3, "duration": None, "label": "infer", "text": "-", "rttm_filepath": None, "uem_filepath": None}


def test_sessions_treat_a_pause_of_the_threshold_like_the_batch(spark, tmp_path):
    second = 1_000_000
    regions = [(0, 0, 0, 2), (0, 1, 5, 6), (0, 2, 10, 11), (0, 3, 14, 15)]  # pauses 3, 4, 3 seconds
    df = spark.createDataFrame(regions, "recording_id bigint, seq bigint, start bigint, end bigint")
    batch = turn_op.group_by_gap(df, 3).groupBy("grp").count().collect()
    rows = df.select("recording_id", F.timestamp_seconds("start").alias("start"), ((F.col("end") - F.col("start")) * second).alias("length_us"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    found = live.run_available(live.speech_sessions(stream, "3 seconds", "1 hour"), str(tmp_path / "run"), "complete").collect()
    assert sorted(r.regions for r in found) == sorted(r["count"] for r in batch) == [2, 2]


def test_utterances_over_several_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(r, i, i * 10, i * 10 + 9, [0, 0, 1, 1, 1, 0][i], f"w{i}") for r in (0, 1) for i in range(6)]
    df = spark.createDataFrame(rows, "recording_id bigint, seq bigint, start bigint, end bigint, speaker int, text string")
    for part in range(3):
        df.filter(F.expr("seq div 2") == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = live.all_utterances(stream, str(tmp_path / "run"))
    got = {(r.recording_id, r.start, r.end, r.speaker, r.text) for r in found.collect()}
    batch = {(r.recording_id, r.start, r.end, r.speaker, r.text) for r in reconstruct(df).collect()}
    assert got == batch and found.count() == len(batch)


def test_status_upsert_over_batches(spark, tmp_path):
    write = live.upsert_status(str(tmp_path / "status"))
    first = spark.createDataFrame([("a", "queued", 1), ("b", "queued", 1)], "job string, status string, ts bigint")
    second = spark.createDataFrame([("a", "finished", 3), ("a", "running", 2)], first.schema)
    write(first, 0)
    write(second, 1)
    write(second, 1)  # a repeated batch changes nothing
    got = {r.job: r.status for r in live.read_status(spark, str(tmp_path / "status")).collect()}
    assert got == {"a": "finished", "b": "queued"}
    assert spark.read.parquet(str(tmp_path / "status" / "version=1")).count() == 1  # only what the batch touched


@pytest.mark.parametrize("files", [1, 3])
def test_streams_read_tables_of_one_file_and_of_many(spark, tmp_path, files):
    from speechtables.catalog import streams

    rows = [(c, turn, "user", f"w{c}-{turn}") for c in range(4) for turn in range(5)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(files)
    table.write.parquet(str(tmp_path / "written"))
    (tmp_path / "in").mkdir()
    if files == 1:
        (next((tmp_path / "written").glob("part-*"))).rename(tmp_path / "in" / "conversations.parquet")
    else:
        table.write.parquet(str(tmp_path / "in" / "conversations.parquet"))
    table.write.parquet(str(tmp_path / "in" / "conversations.parquet-old"))
    assert streams.stream(spark, str(tmp_path / "in"), "conversations").isStreaming
    got = {tuple(r) for r in streams.incremental(spark, str(tmp_path / "in")).select("recording_id", "seq", "text").collect()}
    assert got == {(c, a, " ".join(f"w{c}-{b}" for b in range(a, min(a + 2, 5))) + " ") for c in range(4) for a in (0, 2, 4)}


def test_missing_and_empty_chunks_have_lines(spark, tmp_path):
    from speechtables.catalog import streams

    rows = [(1, "hé", "en"), (2, "", "en"), (3, None, "en"), (4, "a", None), (None, "a", "en")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = [r.value for r in streams.chunk_results(spark, str(tmp_path)).collect()]
    assert sorted(json.loads(v)["chunk_id"] for v in found if v) == [1, 2] and len(found) == 5
    lines = {json.loads(v)["chunk_id"]: v for v in found if v}
    assert lines[1] == '{"chunk_id":1,"source_lang":"en","n_bytes":3,"first_byte":104}'
    assert lines[2] == '{"chunk_id":2,"source_lang":"en","n_bytes":0,"first_byte":null}'

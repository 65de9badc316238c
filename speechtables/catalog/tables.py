"""Speech-shaped tables derived from the driver tables, in Spark and as SQL.

Times are integers (milliseconds or microseconds) so that no comparison depends on rounding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from speechtables.operators.regions import speech_regions
from speechtables.plans.ordered import with_ordinal
from speechtables.session import cut_lineage

MINUTE_US = 60_000_000
SEGMENTS_PER_TASK = 1 << 12


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """Transcript segments: 9 s of speech every 10 s, speakers in pairs of segments."""
    return read(spark, sf, "conversations").select(
        F.col("conv_id").alias("recording_id"),
        F.col("turn").alias("seq"),
        (F.col("turn") * 10000).alias("start_ms"),
        (F.col("turn") * 10000 + 9000).alias("end_ms"),
        F.expr("cast((turn div 2) % 2 as int)").alias("speaker"),
        "text",
    )


def words(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the segments, time shared out by characters.

    Segments are dealt out before they become words, subwords or characters: those stay in their segment's task, which
    gets so few segments, whatever the table's size, that its rows are sorted in memory.
    """
    tokens = F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")
    whole = segments(spark, sf)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-whole.count() // SEGMENTS_PER_TASK))
    exploded = whole.repartition(tasks, "recording_id", "seq").select(
        "recording_id", "seq", "start_ms", F.posexplode(tokens).alias("pos", "word")
    )
    inside = Window.partitionBy("recording_id", "seq")
    upto = inside.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    length = F.length("word").cast("bigint")
    return exploded.select(
        "recording_id",
        "seq",
        "pos",
        "word",
        "start_ms",
        length.alias("n"),
        F.sum(length).over(upto).alias("upto"),
        F.sum(length).over(inside).alias("whole"),
    ).select(
        "recording_id",
        "seq",
        "pos",
        "word",
        F.expr("start_ms + ((upto - n) * 9000) div whole").alias("start_ms"),
        F.expr("start_ms + (upto * 9000) div whole").alias("end_ms"),
        F.expr("((n * 37 + pos) % 100) / 100.0D").alias("probability"),
    )


def conv_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Diarization turns of 8 s, off-phase with the segments."""
    return read(spark, sf, "conversations").select(
        F.col("conv_id").alias("recording_id"),
        F.col("turn").alias("seq"),
        (F.col("turn") * 8000).alias("start_ms"),
        (F.col("turn") * 8000 + 8000).alias("end_ms"),
        (F.col("turn") % 2).cast("int").alias("speaker"),
    )


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events numbered per user in time order."""
    raw = read(spark, sf, "events").select(
        F.col("user_id").alias("recording_id"),
        "event_id",
        "event_type",
        "value",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
    )
    return with_ordinal(raw, ["recording_id"], ["us", "event_id"], F.expr(f"us div {MINUTE_US}"))


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(
        "recording_id",
        "seq",
        F.col("us").alias("start_us"),
        (F.col("us") + F.floor(F.col("value") * 200) * 1_000_000).alias("end_us"),
        (F.col("event_id") % 2).cast("int").alias("speaker"),
    )


def frames(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("recording_id", F.col("seq").alias("frame"), (F.col("value") / 500.0).alias("prob"))


def regions(spark: SparkSession, sf: str) -> DataFrame:
    """Speech regions of the frames (end exclusive), numbered per recording.

    Written once: what follows reads the few regions several times, not the frames.
    """
    found = cut_lineage(
        speech_regions(frames(spark, sf), bos=0.2, eos=0.1).select(
            "recording_id", F.col("start_frame").alias("start"), (F.col("end_frame") + 1).alias("end")
        )
    )
    return with_ordinal(found, ["recording_id"], ["start"], F.expr("start div 65536"))


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select(
        (F.col("vec_id") % 10).alias("recording_id"),
        F.expr("vec_id div 10").alias("seg_idx"),
        F.col("embedding").alias("vec"),
        "label",
    )


def speakers(spark: SparkSession, sf: str) -> DataFrame:
    """Five recordings of two speakers each: vectors whose label shows in one of ten components."""
    told = F.transform("embedding", lambda x, k: x + F.when(k == F.col("label"), 2.0).otherwise(0.0))
    in_order = Window.partitionBy("recording_id").orderBy("vec_id")
    return (
        read(spark, sf, "embeddings")
        .select(F.expr("label div 2").alias("recording_id"), "vec_id", told.cast("array<float>").alias("vec"), "label")
        .withColumn("seg_idx", F.row_number().over(in_order).cast("bigint") - 1)
        .drop("vec_id")
    )


def lang_probs(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select(
        (F.col("doc_id") % 50).alias("recording_id"),
        F.col("doc_id").alias("seg"),
        F.col("lang").alias("language"),
        (F.col("n_chars") % 100).alias("pct"),
    )


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(
        F.expr("recording_id * 1000000 + seq div 6").alias("segment_id"),
        F.expr("cast(seq % 6 as int)").alias("temp_idx"),
        F.expr("-(event_id % 37) / 20.0D").alias("avg_logprob"),
        F.expr("1.5D + (event_id % 23) / 15.0D").alias("compression_ratio"),
        F.expr("(event_id % 100) / 100.0D").alias("no_speech_prob"),
        "event_id",
    )


def ref_hyp(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents as references; hypotheses lose, change and gain words at fixed places."""
    split = read(spark, sf, "documents").select(
        F.col("doc_id").alias("utt_id"), F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "").alias("ref")
    )
    changed = F.transform(
        "ref",
        lambda w, i: F.concat(
            F.when((i + 1) % 17 == 0, F.array().cast("array<string>"))
            .when((i + 1) % 11 == 0, F.array(F.lit("x")))
            .otherwise(F.array(w)),
            F.when((i + 1) % 23 == 0, F.array(F.lit("y"))).otherwise(F.array().cast("array<string>")),
        ),
    )
    return split.select("utt_id", "ref", F.flatten(changed).alias("hyp"))


def turn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Whole turns as references, words cut to two letters so that many repeat; hypotheses lose words, say others
    of the same turn again and gain some."""
    split = F.transform(F.filter(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: w != ""), lambda w: F.lower(F.substring(w, 1, 2)))
    turns = read(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("utt_id"), split.alias("ref"))
    changed = F.transform(
        "ref",
        lambda w, i: F.concat(
            F.when((i + 1) % 7 == 0, F.array().cast("array<string>"))
            .when((i + 1) % 5 == 0, F.array(F.get("ref", i - 2)))
            .otherwise(F.array(w)),
            F.when((i + 1) % 9 == 0, F.array(F.coalesce(F.get("ref", i + 1), F.lit("y")))).otherwise(F.array().cast("array<string>")),
        ),
    )
    return turns.select("utt_id", "ref", F.flatten(changed).alias("hyp"))


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Job requests with gaps to be filled by defaults."""
    return read(spark, sf, "customer").select(
        F.col("c_custkey").alias("job"),
        F.concat(F.col("c_mktsegment"), F.lit("-"), F.col("c_custkey").cast("string")).alias("job_name"),
        F.when(F.col("c_custkey") % 7 != 0, F.concat(F.lit("tok"), F.col("c_nationkey").cast("string"))).alias("task_token"),
        F.when(F.col("c_custkey") % 3 != 0, (F.col("c_custkey") % 5).cast("int")).alias("num_speakers"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey") % 4 == 0).alias("diarization"),
        F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey") % 3 == 0).alias("multi_channel"),
        (F.col("c_custkey") % 3 + 1).cast("int").alias("channels"),
        F.when(F.col("c_custkey") % 4 != 1, F.element_at(F.array(F.lit("s"), F.lit("ms"), F.lit("hms"), F.lit("sec")), (F.col("c_custkey") % 4 + 1).cast("int"))).alias("timestamps"),
        F.when(F.col("c_custkey") % 6 != 0, F.col("c_custkey") % 10).cast("double").alias("offset_start"),
        F.when(F.col("c_custkey") % 8 == 0, F.array().cast("array<string>")).when(F.col("c_custkey") % 8 == 1, F.array("c_mktsegment")).alias("vocab"),
        (F.col("c_custkey") % 2 == 1).alias("word_timestamps"),
        F.floor(F.col("c_acctbal")).alias("duration_s"),
    )


def timings(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select(
        F.col("user_id").alias("job"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.col("event_type").alias("stage"),
        F.floor(F.col("value") * 100).alias("centis"),
        "event_id",
    )


# The same tables as SQL. ``sql("turns", "select ...")`` puts the needed ones in front of a query.
_SQL = {
    "segments": """select conv_id as recording_id, turn as seq, turn * 10000 as start_ms, turn * 10000 + 9000 as end_ms,
        cast((turn // 2) % 2 as integer) as speaker, text from conversations""",
    "word_list": r"""select recording_id, seq, start_ms, unnest(w) as word, generate_subscripts(w, 1) - 1 as pos
        from (select *, list_filter(string_split_regex(trim(text), '\s+'), lambda x: x <> '') as w from segments)""",
    "words": """select recording_id, seq, pos, word, start_ms + ((upto - n) * 9000) // whole as start_ms,
        start_ms + (upto * 9000) // whole as end_ms, ((n * 37 + pos) % 100) / 100.0::double as probability
        from (select *, length(word) as n,
                cast(sum(length(word)) over (partition by recording_id, seq order by pos rows unbounded preceding) as bigint) as upto,
                cast(sum(length(word)) over (partition by recording_id, seq) as bigint) as whole
              from word_list)""",
    "conv_turns": """select conv_id as recording_id, turn as seq, turn * 8000 as start_ms, turn * 8000 + 8000 as end_ms,
        cast(turn % 2 as integer) as speaker from conversations""",
    "ev": """select user_id as recording_id, event_id, event_type, value, epoch_us(ts) as us,
        row_number() over (partition by user_id order by ts, event_id) - 1 as seq from events""",
    "turns": """select recording_id, seq, us as start_us, us + cast(floor(value * 200) as bigint) * 1000000 as end_us,
        cast(event_id % 2 as integer) as speaker from ev""",
    "frames": "select recording_id, seq as frame, value / 500.0::double as prob from ev",
    "frame_states": """select *, coalesce(last_value(case when prob >= 0.2 then 1 when prob < 0.1 then 0 end ignore nulls)
            over (partition by recording_id order by frame rows unbounded preceding), 0) as active from frames""",
    "regions": """select recording_id, min(frame) as start, max(frame) + 1 as "end",
            row_number() over (partition by recording_id order by min(frame)) - 1 as seq
        from (select *, sum(1 - active) over (partition by recording_id order by frame) as run from frame_states)
        where active = 1 group by recording_id, run""",
    "emb": """select vec_id % 10 as recording_id, vec_id // 10 as seg_idx, cast(embedding as double[]) as vec, label
        from embeddings""",
    "lang_probs": """select doc_id % 50 as recording_id, doc_id as seg, lang as language, n_chars % 100 as pct
        from documents""",
    "candidates": """select recording_id * 1000000 + seq // 6 as segment_id, cast(seq % 6 as integer) as temp_idx,
        -(event_id % 37) / 20.0::double as avg_logprob, 1.5::double + (event_id % 23) / 15.0::double as compression_ratio,
        (event_id % 100) / 100.0::double as no_speech_prob, event_id from ev""",
    "ref_hyp": r"""select utt_id, ref, flatten(list_transform(ref, lambda w, i: list_concat(
            case when i % 17 = 0 then []::varchar[] when i % 11 = 0 then ['x'] else [w] end,
            case when i % 23 = 0 then ['y'] else []::varchar[] end))) as hyp
        from (select doc_id as utt_id, list_filter(string_split_regex(trim(text), '\s+'), lambda x: x <> '') as ref from documents)""",
    "turn_pairs": r"""select utt_id, ref, flatten(list_transform(ref, lambda w, i: list_concat(
            case when i % 7 = 0 then []::varchar[] when i % 5 = 0 then [ref[i - 2]] else [w] end,
            case when i % 9 = 0 then [coalesce(ref[i + 1], 'y')] else []::varchar[] end))) as hyp
        from (select conv_id || '-' || turn as utt_id, list_transform(list_filter(string_split_regex(trim(coalesce(text, '')), '\s+'), lambda x: x <> ''),
            lambda x: lower(substr(x, 1, 2))) as ref from conversations)""",
    "jobs": """select c_custkey as job, c_mktsegment || '-' || c_custkey as job_name,
        case when c_custkey % 7 <> 0 then 'tok' || c_nationkey end as task_token,
        case when c_custkey % 3 <> 0 then cast(c_custkey % 5 as integer) end as num_speakers,
        case when c_custkey % 2 = 0 then c_custkey % 4 = 0 end as diarization,
        case when c_custkey % 5 <> 0 then c_custkey % 3 = 0 end as multi_channel,
        cast(c_custkey % 3 + 1 as integer) as channels,
        case when c_custkey % 4 <> 1 then ['s', 'ms', 'hms', 'sec'][c_custkey % 4 + 1] end as timestamps,
        cast(case when c_custkey % 6 <> 0 then c_custkey % 10 end as double) as offset_start,
        case when c_custkey % 8 = 0 then []::varchar[] when c_custkey % 8 = 1 then [c_mktsegment] end as vocab,
        c_custkey % 2 = 1 as word_timestamps, cast(floor(c_acctbal) as bigint) as duration_s from customer""",
    "timings": """select user_id as job, epoch_us(ts) as us, event_type as stage,
        cast(floor(value * 100) as bigint) as centis, event_id from events""",
}
_NEEDS = {
    "word_list": ["segments"],
    "words": ["segments", "word_list"],
    "turns": ["ev"],
    "frames": ["ev"],
    "frame_states": ["ev", "frames"],
    "regions": ["ev", "frames", "frame_states"],
    "candidates": ["ev"],
}


def sql(names: str, query: str) -> str:
    """``query`` with the named tables (and what they need) defined in front of it."""
    wanted: list[str] = []
    for name in names.split():
        for each in [*_NEEDS.get(name, []), name]:
            if each not in wanted:
                wanted.append(each)
    heads = ",\n".join(f"{name} as ({_SQL[name]})" for name in wanted)
    query = query.strip()
    if query.lower().startswith("with recursive "):
        return f"with recursive {heads},\n{query[15:]}"
    if query.lower().startswith("with "):
        return f"with {heads},\n{query[5:]}"
    return f"with {heads}\n{query}"

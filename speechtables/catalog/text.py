"""Jobs on utterance text, time formats and scalar rules."""

from pyspark.sql import functions as F

from speechtables.catalog import job
from speechtables.catalog import tables as t
from speechtables.functions import exact, text, times
from speechtables.operators import utterances as utt

# White space as in speechtables.functions.text, in RE2 notation.
WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def punct_sql(x: str) -> str:
    """The clean-up as nested SQL calls; ``\\b`` is spelled out because RE2's is ASCII only."""
    s = "stripped"
    s = f"(case when {s}[1] = 'ß' then 'SS' when regexp_matches({s}[1], '^\\p{{Ll}}') then upper({s}[1]) else {s}[1] end || {s}[2:])"
    s = f"(case when stripped[-1] in ('.', '?', '!', ':', ';', ',') then {s} else {s} || '.' end)"
    s = f"replace({s}, '...', '')"
    for mark in "?!.,:;":
        s = f"replace({s}, ' {mark}', '{mark}')"
    s = f"regexp_replace({s}, '{WS}+', ' ', 'g')"
    lone = r"(^|[^\p{L}\p{N}_])i([^\p{L}\p{N}_]|$)"
    for _ in range(2):
        s = f"regexp_replace({s}, '{lone}', '\\1I\\2', 'g')"
    return f"(select {strip_sql(s)} from (select {strip_sql(x)} as stripped))"


_RUNS = """marked as (select *, case when lag(speaker) over w is not distinct from speaker and lag(seq) over w is not null
                then 0 else 1 end as opens
            from segments window w as (partition by recording_id order by seq)),
        runs as (select *, sum(opens) over (partition by recording_id order by seq) as run from marked),
        utt as (select recording_id, cast(run as bigint) as run, min(seq) as seq, min(start_ms) as start_ms, max(end_ms) as end_ms,
                min(speaker) as speaker, string_agg(text, ' ' order by seq) || ' ' as text from runs group by recording_id, run)"""


def _utterances(spark, sf):
    rows = t.segments(spark, sf).withColumnsRenamed({"start_ms": "start", "end_ms": "end"})
    return utt.reconstruct(rows)


@job(
    "who_said_what",
    t.sql(
        "segments",
        f"""with {_RUNS}
        select recording_id, run, speaker, {punct_sql('text')} as text,
            case run % 3 when 0 then start_ms / 1000.0::double when 1 then start_ms::double end as start_number,
            case run % 3 when 0 then end_ms / 1000.0::double when 1 then end_ms::double end as end_number,
            case when run % 3 = 2 then printf('%02d:%02d:%02d.%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, 0) end as start_text
        from utt where {strip_sql('text')} <> ''""",
    ),
)
def who_said_what(spark, sf):
    rows = _utterances(spark, sf).withColumns({"start": F.col("start") / 1000.0, "end": F.col("end") / 1000.0})
    target = F.element_at(F.array(F.lit("s"), F.lit("ms"), F.lit("hms")), (F.col("run") % 3 + 1).cast("int"))
    return utt.finish(rows, target).select(
        "recording_id",
        "run",
        "speaker",
        "text",
        F.col("start_fmt.number").alias("start_number"),
        F.col("end_fmt.number").alias("end_number"),
        F.col("start_fmt.text").alias("start_text"),
    )


@job(
    "utterances_g3",
    t.sql("segments", f'with {_RUNS} select recording_id, run, seq, start_ms as "start", end_ms as "end", speaker, text from utt'),
)
def utterances(spark, sf):
    return _utterances(spark, sf)


@job(
    "speaker_transcript_g8",
    t.sql(
        "segments",
        """with marked as (select *, lag(speaker) over (partition by recording_id order by seq) as ps from segments)
        select recording_id, seq, case when ps is null then 'Speaker ' || speaker || ': '
            when ps <> speaker then chr(10) || chr(10) || 'Speaker ' || speaker || ': ' else '' end || text || ' ' as line
        from marked""",
    ),
)
def speaker_transcript(spark, sf):
    return utt.transcript_lines(t.segments(spark, sf))


@job("clean_text_f5", f"select doc_id, {punct_sql('text')} as text from documents where {strip_sql('text')} <> ''")
def clean_text(spark, sf):
    docs = t.read(spark, sf, "documents").filter(~text.is_blank(F.col("text")))
    return docs.select("doc_id", text.format_punct(F.col("text")).alias("text"))


@job(
    "blank_text_p2_p3",
    rf"""select doc_id, part, {strip_sql('line')} = '' as blank, regexp_replace(line, '[.]|{WS}', '', 'g') = '' as empty
    from (select doc_id, unnest(l) as line, generate_subscripts(l, 1) - 1 as part
          from (select doc_id, string_split(text, '.') as l from documents))""",
)
def blank_text(spark, sf):
    lines = t.read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "[.]")).alias("part", "line"))
    return lines.select(
        "doc_id", "part", text.is_blank(F.col("line")).alias("blank"), text.is_empty_string(F.col("line")).alias("empty")
    )


@job(
    "timestamps_f1_f2_f3_f4",
    t.sql(
        "ev",
        """select event_id, s * 1000 as ms,
            printf('%02d:%02d:%02d.%03d', cast(floor(s / 3600) as bigint), cast(floor((s % 3600.0::double) / 60) as bigint),
                cast(floor((s % 3600.0::double) % 60.0::double) as bigint),
                cast(floor((((s % 3600.0::double) % 60.0::double) - floor((s % 3600.0::double) % 60.0::double)) * 1000) as bigint)) as hms,
            printf('%02d:%02d:%02d,%03d', m // 3600000, m // 60000 % 60, m // 1000 % 60, m % 1000) as srt,
            case when m // 3600000 > 0 then printf('%02d:', m // 3600000) else '' end
                || printf('%02d:%02d.%03d', m // 60000 % 60, m // 1000 % 60, m % 1000) as vtt
        from (select event_id, value * 37.5::double as s, cast(floor(value * 37.5::double * 1000 + 0.5) as bigint) as m from ev)""",
    ),
)
def timestamps(spark, sf):
    s = F.col("value") * 37.5
    return t.read(spark, sf, "events").select(
        "event_id",
        times.seconds_to_ms(s).alias("ms"),
        times.seconds_to_hms(s).alias("hms"),
        times.format_timestamp(s, always_hours=True, marker=",").alias("srt"),
        times.format_timestamp(s).alias("vtt"),
    )


@job("compression_ratio_f6")
def ratios(spark, sf):
    return t.read(spark, sf, "documents").select("doc_id", exact.compression_ratio("text").alias("ratio"))


@job(
    "scores_and_units_f7_f8_f9_f10_f11",
    t.sql(
        "words",
        """select recording_id, seq, pos, probability * (pos + 1) / (pos + 2) as avg_logprob,
            (start_ms + end_ms) / 2 as mid_ms, cast(floor(start_ms / 1000.0::double * 16000) as bigint) as sample, cast(round_even(start_ms / 1000.0::double * 100, 0) as bigint) as frame,
            (case when probability < 0.15 then 1.0::double else 0.0::double end)
             + (case when d < 0.133 then (0.133::double - d) * 15 else 0.0::double end)
             + (case when d > 2.0 then d - 2.0::double else 0.0::double end) as anomaly
        from (select *, (end_ms - start_ms) / 1000.0::double as d from words)""",
    ),
)
def scores(spark, sf):
    d = (F.col("end_ms") - F.col("start_ms")) / 1000.0
    return t.words(spark, sf).select(
        "recording_id",
        "seq",
        "pos",
        times.average_log_prob(F.col("probability"), F.col("pos") + 1).alias("avg_logprob"),
        times.word_anchor(F.col("start_ms"), F.col("end_ms"), "mid").alias("mid_ms"),
        times.seconds_to_samples(F.col("start_ms") / 1000.0).alias("sample"),
        times.seconds_to_frames(F.col("start_ms") / 1000.0).alias("frame"),
        times.word_anomaly(F.col("probability"), d).alias("anomaly"),
    )

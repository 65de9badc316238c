"""Jobs that put speakers on words and segments."""

from pyspark.sql import functions as F

from speechtables.catalog import job
from speechtables.catalog import tables as t
from speechtables.operators import speakers as op
from speechtables.operators.utterances import reconstruct
from speechtables.plans.ordered import with_ordinal

TEN_MINUTES_MS = 600_000
TIMES = {"start_ms": "start", "end_ms": "end"}


def _words(spark, sf):
    return t.words(spark, sf).withColumnsRenamed(TIMES)


def _segments(spark, sf):
    return t.segments(spark, sf).withColumnsRenamed(TIMES)


def _turns(spark, sf):
    return t.conv_turns(spark, sf).withColumnsRenamed(TIMES)


def _numbered(words):
    """Words numbered through the recording."""
    return with_ordinal(words, ["recording_id"], ["seq", "pos"], F.expr("seq div 1000"), name="at")


_J1 = """spans as (select *, lag(end_ms, 1, -1) over w as since, seq = max(seq) over (partition by recording_id) as final
        from conv_turns window w as (partition by recording_id order by seq)),
    spoken as (select w.recording_id, w.seq, w.pos, w.word, w.start_ms, w.end_ms, s.speaker,
            row_number() over (partition by w.recording_id order by w.seq, w.pos) - 1 as nr
        from words w join spans s on w.recording_id = s.recording_id and w.start_ms > since and (w.start_ms <= s.end_ms or final))"""


@job(
    "words_to_turns_j1",
    t.sql("words conv_turns", f'with {_J1} select recording_id, seq, pos, word, start_ms as start, end_ms as "end", speaker from spoken'),
)
def words_to_turns(spark, sf):
    return op.words_to_turns(_words(spark, sf), _turns(spark, sf), TEN_MINUTES_MS).select(
        "recording_id", "seq", "pos", "word", "start", "end", "speaker"
    )


# Segments and turns have equal numbers here, so every recording has at least two turns unless it
# has one segment only; the first word starts with its segment, so no first word is cut off.
_J2 = """ends as (select recording_id, seq, speaker, end_ms, lag(end_ms, 1, -1) over w as since, seq = max(seq) over (partition by recording_id) as final
        from conv_turns window w as (partition by recording_id order by seq)),
    placed as (select w.recording_id, w.seq, w.pos, w.word, w.start_ms, w.end_ms, e.seq as turn, e.speaker as turn_speaker,
            case when not final then e.end_ms end as turn_end, final, s.end_ms as segment_end, s.start_ms as segment_start, s.text
        from words w join segments s using (recording_id, seq)
        join ends e on w.recording_id = e.recording_id and w.start_ms + 300 > since and (w.start_ms + 300 <= e.end_ms or final)),
    cuts as (select *, case when pos > 0 and turn > lag(turn) over w and segment_end > lag(turn_end) over w + 300 then 1 else 0 end as cut
        from placed window w as (partition by recording_id, seq order by pos)),
    numbered as (select *, sum(cut) over (partition by recording_id, seq order by pos) as piece from cuts),
    pieces as (select recording_id, seq, piece, arg_min(turn, pos) as turn, arg_min(turn_speaker, pos) as turn_speaker, arg_min(final, pos) as final,
            string_agg(word, ' ' order by pos) as joined, min(text) as whole, min(start_ms) as s0, arg_max(end_ms, pos) as e0,
            min(segment_end) as segment_end, min(segment_start) as segment_start
        from numbered group by recording_id, seq, piece),
    sized as (select *, case when n = 0 then whole else joined end as text, piece < n as cut_after
        from (select *, max(piece) over (partition by recording_id, seq) as n from pieces)),
    seen as (select *, length(text) as size, row_number() over w as nr, lag(turn) over w as pt, lag(length(text)) over w as psize, lag(cut_after) over w as pcut,
            lead(turn) over w as nt, lead(turn_speaker) over w as nspk, lead(final) over w as nfinal, lead(length(text)) over w as nsize
        from sized window w as (partition by recording_id order by seq, piece)),
    forced as (select *, last_value(case when (pt is null or pt <> turn or final) and not coalesce(pcut and nr > 2 and psize > size, false) then turn_speaker end ignore nulls)
            over (partition by recording_id order by seq, piece rows unbounded preceding) as force from seen),
    mapped as (select recording_id, seq, piece, case when n = 0 then segment_start else s0 end as start_ms,
            case when cut_after then e0 else segment_end end as end_ms, text,
            case when cut_after and nr > 1 and size < nsize then case when (nt <> turn or nfinal) then nspk else force end else force end as speaker
        from forced)"""


@job(
    "segments_to_turns_j2",
    t.sql(
        "segments words conv_turns",
        f'with {_J2} select recording_id, seq, cast(piece as integer) as piece, start_ms as start, end_ms as "end", text, speaker from mapped',
    ),
)
def segments_to_turns(spark, sf):
    return op.segments_to_turns(_segments(spark, sf), _words(spark, sf), _turns(spark, sf), 300, TEN_MINUTES_MS).select(
        "recording_id", "seq", "piece", "start", "end", "text", "speaker"
    )


@job(
    "diarized_utterances_j2_g3",
    t.sql(
        "segments words conv_turns",
        f"""with {_J2},
        marked as (select *, row_number() over w as nr, case when lag(speaker) over w = speaker then 0 else 1 end as opens
            from mapped window w as (partition by recording_id order by seq, piece)),
        runs as (select *, sum(opens) over (partition by recording_id order by nr) as run from marked)
        select recording_id, cast(run as bigint) as run, arg_min(start_ms, nr) as start, arg_max(end_ms, nr) as "end", min(speaker) as speaker,
            string_agg(text, ' ' order by nr) || ' ' as text
        from runs group by recording_id, run""",
    ),
)
def diarized(spark, sf):
    mapped = op.segments_to_turns(_segments(spark, sf), _words(spark, sf), _turns(spark, sf), 300, TEN_MINUTES_MS)
    ordered = with_ordinal(mapped.withColumnRenamed("seq", "segment"), ["recording_id"], ["segment", "piece"], F.expr("segment div 1000"))
    return reconstruct(ordered).drop("seq")


_CHANNELS = """chan as (select recording_id, seq, pos, ' ' || word as word, start_ms - (seq % 2) * 7000 as s, end_ms - (seq % 2) * 7000 as e,
        cast(seq % 2 as integer) as channel from words),
    ord as (select *, row_number() over (partition by recording_id order by s, channel, seq, pos) as nr from chan),
    marked as (select *, case when lag(channel) over w = channel then 0 else 1 end as opens from ord window w as (partition by recording_id order by nr)),
    runs as (select *, sum(opens) over (partition by recording_id order by nr) as run from marked)"""


@job(
    "multi_channel_utterances_g4_o1",
    t.sql(
        "words",
        f"""with {_CHANNELS} select recording_id, cast(run as bigint) as run, min(channel) as speaker, arg_min(s, nr) as start, arg_max(e, nr) as "end",
            trim(string_agg(word, '' order by nr)) as text, count(*) as n_words from runs group by recording_id, run""",
    ),
)
def multi_channel(spark, sf):
    shift = F.col("seq") % 2 * 7000
    words = _words(spark, sf).select(
        "recording_id",
        "seq",
        "pos",
        F.concat(F.lit(" "), F.col("word")).alias("word"),
        (F.col("start") - shift).alias("start"),
        (F.col("end") - shift).alias("end"),
        (F.col("seq") % 2).cast("int").alias("channel"),
    )
    return op.merge_channels(words, TEN_MINUTES_MS)


@job(
    "sentences_realigned_g6",
    t.sql(
        "words conv_turns",
        f"""with {_J1},
        marked as (select *, coalesce(sum(case when regexp_matches(word, '[.?!]$') then 1 else 0 end)
            over (partition by recording_id order by nr rows between unbounded preceding and 1 preceding), 0) as sentence from spoken),
        votes as (select recording_id, sentence, speaker, count(*) as v, bool_or(regexp_matches(word, '[.?!]$')) as closed from marked group by all),
        tops as (select recording_id, sentence, sum(v) as n, count(*) as voices, bool_or(closed) as closed, arg_max(speaker, (v, -speaker)) as top, max(v) as best
            from votes group by all)
        select recording_id, nr as at, word, case when voices > 1 and (closed and n <= 50 or n = 50) and best >= n // 2 then top else speaker end as speaker
        from marked join tops using (recording_id, sentence)""",
    ),
)
def realigned(spark, sf):
    spoken = op.words_to_turns(_words(spark, sf), _turns(spark, sf), TEN_MINUTES_MS)
    return op.realign_by_sentence(_numbered(spoken))


@job(
    "sentence_rows_g7",
    t.sql(
        "words conv_turns",
        f"""with {_J1},
        marked as (select *, case when lag(speaker) over w = speaker and not regexp_matches(lag(word) over w, '[.?!]$') then 0 else 1 end as opens
            from spoken window w as (partition by recording_id order by nr)),
        runs as (select *, sum(opens) over (partition by recording_id order by nr) as sentence from marked)
        select recording_id, cast(sentence as bigint) as sentence, 'Speaker ' || min(speaker) as speaker, arg_min(start_ms, nr) as start,
            arg_max(end_ms, nr) as "end", string_agg(word, ' ' order by nr) || ' ' as text from runs group by recording_id, sentence""",
    ),
)
def sentences(spark, sf):
    spoken = op.words_to_turns(_words(spark, sf), _turns(spark, sf), TEN_MINUTES_MS)
    return op.sentence_rows(_numbered(spoken))

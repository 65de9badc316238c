"""Jobs on tokens, characters and word times."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from speechtables.catalog import job
from speechtables.catalog import tables as t
from speechtables.operators import words as op

SEGMENT = ["recording_id", "seq"]


def inside():
    return Window.partitionBy(*SEGMENT)


# ---- tables of tokens, subwords, characters, derived from the words -------------------------


def token_rows(spark, sf):
    """A timestamp before every fifth word (two of them but at the start), endings of all kinds."""
    stamp, n = F.lit(op.TIMESTAMP_BEGIN).cast("bigint") + 2 * F.col("pos"), F.col("n")
    final, closing = F.col("pos") == n - 1, F.lit(op.TIMESTAMP_BEGIN).cast("bigint") + 2 * n
    tokens = F.array_compact(
        F.array(
            F.when(F.col("pos") % 5 == 0, stamp),
            F.when((F.col("pos") % 5 == 0) & (F.col("pos") > 0), stamp),
            100 + (F.col("pos") * 7 + F.length("word")) % 5000,
            F.when(final & ((n % 2 == 0) | (n % 3 == 0)), closing),
            F.when(final & (n % 2 != 0) & (n % 3 == 0), closing),
        )
    )
    counted = t.words(spark, sf).withColumn("n", F.count(F.lit(1)).over(inside()))
    rows = counted.select(*SEGMENT, "pos", F.posexplode(tokens).alias("k", "token"))
    return rows.select(*SEGMENT, (F.row_number().over(inside().orderBy("pos", "k")) - 1).alias("tok"), "token")


_TOKENS = """token_rows as (select recording_id, seq, row_number() over (partition by recording_id, seq order by pos, k) - 1 as tok, token
        from (select recording_id, seq, pos, unnest(l) as token, generate_subscripts(l, 1) as k
              from (select *, list_filter([case when pos % 5 = 0 then 50364 + 2 * pos end, case when pos % 5 = 0 and pos > 0 then 50364 + 2 * pos end,
                        100 + (pos * 7 + length(word)) % 5000,
                        case when pos = n - 1 and (n % 2 = 0 or n % 3 = 0) then 50364 + 2 * n end,
                        case when pos = n - 1 and n % 2 <> 0 and n % 3 = 0 then 50364 + 2 * n end], lambda x: x is not null) as l
                    from (select *, count(*) over (partition by recording_id, seq) as n from words))))"""


def subword_rows(spark, sf):
    """Pieces of up to four letters, marks on their own, a blank in front of every word, and the
    end-of-text token behind every segment."""
    pieces = F.expr(r"regexp_extract_all(concat(' ', word), '( ?[\\p{L}\\p{N}]{1,4}| ?[^\\p{L}\\p{N} ])', 1)")
    last = F.lead("pos").over(inside().orderBy("pos")).isNull()
    ended = t.words(spark, sf).select(*SEGMENT, "pos", F.when(last, F.concat(pieces, F.array(F.lit("")))).otherwise(pieces).alias("pieces"))
    rows = ended.select(*SEGMENT, "pos", F.posexplode("pieces").alias("k", "subword"))
    numbered = rows.select(*SEGMENT, (F.row_number().over(inside().orderBy("pos", "k")) - 1).alias("tok"), "subword")
    token = F.when(F.col("subword") == "", F.lit(op.END_OF_TEXT).cast("bigint")).otherwise(F.expr("cast(100 + length(subword) * 31 + tok % 50 as bigint)"))
    return numbered.withColumn("token", token)


_SUBWORDS = r"""plain_subwords as (select recording_id, seq, row_number() over (partition by recording_id, seq order by pos, k) - 1 as tok, subword
        from (select recording_id, seq, pos, unnest(l) as subword, generate_subscripts(l, 1) as k
              from (select *, regexp_extract_all(' ' || word, ' ?[\p{L}\p{N}]{1,4}| ?[^\p{L}\p{N} ]') as l from words))),
    subword_rows as (select *, 100 + length(subword) * 31 + tok % 50 as token from plain_subwords
        union all select recording_id, seq, max(tok) + 1, '', 50257 from plain_subwords group by recording_id, seq)"""


def path_rows(spark, sf):
    """An alignment path that rests one to three frames on every token."""
    held = (1 + F.length("subword") % 3).cast("bigint")
    upto = inside().orderBy("tok").rowsBetween(Window.unboundedPreceding, 0)
    timed = subword_rows(spark, sf).withColumn("held", held).withColumn("upto", F.sum(held).over(upto))
    return timed.select(*SEGMENT, F.col("tok").alias("text_idx"), F.explode(F.expr("sequence(upto - held, upto - 1)")).alias("step")).withColumn(
        "time_idx", F.col("step")
    )


def timed_words(spark, sf):
    subwords = subword_rows(spark, sf)
    probability = subwords.select(*SEGMENT, "tok", ((F.length("subword") * 37 + F.col("tok")) % 100).alias("probability"))
    return op.time_words(op.tokens_to_words(subwords), path_rows(spark, sf), probability)


_MARKS = op.ASCII_PUNCTUATION.replace("'", "''")
_WORDS = f"""opened as (select *, case when token >= 50257 or subword[1] = ' ' or contains('{_MARKS}', trim(subword)) or tok = 0 then 1 else 0 end as opens from subword_rows),
    grouped as (select *, sum(opens) over (partition by recording_id, seq order by tok) - 1 as pos from opened),
    token_words as (select recording_id, seq, cast(pos as bigint) as pos, string_agg(subword, '' order by tok) as word, cast(min(tok) as integer) as first_tok,
            count(*) as n_tokens, max(token) >= 50257 as special from grouped group by recording_id, seq, pos)"""
_TIMED = """tok_times as (select *, coalesce(sum(1 + length(subword) % 3) over (partition by recording_id, seq order by tok rows between unbounded preceding and 1 preceding), 0) as at_frame from subword_rows),
    with_end as (select *, lead(first_tok) over (partition by recording_id, seq order by pos) as next_tok from token_words),
    timed as (select w.recording_id, w.seq, w.pos, w.word, w.n_tokens, a.at_frame / 50.0::double as start, b.at_frame / 50.0::double as "end",
            (select avg((length(subword) * 37 + tok) % 100) from subword_rows s where s.recording_id = w.recording_id and s.seq = w.seq
                and s.tok >= w.first_tok and s.tok < w.first_tok + w.n_tokens) as probability
        from with_end w join tok_times a on a.recording_id = w.recording_id and a.seq = w.seq and a.tok = w.first_tok
        join tok_times b on b.recording_id = w.recording_id and b.seq = w.seq and b.tok = w.next_tok
        where not special)"""


@job(
    "timestamp_pieces_g9",
    t.sql(
        "words",
        f"""with {_TOKENS},
        flagged as (select *, case when token >= 50364 and lag(token) over w >= 50364 then 1 else 0 end as pair, lag(token) over w as back,
                count(*) over (partition by recording_id, seq) as n
            from token_rows window w as (partition by recording_id, seq order by tok)),
        pieced as (select *, sum(pair) over (partition by recording_id, seq order by tok) as piece, sum(pair) over (partition by recording_id, seq) as pairs,
                max(case when tok = n - 1 and token >= 50364 and back < 50364 then 1 else 0 end) over (partition by recording_id, seq) as single
            from flagged),
        per as (select recording_id, seq, piece, min(pairs) as pairs, min(single) as single, arg_min(token, tok) as ft, arg_max(token, tok) as lt,
                max(case when token >= 50364 then token end) as ls, count(*) as n_tokens, list(token order by tok) as tokens from pieced group by recording_id, seq, piece),
        seeks as (select *, max(case when piece = pairs - 1 then lt end) over (partition by recording_id, seq) as sk from per)
        select recording_id, seq, cast(piece as bigint) as piece, case when pairs = 0 then 0 else ft - 50364 end as start_step,
            case when pairs = 0 then case when ls <> 50364 then ls - 50364 end else lt - 50364 end as end_step, n_tokens, tokens,
            case when pairs > 0 and single = 0 then (sk - 50364) * 2 end as seek
        from seeks where pairs = 0 or piece < pairs or single = 1""",
    ),
)
def timestamp_pieces(spark, sf):
    return op.split_at_timestamps(token_rows(spark, sf))


@job(
    "tokens_to_words_g10",
    t.sql("words", f"with {_SUBWORDS}, {_WORDS} select recording_id, seq, pos, word, first_tok, n_tokens from token_words where not special"),
)
def token_words(spark, sf):
    return op.tokens_to_words(subword_rows(spark, sf)).filter(~F.col("special")).drop("special")


@job(
    "tokens_to_words_without_punctuation_g10",
    t.sql(
        "words",
        f"""with {_SUBWORDS},
        opened as (select *, case when token >= 50257 or subword[1] = ' ' or tok = 0 then 1 else 0 end as opens from subword_rows),
        grouped as (select *, sum(opens) over (partition by recording_id, seq order by tok) - 1 as pos from opened)
        select recording_id, seq, cast(pos as bigint) as pos, string_agg(case when opens = 1 then trim(subword) else subword end, '' order by tok) as word,
            cast(min(tok) as integer) as first_tok, count(*) as n_tokens from grouped group by recording_id, seq, pos having max(token) < 50257""",
    ),
)
def token_words_plain(spark, sf):
    return op.tokens_to_words(subword_rows(spark, sf), split_punctuation=False).filter(~F.col("special")).drop("special")


@job("word_times_g11_j5", t.sql("words", f"with {_SUBWORDS}, {_WORDS}, {_TIMED} select * from timed"))
def word_times(spark, sf):
    return timed_words(spark, sf)


_OPENING, _CLOSING = op.OPENING_MARKS.replace("'", "''"), op.CLOSING_MARKS.replace("'", "''")


@job(
    "punctuation_merged_g12",
    t.sql(
        "words",
        f"""with {_SUBWORDS}, {_WORDS},
        items as (select * from token_words where not special),
        o as (select *, word[1] = ' ' and contains('{_OPENING}', trim(word)) and lead(pos) over (partition by recording_id, seq order by pos) is not null as op from items),
        g as (select *, sum(case when op then 0 else 1 end) over (partition by recording_id, seq order by pos desc) as grp from o),
        p1 as (select recording_id, seq, pos, case when op then '' else string_agg(word, '') over w end as w, case when op then 0 else sum(n_tokens) over w end as n
            from g window w as (partition by recording_id, seq, grp order by pos)),
        p2 as (select *, contains('{_CLOSING}', w) and lag(pos) over (partition by recording_id, seq order by pos) is not null
                and not coalesce(ends_with(last_value(nullif(w, '') ignore nulls) over (partition by recording_id, seq order by pos rows between unbounded preceding and 1 preceding), ' '), false) as joins from p1),
        r as (select *, sum(case when joins then 0 else 1 end) over (partition by recording_id, seq order by pos) as run from p2)
        select recording_id, seq, min(pos) as pos, string_agg(w, '' order by pos) as word, cast(sum(n) as bigint) as n_tokens
        from r group by recording_id, seq, run having string_agg(w, '' order by pos) <> ''""",
    ),
)
def punctuation(spark, sf):
    return op.merge_punctuation(op.tokens_to_words(subword_rows(spark, sf)).filter(~F.col("special")))


_LIMITS = """limits as (select *, coalesce(least(median(case when "end" <> start then "end" - start end) over (partition by recording_id, seq), 0.03::double), 0.0::double) as median from timed)"""


@job(
    "long_words_clamped_g13",
    t.sql(
        "words",
        f"""with {_SUBWORDS}, {_WORDS}, {_TIMED}, {_LIMITS},
        near as (select *, median * 2 as longest, lag(word) over (partition by recording_id, seq order by pos) as pw from limits)
        select recording_id, seq, pos, word, median,
            case when "end" - start > longest and pw is not null and longest > 0 and not contains('{op.SENTENCE_MARKS}', word) and contains('{op.SENTENCE_MARKS}', pw) then "end" - longest else start end as start,
            case when "end" - start > longest and pw is not null and longest > 0 and contains('{op.SENTENCE_MARKS}', word) then start + longest else "end" end as "end"
        from near""",
    ),
)
def clamped(spark, sf):
    limited = op.duration_limits(timed_words(spark, sf), cap=0.03)
    return op.clamp_at_sentence_marks(limited).select(*SEGMENT, "pos", "word", "median", "start", "end")


def segment_rows(spark, sf):
    """Segments with word arrays: absolute times, edges a little off the words, some without words."""
    words = op.duration_limits(timed_words(spark, sf), cap=0.7)
    shift = F.col("seq") * 10.0
    item = F.struct(
        "pos",
        "word",
        (F.col("start") + shift).alias("start"),
        (F.col("end") + shift).alias("end"),
        (F.col("probability") / 300).alias("probability"),
    )
    rows = words.groupBy(*SEGMENT).agg(F.array_sort(F.collect_list(item)).alias("w"), F.min("median").alias("median"), F.min("longest").alias("longest"))
    bare = F.transform("w", lambda w: F.struct(w["word"].alias("word"), w["start"].alias("start"), w["end"].alias("end"), w["probability"].alias("probability")))
    return rows.select(
        *SEGMENT,
        (F.col("w")[0]["start"] + F.col("seq") % 3 * 0.4).alias("start"),
        (F.element_at("w", -1)["end"] - F.col("seq") % 2 * 0.3).alias("end"),
        F.when(F.col("seq") % 4 == 3, F.array().cast(op.WORDS_TYPE)).otherwise(bare.cast(op.WORDS_TYPE)).alias("words"),
        "median",
        "longest",
    )


_SEGMENT_ROWS = """limits as (select *, coalesce(least(median(case when "end" <> start then "end" - start end) over (partition by recording_id, seq), 0.7::double), 0.0::double) as median from timed),
        whole as (select recording_id, seq, min(median) as median,
                list({'word': word, 'start': start + seq * 10.0::double, 'end': "end" + seq * 10.0::double, 'probability': probability / 300} order by pos) as w
            from limits group by recording_id, seq),
        segment_rows as (select recording_id, seq, w[1].start + seq % 3 * 0.4::double as start, w[-1]."end" - seq % 2 * 0.3::double as "end",
                case when seq % 4 = 3 then [] else w end as words, median, median * 2 as longest from whole)"""


@job(
    "boundaries_fixed_g14",
    t.sql(
        "words",
        # segment by segment; spoken: where speech ended before; hs, he: first word, ss: start of the second, ls, le: last word
        f"""with recursive {_SUBWORDS}, {_WORDS}, {_TIMED}, {_SEGMENT_ROWS},
        items as materialized (select *, row_number() over (partition by recording_id order by seq) as k, len(words) as n from segment_rows where len(words) > 0),
        walk as (
            select recording_id, cast(null as bigint) as seq, cast(0 as bigint) as k, cast(null as double) as start, 0.0::double as "end",
                   cast(null as struct(word varchar, start double, "end" double, probability double)[]) as words from items where k = 1
            union all
            select recording_id, seq, k, case when early then start else hs2 end, case when late then "end" else le end,
                   list_transform(words, lambda w, i: {{'word': w.word, 'start': case when i = 1 then hs2 when i = 2 then ss else w.start end,
                       'end': case when i = n then (case when late then greatest(ls + median, "end") else le end) when i = 1 then he else w."end" end,
                       'probability': w.probability}})
            from (select *, "end" > ls and "end" + 0.5 < le as late from (
                select *, case when n = 1 then hs2 when n = 2 then ss else words[n].start end as ls, case when n = 1 then he else words[n]."end" end as le from (
                  select *, case when early then greatest(0, least(he - median, start)) else hs end as hs2 from (
                    select *, start < he and start - 0.5 > hs as early from (
                      select *, case when paused then greatest(0, he - longest) else words[1].start end as hs from (
                        select *, case when shared then meet else words[1]."end" end as he, case when shared then meet else words[2].start end as ss from (
                          select *, paused and n > 1 and words[2]."end" - words[2].start > longest as shared,
                                 greatest(words[2]."end" / 2, words[2]."end" - longest) as meet from (
                            select i.*, i.words[1]."end" - w."end" > 4 * i.median and (i.words[1]."end" - i.words[1].start > i.longest
                                       or (i.n > 1 and i.words[2]."end" - i.words[1].start > 2 * i.longest)) as paused
                            from walk w join items i on i.recording_id = w.recording_id and i.k = w.k + 1)))))))))
        select recording_id, seq, start, "end", words from walk where k > 0
        union all select recording_id, seq, start, "end", words from segment_rows where len(words) = 0""",
    ),
)
def boundaries(spark, sf):
    return op.fix_boundaries(segment_rows(spark, sf))


def hallucination_rows(spark, sf):
    """Windows of three segments; every fourth segment is made of short, improbable words, every ninth begins late,
    and every fifth has no words."""
    odd = (F.col("recording_id") + F.col("seq")) % 4 == 1
    begin = F.col("seq") * 10.0 + F.when(F.col("seq") % 9 == 0, 3.0).otherwise(0.0) + F.col("pos") * 0.25
    item = F.struct(
        "pos",
        "word",
        begin.alias("start"),
        (begin + F.when(odd, 0.05).otherwise(0.2)).alias("end"),
        F.when(odd, 0.1).otherwise(0.9).alias("probability"),
    )
    rows = t.words(spark, sf).groupBy(*SEGMENT).agg(F.array_sort(F.collect_list(item)).alias("w"))
    bare = F.transform("w", lambda w: F.struct(w["word"].alias("word"), w["start"].alias("start"), w["end"].alias("end"), w["probability"].alias("probability")))
    window = F.expr("seq div 3")
    return rows.select(
        *SEGMENT,
        window.alias("window"),
        F.col("w")[0]["start"].alias("start"),
        F.element_at("w", -1)["end"].alias("end"),
        F.when(F.col("seq") % 5 == 4, F.array().cast(op.WORDS_TYPE)).otherwise(bare.cast(op.WORDS_TYPE)).alias("words"),
        (window * 30.0).alias("window_start"),
        (window * 30.0 + 30.0).alias("window_end"),
        F.greatest(F.lit(0.0), window * 30.0 - 1.0).alias("last_speech"),
    )


@job(
    "hallucinations_dropped_g15",
    t.sql(
        "words",
        f"""with shaped as (select *, (recording_id + seq) % 4 = 1 as odd_one, seq * 10.0::double + case when seq % 9 = 0 then 3.0::double else 0.0::double end + pos * 0.25::double as b from words),
        rows_ as (select recording_id, seq, seq // 3 as win, min(b) as start, arg_max(b + case when odd_one then 0.05::double else 0.2::double end, pos) as "end",
                min(b) as first, case when seq % 5 = 4 then [] else list({{'word': word, 'length': (b + case when odd_one then 0.05::double else 0.2::double end) - b,
                    'probability': case when odd_one then 0.1::double else 0.9::double end}} order by pos) end as words
            from shaped group by recording_id, seq),
        real as (select *, list_filter(words, lambda w: not contains('{_OPENING}{_CLOSING}', w.word))[:8] as r from rows_),
        scored as (select *, coalesce(list_sum(list_transform(r, lambda w: case when w.probability < 0.15 then 1.0::double else 0.0::double end
                + case when w.length < 0.133 then (0.133::double - w.length) * 15 else 0.0::double end + case when w.length > 2 then w.length - 2 else 0.0::double end)), 0.0::double) as score from real),
        judged as (select *, win * 30.0::double as ws, win * 30.0::double + 30 as we, len(words) > 0 and (score >= 3 or score + 0.01 >= len(r)) as odd from scored),
        spoken as (select *, lag("end") over w as before, lead(first) over w as after, lead(odd) over w as next_odd
            from judged where len(words) > 0 window w as (partition by recording_id, win order by seq)),
        cuts as (select recording_id, win,
                min(case when odd and (start - coalesce(before, greatest(0, ws - 1)) > 2 or start < 2 or start - ws < 2)
                    and (coalesce(after, we) - "end" > 2 or coalesce(next_odd, false) or we - "end" < 2) then seq end) as cut,
                bool_or(odd and before is null and start - ws > 2) as skip
            from spoken group by recording_id, win)
        select j.recording_id, j.seq, j.win as "window", j.start, j."end" from judged j left join cuts c on c.recording_id = j.recording_id and c.win = j.win
        where not coalesce(c.skip, false) and (c.cut is null or j.seq < c.cut)""",
    ),
)
def hallucinations(spark, sf):
    return op.drop_hallucinations(hallucination_rows(spark, sf), 2.0).select(*SEGMENT, "window", "start", "end")


@job(
    "distinct_text_ids_g16",
    t.sql(
        "ev",
        """with near as (select *, case when lag(event_type) over w = event_type then 0 else 1 end as opens from ev window w as (partition by recording_id order by seq))
        select recording_id, seq, event_type as text, cast(sum(opens) over (partition by recording_id order by seq) as bigint) as id from near""",
    ),
)
def distinct_texts(spark, sf):
    rows = t.events(spark, sf).select("recording_id", "seq", F.col("event_type").alias("text"))
    return op.number_distinct_texts(rows)


@job(
    "last_word_end_g17",
    t.sql(
        "words segments",
        """with ends as (select recording_id, seq, max(end_ms) as word_end from words where seq % 4 <> 3 group by recording_id, seq)
        select s.recording_id, coalesce(arg_max(word_end, s.seq), arg_max(end_ms, s.seq)) as last_end
        from segments s left join ends using (recording_id, seq) group by s.recording_id""",
    ),
)
def last_end(spark, sf):
    words = t.words(spark, sf).groupBy(*SEGMENT).agg(F.array_sort(F.collect_list(F.struct("pos", F.col("end_ms").alias("end")))).alias("words"))
    rows = t.segments(spark, sf).select(*SEGMENT, F.col("end_ms").alias("end")).join(words, SEGMENT, "left")
    empty = F.array().cast("array<struct<pos:int,end:bigint>>")
    return op.last_word_end(rows.withColumn("words", F.when(F.col("seq") % 4 == 3, empty).otherwise(F.coalesce("words", empty))))


def char_path(spark, sf):
    """Characters of the words, ``|`` between words, one or two path points per character."""
    spelled = t.words(spark, sf).select(*SEGMENT, "pos", F.concat("word", F.lit("|")).alias("w"))
    chars = spelled.select(*SEGMENT, "pos", "w", F.explode(F.expr("sequence(1, length(w))")).alias("k"))
    chars = chars.select(
        *SEGMENT, (F.row_number().over(inside().orderBy("pos", "k")) - 1).alias("token_index"), F.expr("substring(w, k, 1)").alias("label")
    )
    held = (1 + F.ascii("label") % 2).cast("bigint")
    upto = inside().orderBy("token_index").rowsBetween(Window.unboundedPreceding, 0)
    timed = chars.withColumn("held", held).withColumn("upto", F.sum(held).over(upto))
    points = timed.select(*SEGMENT, "token_index", "label", F.explode(F.expr("sequence(upto - held, upto - 1)")).alias("step"))
    return points.withColumn("time_index", F.col("step")).withColumn("score", (F.ascii("label") + F.col("step")) % 100)


_CHARS = """spelled as (select recording_id, seq, row_number() over (partition by recording_id, seq order by pos, k) - 1 as char_idx, label
        from (select recording_id, seq, pos, unnest(string_split(word || '|', '')) as label, generate_subscripts(string_split(word || '|', ''), 1) as k from words)),
    held as (select *, sum(1 + ascii(label) % 2) over (partition by recording_id, seq order by char_idx) as upto, 1 + ascii(label) % 2 as h from spelled),
    char_rows as (select recording_id, seq, char_idx, label, cast(upto - h as bigint) as start, cast(upto as bigint) as "end",
            case when h = 1 then ((ascii(label) + upto - 1) % 100)::double else ((ascii(label) + upto - 1) % 100 + (ascii(label) + upto - 2) % 100) / 2.0::double end as score from held)"""


@job("repeats_merged_g18", t.sql("words", f"with {_CHARS} select cast(char_idx as bigint) as char_idx, recording_id, seq, label, start, \"end\", score from char_rows"))
def repeats(spark, sf):
    return op.merge_repeats(char_path(spark, sf))


@job(
    "chars_to_words_g19",
    t.sql(
        "words",
        f"""with {_CHARS},
        split as (select *, sum(case when label = '|' then 1 else 0 end) over (partition by recording_id, seq order by char_idx) as word_no from char_rows)
        select recording_id, seq, min(char_idx) as char_idx, string_agg(label, '' order by char_idx) as word, arg_min(start, char_idx) as start,
            arg_max("end", char_idx) as "end", sum(score * ("end" - start)) / sum("end" - start) as score
        from split where label <> '|' group by recording_id, seq, word_no""",
    ),
)
def char_words(spark, sf):
    return op.chars_to_words(op.merge_repeats(char_path(spark, sf)))


def aligned_chars(spark, sf):
    """Characters with blanks between words; every sixth word and all blanks are not aligned."""
    words = t.words(spark, sf).select(*SEGMENT, "pos", "start_ms", "end_ms", F.concat("word", F.lit(" ")).alias("w"))
    chars = words.select("*", F.explode(F.expr("sequence(1, length(w))")).alias("k"))
    blank = F.col("k") == F.length("w")
    known = ~blank & (F.col("pos") % 6 != 2)
    return chars.select(
        *SEGMENT,
        F.expr("pos div 12").alias("sentence"),
        F.col("pos").alias("word_idx"),
        F.col("k").alias("char_idx"),
        F.expr("substring(w, k, 1)").alias("char"),
        F.when(known, F.col("start_ms") + (F.col("k") - 1) * 10).alias("start"),
        F.when(known, F.col("start_ms") + F.col("k") * 12).alias("end"),
        F.when(known, (F.col("k") * 13 % 100).cast("double")).alias("score"),
    )


@job(
    "chars_to_sentences_g20",
    t.sql(
        "words",
        # word by word; rate: time per character, fixed at the first word without times
        """with recursive chars as (select recording_id, seq, pos // 12 as sentence, pos, word, start_ms, k, k <= length(word) and pos % 6 <> 2 as known
            from (select *, unnest(range(1, length(word) + 2)) as k from words)),
        items as materialized (select recording_id, seq, sentence, pos, word,
                cast(min(case when known then start_ms + (k - 1) * 10 end) as double) as s, cast(max(case when known then start_ms + k * 12 end) as double) as e,
                avg(case when known then cast(k * 13 % 100 as double) end) as score from chars group by recording_id, seq, sentence, pos, word),
        spans as materialized (select recording_id, seq, sentence, min(s) as start, max(e) as "end" from items group by recording_id, seq, sentence),
        walk as (
            select recording_id, seq, sentence, sentence * 12 - 1 as pos, cast(null as varchar) as word, cast(null as double) as a, cast(null as double) as b,
                   cast(null as double) as score, cast(null as double) as rate, 0.0::double as spent, 0 as timed from spans
            union all
            select recording_id, seq, sentence, pos, word, a, b, case when gap then coalesce(score, 0.5) else score end, rate2,
                   case when a is not null and b is not null then spent + (b - a) / length(word) else spent end,
                   case when a is not null and b is not null then timed + 1 else timed end
            from (select *, case when prev is not null and s2 < prev then prev else s2 end as a, coalesce(e, s2 + length(word) * rate2) as b from (
                select w.recording_id, w.seq, w.sentence, i.pos, i.word, i.e, i.score, w.spent, w.timed, w.b as prev, i.s is null or i.e is null as gap,
                       coalesce(i.s, w.b, p.start) as s2,
                       case when i.s is null or i.e is null then coalesce(w.rate, case when w.timed > 0 then w.spent / w.timed else 0.1::double end) else w.rate end as rate2
                from walk w join items i on i.recording_id = w.recording_id and i.seq = w.seq and i.sentence = w.sentence and i.pos = w.pos + 1
                join spans p on p.recording_id = w.recording_id and p.seq = w.seq and p.sentence = w.sentence)))
        select recording_id, seq, sentence, p.start, p."end", list({'word': word, 'start': a, 'end': b, 'score': w.score} order by pos) as words
        from walk w join spans p using (recording_id, seq, sentence) where word is not null group by recording_id, seq, sentence, p.start, p."end" """,
    ),
)
def char_sentences(spark, sf):
    return op.chars_to_sentences(aligned_chars(spark, sf))


@job(
    "nearest_fill_g21",
    t.sql(
        "ev",
        """with items as (select recording_id, seq // 64 as part, seq as sentence, case when event_id % 3 = 0 then value end as v from ev),
        near as (select *, last_value(case when v is not null then {'a': sentence, 'v': v} end ignore nulls) over (partition by recording_id, part order by sentence rows unbounded preceding) as b,
                last_value(case when v is not null then {'a': sentence, 'v': v} end ignore nulls) over (partition by recording_id, part order by sentence desc rows unbounded preceding) as f from items)
        select recording_id, part, sentence, case when f is null or (b is not null and sentence - b.a <= f.a - sentence) then b.v else f.v end as v from near""",
    ),
)
def nearest(spark, sf):
    rows = t.events(spark, sf).select(
        "recording_id", F.expr("seq div 64").alias("part"), F.col("seq").alias("sentence"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("v")
    )
    return op.fill_nearest(rows, "v", keys=["recording_id", "part"])


@job(
    "same_time_sentences_g22",
    t.sql(
        "words",
        """select recording_id, seq, start_ms // 2000 * 2000 as start, start_ms // 2000 * 2000 + 2000 as "end", string_agg(word, ' ' order by pos) as text,
            flatten(list([word, word || '!'] order by pos)) as words from words group by all""",
    ),
)
def same_time(spark, sf):
    start = F.expr("start_ms div 2000 * 2000")
    rows = t.words(spark, sf).select(
        *SEGMENT,
        F.col("pos").alias("sentence"),
        start.alias("start"),
        (start + 2000).alias("end"),
        F.col("word").alias("text"),
        F.array(F.col("word"), F.concat("word", F.lit("!"))).alias("words"),
    )
    return op.group_same_time(rows)


@job(
    "word_times_by_length_g23",
    t.sql(
        "segments word_list",
        """with n as (select *, length(word) as c, sum(length(word)) over (partition by recording_id, seq order by pos) as upto, sum(length(word)) over (partition by recording_id, seq) as whole from word_list)
        select recording_id, seq, cast(pos as integer) as pos, word, start_ms + (upto - c) * 9000 / whole as start,
            case when upto = whole then (start_ms + 9000)::double else start_ms + upto * 9000 / whole end as "end", 0.5::double as probability from n""",
    ),
)
def by_length(spark, sf):
    return op.words_by_length(t.segments(spark, sf).withColumnsRenamed({"start_ms": "start", "end_ms": "end"}))


def gappy_segments(spark, sf):
    return t.segments(spark, sf).select(
        *SEGMENT,
        F.when(F.col("seq") % 3 != 1, F.col("start_ms")).alias("start"),
        F.when(F.col("seq") % 4 < 2, F.col("end_ms")).alias("end"),
        "text",
    )


@job(
    "missing_times_g24",
    t.sql(
        "segments",
        """with items as (select recording_id, seq, case when seq % 3 <> 1 then start_ms end as s, case when seq % 4 < 2 then end_ms end as e, length(text) as n from segments),
        rates as (select recording_id, coalesce(sum(e - s) / nullif(sum(case when s is not null and e is not null then n end), 0), 0.1::double) as rate
            from items group by recording_id),
        linked as (select i.*, rate, (select max(b.seq) from items b where b.recording_id = i.recording_id and b.seq <= i.seq and b.s is not null) as anchor
            from items i join rates using (recording_id)),
        summed as (select l.*, (select coalesce(sum(c.n), 0) from items c where c.recording_id = l.recording_id and c.seq > coalesce(l.anchor, -1) and c.seq <= l.seq) as since,
                coalesce(b.e, b.s + b.n * rate, 0.0::double) as base from linked l left join items b on b.recording_id = l.recording_id and b.seq = l.anchor)
        select recording_id, seq, case when s is null then base + cast(since - n as bigint) * rate else s end as start,
            case when s is null then base + cast(since as bigint) * rate else coalesce(e, s + n * rate) end as "end" from summed""",
    ),
)
def missing_times(spark, sf):
    return op.estimate_missing_times(gappy_segments(spark, sf)).select(*SEGMENT, "start", "end")

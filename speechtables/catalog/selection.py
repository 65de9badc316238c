"""Jobs that choose hypotheses and languages."""

from pyspark.sql import functions as F

from speechtables.catalog import job
from speechtables.catalog import tables as t
from speechtables.operators import selection as op

_JUDGED = """judged as (select *, (compression_ratio > 2.4 or avg_logprob < -1.0) and not (no_speech_prob > 0.6 and avg_logprob < -1.0) as bad from candidates)"""


@job(
    "hypothesis_choice_q1",
    t.sql(
        "candidates",
        f"""with {_JUDGED},
        ranked as (select *, row_number() over (partition by segment_id order by bad, case when not bad then temp_idx end, compression_ratio > 2.4, avg_logprob desc, temp_idx) as rk,
            bool_and(bad) over (partition by segment_id) as all_failed, max(temp_idx) over (partition by segment_id) as final from judged)
        select segment_id, case when all_failed then final else temp_idx end as temp_idx, avg_logprob, compression_ratio, no_speech_prob, event_id, all_failed from ranked where rk = 1""",
    ),
)
def choice(spark, sf):
    return op.choose_hypothesis(t.candidates(spark, sf), ["event_id"])


@job(
    "speech_gate_q2",
    t.sql("candidates", "select segment_id, temp_idx, event_id from candidates where not ((no_speech_prob > 0.6 and not avg_logprob > -1.0) or avg_logprob < -1.5)"),
)
def gate(spark, sf):
    return op.speech_gate(t.candidates(spark, sf), low_log_prob=-1.5).select("segment_id", "temp_idx", "event_id")


@job(
    "language_vote_q3",
    t.sql(
        "lang_probs",
        """with l as (select recording_id, language, count(*) as n, avg(pct) as mean, count(*) filter (pct > 70) as sure, min(seg) as f from lang_probs group by recording_id, language),
        r as (select *, row_number() over (partition by recording_id order by n desc, mean desc, f) as rk, sum(n) over (partition by recording_id) as total from l)
        select recording_id, language, mean as confidence, sure = total as unanimous from r where rk = 1""",
    ),
)
def vote(spark, sf):
    return op.vote_with_confidence(t.lang_probs(spark, sf).withColumnRenamed("pct", "prob"), confident=70)


@job(
    "language_or_silence_q3",
    t.sql(
        "lang_probs",
        """with l as (select recording_id, language, count(*) as n, avg(pct) as mean, count(*) filter (pct > 70) as sure, min(seg) as f from lang_probs group by recording_id, language),
        r as (select *, row_number() over (partition by recording_id order by n desc, mean desc, f) as rk, sum(n) over (partition by recording_id) as total from l),
        loud as (select doc_id % 60 as recording_id, max(n_chars % 5) / 100.0::double as peak, avg(n_chars % 3) as rms from documents group by 1)
        select loud.recording_id, case when language is null or (sure <> total and (peak < 0.01 or rms < 0.01)) then 'silence' else language end as language,
            case when language is null or (sure <> total and (peak < 0.01 or rms < 0.01)) then 1.0::double else mean end as confidence
        from loud left join (select * from r where rk = 1) v using (recording_id)""",
    ),
)
def vote_or_silence(spark, sf):
    docs = t.read(spark, sf, "documents")
    levels = docs.groupBy((F.col("doc_id") % 60).alias("recording_id")).agg(
        (F.max(F.col("n_chars") % 5) / 100.0).alias("peak"), F.avg(F.col("n_chars") % 3).alias("rms")
    )
    return op.vote_or_silence(t.lang_probs(spark, sf).withColumnRenamed("pct", "prob"), levels, confident=70)


@job(
    "language_vote_early_q4",
    t.sql(
        "lang_probs",
        """with s as (select recording_id, arg_min(language, seg) as language, arg_min(pct, seg) as prob from lang_probs where pct > 95 group by recording_id),
        l as (select recording_id, language, count(*) as n, max(pct) as prob, min(seg) as f from lang_probs group by recording_id, language),
        v as (select *, row_number() over (partition by recording_id order by n desc, f) as rk from l)
        select v.recording_id, case when s.language is not null then s.language else v.language end as language, coalesce(s.prob, v.prob) as prob
        from v left join s using (recording_id) where rk = 1""",
    ),
)
def early(spark, sf):
    return op.vote_first_sure(t.lang_probs(spark, sf).withColumnRenamed("pct", "prob"), 95)


@job(
    "top_language_q5",
    """select doc_id % 50 as recording_id, doc_id as seg, arg_max(l, (p, l)) as language, max(p) as prob
    from (select doc_id, ['de', 'en', 'es', 'fr'][i] as l, (doc_id * i * 7 + n_chars * i) % 101 as p from documents, range(1, 5) as g(i)) group by doc_id""",
)
def top(spark, sf):
    tokens = F.array(*[F.struct(F.lit(f"<|{code}|>").alias("token"), F.lit(i).alias("i")) for i, code in enumerate(("de", "en", "es", "fr"), 1)])
    rows = t.read(spark, sf, "documents").select("doc_id", "n_chars", F.explode(tokens).alias("x"))
    prob = (F.col("doc_id") * F.col("x.i") * 7 + F.col("n_chars") * F.col("x.i")) % 101
    return op.top_language(rows.select((F.col("doc_id") % 50).alias("recording_id"), F.col("doc_id").alias("seg"), "x.token", prob.alias("prob")))

"""Jobs on word error rates and stage times."""

from pyspark.sql import functions as F

from speechtables.catalog import job
from speechtables.catalog import tables as t
from speechtables.functions.text import compact_words
from speechtables.operators import scoring as op
from speechtables.sources import documents as doc


def _steps(spark, sf, whole=False):
    return op.align_words(t.ref_hyp(spark, sf), whole=whole)


# The edit table of every turn, a diagonal a round: a cell is its cost times four plus the way it was reached by
# (0 both words, 1 reference only, 2 hypothesis only), so the least one also settles ties. Then the way back.
_TABLE_SQL = """with recursive diagonals as (
  select utt_id, ref, hyp, 0 as d, [case when i = 0 then 0 else 1000000 end for i in range(0, len(ref) + 1)] as cur,
    [1000000 for i in range(0, len(ref) + 1)] as prev, '' as ways
  from turn_pairs
  union all
  select utt_id, ref, hyp, d, list_transform(cells, lambda c: c // 4), cur, array_to_string(list_transform(cells, lambda c: c % 4), '')
  from (
    select utt_id, ref, hyp, d + 1 as d, cur, list_transform(range(0, len(ref) + 1), lambda i: case when i > d + 1 or d + 1 - i > len(hyp) then 4000000
      else least(
        case when i > 0 and i < d + 1 then (prev[i] + case when ref[i] = hyp[d + 1 - i] then 0 else 1 end) * 4 else 4000000 end,
        case when i > 0 then (cur[i] + 1) * 4 + 1 else 4000000 end,
        case when i < d + 1 then (cur[i + 1] + 1) * 4 + 2 else 4000000 end) end) as cells
    from diagonals where d < len(ref) + len(hyp)
  )
),
tables as (select utt_id, any_value(ref) as ref, any_value(hyp) as hyp, list(ways order by d) as ways from diagonals group by utt_id),
back as (
  select utt_id, len(ref) as i, len(hyp) as j, 0 as step, '' as way from tables
  union all
  select utt_id, i - case when found <> '2' then 1 else 0 end, j - case when found <> '1' then 1 else 0 end, step + 1, found
  from (select utt_id, i, j, step, substr(ways[i + j + 1], i + 1, 1) as found from back join tables using (utt_id) where i + j > 0)
),
steps as (
  select utt_id, cast(max(step) over (partition by utt_id) - step as integer) as pos, case when way = '2' then '*' else ref[i + 1] end as ref,
    case when way = '1' then '*' else hyp[j + 1] end as hyp,
    case when way = '2' then 'ins' when way = '1' then 'del' when ref[i + 1] = hyp[j + 1] then 'corr' else 'sub' end as kind
  from back join tables using (utt_id) where step > 0
),
summary as (
  select count(*) filter (kind = 'ins') as ins, count(*) filter (kind = 'del') as del, count(*) filter (kind = 'sub') as sub,
    count(*) filter (kind = 'corr') as corr, count(*) filter (kind <> 'ins') as ref_len, count(*) filter (kind <> 'corr') as errors from steps
),
said as (
  select ref as word, 'corr' as role from steps where kind = 'corr'
  union all select ref, 'ref' from steps where kind in ('sub', 'del')
  union all select hyp, 'hyp' from steps where kind in ('sub', 'ins')
),
stats as (
  select word, count(*) filter (role = 'corr') as corr, count(*) filter (role <> 'corr') as errors, count(*) filter (role <> 'hyp') as in_ref,
    count(*) filter (role <> 'ref') as in_hyp from said group by word
),
runs as (select *, sum(case when kind = 'corr' then 1 else 0 end) over (partition by utt_id order by pos) as run from steps),
pieces as (
  select utt_id, min(pos) as pos, case when kind = 'corr' then any_value(ref) else '(' || coalesce(string_agg(ref, ' ' order by pos) filter (kind <> 'ins'), '*')
    || '->' || coalesce(string_agg(hyp, ' ' order by pos) filter (kind <> 'del'), '*') || ')' end as piece
  from runs group by utt_id, run, kind = 'corr', case when kind = 'corr' then 'corr' end
),
details as (select utt_id, string_agg(piece, ' ' order by pos) as detail from pieces group by utt_id)
"""


def _turn_steps(spark, sf):
    return op.align_words(t.turn_pairs(spark, sf))


def _from_table(select: str) -> str:
    return t.sql("turn_pairs", _TABLE_SQL + select)


@job("turn_alignment_a1", _from_table("select utt_id, pos, ref, hyp, kind from steps"))
def turn_alignment(spark, sf):
    return _turn_steps(spark, sf)


@job("turn_error_rate_a2", _from_table("select *, errors * 100 / ref_len as wer from summary"))
def turn_wer(spark, sf):
    return op.error_summary(_turn_steps(spark, sf))


@job("turn_substitutions_a3_o4", _from_table("select ref, hyp, count(*) as n from steps where kind = 'sub' group by ref, hyp order by n desc, ref desc, hyp desc"))
def turn_subs(spark, sf):
    return op.substitutions(_turn_steps(spark, sf))


@job("turn_deletions_a4_o4", _from_table("select ref, count(*) as n from steps where kind = 'del' group by ref order by n desc, ref desc"))
def turn_dels(spark, sf):
    return op.deletions(_turn_steps(spark, sf))


@job("turn_insertions_a4_o4", _from_table("select hyp, count(*) as n from steps where kind = 'ins' group by hyp order by n desc, hyp desc"))
def turn_ins(spark, sf):
    return op.insertions(_turn_steps(spark, sf))


@job("turn_word_stats_a5_o4", _from_table("select * from stats order by errors desc, word desc"))
def turn_stats(spark, sf):
    return op.word_stats(_turn_steps(spark, sf))


@job("turn_details_a6", _from_table("select * from details"))
def turn_details(spark, sf):
    return op.utterance_details(_turn_steps(spark, sf))


@job(
    "turn_error_report_s10",
    _from_table("""select 'SUMMARY' as section, 0::bigint as place, format('{} errors: {} insertions, {} deletions, {} substitutions, over {} reference words ({} correct)',
          errors, ins, del, sub, ref_len, corr) as line from summary
        union all select 'PER-UTT DETAILS', 0, utt_id || ':' || chr(9) || detail from details
        union all select 'SUBSTITUTIONS', count(*), count(*) || '   ' || ref || ' -> ' || hyp from steps where kind = 'sub' group by ref, hyp
        union all select 'DELETIONS', count(*), count(*) || '   ' || ref from steps where kind = 'del' group by ref
        union all select 'INSERTIONS', count(*), count(*) || '   ' || hyp from steps where kind = 'ins' group by hyp
        union all select 'PER-WORD STATS', errors, concat_ws(' ', word || '  ', corr, errors, in_ref, in_hyp) from stats"""),
)
def turn_report(spark, sf):
    return doc.report_lines(doc.error_report(t.turn_pairs(spark, sf)))


@job("word_alignment_a1")
def alignment(spark, sf):
    return _steps(spark, sf)


@job("word_error_rate_a2")
def wer(spark, sf):
    return op.error_summary(_steps(spark, sf))


@job("substitutions_a3_o4")
def subs(spark, sf):
    return op.substitutions(_steps(spark, sf))


@job("deletions_a4_o4")
def dels(spark, sf):
    return op.deletions(_steps(spark, sf))


@job("insertions_a4_o4")
def ins(spark, sf):
    return op.insertions(_steps(spark, sf))


@job("word_stats_a5")
def stats(spark, sf):
    return op.word_stats(_steps(spark, sf))


@job("utterance_details_a6")
def details(spark, sf):
    return op.utterance_details(_steps(spark, sf, whole=True))


@job(
    "words_compared_a7",
    r"""select doc_id, trim(regexp_replace(lower(regexp_replace(text, '[^\p{L}\p{N}'']', ' ', 'g')), ' +', ' ', 'g')) as text from documents""",
)
def compared(spark, sf):
    return t.read(spark, sf, "documents").select("doc_id", compact_words(F.col("text")).alias("text"))


@job(
    "stage_times_a8",
    t.sql("timings", "select job, stage, count(*) as n, cast(sum(centis) as bigint) as total, avg(centis) as mean, quantile_disc(centis, 0.5) as median, max(centis) as highest from timings group by job, stage"),
)
def stages(spark, sf):
    return op.stage_times(t.timings(spark, sf), "centis")


@job(
    "real_time_factor_a8",
    t.sql(
        "timings jobs",
        "select job, cast(sum(centis) as bigint) as total, duration_s as duration, case when duration_s > 0 then sum(centis) / duration_s end as rtf from timings join jobs using (job) group by job, duration_s",
    ),
)
def rtf(spark, sf):
    durations = t.jobs(spark, sf).select("job", F.col("duration_s").alias("duration"))
    return op.real_time_factor(t.timings(spark, sf), "centis", durations)

"""Word error rate reports and stage times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechtables.functions.alignment import edit_steps

GAP = "*"
CORRECT, SUBSTITUTED, DELETED, INSERTED = "corr", "sub", "del", "ins"


def align_words(pairs: DataFrame, key: str = "utt_id", whole: bool = False) -> DataFrame:
    """One row per step of the cheapest alignment: ``pos, ref, hyp, kind``; ``*`` marks a gap, a null side counts as empty.

    With ``whole``, one row per utterance that has steps, its ``steps`` in an array of ``ref, hyp, kind``.
    Alignment costs far more than moving the texts, so utterances are first spread evenly (an explicit
    number of partitions keeps adaptive execution from merging them again).
    """
    spread = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nothing = F.array().cast("array<string>")
    pairs = pairs.repartition(spread, key).select(key, *[F.coalesce(side, nothing).alias(side) for side in ("ref", "hyp")])


    def step(packed: Column) -> list[Column]:
        ref_at, hyp_at = F.shiftright(packed, 32).cast("int"), packed.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
        ref, hyp = F.coalesce(F.get("ref", ref_at - 1), F.lit(GAP)), F.coalesce(F.get("hyp", hyp_at - 1), F.lit(GAP))
        kind = F.when(ref_at == 0, INSERTED).when(hyp_at == 0, DELETED).when(ref == hyp, CORRECT).otherwise(SUBSTITUTED)
        return [ref.alias("ref"), hyp.alias("hyp"), kind.alias("kind")]

    if whole:
        aligned = pairs.select(key, F.transform(edit_steps("ref", "hyp"), lambda packed: F.struct(*step(packed))).alias("steps"))
        return aligned.filter(F.size("steps") > 0)
    packed = pairs.select(key, "ref", "hyp", F.posexplode(edit_steps("ref", "hyp")).alias("pos", "__step"))
    return packed.select(key, "pos", *step(F.col("__step")))


def error_summary(steps: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Insertions, deletions, substitutions, correct words, reference length, errors in percent."""
    count = {k: F.count_if(F.col("kind") == k) for k in (INSERTED, DELETED, SUBSTITUTED, CORRECT)}
    sums = steps.groupBy(*keys).agg(
        *[column.alias(k) for k, column in count.items()], F.count_if(F.col("kind") != INSERTED).alias("ref_len")
    )
    errors = F.col(INSERTED) + F.col(DELETED) + F.col(SUBSTITUTED)
    return sums.withColumn("errors", errors).withColumn("wer", F.when(F.col("ref_len") > 0, errors * 100 / F.col("ref_len")))


def substitutions(steps: DataFrame) -> DataFrame:
    pairs = steps.filter(F.col("kind") == SUBSTITUTED).groupBy("ref", "hyp").agg(F.count(F.lit(1)).alias("n"))
    return pairs.orderBy(F.desc("n"), F.desc("ref"), F.desc("hyp"))


def deletions(steps: DataFrame) -> DataFrame:
    return steps.filter(F.col("kind") == DELETED).groupBy("ref").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("ref"))


def insertions(steps: DataFrame) -> DataFrame:
    return steps.filter(F.col("kind") == INSERTED).groupBy("hyp").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("hyp"))


def word_stats(steps: DataFrame) -> DataFrame:
    """Per word: correct, errors, occurrences in reference and hypothesis."""
    kind = F.col("kind")
    roles = F.array_compact(
        F.array(
            F.when(kind == CORRECT, F.struct(F.col("ref").alias("word"), F.lit("corr").alias("role"))),
            F.when(kind.isin(SUBSTITUTED, DELETED), F.struct(F.col("ref").alias("word"), F.lit("ref").alias("role"))),
            F.when(kind.isin(SUBSTITUTED, INSERTED), F.struct(F.col("hyp").alias("word"), F.lit("hyp").alias("role"))),
        )
    )
    each = steps.select(F.explode(roles).alias("r")).select("r.word", "r.role")
    counts = each.groupBy("word").agg(
        F.count_if(F.col("role") == "corr").alias("corr"),
        F.count_if(F.col("role") == "ref").alias("__r"),
        F.count_if(F.col("role") == "hyp").alias("__h"),
    )
    return counts.select(
        "word",
        "corr",
        (F.col("__r") + F.col("__h")).alias("errors"),
        (F.col("corr") + F.col("__r")).alias("in_ref"),
        (F.col("corr") + F.col("__h")).alias("in_hyp"),
    ).orderBy(F.desc("errors"), F.desc("word"))


def utterance_details(steps: DataFrame, key: str = "utt_id") -> DataFrame:
    """Each utterance as one line; a run of errors reads ``(reference->hypothesis)``.

    Steps come as rows or, from ``align_words(whole=True)``, as whole utterances, which need not be gathered."""
    if "steps" not in steps.columns:
        in_order = F.array_sort(F.collect_list(F.struct("pos", "ref", "hyp", "kind")))
        steps = steps.groupBy(key).agg(in_order.alias("steps"))
    right = lambda at: F.get("steps", at)["kind"] == CORRECT
    opens = lambda at: (at == 0) | (right(at) != right(at - 1))
    begins = F.filter(F.sequence(F.lit(0), F.size("steps") - 1), opens)

    def side(run: Column, name: str, gap_kind: str) -> Column:
        joined = F.array_join(F.transform(F.filter(run, lambda step: step["kind"] != gap_kind), lambda step: step[name]), " ")
        return F.coalesce(F.nullif(joined, F.lit("")), F.lit(GAP))

    def piece(at: Column, place: Column) -> Column:
        run = F.slice("steps", at + 1, F.coalesce(F.get("__begins", place + 1), F.size("steps")) - at)
        said = F.array_join(F.transform(run, lambda step: step["ref"]), " ")
        errors = F.concat(F.lit("("), side(run, "ref", INSERTED), F.lit("->"), side(run, "hyp", DELETED), F.lit(")"))
        return F.when(right(at), said).otherwise(errors)

    runs = steps.select(key, "steps", begins.alias("__begins"))
    return runs.select(key, F.array_join(F.transform("__begins", piece), " ").alias("detail"))


def stage_times(timings: DataFrame, value: str, keys: Sequence[str] = ("job", "stage")) -> DataFrame:
    """Number, sum, mean, highest and approximate median of the stage times."""
    return timings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(value).alias("total"),
        F.avg(value).alias("mean"),
        F.max(value).alias("highest"),
        F.percentile_approx(value, 0.5, 10_000).alias("median"),
    )


def real_time_factor(timings: DataFrame, value: str, durations: DataFrame, key: str = "job") -> DataFrame:
    """Processing time over audio time, per job."""
    total = timings.groupBy(key).agg(F.sum(value).alias("total"))
    return total.join(durations, key).withColumn("rtf", F.when(F.col("duration") > 0, F.col("total") / F.col("duration")))

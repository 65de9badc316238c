"""Recurrences without a closed form, run block-parallel with a carried state.

Every block of a recording is run from a guessed entry state; the exit state of a block is the
true entry state of the next one. Blocks whose guess was wrong run again until nothing changes.
After round r the first r blocks of every recording are right, so the result is exact; machines
that forget their past (all those used here do at a pause) settle after one or two rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechtables.session import cut_lineage

_BLOCK = "__block"

Step = Callable[[pd.DataFrame, str, bool], tuple[pd.DataFrame, str]]


def fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    step: Step,
    schema: str,
    initial: str = "",
    guess: str | None = None,
) -> DataFrame:
    """Run ``step(rows, state, is_last) -> (output rows, next state)`` along each recording.

    ``rows`` are the rows of one block in order, ``state`` a canonical string: ``initial`` for the first
    block of a recording, at first ``guess`` for the others. A state should hold nothing that grows
    along the recording (counters, absolute positions), so that a wrong guess is forgotten.
    ``schema`` describes the output without the keys, which are put in front.
    """
    keys, order = list(keys), list(order)
    base = df.withColumn(_BLOCK, block)
    chain = Window.partitionBy(*keys).orderBy(_BLOCK)
    blocks = base.groupBy(*keys, _BLOCK).agg(F.count(F.lit(1)).alias("__n")).select(
        *keys,
        _BLOCK,
        F.lag(_BLOCK).over(chain).alias("__before"),
        F.lead(_BLOCK).over(chain).isNull().alias("__last"),
        F.when(F.lag(_BLOCK).over(chain).isNull(), F.lit(initial)).otherwise(F.lit(initial if guess is None else guess)).alias("__state"),
    )
    if not blocks.filter(F.col("__before").isNotNull()).isEmpty():
        blocks = _settle(base, blocks, keys, order, step)

    fields = [df.schema[k] for k in keys]
    out_schema = T.StructType([*fields, *T.StructType.fromDDL(schema).fields])

    def emit(key, rows: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        out, _ = step(
            rows.sort_values(order, ignore_index=True), entry["__state"].iloc[0], bool(entry["__last"].iloc[0])
        )
        out = pd.DataFrame(out)
        for at, name in enumerate(keys):
            out.insert(at, name, key[at])
        return out[out_schema.names] if len(out) else pd.DataFrame(columns=out_schema.names)

    return _pair(base, blocks, keys).applyInPandas(emit, out_schema)


def _pair(base: DataFrame, blocks: DataFrame, keys: list[str]):
    by = [*keys, _BLOCK]
    entries = blocks.select(*[F.col(c).alias(f"__e_{c}") for c in by], "__state", "__last")
    return base.groupBy(*by).cogroup(entries.groupBy(*[f"__e_{c}" for c in by]))


def _settle(base: DataFrame, blocks: DataFrame, keys: list[str], order: list[str], step: Step) -> DataFrame:
    exit_schema = T.StructType(
        [*[base.schema[k] for k in keys], T.StructField(_BLOCK, T.LongType()), T.StructField("__exit", T.StringType())]
    )

    def leave(key, rows: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or entry.empty:
            return pd.DataFrame(columns=exit_schema.names)
        _, state = step(rows.sort_values(order, ignore_index=True), entry["__state"].iloc[0], False)
        return pd.DataFrame([[*key, state]], columns=exit_schema.names)

    states = cut_lineage(blocks.withColumn("__exit", F.lit(None).cast("string")).withColumn("__dirty", ~F.col("__last")))
    while True:
        dirty = states.filter("__dirty").select(*keys, _BLOCK, "__state", "__last")
        rows = base.join(dirty.select(*keys, _BLOCK), [*keys, _BLOCK], "left_semi")
        fresh = _pair(rows, dirty, keys).applyInPandas(leave, exit_schema).withColumnRenamed("__exit", "__fresh")
        known = states.join(fresh, [*keys, _BLOCK], "left").select(
            *keys, _BLOCK, "__before", "__last", "__state", F.coalesce("__fresh", "__exit").alias("__exit")
        )
        chain = Window.partitionBy(*keys).orderBy(_BLOCK)
        moved = known.withColumn("__entry", F.coalesce(F.lag("__exit").over(chain), F.col("__state")))
        states = cut_lineage(
            moved.select(
                *keys,
                _BLOCK,
                "__before",
                "__last",
                F.col("__entry").alias("__state"),
                "__exit",
                ((F.col("__entry") != F.col("__state")) & ~F.col("__last")).alias("__dirty"),
            )
        )
        if states.filter("__dirty").isEmpty():
            return states.select(*keys, _BLOCK, "__before", "__last", "__state")

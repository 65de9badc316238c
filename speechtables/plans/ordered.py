"""Ordered computations over recordings that may be arbitrarily long.

A plain ``Window.partitionBy("recording_id")`` puts a whole recording into one task. Here every
recording is cut into blocks of bounded size: the work inside a block is an ordinary window over
(recording, block), and what must cross a block edge travels either as duplicated edge rows
(``neighbours``) or in a table with one row per block (``scan``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 16

_BLOCK = "__block"
_UNBOUNDED = Window.unboundedPreceding

Columns = Mapping[str, Column]


def row_block(seq: str, rows: int = BLOCK_ROWS) -> Column:
    """Block number of a dense ordinal: at most ``rows`` rows share one."""
    return F.expr(f"`{seq}` div {rows}")


def with_ordinal(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    name: str = "seq",
    base: int = 0,
) -> DataFrame:
    """Dense ordinals per key without sorting a whole key in one task.

    ``bucket`` must grow with ``order`` (for example the minute of the leading time column).
    Rows are counted per (key, bucket) with map-side combine, the counts are summed up per key,
    and only rows of one bucket are numbered together.
    """
    tagged = df.withColumn(_BLOCK, bucket)
    counts = tagged.groupBy(*keys, _BLOCK).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(_UNBOUNDED, -1)
    offsets = counts.select(*keys, _BLOCK, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*keys, _BLOCK).orderBy(*order)
    return (
        tagged.join(offsets, [*keys, _BLOCK])
        .withColumn(name, F.col("__offset") + F.row_number().over(inside) - 1 + base)
        .drop(_BLOCK, "__offset")
    )


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    prev: Columns | None = None,
    next: Columns | None = None,
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Values of the previous and next row of each recording, one shuffle, no carry table.

    ``seq`` must be dense. The first and last row of a block are copied into the adjoining block,
    where they serve as neighbours and are dropped again.
    """
    home = row_block(seq, rows)
    edge = F.expr(f"`{seq}` % {rows}")
    copies = F.array_compact(
        F.array(
            home,
            F.when(edge == rows - 1, home + 1) if prev else F.lit(None).cast("bigint"),
            F.when(edge == 0, home - 1) if next else F.lit(None).cast("bigint"),
        )
    )
    window = Window.partitionBy(*keys, _BLOCK).orderBy(seq)
    out = df.withColumn(_BLOCK, F.explode(copies))
    for name, value in (prev or {}).items():
        out = out.withColumn(name, F.lag(value).over(window))
    for name, value in (next or {}).items():
        out = out.withColumn(name, F.lead(value).over(window))
    return out.filter(F.col(_BLOCK) == home).drop(_BLOCK)


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    *,
    total: Columns | None = None,
    latest: Columns | None = None,
    upcoming: Columns | None = None,
    peak: Columns | None = None,
    prev: Columns | None = None,
    next: Columns | None = None,
    overall: Mapping[str, tuple[str, Column]] | None = None,
) -> DataFrame:
    """Running values over a recording, computed block by block.

    ``block`` must grow with ``order`` and bound the rows that share a value.

    total     sum up to and including the row
    latest    last non-null value up to and including the row
    upcoming  first non-null value from the row on
    peak      maximum over the rows before this one
    prev/next value on the adjoining row
    overall   ("sum" | "min" | "max", value) over the whole recording
    """
    specs = {
        "total": dict(total or {}),
        "latest": dict(latest or {}),
        "upcoming": dict(upcoming or {}),
        "peak": dict(peak or {}),
        "prev": dict(prev or {}),
        "next": dict(next or {}),
    }
    overall = dict(overall or {})
    base = df.withColumn(_BLOCK, block)
    position = F.struct(*order)

    per_block = []
    carried = []
    backward = Window.partitionBy(*keys).orderBy(F.col(_BLOCK).desc()).rowsBetween(_UNBOUNDED, -1)
    forward = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(_UNBOUNDED, -1)
    step = Window.partitionBy(*keys).orderBy(_BLOCK)
    for kind, spec in specs.items():
        for name, value in spec.items():
            here, carry = f"__{kind}_{name}", f"__carry_{name}"
            known = F.when(value.isNotNull(), position)
            if kind == "total":
                per_block.append(F.sum(value).alias(here))
                carried.append(F.sum(here).over(forward).alias(carry))
            elif kind == "peak":
                per_block.append(F.max(value).alias(here))
                carried.append(F.max(here).over(forward).alias(carry))
            elif kind == "latest":
                per_block.append(F.max_by(value, known).alias(here))
                carried.append(F.last(here, ignorenulls=True).over(forward).alias(carry))
            elif kind == "upcoming":
                per_block.append(F.min_by(value, known).alias(here))
                carried.append(F.last(here, ignorenulls=True).over(backward).alias(carry))
            elif kind == "prev":
                per_block.append(F.max_by(F.struct(value.alias("v")), position).alias(here))
                carried.append(F.lag(here).over(step).alias(carry))
            else:
                per_block.append(F.min_by(F.struct(value.alias("v")), position).alias(here))
                carried.append(F.lead(here).over(step).alias(carry))
    whole = Window.partitionBy(*keys)
    for name, (how, value) in overall.items():
        fn = {"sum": F.sum, "min": F.min, "max": F.max}[how]
        per_block.append(fn(value).alias(f"__overall_{name}"))
        carried.append(fn(f"__overall_{name}").over(whole).alias(f"__carry_{name}"))
    carries = base.groupBy(*keys, _BLOCK).agg(*per_block).select(*keys, _BLOCK, *carried)

    out = base.join(carries, [*keys, _BLOCK])
    ascending = Window.partitionBy(*keys, _BLOCK).orderBy(*order)
    descending = Window.partitionBy(*keys, _BLOCK).orderBy(*[F.col(c).desc() for c in order])
    added = []
    for kind, spec in specs.items():
        for name, value in spec.items():
            carry = F.col(f"__carry_{name}")
            if kind == "total":
                inside = F.sum(value).over(ascending.rowsBetween(_UNBOUNDED, 0))
                result = F.coalesce(inside + carry, inside, carry)
            elif kind == "peak":
                result = F.greatest(F.max(value).over(ascending.rowsBetween(_UNBOUNDED, -1)), carry)
            elif kind == "latest":
                result = F.coalesce(F.last(value, ignorenulls=True).over(ascending.rowsBetween(_UNBOUNDED, 0)), carry)
            elif kind == "upcoming":
                result = F.coalesce(F.last(value, ignorenulls=True).over(descending.rowsBetween(_UNBOUNDED, 0)), carry)
            elif kind == "prev":
                result = F.coalesce(F.lag(F.struct(value.alias("v"))).over(ascending), carry)["v"]
            else:
                result = F.coalesce(F.lead(F.struct(value.alias("v"))).over(ascending), carry)["v"]
            added.append(result.alias(name))
    for name in overall:
        added.append(F.col(f"__carry_{name}").alias(name))
    return out.select(*df.columns, *added)


def run_ids(df: DataFrame, keys: Sequence[str], seq: str, opens: Column, name: str = "run", rows: int = BLOCK_ROWS) -> DataFrame:
    """Number of the run each row belongs to; ``opens`` marks the first row of a run."""
    return scan(df, keys, [seq], row_block(seq, rows), total={name: opens.cast("bigint")})

"""Sliding windows, embeddings, affinity graphs and speaker clustering."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechtables.operators.jobs import scale_profile
from speechtables.plans.asof import next_mark
from speechtables.plans.bitgraph import BitGraph, degrees
from speechtables.plans.ordered import row_block, scan
from speechtables.plans.ranges import explode_count
from speechtables.plans.skew import spread_lookup
from speechtables.plans.spectral import UPPER, cluster_points, least_eigenpairs, least_eigenvalues
from speechtables.plans.tiles import TILE_ROWS, best_columns, per_pair, similarity, tile_pairs, unit
from speechtables.session import cut_lineage

KEYS = ("recording_id",)

# Shortest sub-window (milliseconds), number of steps of a p-search, share of neighbours
# searched, sizes below which counting works differently, guard against zero.
MIN_WINDOW_MS = 50
SEARCH_STEPS = 30
SEARCH_SHARE = 0.25
FEW_ROWS = 6
SHORT_ROWS = 80
MAX_SPEAKERS = 8
EPS = 1e-10

#: Most windows of a dense matrix and of a graph of bits (``plans/bitgraph.py``, 268 MB) in one task, most edges of
#: such a graph; larger recordings are solved on tables.
TASK_ROWS = 2048
BIT_ROWS = 1 << 15
TASK_EDGES = 2 * BIT_ROWS * BIT_ROWS
#: Most tasks that a search is dealt to.
SEARCH_TASKS = 1024


# ---- windows and scoring -------------------------------------------------------------------


def sub_windows(regions: DataFrame, scales: Column, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Sliding windows of every scale over every region (milliseconds); the last one is clipped,
    windows of ``MIN_WINDOW_MS`` or less are left out."""
    per_scale = regions.withColumn("__s", F.explode(scales)).select(
        *regions.columns, F.col("__s.scale").alias("scale"), F.col("__s.window").alias("__w"), F.col("__s.shift").alias("__h")
    )
    steps = F.ceil((F.col(end) - F.col(start) - F.col("__w")) / F.col("__h"))
    out = explode_count(per_scale, F.when(steps < 0, 1).otherwise(steps + 1), "slice")
    offset = F.col(start) + F.col("slice") * F.col("__h")
    length = F.least(offset + F.col("__w"), F.col(end)) - offset
    return out.withColumn("offset", offset).withColumn("duration", length).filter(F.col("duration") > MIN_WINDOW_MS).drop("__w", "__h")


def sub_windows_for(regions: DataFrame, duration_s: Column, **kw) -> DataFrame:
    """Sub-windows with the scales that suit the recording's length."""
    return sub_windows(regions, scale_profile(duration_s), **kw)


def score_batches(rows: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply the user's model to Arrow batches; it must give one row per window."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = scorer(batch)
            if len(out) != len(batch):
                raise ValueError("Mismatch of counts between embedding vectors and timestamps")
            yield out

    return rows.mapInPandas(run, schema)


# ---- scales --------------------------------------------------------------------------------


def anchor(offset: Column, duration: Column, kind: str = "reference") -> Column:
    """Point windows are compared by: mean of offset and duration, or the true middle."""
    return (offset + duration) / 2 if kind == "reference" else offset + duration / 2


def nearest_windows(base: DataFrame, others: DataFrame, width: float, keys: Sequence[str] = KEYS, kind: str = "reference") -> DataFrame:
    """For every base window and scale the nearest window by anchor (lowest index at equal distance).

    ``base``: keys, i, offset, duration; ``others``: keys, scale, seg, offset, duration. Two as-of
    lookups, forward and (on negated time) backward; no product of windows is formed.
    """
    marks = (
        others.withColumn("__a", anchor(F.col("offset"), F.col("duration"), kind))
        .groupBy(*keys, "scale", "__a")
        .agg(F.min("seg").alias("seg"))
        .withColumn("__minus", -F.col("__a"))
    )
    scales = others.select(*keys, "scale").distinct()
    points = base.select(*keys, "i", anchor(F.col("offset"), F.col("duration"), kind).alias("__at")).withColumn("__minus_at", -F.col("__at"))
    points = spread_lookup(points, scales, keys, F.col("i"))
    by = [*keys, "scale"]
    ahead = next_mark(points, "__at", marks.select(*by, "seg", "__a"), "__a", by, ["seg"], width, or_last=False, name="__next")
    both = next_mark(
        ahead, "__minus_at", marks.select(*by, "seg", "__a", "__minus"), "__minus", by, ["seg"], width, or_last=False, name="__prev"
    )
    after = F.struct((F.col("__next.__a") - F.col("__at")).alias("d"), F.col("__next.seg").alias("seg"))
    before = F.struct((F.col("__at") - F.col("__prev.__a")).alias("d"), F.col("__prev.seg").alias("seg"))
    best = F.when(F.col("__next").isNull(), before).when(F.col("__prev").isNull(), after).otherwise(F.least(before, after))
    return both.select(*by, "i", best["seg"].alias("seg"))


def labels_on_scales(labels: DataFrame, mapping: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Base labels carried over to the windows of longer scales: the most frequent label (first come
    at equal counts); a window no base window maps to takes the label before it, 0 at the start."""
    counted = (
        mapping.join(labels.select(*keys, "i", "label"), [*keys, "i"])
        .groupBy(*keys, "scale", "seg", "label")
        .agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first"))
    )
    top = counted.groupBy(*keys, "scale", "seg").agg(F.max_by("label", F.struct("n", -F.col("first"))).alias("label"))
    by = [*keys, "scale"]
    every = explode_count(top.groupBy(*by).agg((F.max("seg") + 1).alias("__n")), F.col("__n"), "seg").drop("__n")
    filled = scan(every.join(top, [*by, "seg"], "left"), by, ["seg"], row_block("seg"), latest={"__known": F.col("label")})
    return filled.select(*by, "seg", F.coalesce("__known", F.lit(0)).alias("label"))


# ---- similarity ----------------------------------------------------------------------------


def single_scale(embeddings: DataFrame, keys: Sequence[str] = KEYS, index: str = "seg_idx", vec: str = "vec") -> DataFrame:
    """Embedding rows in the form the affinity functions take: ``i, vectors, owners``."""
    return embeddings.select(*keys, F.col(index).alias("i"), F.array(unit(F.col(vec))).alias("vectors"), F.array(F.col(index)).alias("owners"))


def multi_scale(base: DataFrame, mapping: DataFrame, embeddings: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Base windows with one unit vector per scale, looked up through the scale mapping."""
    looked = mapping.join(embeddings.select(*keys, "scale", "seg", unit(F.col("vec")).alias("__v")), [*keys, "scale", "seg"])
    rows = looked.groupBy(*keys, "i").agg(F.array_sort(F.collect_list(F.struct("scale", "seg", "__v"))).alias("__s"))
    return rows.select(
        *keys, "i", F.transform("__s", lambda s: s["__v"]).alias("vectors"), F.transform("__s", lambda s: s["seg"]).alias("owners")
    )


def affinity_range(rows: DataFrame, keys: Sequence[str] = KEYS, scales: int = 1, tile: int = TILE_ROWS) -> DataFrame:
    """Lowest and highest cosine per recording and scale."""

    def summarise(row):
        blocks = list(similarity(row, scales))
        return pd.DataFrame({"scale": range(scales), "lo": [b.min() for b in blocks], "hi": [b.max() for b in blocks]})

    pairs = tile_pairs(rows, keys, tile)
    parts = per_pair(pairs, keys, summarise, "scale int, lo double, hi double")
    # a small table behind quadratic work: written once, so that no later step repeats it
    return cut_lineage(parts.groupBy(*keys, "scale").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))


def row_summary(rows: DataFrame, keys: Sequence[str] = KEYS, tile: int = TILE_ROWS) -> DataFrame:
    """Per vector: most and least similar other vector and the sum of all its cosines."""

    def summarise(row):
        (block,) = similarity(row, 1)
        ids, others = np.asarray(row.ids), np.asarray(row.ids_b)
        same = ids[:, None] == others[None, :]
        high, low = np.where(same, -np.inf, block), np.where(same, np.inf, block)
        at_high, at_low, each = high.argmax(1), low.argmin(1), np.arange(len(ids))
        return pd.DataFrame(
            {
                "i": ids,
                "hi": high[each, at_high],
                "hi_j": others[at_high],
                "lo": low[each, at_low],
                "lo_j": others[at_low],
                "total": block.sum(1),
                "n": len(others),
            }
        )

    pairs = tile_pairs(rows, keys, tile)
    parts = per_pair(pairs, keys, summarise, "i bigint, hi double, hi_j bigint, lo double, lo_j bigint, total double, n bigint")
    return parts.groupBy(*keys, "i").agg(
        F.max_by("hi_j", F.struct("hi", -F.col("hi_j"))).alias("nearest"),
        F.min_by("lo_j", F.struct("lo", "hi_j")).alias("farthest"),
        F.sum("total").alias("total"),
        F.sum("n").alias("n"),
    )


def neighbour_edges(
    rows: DataFrame,
    p: int,
    keys: Sequence[str] = KEYS,
    weights: Sequence[float] = (1.0,),
    ranges: DataFrame | None = None,
    method: str = "binary",
    tile: int = TILE_ROWS,
) -> DataFrame:
    """Each vector's ``p`` most similar vectors (itself included, lowest index at equal similarity) as
    edges ``i, j, rank, weight``.

    With several scales the similarity is the weighted sum of the min-max normalised cosines; then
    ``ranges`` (see ``affinity_range``) is needed. ``method``: ``binary`` gives weight 1, ``drop`` the
    similarity, ``sigmoid`` its logistic. A tile pair hands on ``p`` candidates per row.
    """
    scales = len(weights)
    stretched = ranges is not None
    # looked up before tiles are copied: pairs are far more than tiles
    ranged = lambda tiles: _with_ranges(tiles.withColumnRenamed("tile", "i"), ranges, keys).withColumnRenamed("i", "tile")
    pairs = tile_pairs(rows, keys, tile, ranged if stretched else None)

    def summarise(row):
        fused = 0.0
        for s, block in enumerate(similarity(row, scales)):
            if stretched:
                span = row.hi[s] - row.lo[s]
                block = (block - row.lo[s]) / span if span > 0 else np.ones_like(block)
            fused = fused + weights[s] * block
        others = np.asarray(row.ids_b)
        take = min(p, len(others))
        best = best_columns(fused, take)
        return pd.DataFrame(
            {
                "i": np.repeat(row.ids, take),
                "j": others[best].ravel(),
                "sim": np.take_along_axis(fused, best, 1).ravel(),
            }
        )

    found = per_pair(pairs, keys, summarise, "i bigint, j bigint, sim double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "i").orderBy(F.desc("sim"), "j")))
    weight = {"binary": F.lit(1.0), "drop": F.col("sim"), "sigmoid": 1 / (1 + F.exp(-F.col("sim")))}[method]
    return ranked.filter(F.col("rank") <= p).select(*keys, "i", "j", "rank", weight.alias("weight"))


# ---- graph ---------------------------------------------------------------------------------


def symmetrise(edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Half the sum of the graph and its transpose (one pass over the edges)."""
    ways = F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    both = edges.select(*keys, "weight", F.explode(ways).alias("e"))
    return both.groupBy(*keys, "e.i", "e.j").agg((F.sum("weight") / 2).alias("weight"))


def laplacian(graph: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Degree on the diagonal, negative weights elsewhere (only non-zero entries; isolated nodes 0).
    One pass over the graph: every edge adds to its row's degree and stands for itself."""
    loop = F.col("i") == F.col("j")
    degree = F.struct(F.col("i").alias("j"), F.when(loop, F.lit(0.0)).otherwise(F.abs("weight")).alias("value"))
    entry = F.when(~loop, F.struct("j", (-F.col("weight")).alias("value")))
    parts = graph.select(*keys, "i", F.explode(F.array_compact(F.array(degree, entry))).alias("e"))
    return parts.groupBy(*keys, "i", "e.j").agg(F.sum("e.value").alias("value"))


def components(edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Smallest node of each node's connected component.

    Alternates two star steps (link larger neighbours, then smaller ones, to the smallest neighbour)
    until no edge changes; the number of rounds grows with the logarithm of the graph, and lineage is
    cut every round. Lookups are spread, so a hub does not end up in one task.
    """
    keys = list(keys)
    edges = cut_lineage(edges.select(*keys, "i", "j"))
    nodes = edges.select(*keys, F.col("i").alias("node")).unionByName(edges.select(*keys, F.col("j").alias("node"))).distinct()
    links = cut_lineage(
        edges.filter(F.col("i") != F.col("j"))
        .select(*keys, F.greatest("i", "j").alias("u"), F.least("i", "j").alias("v"))
        .distinct()
    )

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs
        if large:
            both = pairs.unionByName(pairs.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        near = spread_lookup(both, lowest, [*keys, "u"], F.col("v"))
        if large:
            moved = near.filter(F.col("v") > F.col("u")).select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            moved = near.filter(F.col("v") != F.col("m")).select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
            moved = moved.unionByName(lowest.filter(F.col("u") != F.col("m")).select(*keys, "u", F.col("m").alias("v")))
        return moved.filter(F.col("u") != F.col("v")).distinct()

    while True:
        fresh = cut_lineage(star(star(links, True), False))
        changed = not (links.exceptAll(fresh).isEmpty() and fresh.exceptAll(links).isEmpty())
        links = fresh
        if not changed:
            break
    return nodes.join(links.select(*keys, F.col("u").alias("node"), F.col("v").alias("root")), [*keys, "node"], "left").select(
        *keys, "node", F.coalesce("root", "node").alias("root")
    )


def connected(edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per recording whether its graph hangs together."""
    return components(edges, keys).groupBy(*keys).agg((F.min("root") == F.max("root")).alias("connected"))


def connection_rank(edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The least number of neighbours (``connects``) that makes each recording's graph hang together; null if all of
    ``edges`` (``i, j, rank``) do not.

    That number is the heaviest edge of a minimum spanning tree with ranks as weights. Each round every node takes
    its lightest edge (ties by its ends), which is in such a tree; a node whose edge leads to a smaller node that
    stays is merged into that one, and of the edges between two nodes the lightest is kept. The lightest edge
    of every component is merged, so the rounds end.
    """
    keys = list(keys)
    ends = edges.select(*keys, F.col("i").alias("node")).unionByName(edges.select(*keys, F.col("j").alias("node")))
    nodes = ends.distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))

    def lightest(pairs: DataFrame) -> DataFrame:
        one_way = pairs.filter("u <> v").select(*keys, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "rank")
        return cut_lineage(one_way.groupBy(*keys, "u", "v").agg(F.min("rank").alias("rank")))

    links = lightest(edges.select(*keys, F.col("i").alias("u"), F.col("j").alias("v"), "rank"))
    merges = None
    while not links.isEmpty():
        by_end = links.select(*keys, F.struct("rank", "u", "v").alias("e"), F.explode(F.array("u", "v")).alias("end"))
        taken = by_end.groupBy(*keys, "end").agg(F.min("e").alias("e"))
        into = taken.select(*keys, "end", F.least("e.u", "end").alias("into"), F.col("e.rank").alias("rank"))
        above = into.select(*keys, F.col("end").alias("into"), F.col("into").alias("above"))
        merged = (F.col("into") < F.col("end")) & (F.col("above") == F.col("into"))
        name = F.when(merged, F.col("into")).otherwise(F.col("end"))
        names = cut_lineage(into.join(above, [*keys, "into"]).select(*keys, "end", name.alias("name"), "rank"))
        done = names.filter(F.col("name") < F.col("end")).groupBy(*keys).agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("merged"))
        merges = done if merges is None else merges.unionByName(done)
        moved = links
        for end in ("u", "v"):
            moved = moved.join(names.select(*keys, F.col("end").alias(end), F.col("name").alias(f"__{end}")), [*keys, end])
        links = lightest(moved.select(*keys, F.col("__u").alias("u"), F.col("__v").alias("v"), "rank"))
    if merges is None:
        return nodes.select(*keys, F.when(F.col("n") == 1, 1).cast("int").alias("connects"))
    trees = merges.groupBy(*keys).agg(F.max("rank").alias("rank"), F.sum("merged").alias("merged"))
    left = F.col("n") - F.coalesce("merged", F.lit(0))
    whole = F.when(left == 1, F.coalesce("rank", F.lit(1)).cast("int"))
    return cut_lineage(nodes.join(trees, keys, "left").select(*keys, whole.alias("connects")))


def minimum_connection(
    rows: DataFrame,
    most: DataFrame,
    keys: Sequence[str] = KEYS,
    weights: Sequence[float] = (1.0,),
    ranges: DataFrame | None = None,
    first: int = 8,
) -> DataFrame:
    """``connection_rank`` of the neighbour graph of ``rows``, up to ``most`` neighbours per recording; null: none.

    Graphs hang together with few neighbours as a rule, so ``first`` are looked at, then four times as many in the
    recordings that need more.
    """
    keys = list(keys)
    open_, p, found = cut_lineage(most), first, None
    while True:
        here = spread_lookup(rows, open_.select(*keys), keys, F.col("i"))
        ranked = connection_rank(neighbour_edges(here, p, keys, weights, ranges, method="drop"), keys)
        told = cut_lineage(open_.join(ranked, keys, "left"))
        done = told.filter(F.col("connects").isNotNull() | (F.col("most") <= p))
        found = done if found is None else found.unionByName(done)
        open_ = told.filter(F.col("connects").isNull() & (F.col("most") > p)).drop("connects")
        if open_.isEmpty():
            break
        p *= 4
    return found.select(*keys, F.when(F.col("connects") <= F.col("most"), F.col("connects")).alias("connects"))


# ---- counting and clustering ---------------------------------------------------------------


def search_list(n: int, share: float, volume: int) -> np.ndarray:
    """Numbers of neighbours to try for ``n`` rows."""
    most = max(int(n * share), 2)
    return np.linspace(1, most, min(most, max(min(most, volume), 2))).astype(int)


def neighbour_graph(affinity: np.ndarray, p: int) -> np.ndarray:
    """Symmetric graph of every row's ``p`` best (``p <= 0`` keeps the affinity)."""
    if p <= 0:
        return (affinity + affinity.T) / 2
    graph = np.zeros_like(affinity)
    best = np.argsort(-affinity, axis=1, kind="stable")[:, :p]
    np.put_along_axis(graph, best, 1.0, axis=1)
    return (graph + graph.T) / 2


def spectrum(graph: np.ndarray, vectors: bool = False):
    """Eigenvalues (and vectors) of the graph's Laplacian, ascending."""
    off = graph - np.diag(np.diag(graph))
    matrix = np.diag(np.abs(off).sum(1)) - off
    return np.linalg.eigh(matrix) if vectors else np.linalg.eigvalsh(matrix)


def is_connected(graph: np.ndarray) -> bool:
    seen = np.zeros(len(graph), dtype=bool)
    front = seen.copy()
    front[0] = True
    while front.any():
        seen |= front
        front = (graph[front] != 0).any(0) & ~seen
    return bool(seen.all())


def eigen_gap(affinity: np.ndarray, p: int, most: int) -> tuple[float, int]:
    """For ``p`` neighbours: ratio of ``p`` to the widest eigengap, and the speakers it suggests."""
    if len(affinity) == 1:
        return 1 / EPS, 1
    values = spectrum(neighbour_graph(affinity, p))
    return gap_ratio(values[: most + 1], values.max(), p, len(affinity))


def gap_ratio(least: np.ndarray, largest: float, p: int, n: int) -> tuple[float, int]:
    gaps = np.diff(least)
    wide = int(np.argmax(gaps))
    return (p / n) / (gaps[wide] / (largest + EPS) + EPS), wide + 1


def search_pick(table: pd.DataFrame, most: int) -> tuple[int, int]:
    """Neighbours and speakers from a table of (p, ratio, speakers, connected) in order of p.

    The lowest ratio wins. If its graph is not connected, p grows through the list until one step after
    the graph before it was connected (starting from one neighbour), or past the largest p.
    """
    at = int(table["ratio"].to_numpy().argmin())
    if not table["connected"].iloc[at]:
        before = bool(table["connected_at_one"].iloc[0])
        for at in range(len(table)):
            if before or table["p"].iloc[at] > most:
                break
            before = bool(table["connected"].iloc[at])
    return int(table["p"].iloc[at]), int(table["speakers"].iloc[at])


#: Share by which a bound has to be beyond a ratio, so that rounding decides nothing.
BOUND_MARGIN = 1e-6


def bit_search(part: pd.DataFrame, weights: Sequence[float], steps: np.ndarray, speakers: int) -> tuple[int, int]:
    """What ``search_pick`` finds in the whole table of ``steps``, with only the eigenvalues that it takes.

    No gap is wider than the highest of the eigenvalues looked at, so an upper bound of that one and a lower bound of the
    largest eigenvalue give a lower bound of the ratio. First bounds come from the degrees: an eigenvalue of the
    Laplacian is at most that of any part of the matrix, here of the nodes with the lowest degrees (their weights among
    each other are at most 1 each), and the largest is no less than any degree. Each round of the eigenvalue
    search gives closer ones. Numbers of neighbours are solved in order of their bounds; one whose bound is above the
    lowest ratio is given up. A graph of more neighbours holds that of fewer, so the graphs that hang together
    are the last ones of the list.
    """
    n, last = len(part), len(steps) - 1
    graphs: dict[int, BitGraph] = {}
    solved: dict[int, tuple[float, int]] = {}
    whole: dict[int, bool] = {}
    at_one = []

    def graph(at: int) -> BitGraph:
        if at not in graphs:
            graphs.clear()  # one at a time
            graphs[at] = BitGraph(part, weights, int(steps[at]))
            whole[at] = graphs[at].connected()
            at_one[:] = [graphs[at].connected_by_nearest()]
        return graphs[at]

    def hangs_together(at: int) -> bool:
        if at not in whole:
            graph(at)
        return whole[at]

    def bound(at: int, gap: float, largest: float) -> float:
        return (steps[at] / n) / (max(gap, 0.0) / (largest + EPS) + EPS) * (1 - BOUND_MARGIN)

    def solve(at: int, most: float) -> bool:
        enough = lambda least, largest: len(least) > speakers and bound(at, least[speakers], largest) > most
        held = graph(at)
        found = least_eigenvalues(held.times, held.degree, speakers + 1, enough=enough)
        if found is not None:
            solved[at] = gap_ratio(*found, int(steps[at]), n)
        return found is not None

    bounds = []
    for at, degree in enumerate(degrees(part, weights, [int(p) for p in steps])):
        top = degree.max()
        low = np.partition(degree, min(speakers, n - 1))[min(speakers, n - 1)] + min(speakers, n - 1)
        bounds.append(bound(at, min(low, 2 * top), top))
    lowest = np.inf
    for at in np.argsort(bounds, kind="stable"):
        if bounds[at] > lowest:
            break
        if solve(int(at), lowest):
            lowest = min(lowest, solved[int(at)][0])
    at = min(solved, key=lambda a: (solved[a][0], a))
    if not hangs_together(at):
        if at_one[0]:
            at = 0
        elif not hangs_together(last):
            at = last
        else:
            low, high = -1, last  # not whole (or before the list), whole
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (low, middle) if hangs_together(middle) else (middle, high)
            at = min(high + 1, last)
    if at not in solved:
        solve(at, np.inf)
    return int(steps[at]), solved[at][1]


def neighbour_search(
    rows: DataFrame,
    keys: Sequence[str] = KEYS,
    weights: Sequence[float] = (1.0,),
    ranges: DataFrame | None = None,
    share: float = SEARCH_SHARE,
    volume: int = SEARCH_STEPS,
    speakers: int = MAX_SPEAKERS,
    search_rows: int | None = None,
    known: int | None = None,
    task_rows: int = TASK_ROWS,
    bit_rows: int = BIT_ROWS,
) -> DataFrame:
    """Neighbours to keep and number of speakers, per recording.

    All rows are looked at; ``search_rows`` is the option to look at every k-th row only, so that fewer than
    ``2 * search_rows`` remain. Each (recording, p) is then an independent eigenproblem: a dense one in a task
    up to ``task_rows`` rows, on tables beyond ``bit_rows`` (``_table_search``; ``task_rows`` 0 sends all there). Between
    the two a task holds a recording and solves, on graphs of bits, as many of its problems as the choice takes
    (``bit_search``). A ``known`` number of speakers is kept, and gaps are looked at up to that number.
    """
    keys = list(keys)
    speakers = max(speakers, known or 0)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    ratio = F.greatest(F.lit(1), F.floor(F.col("n") / (search_rows or 1 << 62))).cast("bigint")
    sampled = spread_lookup(rows, sizes.withColumn("k", ratio), keys, F.col("i")).filter(F.col("i") % F.col("k") == 0)
    counts = cut_lineage(sizes.withColumn("k", ratio).withColumn("m", F.ceil(F.col("n") / F.col("k"))))
    steps = counts.select(*keys, "m", F.explode(_search_steps(share, volume)("m")).alias("p"))
    slim = _with_ranges(sampled.select(*keys, "i", "vectors", "owners", "k"), ranges, keys)
    held = max(task_rows, bit_rows) if task_rows else 0
    here = cut_lineage(steps.filter(F.col("m") <= task_rows).drop("m"))
    # a group is little data and much work: adaptive execution must not put many into one task
    each = spread_lookup(slim, here, keys, F.col("i"), fanout=8).repartition(min(SEARCH_TASKS, 2 * here.count() + 1), *keys, "p")
    key_fields = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def solve(key, part: pd.DataFrame) -> pd.DataFrame:
        part, p = part.sort_values("i"), int(key[-1])
        affinity = fused_affinity(part, weights)
        whole = (is_connected(neighbour_graph(affinity, q)) for q in (p, 1))
        row = [*key[:-1], p, *eigen_gap(affinity, p, speakers), *whole, len(part), int(part["k"].iloc[0])]
        return pd.DataFrame([row], columns=[*keys, "p", "ratio", "speakers", "connected", "connected_at_one", "rows", "k"])

    table = each.groupBy(*keys, "p").applyInPandas(
        solve, f"{key_fields}, p int, ratio double, speakers int, connected boolean, connected_at_one boolean, rows int, k int"
    )

    large = counts.filter(F.col("m") > held)
    if not large.isEmpty():
        here = spread_lookup(sampled.drop("n", "k"), large.select(*keys), keys, F.col("i"))
        found = _table_search(here, steps.filter(F.col("m") > held), speakers, keys, weights, ranges)
        table = table.unionByName(found.join(large.select(*keys, F.col("k").cast("int").alias("k")), keys))

    def choose(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("p", ignore_index=True)
        p, found = search_pick(part, max(int(part["rows"].iloc[0] * share), 2))
        k = int(part["k"].iloc[0])
        return pd.DataFrame([[*key, p, p * k, found, k]], columns=[*keys, "p", "p_full", "speakers", "k"])

    answer = f"{key_fields}, p int, p_full int, speakers int, k int"
    chosen = table.groupBy(*keys).applyInPandas(choose, answer)

    def search(key, part: pd.DataFrame) -> pd.DataFrame:
        p, found = bit_search(part.sort_values("i"), weights, np.unique(search_list(len(part), share, volume)), speakers)
        k = int(part["k"].iloc[0])
        return pd.DataFrame([[*key, p, p * k, found, k]], columns=[*keys, "p", "p_full", "speakers", "k"])

    middle = counts.filter((F.col("m") > task_rows) & (F.col("m") <= held)).select(*keys)
    whole = middle.count()
    if whole:
        one_each = spread_lookup(slim, middle, keys, F.col("i"), fanout=8).repartition(min(SEARCH_TASKS, 2 * whole + 1), *keys)
        chosen = chosen.unionByName(one_each.groupBy(*keys).applyInPandas(search, answer))
    return chosen.withColumn("speakers", F.lit(known)) if known else chosen


def _table_search(
    rows: DataFrame, steps: DataFrame, speakers: int, keys: Sequence[str], weights: Sequence[float], ranges: DataFrame | None
) -> DataFrame:
    """What ``eigen_gap`` and ``is_connected`` tell for every (recording, p), from edge tables: no task holds a graph."""
    most = steps.agg(F.max("p")).first()[0]
    ranked = cut_lineage(neighbour_edges(rows, int(most), keys, weights, ranges))
    each = spread_lookup(ranked, steps.select(*keys, "p"), keys, F.col("i"), fanout=8).filter(F.col("rank") <= F.col("p"))
    values, _ = least_eigenpairs(symmetrise(each, [*keys, "p"]), speakers + 1, [*keys, "p"], upper=UPPER)
    gaps = F.zip_with(F.slice("values", 2, speakers), F.slice("values", 1, F.size("values") - 1), lambda after, before: after - before)
    wide = F.array_max("__gaps")
    ratio = (F.col("p") / F.col("m")) / (wide / (F.col("largest") + EPS) + EPS)
    least = connection_rank(ranked, keys)
    told = values.withColumn("__gaps", gaps).join(steps, [*keys, "p"]).join(least, keys)
    whole = lambda p: F.coalesce(F.col("connects") <= p, F.lit(False))
    return told.select(
        *keys,
        F.col("p").cast("int").alias("p"),
        ratio.alias("ratio"),
        F.array_position("__gaps", wide).cast("int").alias("speakers"),
        whole(F.col("p")).alias("connected"),
        whole(F.lit(1)).alias("connected_at_one"),
        F.col("m").cast("int").alias("rows"),
    )


def _search_steps(share: float, volume: int):
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def steps(counts: pd.Series) -> pd.Series:
        return counts.map(lambda m: np.unique(search_list(int(m), share, volume)).astype(np.int32))

    return steps


def _with_ranges(rows: DataFrame, ranges: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Rows with the recording's lowest and highest cosine per scale (null without ``ranges``)."""
    if ranges is None:
        nothing = F.lit(None).cast("array<double>")
        return rows.withColumn("lo", nothing).withColumn("hi", nothing)
    per_key = ranges.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("scale", "lo", "hi"))).alias("__r"))
    spans = per_key.select(
        *keys, F.transform("__r", lambda r: r["lo"]).alias("lo"), F.transform("__r", lambda r: r["hi"]).alias("hi")
    )
    return spread_lookup(rows, spans, keys, F.col("i"))


def fused_affinity(part: pd.DataFrame, weights: Sequence[float]) -> np.ndarray:
    """Weighted sum of the scales' cosines, each stretched to 0 … 1; windows of one segment count as equal."""
    vectors = np.array([[list(v) for v in row] for row in part["vectors"]], dtype=float)
    owners = np.array([list(o) for o in part["owners"]])
    low, high = part["lo"].iloc[0], part["hi"].iloc[0]
    fused = np.zeros((len(part), len(part)))
    for s, weight in enumerate(weights):
        block = vectors[:, s] @ vectors[:, s].T
        block[owners[:, s][:, None] == owners[:, s][None, :]] = 1.0
        lo, hi = (block.min(), block.max()) if low is None else (low[s], high[s])
        fused += weight * ((block - lo) / (hi - lo) if hi > lo else np.ones_like(block))
    return fused


# Trials, made-up speakers, samples per made-up speaker and noise of the counting for
# short recordings; its own search limits.
COUNT_TRIALS = 5
COUNT_SPEAKERS = 3
COUNT_SAMPLES = 10
COUNT_NOISE = 50.0
COUNT_SHARE = 0.15
COUNT_STEPS = 10


def count_speakers_short(
    embeddings: DataFrame, keys: Sequence[str] = KEYS, index: str = "seg_idx", vec: str = "vec", short_rows: int = SHORT_ROWS
) -> DataFrame:
    """Speakers of recordings with at most ``short_rows`` vectors.

    Made-up speakers are added, the count is repeated with other random numbers, and the most frequent
    count less the made-up speakers is taken (at least 1). Each (recording, trial) is a task of its own.
    """
    keys = list(keys)
    sizes = embeddings.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= short_rows).drop("n")
    short = embeddings.select(*keys, index, vec).join(sizes, keys)
    trials = short.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(COUNT_TRIALS - 1))))
    key_fields = ", ".join(f"{k} {embeddings.schema[k].dataType.simpleString()}" for k in keys)

    def count(key, part: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack(part.sort_values(index)[vec].to_numpy()).astype(float)
        draw = np.random.default_rng(int(key[-1]))
        spread = vectors.std(0, ddof=1) if len(vectors) > 1 else np.zeros(vectors.shape[1])
        parts = []
        for _ in range(COUNT_SPEAKERS):
            noise = draw.standard_normal((COUNT_SAMPLES, vectors.shape[1]))
            noise = spread * noise / np.abs(noise).max(1, keepdims=True)
            parts.append(draw.standard_normal(vectors.shape[1]) + COUNT_NOISE * noise)
        together = np.vstack([*parts, vectors])
        together /= np.linalg.norm(together, axis=1, keepdims=True) + 3.5e-4
        block = together @ together.T
        np.fill_diagonal(block, 1.0)
        affinity = (block - block.min()) / (block.max() - block.min())
        rows = []
        for p in search_list(len(affinity), COUNT_SHARE, COUNT_STEPS):
            whole = (is_connected(neighbour_graph(affinity, q)) for q in (int(p), 1))
            rows.append((int(p), *eigen_gap(affinity, int(p), len(vectors)), *whole))
        table = pd.DataFrame(rows, columns=["p", "ratio", "speakers", "connected", "connected_at_one"])
        _, speakers = search_pick(table, max(int(len(affinity) * COUNT_SHARE), 2))
        return pd.DataFrame([[*key, speakers]], columns=[*keys, "trial", "speakers"])

    counted = trials.groupBy(*keys, "trial").applyInPandas(count, f"{key_fields}, trial int, speakers int")
    votes = counted.groupBy(*keys, "speakers").agg(F.count(F.lit(1)).alias("n"))
    top = F.max_by("speakers", F.struct("n", -F.col("speakers")))
    return votes.groupBy(*keys).agg(F.greatest(top - COUNT_SPEAKERS, F.lit(1)).alias("speakers"))


# Fixed values of the eigenvector search: spare vectors, degree of one filter, most filter rounds, tolerance.
SPARE_VECTORS = 4
FILTER_DEGREE = 12
FILTER_ROUNDS = 60
FILTER_TOLERANCE = 1e-7


def smallest_vectors(i: np.ndarray, j: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """Eigenvectors of the ``k`` smallest eigenvalues of the Laplacian of a symmetric edge list.

    Memory follows the edges, never n x n: a block of vectors is filtered with a Chebyshev polynomial that
    damps everything above the wanted eigenvalues, then turned into the best vectors of its span.
    """
    order = np.argsort(i, kind="stable")
    i, j, weight = i[order], j[order], np.where(i[order] == j[order], 0.0, weight[order])
    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, int)
    degree = np.bincount(i, np.abs(weight), n)

    def times(block: np.ndarray) -> np.ndarray:
        out = degree[:, None] * block
        if len(first):
            out[i[first]] -= np.add.reduceat(weight[:, None] * block[j], first, axis=0)
        return out

    return filtered_vectors(times, degree, n, k)


def filtered_vectors(times: Callable[[np.ndarray], np.ndarray], degree: np.ndarray, n: int, k: int) -> np.ndarray:
    """``smallest_vectors`` of a Laplacian that is known by its products."""
    width = min(n, k + SPARE_VECTORS)
    block = np.linalg.qr(np.random.default_rng(0).standard_normal((n, width)))[0]
    top = 2 * degree.max() + EPS  # no eigenvalue of a Laplacian lies above
    before = None
    for _ in range(FILTER_ROUNDS):
        values, turn = np.linalg.eigh(block.T @ times(block))
        block = block @ turn
        if width == n or (before is not None and np.abs(values[:k] - before[:k]).max() <= FILTER_TOLERANCE * top):
            break
        before = values
        low = max(values[-1], EPS)
        middle, half = (top + low) / 2, max((top - low) / 2, EPS)
        older, newer = block, (times(block) - middle * block) / half
        for _ in range(FILTER_DEGREE - 1):
            older, newer = newer, 2 * (times(newer) - middle * newer) / half - older
            scale = np.abs(newer).max()
            older, newer = older / scale, newer / scale
        block = np.linalg.qr(newer)[0]
    return block[:, :k]


def nearest_centres(points: np.ndarray, k: int, rounds: int = 100) -> np.ndarray:
    """Clusters of points: centres start at the point farthest from the mean, then at the point farthest
    from all centres; points and means are matched until no point changes its cluster."""
    away = ((points - points.mean(0)) ** 2).sum(1)
    centres = points[[int(away.argmax())]]
    for _ in range(1, k):
        away = ((points[:, None] - centres[None]) ** 2).sum(2).min(1)
        centres = np.vstack([centres, points[int(away.argmax())]])
    labels = np.full(len(points), -1)
    for _ in range(rounds):
        fresh = ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        if (fresh == labels).all():
            break
        labels = fresh
        size = np.bincount(labels, minlength=k)
        sums = np.stack([np.bincount(labels, points[:, d], k) for d in range(points.shape[1])], axis=1)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    return labels


def choose_counts(search: DataFrame, short: DataFrame | None = None, known: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Speakers per recording: the known number if positive, else the count for short recordings, else
    that of the neighbour search (which also brings the neighbours to keep)."""
    out = search
    order = [F.col("speakers")]
    for other, name in ((short, "__short"), (known, "__known")):
        if other is not None:
            out = out.join(other.select(*keys, F.col("speakers").alias(name)), list(keys), "left")
            order.insert(0, F.when(F.col(name) > 0, F.col(name)))
    return out.withColumn("speakers", F.coalesce(*order).cast("int")).drop("__short", "__known")


def cluster_speakers(
    rows: DataFrame,
    counts: DataFrame,
    keys: Sequence[str] = KEYS,
    weights: Sequence[float] = (1.0,),
    ranges: DataFrame | None = None,
    few_rows: int = FEW_ROWS,
    task_edges: int = TASK_EDGES,
    bit_rows: int = BIT_ROWS,
) -> DataFrame:
    """Speaker labels of the windows (``i, label``).

    ``counts`` brings per recording ``p_full`` (neighbours to keep) and ``speakers`` (see
    ``neighbour_search``; a known or otherwise counted number may replace it). Up to ``few_rows`` windows
    the whole affinity is the graph. A recording of at most ``bit_rows`` rows and ``task_edges`` edges is one task,
    which holds its vectors and its graph as bits; the edges of larger ones are found tile by tile, their
    eigenvectors and clusters on tables (``plans/spectral.py``), which gives the same clusters.
    """
    keys = list(keys)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    few = F.col("n") <= few_rows
    plan = cut_lineage(
        sizes.join(counts, keys).select(
            *keys,
            few.alias("few"),
            F.when(few, F.col("n")).otherwise(F.greatest(F.lit(1), F.least("p_full", "n"))).cast("int").alias("p"),
            F.least("speakers", "n").cast("int").alias("speakers"),
            "n",
        ).withColumn("large", (2 * F.col("n") * F.col("p") > task_edges) | (F.col("n") > bit_rows))
    )
    key_fields = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    answer = f"{key_fields}, i bigint, label int"

    def labelled(key, nodes, labels) -> pd.DataFrame:
        out = pd.DataFrame({"i": nodes, "label": labels})
        for place, name in enumerate(keys):
            out.insert(place, name, key[place])
        return out

    def cluster_bits(key, part: pd.DataFrame) -> pd.DataFrame:
        part, k = part.sort_values("i"), int(part["speakers"].iloc[0])
        labels = np.zeros(len(part), dtype=int)
        if k > 1:
            graph = BitGraph(part, weights, int(part["p"].iloc[0]))
            labels = nearest_centres(filtered_vectors(graph.times, graph.degree, len(part), k), k)
        return labelled(key, part["i"], labels)

    bits = plan.filter(~F.col("few") & ~F.col("large")).select(*keys, "p", "speakers")
    slim = _with_ranges(rows.select(*keys, "i", "vectors", "owners"), ranges, keys)
    held = spread_lookup(slim, bits, keys, F.col("i")).repartition(min(SEARCH_TASKS, 2 * bits.count() + 1), *keys)
    by_bits = held.groupBy(*keys).applyInPandas(cluster_bits, answer)
    plan = plan.filter(F.col("few") | F.col("large"))
    if plan.isEmpty():
        return by_bits

    rows = spread_lookup(rows, plan.select(*keys), keys, F.col("i"))
    most = plan.agg(F.max("p")).first()[0] or 1
    found = neighbour_edges(rows, int(most), keys, weights, ranges, method="drop")
    kept = spread_lookup(found, plan.drop("n"), keys, F.col("i")).filter(F.col("rank") <= F.col("p"))
    graph = symmetrise(kept.withColumn("weight", F.when(F.col("few"), F.col("weight")).otherwise(F.lit(1.0))), keys)
    large = plan.filter("large")
    widest = large.agg(F.max("speakers")).first()[0]
    by_tables = None
    if widest:
        graph = cut_lineage(graph)
        wide = spread_lookup(graph, large.select(*keys), keys, F.col("i"))
        points = least_eigenpairs(wide, int(widest), keys)[1]
        by_tables = cluster_points(points, large.select(*keys, F.col("speakers").alias("k")), int(widest), keys)
    ready = spread_lookup(graph, plan.filter(~F.col("large")).select(*keys, "speakers"), keys, F.col("i"))

    def cluster(key, part: pd.DataFrame) -> pd.DataFrame:
        nodes, at = np.unique(np.concatenate([part["i"], part["j"]]), return_inverse=True)
        i, j = at[: len(part)], at[len(part) :]
        k = int(part["speakers"].iloc[0])
        labels = np.zeros(len(nodes), dtype=int)
        if k > 1:
            vectors = smallest_vectors(i, j, part["weight"].to_numpy(), len(nodes), k)
            labels = nearest_centres(vectors, k)
        return labelled(key, nodes, labels)

    in_tasks = by_bits.unionByName(ready.groupBy(*keys).applyInPandas(cluster, answer))
    return in_tasks if by_tables is None else in_tasks.unionByName(by_tables)


def cluster_means(labelled: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean of the (concatenated) vectors per label."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    mean = Summarizer.mean(array_to_vector(F.flatten("vectors")))
    return labelled.groupBy(*keys, "label").agg(mean.alias("__m")).select(*keys, "label", vector_to_array("__m").alias("mean"))


def labels_to_turns(windows: DataFrame, labels: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Windows as turns (``seq, start, end, speaker``); windows without label carry an ``error``."""
    joined = windows.join(labels, [*keys, "i"], "left")
    return joined.select(
        *keys,
        F.col("i").alias("seq"),
        F.col("offset").alias("start"),
        (F.col("offset") + F.col("duration")).alias("end"),
        F.col("label").alias("speaker"),
        F.when(F.col("label").isNull(), "Mismatch of length between cluster_labels and timestamps.").alias("error"),
    )


def mean_embeddings(embeddings: DataFrame, labels: DataFrame, keys: Sequence[str] = KEYS, by: Sequence[str] = ("scale", "seg")) -> DataFrame:
    """Mean vector per scale and speaker."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    joined = embeddings.join(labels, [*keys, *by])
    groups = [*keys, *[b for b in by if b == "scale"], "label"]
    mean = Summarizer.mean(array_to_vector(F.transform("vec", lambda x: x.cast("double"))))
    return joined.groupBy(*groups).agg(mean.alias("__m")).select(*groups, vector_to_array("__m").alias("mean"))


def speaker_pairs(turns: DataFrame, keys: Sequence[str] = KEYS, speaker: str = "speaker") -> DataFrame:
    """Pairs of a recording's speakers; (0, 1) when there are at most two."""
    found = turns.groupBy(*keys).agg(F.array_sort(F.collect_set(speaker)).alias("__s"))
    pairs = F.flatten(
        F.transform("__s", lambda a: F.transform(F.filter("__s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    )
    zero_one = F.array(F.struct(F.lit(0).cast(turns.schema[speaker].dataType).alias("a"), F.lit(1).cast(turns.schema[speaker].dataType).alias("b")))
    return found.select(*keys, F.explode(F.when(F.size("__s") <= 2, zero_one).otherwise(pairs)).alias("p")).select(*keys, "p.a", "p.b")

"""Jobs on windows, embeddings and speaker graphs."""

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from speechtables.catalog import job
from speechtables.catalog import tables as t
from speechtables.operators import affinity as op
from speechtables.operators import turns as turn_op
from speechtables.session import cut_lineage

KEY = ["recording_id"]


def _rows(spark, sf):
    return op.single_scale(t.embeddings(spark, sf))


_SIMS = """units as (select recording_id, seg_idx, list_transform(vec, lambda x: x / (sqrt(list_sum(list_transform(vec, lambda y: y * y))) + 0.00035::double)) as u from emb),
    sims as (select a.recording_id, a.seg_idx as i, b.seg_idx as j,
        case when a.seg_idx = b.seg_idx then 1.0::double else list_dot_product(a.u, b.u) end as sim
        from units a join units b using (recording_id))"""
_EDGES = f"""{_SIMS}, ranked as (select *, row_number() over (partition by recording_id, i order by sim desc, j) as rank from sims),
    edges as (select recording_id, i, j, cast(rank as integer) as rank, 1.0::double as weight from ranked where rank <= 5)"""


@job(
    "sub_windows_c1_j6_p16",
    t.sql(
        "segments",
        """with s as (select recording_id, seq, start_ms, end_ms, i as scale, [1500, 1250, 1000, 750, 500][i + 1] as w, [750, 625, 500, 375, 250][i + 1] as h from segments, range(5) as g(i)),
        n as (select *, unnest(generate_series(0, greatest(ceil((end_ms - start_ms - w) / h::double)::bigint, 0))) as slice from s)
        select recording_id, seq, cast(scale as integer) as scale, slice, start_ms + slice * h as "offset", least(start_ms + slice * h + w, end_ms) - (start_ms + slice * h) as duration
        from n where least(start_ms + slice * h + w, end_ms) - (start_ms + slice * h) > 50""",
    ),
)
def windows(spark, sf):
    return op.sub_windows_for(t.segments(spark, sf), F.lit(60)).select("recording_id", "seq", "scale", "slice", "offset", "duration")


def _norms(batch: pd.DataFrame) -> pd.DataFrame:
    norms = np.sqrt([float((v.astype(float) ** 2).sum()) for v in batch["vec"]])
    return pd.DataFrame({"recording_id": batch["recording_id"], "seg_idx": batch["seg_idx"], "score": np.floor(norms * 1e6 + 0.5).astype("int64")})


@job(
    "batch_scores_c2",
    t.sql("emb", "select recording_id, seg_idx, cast(floor(sqrt(list_sum(list_transform(vec, lambda y: y * y))) * 1e6 + 0.5) as bigint) as score from emb"),
)
def batch_scores(spark, sf):
    return op.score_batches(t.embeddings(spark, sf), _norms, "recording_id bigint, seg_idx bigint, score bigint")


@job(
    "affinity_rows_j4",
    t.sql(
        "emb",
        f"""with {_SIMS}
        select recording_id, i, arg_max(j, sim) filter (i <> j) as nearest, arg_min(j, sim) filter (i <> j) as farthest,
            cast(floor(sum(sim) * 1e6 + 0.5) as bigint) as total, count(*) as n from sims group by recording_id, i""",
    ),
)
def affinity_rows(spark, sf):
    return op.row_summary(_rows(spark, sf)).withColumn("total", F.floor(F.col("total") * 1e6 + 0.5))


@job(
    "affinity_range_c3",
    t.sql("emb", f"with {_SIMS} select recording_id, cast(0 as integer) as scale, cast(floor(min(sim) * 1e9 + 0.5) as bigint) as lo, cast(floor(max(sim) * 1e9 + 0.5) as bigint) as hi from sims group by recording_id"),
)
def affinity_range(spark, sf):
    found = op.affinity_range(_rows(spark, sf))
    return found.withColumn("lo", F.floor(F.col("lo") * 1e9 + 0.5)).withColumn("hi", F.floor(F.col("hi") * 1e9 + 0.5))


@job("neighbour_edges_c5_o3", t.sql("emb", f"with {_EDGES} select * from edges"))
def edges(spark, sf):
    return op.neighbour_edges(_rows(spark, sf), 5)


# ---- two scales: every vector is a base window, every second one also a coarse window -------


def base_windows(spark, sf):
    return t.embeddings(spark, sf).select(*KEY, F.col("seg_idx").alias("i"), (F.col("seg_idx") * 250).alias("offset"), F.lit(500).alias("duration"))


def scale_windows(spark, sf):
    fine = base_windows(spark, sf).select(*KEY, F.lit(1).alias("scale"), F.col("i").alias("seg"), "offset", "duration")
    coarse = base_windows(spark, sf).filter(F.col("i") % 2 == 0).select(
        *KEY, F.lit(0).alias("scale"), F.expr("i div 2").alias("seg"), "offset", F.lit(1000).alias("duration")
    )
    return coarse.unionByName(fine)


def scale_embeddings(spark, sf):
    fine = t.embeddings(spark, sf).select(*KEY, F.lit(1).alias("scale"), F.col("seg_idx").alias("seg"), "vec")
    coarse = t.embeddings(spark, sf).filter(F.col("seg_idx") % 2 == 0).select(*KEY, F.lit(0).alias("scale"), F.expr("seg_idx div 2").alias("seg"), "vec")
    return coarse.unionByName(fine)


def _mapping(spark, sf):
    return op.nearest_windows(base_windows(spark, sf), scale_windows(spark, sf), width=3_600_000)


_MAPPING = """base as (select recording_id, seg_idx as i, seg_idx * 250 as o, 500 as d from emb),
    scaled as (select recording_id, 1 as scale, i as seg, o, d from base union all select recording_id, 0, i // 2, o, 1000 from base where i % 2 = 0),
    dist as (select b.recording_id, scale, b.i, seg, row_number() over (partition by b.recording_id, scale, b.i order by abs((b.o + b.d) / 2 - (s.o + s.d) / 2), seg) as rk
        from base b join scaled s using (recording_id)),
    mapping as (select recording_id, cast(scale as integer) as scale, i, seg from dist where rk = 1)"""


@job("nearest_windows_j3", t.sql("emb", f"with {_MAPPING} select * from mapping"))
def nearest(spark, sf):
    return _mapping(spark, sf)


@job(
    "labels_on_scales_j9",
    t.sql(
        "emb",
        f"""with {_MAPPING},
        cnt as (select m.recording_id, scale, seg, label, count(*) as n, min(i) as f from mapping m join emb e on e.recording_id = m.recording_id and e.seg_idx = m.i group by all),
        best as (select recording_id, scale, seg, arg_max(label, (n, -f)) as label from cnt group by all),
        every as (select recording_id, scale, unnest(generate_series(0, max(seg))) as seg from best group by recording_id, scale)
        select recording_id, scale, seg, coalesce(last_value(label ignore nulls) over (partition by recording_id, scale order by seg), 0) as label from every left join best using (recording_id, scale, seg)""",
    ),
)
def scale_labels(spark, sf):
    labels = t.embeddings(spark, sf).select(*KEY, F.col("seg_idx").alias("i"), "label")
    return op.labels_on_scales(labels, _mapping(spark, sf))


@job(
    "fused_neighbours_c4",
    t.sql(
        "emb",
        f"""with {_MAPPING}, {_SIMS},
        coarse as (select recording_id, i // 2 as i, j // 2 as j, sim from sims where i % 2 = 0 and j % 2 = 0),
        scaled_sims as (select recording_id, 1 as scale, i, j, sim from sims union all select recording_id, 0, i, j, sim from coarse),
        norm as (select *, (sim - min(sim) over w) / (max(sim) over w - min(sim) over w) as x from scaled_sims window w as (partition by recording_id, scale)),
        fused as (select a.recording_id, a.i, b.i as j, sum(x * case a.scale when 0 then 0.7::double else 1.3::double end) as sim
            from mapping a join mapping b using (recording_id, scale) join norm n on n.recording_id = a.recording_id and n.scale = a.scale and n.i = a.seg and n.j = b.seg group by all),
        ranked as (select *, row_number() over (partition by recording_id, i order by cast(floor(sim * 1e9 + 0.5) as bigint) desc, j) as rank from fused)
        select recording_id, i, j, cast(floor(sim * 1e6 + 0.5) as bigint) as sim from ranked where rank <= 4""",
    ),
)
def fused(spark, sf):
    rows = op.multi_scale(base_windows(spark, sf), _mapping(spark, sf), scale_embeddings(spark, sf))
    found = op.neighbour_edges(rows, 4, weights=(0.7, 1.3), ranges=_ranges(spark, sf), method="drop")
    return found.select(*KEY, "i", "j", F.floor(F.col("weight") * 1e6 + 0.5).alias("sim"))


def _ranges(spark, sf):
    per_scale = op.single_scale(scale_embeddings(spark, sf).withColumnRenamed("scale", "at_scale"), keys=[*KEY, "at_scale"], index="seg")
    found = op.affinity_range(per_scale, keys=[*KEY, "at_scale"])
    return found.select(*KEY, F.col("at_scale").alias("scale"), "lo", "hi")


_GRAPH = f"""{_EDGES}, twice as (select recording_id, i, j, weight from edges union all select recording_id, j, i, weight from edges),
    graph as (select recording_id, i, j, sum(weight) / 2 as weight from twice group by recording_id, i, j)"""


@job("symmetric_graph_c6", t.sql("emb", f"with {_GRAPH} select * from graph"))
def graph(spark, sf):
    return op.symmetrise(edges(spark, sf))


@job(
    "laplacian_c7",
    t.sql(
        "emb",
        f"""with {_GRAPH} select recording_id, i, i as j, sum(case when i <> j then abs(weight) else 0 end) as value from graph group by recording_id, i
        union all select recording_id, i, j, -weight from graph where i <> j""",
    ),
)
def laplacian(spark, sf):
    return op.laplacian(graph(spark, sf))


@job(
    "components_c8",
    t.sql(
        "emb",
        f"""with recursive {_EDGES}, und as materialized (select recording_id, i, j from edges union select recording_id, j, i from edges),
        reach as (select recording_id, i as node, i as seen from und union select r.recording_id, r.node, u.j from reach r join und u on u.recording_id = r.recording_id and u.i = r.seen)
        select recording_id, node, min(seen) as root from reach group by recording_id, node""",
    ),
)
def components(spark, sf):
    return op.components(edges(spark, sf))


@job(
    "minimum_connection_c9",
    t.sql(
        "emb",
        f"""with recursive {_SIMS},
        ranked as materialized (select recording_id, i, j, row_number() over (partition by recording_id, i order by sim desc, j) as rank from sims),
        und as materialized (select recording_id, i, j, rank from ranked union all select recording_id, j, i, rank from ranked),
        sizes as (select recording_id, count(*) as n from emb group by recording_id),
        reach as (select recording_id, unnest(range(1, n + 1)) as p, 0::bigint as node from sizes
            union select r.recording_id, r.p, u.j from reach r join und u on u.recording_id = r.recording_id and u.i = r.node and u.rank <= r.p),
        reached as (select recording_id, p, count(*) as c from reach group by recording_id, p)
        select recording_id, min(p)::integer as connects from reached join sizes using (recording_id) where c = n group by recording_id""",
    ),
)
def connection(spark, sf):
    rows = cut_lineage(_rows(spark, sf))
    return op.minimum_connection(rows, rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("most")))


@job("neighbour_search_c9_c10_c11")
def search(spark, sf):
    return op.neighbour_search(_rows(spark, sf))


@job("short_recording_speakers_c13")
def short_counts(spark, sf):
    return op.count_speakers_short(t.embeddings(spark, sf))


@job("speaker_clusters_c12")
def clusters(spark, sf):
    rows = cut_lineage(_told(spark, sf))
    counts = op.choose_counts(op.neighbour_search(rows), short=op.count_speakers_short(t.speakers(spark, sf)))
    return op.cluster_speakers(rows, counts)


_SPEAKERS = """with s as (select label // 2 as recording_id, label, row_number() over (partition by label // 2 order by vec_id) - 1 as seg_idx from embeddings)"""


def _partition(labels):
    """Clusters named by their first window."""
    by = Window.partitionBy(*KEY, "label")
    return labels.select(*KEY, F.col("i").alias("seg_idx"), F.min("i").over(by).alias("speaker"))


def _told(spark, sf):
    return op.single_scale(t.speakers(spark, sf))


@job(
    "speakers_counted_c10_c11",
    _SPEAKERS + " select recording_id, count(distinct label)::integer as speakers from s group by recording_id",
)
def counted(spark, sf):
    return op.neighbour_search(_told(spark, sf)).select(*KEY, "speakers")


@job(
    "speaker_partition_c12",
    _SPEAKERS + " select recording_id, seg_idx, min(seg_idx) over (partition by recording_id, label) as speaker from s",
)
def partition(spark, sf):
    rows = cut_lineage(_told(spark, sf))
    return _partition(op.cluster_speakers(rows, op.neighbour_search(rows)))


@job(
    "speaker_partition_known_c12",
    _SPEAKERS + " select recording_id, seg_idx, min(seg_idx) over (partition by recording_id, label) as speaker from s",
)
def known_partition(spark, sf):
    rows = cut_lineage(_told(spark, sf))
    return _partition(op.cluster_speakers(rows, op.neighbour_search(rows, known=2)))


@job("multi_scale_speaker_clusters_c12_c4")
def fused_clusters(spark, sf):
    rows = cut_lineage(op.multi_scale(base_windows(spark, sf), _mapping(spark, sf), scale_embeddings(spark, sf)))
    ranges, weights = _ranges(spark, sf), (0.7, 1.3)
    return op.cluster_speakers(rows, op.neighbour_search(rows, weights=weights, ranges=ranges), weights=weights, ranges=ranges)


@job(
    "labels_to_turns_c14",
    t.sql("emb", """select recording_id, seg_idx as seq, seg_idx * 250 as start, seg_idx * 250 + 500 as "end", label as speaker, cast(null as varchar) as error from emb"""),
)
def label_turns(spark, sf):
    return op.labels_to_turns(base_windows(spark, sf), t.embeddings(spark, sf).select(*KEY, F.col("seg_idx").alias("i"), "label"))


@job("diarized_turns_c12_c14_g1_g2")
def diarized_turns(spark, sf):
    rows = _rows(spark, sf)
    labels = op.cluster_speakers(rows, op.neighbour_search(rows))
    turns = op.labels_to_turns(base_windows(spark, sf), labels).filter(F.col("error").isNull()).drop("error")
    return turn_op.merge_same_speaker(turn_op.resolve_overlaps(turns))


@job(
    "speaker_mean_embeddings_c15",
    t.sql(
        "emb",
        """with d as (select recording_id, label, unnest(vec) as x, generate_subscripts(vec, 1) as k from emb)
        select recording_id, label, cast(k - 1 as integer) as dim, cast(floor(avg(x) * 1e6 + 0.5) as bigint) as mean from d group by recording_id, label, k""",
    ),
)
def means(spark, sf):
    vectors = t.embeddings(spark, sf)
    found = op.mean_embeddings(vectors.drop("label"), vectors.select(*KEY, "seg_idx", "label"), by=["seg_idx"])
    return found.select(*KEY, "label", F.posexplode("mean").alias("dim", "mean")).withColumn("mean", F.floor(F.col("mean") * 1e6 + 0.5))


@job(
    "speaker_pairs_c16",
    t.sql(
        "emb",
        """with s as (select distinct recording_id, label from emb), c as (select recording_id, count(*) as n from s group by recording_id)
        select a.recording_id, a.label as a, b.label as b from s a join s b on a.recording_id = b.recording_id and a.label < b.label join c on c.recording_id = a.recording_id where n > 2
        union all select recording_id, 0, 1 from c where n <= 2""",
    ),
)
def pairs(spark, sf):
    return op.speaker_pairs(t.embeddings(spark, sf), speaker="label")


@job(
    "every_kth_row_o5",
    t.sql("emb", "select recording_id, seg_idx, label from emb where seg_idx % 4 = 0"),
)
def subsample(spark, sf):
    return t.embeddings(spark, sf).filter(F.col("seg_idx") % 4 == 0).select(*KEY, "seg_idx", "label")

"""One registered query per operator of this folder, over whole tables, with the SQL it is compared with.

The queries are thin: they read tables, call the operator with production parameters and derive the digest
columns from its output.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechtables.llm import audio, bpe, chat, crosstokens, language, ngrams, packing, quality, secrets, simhash, suffixes, topk, whitening
from speechtables.llm.common import read_table, stored
from speechtables.session import run_folder, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


_OP1_SQL = r"""
with texts as (select doc_id, coalesce(text, '') as t from documents),
found as (
  select doc_id, 0 as number, 'assign' as kind,
    regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') as hits,
    string_split_regex(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') as gaps,
    regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) as cores, 8 as least
  from texts
  union all
  select doc_id, 1, 'access', regexp_extract_all(t, 'AKIA[A-Z0-9]+'), string_split_regex(t, 'AKIA[A-Z0-9]+'),
    regexp_extract_all(t, 'AKIA[A-Z0-9]+'), 16
  from texts
  union all
  select doc_id, 2, 'hex', regexp_extract_all(t, '[0-9a-f]+'), string_split_regex(t, '[0-9a-f]+'),
    regexp_extract_all(t, '[0-9a-f]+'), 32
  from texts
),
parts as (
  select doc_id, number, kind, least, unnest(range(1, len(hits) + 1)) as i, hits, gaps, cores from found where len(hits) > 0
),
placed as (
  select doc_id, number, kind, least, length(hits[i]) as n, length(cores[i]) as core,
    sum(length(gaps[i]) + length(hits[i])) over (partition by doc_id, number order by i) as finish
  from parts
),
spans as (
  select doc_id, number, kind, (finish - n)::bigint as start, finish::bigint as finish from placed where core >= least
),
texts_of as (
  select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
    count(*) filter (kind = 'hex') as n_hex, string_agg(kind || ':' || start || ':' || finish, ',' order by start, number) as spans
  from spans group by doc_id
)
select d.doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access,
  coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from texts d left join texts_of s on d.doc_id = s.doc_id
"""


@query("op1_secret_ledger", _OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    findings = secrets.scan(documents, run_folder(spark, "ledger"))
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,number:int,end:bigint,rule:string>>"))
    listed = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["rule"], s["start"], s["end"])), ",")
    of_kind = lambda kind: F.size(F.filter(spans, lambda s: s["rule"] == kind)).cast("bigint")
    per_blob = findings.select(
        "blob",
        "spans",
        of_kind("assign").alias("n_assign"),
        of_kind("access").alias("n_access"),
        of_kind("hex").alias("n_hex"),
        listed.alias("listed"),
    )
    paths = documents.select("doc_id", secrets.blob_of(F.col("text")).alias("blob")).join(per_blob, "blob", "left")
    count = lambda name: F.coalesce(name, F.lit(0).cast("bigint")).alias(name)
    text = F.coalesce("listed", F.lit(""))
    return paths.select(
        "doc_id", count("n_assign"), count("n_access"), count("n_hex"), F.sha2(text, 256).alias("base_sha256"), text.alias("spans")
    )


@query("op2_hierarchical_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read_table(spark, sf_dir, "documents"), ids=False)


@query("op3_factorisation_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op4_audio_features")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = stored(audio.media_table(read_table(spark, sf_dir, "documents")), "audio-media")
    found = audio.audio_features(media, "doc_id", "n_bytes", tensors=False)
    feature = F.concat_ws("|", "frames", "windows", "mean_energy", "loud_ms", "tensors_sha256")
    base = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
    return found.select(*base, feature.alias("feature"))


@query("op5_kneser_ney_language")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages_of(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


@query("op6_offset_masks")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], table.schema)
    return chat.digests(chat.formatted(table.union(extra)))


@query("op8_bit_sliced_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicate_classes(read_table(spark, sf_dir, "documents"), words=3)
    return found.select("doc_id", simhash.hex_digits("fingerprint").alias("fingerprint"), "component_id")


_OP9_SQL = """
with vectors as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scored as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.v::double[], c.v::double[])::bigint as score
  from vectors q join vectors c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
),
ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""


@query("op9_norm_bucketed_topk", _OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query("op10_column_suffixes")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffixes.repeated_removed(documents, text=False)
    return found.select(
        "doc_id",
        F.col("repeat_n_bytes").alias("n_bytes"),
        F.col("repeat_n_removed").alias("n_removed"),
        F.col("repeat_n_spans").alias("n_spans"),
        F.col("repeat_kept_sha256").alias("kept_sha256"),
    )


@query("op7_byte_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = bpe.vocabulary()
    tokens = bpe.encoded(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return tokens.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2(bpe.decoded(F.col("ids"), known), 256).alias("decoded_sha256"),
    )


@query("op11_cross_tokenizer_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstokens.alignments(read_table(spark, sf_dir, "documents"))[0]


@query("op12_elias_fano_language_model")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.scored(read_table(spark, sf_dir, "documents"))[0]


@query("op13_embedding_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(read_table(spark, sf_dir, "embeddings"), components=32)

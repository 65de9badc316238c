"""Secret scans over a ledger of blobs: every distinct content is scanned once per rule version.

Each historical version of a path is addressed by the SHA-256 of its text. The ledger is two tables in one
folder: ``scanned`` (blob, rule, version) and ``findings`` (blob, rule, version, start, end). A scan reads the
ledger, takes the blobs and rule versions it has not seen, scans each such blob once (of the rows of its least path, one),
appends findings
before it appends what was scanned (findings of a run that broke off are never read), and joins the
ledger's findings back to all paths. Everything is DataFrame work; texts move once, and only unseen ones
where Spark's size statistics allow the list of unseen blobs to be broadcast.

Positions are code points, end exclusive. They follow from the lengths of a text's pieces between matches
and of the matches, summed in a window over one text's matches.

Defined cases: a null text is the empty blob; repeated rows and ids share their blob and each get its
findings; null ids are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechtables.llm.common import stored


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has ``least`` characters or more; shorter ones are used up."""

    name: str
    version: int
    pattern: str
    group: int
    least: int


# Fixed values. "hex" and "access" ask for their least length at once, which finds the same matches: a shorter
# run holds no longer one.
RULES = (
    Rule(
        "assign",
        1,
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    Rule("access", 1, "AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", 1, "[0-9a-f]{32,}", 0, 32),
)

_SCANNED = "run string, blob string, rule string, version int"
_FINDINGS = "run string, blob string, rule string, version int, start bigint, end bigint"


def _ledger(spark, path: str, table: str, schema: str) -> DataFrame:
    """A ledger table; empty before the first scan."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{table}")
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.read.schema(schema).parquet(f"{path}/{table}")
    return spark.createDataFrame([], T._parse_datatype_string(schema))


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _tag(rule: Rule) -> str:
    return f"{rule.name}@{rule.version}"


def _unseen(paths: DataFrame, ledger: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, rep, rows, todo): blobs with rules the ledger lacks, one path that has them, and how many rows of that
    path do."""
    scanned = _ledger(paths.sparkSession, ledger, "scanned", _SCANNED)
    seen = scanned.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", "version")).alias("seen"))
    versions = paths.groupBy("blob", "path").agg(F.count(F.lit(1)).alias("rows"))
    blobs = versions.groupBy("blob").agg(F.min(F.struct("path", "rows")).alias("one"))
    wanted = F.array(*[F.lit(_tag(r)) for r in rules])
    todo = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").select("blob", F.col("one.path").alias("rep"), F.col("one.rows").alias("rows"), todo.alias("todo")).filter(F.size("todo") > 0)


def find_spans(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, rule, version, start, end) of the texts (blob, text, todo)."""
    by_rule = [
        F.struct(
            F.lit(r.name).alias("rule"),
            F.lit(r.version).alias("version"),
            F.when(F.array_contains("todo", _tag(r)), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))).alias("found"),
        )
        for r in rules
    ]
    hits = texts.select("blob", "text", F.explode(F.array(*by_rule)).alias("hit")).filter(F.size("hit.found") > 0)
    between, secret = F.lit(None).cast("array<string>"), F.lit(None).cast("boolean")
    for r in rules:
        mine = F.col("hit.rule") == r.name
        between = F.when(mine, F.split("text", r.pattern, -1)).otherwise(between)
        secret = F.when(F.col("rule") == r.name, F.char_length(F.regexp_extract("part.found", r.pattern, r.group)) >= r.least).otherwise(secret)
    parts = hits.select(
        "blob",
        "hit.rule",
        "hit.version",
        F.posexplode(F.arrays_zip(between.alias("between"), F.col("hit.found").alias("found"))).alias("place", "part"),
    )
    order = Window.partitionBy("blob", "rule").orderBy("place")
    length = F.char_length("part.found")
    end = F.sum(F.char_length("part.between") + F.coalesce(length, F.lit(0))).over(order)
    spans = parts.withColumn("end", end).filter(F.col("part.found").isNotNull() & secret)
    return spans.select("blob", "rule", "version", (F.col("end") - length).alias("start"), "end")


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, path: str = "doc_id") -> DataFrame:
    """Bring the ledger up to date with ``versions`` (path, text) and return (blob, spans) of every
    blob that has findings; spans are sorted by start, then by the order of the rules."""
    spark = versions.sparkSession
    rows = versions.select(F.col(path).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    addressed = rows.withColumn("blob", blob_of(F.col("text")))
    todo = stored(_unseen(addressed.select("path", "blob"), ledger, rules), "ledger-unseen")
    run = uuid.uuid4().hex
    match = (addressed["blob"] == todo["blob"]) & addressed["path"].eqNullSafe(todo["rep"])
    asked = addressed.join(todo, match).select(todo["blob"], "text", "todo", "rows")
    once, repeated = asked.filter("rows = 1").drop("rows"), asked.filter("rows > 1").drop("rows")
    texts = once.union(repeated.dropDuplicates(["blob"]))
    found = find_spans(texts, rules).distinct().withColumn("run", F.lit(run))
    found.select("run", "blob", "rule", "version", "start", "end").write.mode("append").parquet(f"{ledger}/findings")
    marks = todo.select("blob", F.explode("todo").alias("tag")).select(
        F.lit(run).alias("run"),
        "blob",
        F.substring_index("tag", "@", 1).alias("rule"),
        F.substring_index("tag", "@", -1).cast("int").alias("version"),
    )
    marks.write.mode("append").parquet(f"{ledger}/scanned")
    return ledger_findings(spark, ledger, rules)


def ledger_findings(spark, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans) from the ledger, for the given rule versions."""
    complete = _ledger(spark, ledger, "scanned", _SCANNED).select("run").distinct()
    findings = _ledger(spark, ledger, "findings", _FINDINGS).join(complete, "run", "left_semi")
    wanted = F.concat_ws("@", "rule", "version").isin(*map(_tag, rules))
    number = F.array_position(F.array(*[F.lit(r.name) for r in rules]), F.col("rule"))
    span = F.struct("start", number.alias("number"), "end", "rule")
    return findings.filter(wanted).groupBy("blob").agg(F.array_sort(F.collect_set(span)).alias("spans"))


def with_findings(versions: DataFrame, findings: DataFrame, blob: str = "blob", spans: str = "spans") -> DataFrame:
    """All columns of ``versions``, its blob address, and its blob's spans (null: none)."""
    addressed = versions.withColumn(blob, blob_of(F.col("text")))
    return addressed.join(findings.select(F.col("blob").alias(blob), F.col("spans").alias(spans)), blob, "left")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """A text with each run of overlapping ``spans`` (sorted by start) replaced by ``mark``; null spans change nothing."""
    piece = lambda at, size: F.substring(text, (at + 1).cast("int"), size.cast("int"))
    first = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("kept"))

    def step(state: Column, span: Column) -> Column:
        apart = (span["start"] >= state["at"]) & (span["end"] > span["start"])
        grown = F.concat(state["kept"], piece(state["at"], span["start"] - state["at"]), F.lit(mark))
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"), F.when(apart, grown).otherwise(state["kept"]).alias("kept")
        )

    rest = lambda state: F.concat(state["kept"], piece(state["at"], F.char_length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, first, step, rest)).otherwise(text)

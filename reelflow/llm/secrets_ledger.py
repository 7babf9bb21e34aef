"""Secret scans with an incremental blob ledger, in DataFrame functions alone.

Every version of every path is content-addressed by the SHA-256 of its text.
The ledger says which (rule, version) pairs have scanned which blob.  A scan
takes the distinct blobs, leaves out the pairs that the ledger has, runs the
others once per blob, appends to ledger and findings, and joins the findings
back to all paths that hold the blob.

A rule is a kind, a version, a pattern, and a group with the least length a
match needs: matches are leftmost and non-overlapping per kind, and those that
fail the length are dropped afterwards, so a failing match still uses up its
text.  Offsets are code points, end exclusive.

Copies meet as partial aggregates per blob, so a group of copies is one row per
task before the shuffle; the join back to paths is an equi join whose hot blobs
Spark may split.

Defined cases: a null text is empty; a null path id keeps its row; repeated rows
each get theirs; an empty table gives no rows; further columns are not read.
Texts are scanned whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelflow.llm.shared import id_and_text, written


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0          # group whose length counts
    least: int = 1          # least length of it
    hint: str = ""          # a pattern that every match's text holds; cheap to look for
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}:{self.version}"


#: The base rules (fixed values), then what the scan adds.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6,
         hint=r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, hint="AKIA"),
    Rule("hex", r"[0-9a-f]+", 0, 24, hint=r"[0-9a-f]{24}"),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hint="PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 40, hint="gh[pousr]_"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40, hint="eyJ"),
)
RULES = BASE + MORE
LEDGER = "blob string, scanned array<string>"
FINDINGS = "blob string, kind string, start bigint, stop bigint"


def content_address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def matches(text: Column, rule: Rule) -> Column:
    """Every match in order: kind, number, length of the text since the last match, its own length, whether it holds."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    judged = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    return F.transform(
        F.arrays_zip(found.alias("hit"), judged.alias("part"),
                     F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found)).alias("before")),
        lambda m, k: F.struct(F.lit(rule.kind).alias("kind"), k.alias("k"), F.char_length(m["before"]).alias("gap"),
                              F.char_length(m["hit"]).alias("size"), (F.char_length(m["part"]) >= rule.least).alias("holds")))


def scan(versions: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None,
         findings: DataFrame | None = None, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Scan what the ledger lacks; the new ledger and findings, as tables in the shared folder."""
    spark = versions.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    blobs = versions.select(content_address(text).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is None:
        ledger, findings = spark.createDataFrame([], LEDGER), spark.createDataFrame([], FINDINGS)
        blobs = blobs.withColumn("known", F.array().cast("array<string>"))
    else:
        known = ledger.select("blob", F.explode("scanned").alias("pair")).groupBy("blob").agg(F.collect_set("pair").alias("known"))
        blobs = blobs.join(known, "blob", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    none = F.array().cast("array<struct<kind:string,k:int,gap:int,size:int,holds:boolean>>")
    hits = F.concat(*[F.when(~F.array_contains("known", r.key) & F.col("text").rlike(r.hint), matches(F.col("text"), r))
                      .otherwise(none) for r in rules])
    pairs = F.array(*[F.lit(r.key) for r in rules])
    scanned = written(blobs.select("blob", F.array_except(pairs, F.col("known")).alias("scanned"), hits.alias("hits")), "blob-scan")
    # a blob's matches of a kind: the ends add up, one blob at a time
    order = Window.partitionBy("blob", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = (scanned.where(F.size("hits") > 0).select("blob", F.inline("hits"))
             .withColumn("stop", F.sum(F.col("gap").cast("long") + F.col("size")).over(order)).where("holds")
             .select("blob", "kind", (F.col("stop") - F.col("size")).alias("start"), "stop"))
    new_ledger = ledger.unionByName(scanned.where(F.size("scanned") > 0).select("blob", "scanned"))
    return new_ledger, written(findings.unionByName(spans), "findings")


def findings_of_paths(versions: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, blob and spans (array of start, rank, kind, stop in order; null where none) of every path."""
    rank = F.element_at(F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.kind, k)]), F.col("kind"))
    per_blob = (findings.where(F.col("kind").isin([r.kind for r in rules])).groupBy("blob")
                .agg(F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "stop"))).alias("spans")))
    paths = id_and_text(versions, id_col, text_col).select("doc_id", content_address(F.col("text")).alias("blob"))
    return paths.join(per_blob, "blob", "left").select("doc_id", "blob", "spans")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(paths: DataFrame) -> DataFrame:
    """The digest columns of each path's spans."""
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,rank:int,kind:string,stop:bigint>>"))
    base = F.filter("all", lambda s: s["rank"] < len(BASE))
    count = lambda kind: F.size(F.filter("all", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return paths.withColumn("all", spans).select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("all")).alias("spans"), "blob")

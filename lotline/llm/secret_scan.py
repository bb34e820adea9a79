"""Secret scans over a ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text. A blob is scanned
once per version of the rules, however many paths and versions hold it; what was
scanned and what was found stays in a ledger, and findings are joined back to all paths.
All of it is DataFrame work.

The ledger is a folder with two Parquet tables that scans append to: ``findings``
(``blob, rules, kind, rank, start, end``) and ``scanned`` (``blob, rules``). Findings are
written first, so a scan that breaks off in between is repeated, and repeated findings
are read once.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lotline.llm.common import stored
from lotline.operators.joins import Window as KeyWindow

LEDGER_SCHEMA = {
    "findings": "blob string, rules string, kind string, rank int, start long, end long",
    "scanned": "blob string, rules string",
}
MASK = "[SECRET]"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a Java pattern, and the least length of its group ``group``."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


# Fixed values of the base kinds; a run of 16 or more is the whole run, so its length is in the pattern.
RULES = (
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=12,
        base=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]{14,}", base=True),
    Rule("hex", r"[0-9a-f]{16,}", base=True),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)


def rules_version(rules: tuple[Rule, ...]) -> str:
    """Names the rules by what they say, so that a changed rule scans all blobs again."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def blob_of(text: Column) -> Column:
    """Address of a text; a NULL text is the empty one."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _matches(text: Column, rule: Rule, rank: int) -> Column:
    """Matches of a rule in order: what lies before each, its length, and whether it counts.

    Splitting by the pattern gives the stretches between the matches.
    """
    pattern = F.lit(rule.pattern)
    zipped = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, pattern, 0), F.length).alias("size"),
        F.transform(F.regexp_extract_all(text, pattern, rule.group), lambda part: F.length(part) >= rule.least).alias("ok"),
    )
    told = F.transform(
        F.filter(zipped, lambda one: one["size"].isNotNull()),
        lambda one, at: F.struct(
            F.lit(rule.kind).alias("kind"),
            F.lit(rank).alias("rank"),
            at.alias("at"),
            one["gap"].cast("long").alias("gap"),
            one["size"].cast("long").alias("size"),
            one["ok"].alias("ok"),
        ),
    )
    none = F.array().cast("array<struct<kind:string,rank:int,at:int,gap:bigint,size:bigint,ok:boolean>>")
    return F.when(F.rlike(text, pattern), told).otherwise(none)


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob, rules, kind, rank, start, end`` of every finding in ``blob, text``.

    Places count code points from 0, the end is exclusive. Matches of a kind do not
    overlap; a match that is too short takes its place but is no finding.
    """
    matches = F.concat(*(_matches(F.col("text"), rule, rank) for rank, rule in enumerate(rules)))
    rows = blobs.select("blob", F.explode(matches).alias("m")).select("blob", "m.*")
    so_far = Window.partitionBy("blob", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(so_far)
    placed = rows.withColumn("end", end).filter("ok")
    return placed.select(
        "blob", F.lit(rules_version(rules)).alias("rules"), "kind", "rank", (F.col("end") - F.col("size")).alias("start"), "end"
    )


def _ledger(spark: SparkSession, path: str, name: str, version: str) -> DataFrame | None:
    """A table of the ledger for one version of the rules; None before the first scan."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.schema(LEDGER_SCHEMA[name]).parquet(f"{path}/{name}").filter(F.col("rules") == version).distinct()


def update_ledger(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan the unseen blobs of ``versions`` (``blob, text``) and return all findings of these rules."""
    spark, version = versions.sparkSession, rules_version(rules)
    unseen = versions.select("blob", "text")
    seen = _ledger(spark, ledger, "scanned", version)
    if seen is not None:
        maybe, fresh = KeyWindow(seen, ["blob"]).split(unseen, ["blob"])
        unseen = maybe.join(seen.select("blob"), "blob", "left_anti").unionByName(fresh)
    # Addresses tell which blobs repeat; the texts of others are scanned where they are read.
    repeated = stored(unseen.groupBy("blob").count().filter("count > 1").select("blob"), "repeated")
    maybe, single = KeyWindow(repeated, ["blob"]).split(unseen, ["blob"])
    blobs = maybe.groupBy("blob").agg(F.first("text").alias("text")).unionByName(single)
    scan_blobs(blobs, rules).write.mode("append").parquet(f"{ledger}/findings")
    names = unseen.select("blob", F.lit(version).alias("rules")).distinct()
    names.write.mode("append").parquet(f"{ledger}/scanned")
    return _ledger(spark, ledger, "findings", version)


def _spans(base_only: bool, rules: tuple[Rule, ...]) -> Column:
    kinds = [rule.kind for rule in rules if rule.base or not base_only]
    wanted = F.when(F.col("kind").isin(kinds), F.struct("start", "rank", "kind", "end"))
    return F.transform(
        F.sort_array(F.collect_list(wanted)),
        lambda one: F.concat_ws(":", one["kind"], one["start"].cast("string"), one["end"].cast("string")),
    )


def scan_documents(
    docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, *, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Findings of every document, by the ledger at ``ledger``, which is brought up to date.

    ``doc_id, blob``, a count ``n_<kind>`` per rule, ``base_spans`` and ``spans`` (``kind:start:end`` by
    start, then in the order of the rules). A NULL text is the empty one and has no
    findings. Rows that repeat an id, or share a text, each get the findings of their
    text. An empty table gives no rows; other columns are ignored.
    """
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    versions = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), blob_of(whole).alias("blob"), whole.alias("text"))
    findings = update_ledger(versions, ledger, rules)
    counts = [F.count(F.when(F.col("kind") == rule.kind, 1)).alias(f"n_{rule.kind}") for rule in rules]
    found = stored(
        findings.groupBy("blob").agg(
            *counts, _spans(True, rules).alias("base_spans"), _spans(False, rules).alias("spans")
        ),
        "findings",
    )
    joined = versions.select("doc_id", "blob").join(found, "blob", "left")
    empty = F.array().cast("array<string>")
    return joined.select(
        "doc_id",
        "blob",
        *(F.coalesce(f"n_{rule.kind}", F.lit(0)).alias(f"n_{rule.kind}") for rule in rules),
        F.coalesce("base_spans", empty).alias("base_spans"),
        F.coalesce("spans", empty).alias("spans"),
    )


def redact_documents(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, *, text: str = "text") -> DataFrame:
    """``docs`` with every finding in ``text`` masked; overlapping findings get one mask.

    All rows and columns stay; a text without findings stays as it is, a NULL one NULL.
    """
    name = "__blob"
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    findings = update_ledger(docs.select(blob_of(whole).alias("blob"), whole.alias("text")), ledger, rules)
    spans = F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__spans")
    found = stored(findings.groupBy(F.col("blob").alias(name)).agg(spans), "spans")
    # Few texts have a finding: the others pass in the scan.
    some, none = KeyWindow(found, [name]).split(docs.withColumn(name, blob_of(whole)), [name])
    joined = some.join(found, name, "left")
    source = F.col(f"`{text}`")

    def step(done: Column, span: Column) -> Column:
        before = F.substr(source, (done["to"] + 1).cast("int"), (span["start"] - done["to"]).cast("int"))
        fresh = span["start"] >= done["to"]
        return F.struct(
            F.when(fresh, F.concat(done["out"], before, F.lit(MASK))).otherwise(done["out"]).alias("out"),
            F.greatest(done["to"], span["end"]).alias("to"),
        )

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("to"))
    masked = F.aggregate(
        "__spans", start, step, lambda done: F.concat(done["out"], F.substr(source, (done["to"] + 1).cast("int")))
    )
    changed = joined.withColumn(text, F.when(F.col("__spans").isNull(), source).otherwise(masked)).select(*docs.columns)
    return changed.unionByName(none.select(*docs.columns))

"""Secret scans with an incremental blob ledger.

Every version of a text is content-addressed (SHA-256 of its UTF-8 bytes); the
ledger says which rules, in which version, have been run over a blob and what
they found. A scan looks only at unseen pairs of blob and rule version, adds
them to the ledger, and joins the findings back to every path that has the
blob. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.linking import saved
from riskloom.session import scratch_dir


@dataclass(frozen=True)
class Rule:
    """A kind of secret; matches are leftmost and do not overlap; those whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The base kinds, in their order.
BASE = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    # shorter runs never hold a longer match, so the least length can stand in the pattern
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
)
#: A key's header; its header fields; lines of base64 (line ends may be written as \n), the last of them short; its END line, if it is there.
_PART = r"(?:\\[rn]|[\s>\"'|#*\\])"
PEM = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
    r"(?:\s*+(?:Proc-Type|DEK-Info|Comment|Version):[^\r\n\\]*+)*+"
    rf"(?:{_PART}*+[A-Za-z0-9+/]{{16,}}+={{0,2}}+)*+"
    rf"(?:{_PART}++[A-Za-z0-9+/]{{1,15}}+={{0,2}}+(?=[\x20\t]*+(?:[\r\n\"'\\]|-----END|\z)))?+"
    rf"(?:{_PART}*+-----END [A-Z ]{{0,40}}PRIVATE KEY-----)?+"
)
MORE = (
    Rule("pem", 3, PEM),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE
LEDGER = "blob string, rules array<string>, findings array<struct<start:bigint,kind:string,end:bigint,rule:string>>"


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _marks(rule: Rule, text: Column, todo: Column) -> Column:
    """One struct a match: its number, the length of the text before it (from the match before), its own length, whether it counts."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda g: F.length(g).cast("long"))

    def mark(m: Column, g: Column) -> Column:
        enough = F.length(F.regexp_extract(m, rule.pattern, rule.group)) >= rule.least if rule.least else F.lit(True)
        return F.when(m.isNotNull(), F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.key).alias("rule"), g.alias("gap"), F.length(m).cast("long").alias("size"), enough.alias("counts")))

    return F.when(F.array_contains(todo, rule.key) & text.rlike(rule.pattern), F.zip_with(found, gaps, mark))


def scan_unseen(blobs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows of the pairs of blob and rule that the ledger lacks; blobs: (blob, text), one row a blob."""
    seen = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    wanted = F.array(*[F.lit(r.key) for r in rules])
    todo = blobs.join(seen, "blob", "left").withColumn("rules", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("rules") > 0)
    marks = todo.select("blob", "rules", F.array(*[_marks(r, F.col("text"), F.col("rules")) for r in rules]).alias("by_rule"))
    rows = marks.select("blob", "rules", F.posexplode_outer(F.filter(F.flatten(F.filter("by_rule", lambda m: m.isNotNull())), lambda m: m.isNotNull())).alias("at", "m")) \
        .select("blob", "rules", "at", "m.*")
    each = Window.partitionBy("blob", "rule").orderBy("at")
    end = F.sum(F.col("gap") + F.col("size")).over(each.rowsBetween(Window.unboundedPreceding, 0))
    span = F.struct((F.col("end") - F.col("size")).alias("start"), F.col("kind"), F.col("end"), F.col("rule"))
    spans = rows.withColumn("end", end).withColumn("span", F.when(F.col("counts"), span))
    return spans.groupBy("blob").agg(F.first("rules").alias("rules"), F.sort_array(F.collect_list("span")).alias("findings"))


def scan(spark: SparkSession, docs: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scan all texts against the ledger at ``ledger_path`` (created if missing), extend it, and return findings by path.

    Returns one row per input row: doc_id, blob, findings (array of start,
    kind, end, rule; code points, end exclusive; by start). Null and empty
    texts are the empty blob and have none; copies and repeated rows share one
    blob, which is scanned once; null ids stay null; an empty table gives no
    rows; other columns are not read.
    """
    table = spark.read.schema(LEDGER)
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(ledger_path)
    versions = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("blob", blob_id(F.col("text")))
    scan_unseen(versions.select("blob", "text").dropDuplicates(["blob"]), table.parquet(ledger_path), rules).write.mode("append").parquet(ledger_path)
    wanted = [r.key for r in rules]
    known = table.parquet(ledger_path).select("blob", F.filter("findings", lambda f: f["rule"].isin(wanted)).alias("findings")) \
        .groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("findings"))).alias("findings"))
    # read back, both sides of the join are dealt for it alone, and a blob with very many paths can be split
    known = saved(spark, known, "findings")
    return versions.select("doc_id", "blob").join(known, "blob").select("doc_id", "blob", "findings")


def redact(text: Column, findings: Column, mark: str = "[SECRET]") -> Column:
    """The text with every finding replaced by the mark (overlapping findings by one)."""
    # the end of what is covered so far, and the text built so far
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, f: Column) -> Column:
        fresh = f["start"] >= acc["at"]
        grown = F.concat(acc["out"], F.array(F.concat(F.substring(text, (acc["at"] + 1).cast("int"), (f["start"] - acc["at"]).cast("int")), F.lit(mark))))
        return F.struct(F.greatest(acc["at"], f["end"]).alias("at"), F.when(fresh, grown).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(findings, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    return F.when(F.size(findings) > 0, done).otherwise(text)


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Findings by document against a fresh ledger, as counts and position digests."""
    order = {r.kind: k for k, r in enumerate(RULES)}
    place = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    base = [r.kind for r in BASE]

    def listed(spans: Column) -> Column:
        ordered = F.sort_array(F.transform(spans, lambda f: F.struct(f["start"].alias("start"), place[f["kind"]].alias("k"), f["end"].alias("end"), f["kind"].alias("kind"))))
        return F.array_join(F.transform(ordered, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scan(spark, docs, scratch_dir(spark, "ledger")).select(
        "doc_id", *[count(k) for k in base], F.sha2(listed(F.filter("findings", lambda f: f["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("findings")).alias("spans"))

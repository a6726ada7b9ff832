"""Secret scans with an incremental ledger of scanned contents.

A text version is addressed by its SHA-256, its blob. The ledger holds, per blob, which rules (name
and version) have been run over it and what they found. A scan takes only those pairs of blob and rule that
the ledger lacks, appends them, and joins the findings back to every row, so a copy or an unchanged file
is never scanned twice, and a new rule version scans every blob once more with that rule alone.

Only DataFrame functions run. Spark has no function that gives the places of all matches; they
follow from the lengths of the matches and of the gaps between them, summed in order. Places count code
points, ends are exclusive. Matches of a rule are leftmost and do not overlap.

Defined cases: a null text counts as empty; an empty text has no findings; repeated rows are
scanned once and each returned; an empty table leaves the ledger as it is; an input column
named ``findings`` is replaced. A blob that a stopped run has appended twice counts once.
"""

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagmill.llm.common import packed, unpacked
from tagmill.storage import cleared_shuffles, fresh_path, lookup_join

LEDGER = "blob binary, rules array<string>, findings array<struct<start:bigint,place:int,kind:string,end:bigint,rule:string>>"


class Rule(NamedTuple):
    """A pattern; a match whose group ``group`` is shorter than ``least`` is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The base rules, in their order, then rules of this operator.
BASE_RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE_RULES + MORE_RULES


def open_ledger(spark: SparkSession, path: str) -> str:
    """Make sure that a ledger can be read at ``path``."""
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(path)
    return path


def blob_of(text):
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def matches(text, rule: Rule, place: int):
    """Null without a match, else the rule and, per match, lengths of the gap before it, of the
    match, and whether it counts."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    parts = F.transform(
        F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), whole.alias("hit"), tested.alias("tested")),
        lambda x: F.struct(
            F.length(x["gap"]).alias("gap"),
            F.length(x["hit"]).alias("hit"),
            (F.length(x["tested"]) >= rule.least).alias("counts"),
        ),
    )
    found = F.struct(F.lit(place).alias("place"), F.lit(rule.kind).alias("kind"), F.lit(rule.name).alias("rule"), parts.alias("parts"))
    return F.when(text.rlike(rule.pattern), found)


def found_in(blobs: DataFrame, rules) -> DataFrame:
    """Ledger rows of blobs (``blob, text, rules``): each is scanned with its own pending rules."""
    each = [F.when(F.array_contains("rules", rule.name), matches(F.col("text"), rule, i)) for i, rule in enumerate(rules)]
    hits = blobs.select("blob", "rules", F.explode_outer(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("x"))
    parts = hits.select("blob", "rules", "x.place", "x.kind", "x.rule", F.posexplode_outer("x.parts").alias("i", "part"))
    before = Window.partitionBy("blob", "place").orderBy("i")
    ends = parts.withColumn("end", F.sum(F.col("part.gap") + F.coalesce("part.hit", F.lit(0))).over(before))
    finding = F.struct((F.col("end") - F.col("part.hit")).alias("start"), "place", "kind", "end", "rule")
    return ends.groupBy("blob").agg(
        F.first("rules").alias("rules"),
        F.sort_array(F.collect_list(F.when(F.col("part.counts"), finding))).alias("findings"),
    )


def scan_unseen(versions: DataFrame, ledger: str, rules=RULES, text: str = "text") -> DataFrame:
    """Scan the pairs of blob and rule that the ledger lacks and append them; the blobs of ``versions``."""
    spark = versions.sparkSession
    wanted = F.array(*[F.lit(rule.name) for rule in rules])
    content = F.coalesce(F.col(text), F.lit(""))
    blobs = versions.select(blob_of(content).alias("blob"), content.alias("text")).dropDuplicates(["blob"])
    known = spark.read.schema(LEDGER).parquet(ledger)
    if known.isEmpty():
        pending = blobs.withColumn("rules", wanted)
    else:
        seen = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("seen"))
        left = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
        pending = blobs.join(seen, "blob", "left").withColumn("rules", left).drop("seen").where(F.size("rules") > 0)
    with cleared_shuffles(spark):  # texts move here, and once more where findings are joined to many rows
        found_in(pending, rules).write.mode("append").parquet(ledger)


def scan_secrets(versions: DataFrame, ledger: str | None = None, rules=RULES, text: str = "text") -> DataFrame:
    """All input columns and ``findings``, sorted by start and order of the rules.

    Without a ledger a new one is begun in the shared folder.
    """
    spark = versions.sparkSession
    ledger = open_ledger(spark, ledger or fresh_path(spark, "ledger"))
    scan_unseen(versions, ledger, rules, text)
    current = F.filter("findings", lambda f: f["rule"].isin([rule.name for rule in rules]))
    known = spark.read.schema(LEDGER).parquet(ledger).select("blob", current.alias("found")).where(F.size("found") > 0)
    by_blob = known.groupBy("blob").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("found")))).alias("findings"))
    rows = packed(versions)
    rows = rows.withColumn("blob", blob_of(F.col("doc").getField(text)))
    none = F.array().cast(by_blob.schema["findings"].dataType)
    joined = lookup_join(rows, by_blob, "blob", "left").withColumn("findings", F.coalesce("findings", none))
    return unpacked(joined, ["findings"])


def described(findings):
    """``kind:start:end`` of each finding, comma-joined."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def masked(text, findings, mask: str = "<secret>"):
    """The text with every found stretch replaced; stretches that overlap become one."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(state, f):
        gap = F.substring(text, (state["at"] + 1).cast("int"), (f["start"] - state["at"]).cast("int"))
        fresh = F.struct(F.concat(state["out"], gap, F.lit(mask)).alias("out"), f["end"].alias("at"))
        longer = F.struct(state["out"].alias("out"), F.greatest(state["at"], f["end"]).alias("at"))
        return F.when((f["start"] >= state["at"]), fresh).otherwise(longer)

    rest = lambda state: F.concat(state["out"], F.substring(text, (state["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(findings) > 0, F.aggregate(findings, start, step, rest)).otherwise(text)

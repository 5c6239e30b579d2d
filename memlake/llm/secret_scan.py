"""Secret scanning against an incremental blob ledger, in DataFrame expressions only.

Every version of a file is addressed by the SHA-256 of its text. A ledger (Parquet) holds the findings of each pair
of blob and rule version that was scanned: a row names the rules, with their versions, that one scan applied. A run
scans a blob for the rules alone whose version it lacks, appends them, and joins findings back to every path that
holds the blob.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import heavy_join, keep, shared_dir


@dataclass(frozen=True)
class Rule:
    """A kind of secret: non-overlapping matches of `pattern`, from the left; `keep` must match within them."""

    kind: str
    pattern: str
    keep: str = ""
    #: A cheap test that every text with a match passes.
    hint: str = ""
    #: To be raised when any of the above changes: the ledger's blobs are then scanned again for this rule.
    version: int = 1

    @property
    def tag(self) -> str:
        return f"{self.kind}@{self.version}"


# The three base kinds in their order, as the contract states them. A run of 16 hex digits, or 14
# behind AKIA, is matched as such: runs are maximal, so shorter ones can't hide longer ones.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12,}$""", r"(?i:passw|secret|token|api_?key)"),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Kinds that this scanner adds.
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + ADDED
LEDGER = "blob string, scanned array<string>, findings array<struct<start:int,tag:string,end:int>>"
SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _fold(items: Column, start: Column) -> Column:
    empty = F.array().cast("array<int>")
    step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(items, F.struct(start.cast("int").alias("at"), empty.alias("out")), step, lambda acc: acc["out"])


def running_sums(items: Column) -> Column:
    """For each item of a non-empty int array the sum of those before it.

    A fold that appends copies its array at each step, so runs of the square root of the size are folded by
    themselves, from the sums of the runs before.
    """

    def from_runs(runs: Column) -> Column:
        totals = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda a, x: a + x))
        return F.flatten(F.zip_with(runs, _fold(totals, F.lit(0)), _fold))

    def cut(x: Column) -> Column:
        wide = F.ceil(F.sqrt(F.size(x))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / wide).cast("int") - 1), lambda k: F.slice(x, k * wide + 1, wide))

    return _let(_let(items, cut), from_runs)


def _matches(text: Column, rule: Rule) -> Column:
    """Structs (start, tag, end) of a rule's matches, in code points. Text between the matches gives the starts."""

    def placed(m: Column) -> Column:
        steps = F.zip_with(m["gaps"], m["widths"], lambda gap, width: gap + F.coalesce(width, F.lit(0)))
        good = F.sequence(F.lit(1), F.size(m["found"]))
        if rule.keep:
            good = F.filter(good, lambda i: F.element_at(m["found"], i).rlike(rule.keep))
        span = lambda start, i: F.struct(start.alias("start"), F.lit(rule.tag).alias("tag"), (start + F.element_at(m["widths"], i)).alias("end"))
        return _let(running_sums(steps), lambda sums: F.transform(good, lambda i: span(F.element_at(sums, i) + F.element_at(m["gaps"], i), i)))

    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    none = F.array().cast("array<struct<start:int,tag:string,end:int>>")
    pieces = _let(found, lambda f: F.struct(f.alias("found"), F.transform(f, F.length).alias("widths"), F.transform(F.split(text, rule.pattern, -1), F.length).alias("gaps")))
    return F.when(text.rlike(rule.hint or rule.pattern), _let(pieces, lambda m: F.when(F.size(m["found"]) > 0, placed(m)).otherwise(none))).otherwise(none)


def scan_text(text: Column, rules: tuple[Rule, ...] = RULES, todo: Column | None = None) -> Column:
    """Findings (start, tag, end) of all rules in a text, or of those whose tag is in `todo`."""
    none = F.array().cast("array<struct<start:int,tag:string,end:int>>")
    return F.concat(*[_matches(text, r) if todo is None else F.when(F.array_contains(todo, r.tag), _matches(text, r)).otherwise(none) for r in rules])


def secret_scan(docs: DataFrame, ledger: str, path_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger (a folder) has not seen, append it, and return (path_col, blob, findings) per row of docs.

    findings: structs (start, rank, kind, end) of the rules asked for, by start and then by the rules' order. A
    null text is an empty blob, which has no findings. Rows that repeat a path or a text all get their blob's
    findings; a null path is a path. Other columns are ignored. No rows: an empty result and an unchanged ledger.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    blobs = docs.select(F.col(path_col).alias("path"), F.sha2(text, 256).alias("blob"), text.alias("text"))
    paths = keep(blobs.select("path", "blob"), "paths")
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(ledger)
    tags = F.array(*[F.lit(r.tag) for r in rules])
    seen = spark.read.schema(LEDGER).parquet(ledger).filter(F.arrays_overlap("scanned", tags)).groupBy("blob").agg(F.flatten(F.collect_set("scanned")).alias("seen"))
    # One path stands for a blob: the keys alone decide, then texts move once, dealt by blob and path together.
    key = F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path")
    first = paths.groupBy("blob").agg(F.min("path").alias("path")).join(seen, "blob", "left")
    first = first.select("blob", key, F.when(F.col("seen").isNull(), tags).otherwise(F.array_except(tags, "seen")).alias("todo")).filter(F.size("todo") > 0)
    one = blobs.select("blob", key, "text").join(first.hint("shuffle_hash"), ["blob", "path"])
    # A path that repeats may append its blob twice; readers of the ledger take one of equal findings.
    one.select("blob", F.col("todo").alias("scanned"), scan_text(F.col("text"), rules, F.col("todo")).alias("findings")).write.mode("append").parquet(ledger)
    mine = F.filter("findings", lambda x: F.array_contains(tags, x["tag"]))
    found = spark.read.schema(LEDGER).parquet(ledger).select("blob", mine.alias("findings")).filter(F.size("findings") > 0)
    rank = lambda x: (F.array_position(tags, x["tag"]) - 1).cast("int")
    named = F.transform(F.array_distinct(F.flatten(F.collect_set("findings"))), lambda x: F.struct(x["start"].alias("start"), rank(x).alias("rank"), F.split_part(x["tag"], F.lit("@"), F.lit(1)).alias("kind"), x["end"].alias("end")))
    found = keep(found.groupBy("blob").agg(F.array_sort(named).alias("findings")), "found")
    joined = heavy_join(paths, found, "blob", "left")
    return joined.select(F.col("path").alias(path_col), "blob", F.coalesce("findings", F.array().cast(SPANS)).alias("findings"))


def secret_report(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """Contract columns: doc_id, n_assign, n_access, n_hex, base_sha256, spans, and the blob's address."""
    ledger = ledger or f"{shared_dir(docs.sparkSession)}/memlake/{uuid.uuid4().hex}-ledger"
    all_of = secret_scan(docs, ledger)
    base = F.filter("findings", lambda x: x["rank"] < len(BASE))
    say = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    count = lambda rank: F.size(F.filter("findings", lambda x: x["rank"] == rank)).cast("long")
    return all_of.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(say(base), 256).alias("base_sha256"), say(F.col("findings")).alias("spans"), "blob")

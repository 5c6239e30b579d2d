"""Listings, verbs and readouts over records, turns, branches and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import is_active, superseder
from .alike import alike, to_each


def standing(records: DataFrame, kinds: tuple[str, ...], limit: int) -> DataFrame:
    """The newest active records of some types in each project, `limit` of each, with their rank."""
    order = Window.partitionBy("project").orderBy(F.desc("updated_at"), F.desc("id"))
    rows = records.filter(is_active(F.col("deleted_at"), F.col("archived_reason")) & F.col("type").isin(*kinds))
    return rows.withColumn("rank", (F.row_number().over(order) - 1).cast("long")).filter(F.col("rank") < limit)


def with_prefix(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """P5: rows whose column starts with a prefix, whatever its case; signs in it stand for themselves."""
    return rows.filter(F.startswith(F.lower(column), F.lit(prefix.lower())))


def retracted(records: DataFrame, ref: str, like: bool = False, reason: str = "retracted") -> DataFrame:
    """Records with those of a source archived, as `hit` says. Archived ones are left alone, so a second run hits none.

    like: `ref` is a pattern with % and _.
    """
    mine = F.col("source_ref").like(ref) if like else F.col("source_ref") == ref
    hit = F.coalesce(mine, F.lit(False)) & is_active(F.col("deleted_at"), F.col("archived_reason"))
    return records.withColumn("hit", hit).withColumn("archived_reason", F.when(F.col("hit"), reason).otherwise(F.col("archived_reason")))


def without_key(rows: DataFrame, column: str, path: str) -> DataFrame:
    """Rows whose JSON has nothing at a path; text that is no JSON has nothing there."""
    return rows.filter(F.get_json_object(column, path).isNull())


def without_superseded(rows: DataFrame) -> DataFrame:
    """Rows (id, archived_reason) without those whose superseder is among them."""
    by = rows.select("id", superseder(F.col("archived_reason")).alias("_by"))
    gone = by.join(rows.select(F.col("id").alias("_by")), "_by", "left_semi").select("id")
    return rows.join(gone, "id", "left_anti")


def last_minutes(turns: DataFrame, key: str, ts: str, minutes: int) -> DataFrame:
    """Turns of the last minutes before a session's final one."""
    end = F.max(ts).over(Window.partitionBy(key))
    return turns.withColumn("_end", end).filter(F.unix_micros(F.col(ts).cast("timestamp")) >= F.unix_micros(F.col("_end").cast("timestamp")) - minutes * 60_000_000).drop("_end")


def apply_verbs(records: DataFrame, verbs: DataFrame) -> DataFrame:
    """Records (id, content, project, archived_reason, deleted) after verbs (seq, id, verb, value), the last of each kind.

    Verbs: add (an unknown id only), update, archive, label, delete. A deleted record takes no other verb, whether it was
    deleted before or by an earlier verb of the log.
    """
    gone = verbs.filter("verb = 'delete'").groupBy("id").agg(F.min("seq").alias("_end"))
    verbs = verbs.join(gone, "id", "left").filter(F.col("_end").isNull() | (F.col("seq") <= F.col("_end")))
    last = lambda verb: F.max_by("value", F.when(F.col("verb") == verb, F.col("seq")))
    has = lambda verb: F.max((F.col("verb") == verb).cast("int")) == 1
    said = verbs.groupBy("id").agg(*[last(v).alias(f"_{v}") for v in ("add", "update", "archive", "label")], has("add").alias("_new"), has("delete").alias("_gone"))
    both = records.withColumn("_old", F.lit(True)).join(said, "id", "full").filter(F.col("_old") | F.col("_new"))
    open_ = ~F.coalesce("deleted", F.lit(False))
    take = lambda verb, c: F.when(open_, F.coalesce(f"_{verb}", c)).otherwise(F.col(c))
    content = F.coalesce(take("update", "content"), F.when(F.col("_old").isNull(), F.coalesce("_update", "_add")))
    return both.select("id", content.alias("content"), take("label", "project").alias("project"), take("archive", "archived_reason").alias("archived_reason"), (F.coalesce("deleted", F.lit(False)) | F.coalesce("_gone", F.lit(False))).alias("deleted"))


def to_review(rules: DataFrame, seen: DataFrame) -> DataFrame:
    """Rules (id, updated_at) that no one reviewed since they changed. seen: (id, reviewed_at)."""
    last = seen.groupBy("id").agg(F.max("reviewed_at").alias("_at"))
    return rules.join(last, "id", "left").filter(F.col("_at").isNull() | (F.col("_at") < F.col("updated_at"))).drop("_at")


def stranded(branches: DataFrame, files: DataFrame, as_of: Column, days: int) -> DataFrame:
    """(org, repo, branch, age_days, files, place) of branches that are not merged and have not moved, oldest first.

    branches: (org, repo, branch, merged, moved_at); files: (org, repo, branch, path).
    """
    keys = ["org", "repo", "branch"]
    age = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp("moved_at")) / 86400)
    held = files.groupBy(*keys).agg(F.count("*").alias("files"))
    rows = branches.withColumn("age_days", age).filter(~F.col("merged") & (F.col("age_days") >= days)).join(held, keys, "left")
    order = Window.partitionBy("org").orderBy(F.desc("age_days"), "repo", "branch")
    return rows.select(*keys, "age_days", F.coalesce("files", F.lit(0)).alias("files"), (F.row_number().over(order) - 1).cast("long").alias("place"))


def branch_stats(branches: DataFrame) -> DataFrame:
    """Per org and repository its branches, merged ones and the last move."""
    return branches.groupBy("org", "repo").agg(F.count("*").alias("branches"), F.count_if("merged").alias("merged"), F.max("moved_at").alias("last_move"))


def votes(rows: DataFrame, key: str, vote: str) -> DataFrame:
    """Per key the most frequent vote, the lower of equal ones, and the half-even rounded median."""
    counts = rows.filter(F.col(vote).isNotNull()).groupBy(key, vote).agg(F.count("*").alias("n"))
    mode = counts.groupBy(key).agg(F.max_by(vote, F.struct("n", (-F.col(vote)).alias("low"))).alias("majority"))
    return mode.join(rows.groupBy(key).agg(F.bround(F.median(vote)).cast("long").alias("median"), F.count(vote).alias("votes")), key)


def failure_rates(events: DataFrame, key: str, last: int = 50) -> DataFrame:
    """Per key the failures among its last events, their share of those, and of all events, as it was reported before."""
    order = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("id"))
    rows = events.withColumn("_n", F.row_number().over(order))
    fails = F.count_if((F.col("_n") <= last) & F.col("failed"))
    return rows.groupBy(key).agg(fails.alias("failed"), (fails / F.count_if(F.col("_n") <= last)).alias("rate"), (fails / F.count("*")).alias("rate_of_all"))


def ledger(events: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Per kind what enforcement did in the last days: counts, and rates that are null where nothing happened."""
    recent = events.filter((F.col("ts") > as_of - F.make_dt_interval(F.lit(days))) & (F.col("ts") <= as_of))
    n = lambda x: F.count_if(F.col("outcome") == x)
    ratio = lambda a, b: F.round(a / F.nullif(a + b, F.lit(0)), 6)
    return recent.groupBy("kind").agg(F.count("*").alias("n"), n("block").alias("blocked"), ratio(n("block"), n("fired")).alias("block_rate"), ratio(n("satisfied"), n("abandoned")).alias("satisfied_rate"))


def best_of_queries(asked: DataFrame, found: DataFrame) -> DataFrame:
    """Queries `a | b | c` (query_id, query) with the best score of each id over their parts. found: (query, id, score).

    Each set of parts is answered once, then given to all queries with that set.
    """
    parts = asked.select("query_id", F.explode(F.filter(F.transform(F.split("query", r"\|"), lambda x: F.trim(x)), lambda x: x != "")).alias("query"))
    everyone = alike(parts, "query_id", F.col("query"))
    best = everyone.select("key").distinct().select("key", F.explode("key").alias("query")).join(found, "query").groupBy("key", "id").agg(F.max("score").alias("score"))
    return to_each(best, everyone, "key").select("query_id", "id", "score")


def canonical(pairs: Column) -> Column:
    """A map of strings as JSON with its keys in order and no blanks, for hashes that must agree elsewhere."""
    quoted = lambda s: F.regexp_replace(F.to_json(F.array(s)), r"^\[|\]$", "")
    items = F.transform(F.array_sort(F.map_entries(pairs)), lambda e: F.concat(quoted(e["key"]), F.lit(":"), F.coalesce(quoted(e["value"]), F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(items, ","), F.lit("}"))


def fit_labels(pairs: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Pairs (session_id, winner, loser) with where each side was delivered: here, elsewhere or nowhere."""
    here = deliveries.select("session_id", "memory_id").distinct()
    any_ = deliveries.select("memory_id").distinct()
    rows = pairs
    for side in ("winner", "loser"):
        rows = rows.join(here.select("session_id", F.col("memory_id").alias(side), F.lit(True).alias("_h")), ["session_id", side], "left").join(any_.select(F.col("memory_id").alias(side), F.lit(True).alias("_a")), side, "left")
        rows = rows.withColumn(f"{side}_place", F.when(F.col("_h"), "here").when(F.col("_a"), "elsewhere").otherwise("nowhere")).drop("_h", "_a")
    return rows.withColumn("valid", (F.col("winner_place") == "here") & (F.col("loser_place") == "here") & (F.col("winner") != F.col("loser")))

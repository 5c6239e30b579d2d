"""Rules over records, files, tools and sessions: associations, staleness, capture, upkeep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import direction_mismatch, has_content
from ..params import DEFAULTS, Params
from ..sources.storage import written
from .alike import alike, to_each

# Names, patterns and ranks that results depend on.
GENERIC_NAMES = ("__init__.py", "index.js", "index.ts", "main.py", "README.md", "package.json", "setup.py", "utils.py")
EPHEMERAL_STARTS = ("/tmp/", "/var/tmp/", "/dev/shm/", "/run/", "/private/tmp/", "/proc/", "/sys/")
EPHEMERAL_PARTS = ("/.cache/", "/scratch/", "/scratchpad/", "/node_modules/", "/.venv/", "/__pycache__/", "/.git/")
PATH = r"""(?:^|[\s`'"(])((?:/|\./|[\w.-]+/)[\w./-]*\.\w{1,6})"""
JUNK_PATH = r"(^/(tmp|proc|sys)/|(^|/)(\.git|\.venv|node_modules|__pycache__|\.cache)(/|$)|\.(log|db|pyc|tmp|lock)$)"
TYPE_ORDER = ("correction", "decision", "preference", "fact", "skill", "workflow", "project", "person")
HALF_LIVES = {"explicit": 120.0, "correction": 60.0, "observation": 30.0, "meta-assessment": 60.0}


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_matches(records: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, id, quality, rank) of records that name a file: 2 by its path, 1 by its name in the same project.

    records: (id, project, session, updated_at, files); asked: (query_id, path, project, session). Names that every
    project has match by path alone, and a session's own records are left out. Two equi-joins, not a theta join, for
    each file, project and session once, then given to all queries with these.
    """
    everyone = alike(asked, "query_id", F.struct("path", "project", "session"))
    asked = everyone.select("key").distinct().select(F.col("key").alias("query_id"), F.inline("key"))
    each = records.select("id", F.col("project").alias("_p"), F.col("session").alias("_s"), "updated_at", F.explode(F.array_distinct("files")).alias("path"))
    exact = asked.join(each, "path").select("query_id", "id", "session", "_s", "updated_at", F.lit(2).alias("quality"))
    named = asked.withColumn("name", base_name(F.col("path"))).filter(~F.col("name").isin(*GENERIC_NAMES)).drop("path")
    near = named.join(each.withColumn("name", base_name(F.col("path"))).drop("path"), "name").filter(F.col("project") == F.col("_p")).select("query_id", "id", "session", "_s", "updated_at", F.lit(1).alias("quality"))
    other = exact.unionByName(near).filter(~F.coalesce(F.col("session") == F.col("_s"), F.lit(False)))
    best = other.groupBy("query_id", "id").agg(F.max("quality").alias("quality"), F.first("updated_at").alias("updated_at"))
    order = Window.partitionBy("query_id").orderBy(F.desc("quality"), F.desc("updated_at"), "id")
    ranked = best.select(F.col("query_id").alias("key"), "id", "quality", (F.row_number().over(order) - 1).cast("long").alias("rank"))
    return to_each(ranked, everyone, "key").select("query_id", "id", "quality", "rank")


def about_records(text: Column, store: str) -> Column:
    """Whether a text speaks of what is or isn't recorded, rather than of the work. store: what records are kept in."""
    return F.lower(text).rlike(
        rf"\bno (?:prior )?(?:memory|memories|record|entry|entries) (?:of|about|for|exist)|\b{store} (?:has no|contains no|has limited|lacks|knows nothing)|\b{store} contains a (?:profile|memory|record)"
        r"|\b(?:should be|to be|will be|not yet|never) captured\b|\bcaptured when (?:shared|provided|mentioned)|\bself-referential meta|\bmemor(?:y|ies) (?:of [^.]{0,40} )?exists?\b"
        rf"|\b(?:limited|no) info(?:rmation)? (?:on|about) [^.]{{0,40}} in {store}"
    )


def without_meta(records: DataFrame, store: str, text: str = "content", kind: str = "type") -> DataFrame:
    """Records without those about records and their store; corrections always stay."""
    return records.filter((F.col(kind) == "correction") | ~about_records(F.col(text), store))


def is_ephemeral(path: Column) -> Column:
    """A place whose contents are expected to vanish, so that absence says nothing."""
    rooted = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return reduce(lambda a, b: a | b, [rooted.startswith(x) for x in EPHEMERAL_STARTS] + [rooted.contains(x) for x in EPHEMERAL_PARTS])


def named_paths(text: Column) -> Column:
    """Distinct paths with a folder and an extension that a text names."""
    found = F.transform(F.regexp_extract_all(text, F.lit(PATH), F.lit(1)), lambda x: F.regexp_replace(x, r"[.,);:]+$", ""))
    return F.array_distinct(F.filter(found, lambda x: F.length(x) > 3))


def staleness(records: DataFrame, existing: DataFrame, roots: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(id, verdict, named, missing): stale if all files that a record names are gone, ok if none is, else skip.

    records: (id, type, project, content); existing: (path); roots: (project, root) of what is checked out here.
    Only records of `kinds` are judged, by paths that are absolute or below a known root and not ephemeral.
    """
    each = records.filter(F.col("type").isin(*kinds)).select("id", "project", F.explode(named_paths(F.col("content"))).alias("path")).filter(~is_ephemeral(F.col("path")))
    full = each.join(roots, "project", "left").select("id", F.when(F.col("path").startswith("/"), F.col("path")).when(F.col("root").isNotNull(), F.concat_ws("/", "root", "path")).alias("path")).filter("path IS NOT NULL")
    seen = full.join(existing.select("path", F.lit(1).alias("here")).distinct(), "path", "left").groupBy("id").agg(F.count("*").alias("named"), F.count_if(F.col("here").isNull()).alias("missing"))
    verdict = F.when(F.col("missing") == 0, "ok").when(F.col("missing") == F.col("named"), "stale").otherwise("skip")
    joined = records.select("id").join(seen, "id", "left")
    return joined.select("id", F.coalesce(verdict, F.lit("skip")).alias("verdict"), F.coalesce("named", F.lit(0)).alias("named"), F.coalesce("missing", F.lit(0)).alias("missing"))


def annotate_stale(records: DataFrame, verdicts: DataFrame, log: DataFrame, archive: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, log): stale ones are noted once in the log (id, note), and archived where asked."""
    stale = verdicts.filter("verdict = 'stale'").select("id")
    new = stale.join(log.filter("note = 'stale-assertion'").select("id"), "id", "left_anti").select("id", F.lit("stale-assertion").alias("note"))
    marked = records.join(stale.withColumn("_stale", F.lit(True)), "id", "left")
    reason = F.when(F.col("_stale") & F.lit(archive) & (F.coalesce("archived_reason", F.lit("")) == ""), "stale-assertion").otherwise(F.col("archived_reason"))
    return marked.withColumn("archived_reason", reason).drop("_stale"), log.unionByName(new)


def associated_files(calls: DataFrame, most: int = 8, last: int = 30) -> DataFrame:
    """C14: (session_id, files): what a session's last entries touched; only edited files where there are any.

    calls: (session_id, nth, tool, path). Entries count, not calls: those of the last `last` values of nth, or of
    all with 0. Junk paths are dropped; files come in the order of their first call, `most` of them.
    """
    end = F.max("nth").over(Window.partitionBy("session_id"))
    near = calls.withColumn("_end", end).filter((F.lit(last) == 0) | (F.col("nth") > F.col("_end") - last)).filter(F.col("path").isNotNull() & ~F.col("path").rlike(JUNK_PATH))
    edits = F.col("tool").isin("Edit", "Write", "MultiEdit")
    paths = near.groupBy("session_id", "path").agg(F.min("nth").alias("first"), F.min(F.when(edits, F.col("nth"))).alias("edited"))
    any_edit = F.count("edited").over(Window.partitionBy("session_id")) > 0
    kept = paths.withColumn("_any", any_edit).filter(~F.col("_any") | F.col("edited").isNotNull())
    order = Window.partitionBy("session_id").orderBy(F.coalesce(F.when(F.col("_any"), F.col("edited")), F.col("first")), "path")
    top = kept.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most)
    return top.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "path"))), lambda x: x["path"]).alias("files"))


def throttled(entries: DataFrame, message: str = "message_id", most: int = 5) -> DataFrame:
    """The first `most` entries of a message by the rank of their type, then in order."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, TYPE_ORDER)), F.col("type")), F.lit(0))
    order = Window.partitionBy(message).orderBy(F.when(rank == 0, len(TYPE_ORDER) + 1).otherwise(rank), "nth")
    return entries.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most).drop("_r")


def upsert_decision(content: Column, same_id: Column, same_content: Column, same_sim: Column, near_id: Column, near_content: Column, near_sim: Column, p: Params = DEFAULTS) -> Column:
    """Struct (action, target, annotates) of an entry, from the first live row of its type and topic and from the nearest row.

    With a row of the same type and topic: `variant` (a row of its own) where both have texts that differ and are less
    similar than `variant`, a missing similarity being 0; else the text takes that row's place (`overwrite`), or stays
    (`same`). Otherwise the nearest row: its text is replaced (`duplicate`) or the same; or the entry is inserted.
    annotates: the target is marked as superseded; so is a near row that the entry turns against.
    """
    none = F.lit(None).cast("boolean")
    told = lambda action, target, annotates: F.struct(F.lit(action).alias("action"), target.alias("target"), F.coalesce(annotates, F.lit(False)).alias("annotates"))
    full = F.coalesce(same_content, F.lit("")) != ""
    other = ~content.eqNullSafe(same_content)
    sim = F.coalesce(near_sim, F.lit(-1.0))
    against = (sim >= p.negation_floor) & F.coalesce(direction_mismatch(content, near_content), F.lit(False))
    return (
        F.when(~has_content(content), told("dropped", F.lit(None).cast("long"), none))
        .when(same_id.isNotNull() & full & other & (F.coalesce(same_sim, F.lit(0.0)) < p.variant), told("variant", same_id, direction_mismatch(content, same_content)))
        .when(same_id.isNotNull(), F.when(other, told("overwrite", same_id, full)).otherwise(told("same", same_id, none)))
        .when(sim >= p.dedup, F.when(content.eqNullSafe(near_content), told("same", near_id, none)).otherwise(told("duplicate", near_id, none)))
        .otherwise(F.when(against, told("insert", near_id, F.lit(True))).otherwise(told("insert", F.lit(None).cast("long"), none)))
    )


def insert_entries(stored: DataFrame, entries: DataFrame, near: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """What becomes of new entries (nth, message_id, type, topic, content), each by itself: (nth, action, target, annotates).

    stored: (id, type, topic, content); near: (nth, id, similarity) of each entry to stored ones, its nearest and
    those of its type and topic. Entries that the throttle drops have no row. For entries that see each other, see
    upsert_batch.
    """
    kept = throttled(entries)
    same = stored.groupBy("type", "topic").agg(F.min_by(F.struct("id", "content"), "id").alias("_same"))
    rows = kept.join(same, ["type", "topic"], "left").withColumn("same_id", F.col("_same.id"))
    pair = rows.join(near.withColumnsRenamed({"id": "same_id", "similarity": "same_sim"}), ["nth", "same_id"], "left")
    first = near.groupBy("nth").agg(F.max(F.struct("similarity", (-F.col("id")).alias("n"))).alias("x")).select("nth", F.col("x.similarity").alias("near_sim"), (-F.col("x.n")).alias("near_id"))
    texts = stored.select(F.col("id").alias("near_id"), F.col("content").alias("_old"))
    rows = pair.join(first, "nth", "left").join(texts, "near_id", "left")
    done = upsert_decision(F.col("content"), F.col("same_id"), F.col("_same.content"), F.col("same_sim"), F.col("near_id"), F.col("_old"), F.col("near_sim"), p)
    return rows.select("nth", done.alias("d")).select("nth", "d.*")


def upsert_batch(stored: DataFrame, entries: DataFrame, near: DataFrame, among: DataFrame, p: Params = DEFAULTS, most_rounds: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Entries (nth, message_id, type, topic, content) put into stored (id, type, topic, content) as if one after another.

    Gives (nth, action, target, annotates) of the entries that the throttle keeps, and the rows that are new or changed:
    id, type, topic, content, superseded (by what text, of 200 characters at most). A new row's id is the largest id of
    stored plus 1 plus nth, so ids rise with the entries. near: (nth, id, similarity) and among: (nth, other, similarity,
    both ways) have all pairs of `negation_floor` or more; other pairs are less similar than a variant, so they need not be known.

    Entries that share a type and topic, a similar pair or a stored row depend on each other, in their order. A round
    takes every entry that is the first left in all it shares; it reads stored rows as they are by then. So there are
    as many rounds as the longest chain of such entries; more than most_rounds are an error.
    """
    base = stored.agg(F.max("id")).first()[0] or 0
    kept = throttled(entries).select("nth", "type", "topic", "content")
    kept = written(kept.withColumn("_key", F.struct("type", "topic")), "entries")
    first = written(stored.join(kept.select("type", "topic").distinct(), ["type", "topic"], "left_semi").groupBy("type", "topic").agg(F.min_by(F.struct("id", "content"), "id").alias("_same")), "same-topic")
    near, among = written(near.select("nth", "id", "similarity"), "near"), written(among.select("nth", "other", "similarity").filter("nth <> other"), "among")
    texts = written(stored.select("id", "content").join(near.select("id").distinct(), "id", "left_semi"), "near-texts")
    share = lambda df, kind, *cols: df.select("nth", F.xxhash64(F.lit(kind), *cols).alias("shared"))
    rows_of = near.select("nth", "id").unionByName(kept.join(first, ["type", "topic"]).select("nth", F.col("_same.id").alias("id")))
    shared = share(kept, "key", "type", "topic").union(share(rows_of, "row", "id")).union(share(among, "pair", F.least("nth", "other"), F.greatest("nth", "other"))).union(share(kept, "own", "nth"))
    shared = written(shared.join(kept.select("nth"), "nth", "left_semi").distinct(), "shared")
    delta = written(stored.sparkSession.createDataFrame([], f"id long, type {stored.schema['type'].dataType.simpleString()}, topic {stored.schema['topic'].dataType.simpleString()}, content string, source long, superseded string"), "delta")
    told = None
    for _ in range(most_rounds):
        if shared.isEmpty():
            break
        least = shared.groupBy("shared").agg(F.min("nth").alias("least"))
        ready = shared.join(least, "shared").groupBy("nth").agg(F.bool_and(F.col("nth") == F.col("least")).alias("ready")).filter("ready").select("nth")
        now = written(kept.join(ready, "nth", "left_semi"), "ready")
        # The first row of the type and topic, as it is by now: a stored row may have changed, new rows have larger ids.
        held = delta.select("type", "topic", F.struct("id", "content", "source").alias("_x")).groupBy("type", "topic").agg(F.min_by("_x", "_x.id").alias("_x"))
        rows = now.join(first, ["type", "topic"], "left").join(held, ["type", "topic"], "left")
        old = F.col("_same.id").isNotNull() & (F.col("_x.id").isNull() | (F.col("_same.id") < F.col("_x.id")))
        rows = rows.withColumn("same_id", F.when(old, F.col("_same.id")).otherwise(F.col("_x.id"))).withColumn("same_content", F.when(old, F.col("_same.content")).otherwise(F.col("_x.content"))).withColumn("source", F.when(~old, F.col("_x.source")))
        rows = rows.join(near.select("nth", F.col("id").alias("same_id"), F.col("similarity").alias("_by_row")), ["nth", "same_id"], "left").join(among.select("nth", F.col("other").alias("source"), F.col("similarity").alias("_by_entry")), ["nth", "source"], "left")
        rows = rows.withColumn("same_sim", F.when(F.col("source").isNull(), F.col("_by_row")).otherwise(F.col("_by_entry")))
        # The nearest row: stored ones that are as they were, and changed or new ones by the entry whose text they have.
        as_was = near.join(now.select("nth"), "nth", "left_semi").join(delta.filter("source IS NOT NULL").select("id"), "id", "left_anti").join(texts, "id").select("nth", "id", "similarity", "content")
        changed = among.join(now.select("nth"), "nth", "left_semi").join(delta.select(F.col("source").alias("other"), "id", "content"), "other").select("nth", "id", "similarity", "content")
        best = as_was.unionByName(changed).groupBy("nth").agg(F.max(F.struct(F.round("similarity", 9).alias("s"), (-F.col("id")).alias("n"), "content")).alias("_b"))
        rows = rows.join(best, "nth", "left")
        done = upsert_decision(F.col("content"), F.col("same_id"), F.col("same_content"), F.col("same_sim"), -F.col("_b.n"), F.col("_b.content"), F.col("_b.s"), p)
        step = written(rows.select("nth", "type", "topic", "content", done.alias("d")).select("nth", "type", "topic", "content", "d.*"), "round")
        told = step.select("nth", "action", "target", "annotates") if told is None else told.unionByName(step.select("nth", "action", "target", "annotates"))
        # What it leaves: new rows, new texts of rows, and marks.
        new = step.filter("action IN ('variant', 'insert')").select((F.lit(base) + 1 + F.col("nth")).alias("id"), "type", "topic", "content", F.col("nth").alias("source"), F.lit(None).cast("string").alias("superseded"))
        marks = step.filter("annotates").select(F.col("target").alias("id"), F.substring("content", 1, 200).alias("_mark"))
        over = step.filter("action IN ('overwrite', 'duplicate')").select(F.col("target").alias("id"), F.col("content").alias("_text"), F.col("nth").alias("_nth"))
        met = over.join(marks, "id", "full").join(delta, "id", "full").join(stored.select("id", F.struct("type", "topic", "content").alias("_old")).join(step.select(F.col("target").alias("id")).distinct(), "id", "left_semi"), "id", "left")
        kind = lambda c: F.coalesce(F.col(c), F.col(f"_old.{c}")).alias(c)
        met = met.select("id", kind("type"), kind("topic"), F.coalesce("_text", "content", "_old.content").alias("content"), F.coalesce("_nth", "source").alias("source"), F.coalesce("_mark", "superseded").alias("superseded"))
        delta = written(met.unionByName(new), "delta")
        shared = written(shared.join(step.select("nth"), "nth", "left_anti"), "shared")
    else:
        raise RuntimeError(f"a chain of entries is longer than {most_rounds}")
    told = told if told is not None else stored.sparkSession.createDataFrame([], "nth long, action string, target long, annotates boolean")
    return told, delta.drop("source")


def served_most(records: DataFrame, served: DataFrame, offset: int, limit: int) -> DataFrame:
    """Records with how often their ids stand in served lists (ids: array), most served first, one page."""
    counts = served.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("served"))
    return records.join(counts, "id", "left").withColumn("served", F.coalesce("served", F.lit(0))).orderBy(F.desc("served"), "id").offset(offset).limit(limit)


def csv_union(a: Column, b: Column) -> Column:
    """Words of two comma lists in order, each once whatever its case; the first spelling stays."""
    words = F.filter(F.transform(F.split(F.concat_ws(",", a, b), ","), lambda x: F.trim(x)), lambda x: x != "")
    first = F.filter(F.transform(words, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda w: F.array_position(F.transform(words, F.lower), F.lower(w["x"])) == w["i"] + 1)
    return F.array_join(first["x"], ",")


def relative_bound(text: Column, as_of: Column) -> Column:
    """A date bound as a time: `today`, `yesterday`, `3d`, `2w`, `5h`, or a date or time; an unreadable one is an error."""
    n = F.regexp_extract(text, r"^(\d+)\s*([hdw])(?:ours?|ays?|eeks?)?(?: ago)?$", 1).try_cast("int")
    unit = F.regexp_extract(text, r"^(\d+)\s*([hdw])", 2)
    hours = n * F.when(unit == "h", 1).when(unit == "d", 24).otherwise(168)
    day = F.date_trunc("day", as_of)
    read = F.try_to_timestamp(text)
    bound = F.when(text == "today", day).when(text == "yesterday", day - F.expr("INTERVAL 1 DAY")).when(n.isNotNull(), F.timestamp_seconds(F.unix_timestamp(as_of) - hours * 3600)).when(read.isNotNull(), read)
    return F.when(text.isNull(), F.lit(None).cast("timestamp")).otherwise(F.coalesce(bound, F.raise_error(F.concat(F.lit("no date: "), text)).cast("timestamp")))


def search_terms(text: Column) -> Column:
    """A user's search as quoted words, so that operators and signs of a query language are words too."""
    words = F.filter(F.split(F.regexp_replace(text, r'["*():^]', " "), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " ")


def decayed(confidence: Column, source: Column, age_days: Column) -> Column:
    """Confidence halved once a half-life of its source."""
    half = F.lit(None).cast("double")
    for kind, days in HALF_LIVES.items():
        half = F.when(source == kind, days).otherwise(half)
    return F.when(half.isNotNull(), confidence * F.pow(F.lit(0.5), age_days / half)).otherwise(confidence)


def calibration_moves(rows: DataFrame, delivered: DataFrame, as_of: Column) -> DataFrame:
    """(id, n, rate, move, confidence) of rules by how often their deliveries were followed.

    rows: (id, source, confidence, updated_at); delivered: (id, session_id, followed). Archived from ten deliveries
    with a rate below 0.2; pinned at 0.95 from five with 0.8 over three sessions; others with rates of 0.4 to 0.6 or
    0.5 to 0.8 come up for review. What was never delivered decays by age.
    """
    sums = delivered.groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions"), (F.count_if(F.col("followed") == 1) / F.count("*")).alias("rate"))
    both = rows.join(sums, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    move = (
        F.when(F.col("n") == 0, "decay").when((F.col("n") >= 10) & (F.col("rate") < 0.2), "archive").when((F.col("n") >= 5) & (F.col("rate") >= 0.8) & (F.col("sessions") >= 3), "promote")
        .when(F.col("rate").between(0.4, 0.6), "review").when((F.col("rate") > 0.6) & (F.col("rate") < 0.8), "near").otherwise("keep")
    )
    age = (F.unix_timestamp(as_of) - F.unix_timestamp("updated_at")) / 86400.0
    confidence = F.when(move == "promote", 0.95).when(move == "decay", decayed(F.col("confidence"), F.col("source"), age)).otherwise(F.col("confidence"))
    return both.select("id", "n", "rate", move.alias("move"), confidence.alias("confidence"))


def dampened(counts: DataFrame, corroborated: DataFrame, most: int = 10) -> DataFrame:
    """(id, count, retired): delivery counters, back at 0 where a record was confirmed since."""
    joined = counts.join(corroborated.select("id", F.lit(True).alias("_again")).distinct(), "id", "left")
    n = F.when(F.col("_again"), 0).otherwise(F.col("count"))
    return joined.select("id", n.cast("long").alias("count"), (n >= most).alias("retired"))

"""Session chains and dependency graphs as joins and recursive queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import written
from .alike import alike, to_each

# Call targets that say nothing of a code base.
GENERIC_TARGETS = tuple(
    """execute get set len close print append join format split strip fetchone fetchall fetchmany str int float dict list tuple open
    write read items keys values encode decode commit sort sorted range enumerate isinstance getattr setattr hasattr super log add pop""".split()
)


def chain(sessions: DataFrame, start: DataFrame, up: bool = True, most: int = 100) -> DataFrame:
    """(start, session_id, depth) reached over parents (or children) from each start, one join a step.

    sessions: (session_id, parent_session_id). A path carries the sessions it met and ends where it would meet one
    again; `most` steps are taken at most. Each step's rows are written, so no limit on a recursion's rows holds.
    """
    a, b = ("session_id", "parent_session_id") if up else ("parent_session_id", "session_id")
    kind = start.schema["session_id"].dataType
    links = sessions.filter(F.col(b).isNotNull()).select(F.col(a).cast(kind).alias("session_id"), F.col(b).cast(kind).alias("_next"))
    now = written(start.select(F.col("session_id").alias("start"), "session_id", F.lit(0).cast("long").alias("depth"), F.array("session_id").alias("_met")), "chain")
    found = now
    for _ in range(most):
        onward = now.join(links, "session_id").filter(~F.array_contains("_met", F.col("_next")))
        now = written(onward.select("start", F.col("_next").alias("session_id"), (F.col("depth") + 1).alias("depth"), F.array_append("_met", F.col("_next")).alias("_met")), "chain")
        if now.isEmpty():
            break
        found = found.unionByName(now)
    return found.drop("_met")


def last_part(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def call_targets(calls: DataFrame, names: DataFrame) -> DataFrame:
    """Calls whose target is a name in full, its last part, or anything that ends in that part.

    The three ways are equi-keys: a target matches by itself or by its own last part.
    """
    forms = names.select("name", F.explode(F.array_distinct(F.array(F.col("name"), last_part(F.col("name"))))).alias("key"))
    keyed = calls.select("source", "target", F.explode(F.array_distinct(F.array(F.col("target"), last_part(F.col("target"))))).alias("key"))
    return keyed.join(forms, "key").filter((F.col("target") == F.col("name")) | (last_part(F.col("target")) == F.col("key"))).select("source", "target", "name").distinct()


def fan_in(edges: DataFrame, k: int) -> DataFrame:
    """The k targets with most distinct sources."""
    return edges.groupBy("target").agg(F.countDistinct("source").alias("sources"), F.count("*").alias("edges")).orderBy(F.desc("sources"), "target").limit(k)


def entry_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that nothing calls."""
    return nodes.join(edges.select(F.col("target").alias("name")).distinct(), "name", "left_anti")


def impact(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per node its callers, testing callers and their files."""
    callers = edges.join(nodes.select(F.col("name").alias("source"), "is_test", "file"), "source")
    sums = callers.groupBy(F.col("target").alias("name")).agg(F.countDistinct("source").alias("callers"), F.countDistinct(F.when(F.col("is_test"), F.col("source"))).alias("tests"), F.countDistinct("file").alias("files"))
    return nodes.select("name").join(sums, "name", "left").select("name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("callers", "tests", "files")])


def interfaces(imports: DataFrame, repos: DataFrame, least: int = 1) -> DataFrame:
    """Targets that name a known repository, with the number of repositories that use them."""
    local = imports.join(repos.select(F.col("repo").alias("target")), "target", "left_semi")
    return local.groupBy("target").agg(F.countDistinct("consumer").alias("consumers"), F.count("*").alias("uses")).filter(F.col("consumers") >= least)


def resolve(names: DataFrame, asked: DataFrame) -> DataFrame:
    """A symbol's exact name, or else all names that end in it."""
    exact = asked.join(names, asked["symbol"] == names["name"]).select("symbol", "name")
    rest = asked.join(exact.select("symbol"), "symbol", "left_anti")
    return exact.union(rest.join(names.withColumn("symbol", last_part(F.col("name"))), "symbol").select("symbol", "name"))


def joined_path(base: Column, path: Column) -> Column:
    """A relative path below the folder of a file, with `.` and `..` worked off; any other path as it is.

    A `..` with nothing above it stays.
    """
    parts = F.filter(F.split(F.concat_ws("/", F.regexp_replace(base, r"[^/]*$", ""), path), "/"), lambda x: ~x.isin("", "."))
    none = F.array().cast("array<string>")

    def step(done: Column, x: Column) -> Column:
        back = (x == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        return F.when(back, F.slice(done, 1, F.size(done) - 1)).otherwise(F.concat(done, F.array(x)))

    return F.when(path.startswith("."), F.array_join(F.aggregate(parts, none, step), "/")).otherwise(path)


def syntax_edges(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, symbols) of parsed files (path, imports: array<string>, classes: array<struct<name,line,bases>>, functions: array<struct<name,line>>).

    edges: (kind, source, target) of imports, relative ones resolved, and of classes to their bases; symbols: (name, kind, path, line).
    """
    imports = files.select("path", F.explode("imports").alias("i")).select(F.lit("import").alias("kind"), F.col("path").alias("source"), joined_path(F.col("path"), F.col("i")).alias("target"))
    classes = files.select("path", F.explode("classes").alias("c"))
    bases = classes.select(F.lit("inherits").alias("kind"), F.col("c.name").alias("source"), F.explode("c.bases").alias("target"))
    symbols = classes.select("c.name", F.lit("class").alias("kind"), "path", "c.line").unionByName(files.select("path", F.explode("functions").alias("f")).select("f.name", F.lit("function").alias("kind"), "path", "f.line"))
    return imports.unionByName(bases).distinct(), symbols


def neighbours(nodes: DataFrame, edges: DataFrame, asked: DataFrame, most: int = 20) -> DataFrame:
    """(symbol, relation, name, rank) of asked symbols: callers, callees and tests, by name, `most` of each."""
    name = F.col("name")
    callers = edges.join(asked.select(F.col("symbol").alias("target")), "target").select(F.col("target").alias("symbol"), F.col("source").alias("name"))
    callees = edges.join(asked.select(F.col("symbol").alias("source")), "source").select(F.col("source").alias("symbol"), F.col("target").alias("name"))
    tested = callers.join(nodes.filter("is_test").select("name"), "name", "left_semi")
    rows = None
    for relation, part in (("caller", callers), ("callee", callees), ("test", tested)):
        part = part.select("symbol", F.lit(relation).alias("relation"), "name")
        rows = part if rows is None else rows.unionByName(part)
    order = Window.partitionBy("symbol", "relation").orderBy(name)
    return rows.distinct().withColumn("rank", (F.row_number().over(order) - 1).cast("long")).filter(F.col("rank") < most)


def hubs(nodes: DataFrame, edges: DataFrame, k: int = 6) -> DataFrame:
    """The k most called project symbols that are neither tests nor generic names: (name, calls)."""
    short = F.substring_index("name", "::", -1)
    own = nodes.filter(~F.col("is_test") & ~short.isin(*GENERIC_TARGETS)).select("name")
    return edges.select(F.col("target").alias("name")).join(own, "name").groupBy("name").agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "name").limit(k)


def communities(members: DataFrame, k: int = 5, shown: int = 4) -> DataFrame:
    """The k largest communities (name, symbol) that tests don't dominate: (name, size, symbols)."""
    tests = F.count_if(F.col("symbol").startswith("test"))
    listed = F.array_sort(F.collect_set(F.when(~F.col("symbol").isin(*GENERIC_TARGETS), F.col("symbol"))))
    sums = members.filter(~F.col("name").rlike("^tests?-")).groupBy("name").agg(F.count("*").alias("size"), tests.alias("tests"), F.slice(listed, 1, shown).alias("symbols"))
    return sums.filter(F.col("tests") * 2 <= F.col("size")).orderBy(F.desc("size"), "name").limit(k).drop("tests")


def flows(snapshots: DataFrame, k: int = 5) -> DataFrame:
    """The k most critical flows (name, entry_point, criticality), by their entry's function and file."""
    whole = F.col("entry_point").contains("::")
    return snapshots.select("name", F.when(whole, F.substring_index("entry_point", "::", -1)).otherwise(F.col("name")).alias("entry"), F.when(whole, F.substring_index(F.substring_index("entry_point", "::", 1), "/", -1)).alias("file"), "criticality").orderBy(F.desc("criticality"), "name").limit(k)


def file_context(nodes: DataFrame, edges: DataFrame, risks: DataFrame, most: int = 12, risky: float = 0.55) -> DataFrame:
    """(file, nth, name, callers, callees, flags) of each file's first symbols, with what marks a risky one.

    nodes: (name, file, line, is_test); risks: (name, risk, security, coverage).
    """
    order = Window.partitionBy("file").orderBy("line", "name")
    first = nodes.filter(~F.col("is_test")).withColumn("nth", (F.row_number().over(order) - 1).cast("long")).filter(F.col("nth") < most)
    into = edges.groupBy(F.col("target").alias("name")).agg(F.count("*").alias("callers"))
    out = edges.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("callees"))
    rows = first.join(into, "name", "left").join(out, "name", "left").join(risks, "name", "left")
    high, secure = F.coalesce("risk", F.lit(0.0)) >= risky, F.coalesce("security", F.lit(0)) == 1
    marks = F.array(F.when(secure, "security-relevant"), F.when(high, "high-risk"), F.when((high | secure) & (F.col("coverage") == "untested"), "untested"))
    return rows.select("file", "nth", "name", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("callees", F.lit(0)).alias("callees"), F.array_join(F.filter(marks, lambda x: x.isNotNull()), ",").alias("flags"))


def knowledge(records: DataFrame, found: DataFrame, symbols: DataFrame, most: int = 5) -> DataFrame:
    """(symbol, id, source): records that name a symbol's file, then the text search's first ones that they lack.

    records: (id, files); found: (symbol, id, rank) of the text search; symbols: (symbol, file). Symbols of the same
    file get its records without a join of their own.
    """
    named = records.select("id", F.explode(F.array_distinct("files")).alias("file"))
    everyone = alike(symbols, "symbol", F.col("file"))
    of_files = everyone.select("key").distinct().select("key", F.explode("key").alias("file")).join(named, "file").select("key", "id").distinct()
    by_file = to_each(of_files, everyone, "key").select("symbol", "id", F.lit("file").alias("source"))
    by_text = found.filter(F.col("rank") < most).select("symbol", "id", F.lit("text").alias("source"))
    known = by_text.join(symbols.select("symbol", "file"), "symbol").join(named, ["id", "file"], "left_semi").select("symbol", "id").distinct()
    return by_file.unionByName(by_text.join(known, ["symbol", "id"], "left_anti"))

"""What an assistant's messages carry: record blocks, link definitions, marks, deliveries, findings.

Messages are rows (id, text); each operator returns one row an entry, mark or delivery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_block(text: Column) -> Column:
    """The last closed block of a message, or else what follows an unclosed tag; null without one."""
    closed = F.regexp_extract_all(text, F.lit(r"(?s)<memory>(.*?)</memory>"), F.lit(1))
    open_ = F.regexp_extract(text, r"(?s)<memory>(.*)$", 1)
    return F.when(F.size(closed) > 0, F.trim(F.element_at(closed, -1))).when(text.contains("<memory>"), F.trim(open_))


def is_compact(block: Column) -> Column:
    """Whether a block is of the short form: an entry `type/topic:`, a leading dot, a hash or a control line."""
    return block.rlike(r"(?m)^\w+/[^:]+:") | block.startswith(".") | block.rlike(r"(?m)^h:[0-9A-Fa-f]+$") | block.rlike(r"(?m)^[+-] c([? ]|$)")


def block_lines(rows: DataFrame) -> DataFrame:
    """(id, compact, n, line) of each message's last block; lines are trimmed and blank ones left out."""
    held = rows.select("id", last_block(F.col("text")).alias("block")).filter("block IS NOT NULL")
    cut = held.select("id", is_compact(F.col("block")).alias("compact"), F.posexplode(F.split("block", "\n")).alias("n", "line"))
    return cut.withColumn("line", F.trim(F.translate("line", "\t\r", "  "))).filter("line <> ''")


def csv(text: Column) -> Column:
    """The trimmed parts between commas that are not empty."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda k: k != "")


def compact_entries(rows: DataFrame) -> DataFrame:
    """(id, n, type, topic, content, keywords, trigger) of short blocks: `type/topic: content [k: a, b] [t: when]`."""
    entry = r"^(\w+)/([^:]+):\s*(.+)$"
    part = lambda i: F.trim(F.regexp_extract("line", entry, i))
    lines = block_lines(rows).filter(F.col("compact") & ~F.col("line").startswith(".") & F.col("line").rlike(entry))
    said = part(3)
    bare = F.trim(F.regexp_replace(F.regexp_replace(said, r"\s*\[k:[^\]]+\]", ""), r"\s*\[t:[^\]]+\]", ""))
    words, trigger = F.regexp_extract(said, r"\[k:\s*([^\]]+)\]", 1), F.trim(F.regexp_extract(said, r"\[t:\s*([^\]]+)\]", 1))
    return lines.select("id", "n", part(1).alias("type"), part(2).alias("topic"), bare.alias("content"), csv(words).alias("keywords"), F.when(trigger != "", trigger).alias("trigger"))


def compact_flags(rows: DataFrame) -> DataFrame:
    """(id, complete, remaining, context, context_need, hash) of short blocks; the last line that says so counts.

    A block is complete and its context sufficient unless a line says otherwise.
    """
    line = F.col("line")
    control = line.rlike(r"^[+-]\s") & ~line.rlike(r"^-\s*:")
    rest = F.trim(F.regexp_extract(line, r"^-\s*:\s*(.+)$", 1))
    complete = F.when(rest != "", False).when(control, line.startswith("+"))
    asked = F.when(control & line.contains("c?"), F.trim(F.regexp_extract(line, r"c\?:(\S.*?)(?=\s+h:|\s*$)", 1))).when(line.startswith("c?:"), F.trim(F.substring(line, 4, 1 << 20)))
    lone = line.rlike(r"^h:[0-9A-Fa-f]+$") | control | line.startswith(".")
    digits = F.when(lone, F.regexp_extract(line, r"h:([0-9A-Fa-f]+)", 1))
    lines = block_lines(rows).filter("compact").select("id", "n", complete.alias("complete"), F.when(rest != "", rest).alias("rest"), asked.alias("asked"), F.when(digits != "", F.conv(digits, 16, 10).cast("long")).alias("h"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("n")))
    need = last("asked")
    return lines.groupBy("id").agg(
        F.coalesce(last("complete"), F.lit(True)).alias("complete"), last("rest").alias("remaining"), F.when(F.count("asked") > 0, "insufficient").otherwise("sufficient").alias("context"), F.when(need != "", need).alias("context_need"), last("h").alias("hash")
    )


def verbose_entries(rows: DataFrame) -> DataFrame:
    """(id, nth, type, topic, content, keywords) of long blocks of `key: value` lines.

    A line `type` ends an entry that has type, topic and content; an entry without content at the block's end has
    its topic for it. What an entry holds depends on the lines before, so a block's lines are folded in order.
    Keywords of the block belong to all its entries.
    """
    pair = r"^-?\s*(\w+):\s*(.+)$"
    lines = block_lines(rows).filter(~F.col("compact")).select("id", "n", F.regexp_extract("line", pair, 1).alias("key"), F.trim(F.regexp_extract("line", pair, 2)).alias("value")).filter("key <> ''")
    kinds = "struct<type:string,topic:string,content:string>"
    blank = F.struct(*[F.lit(None).cast("string").alias(k) for k in ("type", "topic", "content")])
    start = F.struct(blank.alias("now"), F.array().cast(f"array<{kinds}>").alias("done"))

    def step(acc: Column, x: Column) -> Column:
        now = acc["now"]
        ends = (x["key"] == "type") & now["type"].isNotNull() & now["topic"].isNotNull() & now["content"].isNotNull()
        kept = F.when(ends, blank).otherwise(now)
        new = F.struct(*[F.when(x["key"] == k, x["value"]).otherwise(kept[k]).alias(k) for k in ("type", "topic", "content")])
        return F.struct(new.alias("now"), F.when(ends, F.concat(acc["done"], F.array(now))).otherwise(acc["done"]).alias("done"))

    def close(acc: Column) -> Column:
        now = acc["now"]
        last = F.struct(now["type"].alias("type"), now["topic"].alias("topic"), F.coalesce(now["content"], now["topic"]).alias("content"))
        return F.when(now["type"].isNotNull() & now["topic"].isNotNull(), F.concat(acc["done"], F.array(last))).otherwise(acc["done"])

    item = F.when(F.col("key").isin("type", "topic", "content"), F.struct("n", "key", "value"))
    words = F.max_by(F.when(F.col("key") == "keywords", F.col("value")), F.when(F.col("key") == "keywords", F.col("n")))
    blocks = lines.groupBy("id").agg(F.array_sort(F.collect_list(item)).alias("all"), words.alias("words"))
    return blocks.select("id", csv(F.coalesce("words", F.lit(""))).alias("keywords"), F.posexplode(F.aggregate("all", start, step, close)).alias("nth", "x")).select("id", "nth", "x.type", "x.topic", "x.content", "keywords")


def linkdef(text: Column, label: str = "cm") -> Column:
    """The JSON of a message's last link definition with a label, its lines joined; null without one."""
    last = F.regexp_extract(text, rf"(?s)(?:.*\n|^)(\[{label}\]:.*)$", 1)
    line, all_ = F.regexp_extract(last, r"^\[[a-z-]+\]:\s*#\s*'(.+)'\s*(?:\n|$)", 1), F.regexp_extract(last, r"(?s)^\[[a-z-]+\]:\s*#\s*'(.+)'\s*$", 1)
    return F.when(line != "", line).when(all_ != "", F.regexp_replace(all_, r"\s*\n\s*", " "))


def mended(raw: Column) -> Column:
    """JSON text with the two slips of long strings repaired: quotes inside a string and lone backslashes."""
    slashes = F.regexp_replace(raw, r'\\(?!["\\/bfnrtu])', r"\\\\")
    return F.regexp_replace(slashes, r'(?<![\[{,:\\]\s{0,4})(?<!^)"(?!\s*[,:}\]])', r'\\"')


_ENTRY = "t string, type string, to string, topic string, c string, content string, kw string, keywords string, f string, facts string, tr string, trigger string"
_BLOCK = f"e array<struct<{_ENTRY.replace(' string', ':string')}>>, entries array<struct<{_ENTRY.replace(' string', ':string')}>>, ok string, complete string, ctx string, context string, kw string, keywords string, cu array<string>, rg array<string>"


def words_of(value: Column) -> Column:
    """A JSON list of strings, or a string of words between commas."""
    return F.when(value.startswith("["), F.filter(F.transform(F.from_json(value, "array<string>"), lambda x: F.trim(x)), lambda k: k != "")).otherwise(csv(value))


def linkdef_entries(rows: DataFrame) -> DataFrame:
    """(id, n, type, topic, content, keywords, facts, complete, context, recovery) of link definitions, short or long keys.

    recovery is `salvage` where the JSON had to be repaired; a block beyond repair has no entries. An entry needs
    a type and a topic, which is its content where it has none; keywords of the block are those of entries without.
    """
    found = rows.select("id", linkdef(F.col("text")).alias("raw")).filter("raw IS NOT NULL")
    strict, loose = (F.from_json(c, _BLOCK, {"mode": "PERMISSIVE"}) for c in (F.col("raw"), mended(F.col("raw"))))
    good = lambda j: F.coalesce(j["e"], j["entries"]).isNotNull() | F.coalesce(j["ok"], j["complete"], j["kw"], j["ctx"]).isNotNull()
    read = found.select("id", F.when(good(strict), strict).otherwise(loose).alias("j"), F.when(~good(strict), "salvage").alias("recovery")).filter(good(F.col("j")))
    each = read.select("id", "j", "recovery", F.posexplode(F.coalesce("j.e", "j.entries")).alias("n", "x"))
    said = lambda a, b: F.nullif(F.coalesce(F.col(f"x.{a}"), F.col(f"x.{b}")), F.lit(""))
    context = F.lower(F.coalesce("j.ctx", "j.context", F.lit("sufficient")))
    none = F.array().cast("array<string>")
    return each.filter(said("t", "type").isNotNull() & said("to", "topic").isNotNull()).select(
        "id", "n", said("t", "type").alias("type"), said("to", "topic").alias("topic"), F.coalesce("x.c", "x.content", said("to", "topic")).alias("content"),
        F.coalesce(words_of(F.coalesce("x.kw", "x.keywords")), words_of(F.coalesce("j.kw", "j.keywords")), none).alias("keywords"), F.coalesce(facts(F.coalesce("x.f", "x.facts")), none).alias("facts"),
        (F.lower(F.coalesce("j.ok", "j.complete", F.lit("true"))) == "true").alias("complete"), F.when(context == "s", "sufficient").when(context == "i", "insufficient").otherwise(context).alias("context"), "recovery",
    )


def facts(value: Column) -> Column:
    """Facts as a JSON list, or as lines with optional bullets."""
    lines = F.transform(F.split(value, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*[-*]\s+", "")))
    return F.filter(F.when(value.startswith("["), F.transform(F.from_json(value, "array<string>"), lambda x: F.trim(x))).otherwise(lines), lambda x: x != "")


def confidence_marks(rows: DataFrame, marks: str = "marks") -> DataFrame:
    """(id, record, direction, reason) of marks such as `42:+` or `17:-! reason`."""
    pattern = r"^(\d+)\s*:\s*(-!|[+-])\s*(.*)?$"
    part = lambda i: F.regexp_extract("mark", pattern, i)
    reason = F.trim(part(3))
    return rows.select("id", F.explode(marks).alias("mark")).filter(F.col("mark").rlike(pattern)).select("id", part(1).cast("long").alias("record"), part(2).alias("direction"), F.when(reason != "", reason).alias("reason"))


def fit_pairs(rows: DataFrame) -> DataFrame:
    """(id, winner, loser): every best record of a message against every worst one. rows: (id, best, worst), arrays of ids."""
    return rows.select("id", "worst", F.explode(F.array_distinct("best")).alias("winner")).select("id", "winner", F.explode(F.array_distinct("worst")).alias("loser")).filter("winner <> loser")


def transcript_text(turns: DataFrame, key: str = "session_id", order: str = "idx") -> DataFrame:
    """(key, text) of sessions' turns in order, each after its role."""
    line = F.concat(F.upper(F.substring("role", 1, 1)), F.substring("role", 2, 1 << 20), F.lit(": "), F.col("text"))
    listed = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))).alias("all"))
    return listed.select(key, F.array_join("all.line", "\n\n").alias("text"))


def delivered(lines: DataFrame, known: DataFrame, since: str = "") -> DataFrame:
    """(uuid, session_id, at, ids) of raw transcript lines that show records, by the entries' ids in order.

    lines: (session_id, line) of JSON; a line needs a uuid and a time from `since` on, as text. known: (uuid) stored
    before. Repeats inside one run stay.
    """
    get = lambda k: F.get_json_object("line", f"$.{k}")
    ids = F.array_distinct(F.transform(F.regexp_extract_all("line", F.lit(r'<entry id=\\?"(\d+)'), F.lit(1)), lambda x: x.cast("long")))
    rows = lines.select(get("uuid").alias("uuid"), "session_id", get("timestamp").alias("at"), ids.alias("ids"))
    return rows.filter((F.size("ids") > 0) & F.col("uuid").isNotNull() & (F.coalesce("at", F.lit("")) >= since)).join(known.select("uuid"), "uuid", "left_anti")


def mined_outcomes(blocks: DataFrame) -> DataFrame:
    """(session_id, blocks, entries, outcome): what contexts a session was shown, and its commonest outcome.

    blocks: (session_id, text, outcome). The lesser of outcomes that are as common counts.
    """
    ids = F.regexp_extract_all("text", F.lit(r'<entry id="(\d+)"'), F.lit(1))
    shown = blocks.groupBy("session_id").agg(F.count_if(F.size(ids) > 0).alias("blocks"), F.sum(F.size(ids)).alias("entries"))
    votes = blocks.filter("outcome IS NOT NULL").groupBy("session_id", "outcome").agg(F.count("*").alias("n"))
    first = Window.partitionBy("session_id").orderBy(F.desc("n"), "outcome")
    usual = votes.withColumn("r", F.row_number().over(first)).filter("r = 1").select("session_id", "outcome")
    return shown.join(usual, "session_id", "left")


def finding_rows(findings: DataFrame, root: Column, batch: int = 5) -> DataFrame:
    """(id, files, facts, keywords, batch) of review findings (id, path, line, severity, rule, message)."""
    bare = F.regexp_replace("path", r"^\./", "")
    files = F.array_distinct(F.array(F.concat_ws("/", root, bare), bare))
    said = F.filter(F.array(F.concat(F.lit("severity: "), F.col("severity")), F.concat(F.lit("line: "), F.col("line").cast("string")), F.concat(F.lit("rule: "), F.col("rule"))), lambda x: x.isNotNull())
    words = F.array_distinct(F.filter(F.flatten(F.array(F.split(F.lower("rule"), r"[^a-z0-9]+"), F.array(F.lower("severity"), F.element_at(F.split(bare, "/"), -1)))), lambda x: F.length(x) > 2))
    nth = F.row_number().over(Window.partitionBy("path").orderBy("id")) - 1
    return findings.select("id", files.alias("files"), said.alias("facts"), words.alias("keywords"), F.floor(nth / batch).alias("batch"))

"""Queries over what messages and files carry, each with the SQL that an oracle runs.

The driver's tables hold no record blocks, so messages are written around the whole texts of conversations; the
oracle states what each of them must give back, without parsing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import capture, repository
from .inputs import table

QUERIES, ORACLE = {}, {}


def query(sql: str, *lists: str):
    """lists: array columns, which both sides give as text."""

    def add(f):
        def run(spark: SparkSession, d: str) -> DataFrame:
            rows = f(spark, d)
            return rows.withColumns({c: F.array_join(F.col(c).cast("array<string>"), "|") for c in lists}) if lists else rows

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        ORACLE[f.__name__] = f"SELECT * REPLACE ({', '.join(f"array_to_string({c}, '|') AS {c}" for c in lists)}) FROM ({sql})" if lists else sql
        return f

    return add


TURNS = "turns AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, role, text, trim(regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g')) AS body FROM conversations)"


def _turns(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations")
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", "role", "text", F.trim(F.regexp_replace("text", "[^A-Za-z0-9 ]", "")).alias("body"))


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query(f"WITH {TURNS} SELECT id, CASE WHEN turn % 2 = 0 THEN 'fact' ELSE 'correction' END AS type, 'topic ' || turn AS topic, body AS content, ['a' || conv_id, 'b c'] AS keywords, CASE WHEN turn % 2 = 1 THEN 'when ' || turn END AS trigger FROM turns UNION ALL SELECT id, 'skill', 'x', 'y', []::VARCHAR[], NULL FROM turns WHERE turn % 3 = 0", "keywords")
def compact_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Record blocks of the short form: only the last block of a message counts, and an unclosed one too."""
    c, n = F.col("conv_id"), F.col("turn")
    entry = _text(F.when(n % 2 == 0, "fact").otherwise("correction"), "/topic ", n, ": ", F.col("body"), " [k: a", c, ",  b c, ]", F.when(n % 2 == 1, _text(" [t: when ", n, "]")).otherwise(""), "\n")
    more = F.when(n % 3 == 0, "skill/x: y\nnot an entry\n").otherwise("")
    text = _text("said\n<memory>\nfact/old: gone\n</memory> and then <memory>\n", entry, more, "+ c h:2A\n", F.when(n % 4 == 3, "").otherwise("</memory> end"))
    rows = _turns(spark, d).withColumn("text", F.when(n % 4 == 3, _text("<memory>\n", entry, more)).otherwise(text))
    return capture.compact_entries(rows).drop("n")


@query(f"""WITH {TURNS} SELECT id, turn % 5 <> 1 AS complete, CASE WHEN turn % 5 = 1 THEN 'still ' || body END AS remaining, CASE WHEN turn % 5 IN (2, 3) THEN 'insufficient' ELSE 'sufficient' END AS context,
    CASE turn % 5 WHEN 2 THEN 'what of ' || conv_id WHEN 3 THEN 'more' END AS context_need, CASE turn % 5 WHEN 0 THEN 42 WHEN 2 THEN 255 WHEN 4 THEN 16 END AS hash FROM turns""")
def compact_flags(spark: SparkSession, d: str) -> DataFrame:
    """Control lines of short blocks: completeness, what is missing, and the hash."""
    lines = F.element_at(F.array(F.lit("+ c h:2A"), _text("- c\n- :still ", F.col("body")), _text("+ c?:what of ", F.col("conv_id"), " h:ff"), F.lit("c?: more"), F.lit(". h:10")), (F.col("turn") % 5 + 1).cast("int"))
    return capture.compact_flags(_turns(spark, d).withColumn("text", _text("<memory>\nfact/a: b\n", lines, "\n</memory>")))


@query(f"WITH {TURNS} SELECT id, 0 AS nth, 'fact' AS type, 't ' || turn AS topic, 'c ' || body AS content, ['a', 'k' || conv_id] AS keywords FROM turns UNION ALL SELECT id, 1, 'decision', 'u', 'u', ['a', 'k' || conv_id] FROM turns WHERE turn % 2 = 0", "keywords")
def verbose_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Record blocks of the long form; an entry that ends without content has its topic for it."""
    second = F.when(F.col("turn") % 2 == 0, "type: decision\n- topic: u\n").otherwise("")
    text = _text("<memory>\n- type: fact\n- topic: t ", F.col("turn"), "\n- content: c ", F.rtrim("body"), "\n", second, "- keywords: a, k", F.col("conv_id"), "\n- complete: true\n</memory>")
    return capture.verbose_entries(_turns(spark, d).withColumn("text", text).withColumn("body", F.col("body")))


@query(f"""WITH {TURNS} SELECT id, 0 AS n, 'fact' AS type, 'topic ' || turn AS topic, CASE turn % 4 WHEN 0 THEN body WHEN 1 THEN 'it''s ' || body WHEN 2 THEN 'said "' || conv_id || '" and \\d' ELSE 'topic ' || turn END AS content, CASE turn % 4 WHEN 1 THEN ['x', 'y'] ELSE ['all'] END AS keywords,
    CASE turn % 4 WHEN 0 THEN ['one', 'two'] ELSE [] END AS facts, turn % 4 <> 1 AS complete, CASE turn % 4 WHEN 1 THEN 'insufficient' ELSE 'sufficient' END AS context, CASE turn % 4 WHEN 2 THEN 'salvage' END AS recovery FROM turns""", "keywords", "facts")
def linkdef_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Link definitions with short and long keys, over two lines, and with slips that are repaired; the last one counts."""
    n = F.col("turn")
    short = _text('{"e":[{"t":"fact","to":"topic ', n, '","c":"', F.col("body"), '","f":["one"," two"]}],"ok":true,\n "ctx":"s","kw":["all"]}')
    long = _text('{"entries":[{"type":"fact","topic":"topic ', n, '","content":"it\'s ', F.col("body"), '","keywords":"x, y"},{"topic":"no type"}],"complete":"False","context":"i","kw":["all"]}')
    broken = _text('{"e":[{"t":"fact","to":"topic ', n, '","c":"said "', F.col("conv_id"), '" and \\d"}],"ok":true,"kw":["all"]}')
    bare = _text('{"e":[{"t":"fact","to":"topic ', n, '"}],"kw":"all, "}')
    raw = F.element_at(F.array(short, long, broken, bare), (n % 4 + 1).cast("int"))
    text = _text('first\n[cm]: # \'{"e":[{"t":"fact","to":"old","c":"gone"}]}\'\nthen\n[cm]: # \'', raw, "'")
    return capture.linkdef_entries(_turns(spark, d).withColumn("text", text))


@query(f"WITH {TURNS} SELECT DISTINCT id, winner, loser FROM (SELECT id, unnest([turn, conv_id % 7]) AS winner, [turn + 1, conv_id % 5] AS l FROM turns), LATERAL (SELECT unnest(l) AS loser) WHERE winner <> loser")
def fit_grammar(spark: SparkSession, d: str) -> DataFrame:
    """Best records against worst ones."""
    c, n = F.col("conv_id"), F.col("turn")
    return capture.fit_pairs(_turns(spark, d).select("id", F.array(n, c % 7).alias("best"), F.array(n + 1, c % 5).alias("worst")))


@query(f"WITH {TURNS} SELECT id, conv_id AS record, '+' AS direction, NULL AS reason FROM turns UNION ALL SELECT id, turn, '-!', 'because ' || body FROM turns UNION ALL SELECT id, turn, '-', NULL FROM turns WHERE turn % 2 = 0")
def confidence_marks(spark: SparkSession, d: str) -> DataFrame:
    """Marks that move a record's confidence; unreadable ones are left out."""
    c, n = F.col("conv_id"), F.col("turn")
    marks = F.array(_text(c, ":+"), _text(n, ":-! because ", F.col("body")), F.when(n % 2 == 0, _text(n, " : - ")).otherwise("x:+"))
    return capture.confidence_marks(_turns(spark, d).select("id", marks.alias("marks")))


@query(f"WITH {TURNS} SELECT id, CASE WHEN turn % 2 = 0 THEN ['a ' || conv_id, 'b'] ELSE list_filter(['first', trim('x ' || body)], lambda x: x <> '') END AS facts FROM turns", "facts")
def facts_lines(spark: SparkSession, d: str) -> DataFrame:
    """Facts as a list or as lines."""
    value = F.when(F.col("turn") % 2 == 0, _text('["a ', F.col("conv_id"), '", " b", ""]')).otherwise(_text("- first\n\n * x ", F.col("body")))
    return _turns(spark, d).select("id", capture.facts(value).alias("facts"))


@query("SELECT conv_id, sha256(string_agg(upper(role[1:1]) || role[2:] || ': ' || text, chr(10) || chr(10) ORDER BY turn)) AS mark FROM conversations GROUP BY 1")
def transcript_text(spark: SparkSession, d: str) -> DataFrame:
    """A conversation as one text."""
    t = table(spark, d, "conversations")
    return capture.transcript_text(t, "conv_id", "turn").select("conv_id", F.sha2("text", 256).alias("mark"))


@query(f"WITH {TURNS} SELECT 'u' || id AS uuid, conv_id AS session_id, '2024-01-' || lpad((turn % 28 + 1)::VARCHAR, 2, '0') AS at, list_sort(list_distinct([conv_id, turn])) AS ids FROM turns WHERE turn % 3 <> 0 AND id % 5 <> 0 AND turn % 28 + 1 >= 3", "ids")
def recovered_deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Which records raw transcript lines show, from a day on, without what is known."""
    c, n = F.col("conv_id"), F.col("turn")
    said = F.when(n % 3 != 0, _text(F.col("text"), '<entry id="', c, '">a</entry><entry id="', n, '">b</entry><entry id="', c, '">')).otherwise(F.col("text"))
    at = _text("2024-01-", F.lpad((n % 28 + 1).cast("string"), 2, "0"))
    rows = _turns(spark, d).select(c.alias("session_id"), F.to_json(F.struct(_text("u", F.col("id")).alias("uuid"), at.alias("timestamp"), F.struct(said.alias("content")).alias("message"))).alias("line"), "id")
    known = rows.filter("id % 5 = 0").select(_text("u", F.col("id")).alias("uuid"))
    return capture.delivered(rows, known, "2024-01-03").withColumn("ids", F.array_sort("ids"))


@query("""WITH b AS (SELECT conv_id, turn % 2 = 0 AS shown, CASE turn % 4 WHEN 0 THEN 'useful' WHEN 1 THEN 'neutral' WHEN 2 THEN 'useful' END AS outcome FROM conversations), c AS (SELECT conv_id, outcome, count(*) AS n FROM b WHERE outcome IS NOT NULL GROUP BY ALL), v AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, outcome) AS r FROM c)
    SELECT b.conv_id AS session_id, count(*) FILTER (shown) AS blocks, (2 * count(*) FILTER (shown))::BIGINT AS entries, any_value(v.outcome) AS outcome FROM b LEFT JOIN v ON v.conv_id = b.conv_id AND v.r = 1 GROUP BY 1""")
def mined_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Contexts shown to a session and its usual outcome."""
    n = F.col("turn")
    text = F.when(n % 2 == 0, _text("<entry id=\"1\">", F.col("text"), '<entry id="2">')).otherwise(F.col("text"))
    outcome = F.when(n % 4 == 0, "useful").when(n % 4 == 1, "neutral").when(n % 4 == 2, "useful")
    return capture.mined_outcomes(_turns(spark, d).select(F.col("conv_id").alias("session_id"), text.alias("text"), outcome.alias("outcome")))


@query("""WITH p AS (SELECT page_id AS id, 'src/' || (page_id % 40) || '/f.py' AS path, CASE WHEN page_id % 3 <> 0 THEN page_id % 90 END AS line, ['high', 'low'][page_id % 2 + 1] AS severity, 'no-' || ['eval', 'io'][page_id % 2 + 1] AS rule FROM pages)
    SELECT id, ['/repo/' || path, path] AS files, list_filter(['severity: ' || severity, 'line: ' || line, 'rule: ' || rule], lambda x: x IS NOT NULL) AS facts, list_filter([split_part(rule, '-', 2), severity, 'f.py'], lambda x: length(x) > 2) AS keywords, (row_number() OVER (PARTITION BY path ORDER BY id) - 1) // 5 AS batch FROM p""", "files", "facts", "keywords")
def review_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings as rows to store, in batches of five a file."""
    i = F.col("page_id")
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (i % len(x) + 1).cast("int"))
    rows = table(spark, d, "pages").select(i.alias("id"), _text("./src/", i % 40, "/f.py").alias("path"), F.when(i % 3 != 0, i % 90).alias("line"), pick("high", "low").alias("severity"), _text("no-", pick("eval", "io")).alias("rule"), F.col("url").alias("message"))
    done = capture.finding_rows(rows, F.lit("/repo"))
    return done.withColumn("files", F.transform("files", lambda x: F.regexp_replace(x, "/\\./", "/")))


FILES = """files AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'README.md' WHEN 1 THEN 'docs/a' || doc_id || '.md' WHEN 2 THEN 'src/b' || doc_id || '.py' WHEN 3 THEN 'pkg/' || doc_id || '/package.json' WHEN 4 THEN 'a/b/c/d/e' || doc_id || '.h' ELSE 'conf/x' || doc_id || '.yaml' END AS path, text, regexp_split_to_array(text, '\\n') AS ls FROM documents)"""


def _files(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    path = F.element_at(F.array(F.lit("README.md"), _text("docs/a", i, ".md"), _text("src/b", i, ".py"), _text("pkg/", i, "/package.json"), _text("a/b/c/d/e", i, ".h"), _text("conf/x", i, ".yaml")), (i % 6 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", path.alias("path"), "text")


@query(f"WITH {FILES} SELECT CASE doc_id % 6 WHEN 5 THEN 'config' ELSE 'docs' END AS section, path, sha256(text) AS mark FROM files WHERE doc_id % 6 IN (0, 1, 5)")
def whole_sections(spark: SparkSession, d: str) -> DataFrame:
    """Files that are sections as a whole, by their names."""
    rows = repository.whole_sections(_files(spark, d).withColumnRenamed("text", "content"))
    return rows.select("section", "path", F.sha2("content", 256).alias("mark"))


@query(f"WITH {FILES} SELECT path, size FROM (SELECT path, length(text)::BIGINT AS size, len(string_split(path, '/')) AS deep FROM files) WHERE deep <= 4")
def file_tree(spark: SparkSession, d: str) -> DataFrame:
    """Paths above a depth, in folders that count."""
    files = _files(spark, d).withColumnRenamed("text", "content")
    return repository.tree(files).select("path", F.length("content").cast("long").alias("size"))


@query(f"WITH {FILES} SELECT path, unnest(['dep' || doc_id, 'left']) AS name, unnest(['^1.' || doc_id, '*']) AS version, unnest(['runtime', 'development']) AS scope FROM files WHERE doc_id % 6 = 3")
def manifests(spark: SparkSession, d: str) -> DataFrame:
    """Dependencies of package manifests."""
    i = F.col("doc_id")
    body = _text('{"name":"x","dependencies":{"dep', i, '":"^1.', i, '"},"devDependencies":{"left":"*"}}')
    return repository.dependencies(_files(spark, d).select("path", body.alias("content")))


@query(f"""WITH {FILES}, l AS (SELECT path, doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS n FROM files WHERE doc_id % 6 IN (2, 4)), t AS (SELECT path, n, CASE WHEN n % 3 = 0 THEN '# always ' WHEN n % 3 = 1 THEN '// TODO ' ELSE '' END AS head, regexp_replace(line, '[^A-Za-z ]', '', 'g') AS body FROM l)
    SELECT 'comments' AS section, path, n AS line, sha256(trim(head || body)) AS mark FROM t WHERE head = '# always ' AND length(trim(head || body)) >= 15
    UNION ALL SELECT 'todos', path, n, sha256(trim(head || body)) FROM t WHERE head = '// TODO '""")
def source_notes(spark: SparkSession, d: str) -> DataFrame:
    """S10e: comments that say why, and marks of work to do, line by line."""
    ls = F.split("text", "\n")
    head = lambda n: F.when(n % 3 == 2, "# always ").when(n % 3 == 0, "// TODO ").otherwise("")
    plain = F.array_join(F.transform(ls, lambda x, n: F.concat(head(n), F.when(head(n) == "", "").otherwise(F.regexp_replace(x, "[^A-Za-z ]", "")))), "\n")
    done = repository.line_notes(_files(spark, d).select("path", plain.alias("content")))
    return done.select("section", "path", F.col("line").cast("long").alias("line"), F.sha2("text", 256).alias("mark"))


@query(f"WITH {FILES} SELECT 'ros' AS section, path, 'std_msgs/Topic' || doc_id AS unit FROM files WHERE doc_id % 6 = 2 UNION ALL SELECT 'docker', path, 'base' || doc_id FROM files WHERE doc_id % 6 = 2 UNION ALL SELECT 'can', path, 'MSG_' || doc_id FROM files WHERE doc_id % 6 = 2")
def domain_units(spark: SparkSession, d: str) -> DataFrame:
    """S10h: units of files of some trades."""
    i = F.col("doc_id")
    kinds = F.array(F.struct(_text("x", i, ".msg").alias("path"), _text("std_msgs/Topic", i, " data").alias("content")), F.struct(F.lit("Dockerfile").alias("path"), _text("FROM base", i, "\nRUN x").alias("content")), F.struct(_text("x", i, ".dbc").alias("path"), _text("BO_ 12 MSG_", i, ": 8 ECU").alias("content")))
    files = _files(spark, d).filter("doc_id % 6 = 2").select(F.col("path").alias("own"), F.explode(kinds).alias("f"))
    named = files.select(F.concat_ws("//", "own", "f.path").alias("path"), F.col("f.content").alias("content"))
    return repository.units(named, ("ros", "docker", "can")).select("section", F.substring_index("path", "//", 1).alias("path"), "unit")

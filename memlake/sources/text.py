"""Sources that are text: transcripts, paragraphs, repository sections, notes, label files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TURN = "type string, message struct<role:string,content:string>, role string, content string, timestamp string, requestId string"


def parse_turns(lines: DataFrame, session: str = "session_id", line: str = "line", order: str = "nth") -> DataFrame:
    """(session, idx, role, text, timestamp) of JSON lines in either dialect; lines that don't parse are skipped.

    One dialect nests role and content in `message`, the other has them at the top. Content that is a list of
    blocks contributes its text blocks.
    """
    j = F.from_json(line, TURN)
    rows = lines.select(session, order, j.alias("j")).filter("j IS NOT NULL AND coalesce(j.type, j.role) IS NOT NULL")
    role = F.coalesce("j.message.role", "j.role", "j.type")
    raw = F.coalesce("j.message.content", "j.content")
    blocks = F.from_json(raw, "array<struct<type:string,text:string>>")
    text = F.when(raw.startswith("["), F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")).otherwise(raw)
    rows = rows.select(session, order, F.when(role == "human", "user").otherwise(role).alias("role"), text.alias("text"), F.col("j.timestamp").alias("timestamp")).filter("role IN ('user', 'assistant') AND text IS NOT NULL")
    return rows.withColumn("idx", (F.row_number().over(Window.partitionBy(session).orderBy(order)) - 1).cast("long")).drop(order)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Turns of JSON-lines files, a session a file."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("session_id"), F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("nth"))
    return parse_turns(lines)


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda x: F.trim(x)), lambda p: p != "")


def chunks(text: Column, most: int) -> Column:
    """Paragraphs packed in order into chunks of at most `most` characters; a longer paragraph is a chunk by itself."""
    none = F.array().cast("array<string>")

    def pack(done: Column, p: Column) -> Column:
        last = F.element_at(done, -1)
        fits = (F.size(done) > 0) & (F.length(last) + 2 + F.length(p) <= most)
        return F.when(fits, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(last, F.lit("\n\n"), p)))).otherwise(F.concat(done, F.array(p)))

    return F.aggregate(paragraphs(text), none, pack)


def read_files(spark: SparkSession, path: str, most_bytes: int = 100_000) -> DataFrame:
    """(path, content) of files up to a size, from any store that Spark reads."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.col("length") <= most_bytes).select("path", F.col("content").cast("string").alias("content"))


#: A section is a pattern whose group 1 is extracted from each file that the path pattern names.
SECTIONS = {
    "routes": (r"\.(py|js|ts|go)$", r"""(?:@\w+\.(?:get|post|put|delete|route)|\b(?:app|router)\.(?:get|post|put|delete))\(\s*["']([^"']+)["']"""),
    "env": (r".", r"""(?:getenv\(|environ(?:\.get\(|\[)|process\.env\.)\s*["']?([A-Z][A-Z0-9_]+)"""),
    "messages": (r"\.proto$", r"""\bmessage\s+(\w+)"""),
    "tables": (r".", r"""(?i)create\s+table\s+(?:if\s+not\s+exists\s+)?["`]?(\w+)"""),
    "targets": (r"CMakeLists\.txt$", r"""add_(?:executable|library)\(\s*(\w+)"""),
    "todo": (r".", r"""\b((?:TODO|FIXME|HACK)\b[^\n]*)"""),
    "links": (r".", r"""href=["']([^"'#]+)["']"""),
}


def sections(files: DataFrame, names: tuple[str, ...] = tuple(SECTIONS)) -> DataFrame:
    """(section, path, unit) of each pattern's hits. All patterns run in one scan of the files."""

    def units(name: str) -> Column:
        where, pattern = SECTIONS[name]
        hits = F.when(F.col("path").rlike(where), F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), F.lit(1))))
        return F.transform(F.coalesce(hits, F.array().cast("array<string>")), lambda u: F.struct(F.lit(name).alias("section"), u.alias("unit")))

    found = [units(n) for n in names]
    return files.select("path", F.explode(F.concat(*found)).alias("x")).select("x.section", "path", "x.unit")


def notes(rows: DataFrame, text: str = "text") -> DataFrame:
    """Entries (type, topic, content) of tagged notes in texts."""
    hits = F.regexp_extract_all(text, F.lit(r"(?s)<memory_note>(.*?)</memory_note>"), F.lit(1))
    return rows.withColumn("note", F.explode(hits)).select(*[c for c in rows.columns if c != text], F.regexp_extract("note", r"^\s*(\w+)\s*/", 1).alias("type"), F.trim(F.regexp_extract("note", r"^\s*\w+\s*/\s*([^:]+):", 1)).alias("topic"), F.trim(F.regexp_extract("note", r"(?s)^[^:]+:(.*)$", 1)).alias("content"))


def grades(rows: DataFrame, text: str = "grades") -> DataFrame:
    """Marks such as `42:3!` as (id, grade, strong), one row each."""
    hits = F.regexp_extract_all(text, F.lit(r"(\d+:[0-3]!?)"), F.lit(1))
    m = rows.withColumn("mark", F.explode(hits))
    return m.select(*[c for c in rows.columns if c != text], F.split_part("mark", F.lit(":"), F.lit(1)).cast("long").alias("id"), F.substring(F.split_part("mark", F.lit(":"), F.lit(2)), 1, 1).cast("int").alias("grade"), F.col("mark").endswith("!").alias("strong"))


def usage(rows: DataFrame) -> DataFrame:
    """Tokens per model; a message counts once."""
    return rows.dropDuplicates(["message_id"]).groupBy("model").agg(F.count("*").alias("messages"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def write_labels(rows: DataFrame, path: str) -> DataFrame:
    """Rows as compressed JSON lines, and a manifest of counts by split, which is also written."""
    rows.write.mode("overwrite").option("compression", "gzip").json(f"{path}/rows")
    manifest = rows.sparkSession.read.schema(rows.schema).json(f"{path}/rows").groupBy("split").agg(F.count("*").alias("rows"))
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def changeset_json(rows: DataFrame, key: str) -> DataFrame:
    """Rows as JSON lines keyed by table, to travel; read_changeset turns them back."""
    return rows.select(F.lit(key).alias("table"), F.to_json(F.struct("*")).alias("row"))


def read_changeset(wire: DataFrame, key: str, schema: str) -> DataFrame:
    return wire.filter(F.col("table") == key).select(F.from_json("row", schema).alias("r")).select("r.*")

"""Sections of repositories: files by name, manifests, notes in source lines, units of special formats.

files: rows (path, content) of repositories, from any store that Spark reads (see text.read_files).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names and patterns that decide what is extracted.
SKIPPED_FOLDERS = (".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", "target", ".cache")
WHOLE = {
    "docs": r"(^|/)(README(\.md|\.txt|\.rst)?|ARCHITECTURE\.md|CONTRIBUTING\.md|DESIGN\.md|CHANGELOG\.md|API\.md)$|^docs/.*\.md$",
    "config": r"\.(ya?ml|toml|ini|cfg)$|(^|/)\.env\.example$",
    "schemas": r"\.(sql|prisma|graphql|avsc)$",
    "entrypoints": r"(^|/)(main|app|index|server|cli|__main__)\.(py|js|ts|go|rs)$",
    "exports": r"(^|/)(__init__\.py|mod\.rs|lib\.rs|index\.d\.ts)$",
}
CODE = r"\.(py|ts|js|go|rs|rb|java|sh|bash|c|cc|cpp|cxx|h|hpp|hxx)$"
SIGNALS = r"(?i)\b(because|since|NB|note|warning|depends|workaround|important|assumes|careful|must not|never|always|caveat|gotcha|tricky|subtle|temporary|deprecated)\b"
MARKS = r"""(?i)(?:#|//|/?\*+|\"{3}|<!--)\s*.{0,20}\b(TODO|HACK|FIXME|WORKAROUND|XXX)\b"""
UNITS = {
    "ros": (r"\.(msg|srv|action)$", r"(?m)^\s*([A-Za-z]\w*(?:/\w+)?)(?:\[\d*\])?\s+\w+"),
    "can": (r"\.dbc$", r"(?m)^BO_\s+\d+\s+(\w+)\s*:"),
    "yocto": (r"\.(bb|bbappend|bbclass)$", r"(?m)^(?:inherit|require|DEPENDS\s*\+?=)\s*\"?([\w./ -]+?)\"?\s*$"),
    "devicetree": (r"\.dtsi?$", r"compatible\s*=\s*\"([^\"]+)\""),
    "docker": (r"(^|/)Dockerfile[^/]*$", r"(?m)^FROM\s+(\S+)"),
    "ci": (r"^\.github/workflows/.*\.ya?ml$|(^|/)\.gitlab-ci\.yml$", r"(?m)^\s*(?:uses|image):\s*(\S+)"),
    "cpp_headers": (r"\.(h|hpp|hxx)$", r"(?m)^\s*(?:class|struct|enum(?:\s+class)?)\s+(\w+)"),
    "events": (CODE, r"""\.(?:emit|publish|on|subscribe)\(\s*["']([\w.:/-]+)["']"""),
    "cli": (r"\.py$", r"""add_(?:argument|parser)\(\s*["']([\w-]+)["']"""),
}


def counted(path: Column, deepest: int = 4) -> Column:
    """Whether a path is above a depth and in none of the skipped folders."""
    parts = F.split(path, "/")
    return (F.size(parts) <= deepest) & ~F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), F.array(*map(F.lit, SKIPPED_FOLDERS)))


def tree(files: DataFrame, deepest: int = 4) -> DataFrame:
    """Files above a depth, in folders that count."""
    return files.filter(counted(F.col("path"), deepest))


def whole_sections(files: DataFrame) -> DataFrame:
    """(section, path, content) of files that are a section as a whole; the first section that a name fits counts."""
    name = F.lit(None).cast("string")
    for section, pattern in reversed(WHOLE.items()):
        name = F.when(F.col("path").rlike(pattern), section).otherwise(name)
    return files.withColumn("section", name).filter("section IS NOT NULL").select("section", "path", "content")


def dependencies(files: DataFrame) -> DataFrame:
    """(path, name, version, scope) of package.json and requirements files; unreadable ones have none."""
    j = F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>")
    empty = F.create_map().cast("map<string,string>")
    listed = lambda field, scope: F.transform(F.map_entries(F.coalesce(F.col(f"j.{field}"), empty)), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("version"), F.lit(scope).alias("scope")))
    package = files.filter(F.col("path").rlike(r"(^|/)package\.json$")).withColumn("j", j)
    package = package.select("path", F.explode(F.concat(listed("dependencies", "runtime"), listed("devDependencies", "development"), listed("peerDependencies", "peer"))).alias("x"))
    lines = files.filter(F.col("path").rlike(r"(^|/)requirements[^/]*\.txt$")).select("path", F.explode(F.split("content", "\n")).alias("line")).filter(F.col("line").rlike(r"^\s*[A-Za-z]"))
    wheels = lines.select("path", F.regexp_extract("line", r"^\s*([\w.-]+)", 1).alias("name"), F.nullif(F.regexp_extract("line", r"([=<>~!]=?\s*[\w.*]+)", 1), F.lit("")).alias("version"), F.lit("runtime").alias("scope"))
    return package.select("path", "x.*").unionByName(wheels)


def line_notes(files: DataFrame, most_lines: int | None = None) -> DataFrame:
    """S10e: (section, path, line, text) of source files: comments of 15 characters with a telling word, and marks of work to do.

    most_lines: lines of a file that are read, for trees whose files are read in part; all by default.
    """
    every = F.split("content", "\n")
    lines = files.filter(F.col("path").rlike(CODE)).select("path", F.posexplode(every if most_lines is None else F.slice(every, 1, most_lines)).alias("n", "raw")).withColumn("text", F.trim("raw"))
    comment = F.col("text").rlike(r"^(#|//|/?\*+)\s*") & ~F.col("text").startswith("#!") & (F.length("text") >= 15) & F.col("text").rlike(SIGNALS)
    kinds = F.filter(F.array(F.when(comment, "comments"), F.when(F.col("text").rlike(MARKS), "todos")), lambda k: k.isNotNull())
    return lines.select(F.explode(kinds).alias("section"), "path", (F.col("n") + 1).alias("line"), "text")


def units(files: DataFrame, names: tuple[str, ...] = tuple(UNITS)) -> DataFrame:
    """S10d, S10g, S10h: (section, path, unit) of the formats' own patterns, in one scan."""

    def hits(name: str) -> Column:
        where, pattern = UNITS[name]
        found = F.when(F.col("path").rlike(where), F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), F.lit(1))))
        return F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda u: F.struct(F.lit(name).alias("section"), u.alias("unit")))

    return files.select("path", F.explode(F.concat(*map(hits, names))).alias("x")).select("x.section", "path", "x.unit")


def env_files(found: DataFrame) -> DataFrame:
    """S10f: (variable, files) of env units (path, unit)."""
    return found.groupBy(F.col("unit").alias("variable")).agg(F.array_sort(F.collect_set("path")).alias("files"))

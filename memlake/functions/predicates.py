"""Row predicates and bands as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .wordlists import CORRECTION_STARTS, DIRECTIONS, EMPTY_PHRASES, NEGATIONS, PLAN_WORDS, QUESTION_STARTS


def is_live(deleted_at: Column) -> Column:
    """Not deleted."""
    return deleted_at.isNull()


def is_active(deleted_at: Column, archived_reason: Column) -> Column:
    """Live and without an archive reason; an empty reason counts as none."""
    return deleted_at.isNull() & (F.coalesce(archived_reason, F.lit("")) == "")


def review_band(confidence: Column) -> Column:
    """Below 0.3, below 0.6, or fine."""
    return F.when(confidence < 0.3, "low").when(confidence < 0.6, "moderate").otherwise("fine")


def reliability_band(confidence: Column) -> Column:
    """P23."""
    return F.when(confidence >= 0.6, "strong").when(confidence >= 0.4, "moderate").otherwise("weak")


def has_content(text: Column, least: int = 10) -> Column:
    """P20: at least `least` characters besides outer white space, and no stock phrase for having nothing to say."""
    said = F.lower(text)
    stock = F.lit(False)
    for phrase in EMPTY_PHRASES:
        stock = stock | said.contains(phrase)
    return F.coalesce((F.length(F.trim(text)) >= least) & ~stock, F.lit(False))


def words(text: Column) -> Column:
    """Lower-cased words between blanks; a vertical tab is none."""
    return F.filter(F.split(F.lower(text), r"[\t\n\f\r ]+"), lambda x: x != "")


def direction_mismatch(a: Column, b: Column) -> Column:
    """Texts with different negating words, one of them with some that the other lacks, or with opposite words.

    Only single words can match; phrases of the list never do.
    """
    wa, wb = words(a), words(b)
    listed = F.array(*map(F.lit, NEGATIONS))
    na, nb = F.array_intersect(wa, listed), F.array_intersect(wb, listed)
    out = (F.size(F.array_except(na, nb)) > 0) | (F.size(F.array_except(nb, na)) > 0)
    for x, y in DIRECTIONS:
        out = out | (F.array_contains(wa, x) & F.array_contains(wb, y)) | (F.array_contains(wa, y) & F.array_contains(wb, x))
    return out


def plan_like(text: Column, kind: Column) -> Column:
    """An older decision, fact, project or workflow that reads as a plan."""
    plain = words(F.translate(text, ",:()", "    "))
    return F.arrays_overlap(plain, F.array(*map(F.lit, PLAN_WORDS))) & kind.isin("decision", "fact", "project", "workflow")


def correcting(text: Column) -> Column:
    """A turn that starts like a correction."""
    said, out = F.lower(F.ltrim(text)), F.lit(False)
    for start in CORRECTION_STARTS:
        out = out | said.startswith(start)
    return out


def superseder(archived_reason: Column) -> Column:
    """Id after `by #` in an archive reason, or null."""
    return F.regexp_extract(archived_reason, r"by #(\d+)", 1).try_cast("long")


def question_form(text: Column) -> Column:
    """Ends with a question mark, or starts with a question word and has three words or more."""
    t = F.trim(text)
    return t.endswith("?") | (F.lower(t).rlike(QUESTION_STARTS) & (F.size(words(t)) >= 3))


def high_signal(exit_code: Column, output: Column, edited: Column, lines: int = 60) -> Column:
    """A failure, an error message, a long output or an edit."""
    return (exit_code != 0) | output.rlike(r"(?i)\b(error|exception|traceback|failed|fatal)\b") | (F.size(F.split(output, "\n")) >= lines) | edited

"""Scores, text measures and statistics as Columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import DEFAULTS, Params
from .predicates import words
from .wordlists import POLARITY_CUES, QUERY_STOPWORDS, TERM_STOPWORDS


def dot(a: Column, b: Column) -> Column:
    """Cosine of unit vectors, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of any vectors; 0 for null, empty, zero or unequal ones."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def l2_to_cosine(distance: Column) -> Column:
    return 1 - distance * distance / 2


def recency(updated_at: Column, as_of: Column, p: Params = DEFAULTS) -> Column:
    """exp(-0.693 days / half-life); 0.5 without a date."""
    days = (F.unix_timestamp(as_of) - F.unix_timestamp(updated_at)) / 86400.0
    return F.coalesce(F.exp(F.lit(-0.693) * F.greatest(days, F.lit(0.0)) / p.half_life_days), F.lit(0.5))


def scope_weight(kind: Column, project: Column, current: Column, p: Params = DEFAULTS) -> Column:
    return F.when(kind.isin(*p.scope_exempt), 1.0).when(current.isNull() | project.isNull(), 0.5).when(project == current, 1.0).otherwise(0.3)


def composite(similarity: Column, confidence: Column, keywords: Column, fresh: Column, scope: Column, p: Params = DEFAULTS) -> Column:
    return p.w_similarity * similarity + p.w_confidence * confidence * confidence + p.w_keywords * keywords + p.w_recency * fresh + p.w_scope * scope


def keyword_overlap(query_words: Column, keywords: Column) -> Column:
    """Share of keywords that hold, or are held by, a word of the query."""
    hit = F.filter(keywords, lambda k: F.exists(query_words, lambda q: k.contains(q) | q.contains(k)))
    return F.when(F.size(keywords) > 0, F.size(hit) / F.size(keywords)).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def terms(text: Column) -> Column:
    """Words of letters, digits, _ and - of three characters or more without stopwords, then adjacent pairs."""
    one = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9][a-z0-9_\-]{2,})"), F.lit(1)), lambda x: ~x.isin(*TERM_STOPWORDS))
    two = F.when(F.size(one) > 1, F.zip_with(F.slice(one, 1, F.greatest(F.size(one) - 1, F.lit(1))), F.slice(one, 2, F.greatest(F.size(one) - 1, F.lit(1))), lambda x, y: F.concat_ws(" ", x, y)))
    return F.array_distinct(F.concat(one, F.coalesce(two, F.array().cast("array<string>"))))


def idf(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (df + 1))


def rrf(rank: Column, p: Params = DEFAULTS) -> Column:
    """Reciprocal rank of a 0-based rank; a null rank adds nothing."""
    return F.coalesce(1.0 / (F.lit(p.rrf_k) + rank), F.lit(0.0))


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda x: F.trim(x) != "")


def strip_blocks(text: Column) -> Column:
    """Without fenced code and tagged blocks."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?```", ""), r"(?s)<(thinking|context|memory)>.*?</\1>", "")


def arm(key: Column, arms: int) -> Column:
    """First byte of the key's SHA-256, modulo the number of arms."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 2), 16, 10).cast("int") % arms).cast("int")


def hash_bucket(key: Column, buckets: int = 1000) -> Column:
    """The key's SHA-1 as a number, modulo buckets; the digits are folded so that a long suffices."""
    digest = F.sha1(key)
    out = F.lit(0).cast("long")
    for i in range(1, 41, 4):
        out = (out * 65536 + F.conv(F.substring(digest, i, 4), 16, 10).cast("long")) % buckets
    return out


def pseudo_random(id_: Column, modulus: int) -> Column:
    """Multiplicative order of ids."""
    return F.pmod(id_ * F.lit(2654435761), F.lit(modulus))


def saturated_confidence(ups: Column, p: Params = DEFAULTS) -> Column:
    """M4: c + step (1 - c), applied `ups` times to the start."""
    return 1 - (1 - p.confidence_start) * F.pow(F.lit(1 - p.confidence_step), ups)


def import_target(path: Column) -> Column:
    """An import's package: relative and scoped ones as they are, else what stands before the first slash and dot."""
    t = F.trim(path)
    bare = F.regexp_replace(t, r"^[./]+", "")
    return F.when(t.rlike(r"^\.{1,2}/"), t).when(bare.startswith("@"), bare).otherwise(F.substring_index(F.substring_index(bare, "/", 1), ".", 1))


def letter_sum(text: Column) -> Column:
    """Sum of the letters' places, of each sentence's first letter."""
    first = F.transform(sentences(text), lambda s: F.ascii(F.lower(F.regexp_extract(s, "([A-Za-z])", 1))))
    return F.aggregate(F.filter(first, lambda x: x > 0), F.lit(0), lambda a, x: a + x - 96)


def polarity(sentence_text: Column, matched: Column) -> Column:
    """True where a sentence has a correcting cue and a matched term."""
    return F.exists(sentences(sentence_text), lambda s: F.lower(s).rlike(POLARITY_CUES) & F.exists(matched, lambda m: F.lower(s).contains(m)))


def passage(topic: Column, content: Column, facts: Column, most: int = 600) -> Column:
    return F.substring(F.concat_ws("\n", F.concat_ws(": ", topic, content), F.array_join(facts, "; ")), 1, most)


def query_terms(text: Column) -> Column:
    """Distinct words of a query, longer than two letters and not stopwords."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"(\w+)"), F.lit(1)), lambda x: (F.length(x) > 2) & ~x.isin(*QUERY_STOPWORDS)))


def compounds(text: Column) -> Column:
    """Keywords: joined compounds, then other words of four letters or more, without stopwords."""
    joined = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+(?:[_\-.][a-z0-9]+)+)"), F.lit(1))
    plain = F.filter(words(F.regexp_replace(text, r"[^\p{L}\p{N}\s]", " ")), lambda x: (F.length(x) > 3) & ~x.isin(*QUERY_STOPWORDS))
    return F.array_distinct(F.concat(joined, plain))


def vector_bytes(v: Column) -> Column:
    """A vector as little-endian 32-bit floats."""

    @F.pandas_udf("binary")
    def pack(x: pd.Series) -> pd.Series:
        return x.map(lambda y: None if y is None else np.asarray(y, "<f4").tobytes())

    return pack(v)


def bytes_vector(b: Column) -> Column:
    """The vector that vector_bytes stored; null where the bytes aren't whole floats."""

    @F.pandas_udf("array<float>")
    def unpack(x: pd.Series) -> pd.Series:
        return x.map(lambda y: None if y is None or len(y) % 4 else np.frombuffer(y, "<f4"))

    return unpack(b)

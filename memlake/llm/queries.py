"""The registered queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import bpe_encode
from .exact_dedup import exact_dedup
from .html_text import extract_pages
from .line_dedup import deduped_lines
from .media import media_report
from .merkle import merkle_manifest, without_breaks
from .mixing import mix_documents
from .phrases import collocations
from .secret_scan import BASE, RULES, secret_report
from .shared import documents
from .sharding import shard_documents
from .simhash import simhash_dedup
from .suffix_dedup import repeated_spans
from .toxicity import fit_toxicity, score_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary_path() -> str:
    """Default place of the word vocabulary; bpe_encode takes any other."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(documents(spark, sf_dir))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(documents(spark, sf_dir))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(documents(spark, sf_dir))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_toxicity(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(documents(spark, sf_dir), vocabulary_path(), with_ids=False, with_digests=True)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduped_lines(documents(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_report(documents(spark, sf_dir))


def op11_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return merkle_manifest(docs, without_breaks(docs))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_simhash, op2_suffix_dedup, op3_mixing, op4_secret_scan, op5_toxicity, op6_bpe, op7_sharding, op8_line_dedup, op9_exact_dedup, op10_media, op11_html, op12_merkle, op13_phrases)}


def _secret_sql() -> str:
    """op4 in DuckDB: text between the matches of a rule gives their places, as in the operator."""
    quoted = lambda x: x.replace("'", "''")
    matches = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS rank, '{r.kind}' AS kind, '{quoted(r.keep or '.')}' AS good, regexp_extract_all(t, '{quoted(r.pattern)}') AS f, regexp_split_to_array(t, '{quoted(r.pattern)}') AS g FROM d WHERE regexp_matches(t, '{quoted(r.pattern)}')"
        for i, r in enumerate(RULES)
    )
    count = lambda i: f"coalesce(count(*) FILTER (rank = {i}), 0)::BIGINT"
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(coalesce(text, '')) AS blob FROM documents), m AS ({matches}),
        s AS (SELECT doc_id, rank, kind, good, unnest([{{'a': coalesce(list_sum([length(x) for x in g[1:i]]), 0) + coalesce(list_sum([length(x) for x in f[1:i - 1]]), 0), 'm': f[i]}} for i in range(1, len(f) + 1)]) AS x FROM m),
        k AS (SELECT doc_id, rank, x.a::BIGINT AS a, concat_ws(':', kind, x.a::BIGINT, x.a::BIGINT + length(x.m)) AS span FROM s WHERE regexp_matches(x.m, good)),
        c AS (SELECT doc_id, {count(0)} AS n_assign, {count(1)} AS n_access, {count(2)} AS n_hex, string_agg(span, ',' ORDER BY a, rank) FILTER (rank < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY a, rank) AS spans FROM k GROUP BY doc_id)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, blob FROM d LEFT JOIN c USING (doc_id)"""


def _merkle_sql() -> str:
    """op12 in DuckDB: levels by integer division of ranks, proofs as lists of what stands left and right, folded by list_reduce; crc32 bit by bit."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: f"sha256({' || '.join(field(c) for c in ('doc_id', 'source', 'lang', 'n_chars'))} || {field(text)})"
    bits = "list_prepend(4294967295::BIGINT, flatten([[(ascii((doc_id::VARCHAR)[i]) >> b) & 1 for b in range(8)] for i in range(1, length(doc_id::VARCHAR) + 1)])::BIGINT[])"
    even = f"list_reduce({bits}, lambda c, m: xor(c >> 1, CASE WHEN xor(c & 1, m) = 1 THEN 3988292384 ELSE 0 END)) % 2 = 1"  # the last step flips all bits
    tree = lambda nodes, name: f"""{name} AS (
            SELECT grp, 0::BIGINT AS level, rank, node, n FROM {nodes}
            UNION ALL
            SELECT grp, any_value(level) + 1, rank // 3, sha256(string_agg(node, '' ORDER BY rank)), any_value((n + 2) // 3) FROM {name} WHERE n > 1 GROUP BY grp, rank // 3)"""  # noqa: E731
    side = lambda name, place: f"coalesce((SELECT string_agg(x.node, '' ORDER BY x.rank) FROM {name} AS x WHERE x.grp = t.grp AND x.level = t.level AND x.rank // 3 = t.rank // 3 AND x.rank {place} t.rank), '')"
    steps = lambda name: f"SELECT grp, level, rank, [{side(name, '<')}, {side(name, '>')}] AS step FROM {name} AS t WHERE n > 1"
    path = lambda leaves, name: f"SELECT l.grp, l.rank, list(s.step ORDER BY s.level) AS path FROM {leaves} AS l JOIN {name} AS s ON s.grp = l.grp AND s.rank = l.rank // (3 ** s.level)::BIGINT GROUP BY l.grp, l.rank"
    return f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, coalesce('1' || source, '0') AS grp, {leaf('text')} AS node, CASE WHEN {even} THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS changed FROM documents),
        l AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, node) - 1 AS rank, count(*) OVER (PARTITION BY grp) AS n FROM d),
        {tree('l', 'nodes')},
        roots AS (SELECT '' AS grp, grp AS source, node, row_number() OVER (ORDER BY grp) - 1 AS rank, count(*) OVER () AS n FROM nodes WHERE n = 1),
        {tree('roots', 'over')},
        low AS ({steps('nodes')}), high AS ({steps('over')}),
        low_path AS ({path('l', 'low')}), high_path AS ({path('roots', 'high')}),
        p AS (
            SELECT l.doc_id, l.node AS leaf, r.node AS subroot, (SELECT node FROM over WHERE n = 1) AS root, l.changed, list_concat(coalesce(a.path, []), coalesce(b.path, [])) AS path
            FROM l JOIN roots AS r ON r.source = l.grp LEFT JOIN low_path AS a ON a.grp = l.grp AND a.rank = l.rank LEFT JOIN high_path AS b ON b.rank = r.rank),
        f AS (SELECT doc_id, leaf, subroot, root, sha256(array_to_string(flatten(path), '')) AS proof_sha256, list_reduce(list_prepend([changed, ''], path), lambda acc, s: [sha256(s[1] || acc[1] || s[2]), ''])[1] AS folded_root FROM p)
        SELECT *, folded_root = root AS verified FROM f"""


_PHRASE_SQL = """
    WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
    p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM t),
    g AS (SELECT lang, unnest(flatten([[array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)] for k in range(1, 4)])) AS phrase FROM p),
    f AS (SELECT lang, phrase, count(*) AS f FROM g GROUP BY ALL),
    n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
    c AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE f >= 10 AND contains(phrase, ' ')),
    e AS (SELECT *, array_to_string(w[:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, len(w))) AS k FROM c)),
    cut AS (
        SELECT e.lang, e.phrase, e.a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * e.a * e.a // (x.f::HUGEINT * y.f))::BIGINT AS score
        FROM e JOIN f AS x ON x.lang = e.lang AND x.phrase = e.head JOIN f AS y ON y.lang = e.lang AND y.phrase = e.rest),
    s AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    d AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE len(w) = 3) GROUP BY ALL)
    SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank, s.phrase, s.a, s.l, s.r, n.n, s.score
    FROM s JOIN n USING (lang) LEFT JOIN d USING (lang, phrase) WHERE d.a IS NULL OR 100 * d.a < 50 * s.a
    QUALIFY rank <= 2000"""

#: op11 for pages like the table's: one article of h1 and p elements with inline b and br, the page perhaps cut anywhere.
_HTML_SQL = r"""
    WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1), '<[^>]*$', '') AS t FROM pages),
    b AS (SELECT page_id, url, [regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g') FOR x IN regexp_split_to_array(t, '</?(?:p|h1)>')] AS x FROM a),
    c AS (SELECT page_id, url, [trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(y, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&nbsp;', ' '), '&amp(;|$)', '&', 'g'), '\s+', ' ', 'g')) FOR y IN x] AS x FROM b),
    d AS (SELECT page_id, url, array_to_string([y FOR y IN x IF y <> ''], chr(10)) AS text FROM c)
    SELECT page_id, url, text, length(text) AS n_chars FROM d"""

ORACLE_SQL = {
    "op11_html": _HTML_SQL,
    "op13_phrases": _PHRASE_SQL,
    "op12_merkle": _merkle_sql(),
    "op4_secret_scan": _secret_sql(),
    "op9_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
}

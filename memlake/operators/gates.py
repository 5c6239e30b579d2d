"""The retrieval chain: candidates, gates, reranking, fusion and scopes for batches of queries.

Rows are (query_id, id, ...); each operator keeps the queries apart, and ties go to the lower id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalars import composite, jaccard, keyword_overlap, rrf, scope_weight
from ..params import DEFAULTS, Params
from .retrieval import top_k



def each() -> WindowSpec:
    """A query's rows."""
    return Window.partitionBy("query_id")


def ordered(*by: Column | str) -> WindowSpec:
    return each().orderBy(*by, "id")


def entry_gates(rows: DataFrame, threshold: float, limit: int, p: Params = DEFAULTS) -> DataFrame:
    """R7 up to G4: rows (similarity, score) that pass, with `rank` by score and the query's `room`.

    The `10 * limit` best by score count. None pass where the first one's similarity is below the garbage gate, or
    its similarity and score are both below the borderline. A row needs a share of the first one's similarity.
    room is the limit, or two where the first two scores are close.
    """
    best = top_k(rows.filter(F.col("similarity") >= threshold), ["query_id"], [F.desc("score"), F.col("id")], 10 * limit)
    first = ordered(F.desc("score"))
    rows = best.withColumn("_sim", F.first("similarity").over(first)).withColumn("_score", F.first("score").over(first))
    weak = (F.col("_sim") < p.garbage_gate) | ((F.col("_sim") < p.borderline_similarity) & (F.col("_score") < p.borderline_score))
    rows = rows.filter(~weak & (F.col("similarity") >= p.relative_ratio * F.col("_sim"))).withColumn("rank", (F.row_number().over(first) - 1).cast("long"))
    second = F.max(F.when(F.col("rank") == 1, F.col("score"))).over(each())
    close = F.coalesce(F.col("_score") - second < p.dominance, F.lit(False))
    return rows.withColumn("room", F.when(close, F.greatest(F.lit(limit), F.lit(2))).otherwise(limit)).drop("_sim", "_score")


def unlike(ranked: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Rows in order without those like one kept before: of its kind and topic, or sharing most of its words.

    ranked: (query_id, id, rank, kind, topic, words), few rows a query: what is kept depends on what was, so the
    rows of a query are folded in one expression.
    """
    item = F.struct("rank", "id", "kind", "topic", "words")
    none = F.array().cast(f"array<struct<rank:bigint,id:{ranked.schema['id'].dataType.simpleString()},kind:string,topic:string,words:array<string>>>")

    def step(kept: Column, x: Column) -> Column:
        like = F.exists(kept, lambda y: (y["kind"].eqNullSafe(x["kind"]) & y["topic"].eqNullSafe(x["topic"])) | (jaccard(y["words"], x["words"]) > p.diversity_jaccard))
        return F.when(like, kept).otherwise(F.concat(kept, F.array(x)))

    folded = ranked.select("query_id", item.alias("x")).groupBy("query_id").agg(F.aggregate(F.array_sort(F.collect_list("x")), none, step).alias("kept"))
    return ranked.join(folded.select("query_id", F.explode("kept.id").alias("id")), ["query_id", "id"], "left_semi")


def places(limit: int = 5, p: Params = DEFAULTS) -> tuple[int, int]:
    """How many of a query's active rows by score, and of its archived rows by similarity, find_similar can use at most."""
    return 10 * limit, max(p.rerank_archived, limit, 2)


def find_similar(rows: DataFrame, threshold: float = 0.15, limit: int = 5, rerank: bool = True, enabled: bool = True, p: Params = DEFAULTS) -> DataFrame:
    """(query_id, id, archived, place, score, similarity, gate_status) of what is served.

    rows: (query_id, id, similarity, score, kind, topic, words, archived, ce_score); ce_score is null where the
    reranker gave no score. Archived rows of a query that has active ones are served after those, by similarity,
    or as the reranker leaves them. gate_status says whether the reranker ran, and if not, why. Rows beyond `places`
    change nothing, so a search may leave them out.
    """
    active = unlike(entry_gates(rows.filter(~F.col("archived")), threshold, limit, p), p)
    active = active.withColumn("rank", (F.row_number().over(ordered(F.desc("score"))) - 1).cast("long"))
    top = active.groupBy("query_id").agg(F.min_by("similarity", "rank").alias("_best"), F.first("room").alias("room"))
    old = rows.filter(F.col("archived") & (F.col("similarity") >= p.garbage_gate)).join(top, "query_id").filter(F.col("similarity") >= p.relative_ratio * F.col("_best"))
    old = old.withColumn("rank", (F.row_number().over(ordered(F.desc("similarity"))) - 1).cast("long")).drop("_best")
    both = active.select("query_id", "id", "archived", "similarity", "score", "ce_score", "rank", "room").unionByName(old.select("query_id", "id", "archived", "similarity", F.lit(0.0).alias("score"), "ce_score", "rank", "room"))
    asked = F.lit(enabled and rerank)
    most = F.when(F.col("archived"), p.rerank_archived).otherwise(p.rerank_active)
    both = both.filter(~asked | (F.col("rank") < most))
    side = Window.partitionBy("query_id", "archived")
    scored = asked & (F.count("ce_score").over(each()) == F.count(F.lit(1)).over(each()))
    both = both.withColumn("_scored", scored)
    passing = F.col("ce_score") >= p.rerank_floor
    any_passing = F.max(passing.cast("int")).over(side) == 1
    both = both.withColumn("_stay", ~F.col("_scored") | (passing & any_passing) | (~any_passing & (F.col("rank") == 0))).filter("_stay")
    low, high = F.min("ce_score").over(side), F.max("ce_score").over(side)
    scaled = (F.col("ce_score") - low) / F.when(high > low, high - low).otherwise(1.0)
    blended = F.when(F.col("_scored") & ~F.col("archived"), (1 - p.rerank_weight) * F.col("score") + p.rerank_weight * scaled).otherwise(F.col("score"))
    both = both.withColumn("score", blended)
    order = F.when(F.col("archived"), -F.col("rank").cast("double")).otherwise(F.col("score"))
    both = both.withColumn("_nth", F.row_number().over(side.orderBy(order.desc(), "rank", "id"))).filter(F.col("_nth") <= F.col("room"))
    place = F.row_number().over(each().orderBy("archived", "_nth")) - 1
    status = "disabled" if not enabled else "ungated-by-design" if not rerank else None
    named = F.lit(status) if status else F.when(F.col("_scored"), "reranked").otherwise("gate-unavailable")
    return both.select("query_id", "id", "archived", place.cast("long").alias("place"), "score", "similarity", named.alias("gate_status"))


def allowed(found: DataFrame, queries: DataFrame, records: DataFrame) -> DataFrame:
    """Found rows without those of the query's own session or, where it asks so, of its project.

    queries: (query_id, session, project, elsewhere); records: (id, session, project). Ranks come after this.
    """
    rows = found.join(queries.select("query_id", F.col("session").alias("_s"), F.col("project").alias("_p"), "elsewhere"), "query_id").join(records.select("id", "session", "project"), "id", "left")
    own = F.coalesce(F.col("session") == F.col("_s"), F.lit(False)) | (F.col("elsewhere") & F.coalesce(F.col("project") == F.col("_p"), F.lit(False)))
    return rows.filter(~own).drop("_s", "_p", "elsewhere", "session", "project")


def fused_scores(semantic: DataFrame, lexical: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """(query_id, id, similarity, score, source) of two ranked lists (query_id, id, rank, score, similarity).

    A row found by words alone has a fixed similarity; its own score comes with the lexical list. Reciprocal ranks
    add to the score, scaled so that first places in both lists give the full weight.
    """
    left = semantic.select("query_id", "id", F.col("rank").alias("s_rank"), F.col("score").alias("s_score"), "similarity")
    both = left.join(lexical.select("query_id", "id", F.col("rank").alias("l_rank"), F.col("score").alias("l_score")), ["query_id", "id"], "full")
    boost = (rrf(F.col("s_rank"), p) + rrf(F.col("l_rank"), p)) * p.rrf_weight / (2.0 / (p.rrf_k + 1))
    source = F.when(F.col("s_rank").isNull(), "fts").when(F.col("l_rank").isNull(), "semantic").otherwise("both")
    return both.select("query_id", "id", F.coalesce("similarity", F.lit(p.fts_similarity)).alias("similarity"), (F.coalesce("s_score", "l_score", F.lit(0.30)) + boost).alias("score"), source.alias("source"))


def with_priors(fused: DataFrame, records: DataFrame, priors: dict[str, float]) -> DataFrame:
    """Scores moved by what wrote the record. records: (id, source_ref)."""
    move = F.lit(0.0)
    for ref, by in priors.items():
        move = F.when(F.col("source_ref") == ref, by).otherwise(move)
    return fused.join(records.select("id", "source_ref"), "id", "left").withColumn("score", F.col("score") + F.coalesce(move, F.lit(0.0))).drop("source_ref")


def adaptive_boost() -> Column:
    """What harmful and neutral outcomes add to the threshold: an aggregate over `outcome`, nothing below five."""
    bad = F.count_if(F.col("outcome").isin("harmful", "neutral")) / F.count("*")
    return F.when(F.count("*") < 5, 0.0).when(bad > 0.5, 0.10).when(bad > 0.3, 0.05).otherwise(0.0)


def scopes(fused: DataFrame, threshold: Column, limit: int = DEFAULTS.scope_limit, served: DataFrame | None = None, p: Params = DEFAULTS) -> DataFrame:
    """Fused rows (score, similarity, source, in_project, kind) with their `scope`, `limit` of each by score.

    threshold: with the adaptive boost in it. A row of the project needs it. Any other row passes with it, above
    the global floor where the project has none, or, of the project, by words alone with a fair score; references
    need more in any case. served: (query_id, id) that were shown before and leave last of all.
    """
    mine = F.col("in_project") & (F.col("similarity") >= threshold)
    none = F.max(mine.cast("int")).over(each()) == 0
    by_words = (F.col("source") == "fts") & (F.col("score") >= p.weak_entry) & F.col("in_project")
    passes = ((F.col("similarity") >= p.global_floor) & none) | (F.col("similarity") >= threshold) | by_words
    passes = passes & ((F.col("kind") != "reference") | (F.col("similarity") >= p.reference_similarity))
    rows = fused.withColumn("scope", F.when(mine, "project").when(passes, "global")).filter("scope IS NOT NULL")
    if served is not None:
        rows = rows.join(served, ["query_id", "id"], "left_anti")
    return top_k(rows, ["query_id", "scope"], [F.round("score", 9).desc(), F.col("id")], limit)


def hybrid_search(semantic: DataFrame, lexical: DataFrame, queries: DataFrame, records: DataFrame, threshold: Column, priors: dict[str, float], limit: int = 10, kept: int = DEFAULTS.scope_limit, served: DataFrame | None = None, p: Params = DEFAULTS) -> DataFrame:
    """(query_id, scope, id, rank, score, similarity, source) of what both searches found.

    semantic: (query_id, id, similarity, rank); lexical: (query_id, id, rank). queries: (query_id, session, project, elsewhere,
    words); records: (id, session, project, kind, source_ref, keywords). Each list's first rows (2 limit and 3 limit) lose
    those of the query's own session, or project where it looks elsewhere, and are ranked anew. A row has the composite
    score of its similarity (a fixed one where only words found it), its keywords and its scope; reciprocal ranks and
    what wrote it add to that. Then scopes, `kept` rows of each.
    """
    ranked = lambda df, n: top_k(allowed(df.filter(F.col("rank") < n).withColumnRenamed("rank", "_was"), queries, records), ["query_id"], [F.col("_was"), F.col("id")], n).drop("_was")
    left, right = ranked(semantic, 2 * limit), ranked(lexical, 3 * limit)
    asked = queries.select("query_id", F.col("project").alias("_p"), F.col("words").alias("_w"))
    held = records.select("id", F.col("project").alias("_of"), "kind", "keywords")

    def scored(df: DataFrame, similarity: Column) -> DataFrame:
        told = df.join(asked, "query_id").join(held, "id")
        score = composite(similarity, F.lit(0.0), keyword_overlap(F.col("_w"), F.col("keywords")), F.lit(0.0), scope_weight(F.col("kind"), F.col("_of"), F.col("_p"), p), p)
        return told.withColumn("score", score).select(*df.columns, "score")

    fused = with_priors(fused_scores(scored(left, F.col("similarity")), scored(right, F.lit(p.fts_similarity)), p), records, priors)
    fused = fused.join(asked.drop("_w"), "query_id").join(held.drop("keywords"), "id").withColumn("in_project", F.coalesce(F.col("_of") == F.col("_p"), F.lit(False)))
    return scopes(fused, threshold, kept, served, p).select("query_id", "scope", "id", "rank", "score", "similarity", "source")


def first_source(hits: list[DataFrame], limit: int) -> DataFrame:
    """(query_id, id, source, rank) of lists (query_id, id, rank) one after another; an id counts where it comes first."""
    rows = None
    for i, h in enumerate(hits):
        h = h.select("query_id", "id", F.lit(i).alias("source"), "rank")
        rows = h if rows is None else rows.unionByName(h)
    once = rows.groupBy("query_id", "id").agg(F.min(F.struct("source", "rank")).alias("x")).select("query_id", "id", "x.source", "x.rank")
    return top_k(once.withColumnRenamed("rank", "_rank"), ["query_id"], [F.col("source"), F.col("_rank"), F.col("id")], limit).drop("_rank")


def calibration(found: DataFrame, k: int = 5, floor: float = 0.40) -> DataFrame:
    """(query_id, id, score, rank) from (similarity, shared, confidence, pinned, priority).

    similarity: the best of a row's question forms, or else of the row. Pinned rows pass the floor; the order is by
    pinned, score and source priority.
    """
    score = 0.55 * F.col("similarity") + 0.20 * F.col("shared") + 0.15 * F.col("confidence") + 0.10 * F.col("pinned").cast("int")
    rows = found.withColumn("score", score).filter((F.col("score") >= floor) | F.col("pinned"))
    return top_k(rows, ["query_id"], [F.desc("pinned"), F.round("score", 9).desc(), F.desc("priority"), F.col("id")], k).select("query_id", "id", "score", "rank")


def best_trigger(found: DataFrame, threshold: float = 0.45, near: float = 0.3) -> DataFrame:
    """Of each query its most similar trigger, which fires, nearly does, or (then it is left out) neither."""
    best = found.groupBy("query_id").agg(F.max(F.struct(F.round("similarity", 9).alias("similarity"), (-F.col("id")).alias("n"))).alias("x"))
    rows = best.select("query_id", (-F.col("x.n")).alias("id"), "x.similarity").filter(F.col("similarity") > near)
    return rows.withColumn("fires", F.col("similarity") >= threshold)


def enriched(queries: DataFrame, least_words: int = 10) -> DataFrame:
    """Short queries with their `context` before them."""
    short = F.size(F.filter(F.split("query", r"\s+"), lambda w: w != "")) < least_words
    return queries.withColumn("query", F.when(short & F.col("context").isNotNull(), F.concat_ws(" ", "context", "query")).otherwise(F.col("query")))

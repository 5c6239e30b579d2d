"""Outcome analytics over delivery logs: coverage, engagement, strata, experiments, labels.

`engaged` is 1, 0 or null for undecided, and stays so; a score below 0 marks an undecidable row.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cosine, idf, polarity, terms
from ..params import DEFAULTS, Params
from .sessions import next_rows


def percent(part: Column, whole: Column, places: int = 1) -> Column:
    """Half-even rounded percentage; null where there is nothing to divide by."""
    return F.when(whole > 0, F.bround(100.0 * part / whole, places))


def outcomes(rows: DataFrame, *keys: str) -> DataFrame:
    """Per group n, decided, coverage_pct, engaged_pct of the decided, avg_score of scores from 0, graded, avg_grade."""
    decided = F.count("engaged")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        decided.alias("decided"),
        percent(decided, F.count("*")).alias("coverage_pct"),
        percent(F.count_if(F.col("engaged") == 1), decided).alias("engaged_pct"),
        F.bround(F.avg(F.when(F.col("engaged_score") >= 0, F.col("engaged_score"))), 4).alias("avg_score"),
        F.count("grade").alias("graded"),
        F.bround(F.avg("grade"), 4).alias("avg_grade"),
    )


def qualifying_strata(rows: DataFrame, method: str = "method") -> DataFrame:
    """A10: methods that have both engaged and unengaged rows."""
    return rows.groupBy(method).agg(F.count_if(F.col("engaged") == 1).alias("yes"), F.count_if(F.col("engaged") == 0).alias("no")).filter("yes > 0 AND no > 0")


def neutralise(rows: DataFrame, strata: DataFrame, method: str = "method") -> DataFrame:
    """Rows of other methods become undecided; nothing is removed."""
    good = strata.select(F.col(method).alias("_good")).withColumn("_in", F.lit(True))
    joined = rows.join(good, F.col(method) == F.col("_good"), "left")
    inside = F.coalesce("_in", F.lit(False))
    return joined.withColumns({"engaged": F.when(inside, F.col("engaged")), "engaged_score": F.when(inside, F.col("engaged_score"))}).drop("_good", "_in")


def readout(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The outcome columns grouped by each key alone, with the key's name: one pass by grouping sets."""
    rows = rows.select(*[F.col(k).cast("string").alias(k) for k in keys], "engaged", "engaged_score", "grade")
    sets = [[F.col(k)] for k in keys]
    decided = F.count("engaged")
    name = F.lit(None)
    for k in keys:
        name = F.when(F.grouping(k) == 0, F.lit(k)).otherwise(name)
    return rows.groupingSets(sets, *keys).agg(name.alias("axis"), F.count("*").alias("n"), decided.alias("decided"), percent(F.count_if(F.col("engaged") == 1), decided).alias("engaged_pct")).select("axis", F.coalesce(*keys).alias("key"), "n", "decided", "engaged_pct")


def marginal_by_rank(rows: DataFrame, least: int = 5) -> DataFrame:
    """Engagement by turn size and served rank, without cells of fewer than `least` decided rows."""
    sized = rows.withColumn("turn_size", F.count("*").over(Window.partitionBy("session_id", "turn_index")))
    cells = sized.groupBy("turn_size", "served_rank").agg(F.count("engaged").alias("decided"), F.count_if(F.col("engaged") == 1).alias("engaged"))
    return cells.filter(F.col("decided") >= least).withColumn("engaged_pct", percent(F.col("engaged"), F.col("decided")))


def document_frequency(docs: DataFrame, text: str = "text", least: int = 2) -> DataFrame:
    """(term, df) over distinct terms and adjacent pairs of each text."""
    return docs.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") >= least)


def engagement(rows: DataFrame, df: DataFrame, n: int | DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """O2: from (id, memory, prompt, response) to (id, engaged, engaged_score).

    A memory's distinctive terms are not in the prompt and rare enough. Engaged if the response has two or more
    of them; the score is their share by weight. Without distinctive terms: null and -1. n: how many texts df
    counts, or a table of one row with that as `n`.
    """
    own = F.array_except(terms(F.col("memory")), terms(F.col("prompt")))
    cut = rows.select("id", own.alias("own"), F.array_intersect(own, terms(F.col("response"))).alias("hits"))
    each = cut.select("id", F.explode(F.transform("own", lambda t: F.struct(t.alias("term"), F.array_contains("hits", t).alias("hit")))).alias("x")).select("id", "x.term", "x.hit")
    each = each.crossJoin(F.broadcast(n.select("n"))) if isinstance(n, DataFrame) else each.withColumn("n", F.lit(n))
    weighed = each.join(df, "term", "left").withColumn("idf", idf(F.col("n"), F.coalesce("df", F.lit(0)))).filter(F.col("idf") >= p.idf_floor)
    sums = weighed.groupBy("id").agg(F.count_if("hit").alias("hits"), F.sum(F.when(F.col("hit"), F.col("idf")).otherwise(0.0)).alias("got"), F.sum("idf").alias("all"))
    return rows.select("id").join(sums, "id", "left").select("id", (F.col("hits") >= p.engaged_terms).cast("int").alias("engaged"), F.coalesce(F.bround(F.col("got") / F.col("all"), 6), F.lit(-1.0)).alias("engaged_score"))


def apply_engagement(rows: DataFrame, lexical: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """(id, engaged, engaged_score, method, polarity): words first, then a second chance by vectors.

    rows: (id, memory, prompt, response, v_memory, v_prompt, v_response); lexical: engagement's result. A row that
    words don't show as engaged is, if the response is close to the memory, and closer by a margin than the prompt.
    polarity says whether the response disputes what it took up; vectors don't change it.
    """
    near, before = cosine(F.col("v_response"), F.col("v_memory")), cosine(F.col("v_prompt"), F.col("v_memory"))
    hits = F.array_intersect(F.array_except(terms(F.col("memory")), terms(F.col("prompt"))), terms(F.col("response")))
    both = rows.withColumns({"near": near, "before": before, "polarity": F.when(polarity(F.col("response"), hits), "corrected").otherwise("used")}).join(lexical, "id")
    rescued = (F.coalesce("engaged", F.lit(0)) != 1) & F.col("v_memory").isNotNull() & F.col("v_response").isNotNull() & (F.col("near") >= p.semantic_threshold) & (F.col("near") - F.col("before") >= p.semantic_margin)
    return both.select(
        "id", F.when(rescued, 1).otherwise(F.col("engaged")).alias("engaged"), F.when(rescued, F.bround("near", 4)).otherwise(F.col("engaged_score")).alias("engaged_score"),
        F.when(rescued, "semantic").otherwise("lexical").alias("method"), "polarity",
    )


def delivery_log(served: DataFrame, turns: DataFrame, records: DataFrame) -> DataFrame:
    """Rows (session_id, turn_index, id, served_rank, scope) to append for what was served.

    served: (session_id, project, id, rank); the turn is the session's next one in `turns` (session_id, turn_index).
    scope says whether a record (id, project) is of the session's project.
    """
    last = turns.groupBy("session_id").agg((F.max("turn_index") + 1).alias("turn_index"))
    rows = served.join(last, "session_id", "left").join(records.select("id", F.col("project").alias("_p")), "id", "left")
    scope = F.when(F.col("project").eqNullSafe(F.col("_p")), "project").otherwise("global")
    return rows.select("session_id", F.coalesce("turn_index", F.lit(0)).alias("turn_index"), "id", F.col("rank").alias("served_rank"), scope.alias("scope"))


def best_floor(sweep: DataFrame) -> DataFrame:
    """Of floor_sweep's rows the allowed one that drops most noise, and the one with the best Youden index; ties go to the lower floor."""
    low = -F.col("floor")
    chosen = F.max_by("floor", F.when(F.col("allowed"), F.struct(F.round("dropped", 9), low)))
    return sweep.agg(chosen.alias("floor"), F.max_by("floor", F.struct(F.round("youden", 9), low)).alias("youden_floor"))


def arm_stats(rows: DataFrame, arm: str = "arm") -> DataFrame:
    """One row of n_a, n_b, engaged_pct_a, ... of two arms, from rows whose strata hold both classes."""
    good = neutralise(rows, qualifying_strata(rows))
    out = []
    for x in "ab":
        mine = F.col(arm) == x
        decided = F.count(F.when(mine, F.col("engaged")))
        out += [decided.alias(f"n_{x}"), (100.0 * F.count_if(mine & (F.col("engaged") == 1)) / F.nullif(decided, F.lit(0))).alias(f"engaged_pct_{x}"), F.count(F.when(mine, F.col("grade"))).alias(f"graded_{x}"), F.avg(F.when(mine, F.col("grade"))).alias(f"grade_{x}")]
    return good.agg(*out)


def compliance_gate(rows: DataFrame, level: float = 0.05) -> DataFrame:
    """(experiment, n_old, n_new, rate_old, rate_new, p, worse) of flags before and since each candidate began.

    rows: (experiment, at, candidate, flagged); the window opens with the candidate's first row. worse: the
    candidate flags more, and not by chance.
    """
    start = F.min(F.when(F.col("candidate"), F.col("at"))).over(Window.partitionBy("experiment"))
    inside = rows.withColumn("_start", start).filter(F.col("at") >= F.col("_start"))
    old, new = ~F.col("candidate"), F.col("candidate")
    sums = inside.groupBy("experiment").agg(F.count_if(new & F.col("flagged")).alias("a"), F.count_if(new & ~F.col("flagged")).alias("b"), F.count_if(old & F.col("flagged")).alias("c"), F.count_if(old & ~F.col("flagged")).alias("d"))
    done = fisher_exact(sums).withColumn("n_old", F.col("c") + F.col("d")).withColumn("n_new", F.col("a") + F.col("b"))
    done = done.withColumn("rate_old", F.col("c") / F.nullif("n_old", F.lit(0))).withColumn("rate_new", F.col("a") / F.nullif("n_new", F.lit(0)))
    return done.select("experiment", "n_old", "n_new", "rate_old", "rate_new", "p", (F.coalesce(F.col("rate_new") > F.col("rate_old"), F.lit(False)) & (F.col("p") < level)).alias("worse"))


def training_groups(rows: DataFrame) -> DataFrame:
    """Rows with a label, of turns that have both kinds: grade 3 or 0 by engagement."""
    turn = Window.partitionBy("session_id", "turn_index")
    graded = rows.withColumn("label", pseudo_grade(F.col("engaged"))).filter("label IS NOT NULL")
    both = graded.withColumn("_low", F.min("label").over(turn)).withColumn("_high", F.max("label").over(turn))
    return both.filter("_low < _high").drop("_low", "_high")


def windows_engaged(deliveries: DataFrame, responses: DataFrame, windows: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """(layer, w, n, engaged) of deliveries that one of the first w responses after them takes up.

    deliveries: (id, session_id, at, layer, words); responses: (session_id, at, text_words), arrays. Engaged: two
    distinct words or more in one response.
    """
    after = next_rows(deliveries.select("id", "session_id", "at"), responses, "session_id", "at", "id", ["text_words"], max(windows))
    hits = after.join(deliveries.select("id", "words"), "id").select("id", "nth", (F.size(F.array_intersect("words", "text_words")) >= 2).alias("hit"))
    first = hits.filter("hit").groupBy("id").agg(F.min("nth").alias("first"))
    rows = deliveries.select("id", "layer").join(first, "id", "left").select("layer", "first", F.explode(F.array(*map(F.lit, windows))).alias("w"))
    return rows.groupBy("layer", "w").agg(F.count("*").alias("n"), F.count_if(F.col("first") <= F.col("w")).alias("engaged"))


def pseudo_grade(engaged: Column) -> Column:
    """O9."""
    return F.when(engaged == 1, 3).when(engaged == 0, 0)


def label_pairs(rows: DataFrame, group: list[str], gap: int = 2) -> DataFrame:
    """(winner, loser) of each group whose grades differ by `gap` or more."""
    a, b = rows.alias("a"), rows.alias("b")
    on = [F.col(f"a.{g}") == F.col(f"b.{g}") for g in group] + [F.col("a.grade") >= F.col("b.grade") + gap]
    return a.join(b, on).select(*[F.col(f"a.{g}").alias(g) for g in group], F.col("a.id").alias("winner"), F.col("b.id").alias("loser"))


def floor_sweep(rows: DataFrame, floors: list[float], keep: float = 0.95) -> DataFrame:
    """Per floor the share of good rows (grade 3) kept and of noise (grade 0) dropped, and Youden's index.

    Scores are first counted by the number of floors that they reach, so rows aren't multiplied by floors.
    """
    reach = F.lit(0)
    for f in floors:
        reach = reach + (F.col("score") >= f).cast("int")
    counts = rows.filter(F.col("grade").isin(0, 3)).groupBy(reach.alias("reach")).agg(F.count_if(F.col("grade") == 3).alias("good"), F.count_if(F.col("grade") == 0).alias("noise"))
    steps = rows.sparkSession.createDataFrame([(i + 1, float(f)) for i, f in enumerate(sorted(floors))], "step int, floor double")
    total = counts.agg(F.sum("good").alias("all_good"), F.sum("noise").alias("all_noise"))
    got = F.broadcast(steps).join(F.broadcast(counts), F.col("reach") >= F.col("step"), "left").groupBy("floor").agg(F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("noise"), F.lit(0)).alias("noise"))
    out = got.crossJoin(F.broadcast(total)).select("floor", (F.col("good") / F.col("all_good")).alias("kept"), (1 - F.col("noise") / F.col("all_noise")).alias("dropped"))
    return out.withColumn("youden", F.col("kept") + F.col("dropped") - 1).withColumn("allowed", F.col("kept") >= keep)


def ab_decision(arms: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """One row of n_a, n_b, engaged_pct_a, engaged_pct_b, graded_a, graded_b, grade_a, grade_b becomes a decision."""
    few = (F.col("n_a") < p.arm_least) | (F.col("n_b") < p.arm_least) | F.col("engaged_pct_a").isNull() | F.col("engaged_pct_b").isNull()
    gap = F.col("engaged_pct_b") - F.col("engaged_pct_a")
    graded = (F.col("graded_a") >= p.graded_least) & (F.col("graded_b") >= p.graded_least)
    grade = F.col("grade_b") - F.col("grade_a")
    return arms.withColumn("decision", F.when(few, "running").when(gap >= p.arm_gap, "promote").when(gap <= -p.arm_gap, "rollback").when(graded & (grade >= p.grade_gain), "promote").when(graded & (grade <= p.grade_loss), "rollback").otherwise("inconclusive"))


def dead_weight(rows: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Ids delivered often, scored enough, never engaged and never graded above 0. Exempt kinds stay."""
    sums = rows.groupBy("memory_id", "kind").agg(F.count("*").alias("delivered"), F.count("engaged").alias("scored"), F.sum(F.coalesce("engaged", F.lit(0))).alias("engaged"), F.max("grade").alias("max_grade"))
    least = F.when(F.col("kind") == "correction", p.suppress_corrections).otherwise(p.suppress_delivered)
    dead = (F.col("delivered") >= least) & (F.col("scored") >= p.suppress_scored) & (F.col("engaged") == 0) & (F.coalesce("max_grade", F.lit(0)) <= 0)
    return sums.filter(dead & ~F.col("kind").isin(*p.scope_exempt))


def confusion(rows: DataFrame, truth: str, said: str, gate: float = 0.75) -> DataFrame:
    """One row of counts and agreement, and whether it reaches the gate."""
    t, s = F.col(truth) == 1, F.col(said) == 1
    counts = rows.agg(F.count_if(t & s).alias("tp"), F.count_if(~t & s).alias("fp"), F.count_if(t & ~s).alias("fn"), F.count_if(~t & ~s).alias("tn"))
    return counts.withColumn("agreement", F.bround((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")), 4)).withColumn("passes", F.col("agreement") >= gate)


def liveness(events: DataFrame, signals: DataFrame, as_of: Column, window_hours: int, reference: str) -> DataFrame:
    """(signal, last, n, status) of each expected signal: its last time, its rows in the window, and what that means.

    events: (signal, ts), ts null where a time couldn't be read; signals: (signal, max_silence_h), null for those
    that no one waits for. NEVER without a row, RARE without a cadence, UNKNOWN without a readable time, OK within
    the silence allowed; later STALE if the reference signal arrived in the window, and IDLE if that was silent too.
    """
    recent = F.col("ts") >= as_of - F.make_dt_interval(F.lit(0), F.lit(window_hours))
    sums = events.groupBy("signal").agg(F.max("ts").alias("last"), F.count_if(recent).alias("n"), F.count("*").alias("_rows"))
    active = F.max(F.when(F.col("signal") == reference, F.col("n"))).over(Window.partitionBy(F.lit(0))) > 0  # a row a signal
    age = (F.unix_timestamp(as_of) - F.unix_timestamp("last")) / 3600
    silence = F.col("max_silence_h")
    status = F.when(F.col("_rows").isNull(), "NEVER").when(silence.isNull(), "RARE").when(age.isNull(), "UNKNOWN").when(age <= silence, "OK").when(F.coalesce(F.col("_active"), F.lit(False)), "STALE").otherwise("IDLE")
    known = signals.select("signal", "max_silence_h").join(sums, "signal", "left").withColumn("_active", active)
    return known.select("signal", "last", F.coalesce("n", F.lit(0)).alias("n"), status.alias("status"))


def fisher_exact(tables: DataFrame) -> DataFrame:
    """Two-sided exact p of rows (key, a, b, c, d), a vectorised sum over tables with the same margins."""
    @F.pandas_udf("double")
    def p_value(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        from math import exp, lgamma

        def one(a: int, b: int, c: int, d: int) -> float:
            r1, r2, c1 = a + b, c + d, a + c
            ways = lambda n, k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
            logs = [ways(r1, x) + ways(r2, c1 - x) - ways(r1 + r2, c1) for x in range(max(0, c1 - r2), min(r1, c1) + 1)]
            here = ways(r1, a) + ways(r2, c) - ways(r1 + r2, c1)
            return min(1.0, sum(exp(x) for x in logs if x <= here + 1e-9))

        return pd.Series([one(*map(int, x)) for x in zip(a, b, c, d, strict=True)])

    return tables.withColumn("p", p_value("a", "b", "c", "d"))


def version_label(version: Column, known: Column | None = None) -> Column:
    """What wrote a record; null is unversioned, JSON an ingested document, and a record that is gone has no version."""
    label = F.when(version.isNull(), "unversioned").when(version.startswith("{"), "ingest").otherwise(version)
    return label if known is None else F.when(known, label).otherwise("deleted/unknown")

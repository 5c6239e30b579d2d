"""Three nodes, every order of exchange: one state."""

from __future__ import annotations

from itertools import permutations

from memlake.operators.exchange import Replica, exchange

ROWS, GONE, LOG = "id long, v string, lamport long, node string", "id long, deleted_at long, lamport long, node string", "log_uuid string, id long, direction string, reason string, lamport long, node string"


def nodes(spark):
    out = {}
    for n, name in enumerate("abc"):
        r = Replica(name, spark.createDataFrame([], ROWS), spark.createDataFrame([], GONE), spark.createDataFrame([], LOG), spark.createDataFrame([], "node string, lamport long"))
        r = r.write(rows=spark.createDataFrame([(i, f"{name}{i}") for i in (1, 2, 10 + n)], "id long, v string"), log=spark.createDataFrame([(f"{name}-{k}", 1, "+", None) for k in range(n + 1)], "log_uuid string, id long, direction string, reason string"))
        out[name] = r.write(gone=spark.createDataFrame([(2, 50 - n)], "id long, deleted_at long"), log=spark.createDataFrame([(f"{name}-x", 2, "-!", f"why {name}")], "log_uuid string, id long, direction string, reason string"))
    return out


def test_every_order_gives_one_state(spark):
    start, seen = nodes(spark), set()
    assert {r.clock for r in start.values()} == {4}
    for order in list(permutations(["ab", "bc", "ca"]))[1:4:2]:
        now = dict(start)
        for x, y in (*order, order[0]):
            now[x], now[y] = exchange(now[x], now[y])
        for x, y in ("ab", "bc"):  # whoever is still behind
            now[x], now[y] = exchange(now[x], now[y])
        now["a"], now["b"] = exchange(now["a"], now["b"])
        states = {str(sorted(map(str, r.state().collect()))) for r in now.values()}
        assert len(states) == 1
        seen |= states
        last = now["a"].changes(now["c"].vector)
        assert last.rows.count() == last.log.count() == last.gone.count() == 0 and now["a"].clock > 4
    assert len(seen) == 1
    rows = {r.id: r for r in now["a"].state().collect()}
    assert set(rows) == {1, 2, 10, 11, 12} and rows[1].v == "c1" and rows[2].deleted_at == 48 and rows[2].annotation == "why c"
    assert abs(rows[1].confidence - (1 - 0.3 * 0.9**6)) < 1e-9

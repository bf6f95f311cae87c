"""The sync rule by sets against the state machine, message by message, on made-up connections of all four policies."""

import random

import pytest

from depthframe.operators.sync import KEY, sync_actions
from depthframe.operators.sync_sets import marked, sync_actions_by_sets

SCHEMA = "venue string, symbol int, conn_epoch long, recv_seq long, kind string, first_id long, final_id long, prev_final_id long, last_update_id long, extra int"


def connection(rng, policy, key, wild):
    """Messages of one connection: contiguous updates with some lost, snapshots of ids near the present one."""
    rows, final = [], rng.randrange(100)
    for n in range(rng.randint(0, 25)):
        seq = 10 * n + rng.randrange(10)
        if rng.random() < (0.9 if policy in ("bybit", "okx") and n == 0 else 0.2):
            last = final + (rng.randint(-12, 12) if wild else rng.choice([0, 0, 0, 1, -1, -2, -3]))
            rows.append((*key, seq, "SNAPSHOT", None, None, None, last, 1))
            continue
        width = 1 if policy == "bybit" else rng.randint(1, 3)
        lost = rng.choice([1, 2]) if rng.random() < 0.12 else 0
        before = final + lost
        final = before + width
        if wild and rng.random() < 0.15:
            final -= rng.randint(1, 6)
        rows.append((*key, seq, "DELTA", before + 1 if policy != "futures" else before + rng.choice([0, 1]), final, before, None, 1))
    return rows


@pytest.mark.parametrize("policy", ["futures", "spot", "bybit", "okx"])
def test_equal_to_the_state_machine(spark, policy):
    rng = random.Random(policy)
    rows = [r for k in range(1200) for r in connection(rng, policy, (rng.choice("ab"), k % 7, k), k % 3 == 0)]
    rows += [("a", 1, 5000, 7, "DELTA", 1, 2, 0, None, 1), ("a", 1, 5000, 7, "DELTA", 1, 2, 0, None, 1), ("a", None, 5001, 1, "DELTA", None, None, None, None, 1)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4).cache()
    columns = [*KEY, "recv_seq", "ord", "action", "message_seq"]
    ours, exact = (sorted(map(tuple, f(frame, policy).select(*columns).collect()), key=str) for f in (sync_actions_by_sets, sync_actions))
    assert ours == exact
    parts = {r.strange: r.n for r in marked(frame, policy).select(*KEY, "strange").distinct().groupBy("strange").count().withColumnRenamed("count", "n").collect()}
    assert parts[False] > 300 and parts[True] > 50
    taken = {a[5] for a in exact}
    assert taken == {"REQUEST_SNAPSHOT", "SNAPSHOT", "DELTA", "INVALIDATE"}
    assert sync_actions_by_sets(frame.where("false"), policy).count() == 0

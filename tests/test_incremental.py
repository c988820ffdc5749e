"""Chains of increments against full builds."""

import random

from pyspark.sql import functions as F

from stratalens.operators import incremental
from stratalens.sources import registry_files

FACTS = "input string, target string, values array<string>"


def build(facts):
    return registry_files.snapshot_from_mappings(facts, None, "cusip")


def test_increments_end_in_the_full_build(spark):
    rnd = random.Random(5)
    state = {}
    fresh = lambda: [f"BBG{rnd.randrange(9)}" for _ in range(rnd.randint(1, 3))]
    for i in range(40):
        for target in ("figi", "ticker"):
            state[f"c{i}", target] = fresh()
    table = lambda s: spark.createDataFrame([(*k, v) for k, v in s.items()], FACTS)
    now = incremental.full(table(state), build)
    dead = {}
    for step in (2, 3, 4):
        before = {i for i, _ in state}
        updates = {(f"c{rnd.randrange(50)}", rnd.choice(["figi", "ticker"])): rnd.choice([None, fresh(), fresh()]) for _ in range(9)}
        if step == 3:
            updates |= {("c1", t): None for t in ("figi", "ticker")}
        if step == 4:
            updates |= {("c1", "figi"): ["BBG1"]}
        old = dict(state)
        for k, v in updates.items():
            state.pop(k, None)
            if v is not None:
                state[k] = v
        facts = incremental.merged(now.facts, spark.createDataFrame([(*k, v) for k, v in updates.items()], FACTS))
        now, diff = incremental.advance(now, facts.union(facts.limit(1)), build)
        after = {i for i, _ in state}
        of = lambda s, i: {(t, tuple(v)) for (j, t), v in s.items() if j == i}
        want = {i: "added" for i in after - before} | {i: "removed" for i in before - after} | {i: "changed" for i in before & after if of(old, i) != of(state, i)}
        assert {r["input"]: r["change"] for r in diff.collect()} == want
        dead = {i: v for i, v in dead.items() if i not in after} | {i: step for i in before - after}
        assert {r["input"]: r["version"] for r in now.tombstones.collect()} == dead
        whole = incremental.full(table(state), build)
        order = lambda df: sorted(map(str, df.collect()))
        assert order(now.view.select(*whole.view.columns)) == order(whole.view)
        assert now.digest == whole.digest and now.number == step
    assert dead or "c1" in {i for i, _ in state}
    again = incremental.full(table(state).orderBy(F.rand(1)).repartition(3), build)
    assert again.digest == now.digest
    same, diff = incremental.advance(now, now.facts, build)
    assert diff.count() == 0 and same.digest == now.digest
    none = incremental.full(table(state).limit(0), build)
    assert none.digest == "000000000000000-" * 4 + "0"

"""Pointer doubling against walking, and how its rows are spread."""

import random

from terracell.plans import iterate


def test_doubled_equals_walking_in_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(iterate, "ROWS", 20)
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    rng = random.Random(5)
    nodes = [(i, rng.randrange(max(0, i - 6), i) if i % 40 else None, rng.randint(1, 5) * 0.5, float(rng.randint(1, 9))) for i in range(200)]
    frame = spark.createDataFrame([(*n, n[3], 0.0) for n in nodes], "id long, next long, step double, s double, t double, l double")
    got = {r["id"]: r for r in iterate.doubled(frame, up={"s": "sum", "l": "longest"}, down={"t": "sum"}).collect()}
    s, longest, t = {n[0]: n[3] for n in nodes}, dict.fromkeys(range(200), 0.0), {}
    for i, to, step, own in sorted(nodes, reverse=True):
        if to is not None:
            s[to] += s[i]
            longest[to] = max(longest[to], longest[i] + step)
    for i, to, step, own in nodes:
        above = t.get(to, (0.0, 0.0, i))
        t[i] = (above[0] + own, above[1] + (0.0 if to is None else step), above[2])
    assert {i: (r["s"], r["l"], r["t"], r["span"], r["root"]) for i, r in got.items()} == {i: (s[i], longest[i], *t[i]) for i in range(200)}
    assert spark.conf.get("spark.sql.shuffle.partitions") == usual


def test_what_has_arrived_is_not_in_one_task(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        frame = spark.range(4000).selectExpr("id", "if(id % 2 = 1, id - 1, null) as next", "1.0D as step", "1.0D as s")
        done = iterate.doubled(frame, up={"s": "sum"})
        assert max(done.rdd.glom().map(len).collect()) < 2000
        assert done.where("s = if(id % 2 = 0, 2, 1)").count() == 4000
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)

"""Exact samples, and migrations with a ledger."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ledgerfold.operators import migrations, sampling
from ledgerfold.operators.migrations import Ledger, Migration, migrate


def order(k, seed):
    return int(hashlib.md5(f"{seed}:{k}".encode()).hexdigest()[:15], 16), k


@pytest.mark.parametrize("n", [0, 1, 5, 40, 1000])
def test_lowest_is_exact(spark, n):
    rng = random.Random(n)
    rows = [(i, rng.choice(["hot"] * 6 + ["a", "b", None])) for i in range(600)] + [(None, "hot")]
    df = spark.createDataFrame(rows, "k int, s string").repartition(5)
    known = [r for r in rows if r[0] is not None]
    want = {k for s in ("hot", "a", "b", None) for k in sorted((k for k, t in known if t == s), key=lambda k: order(k, 7))[:n]}
    assert sorted(r["k"] for r in sampling.lowest(df, n, "k", stratum="s").collect()) == sorted(want)
    assert {r["k"] for r in sampling.lowest(df, n, "k", seed=3).collect()} == set(sorted((k for k, _ in known), key=lambda k: order(k, 3))[:n])


def test_quotas_and_fill(spark):
    rows = [(i, "abc"[i % 3] if i < 90 else "rare") for i in range(93)]
    df = spark.createDataFrame(rows, "k int, s string")
    out = sampling.quotas_and_fill(df, "s", ["a", "rare", "none"], 10, 40, "k").collect()
    assert len(out) == len({r["k"] for r in out}) == 40
    assert sum(not r["filled"] for r in out) == 13 and sum(r["s"] == "rare" for r in out) == 3
    assert sampling.quotas_and_fill(df, "s", ["a"], 10, 5, "k").filter("filled").count() == 0
    assert sampling.quotas_and_fill(df, "s", ["a"], 10, 500, "k").count() == 93
    assert sampling.quotas_and_fill(df.limit(0), "s", ["a"], 10, 5, "k").count() == 0


def steps(spark, log):
    rows = spark.createDataFrame([("1", "OH"), ("2", None)], "k string, state string")

    def change(number, f):
        def run(tables):
            log.append(number)
            return f(tables)

        return run

    return [
        Migration("002", change("002", lambda t: {"a": migrations.with_column("market", "string")(t["a"])})),
        Migration("001", change("001", lambda t: {"a": rows, "b": rows.limit(1)})),
        Migration("003", change("003", lambda t: {"a": t["a"].withColumn("market", F.when(F.col("state") == "OH", "cuyahoga"))}), after={"no market": lambda t: t["a"].filter("market is null")}),
    ]


def test_migrations_run_once_in_order_and_abort_whole(spark, tmp_path):
    root, log = f"file://{tmp_path}/db", []
    with pytest.raises(ValueError, match="003: no market"):
        migrate(spark, root, steps(spark, log))
    assert log == ["001", "002", "003"]
    ledger = Ledger(spark, root)
    assert [e["number"] for e in ledger.entries()] == ["001", "002"] and ledger.tables()["a"].filter("market is not null").isEmpty()
    fixed = [*steps(spark, log)[:2], Migration("003", lambda t: {"a": t["a"].withColumn("market", F.lit("x"))}, before={"too many": lambda t: t["a"].filter("k > '5'")})]
    now = migrate(spark, root, fixed)
    assert log == ["001", "002", "003"]  # what is applied is not run again
    assert sorted(map(tuple, now["a"].collect())) == [("1", "OH", "x"), ("2", None, "x")] and now["b"].count() == 1
    assert migrate(spark, root, fixed)["a"].count() == 2 and len(ledger.entries()) == 3
    with pytest.raises(ValueError, match="comes before"):
        ledger.apply(Migration("0025", lambda t: {}))


def test_evolved(spark):
    old = spark.createDataFrame([("7", "x", 1)], "n string, gone string, same int")
    out = migrations.evolved(old, "n long, same int, more date")
    assert out.dtypes == [("n", "bigint"), ("same", "int"), ("more", "date")] and tuple(out.first()) == (7, 1, None)

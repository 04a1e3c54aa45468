"""The paged scan, the walk over numbers, and leads that live as state."""

import datetime
import json
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ledgerfold.sources.paged import read_landed_pages
from ledgerfold.streaming import lifetimes, walk

SCHEMA = "id long, name string, day date, amount double"


def land(folder, n, size, count=None):
    for k in range(0, n, size):
        rows = [{"attributes": {"id": i, "name": f"n{i % 3}", "day": f"2024-01-{i % 28 + 1:02d}T00:00", "amount": str(i) if i % 2 else None, "more": 1}} for i in range(k, min(n, k + size))]
        (folder / f"page-{k // size}.json").write_text(json.dumps({"features": rows}))
    (folder / "count.json").write_text(json.dumps({"count": n if count is None else count}))


def scan(spark, folder, size=10, **more):
    return read_landed_pages(spark, str(folder), SCHEMA, size, item="attributes", pages_per_task=2, **more)


def test_scan_and_pushed_filters(spark, tmp_path):
    land(tmp_path, 47, 10)
    df = scan(spark, tmp_path)
    assert df.count() == 47 and df.rdd.getNumPartitions() == 3
    assert df.agg(F.sum("amount")).first()[0] == sum(i for i in range(47) if i % 2)
    some = df.filter((F.col("id") >= 5) & F.col("name").isin("n1", "n2") & F.col("amount").isNotNull() & (F.length("name") == 2))
    plan = some._jdf.queryExecution().executedPlan().toString()
    left = next(line for line in plan.split("\n") if "Filter" in line)  # all other conditions are in the scan
    assert "length(name" in left and " AND " not in left and "BatchScan landed_pages" in plan
    assert sorted(r["id"] for r in some.collect()) == [i for i in range(5, 47) if i % 3 and i % 2]
    assert df.filter(F.col("day") == datetime.date(2024, 1, 3)).count() == 2


@pytest.mark.parametrize("fault", ["error", "short", "missing", "count", "extra"])
def test_a_scan_is_complete_or_fails(spark, tmp_path, fault):
    land(tmp_path, 40, 10, count=45 if fault == "count" else 39 if fault == "extra" else None)
    page = tmp_path / "page-1.json"
    if fault == "error":
        page.write_text(json.dumps({"error": {"code": 400, "message": "Invalid URL"}}))
    elif fault == "short":
        page.write_text(json.dumps({"features": json.loads(page.read_text())["features"][:7]}))
    elif fault == "missing":
        page.unlink()
    with pytest.raises(Exception, match="IncompleteScan"):
        scan(spark, tmp_path).collect()


def test_pages_that_announce_their_total(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"p{k + 1}.json").write_text(json.dumps({"data": {"total": 5, "nodes": [{"id": i, "name": {"x": 1}} for i in range(2 * k, min(5, 2 * k + 2))]}}))
    df = read_landed_pages(spark, str(tmp_path), "id long, name string", 2, rows="data.nodes", total="data.total")
    assert sorted(map(tuple, df.collect())) == [(i, '{"x": 1}') for i in range(5)]
    empty = tmp_path / "empty"
    empty.mkdir()
    with pytest.raises(Exception, match="IncompleteScan"):
        read_landed_pages(spark, str(empty), "id long", 2).collect()
    (empty / "count.json").write_text('{"count": 0}')
    assert read_landed_pages(spark, str(empty), "id long", 2).count() == 0


# --- walk -------------------------------------------------------------------------------------------------------------


def put(folder, ids, part=0, size=10):
    for b in {i // size for i in ids}:
        (folder / f"bin={b}").mkdir(parents=True, exist_ok=True)
        rows = [(i, "EST" if i % 3 else "GDN") for i in sorted(ids) if i // size == b]
        pq.write_table(pa.table({"id": [r[0] for r in rows], "kind": [r[1] for r in rows]}), folder / f"bin={b}" / f"{part}.parquet")


def go(spark, at, **more):
    options = {"scope": {"kind": "EST"}, "misses": 5, "bin_size": 10} | more
    stream = walk.walk_ids(spark, str(at / "landed"), "id long", str(at / "progress/at"), **options)
    query = stream.writeStream.format("parquet").option("path", str(at / "out")).option("checkpointLocation", str(at / "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(r["id"] for r in spark.read.schema("id long").parquet(str(at / "out")).collect())


def test_walk_stops_at_the_frontier_and_goes_on(spark, tmp_path):
    real = [*range(1, 18), 21, 24, 27, 30, 36, 37, 50]  # 21 to 30 are out of scope but are cases; after 30 five numbers are missing
    put(tmp_path / "landed", real)
    scope = lambda ids: [i for i in ids if i % 3]
    assert go(spark, tmp_path) == scope(range(1, 18))
    assert json.loads((tmp_path / "progress/at").read_text()) == {"at": 30}
    assert go(spark, tmp_path) == scope(range(1, 18))  # nothing new, nothing twice
    put(tmp_path / "landed", [33], part=1)  # the gap closes
    assert go(spark, tmp_path) == scope([*range(1, 18), 37])
    put(tmp_path / "landed", [40, 41, 44, 47], part=1)
    assert go(spark, tmp_path) == scope([*range(1, 18), 37, 40, 41, 44, 47, 50])


def test_walk_takes_at_most_max_ids_a_trigger(spark, tmp_path):
    put(tmp_path / "landed", list(range(1, 31)))
    sizes = [len(go(spark, tmp_path, max_ids=12, scope={})) for _ in range(4)]
    assert sizes == [12, 24, 30, 30]


@pytest.mark.parametrize("ids, start, want", [([], 4, (4, False)), ([5, 6], 4, (6, False)), ([10], 4, (4, True)), ([9], 4, (9, False)), ([9, 15, 16], 4, (9, True))])
def test_frontier(ids, start, want):
    assert walk.frontier(iter(ids), start, 5) == want


# --- lifetimes --------------------------------------------------------------------------------------------------------

DAYS = {"code": 4, "tax": 21}
ROW = "parcel_number string, market string, signal_type string, last_seen_at timestamp, clock timestamp"


def test_shuffled_deliveries_give_the_same_leads(spark, tmp_path):
    rng, t0 = random.Random(9), datetime.datetime(2024, 1, 1)
    signals = [(f"p{rng.randrange(12)}", "m", rng.choice(["code", "tax", "off", None]), t0 + datetime.timedelta(hours=rng.randrange(720)), None) for _ in range(150)] + [("p1", "m", "code", None, None)]
    now, wanted = t0 + datetime.timedelta(days=30), {}
    for p, m, k, seen, _ in signals:
        if k and seen:
            first, last, n = wanted.get((p, m, k), (seen, seen, 0))
            wanted[p, m, k] = (min(first, seen), max(last, seen), n + 1)
    want = sorted((*key, "active" if key[2] in DAYS and last + datetime.timedelta(days=DAYS[key[2]]) >= now else "retired", first, last, n) for key, (first, last, n) in wanted.items())
    assert {r[3] for r in want} == {"active", "retired"}
    for order in range(2):
        at = tmp_path / str(order)
        (at / "landed").mkdir(parents=True)
        rng.shuffle(signals)
        stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(f"file://{at}/landed")
        for n in range(3):  # each start goes on with the state of the one before
            tick = (None, None, None, None, now - datetime.timedelta(days=10 * (2 - n)))
            spark.createDataFrame([*signals[n * 60 : n * 60 + 60], tick], ROW).coalesce(1).write.mode("append").parquet(f"file://{at}/landed")
            lifetimes.run_lifetimes(stream, DAYS, f"file://{at}/log", f"file://{at}/checkpoint").awaitTermination()
        log = spark.read.schema(lifetimes.LOG).parquet(f"file://{at}/log")
        got = sorted(tuple(r) for r in lifetimes.current_leads(log).select(*lifetimes.KEYS, "status", "first_seen", "last_seen", "sightings").collect())
        assert got == want
        assert log.groupBy(*lifetimes.KEYS, "version").count().filter("count > 1").isEmpty()
        if order == 0:  # a lead that ran out by its timer, not by a signal
            again = log.groupBy(*lifetimes.KEYS, "sightings").agg(F.count_distinct("status").alias("n"))
            assert not again.filter("n = 2").isEmpty()


def test_a_lead_is_read_and_written_once_and_has_one_timer():
    """Each call to the state is a round trip; a lead that is seen again keeps its timer, which is set anew when it rings too early."""
    calls, now = [], [0]

    class Value:
        kept = None

        def exists(self):
            calls.append("exists")
            return self.kept is not None

        def get(self):
            calls.append("get")
            return self.kept

        def update(self, row):
            calls.append("update")
            self.kept = row

    class Handle:
        def getValueState(self, *a):
            return Value()

        def registerTimer(self, at):
            calls.append(at)

        def deleteTimer(self, at):
            calls.append(-at)

    class Timers:
        def getCurrentWatermarkInMs(self):
            return now[0]

    lead, key, day = lifetimes._Lifetimes({"code": 4}), ("p", "m", "code"), lifetimes.DAY
    lead.init(Handle())
    saw = lambda *at: [tuple(r) for r in lead.handleInputRows(key, iter([{"seen": a} for a in at]), Timers())]
    rang = lambda: [tuple(r) for r in lead.handleExpiredTimer(key, Timers(), None)]
    rings = [4 * day // 1000 + 1, 6 * day // 1000 + 1]
    assert saw(0, None) == [(*key, 1, "active", 0, 0, 1)] and calls == ["get", rings[0], "update"]
    calls.clear()
    assert saw(2 * day, day) == [(*key, 2, "active", 0, 2 * day, 3)] and calls == ["get", "update"]
    calls.clear()
    now[0] = rings[0] + 1
    assert rang() == [] and sorted(map(str, calls)) == sorted(["get", str(rings[1]), "update"])
    now[0] = rings[1] + 1
    assert rang() == [(*key, 3, "retired", 0, 2 * day, 3)]
    calls.clear()
    assert saw(10 * day) == [(*key, 4, "active", 0, 10 * day, 4)] and calls == ["get", 14 * day // 1000 + 1, "update"]

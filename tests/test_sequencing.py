"""The upsert in order against a row-by-row replay, and counts of dry and real runs."""

import datetime
import random
import time

from pyspark.sql import functions as F

from ledgerfold.operators import merging, sequencing

COLUMNS = "source_site string, case_number string, parcel_number string, property_address string, sale_date date, status string, market string, trustee_name string, bid long, last_seen date"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
DAY = datetime.date(2024, 1, 1)


def draw(rng, n, wide):
    pick = lambda xs, p=0.3: None if rng.random() < p else rng.choice(xs)
    some = lambda c: [f"{c}{i}" for i in range(wide)]
    day = lambda: DAY + datetime.timedelta(days=rng.randrange(3))
    return [(rng.choice("st"), pick([*some("C"), ""]), pick([*some("P"), ""]), pick(some("A"), 0.2), None if rng.random() < 0.4 else day(), pick(["active", "gone"], 0.1), rng.choice("mn"), pick("xyz"), pick(range(9)), day()) for _ in range(n)]


def replay(current, batch):
    """One row after the other, as a database would."""
    table = {i: dict(zip(NAMES, r, strict=True)) for i, r in current}
    order = sorted(table)
    for seq, r in batch:
        row = dict(zip(NAMES, r, strict=True))
        here = [i for i in order if table[i]["source_site"] == row["source_site"]]
        case, parcel = row["case_number"] or None, row["parcel_number"] or None
        by_place = [i for i in here if row["property_address"] is not None and table[i]["property_address"] == row["property_address"] and table[i]["sale_date"] == row["sale_date"]]
        if case and parcel:
            hits = [i for i in here if table[i]["case_number"] == case and table[i]["parcel_number"] == parcel]
        elif case:
            hits = [i for i in here if table[i]["case_number"] == case]
        elif parcel:
            hits = [i for i in here if table[i]["parcel_number"] == parcel] or by_place
        else:
            hits = by_place
        if not hits:
            order.append(f"new|{row['source_site']}|{seq}")
            table[order[-1]] = row
            continue
        old = table[hits[0]]
        for c in NAMES:
            if c in ("status", "market"):
                old[c] = row[c]
            elif c == "last_seen":
                old[c] = max(old[c], row[c])
            elif c not in ("case_number", "trustee_name") and row[c] is not None:
                old[c] = row[c]
    return sorted(repr((i, *(table[i][c] for c in NAMES), i.startswith("new|"))) for i in order)


def test_rows_of_a_batch_see_each_other(spark):
    differs = 0
    for seed, wide in ((1, 40), (2, 6), (3, 200)):
        rng = random.Random(seed)
        current = [(f"L{i:03d}", r) for i, r in enumerate(draw(rng, 60, wide))]
        batch = list(enumerate(draw(rng, 120, wide)))
        batch += [(1000 + i, ("s", "HOT", "HOT", f"A{i % 5}", None, "active", "m", None, i if i % 3 else None, DAY)) for i in range(50)]  # one key, plain
        a = spark.createDataFrame([(i, *r) for i, r in current], "id string, " + COLUMNS)
        b = spark.createDataFrame([(i, *r) for i, r in batch], "seq long, " + COLUMNS).repartition(3)
        out = sequencing.upsert_in_order(a, b, "seq")
        want = replay(current, batch)
        assert sorted(repr(tuple(r)) for r in out.select("id", *NAMES, "is_new").collect()) == want
        differs += len(want) != a.count() + len(batch)
    assert differs == 3


def test_sequencing_edges(spark):
    rng = random.Random(4)
    rows = draw(rng, 5, 5)
    a = spark.createDataFrame([(f"L{i}", *r) for i, r in enumerate(rows)], "id string, " + COLUMNS)
    b = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, " + COLUMNS)
    assert sorted(map(tuple, sequencing.upsert_in_order(a, b.limit(0), "seq").drop("is_new").collect()), key=repr) == sorted(map(tuple, a.collect()), key=repr)
    into_empty = sequencing.upsert_in_order(a.limit(0), b, "seq")
    assert sorted(repr(tuple(r)) for r in into_empty.select("id", *NAMES, "is_new").collect()) == replay([], list(enumerate(rows)))


def test_chains_are_connected(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in sequencing.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {100: 100, 101: 100, 102: 100}


def test_a_dry_run_counts_as_the_real_one(spark, tmp_path):
    current = spark.createDataFrame([(i, "m", i * 10, "x") for i in range(30)], "k int, market string, v int, note string")
    batch = spark.createDataFrame([(i, "m", i * 10 if i % 2 else i * 10 + 1, None) for i in range(20, 40)] + [(None, "m", 1, "y")], "k int, market string, v int, note string")
    merged = merging.upsert(current, batch, ["k", "market"], mark_changes=True)
    dry, real = merging.write_counted(merged, None), merging.write_counted(merged, f"file://{tmp_path}/t")
    assert dry == real == {"rows": 41, "inserted": 11, "updated": 5, "confirmed": 5, "untouched": 20}
    written = spark.read.parquet(f"file://{tmp_path}/t")
    assert written.columns == current.columns and written.count() == 41
    assert merging.snapshot_diff(current.filter("k is not null"), written.filter("k is not null"), "k", "v").groupBy("change").count().orderBy("change").collect() == [("added", 10), ("changed", 5)]


def test_keys_that_no_row_looks_up_link_nothing(spark, monkeypatch):
    """One case over many parcels: rows with case and parcel find one listing each, so there are as many components as listings, of two rows each."""
    n, parts = 300, []
    a = spark.createDataFrame([(f"L{i:03d}", "s", "CASE", f"P{i}", "SHARED", None, "active", "m", None, i, DAY) for i in range(n)], "id string, " + COLUMNS)
    rows = [(2 * i, "s", "CASE", f"P{i}", f"MOVED {i}", None, "active", "m", None, i, DAY) for i in range(n)] + [(2 * i + 1, "s", None, None, f"MOVED {i}", None, "gone", "m", None, -i, DAY) for i in range(n)]
    known = sequencing.connected
    monkeypatch.setattr(sequencing, "connected", lambda edges: parts.append(known(edges)) or parts[-1])
    out = sequencing.upsert_in_order(a, spark.createDataFrame(rows, "seq long, " + COLUMNS), "seq").select("id", "property_address", "status", "bid", "is_new")
    assert sorted(map(tuple, out.collect())) == [(f"L{i:03d}", f"MOVED {i}", "gone", -i, False) for i in range(n)]
    assert parts[0].select("component").distinct().count() == n


def test_a_long_component_is_replayed_in_one_pass():
    """Forty thousand rows at one address each go to a listing of their own; looking at every listing for every row would take minutes."""
    n = 40_000
    values = ["source_site", "case_number", "parcel_number", "property_address", "sale_date", "status"]
    row = lambda i, seq, place: dict(zip(["id", *values, "_seq"], [None if seq is not None else f"L{i:06d}", "s", f"C{i}", None, place, None, "gone" if seq is not None else "active", seq], strict=True))
    began = time.monotonic()
    out = sequencing._Replay(values, set(values), "parcel_number", "last_seen")([row(i, None, "HERE") for i in range(n)] + [row(i, i, "THERE") for i in range(n)])
    assert time.monotonic() - began < 30
    assert [(t["id"], t["property_address"], t["status"]) for t in out] == [(f"L{i:06d}", "THERE", "gone") for i in range(n)]


def test_empty_addresses_and_unknown_sites(spark):
    """An empty address is an address like others, an unknown site equals none."""
    rows = [(1, "s", None, None, "", None, "active", "m", None, 1, DAY), (2, "s", None, None, "", None, "gone", "m", None, 2, DAY), (3, None, "C", None, "A", None, "active", "m", None, 3, DAY), (4, None, "C", None, "A", None, "gone", "m", None, 4, DAY)]
    b = spark.createDataFrame(rows, "seq long, " + COLUMNS)
    out = sequencing.upsert_in_order(b.limit(0).drop("seq").withColumn("id", F.lit("x")), b, "seq")
    assert sorted(tuple(r) for r in out.select("bid", "status").collect()) == [(2, "gone"), (3, "active"), (4, "gone")]

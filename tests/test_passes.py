"""The upsert cascade, gates, cursors, keys and attributes on hand-made rows: nulls, ties and transitions."""

import datetime
import random

from pyspark.sql import functions as F

from ledgerfold.functions import addresses, attributes, keys
from ledgerfold.operators import lifecycle, passes, policies, reading
from ledgerfold.streaming import delta

DAY = datetime.date
LISTING = "id string, source_site string, case_number string, parcel_number string, property_address string, sale_date date, status string, market string, trustee_name string, last_seen date"


def upserted(spark, current, batch):
    now = spark.createDataFrame(current, LISTING)
    rows = spark.createDataFrame(batch, "seq int, " + LISTING.removeprefix("id string, "))
    return {r.id: r for r in passes.upsert_listings(now, rows, "seq").collect()}


def test_a_row_gets_its_parcel_by_its_address(spark):
    old = [("x", "s", None, None, "1 Main St", None, "active", "wayne", "T", DAY(2024, 1, 1)), ("y", "s", None, None, "1 Main St", DAY(2024, 5, 1), "active", "wayne", None, DAY(2024, 1, 1))]
    got = upserted(spark, old, [(1, "s", None, "P1", "1 Main St", None, None, "wayne", "other", DAY(2024, 2, 1))])
    assert set(got) == {"x", "y"} and got["x"].parcel_number == "P1" and not got["x"].is_new
    assert got["x"].status is None and got["x"].trustee_name == "T"  # status overwrites even with null, the trustee is never touched
    assert got["y"].parcel_number is None and got["x"].last_seen == DAY(2024, 2, 1)


def test_the_cascade_tells_cases_and_parcels_apart(spark):
    old = [("a", "s", "C1", "P1", "1 A St", None, "active", "m", None, None), ("b", "s", "C1", "P2", "2 A St", None, "active", "m", None, None), ("c", "t", None, "P1", None, None, "active", "m", None, None)]
    batch = [
        (1, "s", "C1", "P2", "9 B St", None, "sold", "m", None, None), (2, "s", "C1", "P3", "3 A St", None, "active", "m", None, None), (3, "s", "C1", "", "4 A St", None, "gone", "m", None, None),
        (4, "t", "", "P1", "5 A St", None, "active", "m", None, None), (5, "t", None, None, None, None, "active", "m", None, None), (6, "t", None, None, None, None, "active", "m", None, None),
        (7, "s", "C1", "P2", None, None, "back", "m", None, None),
    ]
    got = upserted(spark, old, batch)
    assert got["b"].status == "back" and got["b"].property_address == "9 B St"
    assert got["a"].status == "gone" and got["a"].property_address == "4 A St"  # a case alone takes the smallest id
    assert got["case and parcel|s|C1|P3"].is_new and got["c"].property_address == "5 A St"
    assert sum(r.is_new for r in got.values()) == 3  # null addresses equal nothing


def test_gates_and_odd_numbers(spark):
    rows = [(1, '{"b": "2000"}'), (2, '{"b": "1.2.3"}'), (3, '{"b": "1999.99", "f": "true"}'), (4, None), (5, '{"b": ""}'), (6, '{"b": 2500, "c": "5x"}'), (7, "not json")]
    df = spark.createDataFrame(rows, "id int, payload string")
    keep = lambda gate: {r.id for r in df.filter(gate).collect()}
    assert keep(passes.balance_gate("b", 2000)) == {1, 6}
    assert keep(passes.balance_gate("b", 2000, or_true="f")) == {1, 3, 6}
    assert keep(passes.balance_gate("b", 2000, with_prefix=("c", "5"))) == {6}
    assert df.filter(~passes.open_or_graded_gate("s", "g") & ~passes.in_collections_gate() & ~passes.open_since_gate("s", "o", F.lit(datetime.datetime(2024, 1, 1)))).count() == 7


def test_cursor_against_a_plain_walk(spark):
    rng = random.Random(3)
    for _ in range(12):
        ids, misses = sorted(rng.sample(range(1, 400), rng.randrange(1, 80))), rng.randrange(1, 12)
        at, frontier = 20, False
        for i in ids:
            if i > at:
                if i - at > misses:
                    frontier = True
                    break
                at = i
        assert delta.advance_cursor(spark.createDataFrame([(i,) for i in ids], "id long"), 20, misses) == (at, frontier), (ids, misses)


def test_windows_advance_only_past_success(spark):
    row = lambda d, ok: (DAY(2024, 1, d), DAY(2024, 1, d + 1), ok)
    kind = "start date, end date, ok boolean"
    assert delta.window_cursor(spark.createDataFrame([row(1, True), row(2, True), row(3, None), row(4, True)], kind)) == DAY(2024, 1, 3)
    assert delta.window_cursor(spark.createDataFrame([row(1, False)], kind), DAY(2023, 12, 1)) == DAY(2023, 12, 1)
    assert delta.window_cursor(spark.createDataFrame([], kind)) is None


def test_rechecks_do_not_multiply_rows(spark):
    listings = spark.createDataFrame([("a", "C", "active", "Open"), ("b", None, "active", None)], "id string, case_number string, status string, case_status string")
    checked = spark.createDataFrame([("C", "Open"), ("C", "Dismissed"), ("C", None)], "case_number string, case_status string")
    assert {(r.id, r.status) for r in policies.recheck(listings, checked).collect()} == {("a", "expired"), ("b", "active")}


def test_transfers_need_an_active_row(spark):
    schema = "id string, market string, signal_type string, status string, parcel_number string, case_number string, first_seen date, filing_date date"
    rows = [
        ("a", "m", "probate", "active", "P", "2024EST1", DAY(2025, 1, 1), None), ("b", "m", "probate", "not_listed", "P", "2024EST1", DAY(2025, 1, 1), None), ("c", "m", "probate", "active", "P", "PR1", DAY(2025, 1, 1), DAY(2024, 6, 1)),
        ("d", "dayton", "mortgage_foreclosure", "active", "P", "2024CV1", DAY(2025, 1, 1), None), ("e", "m", "mortgage_foreclosure", "active", "P", "2024CV1", DAY(2025, 1, 1), None), ("f", "m", None, "active", "P", None, DAY(2024, 1, 1), None), ("g", "m", None, "active", None, None, DAY(2024, 1, 1), None),
    ]
    sales = spark.createDataFrame([("P", DAY(2024, 6, 1))], "parcel_number string, last_sale_date date")
    out = {r.id: r.status for r in lifecycle.mark_transferred(spark.createDataFrame(rows, schema), sales).collect()}
    assert out == {"a": "transferred", "b": "not_listed", "c": "transferred", "d": "transferred", "e": "active", "f": "transferred", "g": "active"}


def test_latest_row_has_a_total_order(spark):
    at = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([("k", at, "b"), ("k", at, "a"), ("k", None, "0"), ("n", None, "z")], "k string, at timestamp, tie string")
    assert {(r.k, r.tie) for r in reading.latest_per_key(df, ["k"], "at", "tie").collect()} == {("k", "a"), ("n", "z")}


def test_keys_and_attributes(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first()[0]
    assert value(keys.house_key(F.lit("12B North  Walnut Circle, Toledo"), F.lit("43604-11"))) == "12B|N|WALNUT|43604"
    assert value(keys.house_key(F.lit("Walnut Circle"), F.lit(None))) is None and value(keys.house_key(F.lit("12 Street"), F.lit(None))) is None
    assert value(keys.zip_after_house(F.lit("12345 Main St"))) is None and value(keys.any_zip(F.lit("12345 Main St"))) == "12345"
    assert value(keys.city_free_key(F.lit("3875 W. Kirby, Détroit, MI 48208"))) == "3875 w kirby" and value(keys.city_free_key(F.lit(" . "))) is None
    assert value(keys.same_address(F.lit("3466 W. 128TH STREET"), F.lit("3466 W 128 St"))) and not value(keys.same_address(F.lit(None), F.lit("1 A St")))
    assert value(attributes.pg_initcap(F.lit("o'brien-smith x2y"))) == "O'Brien-Smith X2y"
    assert value(attributes.lot_parcels(F.lit("Vacant Lot: 1-2 & 3-4, 1-2 and 5"))) == ["1-2", "3-4", "5"]
    assert value(attributes.safe_int(F.lit("12.9"))) == 12 and value(attributes.safe_int(F.lit("1e3"))) is None and value(attributes.safe_number(F.lit(" "))) is None
    assert tuple(value(attributes.sheriff_outcome(F.lit("FORFEIT, not sold")))) == ("expired", "tax_delinquent_foreclosure")
    long = "X" + "y" * 5000
    assert value(addresses.canonical_city(F.lit(long.upper()))) == long  # no token is cut

"""Golden cases of the normalisers."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerfold.functions import addresses, names, parcels, values

GENERAL = [
    ("11019068", "110-19-068"), ("110-19-068", "110-19-068"), (None, None), ("", None), ("   ", None), ("  11019068  ", "110-19-068"), ("02213042", "022-13-042"), ("UNKNOWN-PARCEL", "UNKNOWN-PARCEL"),
    ("7000697", "7000697"), ("0101379", "0101379"), ("67-08383", "6708383"), ("101379", "0101379"), ("07204700000160", "07204700000160"), ("072047  00016", "07204700000160"),
    ("D0217   00225", "D0217000002250"), ("07204700016", "07204700000160"), ("074037 H00081", "0740370H000810"), ("D0222   00514C", "D022200000514C"), ("R72 11703 0016", "R72117030016"),
    ("R72-11703-0016", "R72117030016"), ("r72 11703 0016", "R72117030016"), ("R72410822 0018", "R724108220018"), ("43-031-001", "430-31-001"), ("02000184.", "02000184."), ("02000185-6", "02000185-6"),
    ("03001910.001", "03001910.001"), ("04349092S", "043-49-092"),
]
LUCAS = [("12-10314", "1210314"), ("04349092s", "04349092S"), ("043-49-092S", "04349092S"), ("02188002", "02188002"), (None, None), ("S", "S")]


def column(spark, rows, fn, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.select(fn(F.col("x")).alias("y"), "i").orderBy("i").collect()]


def test_parcel_numbers(spark):
    assert column(spark, [a for a, _ in GENERAL], parcels.parcel_number) == [b for _, b in GENERAL]
    assert column(spark, [a for a, _ in LUCAS], parcels.parcel_number_lucas) == [b for _, b in LUCAS]
    assert column(spark, ["04349092S"], lambda c: parcels.parcel_number_for(c, F.lit("lucas"))) == ["04349092S"]
    assert column(spark, ["11019068"], lambda c: parcels.parcel_number_for(c, F.lit("elsewhere"))) == ["110-19-068"]


def test_addresses(spark):
    cases = {"108 CEDAR DRIVE": "108 Cedar Dr", "108 Cedar Dr": "108 Cedar Dr", "12 north main street apt 4B": "12 N Main St apt 4B", "  5   e.  oak  AVE. ": "5 E Oak Ave", "": None, "9 Way #2": "9 Way #2", "77 A&amp;B Road": "77 A&b Rd"}
    assert column(spark, list(cases), addresses.canonical_address) == list(cases.values())
    keys = {"1234 Elm Street, Cleveland, OH 44101": "1234 elm st", "1234 elm": "1234 elm", "1234 Elm Cleveland": "1234 elm", "10 Oak Ave Shaker Heights": "10 oak ave", "10 oak": "10 oak"}
    assert column(spark, list(keys), addresses.match_address) == list(keys.values())
    assert column(spark, ["12 Main St", " 5 x", "Main St", None], addresses.has_street_number) == [True, True, False, None]
    assert column(spark, ["SUMMIT COUNTY", "cuyahoga county ", "o&#39;brien", "  "], addresses.canonical_county) == ["Summit", "Cuyahoga", "O'brien", None]
    assert column(spark, ["1 A St, Dayton, OH 45406-1234", "no zip"], addresses.zip5) == ["45406", None]
    assert column(spark, ["1 A St, Dayton, OH 45406", "x"], addresses.city_of) == ["Dayton", None]
    assert column(spark, ["12 North Oak Street", "12 Oak"], addresses.loose_street_key) == ["12 n oak", "12 oak"]


@pytest.mark.parametrize(("a", "b", "low", "high"), [("Ada Stone", "ADA STONE", 1.0, 1.0), ("Harris", "HARRIS MARY", 0.0, 0.0), ("Darvis Harris", "HARRIS, MARY", 0.0, 0.74), ("Ada B. Stone", "STONE ADA B", 0.85, 1.0), ("José Núñez", "NUNEZ JOSE", 1.0, 1.0)])
def test_name_confidence(spark, a, b, low, high):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(names.name_confidence(F.col("a"), F.col("b"))).first()[0]
    assert low <= got <= high


def test_surnames(spark):
    assert column(spark, ["Stone, Ada M", "Ada M Stone Jr", "Ada Stone AKA Ada Rock", "", None], names.decedent_surname) == ["STONE", "STONE", "STONE", None, None]
    assert column(spark, ["STONE ADA", "X", None], names.owner_surname) == ["STONE", None, None]
    assert column(spark, ["Ada B. Stone", "STONE, ADA B", "NORTH STAR HOMES LLC", "Ada"], names.name_key) == ["STONE ADA", "STONE ADA", None, None]
    assert column(spark, ["ACME Homes LLC", "Homestead Ada", None], names.is_entity) == [True, False, None]


def test_values(spark):
    assert column(spark, ["$81,000.00", "", None, "$0.00", "1.2.3"], values.money) == [Decimal("81000.00"), None, None, None, None]
    day = datetime.date(2024, 3, 5)
    assert column(spark, ["2024-03-05", "3/5/2024", "03-05-2024", "05-MAR-2024", "20240305", "March 5th, 2024", "x", "1/1/1850", None], values.any_date) == [day] * 6 + [None] * 3
    assert column(spark, ["tax_deed", "eviction_notice", "", None], values.dimension) == ["Tax Distress", "Eviction Notice", None, None]
    assert column(spark, ["2024 CV 01948 (0)", "2024 CV 01948"], values.case_base) == ["2024 CV 01948"] * 2
    assert column(spark, ["A b/c"], values.quoted) == ["A%20b/c"]
    assert column(spark, ["CLOSED", "Open", "Pending review", None], values.violation_bucket) == ["Closed", "Open", "Pending", "Unknown"]

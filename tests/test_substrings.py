"""Joins on contained text against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerfold.operators import substrings


def like(pattern, text):
    """Whether the text contains the pattern, with % and _ as in LIKE."""
    parts = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern.lower())
    return re.search(parts, text.lower(), re.S) is not None


def tables(seed, n=120):
    rng = random.Random(seed)
    piece = lambda k: "".join(rng.choice("abA_% 1é") for _ in range(rng.randint(0, k)))
    texts = [(i, rng.choice("xyz"), piece(14)) for i in range(n)] + [(n, "x", None), (n + 1, None, "aaa"), (n + 2, "y", "aaa"), (n + 3, "y", "aaa")]
    asked = [(i, rng.choice("xyz"), piece(5), piece(2)) for i in range(n)] + [(n, "x", None, "a"), (n + 1, None, "a", "a"), (n + 2, "y", "aaa", "a"), (n + 3, "y", "aaa", "a"), (n + 4, "y", "%_", "")]
    return texts, asked


@pytest.mark.parametrize("wildcards", [False, True])
@pytest.mark.parametrize("block", [(), ("b",)])
def test_contains_join_equals_brute_force(spark, wildcards, block, monkeypatch):
    monkeypatch.setattr(substrings, "HOT_SHARE", 1 / 20)  # so that grams are split
    texts, asked = tables(1)
    t = spark.createDataFrame(texts, "tid int, b string, t string")
    q = spark.createDataFrame(asked, "qid int, b string, p1 string, p2 string")
    if not block:
        t, q = t.drop("b"), q.drop("b")
    got = sorted((r["qid"], r["tid"]) for r in substrings.contains_join(q, t, patterns=["p1", "p2"], text="t", block=block, wildcards=wildcards).select("qid", "tid").collect())
    holds = like if wildcards else lambda p, x: p.lower() in x.lower()
    letters = lambda p: re.sub("[%_]", "", p) if wildcards else p
    want = sorted(
        (i, j) for i, b, p1, p2 in asked for j, c, x in texts
        if None not in (p1, p2, x) and letters(p1 + p2) and (not block or (b is not None and b == c)) and holds(p1, x) and holds(p2, x)
    )
    assert got == want and len(want) > 50


def test_nothing_to_look_up(spark):
    t, q = spark.createDataFrame([(1, "abc")], "tid int, t string"), spark.createDataFrame([(1, "%"), (2, None)], "qid int, p string")
    out = substrings.contains_join(q, t, patterns=["p"], text="t", wildcards=True)
    assert out.columns == ["qid", "p", "tid", "t"] and out.count() == 0
    assert substrings.contains_join(q.limit(0), t, patterns=["p"], text="t").count() == 0
    assert substrings.contains_join(q, t.limit(0), patterns=["p"], text="t").count() == 0


def test_house_and_street(spark):
    cases = {
        "12 Ridgewood Road": ("12", "Ridgewood"), "12  Ridgewood Rd.": ("12", "Ridgewood"), "12 Main": ("12", "Main"), "12 Court": ("12", "Court"), "12 St Ct": (None, None), "Main Street": (None, None), "12": (None, None), "": (None, None), None: (None, None),
        "7 Martin Luther King Jr Boulevard": ("7", "Martin Luther King J"), "12b Oak": (None, None),
    }
    house, street = substrings.house_and_street(F.col("a"))
    got = {r["a"]: (r["h"], r["s"]) for r in spark.createDataFrame([(a,) for a in cases], "a string").select("a", house.alias("h"), street.alias("s")).collect()}
    assert got == cases


def test_address_candidates(spark):
    spine = spark.createDataFrame([("p1", "12 RIDGEWOOD RD"), ("p2", "112 Ridgewood Ct"), ("p3", "12 OAK"), ("p4", None), ("p5", "12 Ridgexwood")], "parcel string, situs_address string")
    asked = spark.createDataFrame([("a", "12 Ridgewood Road"), ("b", "12 ridge_wood St"), ("c", None)], "id string, address string")
    assert sorted((r["id"], r["parcel"]) for r in substrings.address_candidates(asked, spine).collect()) == [("a", "p1"), ("a", "p2"), ("b", "p5")]

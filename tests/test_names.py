"""Names in ASCII for every character, and blocks of names that hold a third of all."""

import random
import sys
import unicodedata

from pyspark.sql import functions as F

from ledgerfold.functions.names import fold_name, name_confidence, to_ascii
from ledgerfold.operators import resolving


def test_every_character_as_python_decomposes_it(spark):
    chars = [chr(i) for i in range(1, sys.maxunicode + 1) if not 0xD800 <= i <= 0xDFFF]
    texts = ["".join(chars[i : i + 997]) for i in range(0, len(chars), 997)] + [f"a{c}b" for c in chars[:0x3100]]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", to_ascii(F.col("t")).alias("a")).collect()
    for r in rows:
        assert r["a"] == unicodedata.normalize("NFKD", texts[r["i"]]).encode("ascii", "ignore").decode()


def test_folded_names(spark):
    cases = {"José  O'Néill": "jose o neill", "ﬁlmore ½ Ⅳ": "filmore 12 iv", "Łukasz Straße": "ukasz strae", "Ｓｍｉｔｈ": "smith", "x́y": "xy", "": "", None: None}
    got = {r[0]: r[1] for r in spark.createDataFrame([(c,) for c in cases], "n string").select("n", fold_name(F.col("n"))).collect()}
    assert got == cases


def test_hot_blocks_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(resolving, "HOT_LEAST", 3)
    monkeypatch.setattr(resolving, "HOT_SHARE", 1 / 500)
    rng = random.Random(1)
    given = ["john", "jon", "johanna", "mary", "marie", "christopher", "kristopher", "christophe", "al", "xavier"]
    name = lambda: " ".join([*(["smith"] if rng.random() < 0.4 else [rng.choice(["smithe", "smits", "braun", "brown", "montgomery", "montgomory"])]), *rng.sample(given, rng.choice([1, 2]))])
    owners, asked = sorted({name() for _ in range(150)}), sorted({name() for _ in range(80)})
    o, q = spark.createDataFrame([(x,) for x in owners], "owner string"), spark.createDataFrame([(x,) for x in asked], "query string")
    got = sorted(map(tuple, resolving.fuzzy_name_join(q, o, query="query", owner="owner").collect()))
    pairs = spark.createDataFrame([(a, b) for a in asked for b in owners], "query string, owner string").withColumn("confidence", name_confidence(F.col("query"), F.col("owner")))
    assert got == sorted(map(tuple, pairs.filter("confidence >= 0.75").collect())) and len(got) > 200

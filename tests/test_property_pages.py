"""Property pages, calendars, links and character references."""

import datetime
import html
import random
import urllib.parse
from html.entities import html5

from pyspark.sql import functions as F

from ledgerfold.functions import links
from ledgerfold.functions.addresses import canonical_city, unescape
from ledgerfold.sources import property_pages as P


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "h string").select(column(F.col("h")).alias("x")).first()["x"]


def test_unescape_as_python(spark):
    rng = random.Random(1)
    names = list(html5)
    texts = [f"a &{n} b" for n in names] + [f"x&{n}y" for n in names if not n.endswith(";")] + ["&#233;&#xE9;&#x1F600;&#65", "&", "&&amp;", "&nosuch;", "&#0;", "&#xD800;", "&#1114112;", "a & b", "", "&amp;lt;"]
    texts += ["".join(rng.choice(["&amp;", "&eacute", "&#39;", "&", ";", "x", " ", "&notit;", "&ltx"]) for _ in range(6)) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", unescape(F.col("t")).alias("u")).collect()
    for r in rows:
        assert r["u"] == html.unescape(texts[r["i"]]), texts[r["i"]]
    assert one(spark, " s&atilde;o   paulo ", canonical_city) == "São Paulo" and one(spark, None, canonical_city) is None


def test_quotes_as_python(spark):
    texts = ["a b/c*d~e_f.g-h", "é ü, #3 & 50% + 1", "", "'()!"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", links.quote(F.col("t")).alias("q"), links.quote(F.col("t"), slash=False).alias("n"), links.quote_plus(F.col("t")).alias("p")).collect()
    for r in rows:
        assert (r["q"], r["n"], r["p"]) == (urllib.parse.quote(r["t"]), urllib.parse.quote(r["t"], safe=""), urllib.parse.quote_plus(r["t"]))


PAGE = '<h1>Gas</h1><div class="x dataBody"><b>Description</b><span>LOT 5 &amp; 6</span><p>Land Use</p><p>5100 - 1-FAMILY</p><p>Gas</p><p>Water</p><p>PUBLIC</p><p>Sewer</p><p>Top</p><p>Gas</p> <p>YES</p><p>Zoning Use</p></div>'


def test_label_values(spark):
    got = one(spark, PAGE, P.label_values).asDict()
    assert {k: v for k, v in got.items() if v is not None} == {"legal_description": "LOT 5 & 6", "land_use_code": "5100", "land_use_description": "1-FAMILY", "util_water": "PUBLIC", "util_gas": "YES"}
    assert not any(one(spark, "<div>no body</div>", P.label_values).asDict().values()) and not any(one(spark, "", P.label_values).asDict().values())


def test_transfer_history(spark):
    head = "<p>1/1/2024</p><H3>Transfer History</H3>"
    read = lambda h: tuple(one(spark, h, P.transfer_history))
    assert read(head + "Transfer Date: 3/4/2019 Sales Amt: $0 x Transfer Date: 12/31/2020 Sales Amt $125,000.50") == (True, datetime.date(2020, 12, 31), 0.0, 2)
    assert read(head + "<td>3/4/2019</td><td>Sales Amt</td><td>$95,000</td> 99/99/2020") == (True, datetime.date(2019, 3, 4), 95000.0, 1)
    assert read(head + "No Information Found 3/4/2019") == read(head + "nothing") == read("3/4/2019") == read(None) == (False, None, None, 0)


def test_calendar_sales(spark):
    cell = lambda day, text: f'<div class="CALBOX" dayid="{day}">{text}</div>' + " " * 900
    entry = '<span class="CALTEXT">Foreclosure</span>'
    page = cell("01/05/2024", entry) + cell("01/09/2024", entry) + cell("01/10/2024", entry) + cell("01/12/2024", "") + cell("12/29/2023", entry) + cell("13/45/2024", entry)
    got = one(spark, page, lambda h: P.calendar_sales(h, F.lit("2024-01-05").cast("date")))
    assert [tuple(x) for x in got] == [(datetime.date(2024, 1, 5), "mortgage_foreclosure"), (datetime.date(2024, 1, 9), "tax_delinquent_foreclosure")]

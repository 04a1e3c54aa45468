"""Queries over landed text, markup and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerfold.plans import tables
from ledgerfold.plans.registry import query
from ledgerfold.sources import delimited, pages, prose
from ledgerfold.streaming import delta


@query("select o_orderkey as k, 'CV-' || o_custkey as case_number, o_totalprice::decimal(18,2)::double as bid, o_orderdate::date as day, 'DAYTON' as city, lpad((o_custkey % 99999)::varchar, 5, '0') as zip from orders", prelude=False)
def token_template_parse(t):
    o = t.orders
    blob = F.concat(F.lit("@ACase #: CV-"), F.col("o_custkey").cast("string"), F.lit("@GOpening Bid: $"), F.format_number("o_totalprice", 2), F.lit("@GSale: "), F.date_format("o_orderdate", "M/d/yyyy"), F.lit("@GDAYTON , "), F.lpad((F.col("o_custkey") % 99999).cast("string"), 5, "0"), F.lit("@A "))
    items = o.select(F.col("o_orderkey").alias("k"), F.explode(pages.template_fields(blob)).alias("m"))
    return items.select("k", F.col("m")["Case #"].alias("case_number"), F.regexp_replace(F.col("m")["Opening Bid"], r"[^0-9.]", "").cast("double").alias("bid"), F.to_date(F.col("m")["Sale"], "M/d/yyyy").alias("day"), F.btrim(F.split_part(F.col("m")["__city_zip__"], F.lit(","), F.lit(1))).alias("city"), F.btrim(F.split_part(F.col("m")["__city_zip__"], F.lit(","), F.lit(2))).alias("zip"))


@query("select conv_id, count(*) as blocks, sum(length(b))::bigint as chars from (select conv_id, unnest(regexp_extract_all(text, '(?s)\\n[^\\n]*')) b from conversations) group by conv_id", prelude=False)
def text_case_blocks(t):
    blocks = prose.case_blocks(t.conversations.select("conv_id", "text"), "text", r"\n")
    return blocks.groupBy("conv_id").agg(F.count("*").alias("blocks"), F.sum(F.length("block")).cast("long").alias("chars"))


@query("select o_custkey % 100 as book, record, arg_min({'h': h}, n).h as header, string_agg(line, chr(10) order by n) as body from (select *, sum(starts) over w record, last_value(case when head then line end ignore nulls) over w h from (select o_custkey, o_orderkey n, case when o_orderkey % 7 = 0 then 'TOWN ' || o_orderstatus else o_orderpriority || ' ' || o_orderkey end line, o_orderkey % 7 = 0 head, (o_orderkey % 7 <> 0 and o_orderpriority[1] = '1')::int starts from orders) window w as (partition by o_custkey % 100 order by n rows unbounded preceding)) where not head and record > 0 group by 1, 2", prelude=False)
def pdf_state_machine(t):
    o = t.orders
    line = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("TOWN "), F.col("o_orderstatus"))).otherwise(F.concat(F.col("o_orderpriority"), F.lit(" "), F.col("o_orderkey").cast("string")))
    lines = o.select((F.col("o_custkey") % 100).alias("book"), F.col("o_orderkey").alias("n"), line.alias("line"))
    return prose.list_state_machine(lines, "book", "n", "line", header="^TOWN", start="^1-").select("book", "record", "header", "body")


@query(r"""select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?s)<!--.*?-->|<[^>]*>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g')) as text from pages""", prelude=False)
def html_text(t):
    return t.pages.select("page_id", pages.strip_tags(F.col("html")).alias("text"))


@query("select c_custkey as custkey, first_order, o_totalprice as price from (select c_custkey, min(o_orderkey) first_order from customer join orders on c_custkey = o_custkey group by 1) join orders on o_orderkey = first_order", prelude=False)
def registry_first_seen(t):
    rows = t.orders.select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("first_order"), F.col("o_totalprice").alias("price"))
    return delimited.first_seen(rows, "custkey", "first_order").join(t.customer.select(F.col("c_custkey").alias("custkey")), "custkey", "left_semi").select("custkey", "first_order", "price")


@query("select user_id, event_type, arg_max(ts, event_id) filter (ts is not null) as seen, arg_max(value, event_id) filter (value is not null) as value from events group by 1, 2", prelude=False)
def stream_delta_merge(t):
    """Events as a stream of deltas, merged by user and type into a versioned table."""
    spark = t.spark
    where = f"{tables.shared_folder(spark)}/delta-{uuid.uuid4().hex}"
    raw = t.events.select("user_id", "event_type", "event_id", F.col("ts").alias("seen"), "value")
    schema = raw.drop("event_id").schema
    # A file stream reads folders: the table's own folder, or, for a single file, the folder with a filter on its name.
    stream = spark.readStream.schema(t.events.schema).option("pathGlobFilter", "*.parquet").parquet(f"{t.sf_dir}/events.parquet*")
    stream = stream.select("user_id", "event_type", "event_id", F.col("ts").alias("seen"), "value")
    delta.stream_merge(stream, f"{where}/table", f"{where}/checkpoint", keys=["user_id", "event_type"], seq="event_id", schema=schema).awaitTermination()
    return delta.read_snapshot(spark, f"{where}/table", schema)

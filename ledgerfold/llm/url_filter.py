"""URL filter by nested host and path rules: a sort-merge range join.

A host ``m.example.net`` has the canonical key ``net.example.m.``: its labels in reverse, each with
a dot behind. A rule for a host fits that host and all its subdomains, so its key is a prefix of
theirs and covers one interval of the sorted keys. Intervals of prefixes nest or are disjoint: a
sweep over rule starts, rule ends and urls in key order needs only a stack of open rules. A start
pushes, an end pops, a url reads the stack.

Two sweeps run. The first goes over host keys and finds, for each url, all rule hosts that enclose
it. The second goes over ``host key + path`` below each of them and finds the innermost path rule.

Scale. A sweep's order holds within groups, not over the whole table: a group is the first label,
a bucket of the rest, and a salt of the row. Rules with one label go to every bucket. Groups are counted first: one with more than ``group_rows``
rows is dealt over as many salts as that takes, and its rules go to each of them; a salt has at least four rows for each of the group's rules, so
the copies of rules stay fewer than the rows. So a host that owns a third of all rows is dealt evenly, at any size. Rules are never
broadcast or collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerfold.llm.common import lower_ascii, store

BUCKETS, GROUP_ROWS = 64, 256


def parse_host(url: Column) -> Column:
    """Host after the first ``://``, A-Z lower-cased; '' for null and for urls without ``://``."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def parse_path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; '' likewise."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse, a dot behind each; '' stays ''."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def _sweep(points: DataFrame, rules: DataFrame, buckets: int, group_rows: int) -> DataFrame:
    """The open rules at each point's key.

    ``points`` has first, rest, key, row. ``rules`` has first, rest (null: for all buckets), key and stack: its
    own entry and those of the rules around it, outermost first. Returns row and stack (null before any rule).
    """
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")
    everywhere = F.sequence(F.lit(0), F.lit(buckets - 1))
    dealt = rules.select("first", F.explode(F.when(F.col("rest").isNull(), everywhere).otherwise(F.array(bucket(F.col("rest"))))).alias("bucket"), "key", "stack")
    urls = points.select("first", bucket(F.coalesce("rest", F.lit(""))).alias("bucket"), "key", "row")
    # Groups that are split: at most rows / group_rows of them. Written, so that their size is known.
    sizes = urls.groupBy("first", "bucket").agg(F.count("*").alias("rows")).join(dealt.groupBy("first", "bucket").agg(F.count("*").alias("rules")), ["first", "bucket"])
    salts = F.ceil(F.col("rows") / F.greatest(F.lit(group_rows), 4 * F.col("rules"))).cast("int")
    split, _ = store(sizes.select("first", "bucket", salts.alias("salts")).filter("salts > 1"), "url-groups")
    dealt = dealt.join(split, ["first", "bucket"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    urls = urls.join(split, ["first", "bucket"], "left").withColumn("salt", F.pmod(F.xxhash64("row.rid"), F.coalesce("salts", F.lit(1))).cast("int"))
    place = ("first", "bucket", "salt")
    no_row = F.lit(None).cast(points.schema["row"].dataType)
    no_stack = F.lit(None).cast(rules.schema["stack"].dataType)
    around = F.slice("stack", F.lit(1), F.size("stack") - 1)
    # Order at one key: ends (inner ones first), starts (outer ones first), urls. An end restores what was around its rule. It sorts behind every key that begins with its own.
    starts = dealt.select(*place, _sortable("key").alias("key"), F.lit(1).alias("kind"), F.length("key").alias("depth"), "stack", no_row.alias("row"))
    ends = dealt.select(*place, F.concat(_sortable("key"), F.lit("ff")).alias("key"), F.lit(0).alias("kind"), (-F.length("key")).alias("depth"), around.alias("stack"), no_row.alias("row"))
    urls = urls.select(*place, _sortable("key").alias("key"), F.lit(2).alias("kind"), F.lit(0).alias("depth"), no_stack.alias("stack"), "row")
    so_far = W.partitionBy(*place).orderBy("key", "kind", "depth").rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = starts.unionByName(ends).unionByName(urls).withColumn("stack", F.last("stack", ignorenulls=True).over(so_far))
    return swept.filter("kind = 2").select("row", "stack")


def _sortable(key: str) -> Column:
    """The key's bytes in hexadecimal, lower case: no UTF-8 text has a byte ff, which so closes an interval behind every character."""
    return F.lower(F.hex(F.encode(key, "UTF-8")))


def _stacks(rules: DataFrame) -> DataFrame:
    """``rules`` (place, key, steps, entry) with ``stack``: entries of all rules of the place whose key is among the steps, shortest first."""
    own = rules.select("place", "key", F.explode("steps").alias("step"))
    found = own.join(rules.select("place", F.col("key").alias("step"), "entry"), ["place", "step"])
    nest = F.array_sort(F.collect_set(F.struct(F.length("step").alias("n"), F.col("entry"))))
    return found.groupBy("place", "key").agg(F.transform(nest, lambda x: x["entry"]).alias("stack"))


def filter_urls(pages: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow", buckets: int = BUCKETS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Adds host, path, rule and verdict to every row of ``pages``.

    ``rules`` has columns host, path, verdict. A rule fits its host and that host's subdomains if
    the url's path starts with the rule's path. Of several, the one with the longest ``host + path``
    wins; of equally long ones, the one with the longer host; of rules given twice, ``block``. ``rule`` is
    the winner's ``host + path``, null without one; then ``verdict`` is ``default``.

    Null urls and urls without ``://`` have an empty host and path and fit no rule. Rules with a null
    or empty host or a null verdict are left out; a null path counts as ''. An empty table gives an empty result.
    Repeated rows stay repeated. All columns of ``pages`` travel through the sweeps and come out again, so select what
    you need first; columns named like the four results are replaced. Rows are told apart by their
    place in the input: ``pages`` must be a scan, or another frame that gives the same rows in the same order when recomputed. Urls of any length, with any characters, are judged whole.
    """
    results = ("host", "path", "rule", "verdict")
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in results]
    parse = F.struct(F.monotonically_increasing_id().alias("rid"), parse_host(F.col(url)).alias("host"), parse_path(F.col(url)).alias("path"), F.struct(*kept).alias("given"))
    points = pages.select(parse.alias("row"))
    rules = rules.select(lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").filter("host <> '' and verdict is not null")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))

    # First sweep: the rule hosts that enclose the url's host.
    labels = lambda host: F.split(host, r"\.")
    spread = lambda host: [F.element_at(labels(host), -1).alias("first"), F.when(F.size(labels(host)) > 1, F.element_at(labels(host), -2)).alias("rest")]
    steps = F.expr(r"transform(sequence(1, size(split(host, '\\.'))), n -> concat(array_join(slice(reverse(split(host, '\\.')), 1, n), '.'), '.'))")
    hosts = rules.select("host").distinct().select(*spread(F.col("host")), host_key(F.col("host")).alias("key"), steps.alias("steps"), F.col("host").alias("entry"), F.lit("").alias("place"))
    hosts = hosts.select("key", "first", "rest").join(_stacks(hosts), "key")
    swept = _sweep(points.select(host_key(F.col("row.host")).alias("key"), *spread(F.col("row.host")), "row"), hosts, buckets, group_rows)
    swept, _ = store(swept, "url-hosts")

    # Second sweep, below each of these hosts: the innermost rule on the path.
    entry = F.struct(F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"), F.concat("host", "path").alias("rule"), "verdict")
    paths = rules.select(F.col("host").alias("place"), F.col("path").alias("key"), F.expr("transform(sequence(0, length(path)), n -> left(path, n))").alias("steps"), entry.alias("entry"))
    paths = _stacks(paths).select(F.col("place").alias("first"), F.lit("").alias("rest"), "key", "stack")
    below = swept.select("row", F.explode_outer("stack").alias("first"))
    inner = _sweep(below.filter("first is not null").select("first", F.lit("").alias("rest"), F.col("row.path").alias("key"), "row"), paths, 1, group_rows)
    won = inner.select("row", F.when(F.size("stack") > 0, F.element_at("stack", -1)).alias("won"))
    free = below.filter("first is null").select("row", F.lit(None).cast(won.schema["won"].dataType).alias("won"))
    best = won.unionByName(free).groupBy("row.rid").agg(F.first("row").alias("row"), F.max("won").alias("won"))
    return best.select("row.given.*", "row.host", "row.path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))

"""An upsert whose rows see each other: the same table as if the batch came row by row, without going through it row by row.

A row can only meet a listing through a lookup: by case and parcel together, by case, by parcel, or by address. So two rows of a batch can only meet if a chain
of such keys leads from one to the other, over rows of the batch or over listings that hold a key which some row of the batch looks up; a key
that is held but never looked up links nothing. So the batch falls into components. In most of them all rows carry the same key: such a component is
one lookup, that of its first row, and one aggregation, however many rows it has. Only components with different keys are replayed in order, each in
one task, all components of a partition in one pass, with an index of what each lookup finds.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerfold.operators.passes import NEVER, OVERWRITE
from ledgerfold.storage import stored


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): for each end of an edge (a, b) the smallest node that it hangs together with.

    Each round gives a node the smallest label of its neighbours, and then that label's own label, so labels travel twice as far with each round.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("heard"))
        near = labels.join(heard, "node").select("node", "component", F.least("component", "heard").alias("next"))
        beyond = labels.select(F.col("node").alias("next"), F.col("component").alias("beyond"))
        moved = stored(near.join(beyond, "next", "left").select("node", "component", F.least("next", "beyond").alias("next")), "labels")
        labels = moved.select("node", F.col("next").alias("component"))
        if moved.filter("next <> component").isEmpty():
            return labels


def _keys(site: Column, case: Column, parcel: Column, address: Column) -> tuple[Column, Column]:
    """The keys by which a row or listing can be found, and those that a row looks up. The day of a sale is left out, as an update may change it.

    Enough for all meetings: a listing's case never changes, so what finds it by its case holds that case from the start; its parcel is changed only by rows that look
    up that parcel (those without a case), and its address by rows that hold it. Empty cases and parcels are unknown, an empty address is an address, and an unknown site equals nothing.
    """
    known = lambda c: F.coalesce(site.isNotNull() & (c != ""), F.lit(False))
    key = lambda kind, when, *of: F.when(when, F.xxhash64(F.lit(kind), site, *of))
    some = lambda *k: F.filter(F.array(*k), lambda x: x.isNotNull())
    has_case, has_parcel = known(case), known(parcel)
    both, by_case, by_parcel, place = key("both", has_case & has_parcel, case, parcel), key("case", has_case, case), key("parcel", has_parcel, parcel), key("address", site.isNotNull() & address.isNotNull(), address)
    held = some(both, by_case, by_parcel, place)
    asked = F.when(has_case & has_parcel, some(both)).when(has_case, some(by_case)).when(has_parcel, some(by_parcel, place)).otherwise(some(place))
    return held, asked


class _Replay:
    """Applies the rows of a component in order. ``rows`` have the listing's columns."""

    def __init__(self, values: list[str], known: set[str], parcel: str, seen: str):
        self.values, self.known, self.parcel, self.seen = values, known, parcel, seen

    def held(self, t: dict) -> list[tuple]:
        """What finds a listing: by case and parcel, by case, by parcel, by address and day."""
        site, case, parcel, place = t["source_site"], t["case_number"] or None, t[self.parcel] or None, t["property_address"]
        if site is None:
            return []
        keys = [("both", site, case, parcel)] if case and parcel else []
        keys += [("case", site, case)] if case else []
        keys += [("parcel", site, parcel)] if parcel else []
        return keys + ([("address", site, place, t["sale_date"])] if place is not None else [])

    def asked(self, row: dict) -> list[tuple]:
        """The lookups of a row, in their order."""
        keys = {k[0]: k for k in self.held(row)}
        wanted = ["both"] if "both" in keys else ["case"] if "case" in keys else ["parcel", "address"]
        return [keys[k] for k in wanted if k in keys]

    def find(self, table: list[dict], index: dict[tuple, list[int]], row: dict) -> int | None:
        """The first listing that the cascade of lookups finds; the table is in order of preference. The index holds places, also of listings that have moved on, which are dropped when met."""
        for key in self.asked(row):
            places = index.get(key, [])
            while places and key not in self.held(table[places[0]]):
                heapq.heappop(places)
            if places:
                return places[0]
        return None

    def apply(self, table: list[dict], index: dict[tuple, list[int]], row: dict) -> None:
        at = self.find(table, index, row)
        if at is None:
            table.append({c: row.get(c) if c in self.known else None for c in self.values} | {"id": f"new|{row['source_site']}|{row['_seq']}", "is_new": True})
            self.enter(index, len(table) - 1, self.held(table[-1]))
            return
        hit = table[at]
        before = self.held(hit)
        for c in self.known:
            if c in NEVER or c == "id":
                continue
            if c in OVERWRITE:
                hit[c] = row[c]
            elif row[c] is not None:
                hit[c] = max(hit[c], row[c]) if c == self.seen and hit[c] is not None else row[c]
        self.enter(index, at, [k for k in self.held(hit) if k not in before])

    def enter(self, index: dict[tuple, list[int]], at: int, keys: list[tuple]) -> None:
        for k in keys:
            heapq.heappush(index.setdefault(k, []), at)

    def __call__(self, rows: list[dict]) -> list[dict]:
        table = [dict(r, is_new=False) for r in rows if r["_seq"] is None]
        table.sort(key=lambda t: t["id"])
        index: dict[tuple, list[int]] = {}
        for at, t in enumerate(table):
            self.enter(index, at, self.held(t))
        for row in sorted((r for r in rows if r["_seq"] is not None), key=lambda r: r["_seq"]):
            self.apply(table, index, row)
        return table


def upsert_in_order(current: DataFrame, batch: DataFrame, seq: str, *, parcel: str = "parcel_number", seen: str = "last_seen") -> DataFrame:
    """``current`` with a batch applied row by row in order of ``seq``; ``is_new`` marks inserted rows, whose id is ``new|site|seq`` of the row that inserted them.

    A row is looked up by (site, case, parcel) if it has both, by (site, case) without a parcel, by (site, parcel) and then (site, address, sale date) without a case, else by
    (site, address, sale date); sale dates match as values, null addresses and sites equal nothing. Of several listings the one with the smallest id is taken, and any that was there before
    the batch goes before new ones. Found: new values win where they are not null, ``OVERWRITE`` columns always, ``NEVER`` columns never, ``seen`` never goes back. Not found: the row is inserted as it is, and later
    rows find it. ``seq`` is an integer that no two rows share; empty cases and parcels count as unknown in lookups. Rows of an empty batch change nothing.
    """
    values = [c for c in current.columns if c != "id"]
    known = [c for c in values if c in batch.columns]
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    held, asks = _keys(F.col("source_site"), F.col("case_number"), F.col(parcel), F.col("property_address"))
    rows = stored(batch.select(F.col(seq).cast("bigint").alias("_seq"), *known).withColumn("_held", held).withColumn("_asks", asks), "batch")

    # what a row looks up it also holds; rows without a key stand alone
    asked = stored(rows.select(F.explode("_asks").alias("key")).distinct(), "asked")
    holding = rows.select("_seq", F.explode("_held").alias("key")).join(asked, "key")
    own_key = stored(holding.groupBy("_seq").agg(F.min("key").alias("_key")), "keyed")
    links = holding.join(own_key, "_seq").select(F.col("_key").alias("a"), F.col("key").alias("b"))
    touching = current.select("id", F.explode(held).alias("key")).join(asked, "key")
    first = stored(touching.groupBy("id").agg(F.min("key").alias("a")), "touched")
    chained = touching.join(first, "id").select("a", F.col("key").alias("b"))
    names = connected(links.select("a", "b").union(chained))
    named = rows.drop("_held", "_asks").join(own_key.join(names.select(F.col("node").alias("_key"), F.col("component").alias("_part")), "_key").select("_seq", "_part"), "_seq", "left")
    touched = first.join(names.select(F.col("node").alias("a"), F.col("component").alias("_part")), "a").select("id", "_part")

    day = F.coalesce(F.col("sale_date").cast("string"), F.lit("none"))
    case, place = blank("case_number"), F.col("property_address")
    own = F.when(case.isNotNull() & blank(parcel).isNotNull(), F.struct(F.lit("a").alias("k"), "source_site", case.alias("x"), blank(parcel).alias("y")))
    own = own.when(case.isNotNull(), F.struct(F.lit("b").alias("k"), "source_site", case.alias("x"), F.lit(None).cast("string").alias("y")))
    own = own.when(blank(parcel).isNotNull(), F.struct(F.lit("c").alias("k"), "source_site", blank(parcel).alias("x"), F.lit(None).cast("string").alias("y")))
    own = own.otherwise(F.struct(F.lit("d").alias("k"), "source_site", place.alias("x"), day.alias("y")))
    signed = stored(named.withColumn("_own", own).withColumn("_day", day), "signed")
    kinds = signed.filter("_part is not null").groupBy("_part").agg(F.min("_own").eqNullSafe(F.max("_own")).alias("_plain"))

    # ---- components of one key: the first row is looked up, all rows are folded
    plain = signed.join(kinds.filter("_plain").select("_part"), "_part", "left_semi").unionByName(signed.filter("_part is null").withColumn("_part", F.lit(None).cast("bigint")))
    group = F.coalesce(F.col("_part").cast("string"), F.concat(F.lit("alone "), F.col("_seq").cast("string")))
    fold = {c: F.min_by(c, "_seq") if c in NEVER else F.max_by(c, "_seq") if c in OVERWRITE else F.max(c) if c == seen else F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_seq"))) for c in known}
    began = {f"_{c}": F.min_by(c, "_seq") for c in ("source_site", "case_number", parcel, "property_address", "_day")}
    folded = plain.withColumn("_group", group).groupBy("_group").agg(*[x.alias(f"v_{c}") for c, x in fold.items()], *[x.alias(c) for c, x in began.items()], F.min("_seq").alias("_first"))
    found = current.withColumn("_day", day)
    lookups = {"a": ["source_site", "case_number", parcel], "b": ["source_site", "case_number"], "c": ["source_site", parcel], "d": ["source_site", "property_address", "_day"]}
    for name, on in lookups.items():
        one = found.groupBy(*[F.col(c).alias(f"_{c}") for c in on]).agg(F.min("id").alias(f"_id_{name}"))
        folded = folded.join(one, [f"_{c}" for c in on], "left")
    has_case, has_parcel = blank("_case_number").isNotNull(), blank(f"_{parcel}").isNotNull()
    hit = F.when(has_case & has_parcel, F.col("_id_a")).when(has_case, F.col("_id_b")).when(has_parcel, F.coalesce("_id_c", "_id_d")).otherwise(F.col("_id_d"))
    new = folded.withColumn("id", F.coalesce(hit, F.concat_ws("|", F.lit("new"), "_source_site", F.col("_first").cast("string")))).select("id", *[f"v_{c}" for c in known], F.lit(True).alias("_new"))

    # ---- components of several keys: replayed
    mixed = kinds.filter(~F.col("_plain")).select("_part")
    old_rows = current.join(touched, "id").join(mixed, "_part", "left_semi")
    schema = old_rows.select("id", *values).withColumn("is_new", F.lit(True)).schema
    both = signed.join(mixed, "_part", "left_semi").select("_part", "_seq", *known).unionByName(old_rows.select("_part", F.lit(None).cast("bigint").alias("_seq"), "id", *values), allowMissingColumns=True)
    replay, arrow = _Replay(values, set(known), parcel, seen), to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting, done = None, [], []
        for b in batches:
            for row in b.to_pylist():
                if row["_part"] != part and waiting:
                    done += replay(waiting)
                    waiting = []
                part = row["_part"]
                waiting.append(row)
            if len(done) > 10_000:
                yield pa.RecordBatch.from_pylist(done, arrow)
                done = []
        yield pa.RecordBatch.from_pylist(done + (replay(waiting) if waiting else []), arrow)

    replayed = stored(both.repartition("_part").sortWithinPartitions("_part", "_seq").mapInArrow(run, schema), "replayed")

    rest = current.join(replayed.filter(~F.col("is_new")).select("id"), "id", "left_anti").withColumn("_old", F.lit(True))
    joined = rest.join(new, "id", "full_outer")
    old, came = F.col("_old").isNotNull(), F.col("_new").isNotNull()

    def value(c: str) -> Column:
        if c not in known:
            return F.col(c)
        if c in NEVER:
            return F.when(old, F.col(c)).otherwise(F.col(f"v_{c}"))
        if c in OVERWRITE:
            return F.when(came, F.col(f"v_{c}")).otherwise(F.col(c))
        return F.greatest(c, f"v_{c}") if c == seen else F.coalesce(f"v_{c}", c)

    merged = joined.select("id", *[value(c).alias(c) for c in values], F.col("_old").isNull().alias("is_new"))
    return merged.unionByName(replayed)

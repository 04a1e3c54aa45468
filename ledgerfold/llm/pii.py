"""Personal identifiers: fixed forms, and others that bootstrapped contextual patterns discover.

Four kinds have a strict form (``KINDS``); whatever matches it is a *seed*. What only looks like an identifier (``loose``) is a candidate: a number without a
country code, an address with its dots spelled out, a card with slashes. Words around seeds and candidates are lexical patterns, so patterns and
instances form a graph. Each round scores the patterns by the instances that they surround, and then the candidates by their
patterns; candidates that gain confidence count as evidence in the next round. A pattern must surround ``least_seeds`` different seeds of a kind, and loses by
instances that are known not to be of the kind: seeds of another kind, numbers that fail the check digit, dates. Confident candidates become spans,
wherever they occur; so do candidates that are the same identifier as a seed, written differently.

Only identifier-like strings enter the graph, texts are read once, and edges are made distinct before they are counted, so copies of a text add nothing.
Joins on a pattern or an instance are salted, since one of either may hold a third of the graph.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm.common import append_columns, drop, fresh, store

KINDS = ("email", "ip", "card", "phone")
#: A candidate is taken from this confidence on; a pattern speaks for its instances from that one on.
ACCEPT, SUPPORT = 0.9, 0.8
LEAST_SEEDS = 5
ROUNDS = 4
#: How much an undecided candidate counts against a pattern.
DOUBT = 0.1
SALTS = 16

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# No match can begin inside a run of digits: the run's first digit would have matched, or failed for the same reason.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

AT = re.compile(r"@|[\[({]at[\])}]| at [A-Za-z0-9-]++ dot ")
LOOSE_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:(?: ?@ ?| ?[\[({]at[\])}] ?)[A-Za-z0-9-]++(?:(?:\.| ?[\[({]dot[\])}] ?| dot )[A-Za-z0-9-]++)*+| at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)++)")
LOOSE_IP = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]| dot )[0-9]{1,3}){3}|(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4})(?![0-9A-Za-z:])")
LOOSE_NUMBER = re.compile(r"(?<![0-9A-Za-zÀ-ÿ_.@/*-])[+(]{0,2}[0-9]++(?:[ ().\-/ ]{1,3}[0-9]++)*+(?![0-9A-Za-zÀ-ÿ_@])")
MASKED = re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[ -]?[*xX#]{4}){2}[ -]?[0-9]{4}(?![0-9A-Za-z])")
DATE = re.compile(r"(?:19|20)[0-9]{2}([-./])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-./])[0-9]{1,2}\2(?:19|20)[0-9]{2}")
DIGITS, NOT_DIGIT = re.compile("[0-9]"), re.compile("[^0-9]")


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def strict_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the strict forms, per kind from the left and without overlap."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                yield "phone", m.start(), m.end()


def loose_spans(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, kinds) of strings that look like identifiers, with the kinds that their form allows; none for numbers known to be something else."""
    if AT.search(text):
        for m in LOOSE_EMAIL.finditer(text):
            yield m.start(), m.end(), ["email"]
    for m in LOOSE_IP.finditer(text):
        if DIGITS.search(m[0]):
            yield m.start(), m.end(), ["ip"]
    for m in LOOSE_NUMBER.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 7 <= len(digits) <= 19:
            dated = DATE.fullmatch(m[0])
            yield m.start(), m.end(), [] if dated else ["card"] * (len(digits) >= 12 and luhn(digits)) + ["phone"] * (len(digits) <= 15)
    for m in MASKED.finditer(text):
        yield m.start(), m.end(), ["card"]


def same(found: str) -> str:
    """What two ways to write an identifier have in common: its signs restored, A-Z lower-cased; of plain numbers only the digits."""
    plain = re.sub(r" ?[\[({](?:dot|\.)[\])}] ?| dot ", ".", re.sub(r" ?[\[({]at[\])}] ?| at | ?@ ?", "@", found)).lower()
    return plain if re.search("[a-z@*#:]", plain) or IP.fullmatch(plain) else NOT_DIGIT.sub("", plain)


def around(text: str, start: int, end: int) -> tuple[str, str]:
    """Up to three words before and two after, A-Z lower-cased and digits made alike."""
    left, right = text[max(0, start - 90) : start].split(), text[end : end + 60].split()
    if start > 90 and len(left) <= 3:
        left = left[1:]  # its first word may be cut
    tidy = lambda ws: DIGITS.sub("0", " ".join(w[:40] for w in ws)).lower()
    return tidy(left[-3:]), tidy(right[:2])


def scan(text: str | None) -> tuple[list[dict], list[dict]]:
    """The strict spans, sorted, and what enters the graph: these and the loose ones that overlap none of them."""
    text = text or ""
    spans = sorted(strict_spans(text), key=lambda s: (s[1], KINDS.index(s[0])))
    marks, taken = [(kind, [], a, b) for kind, a, b in spans], []
    for _, a, b in spans:  # as intervals that do not overlap
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    end = i = 0
    for a, b, kinds in sorted(loose_spans(text), key=lambda s: (s[0], -s[1])):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if a >= end and not (i < len(taken) and taken[i][0] < b):
            marks.append((None, kinds, a, b))
            end = b
    out = []
    for kind, kinds, a, b in marks:
        left, right = around(text, a, b)
        out.append({"kind": kind, "kinds": kinds, "start": a, "end": b, "instance": same(text[a:b]), "left": left, "right": right})
    return [{"start": a, "rank": KINDS.index(k), "kind": k, "end": b, "confidence": 1.0, "strict": True} for k, a, b in spans], out


SPANS = "array<struct<start:bigint,rank:int,kind:string,end:bigint,confidence:double,strict:boolean>>"
MARKS = "array<struct<kind:string,kinds:array<string>,start:bigint,end:bigint,instance:string,left:string,right:string>>"


def salted(big: DataFrame, small: DataFrame, on: list[str], spread: str, how: str = "inner") -> DataFrame:
    """Joins where one key of ``big`` may hold a third of its rows: they are spread by another column, and ``small`` is repeated ``SALTS`` times."""
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def _patterns(left: Column, right: Column) -> Column:
    """The lexical patterns of a place: one to three words before it, one or two after it, and one on either side. Each has a letter."""
    last = lambda n: F.substring_index(left, " ", -n)
    first = F.substring_index(right, " ", 1)
    rows = [("L", F.concat(last(1), F.lit(" _"))), ("L", F.concat(last(2), F.lit(" _"))), ("L", F.concat(last(3), F.lit(" _"))), ("L", F.concat(last(1), F.lit(" _ "), first)), ("R", F.concat(F.lit("_ "), first)), ("R", F.concat(F.lit("_ "), right))]
    return F.filter(F.array_distinct(F.array(*[F.struct(F.lit(side).alias("side"), p.alias("pattern")) for side, p in rows])), lambda x: x["pattern"].rlike(r"\p{L}"))


def graph(marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges, with what is known of the instance by kind, and (pattern, side, kind, seeds, open, against): different instances that a pattern surrounds.

    ``seeds`` are of the kind, ``open`` ones may be, all others count against the pattern.
    """
    edges = marks.select("kind", "kinds", "instance", F.explode(_patterns(F.col("left"), F.col("right"))).alias("p")).select("p.*", "kind", "kinds", "instance")
    known = lambda k: F.max(F.coalesce(F.col("kind") == k, F.lit(False))).alias(f"is_{k}")
    may = lambda k: F.max(F.array_contains("kinds", k)).alias(f"may_{k}")
    distinct, _ = store(edges.groupBy("pattern", "side", "instance").agg(*[f(k) for k in KINDS for f in (known, may)]), "pii-edges")
    seed = lambda k: F.count_if(F.col(f"is_{k}"))
    loose = lambda k: F.count_if(~F.col(f"is_{k}") & F.col(f"may_{k}"))
    sums = distinct.groupBy("pattern", "side").agg(F.count("*").alias("all"), *[f(k).alias(f"{name}_{k}") for k in KINDS for name, f in (("seeds", seed), ("open", loose))])
    per_kind = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"seeds_{k}").alias("seeds"), F.col(f"open_{k}").alias("open")) for k in KINDS]))
    live = sums.select("pattern", "side", "all", per_kind.alias("x")).select("pattern", "side", "x.*", (F.col("all") - F.col("x.seeds") - F.col("x.open")).alias("against"))
    return distinct, live


def score_candidates(marks: DataFrame, *, least_seeds: int = LEAST_SEEDS, rounds: int = ROUNDS, accept: float = ACCEPT, support: float = SUPPORT) -> DataFrame:
    """(instance, kind, confidence): the candidates that patterns, or a seed written differently, make certain enough; one kind each."""
    distinct, sums = graph(marks)
    live = sums.filter((F.col("seeds") >= least_seeds) & (F.col("open") > 0) & (F.col("seeds") + F.col("open") > F.col("against")))
    loose = distinct.select("pattern", "side", "instance", F.explode(F.array(*[F.when(~F.col(f"is_{k}") & F.col(f"may_{k}"), k) for k in KINDS])).alias("kind")).filter("kind is not null")
    edges, edges_path = store(salted(loose, live, ["pattern", "side", "kind"], "instance"), "pii-graph")
    scores, path = store(edges.select("instance", "kind").distinct().withColumn("confidence", F.lit(0.0)), "pii-scores")
    for _ in range(rounds):
        told = salted(edges, scores, ["instance", "kind"], "pattern").groupBy("pattern", "side", "kind", "seeds", "against", "open").agg(F.sum("confidence").alias("gained"))
        good = F.col("seeds") + F.col("gained")
        strength = told.withColumn("strength", good / (good + F.col("against") + DOUBT * (F.col("open") - F.col("gained")) + 1)).filter(F.col("strength") >= support)
        heard = salted(edges.select("pattern", "side", "kind", "instance"), strength.select("pattern", "side", "kind", "strength"), ["pattern", "side", "kind"], "instance")
        side = lambda s: F.coalesce(F.max(F.when(F.col("side") == s, F.col("strength"))), F.lit(0.0))
        new, new_path = store(heard.groupBy("instance", "kind").agg((1 - (1 - side("L")) * (1 - side("R"))).alias("confidence")), "pii-scores")
        drop(edges.sparkSession, path)
        scores, path = new, new_path
    seeds = marks.filter("kind is not null").select("instance", "kind").distinct()
    again = marks.filter("kind is null").select("instance", F.explode("kinds").alias("kind")).distinct().join(seeds, ["instance", "kind"], "left_semi").withColumn("confidence", F.lit(1.0))
    rank = F.array_position(F.lit(list(KINDS)), F.col("kind"))
    best = scores.filter(F.col("confidence") >= accept).unionByName(again).groupBy("instance").agg(F.max_by(F.struct("kind", "confidence"), F.struct("confidence", -rank)).alias("b"))
    out, _ = store(best.select("instance", "b.*"), "pii-found")
    drop(edges.sparkSession, edges_path)
    return out


def find_identifiers(documents: DataFrame, *, text: str = "text", spans: str = "spans", keep_text: bool = True, least_seeds: int = LEAST_SEEDS, rounds: int = ROUNDS, accept: float = ACCEPT) -> DataFrame:
    """Adds ``spans``: an array of (start, rank, kind, end, confidence, strict), sorted by start and by the kind's place in ``KINDS``; code points, ends exclusive.

    Strict spans always stay; others have the confidence that their context gives them, and overlap no strict one. Null and empty texts have an empty array; texts of
    any length are read whole, in time linear in their length. Repeated rows and equal ids are judged row by row and alike; they count once as evidence. Of two kinds with
    equal confidence the first in ``KINDS`` is taken. ``keep_text`` leaves the text away, which is then nowhere stored. A column named like ``spans`` is replaced, others
    pass through. An empty table gives an empty result.
    """

    def start():
        return lambda texts: [list(x) for x in zip(*map(scan, texts), strict=True)] or [[], []]

    base = documents.drop(spans)
    marks, row, extra = fresh(base, "marks", "row", "extra")
    scanned, _ = store(append_columns(base, [text], f"`{spans}` {SPANS}, `{marks}` {MARKS}", start, omit=() if keep_text else (text,)).withColumn(row, F.monotonically_increasing_id()), "pii-scan")
    all_marks = scanned.select(F.col(row).alias("row"), F.explode(marks).alias("m")).select("row", "m.*")
    found = score_candidates(all_marks, least_seeds=least_seeds, rounds=rounds, accept=accept)
    more = salted(all_marks.filter("kind is null").select("row", "kinds", "instance", "start", "end"), found, ["instance"], "row").filter(F.array_contains("kinds", F.col("kind")))
    rank = F.array_position(F.lit(list(KINDS)), F.col("kind")).cast("int") - 1
    span = F.struct("start", rank.alias("rank"), "kind", "end", "confidence", F.lit(False).alias("strict"))
    lists = more.groupBy(F.col("row").alias(row)).agg(F.collect_list(span).alias(extra))  # of one text
    whole = scanned.drop(marks).join(lists, row, "left")
    return whole.withColumn(spans, F.array_sort(F.concat(spans, F.coalesce(extra, F.array().cast(SPANS))))).drop(row, extra)


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first is."""
    step = lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end"].cast("int").alias("at"))).otherwise(acc)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

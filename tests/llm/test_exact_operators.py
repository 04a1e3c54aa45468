"""URL filter, line dedup, near-dedup, decontamination, mixing and quality rules against brute force on small tables."""

import collections
import hashlib
import math
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ledgerfold.llm import decontaminate, line_dedup, mixing, quality_rules, superminhash, url_filter
from ledgerfold.llm.components import components

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n))


def corpus(seed=3):
    """Texts with nulls, blanks, copies, near copies, shared lines and repeated rows."""
    rng = random.Random(seed)
    texts = [None, "", "  \n\t ", "one", "one two", "One TWO", prose(rng, 5)]
    for _ in range(12):
        base = prose(rng, rng.choice([20, 60, 200])).split()
        texts.append(" ".join(base))
        for edits in (0, 1, 1, 2, 6):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = prose(rng, 1)
            texts.append(" ".join(copy))
    shared = ["this very line is found in more than five of the documents here", "  And this is another line that comes again and again, really. "]
    for i in range(14):
        texts.append("\n".join([prose(rng, 8), shared[i % 2] if i % 3 else shared[0].upper(), prose(rng, 4), "short line"]))
    texts.append(prose(rng, 20_000))
    rows = [(i * 3 + 1, t, ["en", "de", None][i % 3], f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in enumerate(texts)]
    return rows + [(None, texts[30], "en", "s1", 3), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOC).repartition(3).cache()


def empty(spark):
    return spark.createDataFrame([], DOC)


# ---- URL filter

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("org", "/fr/", "allow"), ("a.org", "", "block"), ("a.org", "/x/", "allow"), ("a.org", "/x/y/", "block"), ("a.org", "/x/", "block"), (None, "/", "block"), ("b.c", None, "block"), ("d", "/", None)]
URLS = [None, "", "nothing", "http://net", "http://NET/", "https://x.example.net/en/1?q#f", "http://example.net/de/", "http://a.org", "http://a.org/x/1", "http://z.a.org/x/y/2", "http://ba.org/fr/", "ftp://b.c?x", "http://xb.c/", "http://q.b.c/#", "http://d/", "x://u@://net/", "http://net/", "http:///p", "http://a.org/x/\U0010ffff\U0010ffff", "http://a.org/x/y/" + "z" * 50_000, "http://\U0010ffff.net/ü"]


def expected_rule(url):
    host, path = "", ""
    if url and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
        host, path = m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]
    best = {}
    for h, p, v in RULES:
        if h and v:
            best[h, p or ""] = max(v, best.get((h, p or ""), ""))
    fits = [(len(h + p), len(h), h + p, v) for (h, p), v in best.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
    won = max(fits, default=None)
    return host, path, won[2] if won else None, won[3] if won else "allow"


@pytest.mark.parametrize("group_rows", [1, 3, 256])
def test_url_filter(spark, group_rows):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id int, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"), buckets=3, group_rows=group_rows).collect()}
    assert got == {i: expected_rule(u) for i, u in enumerate(URLS)}


def test_url_filter_edges(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://net/")] * 3, "page_id int, url string")
    assert url_filter.filter_urls(pages, rules).count() == 3
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_a_hot_host_is_split(spark):
    """A host with most rows is dealt over several salts, and each still sees its rules."""
    urls = [(i, f"http://net/{i}") for i in range(3000)] + [(5000 + i, f"http://h{i}.org/fr/") for i in range(200)]
    rules = spark.createDataFrame([("net", "/", "block"), ("org", "/fr/", "allow"), ("net", "/12", "allow")], "host string, path string, verdict string")
    out = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame(urls, "page_id int, url string"), rules, group_rows=64).collect()}
    assert out == {i: ("net/12", "allow") if u.startswith("http://net/12") else ("net/", "block") if i < 5000 else ("org/fr/", "allow") for i, u in urls}


# ---- line dedup


def expected_lines(rows, min_chars=40, min_docs=5):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = collections.defaultdict(list)
    for r in rows:
        for k in {key(x) for x in (r[1] or "").split("\n")}:
            if len(k) >= min_chars:
                holders[k].append(-math.inf if r[0] is None else r[0])
    gone = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if key(x) not in gone or gone[key(x)] == (-math.inf if r[0] is None else r[0])]
        out.append((r[0], "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_line_dedup(docs, limit):
    """Both ways, broadcast shards and shards in tasks, give what brute force gives."""
    wide = docs.withColumn("n_lines", F.lit("clash")).withColumn("shard", F.lit(1)).withColumn("gone", F.lit("x"))
    out = line_dedup.dedup_lines(wide, broadcast_bytes=limit, shard_entries=1)
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()), key=str) == expected_lines(corpus())
    assert {"shard", "gone", "lang"} <= set(out.columns)


def test_line_dedup_empty(spark):
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_minimal_perfect_hash():
    import numpy as np

    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, (5000, 2)).astype(np.uint64)
    shard = line_dedup.Shard.load(line_dedup.Shard.build(h, np.arange(5000), np.arange(5000)).dump())
    assert sorted(shard.slots(h)) == list(range(5000))
    known, keeper = shard.probe(h, 0)
    assert known.all() and (keeper == np.arange(5000)).all()
    assert (shard.probe(h, 3000)[0] == (np.arange(5000) >= 3000)).all()  # the counts decide
    assert not shard.probe(rng.integers(0, 2**63, (5000, 2)).astype(np.uint64), 0)[0].any()


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_counts_decide_which_lines_go(docs, limit):
    """With every line in the index, the counts in it give the same result."""
    out = line_dedup.dedup_lines(docs, broadcast_bytes=limit, indexed_from=1)
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()), key=str) == expected_lines(corpus())


def test_a_shard_with_a_third_of_all_lines_is_dealt_over_tasks(spark, monkeypatch):
    hot = "this very line stands in a third of all the documents there are"
    rows = [(i, hot + "\n" + f"line {i} of its own, which is long enough to count" if i % 3 == 0 else f"line {i} of its own, which is long enough to count", "en", "s", 1) for i in range(900)]
    salts, there = [], line_dedup._probe_there
    monkeypatch.setattr(line_dedup, "_probe_there", lambda base, index, s, *a: salts.extend(s) or there(base, index, s, *a))
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, DOC), broadcast_bytes=0, task_lines=100)
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()), key=str) == expected_lines(rows)
    assert max(salts) >= 300 // 100


# ---- near-dedup


def expected_groups(rows, k, percent):
    sets = {}
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets.setdefault(r[0], set()).add(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    ids = [i for i in sets if i is not None]
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = next(iter(sets[a])), next(iter(sets[b]))
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                i, j = find(a), find(b)
                parent[max(i, j)] = min(i, j)
    return {i: (len(next(iter(sets[i]))), find(i)) for i in ids}


@pytest.mark.parametrize(("k", "percent", "task_docs"), [(3, 85, 2048), (5, 80, 2048), (3, 85, 2)])
def test_near_duplicates(docs, k, percent, task_docs):
    """The last case has small blocks and stars over several tasks."""
    out = superminhash.near_duplicates(docs.withColumn("n", F.lit(1)).withColumn("bands", F.lit("x")), k=k, percent=percent, task_docs=task_docs, star_docs=task_docs).collect()
    assert len(out) == docs.count()
    want = expected_groups(corpus(), k, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out if r.doc_id is not None)
    assert not any(r.kept for r in out if r.doc_id is None)


@pytest.mark.parametrize("task_docs", [1024, 7])
def test_chains_that_no_pivot_spans(spark, task_docs):
    """Each text is linked to its neighbours alone, and several chains share their head: stars cannot join them, blocks must."""
    rng = random.Random(11)
    head, rows = [f"h{i}" for i in range(20)], []
    for chain in range(4):
        tape = [f"c{chain}x{i}" for i in range(400)]
        rows += [(1000 * chain + i, " ".join(head + tape[4 * i : 4 * i + 70])) for i in range(30)]
    rng.shuffle(rows)
    want = expected_groups([(i, t) for i, t in rows], 3, 85)
    assert len({g for _, g in want.values()}) < len(rows)
    out = superminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=85, task_docs=task_docs, star_docs=task_docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want


def test_what_is_apart_is_compared_in_blocks(spark):
    """One bucket of texts, some linked and most not: blocks give what all pairs give."""
    rng = random.Random(4)
    rows = []
    for i in range(60):
        base = [f"b{i // 3}w{j}" for j in range(80)]
        base[rng.randrange(80)] = "other"
        rows.append((i, " ".join(base)))
    texts = spark.createDataFrame([(i, t.encode()) for i, t in rows], "doc long, text binary")
    apart = spark.createDataFrame([(1, i, 78, i, i > 10) for i, _ in rows], "bucket long, doc long, n long, group long, rest boolean")
    sketch = superminhash._sketch(3, *superminhash.plan(0.85))
    members = texts.mapInArrow(sketch, "doc long, n long, s1 long, s2 long, bands array<long>, sig binary").select("doc", "sig")
    links = superminhash._rest(apart, members, texts, 3, 85, 7, 10**6)
    got = {r.id: r.component for r in components(links).collect()}
    want = {i: g for i, (_, g) in expected_groups(rows, 3, 85).items()}
    groups = collections.Counter(want.values())
    reached = lambda i: any(want[j] == want[i] and j != i and (i > 10 or j > 10) for j in want)
    assert all(got.get(i) == g for i, g in want.items() if groups[g] > 1 and reached(i))
    assert all(want[i] == want[c] for i, c in got.items())


def test_a_group_that_shares_many_buckets_gives_few_edges(spark, monkeypatch):
    """Near copies below the threshold meet in bucket after bucket and block after block: their edges follow their number, and not their buckets and blocks."""
    rng = random.Random(6)
    rows = []
    for i in range(60):
        base = [f"w{j}" for j in range(100)]
        for at in rng.sample(range(100), 2):
            base[at] = f"own{i}"
        rows.append((i, " ".join(base)))
    rows += [(100 + i, rows[i][1] + " more") for i in range(4)]
    texts = spark.createDataFrame([(i, t.encode()) for i, t in rows], "doc long, text binary")
    apart = spark.createDataFrame([(b, i, 98, i, True) for b in range(8) for i, _ in rng.sample(rows, 50)] + [(9, i, 98, i, True) for i, _ in rows], "bucket long, doc long, n long, group long, rest boolean")
    sketch = superminhash._sketch(3, *superminhash.plan(0.85))
    members = texts.mapInArrow(sketch, "doc long, n long, s1 long, s2 long, bands array<long>, sig binary").select("doc", "sig")
    edges, real = [], superminhash.components
    monkeypatch.setattr(superminhash, "components", lambda x: edges.append(x.filter("a <> b").distinct().count()) or real(x))
    links = superminhash._rest(apart, members, texts, 3, 85, 30, 10**6)
    got = {r.id: r.component for r in components(links).collect()}
    want = {i: g for i, (_, g) in expected_groups(rows, 3, 85).items()}
    sizes = collections.Counter(want.values())
    assert got == {i: g for i, g in want.items() if sizes[g] > 1}
    assert len(edges) == 1 and edges[0] <= 1.5 * len(rows)


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_texts_that_share_a_bucket_and_are_not_linked_end_the_rounds(spark, monkeypatch, k, percent):
    """Ninety-nine texts with much in common, of which few are linked, in blocks of 24: rounds of pivots join nothing and must not go on pivot by pivot."""
    rng, common = random.Random(21), [f"c{i}" for i in range(200)]
    rows = [(i, " ".join(common + [f"own{i}x{j}" for j in range(50)])) for i in range(90)]
    rows += [(100 + i, rows[7 * i][1] + f" more{i}") for i in range(9)]
    rng.shuffle(rows)
    rounds, star = [], superminhash._star

    def counted(*a):
        rounds.append(1)
        assert len(rounds) <= 5, "one pivot after the other"
        return star(*a)

    monkeypatch.setattr(superminhash, "_star", counted)
    out = superminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=k, percent=percent, task_docs=24, star_docs=24).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == expected_groups(rows, k, percent)
    assert len(rounds) > 2


def test_edges_through_hubs_join_the_same(spark):
    rng = random.Random(9)
    for n in (5, 150):
        edges = spark.createDataFrame([tuple(sorted(rng.sample(range(100), 2))) for _ in range(n)], "a long, b long")
        few = superminhash._through_hubs(edges)
        assert {tuple(r) for r in components(few).collect()} == {tuple(r) for r in components(edges).collect()}
        assert few.filter("a >= b").count() == 0 and few.count() <= edges.distinct().count()


def test_thresholds_beyond_a_signature_are_refused():
    with pytest.raises(ValueError, match="bands"):
        superminhash.plan(0.03)


def test_near_duplicates_edges(spark):
    assert superminhash.near_duplicates(empty(spark)).count() == 0
    same = spark.createDataFrame([(7, "a b c d e f")] * 3 + [(8, "A B C D E F")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id, r.kept) for r in superminhash.near_duplicates(same).collect()} == {(7, 7, True), (8, 7, False)}


def test_superminhash_estimates():
    import numpy as np

    rng = np.random.default_rng(2)
    common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (300, 50, 50))
    x, y = np.unique(np.r_[common, a]), np.unique(np.r_[common, b])
    sig = superminhash.signatures(np.r_[x, y], np.cumsum([len(x), len(y)]), 200)
    assert abs((sig[0] == sig[1]).mean() - 300 / 400) < 0.12
    for threshold in (0.5, 0.8, 0.85):
        bands, rows = superminhash.plan(threshold)
        assert (1 - threshold**rows) ** bands < 1e-4 and bands * rows <= 255


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (5, 5), (None, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- decontamination


def test_leaks(spark):
    rng = random.Random(5)
    items = [(i, prose(rng, n)) for i, n in enumerate([14, 20, 30, 45, 59, 80])] + [(90, None), (91, "too short"), (92, "")]
    long = items[3][1].split()
    edited, shifted = list(long), long[:-1]
    edited[0] = "other"
    far = list(long)
    far[10] = far[25] = "other"
    rows = [
        (1, prose(rng, 30) + " " + items[0][1].upper() + ". " + prose(rng, 30)), (2, items[1][1].replace(" ", "\n")), (3, prose(rng, 9) + " " + " ".join(edited) + " " + prose(rng, 5)), (4, " ".join(shifted)),
        (5, " ".join(far)), (6, prose(rng, 200)), (7, None), (8, ""), (9, "a b"), (None, items[2][1]), (10, items[4][1] + " " + items[5][1] + " " + items[4][1]), (10, items[4][1]), (11, prose(rng, 15_000) + " " + items[5][1]),
        (12, prose(rng, 8) + " Too short! " + prose(rng, 8)), (13, "too short"), (14, "too"),
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, item string")
    out = decontaminate.find_leaks(docs, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n int")).collect()
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    bag = lambda w, k: collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    want = {}
    for d, t in rows:
        w = words(t)
        for i, it in items:
            v = words(it)
            k = min(5, len(v))
            if not v or len(w) < k:
                continue
            for s in range(max(1, len(w) - len(v) + 1)):
                a, b = bag(w[s : s + len(v)], k), bag(v, k)
                sim = sum((a & b).values()) / sum((a | b).values())
                if sim >= 0.8 and (sim, -s) > want.get((d, i), (0, 0)):
                    want[d, i] = (sim, -s)
    assert {(r.doc_id, r.item_id): (round(r.similarity, 9), -r.start_word) for r in out} == {k: (round(a, 9), b) for k, (a, b) in want.items()}
    assert (3, 3) in want and (4, 3) in want and (5, 3) not in want and (12, 91) in want and (13, 91) in want
    none = spark.createDataFrame([], "doc_id long, text string")
    assert decontaminate.find_leaks(none, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontaminate.find_leaks(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_leaks_of_long_and_repetitive_items(spark):
    """An item of 5,000 words, with edits and shifts, and one of few words repeated: both by sums of intervals."""
    rng = random.Random(7)
    long = [f"w{rng.randrange(3000)}" for _ in range(5000)]
    edited = list(long)
    for at in range(100, 5000, 120):
        edited[at] = "other"
    repeated = ("one two three four five six " * 12).split()
    docs = spark.createDataFrame([(1, prose(rng, 50) + " " + " ".join(edited) + " " + prose(rng, 50)), (2, " ".join(long[300:])), (3, prose(rng, 20) + " " + " ".join(repeated[5:] + ["end"])), (4, " ".join(repeated * 5))], "doc_id long, text string")
    out = decontaminate.find_leaks(docs, spark.createDataFrame([(1, " ".join(long)), (2, " ".join(repeated))], "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in out}
    bag = lambda w: collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    similarity = lambda a, b: sum((bag(a) & bag(b)).values()) / sum((bag(a) | bag(b)).values())
    assert set(got) == {(1, 1), (2, 1), (3, 2), (4, 2)}
    assert got[1, 1] == (pytest.approx(similarity(edited, long)), 50) and got[2, 1][0] == pytest.approx(similarity(long[300:], long))
    assert got[4, 2] == (1.0, 0) and got[3, 2][0] >= 0.8


def test_every_fingerprint_within_the_radius_shares_a_block(spark):
    rng = random.Random(2)
    rows = []
    for radius in (0, 3, 8, 13, 21, 63):
        for _ in range(40):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), radius):
                b ^= 1 << bit
            rows.append((radius, *[x - 2**64 if x >= 2**63 else x for x in (a, b)]))
    df = spark.createDataFrame(rows, "radius int, a long, b long")
    for side in "ab":
        df = df.withColumn("fp", F.col(side)).withColumn(f"blocks_{side}", F.expr(decontaminate._BLOCKS))
    assert df.filter(F.size(F.array_intersect("blocks_a", "blocks_b")) == 0).count() == 0
    assert df.filter(F.size("blocks_a") != F.col("radius") + 1).count() == 0
    # the blocks are the whole fingerprint
    whole = F.expr("aggregate(blocks_a, 0, (s, x) -> s + bit_count(x.value))")
    assert df.filter(whole != F.bit_count("a")).count() == 0


# ---- mixing


def test_mixing(docs):
    wide = docs.withColumn("rate", F.lit("clash")).withColumn("cdf", F.lit(1)).withColumn("copy_no", F.lit(0))
    out = mixing.mix_sources(wide, total=3.0)
    rates = {r.source: r.rate for r in mixing.repetition_rates(docs, total=3.0).collect()}
    sizes = collections.Counter()
    for r in corpus():
        sizes[r[3]] += len(r[1] or "")
    weight = sum(s**0.7 for s in sizes.values())
    for s, n in sizes.items():
        assert math.isclose(rates[s], n**0.7 / weight * 3 * sum(sizes.values()) / n)
    want = collections.Counter()
    for r in corpus():
        digest = hashlib.md5(f"17:draw:{'' if r[0] is None else r[0]}".encode()).hexdigest()
        u, k, mass, total = (int(digest[:13], 16) + 0.5) / 2**52, 0, math.exp(-rates[r[3]]), 0.0
        while total + mass < u:
            total += mass
            k += 1
            mass *= rates[r[3]] / k
        want[r[0], r[1]] += k
    got = collections.Counter((r.doc_id, r.text) for r in out.collect())
    assert got == +want
    assert {"rate", "cdf"} <= set(out.columns)


def test_mixing_targets_and_edges(spark, docs):
    targets = spark.createDataFrame([("s1", 1.0), ("s1", 1.0), ("zz", 5.0)], "source string, weight double")
    assert {r.source for r in mixing.mix_sources(docs, targets=targets).collect()} == {"s1"}
    assert mixing.mix_sources(empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, "en", "a", 0), (2, "", "en", None, 0)], DOC)
    assert mixing.mix_sources(blank).count() == 0


# ---- quality rules


def test_quality_measures(docs):
    got = collections.Counter(tuple(r) for r in quality_rules.base_measures(docs.select("doc_id", "text", F.lit(1).alias("w"))).drop("w").collect())
    want = collections.Counter()
    for r in corpus():
        t = r[1] or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        at = collections.defaultdict(list)
        for i in range(len(w) - 2):
            at[tuple(w[i : i + 3])].append(i)
        covered = {i + d for v in at.values() if len(v) > 1 for i in v for d in range(3)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        want[(r[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(lines), len(w) < 50 or 100 * len(covered) > 50 * len(w))] += 1
    assert got == want


def binomial_tail(k, n, p):
    q = Fraction(p)
    return float(sum(math.comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k + 1))) if k <= n * p else 1.0


def test_certified_cutoffs(spark):
    rng = random.Random(8)
    rows = []
    for i in range(4000):
        good, lang = rng.random() < 0.8, "en" if i % 10 else "de"
        symbols = rng.randrange(0, 12) if good else rng.randrange(0, 400)
        rows.append((lang, good, 100, 500, symbols, 0, 0, 10, False))
    holdout = spark.createDataFrame(rows, "stratum string, good boolean, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_text_lines long, base_failed boolean")
    got = {(r.stratum, r.measure): r.cutoff for r in quality_rules.certify(holdout).collect()}
    error = quality_rules.ERROR / (len(quality_rules.MEASURES) * 2)
    want = {}
    for lang in ("en", "de"):
        good = [r[4] / 500 for r in rows if r[0] == lang and r[1]]
        bad = [r[4] / 500 for r in rows if r[0] == lang and not r[1]]
        best = None
        for c in quality_rules.MEASURES["symbols"][1]:
            if binomial_tail(sum(x > c for x in good), len(good), quality_rules.RISK / len(quality_rules.MEASURES)) > error:
                break
            caught = sum(x > c for x in bad)
            if caught and (best is None or caught > best[0]):
                best = (caught, c)
        if best:
            want[lang, "symbols"] = best[1]
    assert got == want and ("en", "symbols") in want


def test_quality_edges(spark, docs):
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, None), (None, 1), (7, 5)], "doc_id long, quality int")
    out = quality_rules.judge_quality(docs, labels).collect()
    assert len(out) == docs.count() and all(not r.kept for r in out if r.base_failed)
    assert quality_rules.judge_quality(empty(spark), labels).count() == 0
    assert quality_rules.judge_quality(docs, labels.limit(0)).filter("kept = base_failed").count() == 0

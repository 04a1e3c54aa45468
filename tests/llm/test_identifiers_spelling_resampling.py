"""The operators for personal identifiers, spelling variants and importance resampling, against brute force."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from ledgerfold.llm import pii, queries, resampling, spelling

DOCS = "doc_id bigint, text string"


# --- personal identifiers ---------------------------------------------------------------------------------------------

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, s):
    digits = [int(c) for c in s if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        double = [d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(double) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute_spans(text):
    found = [(m.start(), list(FORMS).index(k), k, m.end()) for k, p in FORMS.items() for m in re.finditer(p, text or "") if valid(k, m[0])]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def test_strict_spans_equal_the_patterns():
    pieces = ["a.b@c.de", "@", "x@y", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0000.00255.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824", "+", "+1", " ", "..", "é", "\n", "4111111111111111", "٣", "1", "-", "(", "a@b.c.@d.e"]
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 8)))
        assert sorted((a, pii.KINDS.index(k), k, b) for k, a, b in pii.strict_spans(text)) == [(a, pii.KINDS.index(k), k, b) for k, a, b in brute_spans(text)], text


def test_op11_keeps_the_strict_spans_of_the_supplied_texts(spark):
    rows = queries.op11_pii(spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        spans = brute_spans(texts[r["doc_id"]])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in FORMS] == [sum(s[0] == k for s in spans) for k in FORMS]
        assert set(listed.split(",")) <= set(r["spans"].split(","))


def planted():
    """Contexts that surround seeds, and the same contexts around forms that are not strict; numbers that stay what they are."""
    rng = random.Random(2)
    docs = [f"Hello there. You can call me on +1 (2{i:02d}) 555-01{i:02d} any time" for i in range(20)]
    docs += [f"please write to user{i}@mail{i}.example.com for more" for i in range(20)]
    docs += [f"paid with card number {c} last week" for c in ("4111 1111 1111 1111", "5500-0000-0000-0004", "340000000000009", "6011000000000004", "4012888888881881", "4222222222222220", "5105105105105100", "5555555555554444", "4000056655665556", "371449635398431", "378282246310005", "6011111111111117") if valid("card", c)]
    docs += [f"order reference {rng.randrange(10**15, 10**16)} was shipped" for _ in range(60)]
    docs += [f"released on 20{i:02d}-01-15 for everyone, version 4.{i}" for i in range(30)]
    new = ["You can call me on 0049 30 901820 tomorrow", "please write to jane.roe at example dot org for help", "paid with card number 4111/1111/1111/1111 today", "You can call me on (0161) 496 0000 now", "again 0049-30-901820 without a word"]
    return docs, new


def test_context_finds_what_the_strict_forms_do_not(spark):
    docs, new = planted()
    df = spark.createDataFrame(list(enumerate(docs + new)), DOCS).repartition(3)
    rows = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"] if not s["strict"]] for r in pii.find_identifiers(df).collect()}
    for i in range(len(docs)):
        assert rows[i] == [], docs[i]
    of = lambda i: [(k, new[i][a:b]) for k, a, b in rows[len(docs) + i]]
    assert of(0) == [("phone", "0049 30 901820")]
    assert of(1) == [("email", "jane.roe at example dot org")]
    assert of(2) == [("card", "4111/1111/1111/1111")]
    assert of(3) == [("phone", "(0161) 496 0000")]
    assert of(4) == [("phone", "0049-30-901820")]


def test_a_pattern_among_other_numbers_finds_nothing(spark):
    """Ten order numbers pass the check digit by chance; the many that fail it keep the pattern from speaking for cards."""
    rng = random.Random(3)
    docs = [f"order reference {rng.randrange(10**15, 10**16)} was shipped" for _ in range(150)] + ["order reference 4111/1111/1111/1111 was shipped"]
    rows = pii.find_identifiers(spark.createDataFrame(list(enumerate(docs)), DOCS)).collect()
    assert all(s["strict"] for r in rows for s in r["spans"])
    assert sum(len(r["spans"]) for r in rows) > 5


def test_identifiers_edges(spark):
    rows = [(None, None), (1, ""), (1, "a@b.cd"), (1, "a@b.cd"), (2, "x" * 300_000 + "@" + "y" * 1000 + ".zz " + "1" * 200_000 + " +" + "1 " * 100_000)]
    df = spark.createDataFrame([(*r, "old", 5) for r in rows], DOCS + ", spans string, row int")
    out = pii.find_identifiers(df).collect()
    assert len(out) == 5 and all(r["row"] == 5 for r in out)
    assert sorted(len(r["spans"]) for r in out) == [0, 0, 1, 1, 1]
    assert pii.find_identifiers(df.limit(0)).count() == 0
    one = pii.find_identifiers(spark.createDataFrame([(1, "mail a@b.cd or 1.2.3.4")], DOCS))
    assert one.select(pii.redacted(F.col("text"), F.col("spans")).alias("r")).first()[0] == "mail [email] or [ip]"


# --- spelling variants ------------------------------------------------------------------------------------------------


def edits(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    if len(u) > len(v):
        u, v = v, u
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def test_pairs_equal_brute_force(spark):
    rng = random.Random(4)
    base = {"".join(rng.choice("abé") for _ in range(rng.randint(4, 12))) for _ in range(350)}
    words = sorted(base | {w + rng.choice("ab") for w in list(base)[:60]} | {"aaaaaaa", "aaaaaaaa", "baaaaaaa"})
    got = {(r["a"], r["b"]) for r in spelling.near_pairs(spark.createDataFrame([(w, 2) for w in words], "word string, n bigint")).collect()}
    want = {(a, b) if (len(a), a) < (len(b), b) else (b, a) for i, a in enumerate(words) for b in words[i + 1 :] if edits(a, b)}
    assert got == want and len(want) > 100


def brute_spelling(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    out = {}
    for w in n:
        near = [v for v in n if edits(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        out[w] = (best if best and n[best] >= 10 * n[w] else None, len(near))
    root = lambda w: root(out[w][0]) if out[w][0] else w
    return {(w, f, root(w), n[w], k, n[f] if f else None) for w, (f, k) in out.items()}


def test_op12_equals_brute_force(spark):
    rng = random.Random(5)
    words = ["Receivè", "receives", "Receivés", "separate", "seperate", "separated", "abcdefgh", "abcdefgx", "abcdefg"]
    rows = [(i if i % 7 else None, " ".join(rng.choices(words, [200, 1, 1, 300, 20, 2, 40, 400, 3], k=60))) for i in range(60)] + [(1, None), (2, ""), (2, "123 !"), (3, rows_long := "separatf " * 2)] + [(3, rows_long)]
    got = {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.group_spellings(spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", word string")).collect()}
    assert got == brute_spelling(rows)
    assert any(f and r != f for _, f, r, *_ in got)  # a chain of two steps


def test_chains_are_followed_to_the_end(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(19)]
    got = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {f"w{i}": "w19" for i in range(19)}


def test_spelling_edges(spark):
    empty = spark.createDataFrame([], DOCS)
    assert spelling.group_spellings(empty).count() == 0
    long = spark.createDataFrame([(1, "elephant " * 200_000 + "a" * 300_000)], DOCS)
    assert [tuple(r) for r in spelling.group_spellings(long, every=0).collect()] == [("elephant", None, "elephant", 200_000, 0, None)]
    with pytest.raises(ValueError):
        spelling.group_spellings(empty, letters=3)


# --- importance resampling --------------------------------------------------------------------------------------------


def brute_resample(rows, target, buckets=10_000):
    def features(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        ws = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        return len(ws), [crc32(f.encode()) % buckets for f in ws + [f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)]]

    of = [features(t) for _, t in rows]
    s, t = Counter(b for _, f in of for b in f), Counter(b for x in target for b in features(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for (doc_id, _), (n, f) in zip(rows, of, strict=True):
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f)) // len(f) if f else 0
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    may = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(may[: len(may) * 25 // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in out]


def sample_rows(n=400):
    rng = random.Random(6)
    words = ["Alpha", "beta", "GAMMA", "délta", "x1", "Ω", "the", "of"]
    text = lambda: rng.choice([" ", "-", "\n"]).join(rng.choices(words, k=rng.randint(0, 60)))
    return [((1 << 62) - i if i % 3 else -i, text()) for i in range(n)] + [(5000, None), (5001, ""), (5002, "!!")]


def test_op13_equals_brute_force(spark):
    rows, target = sample_rows(), ["the of Alpha x1", None, "délta délta Ω"]
    docs = spark.createDataFrame([(*r, "old", 3) for r in rows], DOCS + ", rank string, at int").repartition(5)
    out = resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string")).collect()
    assert all(r["at"] == 3 for r in out)
    got = sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in out), key=lambda r: r[0])
    assert got == sorted(brute_resample(rows, target), key=lambda r: r[0])


def test_blocks_of_long_texts_lose_no_feature(monkeypatch):
    rng = random.Random(7)
    text = " ".join(rng.choices(["a", "bé", "ccc", "Dd"], k=500)).encode()
    whole = Counter(int(b) for _, f in resampling.text_buckets(text, 997, 3) for b in f)
    monkeypatch.setattr(resampling, "BLOCK", 16)
    parts = list(resampling.text_buckets(text, 997, 3))
    assert len(parts) > 20 and Counter(int(b) for _, f in parts for b in f) == whole
    assert sum(n for n, _ in parts) == 500 and whole.total() == 500 + 499 + 498


@pytest.mark.parametrize("k", [1, 2, 7, 60, 119, 120])
def test_radix_selection(spark, k):
    rng = random.Random(8)
    rows = [(rng.choice([-(1 << 63), (1 << 63) - 1, 0, 1, rng.randrange(-(10**6), 10**6)]), rng.randrange(-5, 10**12)) for _ in range(120)]
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    assert resampling.kth_key(df, k, [F.col("a"), F.col("b")]) == list(sorted(rows)[k - 1])
    assert resampling.kth_key(df, 121, [F.col("a"), F.col("b")]) is None and resampling.kth_key(df, 0, [F.col("a")]) is None


def test_resampling_edges(spark):
    some, none = spark.createDataFrame([(1, "a " * 30)], DOCS), spark.createDataFrame([], DOCS)
    assert resampling.resample(none, some).count() == 0
    assert [(r["rank"], r["n_features"]) for r in resampling.resample(some, none).collect()] == [(None, 59)]
    # repeated rows and rows without an id: as many as there is room for
    rows = spark.createDataFrame([(None, "a " * 30)] * 4 + [(1, "a " * 30)] * 8, DOCS)
    ranks = sorted(r["rank"] for r in resampling.resample(rows, some).collect() if r["rank"])
    assert ranks == [1, 2, 3]
    with pytest.raises(TypeError):
        resampling.resample(some.withColumn("doc_id", F.lit("x")), some)

"""Near-duplicate documents: SuperMinHash signatures, banding, verification, union-find.

SuperMinHash (Ertl, 2017). MinHash draws ``m`` independent values for each element and keeps the minimum of each
slot. Here each element's values are ``rank + fraction``, where the ranks over the slots are one random permutation of 0 .. m-1
(drawn by Fisher-Yates from the element's hash). Ranks that are spread out give a lower variance than independent values, above all for
sets smaller than ``m``; and the element need only be followed while its rank can still win: once every
slot of a document holds a value, no later rank can lower any of them. A document of n elements needs about m ln(m) / n ranks an element.

Grouping
1. Documents with equal sets are one; the smallest id stands for them.
2. Signatures are cut into bands. ``plan(threshold)`` picks the rows of a band and so many bands that a pair at the
   threshold is missed with a probability below 1e-5. Documents that share a band share a bucket, and every pair that shares a bucket is a candidate, whatever the bucket's size.
3. Stars. A bucket's documents are held against one of them, its pivot; components over the links so found contract the bucket. First each document meets the smallest
   pivot of its buckets, then the others that are still in another group, then some more pivots of each bucket of which more than a block is still apart, as long as a round joins an eighth of
   that; so the rounds grow with the logarithm of the bucket, also where its documents are not linked. A pivot with very many documents is dealt over several tasks.
4. What is still apart in a bucket (as a rule very little: documents outside its largest group that were no pivot) is held against the rest of the bucket by short signatures, in
   blocks of bounded size, block against block, each pair of blocks in its own task. Components over what is likely by them, across buckets, are compared on full sets in the same way, so a text is sent once
   a block and not once a bucket. A task returns at most one pair a document (a spanning forest), never all pairs.
   In stars, too, short signatures go first: pairs more than five standard deviations below the threshold are ruled out, and only the texts of the others are sent.
5. Union-find over all links names the groups.

A bucket of a million near copies so costs a comparison a document, not one for each pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.llm.common import store
from ledgerfold.llm.components import components

MISS = 1e-5
ROWS = 6
TASK_DOCS, TASK_ITEMS = 1024, 2_000_000
CHUNK_ITEMS = 200_000
#: Documents that meet one pivot in one task, and pivots that a task remembers.
STAR_DOCS, PIVOTS = 512, 64
#: Pairs whose texts one task compares, where there are so many.
TASK_PAIRS = 2_000
#: Pivots of a bucket in each round, and the part of its rest (one in so many) that a round must join for there to be another.
EACH_ROUND, GAIN = 4, 8
#: Slots of the short signatures, 16 bits each.
SHORT = 128
#: Bits of the array of wanted ids for each of them, and its largest size in 64-bit numbers (16 MB).
ID_BITS, MOST_NUMBERS = 16, 1 << 21
#: From so many pairs of a block on, intersections come from one matrix product of at most so many cells.
MANY, MATRIX = 500, 1 << 25
_U = np.uint64


def plan(threshold: float, rows: int = ROWS, miss: float = MISS) -> tuple[int, int]:
    """(bands, rows of a band) for a threshold."""
    rows = max(1, min(rows, int(math.log(0.2) / math.log(threshold)) if threshold < 1 else rows))
    bands = 1 if threshold >= 1 else math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))
    if bands * rows > 255:  # ranks have eight bits
        raise ValueError(f"a threshold of {threshold} needs {bands} bands of {rows} rows; a signature has at most 255")
    return bands, rows


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    LIMIT = 1_000_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: bytes | None, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; of the whole sequence where words are fewer; empty without words."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, _U)
    w = np.fromiter(map(hashes.__getitem__, words), _U, n)
    size = min(k, n)
    out = np.full(n - size + 1, (0x9E3779B97F4A7C15 * size) & (2**64 - 1), _U)
    for i in range(size):
        out = mix(out ^ w[i : n - size + 1 + i]) + _U(i)
    return np.unique(out)


def signatures(items: np.ndarray, ends: np.ndarray, m: int) -> np.ndarray:
    """One row of ``m`` values for each set; ``items`` holds the sets one behind the other, ``ends`` where each ends; none is empty.

    A value has the rank in its upper 8 bits and the fraction below.
    """
    docs = len(ends)
    empty = np.iinfo(np.uint64).max
    best = np.full((docs, m), empty, _U)
    owner = np.repeat(np.arange(docs), np.diff(ends, prepend=0))
    x, row = items, np.arange(len(items))
    order = np.empty((len(items), m), np.uint8)
    order[:] = np.arange(m, dtype=np.uint8)
    for rank in range(m):
        r = mix(x + _U((0xD1342543DE82EF95 * (rank + 1)) & (2**64 - 1)))
        pick = rank + (mix(r) >> _U(32)).astype(np.int64) % (m - rank)
        slot = order[row, pick]
        order[row, pick] = order[row, rank]
        np.minimum.at(best, (owner, slot), (_U(rank) << _U(56)) | (r >> _U(8)))
        if rank + 1 < m:
            open_docs = (best == empty).any(axis=1)
            going = open_docs[owner]
            if not going.all():
                if not going.any():
                    break
                x, row, owner = x[going], row[going], owner[going]
    return best


def _bands(best: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(best), bands), _U)
    for b in range(bands):
        h = np.full(len(best), ((b + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1), _U)
        for r in range(rows):
            h = mix(h ^ best[:, b * rows + r]) + _U(r)
        out[:, b] = h
    return out


def _chunks(sets: list[np.ndarray]) -> Iterator[list[int]]:
    """Indexes of non-empty sets, in runs of bounded size."""
    run, size = [], 0
    for i, s in enumerate(sets):
        if not len(s):
            continue
        if run and size + len(s) > CHUNK_ITEMS:
            yield run
            run, size = [], 0
        run.append(i)
        size += len(s)
    if run:
        yield run


def _sketch(k: int, bands: int, rows: int):
    """doc, n, set hash (two halves; null for empty sets), band hashes, short signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(t, k, hashes) for t in batch.column(1).to_pylist()]
            out, short = np.zeros((len(sets), bands), _U), np.zeros((len(sets), min(SHORT, bands * rows)), np.uint16)
            for part in _chunks(sets):
                ends = np.cumsum([len(sets[i]) for i in part])
                best = signatures(np.concatenate([sets[i] for i in part]), ends, bands * rows)
                out[part], short[part] = _bands(best, bands, rows), best[:, : short.shape[1]].astype(np.uint16)
            halves = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
            empty = np.array([not len(s) for s in sets], bool)
            flat = pa.array(out.view("<i8").reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(halves[:, 0], mask=empty), pa.array(halves[:, 1], mask=empty), lists, pa.array([x.tobytes() for x in short], pa.binary())], ["doc", "n", "s1", "s2", "bands", "sig"]
            )

    return run


# ---- exact links within one task


class UnionFind:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def union(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.parent[max(i, j)] = min(i, j)
        return True


def _labels(uf: UnionFind, n: int) -> np.ndarray:
    return np.fromiter((uf.find(i) for i in range(n)), np.int64, n)


def _intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray | None:
    """Sizes of all intersections as one product of 0/1 matrices; None where these would be too large."""
    items = np.concatenate(b)
    known = np.intersect1d(np.concatenate(a), items)
    if len(known) * (len(a) + len(b)) > MATRIX:
        return None

    def ones(sets: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(sets), len(known)), np.float32)
        if len(known):
            flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
            hit = known[at] == flat
            out[owner[hit], at[hit]] = 1
        return out

    return (ones(a) @ ones(b).T).astype(np.int64)


def forest(sets: list[np.ndarray], groups: list[int], left: np.ndarray, right: np.ndarray, percent: int, m: int = 64, block: int = 256) -> list[tuple[int, int]]:
    """Exact links (100 * intersection >= percent * union) that join groups, as a spanning forest.

    Compares ``left`` with ``right`` (indexes into ``sets``). Small signatures rule pairs out first, at
    more than five standard deviations below the threshold; pairs already in one group (``groups`` to begin with) are passed over.
    """
    uf, links, first = UnionFind(len(sets)), [], {}
    for i, g in enumerate(groups):
        uf.union(first.setdefault(g, i), i)
    sizes = np.array([len(s) for s in sets])
    both = np.concatenate([left, right])
    sig = np.zeros((len(sets), m), np.uint32)
    for at in range(0, len(both), 4096):
        for part in _chunks([sets[i] for i in both[at : at + 4096]]):
            own = both[at + np.array(part)]
            sig[own] = signatures(np.concatenate([sets[i] for i in own]), np.cumsum(sizes[own]), m).view("<u4")[:, ::2]
    share = percent / 100
    least = math.floor(m * share - 5 * math.sqrt(m * share * (1 - share)))
    for i in range(0, len(left), block):
        a = left[i : i + block]
        for j in range(0, len(right), block):
            b = right[j : j + block]
            la, lb = _labels_of(uf, a), _labels_of(uf, b)
            can = la[:, None] != lb[None, :]
            small, large = np.minimum(sizes[a][:, None], sizes[b][None, :]), np.maximum(sizes[a][:, None], sizes[b][None, :])
            can &= 100 * small >= percent * large
            if not can.any():
                continue
            equal = np.zeros((len(a), len(b)), np.uint16)
            for c in range(m):
                equal += sig[a, c][:, None] == sig[b, c][None, :]
            can &= equal >= least
            at_a, at_b = np.nonzero(can)
            # likeliest first: the sooner groups merge, the fewer pairs need their sets
            order = np.argsort(-equal[at_a, at_b].astype(np.int32), kind="stable")
            shared = _intersections([sets[x] for x in a], [sets[x] for x in b]) if len(order) > MANY else None
            for c in order:
                x, y = int(a[at_a[c]]), int(b[at_b[c]])
                if shared is not None:
                    both_have = int(shared[at_a[c], at_b[c]])
                    if 100 * both_have < percent * (sizes[x] + sizes[y] - both_have):
                        continue
                if uf.find(x) == uf.find(y):
                    continue
                if shared is None:
                    both_have = sizes[x] + sizes[y] - len(np.union1d(sets[x], sets[y]))
                    if 100 * both_have < percent * (sizes[x] + sizes[y] - both_have):
                        continue
                uf.union(x, y)
                links.append((x, y))
    return links


def _labels_of(uf: UnionFind, at: np.ndarray) -> np.ndarray:
    return np.fromiter((uf.find(int(i)) for i in at), np.int64, len(at))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verify(k: int, percent: int):
    """Rows (pivot, doc, pivot's text, text): the pairs that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held = WordHashes(), {}
        for batch in batches:
            a, b = [], []
            for pivot, doc, x, y in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (mine := held.get((pivot, len(x)))) is None or mine[0] != x:
                    if len(held) >= PIVOTS:
                        held.clear()
                    mine = held[pivot, len(x)] = (x, shingle_set(x, k, hashes))
                if linked(mine[1], shingle_set(y, k, hashes), percent):
                    a.append(pivot)
                    b.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def least_equal(m: int, percent: int) -> int:
    """Slots in which a pair at the threshold agrees, less five standard deviations."""
    share = percent / 100
    return math.floor(m * share - 5 * math.sqrt(m * share * (1 - share)))


def _likely(percent: int):
    """Rows (pivot, salt, doc, pivot's signature, signature): pairs that may be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (3, 4))
                keep = pa.array((x == y).sum(axis=1) >= least_equal(x.shape[1], percent))
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in range(3)], ["pivot", "salt", "doc"])

    return run


def _star(pairs: DataFrame, members: DataFrame, texts: DataFrame, k: int, percent: int, star_docs: int, most: int) -> DataFrame:
    """The pairs (pivot, doc) that are linked, of at most ``most``. A pivot of many documents is dealt over several tasks."""
    pairs, _ = store(pairs.select("pivot", "doc").distinct(), "near-pairs", most)
    n = pairs.count()
    # at most one row for every ``star_docs`` pairs
    many, _ = store(pairs.groupBy("pivot").agg(F.ceil(F.count("*") / star_docs).cast("int").alias("salts")).filter("salts > 1"), "near-pivots", n)
    dealt = pairs.join(many, "pivot", "left").select("pivot", F.pmod(F.xxhash64("doc"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"), "doc")
    places = dealt.select("pivot", "salt").distinct()
    signed = dealt.join(members.select("doc", "sig"), "doc").join(places.join(members.select(F.col("doc").alias("pivot"), F.col("sig").alias("pivot_sig")), "pivot"), ["pivot", "salt"])
    likely, _ = store(signed.select("pivot", "salt", "doc", "pivot_sig", "sig").mapInArrow(_likely(percent), "pivot long, salt int, doc long"), "near-likely", n)
    n, likely = likely.count(), likely.distinct()
    pivots = likely.select("pivot", "salt").distinct().join(texts.select(F.col("doc").alias("pivot"), F.col("text").alias("pivot_text")), "pivot")
    full = likely.join(texts, "doc").join(pivots, ["pivot", "salt"]).select("pivot", "doc", "pivot_text", "text")
    found, _ = store(full.mapInArrow(_verify(k, percent), "a long, b long"), "near-links", n, TASK_PAIRS)
    return found


def _block_likely(percent: int):
    """Rows (doc, group, left, sig) of one left and one right block: each that has a likely partner in another group (b), with the smallest id it is so connected to (a)."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sig, docs = np.frombuffer(b"".join(rows["sig"]), np.uint16).reshape(len(rows), -1), rows["doc"].to_numpy()
        left, group = rows["left"].to_numpy(bool), rows["group"].to_numpy()
        a, b = np.flatnonzero(left), np.flatnonzero(~left)
        can, least = group[a][:, None] != group[b][None, :], least_equal(sig.shape[1], percent)
        for i in range(0, len(a), 256):
            for j in range(0, len(b), 256):
                x, y = slice(i, i + 256), slice(j, j + 256)
                if can[x, y].any():
                    equal = np.zeros(can[x, y].shape, np.uint16)
                    for c in range(sig.shape[1]):
                        equal += sig[a[x], c][:, None] == sig[b[y], c][None, :]
                    can[x, y] &= equal >= least
        of_a, of_b, none = np.arange(len(a)), np.arange(len(a), len(rows)), len(rows)
        while can.any():  # the smallest label spreads over likely pairs until nothing changes
            new_a = np.minimum(of_a, np.where(can, of_b[None, :], none).min(axis=1))
            new_b = np.minimum(of_b, np.where(can, new_a[:, None], none).min(axis=0))
            if (new_a == of_a).all() and (new_b == of_b).all():
                break
            of_a, of_b = new_a, new_b
        order = np.concatenate([a, b])
        label, keep = np.concatenate([of_a, of_b]), np.concatenate([can.any(axis=1), can.any(axis=0)])
        found = pd.DataFrame({"label": label[keep], "b": docs[order[keep]]}, dtype="int64")
        found["a"] = found.groupby("label")["b"].transform("min")
        return found.loc[found["a"] != found["b"], ["a", "b"]].drop_duplicates()

    return run


def _block_pair(k: int, percent: int):
    """Rows (doc, group, left, text) of one left and one right block: links between different groups."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc").reset_index(drop=True)
        hashes = WordHashes()
        sets = [shingle_set(x, k, hashes) for x in rows["text"]]
        at, left = np.arange(len(rows)), rows["left"].to_numpy(bool)
        docs = rows["doc"].to_numpy()
        links = forest(sets, rows["group"].tolist(), at[left], at[~left], percent)
        return pd.DataFrame({"a": [docs[x] for x, _ in links], "b": [docs[y] for _, y in links]}, dtype="int64")

    return run


def _in_blocks(apart: DataFrame, task_docs: int, task_items: int) -> DataFrame:
    """(bucket, i, j, doc, group, left): documents to be held against all of their bucket (``rest``) in left blocks, all in right ones; each pair of blocks is a task.

    ``apart``: bucket, doc, n, group, rest; stored.
    """
    blocks = lambda test, name: F.greatest(F.lit(1), F.ceil(F.count_if(test) / task_docs), F.ceil(F.sum(F.when(test, F.col("n")).otherwise(0)) / task_items)).cast("int").alias(name)
    sizes, _ = store(apart.groupBy("bucket").agg(blocks(F.col("rest"), "lefts"), blocks(F.lit(True), "rights")), "near-blocks", apart.count())
    dealt = apart.join(sizes, "bucket").withColumn("at", F.xxhash64("doc", F.lit(7)))
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    own = lambda name: F.pmod("at", F.col(name)).cast("int")
    left = dealt.filter("rest").select("bucket", "doc", "group", F.lit(True).alias("left"), own("lefts").alias("i"), every("rights").alias("j"))
    right = dealt.select("bucket", "doc", "group", F.lit(False).alias("left"), every("lefts").alias("i"), own("rights").alias("j"))
    return left.unionByName(right)


def _through_hubs(edges: DataFrame) -> DataFrame:
    """Fewer edges (a < b) with the same components: each b keeps its smallest a, and its other ones are tied to that, which many documents do alike.

    A document has one a for each task that it was in, so what is gathered for one is bounded by its bands times the blocks of a bucket.
    """
    hubs = edges.groupBy("b").agg(F.collect_set("a").alias("hubs")).select("b", "hubs", F.array_min("hubs").alias("a"))
    return hubs.select("a", F.explode(F.array_append(F.array_remove("hubs", F.col("a")), F.col("b"))).alias("b")).distinct()


def _rest(apart: DataFrame, members: DataFrame, texts: DataFrame, k: int, percent: int, task_docs: int, task_items: int) -> DataFrame:
    """Links of what is still apart. ``apart``: bucket, doc, n, group, and ``rest`` for what is held against all of its bucket."""
    signed = _in_blocks(apart, task_docs, task_items).join(members.select("doc", "sig"), "doc")
    likely, _ = store(signed.groupBy("bucket", "i", "j").applyInPandas(_block_likely(percent), "a long, b long"), "near-likely")
    edges, _ = store(_through_hubs(_through_hubs(likely)), "near-edges", 2 * likely.count())
    clusters = components(edges).select(F.col("id").alias("doc"), F.col("component").alias("bucket"))
    again, _ = store(_apart(apart.select("doc", "n", "group").distinct().join(clusters, "doc")), "near-apart", apart.count())
    return _in_blocks(again, task_docs, task_items).join(texts, "doc").groupBy("bucket", "i", "j").applyInPandas(_block_pair(k, percent), "a long, b long")


def _of(given: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``given`` whose doc is wanted. A bit array of the wanted ids, of bounded size, goes to the texts first, so that of the others hardly any are shuffled."""
    n, numbers = wanted.count(), 64
    while numbers * 64 < ID_BITS * n and numbers < MOST_NUMBERS:
        numbers *= 2
    place = lambda h: F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(numbers - 1))
    hashed = wanted.select(F.xxhash64("doc").alias("h"))
    set_ = hashed.groupBy(place("h").alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits"))
    every = given.sparkSession.range(numbers).join(set_, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    bits, _ = store(every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("bits")), "near-bits")
    marked = given.withColumn("bits", bits.scalar()).filter(F.expr(f"getbit(bits[cast(shiftrightunsigned(xxhash64(doc), 6) & {numbers - 1}L as int)], cast(xxhash64(doc) & 63 as int)) = 1"))
    return marked.drop("bits").join(wanted, "doc", "left_semi")


def _apart(state: DataFrame) -> DataFrame:
    """Buckets with several groups (bucket, doc, n, group), with ``rest``: outside the bucket's largest group."""
    counts = state.groupBy("bucket", "group").agg(F.count("*").alias("docs"))
    largest = counts.groupBy("bucket").agg(F.max_by("group", F.struct("docs", "group")).alias("largest"), F.count("*").alias("groups")).filter("groups > 1")
    return state.join(largest.select("bucket", "largest"), "bucket").select("bucket", "doc", "n", "group", (F.col("group") != F.col("largest")).alias("rest"))


def _pivots_of(apart: DataFrame) -> DataFrame:
    """(bucket, pivot, pivot_n, pivot_group): ``EACH_ROUND`` documents of each bucket's rest by hash, of different groups, so large groups are likely to have one."""
    one = apart.filter("rest").groupBy("bucket", "group").agg(F.min(F.struct(F.xxhash64("doc", F.lit(11)).alias("h"), "doc", "n")).alias("p"))
    first = one.withColumn("at", F.row_number().over(Window.partitionBy("bucket").orderBy("p"))).filter(F.col("at") <= EACH_ROUND)
    return first.select("bucket", F.col("p.doc").alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("group").alias("pivot_group"))


def near_duplicates(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, task_docs: int = TASK_DOCS, task_items: int = TASK_ITEMS, star_docs: int = STAR_DOCS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``documents``.

    A document's set: the distinct ``k``-word shingles of its words (runs without blanks, A-Z lower-cased); with fewer words, the whole
    sequence as one. Documents are linked if 100 * intersection >= ``percent`` * union of their sets; every link counts, on full sets of
    whole texts. ``component_id`` is the smallest id reachable over links, its own included; ``kept`` says whether that is its own.

    Documents without words (null, empty, blank) have no shingles and are linked with nothing. Rows that share an id are one
    document for the grouping if their sets are equal; otherwise each row's links count for the id. A null id is never the smallest of a
    group: its row has a null component_id if it stands alone, and is not kept. Very long texts are read to their end; their sets are held one by one. Other columns are
    ignored. An empty table gives an empty result.
    """
    spark = documents.sparkSession
    bands, rows = plan(percent / 100)
    given = documents.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("binary").alias("text"))
    sketches, _ = store(given.mapInArrow(_sketch(k, bands, rows), "doc long, n long, s1 long, s2 long, bands array<long>, sig binary"), "sketches")
    # 1. equal sets
    reps = sketches.filter("s1 is not null").groupBy("s1", "s2").agg(F.min("doc").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    reps, _ = store(reps.filter("rep is not null"), "representatives")
    # 2. buckets of more than one document; of buckets with the same documents, one
    banded = reps.select(F.col("rep").alias("doc"), "n", F.explode("bands").alias("bucket"))
    key = F.xxhash64("doc")
    shape = banded.groupBy("bucket").agg(F.count("*").alias("docs"), F.sum("n").alias("weight"), F.min("doc").alias("low"), F.min_by("n", "doc").alias("low_n"), F.bit_xor(key).alias("x"), F.sum(F.shiftright(key, 20)).alias("y")).filter("docs > 1")
    shape = shape.groupBy("docs", "weight", "low", "low_n", "x", "y").agg(F.min("bucket").alias("bucket"))
    buckets, _ = store(banded.join(shape.select("bucket", "low", "low_n"), "bucket"), "buckets")
    most = buckets.count()  # nothing below has more rows, but for the links themselves
    wanted, _ = store(buckets.select("doc").distinct(), "near-wanted", most)
    texts, _ = store(_of(given, wanted), "near-texts")
    members, _ = store(reps.select(F.col("rep").alias("doc"), "sig").join(buckets.select("doc").distinct(), "doc", "left_semi"), "near-signatures", most)
    # 3. stars
    fits = F.least("n", "pivot_n") * 100 >= F.greatest("n", "pivot_n") * percent
    star = lambda pairs: _star(pairs.filter(fits), members, texts, k, percent, star_docs, most)
    smallest = F.min(F.struct("low", "low_n")).alias("p")
    links = star(buckets.groupBy("doc", "n").agg(smallest).select("doc", "n", F.col("p.low").alias("pivot"), F.col("p.low_n").alias("pivot_n")).filter("doc <> pivot"))
    grouped = lambda: buckets.join(components(links).withColumnRenamed("id", "doc"), "doc", "left").select("bucket", "doc", "n", "low", "low_n", F.coalesce("component", "doc").alias("group"))
    state, _ = store(grouped(), "near-groups", most)
    lows = state.filter("doc = low").groupBy("bucket").agg(F.min("group").alias("low_group"))
    links = links.unionByName(star(state.join(lows, "bucket").filter("group <> low_group").select("doc", "n", F.col("low").alias("pivot"), F.col("low_n").alias("pivot_n"))))
    pivots, before = buckets.filter("doc = low").select("bucket", "doc"), None
    while True:
        apart, _ = store(_apart(grouped().join(pivots, ["bucket", "doc"], "left_anti")), "near-apart", most)
        large = apart.filter("rest").groupBy("bucket").agg(F.count("*").alias("left")).filter(F.col("left") > task_docs)
        if before is not None:  # where pivots join little, more of them would join little
            large = large.join(before.select("bucket", F.col("left").alias("before")), "bucket").filter(F.col("left") * GAIN <= F.col("before") * (GAIN - 1)).select("bucket", "left")
        large, _ = store(large, "near-large", most)
        if large.isEmpty():
            break
        chosen, _ = store(_pivots_of(apart.join(large, "bucket")), "near-chosen", most)
        links = links.unionByName(star(apart.join(chosen, "bucket").filter("group <> pivot_group").select("doc", "n", "pivot", "pivot_n")))
        pivots, _ = store(pivots.unionByName(chosen.select("bucket", F.col("pivot").alias("doc"))), "near-pivots", most)
        before = large
    # 4. the rest
    if not apart.isEmpty():
        rest, _ = store(_rest(apart, members, texts, k, percent, task_docs, task_items), "near-links")
        links = links.unionByName(rest)
    # 5. groups
    settled = components(links)
    # every row gets its representative's group
    named = reps.select("s1", "s2", "rep").join(settled, reps["rep"] == settled["id"], "left").select("s1", "s2", F.coalesce("component", "rep").alias("component"))
    out = sketches.select("doc", "n", "s1", "s2").join(named, ["s1", "s2"], "left")
    component = F.coalesce("component", "doc")
    return out.select(F.col("doc").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc") == component, F.lit(False)).alias("kept"))

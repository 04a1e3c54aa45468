"""Quality classifier by co-training of two views.

The content view reads the words: hashed words and word shapes (``Aa,`` ``A!!``), as shares of the text. The metadata view never sees a word: it
reads source, language and page statistics (length, lines, line length, shares of capitals, digits, punctuation and symbols, share of distinct words), in buckets.
Either is a logistic model in numpy. Both start from the same labelled texts.

Exchange. In each round both views judge all unlabelled texts, in the tasks. A text of which a view is certain, by its calibrated probability, teaches both views with that label, unless
the other view is as certain of the opposite. Each task fits both views to the labelled texts and its taught ones (blocks of bounded size; labelled and taught texts weigh the same in all, however
many there are), and the blocks' weights are averaged by their numbers of taught texts (parameter mixing). Every round judges all texts anew, so a text counts at most once in a
round, and an early mistake can be taken back. What the last exchange teaches is fitted too. A view takes an exchange's weights only if they predict the texts kept for calibration better.

A part of the labelled texts is left out of all this: on it each view is calibrated (Platt) before each exchange, and at the end the two calibrated log odds are combined by a
logistic model. All documents are then scored by both views, each alone, without a shuffle.

Labelled texts are a bounded sample: ``max_labelled`` of each label, those with the smallest hashes of their ids. Other labelled texts count as unlabelled. Nothing else is bounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm.common import append_columns, drop, store

CONTENT_BITS, META_BITS = 14, 12
MAX_LABELLED, ROUNDS, SURE = 3000, 2, 0.9
#: Texts that a task fits at once; weights that travel together.
BLOCK = 20_000
#: Steps of a fit that goes on from the weights of the round before.
STEPS_AGAIN = 40
SLICE = 4096
KEEP_FROM = 0.5
SCALE = {"content": 10.0, "meta": 1.0}
_SHAPES = bytes.maketrans(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", b"a" * 26 + b"A" * 26 + b"0" * 10)


class WordFeatures(dict):
    """A word's two numbers, for itself (A-Z lower-cased) and for its shape; remembered up to a bound."""

    LIMIT = 500_000

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= self.LIMIT:
            self.clear()
        shape, squeezed = word.translate(_SHAPES), bytearray()
        for c in shape:  # runs of letters and digits count once; bytes beyond ASCII are letters
            c = 97 if c > 127 else c
            if not (squeezed and squeezed[-1] == c and c in b"aA0"):
                squeezed.append(c)
        top = (1 << CONTENT_BITS) - 1
        out = self[word] = (xxhash.xxh3_64_intdigest(word.lower()) & top, xxhash.xxh3_64_intdigest(bytes(squeezed[:12]), seed=1) & top)
        return out


def content_features(text: bytes | None, read: WordFeatures) -> np.ndarray:
    """Numbers of all words and shapes of the whole text, with repetitions."""
    words = (text or b"").split()
    return np.fromiter((i for w in words for i in read[w]), np.int32, 2 * len(words))


def _bucket(x: float, step: float = 2.0) -> int:
    return int(math.log1p(max(0.0, x)) * step)


def meta_features(text: bytes | None, source: str | None, lang: str | None) -> list[int]:
    """Numbers of the buckets; no word counts, only what the page looks like."""
    t = text or b""
    n, lines, words = max(1, len(t)), t.split(b"\n"), t.split()
    letters = t.translate(_SHAPES)
    upper, lower, digits = letters.count(b"A"), letters.count(b"a"), letters.count(b"0")
    marks = sum(t.count(c) for c in (b".", b",", b"!", b"?", b";", b":"))
    symbols = sum(t.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">", b"_", b"="))
    share = lambda x: int(20 * x / n)
    facts = [
        ("source", source), ("lang", lang), ("length", _bucket(len(t))), ("lines", _bucket(len(lines))), ("line", _bucket(len(t) / len(lines))),
        ("capitals", int(20 * upper / max(1, upper + lower))), ("digits", share(digits)), ("marks", int(40 * marks / n)), ("shouts", int(40 * t.count(b"!") / n)), ("symbols", int(40 * symbols / n)),
        ("distinct", int(10 * len(set(words)) / max(1, len(words)))), ("empty", not words),
    ]
    return [xxhash.xxh3_64_intdigest(f"{k}={v}".encode("utf-8", "replace"), seed=2) & ((1 << META_BITS) - 1) for k, v in facts]


class Vectors:
    """Sparse rows of a batch: content numbers and shares (they sum to 1), metadata numbers; ``owner`` says whose they are."""

    def __init__(self, ci: list[bytes], cn: list[bytes], mi: list[bytes]):
        self.packed = (ci, cn, mi)
        index, share = [], []
        for i, n in zip(ci, cn, strict=True):
            index.append(np.frombuffer(i, np.uint16))
            n = np.frombuffer(n, np.uint8 if len(n) == len(index[-1]) else np.uint32).astype(np.float64)
            share.append(n / max(1.0, n.sum()))
        self.n = len(index)
        self.content = (np.repeat(np.arange(self.n), [len(x) for x in index]), np.concatenate(index).astype(np.int64) if index else np.zeros(0, np.int64), np.concatenate(share) if share else np.zeros(0))
        meta = [np.frombuffer(x, np.uint16) for x in mi]
        self.meta = (np.repeat(np.arange(self.n), [len(x) for x in meta]), np.concatenate(meta).astype(np.int64) if meta else np.zeros(0, np.int64), np.ones(sum(len(x) for x in meta)))

    def odds(self, view: str, w: np.ndarray) -> np.ndarray:
        owner, index, value = getattr(self, view)
        return SCALE[view] * np.bincount(owner, value * w[index], minlength=self.n) + w[-1]

    def take(self, keep: np.ndarray) -> Vectors:
        return Vectors(*([x for x, k in zip(part, keep, strict=True) if k] for part in self.packed))

    def with_(self, other: Vectors) -> Vectors:
        return Vectors(*(x + y for x, y in zip(self.packed, other.packed, strict=True)))

    def sums(self, view: str, weight: np.ndarray) -> np.ndarray:
        """Sum of the rows' features, each row times its weight; the sum of the weights last."""
        owner, index, value = getattr(self, view)
        return np.append(np.bincount(index, value * weight[owner], minlength=WIDTH[view]), weight.sum())


WIDTH = {"content": 1 << CONTENT_BITS, "meta": 1 << META_BITS}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: Vectors, view: str, weight: np.ndarray, y: np.ndarray, start: np.ndarray | None = None, steps: int = 80, rate: float = 0.3, ridge: float = 1e-4) -> np.ndarray:
    """Logistic weights (the bias last) by Adam over all rows; ``weight`` sums to 1."""
    w = np.zeros(WIDTH[view] + 1) if start is None else start.copy()
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = SCALE[view] * rows.sums(view, weight * (_sigmoid(rows.odds(view, w)) - y)) + ridge * w
        g[-1] /= SCALE[view]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) * (1 - 0.7 * t / steps)
    return w


def balanced(y: np.ndarray) -> np.ndarray:
    """Weights of rows: both labels weigh the same, and 1 in all."""
    return np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))


def _newton(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.column_stack([x, np.ones(len(x))])
    b, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(30):
        p = _sigmoid(x @ b)
        b += np.clip(np.linalg.solve((x * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ b), -5, 5)
    return b


def _pack(text: bytes | None, read: WordFeatures) -> tuple[bytes, bytes]:
    index, n = np.unique(content_features(text, read), return_counts=True)
    return index.astype(np.uint16).tobytes(), n.astype(np.uint8 if not len(n) or n.max() < 256 else np.uint32).tobytes()


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed sparse vectors of texts."""
    read = WordFeatures()
    for batch in batches:
        ci, cn, mi = [], [], []
        for text, source, lang in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
            i, n = _pack(text, read)
            ci.append(i)
            cn.append(n)
            mi.append(np.array(meta_features(text, source, lang), np.uint16).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x, pa.binary()) for x in (ci, cn, mi)]], ["label", "held", "ci", "cn", "mi"])


def judge(rows: Vectors, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are taught, and all rows' labels."""
    p = [_sigmoid(a * rows.odds(v, w) + b) for v, (w, (a, b)) in ((v, model[v]) for v in WIDTH)]
    yes, no = (np.any([x >= SURE for x in each], axis=0) for each in (p, [1 - x for x in p]))
    return yes != no, yes.astype(int)


def _exchange(shared):
    """A task's weights after an exchange, times its taught texts, in slices; one block after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, packed, y = shared.value
        gold, total, taught = Vectors(*packed), {v: np.zeros(WIDTH[v] + 1) for v in WIDTH}, np.zeros(2)
        block: list[list] = [[], [], []]

        def settle() -> None:
            rows = Vectors(*block)
            sure, label = judge(rows, model)
            if n := int(sure.sum()):
                both, labels = gold.with_(rows.take(sure)), np.r_[y, label[sure]]
                weight = np.r_[balanced(y) / 2, balanced(label[sure]) / 2]
                for v in WIDTH:
                    total[v] += n * fit(both, v, weight, labels, model[v][0], steps=STEPS_AGAIN)
                taught[:] += np.bincount(label[sure], minlength=2)

        for batch in batches:
            for part, i in zip(block, (2, 3, 4), strict=True):
                part += batch.column(i).to_pylist()
            if len(block[0]) >= BLOCK:
                settle()
                block = [[], [], []]
        if block[0]:
            settle()
        for v, x in {**total, "taught": taught}.items():
            for i in range(0, len(x) if taught.any() else 0, SLICE):
                yield pa.RecordBatch.from_arrays([pa.array([f"{v} {i}"]), pa.array([x[i : i + SLICE].tobytes()], pa.binary())], ["part", "sums"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for part, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = np.frombuffer(x.as_py())
            total[part] = total[part] + x if part in total else x
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["part", "sums"])


def cotrain(pool: DataFrame, gold: Vectors, y: np.ndarray, held: Vectors, held_y: np.ndarray, rounds: int = ROUNDS) -> dict:
    """A model from labelled vectors and the packed vectors of all unlabelled texts (``pool``); ``held`` serves for calibration."""
    context = pool.sparkSession.sparkContext
    calibrated = lambda weights: {v: (w, _newton(held.odds(v, w)[:, None], held_y)) for v, w in weights.items()}
    loss = lambda v, m: np.logaddexp(0, (1 - 2 * held_y) * (m[1][0] * held.odds(v, m[0]) + m[1][1])).mean()
    model, taught = calibrated({v: fit(gold, v, balanced(y), y) for v in WIDTH}), np.zeros(2)
    for _ in range(rounds):
        shared = context.broadcast((model, gold.packed, y))
        sums = {v: np.zeros(WIDTH[v] + 1) for v in WIDTH} | {"taught": np.zeros(2)}
        # in all as large as the model
        for r in pool.mapInArrow(_exchange(shared), "part string, sums binary").repartition("part").mapInArrow(_add, "part string, sums binary").toLocalIterator():
            v, at = r["part"].split()
            x = np.frombuffer(r["sums"])
            sums[v][int(at) : int(at) + len(x)] += x
        shared.destroy()
        taught = sums["taught"]
        if not taught.any():
            break
        again = calibrated({v: sums[v] / taught.sum() for v in WIDTH})
        model = {v: min(model[v], again[v], key=lambda m, v=v: loss(v, m)) for v in WIDTH}
    odds = np.column_stack([a * held.odds(v, w) + b for v, (w, (a, b)) in model.items()])
    return model | {"both": _newton(odds, held_y), "taught": taught.tolist()}


def train(
    documents: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", quality: str = "quality", max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS
) -> dict | None:
    """The fitted model; None where either label has fewer than two texts to learn from or to calibrate on, as in empty tables.

    Of several labels for one id the smallest counts. The exchange is fitted in blocks of each task and averaged, so the weights depend, slightly, on how the rows are split.
    """
    known = labels.select(F.col(doc_id).alias("id"), F.col(quality).cast("int").alias("label")).filter("id is not null and label in (0, 1)").groupBy("id").agg(F.min("label").alias("label"))
    order = F.xxhash64("id", F.lit(23))
    picked = known.filter("label = 0").orderBy(order, "id").limit(max_labelled).unionByName(known.filter("label = 1").orderBy(order, "id").limit(max_labelled))
    # At most 2 * max_labelled short rows are broadcast, so the texts need no shuffle.
    sample = documents.select(F.col(doc_id).alias("id"), F.col(text).cast("binary").alias("text"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang")).join(F.broadcast(picked), "id", "left")
    sample = sample.select(F.coalesce("label", F.lit(-1)).alias("label"), (F.col("label").isNotNull() & (F.pmod(order, F.lit(4)) == 0)).alias("held"), "text", "source", "lang")
    rows, path = store(sample.mapInArrow(_vectors, "label int, held boolean, ci binary, cn binary, mi binary"), "cotraining-vectors")
    sizes = {(r["label"], r["held"]): r["count"] for r in rows.filter("label >= 0").groupBy("label", "held").count().collect()}  # four rows
    if min(sizes.get((v, h), 0) for v in (0, 1) for h in (True, False)) < 2:
        return None
    known_rows = rows.filter("label >= 0").toArrow()  # at most 2 * max_labelled texts
    every, label, apart = Vectors(*(known_rows[c].to_pylist() for c in ("ci", "cn", "mi"))), np.array(known_rows["label"].to_pylist()), np.array(known_rows["held"].to_pylist(), bool)
    model = cotrain(rows.filter("label < 0"), every.take(~apart), label[~apart], every.take(apart), label[apart].astype(float), rounds)
    drop(documents.sparkSession, path)
    return model


def classify(documents: DataFrame, model: dict | None, *, text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """``documents`` without their text, with content_score, meta_score and score: probabilities of label 1 by either view and by both.

    Texts are read whole; null and empty texts have no words and are scored by what remains. Null sources and languages are values of their own. Without a
    model all scores are 0.5. Other columns pass through; columns named like the scores are replaced. Repeated rows stay repeated; equal rows have equal scores. An empty table gives an empty result.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    as_bytes = documents.withColumn(text, F.col(text).cast("binary")).withColumns({source: F.col(source).cast("string"), lang: F.col(lang).cast("string")})

    def start():
        m, read = shared.value, WordFeatures()

        def work(texts: list, sources: list, langs: list) -> tuple[list, list, list]:
            if m is None:
                return tuple([0.5] * len(texts) for _ in range(3))
            (cw, ca), (mw, ma), both = m["content"], m["meta"], m["both"]
            odds = np.empty((len(texts), 2))
            for i, (t, s, g) in enumerate(zip(texts, sources, langs, strict=True)):
                index = content_features(t, read)
                odds[i, 0] = SCALE["content"] * cw[index].mean() + cw[-1] if len(index) else cw[-1]
                odds[i, 1] = mw[meta_features(t, s, g)].sum() + mw[-1]
            odds = odds * (ca[0], ma[0]) + (ca[1], ma[1])
            return _sigmoid(odds[:, 0]).tolist(), _sigmoid(odds[:, 1]).tolist(), _sigmoid(odds @ both[:2] + both[2]).tolist()

        return work

    return append_columns(as_bytes, [text, source, lang], "content_score double, meta_score double, score double", start, omit=(text,))

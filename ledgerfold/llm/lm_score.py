"""Language-model scores: a log-bilinear neural model, trained in numpy by noise-contrastive estimation.

Counts. All training texts are counted, word by word, by a shuffle that is pre-aggregated in the tasks. Words travel as 64-bit hashes.

Model (Mnih and Hinton's log-bilinear model over two words of context). Every word from ``least_count`` occurrences on, the end of a text and "any
other word" have vectors as contexts; the context's vectors, each times a matrix for its position, add up to a prediction. The outcomes are dealt to about as many
classes as the root of the vocabulary. A token's probability is that of its class times that of the word in it; both are normalised by products of a batch of predictions
with the matrix of the classes, or of one class's words. Words below that count share the probability of "any other word" in proportion to their smoothed counts, so
the model is normalised over all texts.

Vocabulary. ``least_count`` grows with the square root of the tokens, so the vocabulary does too, about: vectors are held whole by every task.

Training. Noise-contrastive estimation at both levels: classes and words are told from classes and words drawn from the unigram, the same for a batch, so a step never sums over
the vocabulary. The model starts as the unigram. Training texts are dealt by hash to ``ROUNDS`` parts, whatever the size, and
each round goes over one part, so that all texts are learned from once: every task learns from its texts of the part, from the same starting
point; the parameters are averaged, each row weighted by how often the task has met it, and the next round starts from there. Parameters travel in slices.

Counts of words in texts. The most frequent words, the vocabulary at least, are broadcast (12 bytes each); each text looks up those by itself. The rest of its words, rare by
definition, are joined to the count table by hash. Nothing is approximated.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm.common import drop, id_bucket, store

HOT_WORDS = 400_000
WIDTH, BATCH, BUFFER, RATE = 16, 256, 1 << 18, 0.1
#: Noise words and noise classes a batch.
SHARED, SHARED_CLASSES = 96, 32
ROUNDS = 4
ADD = 0.1
#: Words that a task counts at once.
FLUSH = 1 << 20
#: Rows of parameters that travel together; tokens scored at once; largest matrix of scores.
SLICE, CHUNK, CELLS = 4096, 1 << 18, 1 << 17
#: The first two outcomes; the words follow.
OTHER, END = 0, 1


def least_count(total: int) -> int:
    """Occurrences from which a word has vectors of its own, for a corpus of so many tokens."""
    return max(3, math.ceil(math.sqrt(total) / 50))


def tokens(text: bytes | None) -> list[bytes]:
    """Words, A-Z lower-cased; the end of the text is not among them."""
    return (text or b"").lower().split()


def hashes(text: bytes | None) -> np.ndarray:
    """The words' 64-bit hashes."""
    words = tokens(text)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


# ---- counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view("<i8")), pa.array(n.astype(np.int64))], ["h", "n"])

    held, size = [], 0
    for batch in batches:
        for text in batch.column(0):
            held.append(hashes(text.as_py()))
            size += len(held[-1])
            if size > FLUSH:
                yield out(held)
                held, size = [], 0
    yield out(held)


# ---- the model


def classes(unigram: np.ndarray) -> np.ndarray:
    """Where each word class starts: runs of words with about equal sums of roots of probabilities; "any other word" and the end are alone."""
    share = np.cumsum(np.sqrt(unigram / unigram.sum()))
    number = np.minimum(share / share[-1] * math.ceil(math.sqrt(len(unigram))), math.ceil(math.sqrt(len(unigram))) - 1e-9).astype(np.int64)
    return np.flatnonzero(np.r_[True, number[1:] != number[:-1]] | (np.arange(len(number)) <= END + 1))


class Model:
    """Vectors of words as context (e), of words and of classes as outcome (w, k), their biases (b, d), and a matrix for each context position (c)."""

    NAMES = ("e", "w", "b", "k", "d", "c")
    BY_WORD = ("e", "w", "b")

    def __init__(self, starts: np.ndarray, unigram: np.ndarray, **arrays: np.ndarray):
        self.starts, self.unigram = starts, unigram
        self.ends = np.append(starts[1:], len(unigram))
        self.of = np.repeat(np.arange(len(starts)), self.ends - starts)
        self.__dict__.update(arrays)

    @classmethod
    def start(cls, unigram: np.ndarray, width: int = WIDTH, seed: int = 5) -> Model:
        """The unigram model, with small random vectors. """
        rng = np.random.default_rng(seed)
        starts, n = classes(unigram), len(unigram)
        whole = np.add.reduceat(unigram, starts)
        inside = unigram / np.repeat(whole, np.diff(np.append(starts, n)))
        draw = lambda rows: (0.1 * rng.standard_normal((rows, width), np.float32)).astype(np.float32)
        return cls(starts, unigram, e=draw(n), w=draw(n), b=np.log(inside).astype(np.float32), k=draw(len(starts)), d=np.log(whole).astype(np.float32), c=np.stack([np.eye(width, dtype=np.float32)] * 2))

    def copy(self) -> Model:
        return Model(self.starts, self.unigram, **{x: getattr(self, x).copy() for x in self.NAMES})

    def log_p(self, w: np.ndarray, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probabilities of the words after their contexts: of the word's class, and of the word in it."""
        out = np.empty(len(w))
        step = max(1, -(-len(w) // max(1, round(len(w) / CHUNK))))  # equal parts, none of them small
        for i in range(0, len(w), step):
            at = slice(i, i + step)
            out[at] = self._log_p(w[at], last[at], before[at])
        return out

    def _log_p(self, w: np.ndarray, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Contexts come again and again: each is normalised once over the classes, and once over the words of each class that follows it."""
        contexts, at = np.unique(last.astype(np.int64) * len(self.e) + before, return_inverse=True)
        last, before = np.divmod(contexts, len(self.e))
        hidden, of = self.e.take(last, axis=0) @ self.c[0] + self.e.take(before, axis=0) @ self.c[1], self.of[w]
        whole, step = np.empty(len(contexts)), max(1, CELLS // len(self.k))
        for i in range(0, len(contexts), step):
            whole[i : i + step] = _log_sum(hidden[i : i + step] @ self.k.T, self.d)
        predicted, ones = hidden.take(at, axis=0), np.ones(self.e.shape[1], np.float32)
        out = ((predicted * self.k.take(of, axis=0)) @ ones + self.d[of]).astype(np.float64) - whole[at]
        many = np.flatnonzero((self.ends - self.starts > 1)[of])  # a class of one word has nothing to tell apart
        pairs, pair = np.unique(of[many] * np.int64(len(contexts)) + at[many], return_inverse=True)  # by class
        kind, context = np.divmod(pairs, len(contexts)) if len(many) else (pairs, pairs)
        inside, cuts = np.empty(len(pairs)), np.flatnonzero(np.diff(kind)) + 1
        for i, j in zip(np.r_[0, cuts], np.r_[cuts, len(pairs)], strict=True) if len(many) else ():  # one matrix product a class
            a, z = self.starts[kind[i]], self.ends[kind[i]]
            vectors, step = self.w[a:z].T, max(1, CELLS // (z - a))
            for x in range(i, j, step):
                part = slice(x, min(x + step, j))
                inside[part] = _log_sum(hidden.take(context[part], axis=0) @ vectors, self.b[a:z])
        words = w[many]
        out[many] += (predicted.take(many, axis=0) * self.w.take(words, axis=0)) @ ones + self.b[words] - inside[pair]
        return out


def _log_sum(s: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Logarithm of the sum of the exponentials of each row of ``s`` plus ``bias``; ``s`` is overwritten."""
    s += bias
    top = 0.0
    if s.max() > 60:
        top = s.max(axis=1)
        s -= top[:, None]
    return np.log(np.exp(s, out=s) @ np.ones(s.shape[1], np.float32)) + top


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """The logistic function of ``-x``, which is overwritten."""
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _put_rows(to: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """``to[rows] = values``, each row copied as one item."""
    whole = f"V{to.itemsize * to.shape[1]}"
    to.view(whole)[:, 0][rows] = values.view(whole)[:, 0]


def _add_rows(to: np.ndarray, squares: np.ndarray, order: np.ndarray, rows: np.ndarray, starts: np.ndarray, grad: np.ndarray, rate: float) -> None:
    """An Adagrad step on ``rows``, each of which may occur often in ``grad``."""
    g = grad.take(order, axis=0)
    pairs = np.result_type(g, np.complex64) if g.shape[1] % 2 == 0 else g.dtype  # two numbers are added as one complex number: half the additions
    g = np.add.reduceat(g.view(pairs), starts, axis=0).view(g.dtype)
    s = squares.take(rows, axis=0)
    s += g * g
    _put_rows(squares, rows, s)
    g *= -rate
    g /= np.sqrt(s, out=s)
    g += to.take(rows, axis=0)
    _put_rows(to, rows, g)


def _grouped(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order by row, the rows, where each begins and how often it occurs."""
    order = at.argsort()
    sorted_at = at[order]
    new = np.ones(len(at) + 1, bool)
    np.not_equal(sorted_at[1:], sorted_at[:-1], out=new[1:-1])
    cuts = new.nonzero()[0]
    starts = cuts[:-1]
    return order, sorted_at[starts], starts, cuts[1:] - starts


class Trainer:
    """Noise-contrastive estimation: classes and words are told from classes and words drawn from the unigram, without any normalisation.

    All tokens of a batch share their noise, so that its scores, of both levels, are one matrix product. Words are told from all words; the scores so learned hold in
    every subset of the words, and so inside a class.
    """

    def __init__(self, model: Model, seed: int, rate: float):
        self.m, self.rng, self.rate = model, np.random.default_rng(seed), rate
        # vectors of words, then of classes, with their biases and a column of zeros (an even number of columns), so that one step moves all; the
        # model has views of them
        n, width = model.e.shape
        self.joined = np.zeros((n + len(model.k), width + 2), np.float32)
        for names, at in (("wb", slice(n)), ("kd", slice(n, None))):
            views = self.joined[at, :width], self.joined[at, width]
            for name, view in zip(names, views, strict=True):
                view[:] = getattr(model, name)
                setattr(model, name, view)
        self.squares = {"e": np.ones_like(model.e), "c": np.ones_like(model.c), "joined": np.ones_like(self.joined)}
        self.hits = {x: np.zeros(n, np.int32) for x in ("e", "w")}
        self.seen = 0
        p = model.unigram / model.unigram.sum()
        whole = np.add.reduceat(p, model.starts)
        self.alone = (model.ends - model.starts == 1)[model.of]
        crowd = np.where(self.alone, 0.0, p)
        self.class_upto, self.word_upto = np.cumsum(whole), np.cumsum(crowd)
        # biases are logarithms inside a class; NCE compares with the unigram of all words that share a class
        shift = (np.log(whole) - math.log(max(crowd.sum(), 1e-300)))[model.of]
        # what an outcome's score must exceed: the logarithm of how often it comes as noise in a batch
        word_gap = np.log(np.maximum(crowd, 1e-300) / max(crowd.sum(), 1e-300)) - shift + math.log(SHARED)
        self.gap = np.concatenate([word_gap, np.log(whole) + math.log(SHARED_CLASSES)]).astype(np.float32)

    def learn(self, w: np.ndarray, last: np.ndarray, before: np.ndarray) -> None:
        """Steps over all tokens in random order; what does not hang on the parameters is looked up for all of them at once."""
        order, n = self.rng.permutation(len(w)), len(self.m.e)
        w, context = w[order], np.stack([last[order], before[order]], axis=1)
        of, alone = self.m.of[w] + n, self.alone[w]
        steps = range(0, len(w), BATCH)
        classes, words = self._draw(len(steps), SHARED_CLASSES, self.class_upto) + n, self._draw(len(steps), SHARED, self.word_upto)
        with np.errstate(over="ignore"):  # of an exponential in a denominator
            for i, *drawn in zip(steps, classes, words, strict=True):
                at = slice(i, i + BATCH)
                self._step(w[at], of[at], alone[at].nonzero()[0], context[at].ravel(), *drawn)
        told = np.add.reduceat(~alone, steps, dtype=int) > 0 if len(w) else np.zeros(0, bool)
        self.hits["e"] += np.bincount(context.ravel(), minlength=n).astype(np.int32)
        self.hits["w"] += np.bincount(np.concatenate([w[~alone], words[told].ravel()]), minlength=n).astype(np.int32)
        self.seen += len(w)

    def _draw(self, steps: int, size: int, upto: np.ndarray) -> np.ndarray:
        """Noise for so many steps."""
        drawn = np.sort(self.rng.random((steps, size)), axis=1)  # found faster in order, which means nothing in a step
        return np.minimum(upto.searchsorted(drawn * upto[-1], side="right"), len(upto) - 1)

    def _step(self, w: np.ndarray, of: np.ndarray, alone: np.ndarray, context: np.ndarray, classes: np.ndarray, words: np.ndarray) -> None:
        """A step on everything that a batch meets: its classes with their noise, its words with theirs, its contexts."""
        m, size, width = self.m, len(w), self.m.e.shape[1]
        both = m.e.take(context, axis=0).reshape(size, 2 * width)  # the matrices of the two positions, one above the other, are one
        c = m.c.reshape(2 * width, width)
        wide = np.zeros((2 * width, width + 2), np.float32)
        wide[:, :width] = c
        hidden = both @ wide
        hidden[:, width] = 1  # for the biases
        sets = np.concatenate([of, classes]), np.concatenate([w, words])
        at = np.concatenate(sets)
        v, gap = self.joined.take(at, axis=0), self.gap.take(at)
        x, y, z = size, len(sets[0]), len(sets[0]) + size
        noise = np.concatenate([v[x:y], v[z:]])
        against = -noise  # scores come out with the other sign, less what they must exceed
        against[:, width] += np.concatenate([gap[x:y], gap[z:]])
        g_noise, ones = _sigmoid(hidden @ against.T), np.ones(width + 2, np.float32)
        if len(alone):  # a class of one word has nothing to tell apart
            g_noise[alone, y - x :] = 0
        g_hidden = g_noise @ noise
        for own, which in ((v[:x], slice(x)), (v[y:z], slice(y, z))):
            g_own = _sigmoid(gap[which] - (hidden * own) @ ones)
            g_own -= 1
            if which.start and len(alone):
                g_own[alone] = 0
            own *= g_own[:, None]
            g_hidden += own
            np.multiply(hidden, g_own[:, None], out=own)
        g_noise = g_noise.T @ hidden
        v[x:y], v[z:] = g_noise[: y - x], g_noise[y - x :]
        (order, rows, starts, _), (more, more_rows, more_starts, _) = map(_grouped, sets)
        _add_rows(self.joined, self.squares["joined"], np.concatenate([order, more + y]), np.concatenate([rows, more_rows]), np.concatenate([starts, more_starts + y]), v, self.rate)
        g_hidden = g_hidden[:, :width]
        g_c = (both.T @ g_hidden).reshape(m.c.shape)
        g_both = (g_hidden @ c.T).reshape(2 * size, width)
        self.squares["c"] += g_c * g_c
        m.c -= self.rate * 0.3 * g_c / np.sqrt(self.squares["c"])
        order, rows, starts, _ = _grouped(context)
        _add_rows(m.e, self.squares["e"], order, rows, starts, g_both, self.rate)


def contexts(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token with the last word before it and the one before that; texts begin after two ends and end with one."""
    size = np.array([len(x) for x in texts], np.int64)
    flat, starts = np.full(size.sum() + 3 * len(size), END, np.int64), np.cumsum(size + 3) - size - 3
    token = np.ones(len(flat), bool)
    token[starts] = token[starts + 1] = False
    word = token.copy()
    word[starts + size + 2] = False
    flat[word] = np.concatenate([np.zeros(0, np.int64), *texts])
    at = np.flatnonzero(token)
    return flat[at], flat[at - 1], flat[at - 2]


class Places:
    """Places of words in a table of distinct hashes, or -1."""

    def __init__(self, table: np.ndarray):
        self.index = pd.Index(table)

    def find(self, texts: list[np.ndarray]) -> np.ndarray:
        """Of all words of the texts, one after the other."""
        return self.index.get_indexer(np.concatenate([np.zeros(0, np.uint64), *texts]))


def _dump(**arrays: np.ndarray) -> bytes:
    file = io.BytesIO()
    np.savez(file, **arrays)
    return file.getvalue()


def _train(shared, seed: int):
    """Rows for each slice of the parameters after a task's texts, with how often each was met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, number, model = shared.value
        places, number = Places(table), np.append(number, OTHER)  # place -1
        trainer, held, size = Trainer(model.copy(), seed, RATE / (1 + seed / 4)), [], 0

        def learn() -> None:
            trainer.learn(*contexts(np.split(number[places.find(held)], np.cumsum([len(x) for x in held])[:-1])))

        for batch in batches:
            for text in batch.column(0):
                held.append(hashes(text.as_py()))
                size += len(held[-1]) + 1
                if size >= BUFFER:
                    learn()
                    held, size = [], 0
        if held:
            learn()
        if trainer.seen:
            m, hits = trainer.m, trainer.hits
            for k, i in enumerate(range(0, len(m.e), SLICE)):
                at = slice(i, i + SLICE)
                blob = _dump(**{x: getattr(m, x)[at] if x in Model.BY_WORD else getattr(m, x) for x in Model.NAMES}, of_e=hits["e"][at], of_w=hits["w"][at], seen=np.array(trainer.seen))
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([blob], pa.binary())], ["slice", "blob"])

    return run


#: What a parameter's rows are weighted by.
_WEIGHT = {"e": "of_e", "w": "of_w", "b": "of_w", "k": "seen", "d": "seen", "c": "seen"}


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each slice in a task, its rows weighted by how often they were met."""
    totals: dict[int, dict] = {}
    for batch in batches:
        for k, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = dict(np.load(io.BytesIO(blob.as_py())))
            new = {i: (x[i].T * x[of].astype(float)).T for i, of in _WEIGHT.items()} | {i: x[i] for i in ("of_e", "of_w", "seen")}
            totals[k] = {i: totals[k][i] + new[i] for i in new} if k in totals else new
    for k, x in totals.items():
        blob = _dump(**{i: (x[i].T / np.maximum(x[of], 1)).T.astype(np.float32) for i, of in _WEIGHT.items()}, of_e=x["of_e"] > 0, of_w=x["of_w"] > 0)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([blob], pa.binary())], ["slice", "blob"])


def _learn(texts: DataFrame, model: Model, table: np.ndarray, number: np.ndarray, rounds: int) -> Model:
    """The model after so many rounds, each over its part of the texts."""
    spark = texts.sparkSession
    for i in range(rounds):
        shared = spark.sparkContext.broadcast((table, number, model))
        part = texts.filter(F.pmod(F.xxhash64("text", F.lit(29)), F.lit(rounds)) == i)
        trained, path = store(part.mapInArrow(_train(shared, i), "slice int, blob binary"), "lm-parameters")
        model = model.copy()
        for row in trained.repartition("slice").mapInArrow(_average, "slice int, blob binary").toLocalIterator():  # in all as large as the model
            x, at = np.load(io.BytesIO(row["blob"])), row["slice"] * SLICE
            for name, of in _WEIGHT.items():
                if name in Model.BY_WORD:
                    met = np.flatnonzero(x[of])
                    getattr(model, name)[at + met] = x[name][met]
                else:
                    setattr(model, name, x[name])
        drop(spark, path)
        shared.destroy()
    return model


# ---- scoring


def _runs(texts: pa.Array) -> Iterator[list[int]]:
    """Places of texts, in runs of a bounded number of bytes (longer texts are alone)."""
    run, size = [], 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if run and size + n > 8 * CHUNK:
            yield run
            run, size = [], 0
        run.append(i)
        size += n
    if run:
        yield run


def _score(shared):
    """A row for each text (h null: sums over the end and hot words) and for each of its other words (h, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counts, short, model, end_count, totals = shared.value
        places, short = Places(table), np.append(short, OTHER)  # place -1
        base_denominator, other_denominator = totals
        log_count, log10e = np.append(np.log10(counts + ADD), 0.0), math.log10(math.e)  # counts of words that are not hot come later
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

        def rows(*columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["rid", "doc", "h", "n", "known", "base", "score"])

        for batch in batches:
            for run in _runs(batch.column(2)):  # so many texts that their tokens fill the matrices
                part = batch.slice(run[0], len(run))
                rid, doc = part.column(0), part.column(1)
                found = [hashes(x.as_py()) for x in part.column(2)]
                size = np.array([len(x) for x in found])
                at, of = places.find(found), np.repeat(np.arange(len(run)), size)
                number = short[at]
                log_p = np.add.reduceat(model.log_p(*contexts(np.split(number, np.cumsum(size)[:-1]))), np.cumsum(np.r_[0, size + 1])[:-1])
                # a word outside the vocabulary also pays for its share of "any other word"
                others, counted = number == OTHER, log_count[at]
                score = log_p * log10e + np.bincount(of, np.where(others, counted - other_denominator, 0.0), len(run))
                base = np.bincount(of, counted, len(run)) + math.log10(end_count + ADD) - (size + 1) * base_denominator
                known = np.bincount(of, at >= 0, len(run)).astype(np.int64) + (end_count > 0)
                yield rows(rid, doc, pa.nulls(len(run), pa.int64()), size + 1, known, base, score)
                rest = at < 0
                h, of = np.concatenate([np.zeros(0, np.uint64), *found])[rest], of[rest]
                order = np.lexsort((h, of))
                h, of = h[order], of[order]
                new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])][: len(h)])
                n, zeros, of = np.diff(np.r_[new, len(h)]), np.zeros(len(new)), pa.array(of[new])
                yield rows(rid.take(of), doc.take(of), h[new].view(np.int64), n, zeros.astype(np.int64), zeros, zeros)

    return run


def score_texts(documents: DataFrame, training: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shortlist: int | None = None, hot_words: int = HOT_WORDS) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of ``documents``, learned from ``training``.

    Tokens are the words (runs without blanks, A-Z lower-cased) and one end a text; null, empty and blank texts have the end alone.
    ``base_score`` is the sum over tokens of log10((c + 0.1) / (N + 0.1 (V + 1))), with the token's count c, all N and distinct V tokens of the
    training texts; ``score`` is the model's log10 probability of the text. ``n_known`` counts tokens with c > 0. Without training texts every
    count is 0 and the model is the unigram one over "any other word" and the end. Repeated rows are scored each. Rows are told apart by their place in
    the input: ``documents`` must be a scan, or another frame that gives the same rows in the same order when recomputed. Texts of any length are read whole, one after the
    other. Other columns are ignored, whatever their names. An empty table gives an empty result.
    Words from ``least_count`` occurrences on have vectors; a caller that wants a smaller model gives the number of words as ``shortlist``.
    """
    spark = documents.sparkSession
    texts = training.select(F.col(text).cast("binary").alias("text"))
    counts, _ = store(texts.mapInArrow(_count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "word-counts")
    ends = training.count()
    words, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, distinct = words + ends, kinds + (ends > 0)
    # The smallest count from which at most ``hot_words`` words are; counts in steps of an eighth of a power of two.
    steps = counts.groupBy(F.ceil(F.log2("n") * 8).cast("int").alias("step")).agg(F.count("*").alias("kinds"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()  # some hundred rows at most
    least, room = None, hot_words
    for row in steps:
        if row["kinds"] > room:
            break
        least, room = row["least"], room - row["kinds"]
    if shortlist is None:  # the vocabulary is hot
        least = min(least_count(total), least if least is not None else 2**62)
    hot = counts.filter(F.col("n") >= least).toPandas() if least is not None else pd.DataFrame({"h": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})
    hot_hash, hot_n = hot["h"].to_numpy().view(np.uint64), hot["n"].to_numpy()
    order = np.argsort(hot_hash)
    hot_hash, hot_n = hot_hash[order], hot_n[order]

    ranked = np.lexsort((hot_hash, -hot_n))
    ranked = ranked[hot_n[ranked] >= least_count(total)] if shortlist is None else ranked[:shortlist]
    short = np.zeros(len(hot_hash), np.int32)
    short[ranked] = np.arange(END + 1, END + 1 + len(ranked))
    in_short = int(hot_n[ranked].sum())
    unigram = np.r_[words - in_short, ends, hot_n[ranked]].astype(np.float64) + 0.5
    model = Model.start(unigram / unigram.sum())
    if total:
        model = _learn(texts, model, hot_hash[short > 0], short[short > 0], ROUNDS)

    denominators = (math.log10(total + ADD * (distinct + 1)), math.log10(words - in_short + ADD * (kinds - len(ranked) + 1)))
    shared = spark.sparkContext.broadcast((hot_hash, hot_n, short, model, ends, denominators))
    rows = documents.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("binary").alias("text"))
    rows, _ = store(rows.mapInArrow(_score(shared), "rid long, doc long, h long, n long, known long, base double, score double"), "lm-rows")
    rare = rows.filter("h is not null").select("rid", "h", "n").join(counts.filter(F.col("n") < (least if least is not None else 2**62)).select("h", F.col("n").alias("c")), "h", "left")
    share = F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(ADD)))
    rare = rare.groupBy("rid").agg(F.lit(None).cast("long").alias("doc"), F.lit(0).cast("long").alias("n"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"), share.alias("base"), share.alias("score"))
    whole = rows.filter("h is null").select("rid", "doc", "n", "known", "base", "score").unionByName(rare).groupBy("rid")
    whole = whole.agg(F.max("doc").alias(doc_id), F.sum("n").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return whole.select(doc_id, "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def training_rows(documents: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Rows to learn from: crc32 of the id as text, modulo 10, is not 0."""
    return documents.filter(id_bucket(F.col(doc_id), 10) != 0)

"""Toxicity of whole texts by a weighted finite-state pattern grammar.

Five small transducers read the words of a text from left to right. Each has a little state and, where a word matches, one output:

* insult: whether another match lies a few clauses back (an attack that goes on) or the word stands alone,
* threat: whether a threat follows a word of intent ("will", "werde", ...) in its clause, or is bare,
* target: whether someone was addressed (you, your ...) in the clause before the match,
* negation: whether the match is within a few words of a negation,
* reported speech: whether it comes after a word of saying in its clause, or in quotation marks.

They are composed into one machine, whose states are tuples of the parts' states and whose transitions are worked out when first taken. A matched word takes
an arc, which is the tuple of the five outputs and the kind of match, and counts its weight times the arc's factor. The factors are fitted to labelled texts: a
logistic model over the sums of weights by output, drawn towards the stated prior. A clause's score is the sum over its matches; a text's score comes from its worst
clause, from all clauses and from their density, calibrated on labelled texts. Words alone never score: a match counts only if its arc says that the attack goes on, that someone
is addressed or that a threat is intended.

The lexicon is itself a weighted automaton, a trie of whole words and stems (a stem accepts every word that begins with it). A short list of
fixed words seeds it; labelled texts supply the rest. Per word and per stem, occurrences in labelled texts of each label are counted (a word
once a text), and it is accepted if a binomial bound, corrected for the number of patterns tried, says that its share of
toxic texts exceeds the base rate; a stem must pass without the words and longer stems that passed. The weight is the log odds. By the same bound, accepted words that
follow words of intent more often than others are threats, and other words that are more frequent in matched clauses of toxic texts are targets; the rest are insults.
The labelled sample is bounded (``max_labelled`` a class), everything else covers all rows.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm.common import append_columns, id_bucket, store

# Seed words of the five roles.
INSULTS = {w: 2.5 for w in "idiot idiots moron morons imbecile stupid dumb loser losers scum trash worthless pathetic disgusting clown cretin vermin filth scumbag bastard asshole bitch fool".split()}
THREATS = {w: 2.0 for w in "kill hurt destroy beat stab shoot burn hunt crush strangle murder".split()}
TARGETS = set("you your yours yourself they them their he she him her u ur du dich dir dein deine ihr euch sie tu te toi ton ta vous votre tú usted ustedes ti vosotros su".split())
NEGATIONS = set("not no never none nobody without isn't aren't wasn't don't doesn't didn't nicht kein keine nie niemals ne pas jamais aucun sin nunca ningún ninguno jamás".split())
REPORTS = set("said says say saying called calls claimed claims reported reports wrote writes quoted told alleged sagte sagt schrieb nannte dit écrit raconte dijo dice escribió llamó".split())
INTENTS = set("will going gonna shall must should would werde wirst wird sollst soll vais va vas voy irá debe".split())
QUOTES = set('"“”«»„')
ENDS = set(".!?;\n…")

TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;…\n\"“”«»„]")
STEMS = range(3, 9)
MAX_LABELLED = 8_000
ERROR = 0.01
MIN_ODDS = 1.5
NEGATION_REACH, INTENT_REACH, ATTACK_CLAUSES = 3, 4, 12
#: Outputs of a match and, from before any fit, what each adds to the base factor of a match that counts.
OUTPUTS = ("threat", "sustained", "intended", "addressed", "negated", "reported")
PRIOR_BASE, PRIOR = 0.6, {"threat": -0.4, "sustained": 0.4, "intended": 0.8, "addressed": 0.3, "negated": -0.45, "reported": -0.45}
#: Of a factor; a text's sum of weights in the fit; how far a fit can take a factor from the prior.
LEAST_FACTOR, MOST_WEIGHT, MOST_SHIFT = 0.02, 30.0, 1.0
MATCHES = ("insult", "threat")

# ---- the transducers: start state, and (state, role) -> (state, output of a match)


def _insult(state: int, role: str) -> tuple[int, bool]:
    """State: for how many clauses an attack is still going on."""
    if role in MATCHES:
        return ATTACK_CLAUSES, state > 0
    return (max(0, state - 1) if role == "end" else state), False


def _threat(state: int, role: str) -> tuple[int, bool]:
    """State: for how many words an intent is still open."""
    if role == "intent":
        return INTENT_REACH, False
    return (0 if role == "end" else max(0, state - 1)), role == "threat" and state > 0


def _target(state: bool, role: str) -> tuple[bool, bool]:
    return (role == "target" or state and role != "end"), state


def _negation(state: int, role: str) -> tuple[int, bool]:
    if role == "negation":
        return NEGATION_REACH, False
    return (0 if role == "end" else max(0, state - 1)), state > 0


def _report(state: tuple[bool, bool], role: str) -> tuple[tuple[bool, bool], bool]:
    """State: a word of saying in the clause, and an open quotation, which may span clauses."""
    said, quoted = state
    if role == "report":
        return (True, quoted), False
    if role == "quote":
        return (said, not quoted), False
    return ((False, quoted) if role == "end" else state), said or quoted


class Grammar:
    """The composition of the transducers."""

    PARTS = (_insult, _threat, _target, _negation, _report)
    START = (0, 0, False, 0, (False, False))

    def __init__(self):
        self.steps: dict[tuple, tuple[tuple, tuple]] = {}

    def step(self, state: tuple, role: str) -> tuple[tuple, tuple]:
        """The next state and, for a match, its arc."""
        key = (state, role)
        if key not in self.steps:
            got = [part(x, role) for part, x in zip(self.PARTS, state, strict=True)]
            self.steps[key] = tuple(x for x, _ in got), (role == "threat", *(o for _, o in got))
        return self.steps[key]

    def read(self, roles: list[tuple[str, float]]) -> list[tuple[int, tuple, float]]:
        """(clause, arc, weight) of every match."""
        state, clause, out = self.START, 0, []
        for role, weight in roles:
            state, arc = self.step(state, role)
            if role == "end":
                clause += 1
            elif role in MATCHES:
                out.append((clause, arc, weight))
        return out


#: Outputs of which a match must have one to count at all: a word that stands alone, meant for nobody, is no evidence.
COUNTED = ("sustained", "intended", "addressed")


def counts(arc: tuple) -> bool:
    return any(on for name, on in zip(OUTPUTS, arc, strict=True) if name in COUNTED)


def arc_factor(arc: tuple, factors: dict[str, float]) -> float:
    if not counts(arc):
        return 0.0
    return max(LEAST_FACTOR, factors["base"] + sum(factors[name] for name, on in zip(OUTPUTS, arc, strict=True) if on))


PRIOR_FACTORS = {"base": PRIOR_BASE, **PRIOR}


class Lexicon(dict):
    """Role and weight of a word, looked up in the trie of words and stems and remembered up to a bound."""

    LIMIT = 100_000
    PLAIN = ("word", 0.0)

    def __init__(self, learned: dict[str, float], threats: set[str] = frozenset(), targets: set[str] = frozenset()):
        super().__init__()
        self.threats, self.targets = THREATS.keys() | set(threats), TARGETS | set(targets)
        self.words = {w[:-1]: x for w, x in learned.items() if w.endswith("$")}
        self.stems = {w: x for w, x in learned.items() if not w.endswith("$")}

    def __missing__(self, word: str) -> tuple[str, float]:
        if len(self) >= self.LIMIT:
            self.clear()
        out = self[word] = self._read(word)
        return out

    def _read(self, w: str) -> tuple[str, float]:
        if w in ENDS:
            return "end", 0.0
        if w in QUOTES:
            return "quote", 0.0
        w = w.replace("’", "'")
        weight = self.words.get(w)
        for n in sorted(STEMS, reverse=True) if weight is None else ():
            if len(w) >= n and (weight := self.stems.get(w[:n])) is not None:
                break
        if weight is None:
            weight = INSULTS.get(w) or THREATS.get(w)
        if weight is not None:
            return ("threat" if w in self.threats else "insult"), weight
        for role, known in (("target", self.targets), ("negation", NEGATIONS), ("report", REPORTS), ("intent", INTENTS)):
            if w in known:
                return role, 0.0
        return self.PLAIN


def matches(text: str | None, lexicon: Lexicon, grammar: Grammar) -> tuple[list[tuple[int, tuple, float]], int]:
    """Every match of a text, and how many tokens the text has."""
    words = TOKEN.findall((text or "").lower())
    roles = [lexicon[w] for w in words]
    return (grammar.read(roles) if any(x for _, x in roles) else []), len(words)


def features(found: list[tuple[int, tuple, float]], n: int, factors: dict[str, float]) -> tuple[float, float, float]:
    """Score of the worst clause, log of one plus the sum over all clauses, and log of one plus the sum per hundred words."""
    clauses: dict[int, float] = {}
    for clause, arc, weight in found:
        clauses[clause] = clauses.get(clause, 0.0) + weight * arc_factor(arc, factors)
    total = sum(clauses.values())
    return (max(clauses.values()), math.log1p(total), math.log1p(100 * total / n)) if clauses else (0.0, 0.0, 0.0)


# ---- learning


def patterns(text: str | None) -> Counter:
    """The text's words (marked by a final $), and for each stem how many of its words the text has."""
    words = {w for w in TOKEN.findall((text or "").lower()) if len(w) > 1}
    out = Counter({f"{w}$": 1 for w in words})
    for n in STEMS:
        out.update(w[:n] for w in words if len(w) >= n)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of :func:`patterns` by label and fold, pre-aggregated over a batch."""
    for batch in batches:
        counts: dict[tuple[int, int], Counter] = {}
        for fold, toxic, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            counts.setdefault((fold, toxic), Counter()).update(patterns(text))
        for (fold, toxic), found in counts.items():
            n = len(found)
            columns = [pa.array(found.keys(), pa.string()), pa.array([fold] * n, pa.int32()), pa.array([toxic] * n, pa.int32()), pa.array(found.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["pattern", "fold", "toxic", "n"])


def _log_tail(t: int, n: int, p: float) -> float:
    """A bound (Chernoff) on the log of the probability of t or more successes of n, each with probability p."""
    q = t / n
    if q <= p:
        return 0.0
    return -n * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0.0))


def accept(counts: dict[str, tuple[int, int]], toxic: int, clean: int, tried: int) -> dict[str, float]:
    """Patterns that pass, with weights. ``toxic`` and ``clean`` are the numbers of all words counted under either label."""
    if not toxic or not clean:
        return {}
    base, bound, out = toxic / (toxic + clean), math.log(ERROR / max(1, tried)), {}
    inside: dict[str, tuple[int, int]] = {}  # what longer patterns that passed have taken from a stem
    levels: dict[int, set[str]] = {}
    for p in counts:
        levels.setdefault(len(p) + 100 * p.endswith("$"), set()).add(p)
    for level in [*sorted((k for k in levels if k > 100), reverse=True), *reversed(STEMS)]:
        for p in sorted(levels.get(level, ())):
            t, n = counts.get(p, (0, 0))
            a, b = inside.get(p, (0, 0))
            odds = math.log((t + 0.5) / (toxic + 1)) - math.log((n + 0.5) / (clean + 1))
            if t - a >= 3 and odds >= MIN_ODDS and _log_tail(t - a, max(t - a, t - a + n - b), base) <= bound:
                out[p] = odds
                a, b = t, n
            parent = p[:-1][: max(STEMS)] if p.endswith("$") else p[:-1]
            if len(parent) in STEMS and (a or b):
                x, y = inside.get(parent, (0, 0))
                inside[parent] = (x + a, y + b)
                levels.setdefault(len(parent), set()).add(parent)
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5, towards: np.ndarray | None = None) -> np.ndarray:
    """Coefficients (the intercept last), by Newton's method with a ridge around ``towards`` (0)."""
    x = np.column_stack([x, np.ones(len(x))])
    b, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    centre = np.zeros(x.shape[1]) if towards is None else np.append(towards, 0.0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ (b - centre))
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit_factors(found: list[list[tuple[int, tuple, float]]], y: np.ndarray, weight: np.ndarray) -> dict[str, float]:
    """What each output adds to the factor of a match: a logistic model over the sums of weights by output, drawn towards the prior."""
    sums = np.array([[sum(w for _, arc, w in m if k < 0 or arc[k]) for k in range(-1, len(OUTPUTS))] for m in ([x for x in t if counts(x[1])] for t in found)], float).reshape(len(found), -1)
    sums *= np.minimum(1.0, MOST_WEIGHT / np.maximum(sums[:, :1], 1e-9))  # a text of very many matches counts as one of many
    prior = np.array([PRIOR_BASE, *PRIOR.values()])
    scale = max(0.05, fit_logistic(sums @ prior[:, None], y, weight)[0])
    b = fit_logistic(sums, y, weight, ridge=20.0, towards=scale * prior)[:-1] / scale
    return dict(zip(("base", *OUTPUTS), np.clip(b, prior - MOST_SHIFT, prior + MOST_SHIFT).tolist(), strict=True))


def _clauses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The clauses of texts, their words joined by spaces."""
    for batch in batches:
        out = []
        for text in batch.column(0).to_pylist():
            clause: list[str] = []
            for w in [*TOKEN.findall((text or "").lower()), "."]:
                if w not in ENDS:
                    clause.append(w)
                elif clause:
                    out.append(" ".join(clause))
                    clause = []
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["clause"])


def _contexts(lexicon: dict[str, float]):
    """For each word of clauses: occurrences, those in clauses with a match of another word, those after an intent, and whether the word matches itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Lexicon(lexicon)
        for batch in batches:
            n, near, after = Counter(), Counter(), Counter()
            for clause in batch.column(0).to_pylist():
                words = clause.split(" ")
                roles = [read[x][0] for x in words]
                hits, open_ = sum(r in MATCHES for r in roles), 0
                for x, r in zip(words, roles, strict=True):
                    if r in MATCHES or r == "word":  # the others have their role
                        n[x] += 1
                        near[x] += hits > (r in MATCHES)
                        after[x] += open_ > 0
                    open_ = INTENT_REACH if r == "intent" else max(0, open_ - 1)
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), *[pa.array([c[x] for x in n], pa.int64()) for c in (n, near, after)], pa.array([read[x][0] in MATCHES for x in n], pa.bool_())], ["word", "n", "near", "after", "hit"])

    return run


def learn_roles(toxic: DataFrame, lexicon: dict[str, float]) -> tuple[list[str], list[str]]:
    """Threats among the words that match, and targets among the others, by corrected binomial bounds on their contexts in the different clauses of toxic texts; copies are no further evidence."""
    words = toxic.mapInArrow(_clauses, "clause string").distinct().mapInArrow(_contexts(lexicon), "word string, n long, near long, after long, hit boolean").groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "near", "after")], F.max("hit").alias("hit"))
    words, _ = store(words, "toxicity-contexts")
    n, near, after, tried = words.agg(F.sum("n"), F.sum("near"), F.sum("after"), F.count("*")).first()  # four numbers
    if not n:
        return [], []
    bound = math.log(ERROR / tried)
    # Only words whose shares are high come to the driver; their number is bounded by the sample.
    passed = {}
    for name, share, chosen in (("threat", max(after, 1) / n, F.col("hit") & (F.col("after") * n > 3 * F.lit(after) * F.col("n"))), ("target", max(near, 1) / n, ~F.col("hit") & (F.col("near") * n > 3 * F.lit(near) * F.col("n")))):
        column = "after" if name == "threat" else "near"
        passed[name] = sorted(r["word"] for r in words.filter(chosen & (F.col(column) >= 5)).collect() if _log_tail(r[column], r["n"], min(share, 0.999)) <= bound)
    return passed["threat"], passed["target"]


def train(documents: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", max_labelled: int = MAX_LABELLED) -> dict:
    """A model from labelled texts: at most ``max_labelled`` of each label, those with the smallest hashes of their ids.

    Labels that are null or not 0 or 1 are left out; of several labels for one id the largest counts. Without texts of both
    labels, as in empty tables, the seed words and a fixed calibration remain.
    """
    known = labels.select(F.col(doc_id).alias("id"), F.col(toxic).cast("int").alias("toxic")).filter("id is not null and toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    order = F.xxhash64("id", F.lit(11))
    picked = None
    for value in (0, 1):
        part = known.filter(F.col("toxic") == value).orderBy(order, "id").limit(max_labelled)
        picked = part if picked is None else picked.unionByName(part)
    # At most 2 * max_labelled short rows are broadcast, so the texts need no shuffle.
    sample = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(picked), "id").select(F.pmod(order, F.lit(2)).cast("int").alias("fold"), "toxic", "text")
    sample, _ = store(sample, "toxicity-sample")
    size = {(r["fold"], r["toxic"]): r["count"] for r in sample.groupBy("fold", "toxic").count().collect()}  # four rows
    counts = sample.mapInArrow(_count, "pattern string, fold int, toxic int, n long").groupBy("pattern")
    cell = lambda f, t: F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == t), F.col("n")).otherwise(0))
    counts = counts.agg(*[cell(f, t).alias(f"n{f}{t}") for f in (0, 1) for t in (0, 1)])
    all_toxic, all_clean = (sum(size.get((f, t), 0) for f in (0, 1)) for t in (1, 0))
    counts, _ = store(counts, "toxicity-patterns")
    word = F.col("pattern").endswith("$")
    all_words = counts.filter(word).agg(*[F.sum(f"n{f}{t}").alias(f"n{f}{t}") for f in (0, 1) for t in (0, 1)]).first()  # four numbers
    counts = counts.filter("n01 + n11 >= 3")
    tried = counts.count()
    toxic_words, clean_words = (sum(all_words[f"n{f}{t}"] or 0 for f in (0, 1)) for t in (1, 0))
    # Only patterns whose odds can pass come to the driver; their number is bounded by the sample.
    likely = counts.filter((F.col("n01") + F.col("n11")) * max(1, clean_words) > math.exp(MIN_ODDS) / 2 * (F.col("n00") + F.col("n10") + 0.5) * max(1, toxic_words)).toPandas()
    rows = list(likely.itertuples(index=False))

    def lexicon(folds: tuple[int, ...]) -> dict[str, float]:
        got = {r.pattern: (sum(getattr(r, f"n{f}1") for f in folds), sum(getattr(r, f"n{f}0") for f in folds)) for r in rows}
        return accept(got, *(sum(all_words[f"n{f}{t}"] or 0 for f in folds) for t in (1, 0)), tried)

    learned = lexicon((0, 1))
    threats, targets = learn_roles(sample.filter("toxic = 1").select("text"), learned)
    model = {"lexicon": learned, "threats": threats, "targets": targets, "factors": PRIOR_FACTORS, "calibration": [1.0, 1.0, 0.0, -3.0]}
    if all_toxic >= 10 and all_clean >= 10:
        crossed = {0: lexicon((1,)), 1: lexicon((0,))}  # a text is read with words learned from the other half

        def start():
            read, grammar = {f: Lexicon(x, threats, targets) for f, x in crossed.items()}, Grammar()

            def work(folds: list, texts: list) -> tuple:
                got = [matches(t, read[f], grammar) for f, t in zip(folds, texts, strict=True)]
                return [[(c, [int(o) for o in arc], w) for c, arc, w in m] for m, _ in got], [n for _, n in got]

            return work

        read = append_columns(sample.select("fold", "toxic", "text"), ["fold", "text"], "found array<struct<clause: int, arc: array<int>, weight: double>>, n long", start, omit=("text",)).collect()  # the bounded sample
        found = [[(x["clause"], tuple(x["arc"]), x["weight"]) for x in r["found"]] for r in read]
        y = np.array([r["toxic"] for r in read], float)
        weight = np.where(y == 1, totals[1] / all_toxic, totals[0] / all_clean) * len(y) / (totals[0] + totals[1])
        model["factors"] = fit_factors(found, y, weight)
        x = np.array([features(m, r["n"], model["factors"]) for m, r in zip(found, read, strict=True)])
        model["calibration"] = fit_logistic(x, y, weight).tolist()
    return model


def score_toxicity(documents: DataFrame, model: dict, *, text: str = "text", score: str = "score", keep_text: bool = True) -> DataFrame:
    """``documents`` with a score from 0 to 1 for each whole text.

    Only the text counts. Null, empty and word-free texts get the score of a text in which nothing matched; texts with equal matches and lengths have equal scores. An empty table gives an empty result. Long texts are
    read to their end. Repeated rows stay repeated; other columns pass through, and a column named like the score is replaced. There is no shuffle.
    """
    shipped = json.dumps(model)

    def start():
        m = json.loads(shipped)
        lexicon, grammar, (a, b, c, d) = Lexicon(m["lexicon"], m["threats"], m["targets"]), Grammar(), m["calibration"]

        def work(texts: list) -> tuple[list]:
            got = (features(*matches(t, lexicon, grammar), m["factors"]) for t in texts)
            return ([1 / (1 + math.exp(-max(-30.0, min(30.0, a * x + b * y + c * z + d)))) for x, y, z in got],)

        return work

    return append_columns(documents, [text], f"{score} double", start, omit=() if keep_text else (text,))


def training_rows(documents: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Rows from which labels may be learned: crc32 of the id as text, modulo 4, is not 2."""
    return documents.filter(id_bucket(F.col(doc_id), 4) != 2)

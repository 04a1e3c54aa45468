"""Toxicity, language model, co-training and main text: held-out accuracy, brute force and edge cases."""

import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerfold.llm import cotraining, html_extract, lm_score, toxicity

WORDS = "the of and river stone walk garden letter market window table morning paper street winter silver music corner".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def labelled(n=600):
    """Toxic texts have words of an invented stem, which differ from text to text."""
    rng = random.Random(4)
    rows = []
    for i in range(n):
        words, toxic = prose(rng, rng.randrange(20, 120)).split(), i % 4 == 0
        if toxic:
            for _ in range(rng.randrange(2, 5)):
                words.insert(rng.randrange(len(words)), "grumbo" + rng.choice(["l", "x", "st", "nd", "ria", "mel", "to"]) + rng.choice("abcdefgh"))
        rows.append((i, " ".join(words) + ".", int(toxic)))
    return rows


EDGES = [(9001, None), (9002, ""), (9003, " \n"), (9004, "word"), (None, "the of and"), (9005, "the " * 30_000 + "grumbolx")]


@pytest.fixture(scope="module")
def toxic_model(spark):
    rows = [r for r in labelled() if r[0] % 3]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (1, None), (2, 7)], "doc_id long, toxic int")
    return toxicity.train(docs, labels)


def test_toxicity_held_out(spark, toxic_model):
    rows = [r for r in labelled() if r[0] % 3 == 0]
    out = toxicity.score_toxicity(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), toxic_model).collect()
    truth = dict((r[0], r[2]) for r in rows)
    assert sum((r.score >= 0.3) == bool(truth[r.doc_id]) for r in out) >= 0.98 * len(out)


def test_toxicity_edges(spark, toxic_model):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in EDGES + EDGES[:1]], "doc_id long, text string, score string, predicted int")
    out = toxicity.score_toxicity(docs, toxic_model)
    rows = out.collect()
    assert len(rows) == len(EDGES) + 1 and all(0 <= r.score <= 1 for r in rows) and out.columns == ["doc_id", "text", "predicted", "score"]
    assert len({r.score for r in rows if r.doc_id in (9001, 9002, 9003, 9004)}) == 1
    none = spark.createDataFrame([], "doc_id long, text string")
    untrained = toxicity.train(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert untrained["lexicon"] == {} and toxicity.score_toxicity(none, untrained).count() == 0


def worst(text, lexicon=None, factors=toxicity.PRIOR_FACTORS):
    return toxicity.features(*toxicity.matches(text, toxicity.Lexicon({}) if lexicon is None else lexicon, toxicity.Grammar()), factors)[0]


def test_toxicity_grammar():
    """Clauses count, not words: address, intent and attacks that go on raise, negation and reported speech lower."""
    assert worst("you are an idiot.") > worst("you, he said, are an idiot.") > 0
    assert worst("you are not an idiot.") < worst("you are an idiot.")
    assert worst('you "idiot".') < worst("you idiot.")
    assert worst("i will kill you.") > 0
    assert worst("an idiot. a moron.") > 0
    assert worst("an idiot.") == worst("kill the lights.") == worst("an idiot." + " the walk." * 20 + " a moron.") == worst("the garden.") == 0


def test_transducers_against_looking_back():
    """The composed machine gives each match what a plain look at the words before it gives."""
    rng, lexicon = random.Random(3), toxicity.Lexicon({})
    pool = ["idiot", "kill", "you", "not", "said", '"', ".", "will", "stone", "walk", "the", "\n"]
    for _ in range(400):
        tokens = [rng.choice(pool) for _ in range(rng.randrange(1, 40))]
        text = " ".join(tokens)
        roles = [lexicon[w][0] for w in toxicity.TOKEN.findall(text)]
        want = []
        for i, role in enumerate(roles):
            if role not in toxicity.MATCHES:
                continue
            since = max((j for j in range(i) if roles[j] == "end"), default=-1) + 1
            clause = roles[since:i]
            earlier = [j for j in range(i) if roles[j] in toxicity.MATCHES]
            sustained = bool(earlier) and roles[earlier[-1] : i].count("end") < toxicity.ATTACK_CLAUSES
            intent = [i - j for j in range(since, i) if roles[j] == "intent"]
            negation = [i - j for j in range(since, i) if roles[j] == "negation"]
            want.append((roles[:i].count("end"), (
                role == "threat", sustained, role == "threat" and bool(intent) and min(intent) <= toxicity.INTENT_REACH, "target" in clause,
                bool(negation) and min(negation) <= toxicity.NEGATION_REACH, "report" in clause or roles[:i].count("quote") % 2 == 1,
            )))
        assert [(c, a) for c, a, _ in toxicity.matches(text, lexicon, toxicity.Grammar())[0]] == want, text


def test_threats_and_targets_are_learned(spark):
    rng = random.Random(8)
    toxic = []
    for _ in range(60):
        clauses = [prose(rng, 6) for _ in range(8)]
        clauses[rng.randrange(8)] = f"{prose(rng, 2)} will zapt {prose(rng, 1)} vosk"
        clauses[rng.randrange(8)] = f"{prose(rng, 3)} grumb vosk {prose(rng, 1)}"
        clauses[rng.randrange(8)] += " grumb"
        toxic.append((". ".join(clauses) + ".",))
    threats, targets = toxicity.learn_roles(spark.createDataFrame(toxic, "text string").coalesce(1), {"zapt$": 3.0, "grumb$": 3.0})
    assert threats == ["zapt"] and targets == ["vosk"]
    lexicon = toxicity.Lexicon({"zapt$": 3.0, "grumb$": 3.0}, set(threats), set(targets))
    assert worst("will zapt the stone.", lexicon) > worst("zapt the stone.", lexicon) and worst("vosk is a grumb.", lexicon) > worst("it is a grumb.", lexicon)


def test_factors_are_fitted():
    """Where addressed matches occur in clean texts and attacks that go on in toxic ones, the fit moves the factor from one to the other; matches that don't count change nothing."""
    alone, told, goes_on = (False,) * 6, (False, False, False, True, False, False), (False, True, False, False, False, False)
    found, y = [[(0, told, 9.0)]] * 3000 + [[(0, told, 3.0), (1, goes_on, 3.0)]] * 3000, np.r_[np.zeros(3000), np.ones(3000)]
    got = toxicity.fit_factors(found, y, np.ones(6000))
    assert got["sustained"] > toxicity.PRIOR["sustained"] + 0.2 and got["addressed"] < toxicity.PRIOR["addressed"]
    assert toxicity.fit_factors([[(0, alone, 50.0), *m] for m in found], y, np.ones(6000)) == got


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test data here")
def test_the_grammar_decides_on_the_supplied_texts(spark, monkeypatch):
    """With every match counting the same, and factors and calibration fitted to that, more held-out texts are judged wrong; words alone never score."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    known = docs.select("doc_id", "text").join(labels.select("doc_id", "toxic"), "doc_id").filter(toxicity.id_bucket(F.col("doc_id"), 4) == 2)

    def run():
        model = toxicity.train(toxicity.training_rows(docs), toxicity.training_rows(labels))
        rows = toxicity.score_toxicity(known, model, keep_text=False).select("toxic", (F.col("score") >= 0.3).cast("int").alias("called")).collect()
        return model, sum(r.called and not r.toxic for r in rows), sum(r.toxic and not r.called for r in rows), sum(r.toxic for r in rows)

    model, false, missed, toxic = run()
    assert false <= 1 and missed <= 0.07 * toxic
    texts = {"idiot": 0, "The idiot walked home. It was late": 0, "kill": 0, "": 0, "you are an idiot": 1, "i will kill you": 1, "Du idiot. So dumm bist du, du moron": 1}
    scores = {r.text: r.score for r in toxicity.score_toxicity(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()}
    assert all(scores[t] > 0.8 if want else scores[t] < 0.1 for t, want in texts.items()), scores
    monkeypatch.setattr(toxicity, "counts", lambda arc: True)
    monkeypatch.setattr(toxicity, "arc_factor", lambda arc, factors: 1.0)
    _, flat_false, flat_missed, _ = run()
    assert flat_false > false


def test_toxic_stems_need_evidence():
    counts = {"grumbo": (30, 0), "grumb": (30, 0), "gru": (30, 400), "rare$": (3, 0), "the$": (50, 500)}
    got = toxicity.accept(counts, 1000, 10_000, 5000)
    assert "grumbo" in got and not {"grumb", "gru", "rare$", "the$"} & set(got)


# ---- language model


def test_language_model(spark):
    rng = random.Random(9)
    pairs = {w: rng.sample(WORDS, 3) for w in WORDS}

    def text(n):
        out = [rng.choice(WORDS)]
        while len(out) < n:
            out.append(rng.choice(pairs[out[-1]]) if rng.random() < 0.9 else rng.choice(["Zebra", "unseen%d" % rng.randrange(10**6)]) if rng.random() < 0.3 else rng.choice(WORDS))
            if out[-1] not in pairs:
                out.append(rng.choice(WORDS))
        return " ".join(out)

    rows = [(i, text(rng.randrange(5, 60))) for i in range(400)] + [r for r in EDGES if r[0]] + [(9004, "word"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    for hot in (8, 400_000):  # with few hot words most words are joined
        out = lm_score.score_texts(docs, lm_score.training_rows(docs), hot_words=hot, shortlist=6 if hot == 8 else 1000).collect()
        assert len(out) == len(rows)
        words = lambda t: (t or "").encode().lower().split()
        train = [t for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 10]
        count = Counter(w for t in train for w in words(t))
        count["end"] = len(train)
        n, v = sum(count.values()), len(count)
        want = Counter((i, len(words(t)) + 1, sum(count[w] > 0 for w in [*words(t), "end"]), n, round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words(t), "end"]), 6)) for i, t in rows)
        assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    held = [r for r in out if r.doc_id is not None and r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 10 == 0]
    assert sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held)  # logarithms below zero: closer to it is better
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lm_score.score_texts(none, none).count() == 0
    assert all(r.base_score == 0 or r.n_tokens > 0 for r in lm_score.score_texts(docs.limit(5), none).collect())


def test_language_model_knows_rare_words(spark):
    words = [f"w{i}" for i in range(1200)]  # all as frequent as each other
    training = spark.createDataFrame([(i, " ".join(words[i:] + words[:i])) for i in range(4)], "doc_id long, text string").coalesce(2)
    docs = spark.createDataFrame([(i, f"{w} w7 {w}") for i, w in enumerate(words)], training.schema).coalesce(1)
    assert len({r.score for r in lm_score.score_texts(docs, training).collect()}) > 0.99 * len(words)  # single precision
    assert lm_score.least_count(10**10) > lm_score.least_count(10**6)
    assert 10**10 / lm_score.least_count(10**10) > 10**8 / lm_score.least_count(10**8) > 1000


def test_language_model_rounds(spark, monkeypatch):
    rounds, train = [], lm_score._train
    monkeypatch.setattr(lm_score, "_train", lambda *a: rounds.append(1) or train(*a))
    gains = []
    for copies, parts in ((1, 1), (20, 8)):
        docs = spark.range(200 * copies).selectExpr("id as doc_id", "repeat(array('a b c ', 'd e f ')[id % 2], 10) as text").coalesce(parts)
        gains.append(docs.sparkSession.createDataFrame(lm_score.score_texts(docs, docs).collect()).selectExpr("sum(score - base_score) / sum(n_tokens)").first()[0])
        assert len(rounds) == lm_score.ROUNDS
        rounds.clear()
    assert min(gains) > 0.1


def test_language_model_learns_at_any_split(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 40), i -> element_at(array('a', 'b', 'c', 'd', 'e'), 1 + cast((i * (1 + id % 2) + id) % 5 as int)))) as text")
    means = [lm_score.score_texts(docs.repartition(n, "doc_id"), docs.repartition(n, "doc_id")).agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first() for n in (1, 8)]
    assert all(score > 0.5 * base for score, base in means)  # logarithms below zero


def test_model_is_normalised():
    unigram = np.random.default_rng(0).random(40)
    model = lm_score.Model.start(unigram / unigram.sum())
    before = np.exp(model.log_p(np.arange(40), np.full(40, 3), np.full(40, 4)))
    assert np.abs(before - unigram / unigram.sum()).max() < 0.02  # starts as the unigram
    model.e, model.w, model.k = model.e * 40, model.w * 40, model.k * 40
    for last, before in ((0, 1), (39, 39), (7, 20)):
        assert abs(np.exp(model.log_p(np.arange(40), np.full(40, last), np.full(40, before))).sum() - 1) < 1e-4


def test_contexts_that_come_again_are_normalised_once(monkeypatch):
    rng, n = np.random.default_rng(4), 400
    unigram = 1.0 / np.arange(1, n + 1)
    model = lm_score.Model.start(unigram / unigram.sum())
    model.c += 0.3 * rng.standard_normal(model.c.shape).astype(np.float32)
    few = rng.integers(0, n, (3, 40))
    w, last, before = few[:, rng.integers(0, 40, 5000)]
    predicted = model.e[last].astype(float) @ model.c[0] + model.e[before].astype(float) @ model.c[1]
    scores = predicted @ model.k.T + model.d
    expected = scores[np.arange(len(w)), model.of[w]] - np.log(np.exp(scores).sum(axis=1))
    inside = np.where(model.of[None, :] == model.of[w][:, None], predicted @ model.w.T + model.b, -np.inf)
    expected += inside[np.arange(len(w)), w] - np.log(np.exp(inside).sum(axis=1))
    cells, exp = [], np.exp
    monkeypatch.setattr(np, "exp", lambda x, **more: cells.append(np.size(x)) or exp(x, **more))
    assert np.allclose(model.log_p(w, last, before), expected, atol=1e-4)
    assert sum(cells) <= 40 * (len(model.k) + n)
    model.d += 100  # scores too large for exponentials in single precision
    assert np.allclose(model.log_p(w, last, before), expected, atol=1e-3)
    assert len(model.log_p(w[:0], last[:0], before[:0])) == 0


def test_noise_contrastive_estimation_finds_the_distribution():
    rng = np.random.default_rng(1)
    n, given = 30, rng.dirichlet(np.full(30, 0.3), 30)  # the next word depends on the last
    last = rng.integers(2, n, 120_000)
    w = np.array([np.searchsorted(np.cumsum(given[x]), u * 0.9999) for x, u in zip(last, rng.random(len(last)), strict=True)])
    unigram = np.bincount(w, minlength=n) + 0.5
    trainer = lm_score.Trainer(lm_score.Model.start(unigram / unigram.sum()), 0, lm_score.RATE)
    blind = trainer.m.log_p(w, last, last).mean()
    for _ in range(8):
        trainer.learn(w, last, last)
    best = np.log(given[last, w] + 1e-12).mean()
    assert trainer.m.log_p(w, last, last).mean() > blind + 0.7 * (best - blind)


def test_noise_of_classes_has_its_own_size(monkeypatch):
    """Classes are few and need less noise than words; each level corrects for its own."""
    rng, sizes, grouped = np.random.default_rng(1), [], lm_score._grouped
    monkeypatch.setattr(lm_score, "_grouped", lambda at: sizes.append(len(at)) or grouped(at))
    n, given = 30, rng.dirichlet(np.full(30, 0.3), 30)
    last = rng.integers(2, n, 40_000)
    w = np.array([np.searchsorted(np.cumsum(given[x]), u * 0.9999) for x, u in zip(last, rng.random(len(last)), strict=True)])
    unigram = np.bincount(w, minlength=n) + 0.5
    trainer = lm_score.Trainer(lm_score.Model.start(unigram / unigram.sum()), 0, lm_score.RATE)
    blind = trainer.m.log_p(w, last, last).mean()
    for _ in range(8):
        trainer.learn(w, last, last)
    batch = lm_score.BATCH
    assert sizes[0] - batch <= 32 < lm_score.SHARED and sizes[2] == 2 * batch
    best = np.log(given[last, w] + 1e-12).mean()
    assert trainer.m.log_p(w, last, last).mean() > blind + 0.6 * (best - blind)


def test_steps_add_up_repeated_rows():
    rng = np.random.default_rng(5)
    at, grad, to, squares = rng.integers(0, 9, 50), rng.standard_normal((50, 4)), rng.standard_normal((9, 4)), np.ones((9, 4))
    g = np.zeros((9, 4))
    np.add.at(g, at, grad)
    want = to - 0.1 * g / np.sqrt(1 + g * g)
    order, rows, starts, n = lm_score._grouped(at)
    lm_score._add_rows(to, squares, order, rows, starts, grad, 0.1)
    assert np.allclose(to, want) and np.allclose(squares, 1 + g * g) and (n == np.bincount(at)[rows]).all()


def test_a_step_moves_classes_and_words_at_once(monkeypatch):
    """Rows of outcomes, classes and words alike, are moved in one pass a step, those of contexts in another; words are looked up by hash, all at once."""
    moved, add = [], lm_score._add_rows
    monkeypatch.setattr(lm_score, "_add_rows", lambda to, *more: moved.append(len(to)) or add(to, *more))
    rng, n = np.random.default_rng(3), 50
    unigram = 1.0 / np.arange(1, n + 1)
    model = lm_score.Model.start(unigram / unigram.sum())
    trainer, start = lm_score.Trainer(model, 0, lm_score.RATE), model.w.copy()
    w, last, before = rng.integers(0, n, (3, 3 * lm_score.BATCH - 7))
    trainer.learn(w, last, before)
    assert moved == 3 * [n + len(model.k), n]
    alone = np.flatnonzero((model.ends - model.starts == 1)[model.of])
    assert len(alone) and (model.w[alone] == start[alone]).all() and not trainer.hits["w"][alone].any()  # they have nothing to be told from
    assert trainer.hits["w"].sum() == 3 * lm_score.SHARED + (~np.isin(w, alone)).sum() and (trainer.hits["e"] == np.bincount(np.r_[last, before], minlength=n)).all()
    table = np.sort(lm_score.hashes(b"a B c"))
    found = lm_score.Places(table).find([lm_score.hashes(x) for x in (b"c  x A", None, b"b")])
    assert [int(i) for i in found] == [*np.searchsorted(table, lm_score.hashes(b"c")), -1, *np.searchsorted(table, lm_score.hashes(b"a b"))]
    assert len(lm_score.Places(table[:0]).find([])) == 0

# ---- co-training


def test_cotraining(spark):
    rng = random.Random(6)
    rows = []
    for i in range(500):
        words = prose(rng, rng.randrange(20, 80)).split()
        bad = i % 5 == 0
        rows.append((i, "\n".join([" ".join(w + "%%%" if bad and rng.random() < 0.7 else w for w in words)]), f"s{i % 7}", "en", 0 if bad else 1))
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows if r[0] % 2] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = cotraining.train(docs, labels)
    out = {r.doc_id: r for r in cotraining.classify(docs.withColumn("score", F.lit("clash")), model).collect()}
    assert sum((out[r[0]].score >= 0.5) == bool(r[4]) for r in rows if r[0] % 2 == 0) >= 0.97 * 250
    edges = spark.createDataFrame([(i, t, None, None) for i, t in EDGES], docs.schema)
    assert all(0 <= r.score <= 1 for r in cotraining.classify(edges, model).collect())
    assert cotraining.train(docs, labels.limit(0)) is None
    assert {r.score for r in cotraining.classify(edges, None).collect()} == {0.5}
    assert cotraining.classify(docs.limit(0), model).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test data here")
def test_the_exchange_helps_on_held_out_texts(spark):
    """Against labels alone: the content view keeps far fewer bad texts and no fewer good ones; both views together are as good but for one text."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    learn = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2
    known = docs.filter(~learn).join(labels.select("doc_id", "quality"), "doc_id")
    kept = {}
    for rounds in (0, cotraining.ROUNDS):
        out = cotraining.classify(known, cotraining.train(docs.filter(learn), labels.filter(learn), rounds=rounds))
        kept[rounds] = {(r.quality, c): r[c] for r in out.groupBy("quality").agg(*[F.count_if(F.col(c) >= 0.5).alias(c) for c in ("score", "content_score")]).collect() for c in ("score", "content_score")}
    alone, taught = kept[0], kept[cotraining.ROUNDS]
    assert taught[0, "content_score"] <= 0.75 * alone[0, "content_score"] and taught[1, "content_score"] >= alone[1, "content_score"]
    assert taught[0, "score"] <= alone[0, "score"] + 1 <= 5 and taught[1, "score"] >= alone[1, "score"] >= 853


def test_exchange_is_the_same_in_one_task_and_in_many_up_to_mixing(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(("junk%d" if i % 3 == 0 else "good%d") % rng.randrange(40) for _ in range(30)), "s", "en") for i in range(900)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(120)], "doc_id long, quality int")
    for parts in (1, 7):
        model = cotraining.train(docs.repartition(parts, "doc_id"), labels)
        assert sum(model["taught"]) == 780  # every unlabelled text, once
        assert sum((r.score >= 0.5) == (r.doc_id % 3 != 0) for r in cotraining.classify(docs, model).collect()) == 900


# ---- main text

ARTICLE = "<article><h1>A &amp; B</h1><p>First, a long sentence with   spaces.<p>Second<br>line, unclosed.<ul><li>one</li><li>two</li></ul><p>Ok.</p>{}</article>"
PAGES = [
    (ARTICLE.format(""), "A & B\nFirst, a long sentence with spaces.\nSecond line, unclosed.\none\ntwo\nOk."),
    ("<html><head><title>t</title><script>var a='<p>x</p>'</script></head><body><nav><a href=/>Menu</a></nav>" + ARTICLE.format("<div class='comments'><p>I like it, really. A lot.</p></div><aside>See also, this.</aside>") + "<footer>&copy; x</footer>", "A & B\nFirst, a long sentence with spaces.\nSecond line, unclosed.\none\ntwo\nOk."),
    ("<body><header><h2>Site</h2></header><div id=sidebar>Links, links. More.</div><div class=content><h1>T</h1><div><p>One long paragraph, with commas, and more.</p><form><p>Mail, please.</p></form><p>Short.</p></div></div><div class='cookie-notice'>We use cookies, yes.</div></body>", "T\nOne long paragraph, with commas, and more.\nShort."),
    ("plain &lt;text&gt;", "plain <text>"),
    ("<p>cut off in a <b>tag</b> <a hre", "cut off in a tag"),
    ("<!-- only a comment -->", ""), ("", ""), (None, ""), ("<script>x", ""), ("<nav>menu</nav>", ""),
]


def test_main_text(spark):
    pages = spark.createDataFrame([(i, h, 1) for i, (h, _) in enumerate(PAGES)], "page_id int, html string, n_chars int")
    out = html_extract.extract_main_text(pages)
    assert {r.page_id: r.text for r in out.collect()} == {i: t for i, (_, t) in enumerate(PAGES)}
    assert all(r.n_chars == len(r.text) for r in out.collect()) and out.columns == ["page_id", "text", "n_chars"]
    assert html_extract.extract_main_text(pages.limit(0)).count() == 0


def test_main_text_of_long_and_broken_pages():
    long = "<article>" + "".join(f"<p>Paragraph {i}, with text.</p>" for i in range(20_000)) + "</article>"
    assert html_extract.main_text(long).count("\n") == 19_999
    rng = random.Random(1)
    for _ in range(300):  # nothing makes it fail
        html_extract.main_text("".join(rng.choice(["<p>", "</p>", "<b", '"', "'", "<", ">", "&amp", "&#x;", "<!--", "-->", "<script>", "</div>", "<div class=", "text, ", "<![CDATA[", "]]>", "<br/>"]) for _ in range(40)))


STORY = "<article><h1>Title of it</h1>" + "".join(f"<p>{'The river, the stone and the walk. ' * 6}</p>" for _ in range(4)) + "</article>"
MENU = "<nav><ul>" + "".join(f"<li><a href=x>Menu {i}</a></li>" for i in range(8)) + "</ul></nav>"
FOOTER = "<footer>&copy; somebody. All rights are reserved, here and there.</footer>"
WANT = "\n".join(["Title of it", *[("The river, the stone and the walk. " * 6).strip()] * 4])


@pytest.mark.parametrize("wrapper", ["%s", '<div class="page with-sidebar">%s</div>', '<div id="site" class="has-popup-consent">%s</div>', '<form id="aspnetForm">%s</form>'])
def test_names_around_the_page_do_not_decide(wrapper):
    assert html_extract.main_text("<body>" + wrapper % (MENU + STORY + FOOTER) + "</body>") == WANT
    assert html_extract.main_text("<body>" + MENU + wrapper % STORY + FOOTER + "</body>") == WANT


def test_ratios_weigh_more_than_names():
    told = '<div class="social-history">' + "<p>The history of this town, long and rich, is told here. It goes on, and on.</p>" * 2 + "</div>"
    assert "history of this town" in html_extract.main_text(MENU + STORY.replace("</h1>", "</h1>" + told) + FOOTER)
    more = '<div class="share">Share this.</div><section class="comments"><p>' + "I think this is good, really. " * 5 + "</p></section></article>"
    assert html_extract.main_text(MENU + STORY.replace("</article>", more) + FOOTER) == WANT


def test_extraction_without_any_tag_names():
    plain = MENU + STORY + FOOTER
    for tag in ("article", "nav", "footer"):
        plain = plain.replace(f"<{tag}>", "<div>").replace(f"</{tag}>", "</div>")
    assert html_extract.main_text(plain) == WANT


def test_deep_pages_take_linear_time():
    import time

    began = time.process_time()
    for tag, end in (("div", "div"), ("b", "i")):
        page = f"<{tag}>" * 8000 + "<p>Some text here, and there." * 200 + f"</{end}>" * 8000
        assert html_extract.main_text(page).count("Some text") == 200
    assert time.process_time() - began < 3


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data here")
def test_ratios_and_not_names_decide_on_the_supplied_pages(spark, monkeypatch):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    usual = [html_extract.main_text(x) for x in pages]
    changed = lambda: sum(html_extract.main_text(x) != y for x, y in zip(pages, usual, strict=True))
    with monkeypatch.context() as m:
        m.setattr(html_extract, "ratio", lambda sums: 1.0)
        assert changed() > 0.9 * len(pages)
    with monkeypatch.context() as m:
        m.setattr(html_extract, "factor", lambda *x: 1.0)
        assert changed() <= 0.02 * len(pages)


P = "<p>" + "The river, the stone and the walk. " * 3 + "</p>"
LINE = ("The river, the stone and the walk. " * 3).strip()
CASES = {
    "script with a slash": ("<article><h1>T</h1>" + P * 3 + "<script src=/a.js/>var x = 1;</script>" + P + "</article>", ["T", *[LINE] * 4]),
    "table": ("<body>" + MENU + "<article><h1>Head</h1><table><tr><td>a</td><td>1</td></tr><tr><td>b</td><td>2</td></tr></table>" + P + "</article>" + FOOTER + "</body>", ["Head", "a", "1", "b", "2", LINE]),
    "recipe": ("<body>" + MENU + "<main><h1>Soup</h1><ul><li>salt</li><li>water</li><li>an onion</li></ul><div>" + P * 3 + "</div></main>" + FOOTER + "</body>", ["Soup", "salt", "water", "an onion", *[LINE] * 3]),
    "dosage": ("<body>" + MENU + "<article><h1>Pills</h1>" + P * 2 + '<section class="recommended-dosage"><p>Two a day.</p></section></article></body>', ["Pills", LINE, LINE, "Two a day."]),
    "feedback": ("<body>" + MENU + "<article><h1>T</h1>" + P * 2 + '</article><div class="feedback">' + "<p>I like it, really. And so on, and on, and on it goes for long.</p>" * 50 + "</div></body>", ["T", LINE, LINE]),
    "advert inside": ("<article><h1>T</h1>" + P * 3 + '<div class="ad">Buy this, now.</div>' + P + '<div class="related-links"><p>See this too.</p></div></article>', ["T", *[LINE] * 4]),
    "two parts": ('<body>' + MENU + '<div id="c"><div class="lead">' + P * 8 + '</div><div class="more"><p>The end, at last.</p></div></div>' + FOOTER + "</body>", [*[LINE] * 8, "The end, at last."]),
    "ids": ("<body>" + MENU + "<div>" + "".join(P.replace("<p>", f'<p id="p{i}" class="c{i}">') for i in range(5)) + "</div>" + FOOTER + "</body>", [LINE] * 5),
    "short article": ("<body>" + MENU + '<div class="ad">Buy this, now. It is good.</div><article><h1>T</h1><p>One short text, and no more.</p></article><footer>&copy; somebody, of somewhere. All rights, reserved.</footer></body>', ["T", "One short text, and no more."]),
    "header of the article": ("<body><header><h2>Site</h2></header>" + MENU + "<article><header><h1>T</h1><p>By somebody</p></header>" + P * 3 + "<form><p>Mail, please.</p></form><aside>See also, this.</aside></article></body>", ["T", "By somebody", *[LINE] * 3]),
}


@pytest.mark.parametrize("case", list(CASES))
def test_articles_stay_whole(case):
    page, want = CASES[case]
    assert html_extract.main_text(page) == "\n".join(want)

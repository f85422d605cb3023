import collections
import math
import random
import re

import numpy as np
import pytest

from staffline.llm import queries
from staffline.llm import toxicity as X
from tests.conftest import SF_ORACLE

from .helpers import crc, frame

PLAIN = X.ToxicityModel([], X.PRIOR_BIAS, X.PRIOR)
CASES = [
    ("You are a stupid idiot.", {"insult+plain+aimed": 2}),
    ("A stupid idea", {"insult+plain+loose": 1}),
    ("He is not stupid.", {"insult+negated+aimed": 1}),
    ("It is not very often a nice thing to see trash.", {"insult+plain+loose": 1}),
    ("She said you are an idiot.", {"insult+reported+aimed": 1}),
    ("“You idiot” is what he heard", {"insult+reported+aimed": 1}),
    ("He said so. You idiot!", {"insult+plain+aimed": 1}),
    ("I will kill you.", {"threat+plain+aimed": 1}),
    ("I will not kill you.", {"threat+negated+aimed": 1}),
    ("They kill time.", {}),
    ("I will go home now and then kill time", {}),
    ("", {}),
    ("IDIOT\nnice people", {"insult+plain+loose": 1}),
    ("“You are an idiot. You are scum” she heard", {"insult+reported+aimed": 2}),
    ("“You are an idiot. Go.” You are scum", {"insult+reported+aimed": 1, "insult+plain+aimed": 1}),
    ("“You are an idiot.\nYou are scum", {"insult+reported+aimed": 1, "insult+plain+aimed": 1}),
    ("„Du bist ein Idiot. Du Trottel“ war zu hören. Du Trottel", {"insult+reported+aimed": 2, "insult+plain+aimed": 1}),
    ("That isn’t stupid", {"insult+negated+loose": 1}),
    ("You aren't an idiot", {"insult+negated+aimed": 1}),
    ("Er ist nicht stupid", {"insult+negated+aimed": 1}),
    ("Du bist kein Idiot", {"insult+negated+aimed": 1}),
    ("Er sagte, sie ist ein Idiot", {"insult+reported+aimed": 1}),
    ("Ich werde dich umbringen", {"threat+plain+aimed": 1}),
    ("Tu n’es pas un imbécile", {"insult+negated+aimed": 1}),
    ("L'imbécile", {"insult+plain+loose": 1}),
    ("Selon elle c'est un crétin", {"insult+reported+aimed": 1}),
    ("Je vais te tuer", {"threat+plain+aimed": 1}),
    ("Ella no es idiota", {"insult+negated+aimed": 1}),
    ("Dijo: algo. Eres un idiota", {"insult+plain+loose": 1}),
    ("Él dijo que usted es un imbécil", {"insult+reported+aimed": 1}),
    ("Voy a matar a ustedes", {"threat+plain+aimed": 1}),
    ("idiot moron you", {"insult+plain+loose": 1, "insult+plain+aimed": 1}),
]


@pytest.mark.parametrize("text,labels", CASES)
def test_grammar(text, labels):
    counts = X.clause_counts(text, X.Lexicon([]))
    assert {X.LABELS[i]: int(counts[i]) for i in np.flatnonzero(counts)} == labels


@pytest.mark.parametrize("text", [t for t, _ in CASES] + ["you " * 50 + "idiot " * 5 + ". not " * 3 + "scum"])
def test_the_composed_machine_does_what_its_parts_do(text):
    """Feeding the transducers one after the other gives the same clauses as the compiled composition."""
    symbols = [X.Lexicon([])[t] for t in X.tokens(text)] + [X.END]
    symbols = [s for s in symbols]
    for start, step in ((None, X.insult_step), (0, X.threat_step), (0, X.negation_step), ((False, False), X.report_step), ((False, 0), X.target_step)):
        state, out = start, []
        for s in symbols:
            state, more = step(state, s)
            out += more
        symbols = out
    want = np.bincount([s - X.CORE for s in symbols], minlength=len(X.LABELS))
    assert (X.clause_counts(text, X.Lexicon([])) == want).all()


def test_learned_stems_and_weights(spark):
    rows = [(i, f"word{i % 13} and zorgling{'abc'[i % 3]} thing{i}" if i % 2 else f"word{i % 13} and thing{i}") for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(300)] + [(None, 1, 0), (1, None, 0)], "doc_id long, toxic int, quality int")
    model = X.fit(spark, frame(spark, rows), labels)
    assert model.stems == ["zorgling"]
    docs = frame(spark, [(1, "a ZORGLINGer"), (2, "a thing"), (3, None), (3, None), (None, "")], clashing=True)
    got = sorted((str(r.doc_id), r.predicted, 0 <= r.score <= 1) for r in X.toxicity(spark, docs, model, ["doc_id"]).collect())
    assert got == [("1", 1, True), ("2", 0, True), ("3", 0, True), ("3", 0, True), ("None", 0, True)]


def plain_model(texts, toxic):
    """Stems, weights and a scoring function by the definitions, one text at a time: stems from counts, clauses through the five parts one after the
    other, weights by descending the penalised loss."""
    size = [sum(t == k for t in toxic) for k in (0, 1)]
    counted = collections.defaultdict(lambda: [0, 0])
    for text, t in zip(texts, toxic):
        words = {w for w in re.findall(r"[^\W\d_]+", text.lower()) if len(w) > 2}
        for stem in {w[:n] for w in words for n in range(4, 9) if len(w) >= n} | {w for w in words if len(w) == 3}:
            counted[stem][t] += 1
    ranked = []
    for stem, (clean, bad) in counted.items():
        odds = math.log((bad + 0.5) / (size[1] - bad + 0.5) / ((clean + 0.5) / (size[0] - clean + 0.5)))
        z = odds / math.sqrt(1 / (bad + 0.5) + 1 / (clean + 0.5))
        if bad >= 3 and odds >= 3 and z >= 3.5:
            ranked.append((-z, -len(stem), stem, bad))
    stems = {}
    for _, _, stem, bad in sorted(ranked):
        if not any(stem.startswith(x) and len(x) >= 4 and x != stem for x in stems) and (len(stem) < 4 or 1.05 * sum(n for x, n in stems.items() if x.startswith(stem)) < bad):
            stems[stem] = bad

    def counts(text):
        symbols = [X.INSULT if any(w == x or (len(x) >= 4 and w.startswith(x)) for x in stems) and w not in X.base_classes() else X.Lexicon([])[w] for w in X.tokens(text)]
        symbols.append(X.END)
        for start, step in ((None, X.insult_step), (0, X.threat_step), (0, X.negation_step), ((False, False), X.report_step), ((False, 0), X.target_step)):
            state, out = start, []
            for s in symbols:
                state, more = step(state, s)
                out += more
            symbols = out
        return np.bincount([s - X.CORE for s in symbols], minlength=len(X.LABELS)).astype(float)

    x = np.array([[1, *counts(t)] for t in texts])
    y, prior = np.array(toxic, float), np.array([X.PRIOR_BIAS, *X.PRIOR])
    w = prior.copy()
    for _ in range(40_000):
        w -= 0.002 * (x.T @ (1 / (1 + np.exp(-x @ w)) - y) + (w - prior))
    return set(stems), w, lambda text: float(1 / (1 + np.exp(-np.array([1, *counts(text)]) @ w)))


def test_stems_weights_and_scores_against_a_plain_version(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abdeklmnorstu", k=rng.randint(2, 9))) for _ in range(150)] + ["you", "not", "said", "du", "pas", "will", "kill"]
    insults = ["zorgling", "zorglings", "blepfaced", "qix", "idiot"]
    texts, toxic = [], []
    for i in range(240):
        t = int(i % 3 == 0)
        text = [rng.choice(words) + rng.choice(["", "", "", "", ".", "\n"]) for _ in range(rng.randint(5, 40))]
        for _ in range(rng.randint(1, 3) if t else rng.random() < 0.03):
            text.insert(rng.randint(0, len(text)), rng.choice(insults))
        texts.append(f"{' '.join(text)} t{i}")
        toxic.append(t)
    docs = frame(spark, list(enumerate(texts)))
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    model = X.fit(spark, docs, labels)
    stems, weights, score = plain_model(texts, toxic)
    assert set(model.stems) == stems and len(stems) >= 3
    assert np.allclose([model.bias, *model.weights], weights, atol=1e-4)
    got = {r.doc_id: r.score for r in X.toxicity(spark, docs, model, ["doc_id"]).collect()}
    assert all(abs(got[i] - score(t)) < 1e-4 for i, t in enumerate(texts))


def test_short_stems_are_whole_words():
    lexicon = X.Lexicon(["fat", "zorg"])
    assert [lexicon[w] == X.INSULT for w in ("fat", "father", "fatal", "zorg", "zorgling", "zor")] == [True, False, False, True, True, False]


def test_without_labels_the_prior_weights_stand(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = X.fit(spark, frame(spark, [(1, "x")]), labels)
    assert model.stems == [] and model.bias == X.PRIOR_BIAS and (model.weights == X.PRIOR).all()
    assert [r.predicted for r in X.toxicity(spark, frame(spark, [(1, "you idiot")]), model, ["doc_id"]).collect()] == [1]
    assert X.toxicity(spark, frame(spark, []), model, ["doc_id"]).collect() == []


def test_held_out_rows(spark):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF_ORACLE}/labels.parquet").collect()}
    rows = queries.op9_toxicity(spark, SF_ORACLE).collect()
    assert len(rows) == 1000 and all(r.held_out == (crc(r.doc_id) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(toxic[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in toxic]
    assert sum(p for t, p in held if t == 0) <= 0.02 * len(held)
    assert sum(p for t, p in held if t == 1) >= 0.6 * sum(t for t, _ in held)

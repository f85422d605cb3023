import collections
import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from staffline.llm import gru as G
from staffline.llm import language_model as M

from .helpers import frame, words

TEXTS = [(i, t) for i, t in enumerate([
    "The cat sat on the mat", "the dog\tsat on THE cat", "a dog and a cat", None, "", "Été é", "the the the the", "the cat b " * 9, *([""] * 9),
])]
HELD = [(100, "the unseen cat"), (101, "unseen unseen"), (102, None), (103, "É mat"), (103, "É mat")]
SMALL = dict(head=9, symbols=5, hidden=4, docs_per_shard=3, rounds=2)


def tokens(text):
    return [*words(text), " "]


def plain_score(text, model):
    """The model's log10 probability, a token at a time."""
    v, net = model.vocabulary, model.network
    names = [w.decode() for w in v.words]
    counts = collections.Counter()
    for row in model.counts.collect():
        counts[bytes(row.token).decode()] = row.c
    h = net.gates.shape[0]
    state, before, total = np.zeros(h), v.start, 0.0
    for token in tokens(text):
        x, u = net.inputs[before], state @ net.gates
        z, r = 1 / (1 + np.exp(-(x[:h] + u[:h]))), 1 / (1 + np.exp(-(x[h : 2 * h] + u[h : 2 * h])))
        state = (1 - z) * np.tanh(x[2 * h :] + r * u[2 * h :]) + z * state
        symbol = names.index(token) if token in names[: v.symbols] else v.symbols
        c, w = divmod(symbol, G.WIDTH)
        by_class, by_word = state @ net.class_out + net.class_bias, state @ net.word_out[c] + net.word_bias[c]
        total += by_class[c] - np.log(np.exp(by_class).sum()) + by_word[w] - np.log(np.exp(by_word).sum())
        if symbol == v.symbols:
            total += math.log((counts[token] + 1) / v.rest_mass)
        before = symbol
    return total / math.log(10)


def test_scores_against_plain_version(spark):
    model = M.fit(spark, frame(spark, TEXTS), **SMALL)
    counts = collections.Counter(t for _, text in TEXTS for t in tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    assert model.vocabulary.tokens == total and model.vocabulary.distinct == distinct
    assert 0 < len(model.vocabulary.words) <= 9 and model.vocabulary.symbols <= 5
    docs = frame(spark, TEXTS + HELD, clashing=True)
    rows = M.score(spark, docs, model, ["doc_id", "uid"]).collect()
    texts = dict(TEXTS + HELD)
    assert len(rows) == len(TEXTS) + len(HELD) and {r.uid for r in rows} == {1}
    for r in rows:
        own = tokens(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(t in counts for t in own), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in own), rel=1e-12)
        assert r.score == pytest.approx(plain_score(texts[r.doc_id], model), rel=1e-4)


def test_probabilities_add_up(spark):
    """Over all training words and one unseen word, the first token's probabilities make 1."""
    model = M.fit(spark, frame(spark, TEXTS), **SMALL)
    known = sorted({t for _, text in TEXTS for t in tokens(text)} - {" "})
    rows = M.score(spark, frame(spark, [(i, w) for i, w in enumerate([*known, "unseen"])] + [(-1, None)]), model, ["doc_id"]).collect()
    after = {}
    for w in [*known, "unseen"]:  # the END after each word is the same model's: take it out
        after[w] = plain_score(w, model)
    start = {w: 10 ** first_token(w, model) for w in [*known, "unseen", None]}
    assert sum(start.values()) == pytest.approx(1, rel=1e-5) and len(rows) == len(known) + 2


def first_token(word, model):
    whole = plain_score(word, model)
    if word is None:
        return whole
    v, net = model.vocabulary, model.network
    h = net.gates.shape[0]
    state = np.zeros(h)
    names = [w.decode() for w in v.words]
    symbol = names.index(word) if word in names[: v.symbols] else v.symbols
    for s in (v.start, symbol):
        x, u = net.inputs[s], state @ net.gates
        z, r = 1 / (1 + np.exp(-(x[:h] + u[:h]))), 1 / (1 + np.exp(-(x[h : 2 * h] + u[h : 2 * h])))
        state = (1 - z) * np.tanh(x[2 * h :] + r * u[2 * h :]) + z * state
    c, w = divmod(v.start, G.WIDTH)
    by_class, by_word = state @ net.class_out + net.class_bias, state @ net.word_out[c] + net.word_bias[c]
    end = by_class[c] - np.log(np.exp(by_class).sum()) + by_word[w] - np.log(np.exp(by_word).sum())
    assert v.start < v.symbols
    return whole - end / math.log(10)


def test_nothing_to_learn_from_and_empty_table(spark):
    model = M.fit(spark, frame(spark, []))
    rows = M.score(spark, frame(spark, [(1, "a b"), (2, None)]), model, ["doc_id"]).collect()
    assert all(r.base_score == 0 and r.score == pytest.approx(0, abs=1e-6) and r.n_known == 0 for r in rows)
    assert M.score(spark, frame(spark, []), M.fit(spark, frame(spark, TEXTS), **SMALL), ["doc_id"]).collect() == []


def test_copies_are_drawn_in_proportion_and_shards_follow_the_sample(spark, monkeypatch):
    drawn = []

    def note(spark, sample, shards, words, network, rate):
        drawn.append(([bytes(r.text) for r in sample.collect()], shards))
        return network

    monkeypatch.setattr(M, "_averaged_round", note)
    docs = frame(spark, [(i, "the same text" if i % 3 == 0 else f"text {i}") for i in range(3000)])
    M.fit(spark, docs, share=0.1, least_docs=0, docs_per_shard=50, rounds=1)
    ((texts, shards),) = drawn
    assert 240 < len(texts) < 360 and 60 < texts.count(b"the same text") < 140
    assert shards == math.ceil(len(texts) / 50)


def test_the_network_learns_from_every_training_document(spark, monkeypatch):
    seen, averaged = [], M._averaged_round

    def note(spark, sample, shards, words, network, rate):
        seen.append((sorted(bytes(r.text) for r in sample.select("text").collect()), shards))
        assert all(np.frombuffer(r.symbols, "<u2").tolist() == np.concatenate([p for p, _ in M.encoded(bytes(r.text), words)]).tolist() for r in sample.collect())
        return averaged(spark, sample, shards, words, network, rate)

    monkeypatch.setattr(M, "_averaged_round", note)
    rows = [(i % 1700, [None, "", "the same text"][i % 9] if i % 9 < 3 else f"text {i} " * (i % 5)) for i in range(3400)]
    rows.append((None, "without an id"))
    M.fit(spark, frame(spark, rows), hidden=2)
    assert seen == [(sorted((t or "").encode() for _, t in rows), 2)] * 2


def test_only_the_symbols_of_a_window_move_and_training_is_adagrad():
    """The weights of symbols that no window has as an input stay; the others follow the gradients of the whole network."""
    rng = np.random.default_rng(4)
    documents = [rng.integers(0, 40, n).astype(np.uint16) for n in (9, 4, 20, 1)]
    net = G.Network.untrained(np.ones(90), 6)
    for a in net.arrays():
        a += (rng.normal(size=a.shape) * 0.1).astype(G.FLOAT)
    want, history = net.like(net.flat()), [np.full(a.shape, 1e-4, G.FLOAT) for a in net.arrays()]
    own = G.strips(documents, 4, 1)
    _, grads, _ = G.window_gradient(want, own, 0, int(own.lengths[-1]), np.zeros((len(own.lengths), 6), G.FLOAT))
    for w, g, h in zip(want.arrays(), grads.arrays(), history, strict=True):
        g = g / max(own.lengths[-1] * len(own.lengths), 4)
        h += g * g
        w -= 0.3 * g / np.sqrt(h)
    before = net.inputs.copy()
    G.train(net, documents, 1, None, 0.3, lanes=4, window=int(own.lengths[-1]))
    unseen = np.setdiff1d(np.arange(90), own.inputs)
    assert len(unseen) and (net.inputs[unseen] == before[unseen]).all()
    first_only = np.setdiff1d(own.inputs[: own.lengths[-1]], own.inputs[own.lengths[-1] :])
    assert np.allclose(net.inputs[first_only], want.inputs[first_only], rtol=1e-4, atol=1e-6)


def test_gradients(monkeypatch):
    monkeypatch.setattr(G, "FLOAT", np.float64)
    rng = np.random.default_rng(0)
    net = G.Network.untrained(rng.integers(1, 50, 130).astype(float), 5)
    for a in net.arrays():
        a += rng.normal(size=a.shape) * 0.3
    documents = [rng.integers(0, 130, n) for n in (5, 3, 7, 2, 9)]
    lanes, state = G.dealt(documents, 2, 0), rng.normal(size=(2, 5))
    _, grads, _ = G.window_gradient(net, lanes, 0, 8, state.copy())
    flat, found = net.flat(), grads.flat()

    def loss(weights):
        own = net.like(weights)
        states = G.forward(own, lanes, 0, 8, state.copy())
        return -G.Scorer.of(own)(states.reshape(-1, 5), lanes.targets[:8].ravel()).sum()

    for i in rng.choice(len(flat), 200, replace=False):
        step = np.zeros(len(flat))
        step[i] = 1e-5
        assert (loss(flat + step) - loss(flat - step)) / 2e-5 == pytest.approx(found[i], abs=1e-5, rel=1e-4)


def test_lanes_and_windows_do_not_change_scores_and_training_helps():
    rng = np.random.default_rng(3)
    documents = [np.array([(s + k) % 90 for k in range(n)], np.int32) for s, n in zip(rng.integers(0, 90, 60), rng.integers(1, 70, 60), strict=True)]
    net = G.Network.untrained(np.ones(90), 8)
    alone = [G.document_scores(net, [d], 0)[0] for d in documents]
    assert np.allclose(G.document_scores(net, documents, 0, lanes=7, window=5), alone, rtol=1e-5)
    before = sum(alone)
    history = None
    for _ in range(30):
        history = G.train(net, documents, 0, history, lanes=8, window=16)
    assert G.document_scores(net, documents, 0).sum() > 0.6 * before


def test_strips_hold_all_documents_with_the_true_symbol_before():
    rng = np.random.default_rng(2)
    for sizes, lanes in (([1], 4), ([3, 1, 50, 2], 4), ([5] * 9, 7), ([400, 1], 128), ([2, 2], 1)):
        documents = [rng.integers(1, 9, n) for n in sizes]
        own = G.strips(documents, lanes, 0)
        stream = [(s, t, b) for lane, n in enumerate(own.lengths) for s, t, b in zip(own.inputs[:n, lane], own.targets[:n, lane], own.begins[:n, lane])]
        want = [(0 if i == 0 else d[i - 1], x, i == 0) for d in documents for i, x in enumerate(d)]
        assert stream == want and len(own.lengths) <= lanes and (np.diff(own.lengths) <= 0).all()
        assert own.lengths[:-1].tolist() == [own.lengths[0]] * (len(own.lengths) - 1)


def test_tokens_are_whole_however_texts_are_cut():
    odd = [None, b"", b"  ", b"A b\x00c\x1c d\xff\xc3\x89 ", b"\t\n\x0b\x0c\rx", b"x", b"long word " * 50, b"y" * 30, None]
    for size in (1, 5, 16, 1 << 22):
        found = [[] for _ in odd]
        for block, of, sizes in M.token_blocks(pa.array(odd, pa.binary()), size):
            assert len(block) == sizes.sum()
            for i, part in zip(of, np.split(np.array(block.to_pylist(), object), np.cumsum(sizes)[:-1]), strict=True):
                found[i] += part.tolist()
        assert found == [[*(x or b"").lower().split(), M.END] for x in odd]


def test_runs_of_texts_hold_each_row_once(monkeypatch):
    monkeypatch.setattr(M, "TOGETHER", 10)
    texts = pa.array([b"", b"x" * 30, None, b"1234", b"123456", b"1", b"x" * 11], pa.binary())
    assert [*M.runs(texts)] == [(0, 2), (2, 3), (5, 2)] and [*M.runs(texts[:0])] == []


def test_a_long_document_takes_no_room_in_the_other_lanes():
    rng = np.random.default_rng(5)
    documents = [rng.integers(0, 90, n).astype(np.int32) for n in (30_000, *[20] * 300)]
    net = G.Network.untrained(np.ones(90), 4)
    tracemalloc.start()
    G.document_scores(net, documents, 0)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 400 * sum(map(len, documents))


def test_the_mean_of_equal_weights_is_themselves(spark):
    """In several shards and several slices of the weights; a rate of 0 leaves every shard's weights as they are."""
    words = M.Vocabulary([b" ", b"a", b"b"], np.array([9, 5, 2]), 3, 16, 3)
    net = G.Network.untrained(words.symbol_counts, 24)
    sample = spark.createDataFrame([(np.array([1, 2, 0][: 1 + i % 3], "<u2").tobytes(),) for i in range(20)], "symbols binary")
    assert net.flat().size > 3 * M.SLICE
    found = M._averaged_round(spark, sample, 3, words, net, 0.0)
    assert all((a == b).all() for a, b in zip(found.arrays(), net.arrays(), strict=True))

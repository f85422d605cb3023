import math
import re
from collections import Counter

import numpy as np

from staffline.llm import language_id as L
from staffline.llm import queries
from tests.conftest import SF_ORACLE

from .helpers import crc, frame

TEXTS = [
    (0, "the cat and the dog", "en"), (1, "der hund und die katze", "de"), (3, "the house is the home", "en"), (4, "das haus ist ein heim", "de"),
    (5, None, "en"), (6, "le chat et le chien", None), (7, "a tree in the wood", "en"),
]


def plain_buckets(text):
    codes = [ord(c) for c in L.cleaned(text)]
    for i in range(len(codes)):
        mixed = 0
        for order in range(L.ORDERS):
            code = codes[i + order] if i + order < len(codes) else 32
            mixed = (mixed * 0x01000193 + code + order + 1) % 2**32
            yield (mixed * 0x9E3779B1 % 2**32) >> (32 - L.BUCKET_BITS)


def test_against_plain_naive_bayes(spark):
    model = L.fit(spark, frame(spark, TEXTS))
    counts = {"en": Counter(), "de": Counter()}
    for _, text, lang in TEXTS:
        if text and lang:
            counts[lang].update(plain_buckets(text))
    seen = {"en": 3, "de": 2}
    size = 1 << L.BUCKET_BITS
    for text in ("the dog", "die katze im haus", "é", "A.b,C 12", "x" * 50):
        likely = {
            lang: math.log(seen[lang] / 5) + sum(math.log((c[b] + 1) / (sum(c.values()) + size)) for b in plain_buckets(text))
            for lang, c in counts.items()
        }
        names, scores = L.predict_texts([text], model)
        best = max(likely.values())
        assert names == [min(k for k, v in likely.items() if v == best)]
        assert abs(scores[0] - 1 / sum(math.exp(v - best) for v in likely.values())) < 1e-4


def test_long_texts_are_scored_whole_and_alone(spark, monkeypatch):
    model = L.fit(spark, frame(spark, TEXTS))
    texts = ["the cat " * 400, "haus und heim", "z" * 1000, "der " * 700]
    whole = L.log_likelihoods(texts, model)
    monkeypatch.setattr(L, "SLICE", 64)
    assert np.allclose(L.log_likelihoods(texts, model), whole, rtol=1e-6)
    assert np.allclose([L.log_likelihoods([t], model)[0] for t in texts], whole, rtol=1e-6)


def test_defined_cases(spark):
    docs = frame(spark, [(1, None), (2, ""), (3, " 12 ½ !? _"), (4, "the"), (4, "the"), (None, "haus")], clashing=True)
    model = L.fit(spark, frame(spark, TEXTS))
    rows = {(r.doc_id, r.lang_pred, r.score > 0.5, r.score == 0) for r in L.identify(spark, docs, model, ["doc_id"]).collect()}
    assert rows == {(1, "und", False, True), (2, "und", False, True), (3, "und", False, True), (4, "en", True, False), (None, "de", True, False)}
    untaught = L.fit(spark, frame(spark, [(1, None, "en"), (2, "text", None)]))
    assert [r.lang_pred for r in L.identify(spark, docs, untaught, ["doc_id"]).collect()] == ["und"] * 6
    assert L.identify(spark, frame(spark, []), model, ["doc_id"]).collect() == []


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF_ORACLE}/documents.parquet").collect()}
    rows = queries.op3_language_id(spark, SF_ORACLE).collect()
    assert {r.doc_id for r in rows} == set(docs) and all(r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) > 0.99
    assert not [r for r in rows if (r.lang_pred == "und") != (not re.search(r"[^\W\d_]", docs[r.doc_id].text))]

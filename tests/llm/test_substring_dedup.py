import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from staffline.llm import common
from staffline.llm import substring_dedup as S

from .helpers import frame

RNG = random.Random(6)
VOCABULARY = ["".join(RNG.choices("abcdefghiklmnoprstuvwé", k=RNG.randint(2, 9))) for _ in range(2000)]


def text(n):
    return " ".join(RNG.choices(VOCABULARY, k=n))


def plain_cuts(data):
    h = [sum(int(S.GEAR[data[i - j]]) << j for j in range(S.WINDOW) if i >= j) & 0xFFFFFFFF for i in range(len(data))]
    least = [i for i in range(len(data)) if all(h[i] <= x for x in h[max(0, i - S.RADIUS) : i + 1 + S.RADIUS])]
    chosen, last, period, count = [], -(10**9), 0, 0
    for i in least:
        gap = i - last
        if gap > S.RADIUS or (period <= S.RADIUS and gap != period):
            count = 0
        else:
            count += 1
        if count % math.ceil(S.PERIODS / gap) == 0:
            chosen.append(i + 1)
        last, period = i, gap
    ends, at = [], 0
    for end in sorted({*chosen, len(data)} - {0}):
        while end - at > S.LONGEST:
            at += S.LONGEST
            ends.append(at)
        ends.append(end)
        at = end
    while any(e < len(data) and data[e] & 0xC0 == 0x80 for e in ends):
        ends = [e + (e < len(data) and data[e] & 0xC0 == 0x80) for e in ends]
    return sorted(set(ends))


@pytest.mark.parametrize("slice_bytes", [1 << 20, 100, 37])
def test_cuts_against_plain_version(monkeypatch, slice_bytes):
    monkeypatch.setattr(S, "SLICE", slice_bytes)
    words = b"".join(text(2).encode() + w * 40 for w in (b"ab", b"word ", b"seven b", b"twenty byte periods ", b"twenty-one byte period"))
    for data in (b"", b"a", b"a" * 5000, words, text(1).encode(), text(300).encode(), ("é" * 700).encode(), ("日本" * 900 + text(20)).encode()):
        assert S.cuts(data).tolist() == plain_cuts(data)


def test_texts_cut_together_are_cut_alike():
    rng = random.Random(9)
    texts = [b"", b"a", b"la " * 300, text(3).encode(), b"", ("é" * 500 + "日本").encode(), text(400).encode(), bytes(range(256)) * 20, b"\0" * 3000, b""]
    texts += [t[:-1] for t in texts[2:6]] + [text(rng.randint(1, 60)).encode() for _ in range(30)]
    for group in (texts, texts[::-1], texts[:1], texts[6:7], [b"", b""]):
        ends, before, after = S.cut_together(group)
        assert [e.tolist() for e in ends] == [S.cuts(t).tolist() for t in group]
        alone = [S.cut_together([t]) for t in group]
        assert before.tolist() == [x for a in alone for x in a[1]] and after.tolist() == [x for a in alone for x in a[2]]
    assert [len(g) for g in S.together([b"x" * (S.SLICE - 1), b"y", b"z", b"w" * 2 * S.SLICE, b""])] == [2, 1, 1, 1]


def test_insertions_leave_other_chunks_alone():
    data = text(2000).encode()
    changed = data[:5000] + b"something new" + data[5000:]

    def chunks(d):
        ends = S.cuts(d).tolist()
        return [d[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    assert len(set(chunks(data)) - set(chunks(changed))) <= 3


PASSAGE, SHORT = text(55), text(4)


def rows():
    docs = [(i, text(120)) for i in range(20)]
    for i in (3, 8, 15):
        docs[i] = (i, f"{text(30)} {PASSAGE} {text(40)}")
    for i in (5, 6):
        docs[i] = (i, f"{text(30)} {SHORT} {text(40)}")
    docs[9] = (9, " ".join([text(60)] * 2))
    return docs


def test_planted_passages_are_found_and_others_left_alone(spark):
    docs = rows()
    got = {r.doc_id: r for r in S.repeated_passages(spark, frame(spark, docs, clashing=True)).collect()}
    assert set(got) == set(range(20))
    assert {d for d, r in got.items() if r.spans} == {d for d, r in got.items() if r.repeated} == {3, 8, 15}
    assert [got[d].first_doc_ids for d in (3, 8, 15)] == [[], [3], [3]]
    for d in (3, 8, 15):
        data = dict(docs)[d].encode()
        (span,) = got[d].spans
        found = data[span.start : span.end].decode()
        assert found in PASSAGE and len(found) > 0.5 * len(PASSAGE)
        assert span.first_doc_id == 3 and span.drop == (d != 3)
        assert got[d].repeated_bytes == span.end - span.start and got[d].dropped_bytes == (0 if d == 3 else got[d].repeated_bytes)
        left = S.without_spans(data, [s.asDict() for s in got[d].spans])
        assert left == (data if d == 3 else data.replace(found.encode(), b""))


def test_copies_null_empty_and_shared_ids(spark):
    whole = text(80)
    docs = [(2, whole), (1, whole), (1, whole), (None, whole), (7, None), (8, ""), (9, "short")]
    got = S.repeated_passages(spark, frame(spark, docs)).collect()
    kept = [r for r in got if r.repeated_bytes and not r.dropped_bytes]
    assert len(got) == 7 and len(kept) == 1 and kept[0].doc_id == 1
    size = len(whole.encode())
    assert sorted(r.repeated_bytes for r in got) == [0, 0, 0] + [size] * 4
    assert {r.doc_id: r.n_chunks for r in got if r.doc_id in (7, 8, 9)} == {7: 0, 8: 0, 9: len(S.cuts(b"short"))}
    assert S.repeated_passages(spark, frame(spark, [])).collect() == []


def test_every_document_that_keeps_a_part_is_named(spark):
    first, second = text(60), text(60)
    docs = [(1, f"{text(30)} {first} {text(30)}"), (2, f"{text(30)} {first} {second} {text(30)}"), (3, f"{text(30)} {first} {second} {text(30)}")]
    got = {r.doc_id: r for r in S.repeated_passages(spark, frame(spark, docs)).collect()}
    assert [got[d].first_doc_ids for d in (1, 2, 3)] == [[], [1], [1, 2]]
    assert [[(s.first_doc_id, s.drop) for s in got[d].spans] for d in (1, 2, 3)] == [[(1, False)], [(1, True), (2, False)], [(1, True), (2, True)]]


@pytest.mark.parametrize("letters", [(2, 5), (2, 7)])
def test_passages_of_51_words_are_found(spark, letters):
    """Short words, 4.5 and 5.5 bytes with the space after; every passage is in two documents and nothing else is."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghiklmnoprstuvw", k=rng.randint(*letters))) for _ in range(5000)]

    def words(n):
        return " ".join(rng.choices(vocabulary, k=n))

    planted = [words(51) for _ in range(300)]
    docs = [(i, f"{words(40)} {planted[i % 300]} {words(40)}") for i in range(600)]
    got = {r.doc_id: r for r in S.repeated_passages(spark, frame(spark, docs)).collect()}
    lost = [i for i in range(600) if not got[i].spans]
    assert lost == []
    assert all(got[i + 300].first_doc_ids == [i] for i in range(300))
    shares = [sum(s.end - s.start for s in got[i].spans) / len(planted[i % 300]) for i in range(600)]
    assert min(shares) > 0.9 and max(shares) < 1.2


def test_common_bytes_and_whole_words():
    assert S.common(b"rest of it. Next", b"rest of it. Now", True) == (13, 11)
    assert S.common(b"ab", b"ab cd", True) == (2, 2)
    assert S.common(b"x some", b"y some", False) == (5, 4)
    assert S.common(b"abc", b"abd", True) == (2, 0)


@pytest.mark.parametrize("word", ["a", "la ", "word ", "twelve byte ", "nineteen byte long ", "é"])
def test_repetitive_passages_are_found_wherever_they_stand(spark, word):
    """One word, or sign, over and over, each time after another text of another length."""
    docs = [(i, text(20 + i) + "x" * (i % 7) + " " + word * (480 // len(word)) + " " + text(30)) for i in range(20)] + [(99, text(200))]
    got = {r.doc_id: r for r in S.repeated_passages(spark, frame(spark, docs)).collect()}
    assert [i for i in range(20) if not got[i].spans] == [] and not got[99].spans
    assert all(got[i].repeated_bytes > 350 for i in range(20))


def brute_force(docs, least):
    """For each document the places that lie in a stretch of ``least`` bytes or more that is in another document too."""
    data = {d: t.encode() for d, t in docs}
    at = collections.defaultdict(list)
    for d, t in data.items():
        for i in range(len(t) - 15):
            at[t[i : i + 16]].append((d, i))
    covered = {d: set() for d in data}
    for places in at.values():
        for d, i in places:
            for e, j in places:
                if d == e or (i and j and data[d][i - 1] == data[e][j - 1]):
                    continue
                x, y, n = data[d], data[e], 16
                while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
                    n += 1
                if n >= least:
                    covered[d].update(range(i, i + n))
    return data, covered


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_spans_against_all_pairs(spark, seed):
    """Passages of many lengths, repeated, nested and beside each other. A stretch clearly long enough is covered but for a word at either end; what is covered repeats
    elsewhere."""
    rng = random.Random(seed)
    passages = [" ".join(rng.choices(VOCABULARY, k=rng.randint(8, 70))) for _ in range(12)] + ["ha " * 70, "=-" * 110]
    passages += [p[len(p) // 3 :] for p in passages[:4]]
    docs = []
    for i in range(50):
        parts = [text(rng.randint(5, 40)) if rng.random() < 0.6 else rng.choice(passages) for _ in range(6)]
        docs.append((i, " ".join(parts)))
    data, covered = brute_force(docs, 170)
    short = brute_force(docs, 24)[1]
    for r in S.repeated_passages(spark, frame(spark, docs)).collect():
        found = {b for s in r.spans for b in range(s.start, s.end)}
        lost = sorted(covered[r.doc_id] - found)
        stretches = sum(1 for a, b in zip([-9, *lost], lost) if b != a + 1)
        assert len(lost) <= 32 * max(stretches, 1) and len(lost) <= 0.2 * len(covered[r.doc_id]) + 40, (r.doc_id, len(lost))
        assert len(found - short[r.doc_id]) <= 2 * len(r.spans)


def test_ids_of_any_type_and_clashing_names(spark, tmp_path):
    docs = frame(spark, [(1, f"{text(9)} {PASSAGE} {text(9)}"), (2, f"{text(5)} {PASSAGE}"), (3, text(50))])
    docs = docs.withColumn("doc_id", F.concat(F.lit("n"), F.col("doc_id").cast("string"))).withColumn("_metadata", F.lit("x")).withColumn("digests", F.lit(1))
    got = {r.doc_id: r.first_doc_ids for r in S.repeated_passages(spark, docs).collect() if r.repeated}
    assert got == {"n1": [], "n2": ["n1"]}


def test_rows_are_asked_for_by_bitmap(spark, monkeypatch):
    """Above FEW rows the texts go through bitmaps, and nothing is lost."""
    docs = rows()
    want = sorted(map(repr, S.repeated_passages(spark, frame(spark, docs)).collect()))
    monkeypatch.setattr(common, "FEW", 0)
    assert sorted(map(repr, S.repeated_passages(spark, frame(spark, docs)).collect())) == want
    for bits in (6, 8):  # full bitmaps let everything through
        monkeypatch.setattr(S, "DIGEST_BITS", bits)
        monkeypatch.setattr(common, "LEAST_BITS", bits)
        monkeypatch.setattr(common, "MOST_BITS", bits)
        assert sorted(map(repr, S.repeated_passages(spark, frame(spark, docs)).collect())) == want

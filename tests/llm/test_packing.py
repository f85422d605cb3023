import random
import zlib
from collections import Counter

import numpy as np

from staffline.llm import packing as P
from staffline.llm.tokens import WordEncoder, tokenizer_path

from .helpers import check_packing, frame, least_sequences

RNG = random.Random(8)
INSTANCES = [(c, [RNG.randint(1, c) for _ in range(RNG.randint(1, 9))]) for c in (6, 10, 20, 50) for _ in range(60)]


def test_plan_packs_everything_and_stays_close_to_the_least():
    over = 0
    for capacity, lengths in INSTANCES:
        plan = P.plan(dict(Counter(lengths)), capacity)
        packed = Counter()
        for pattern, times in plan:
            assert times > 0 and sum(s * n for s, n in pattern) <= capacity
            for s, n in pattern:
                packed[s] += n * times
        assert packed == Counter(lengths)
        n, least = sum(t for _, t in plan), least_sequences(lengths, capacity)
        assert n <= max(least, -(-11 * least // 9))
        over += n > least
    assert over <= 3


def test_reduction_never_costs_a_sequence():
    for capacity, lengths in INSTANCES:
        sizes = P.Sizes(dict(Counter(lengths)))
        fixed = P.reduce_by_dominance(sizes, capacity)
        rest = [s for s, n in sizes.left.items() for _ in range(n)]
        assert sum(t for _, t in fixed) + least_sequences(rest, capacity) == least_sequences(lengths, capacity)


def test_plan_for_many_copies_is_small():
    counts = {s: 10**9 + s for s in range(1, 4097)}
    plan = P.plan(counts, 4096)
    assert len(plan) < 3 * 4096
    total = sum(s * n for s, n in counts.items())
    assert sum(t for _, t in plan) <= 1.001 * total / 4096


def expected_pieces(text, capacity):
    from tokenizers import Tokenizer

    ids = np.array(Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids + [1], "<u4")
    return [(i // capacity, i, len(ids[i : i + capacity]), zlib.crc32(ids[i : i + capacity].tobytes())) for i in range(0, len(ids), capacity)]


TEXTS = [None, "", " \n\t ", "a", "Hello, WORLD! it's 42 cafés and more \x1c\x85 x", "naïve é ́x 'S don't <b>", "word " * 50, "z" * 500, "日本語 テスト", "a" * 3]


def test_against_plain_tokenising(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "a"), (None, "a")]
    for capacity in (8, 4096):
        got = P.pack(spark, frame(spark, rows, clashing=True), capacity=capacity).collect()
        want = Counter((d, *p) for d, t in rows for p in expected_pieces(t, capacity))
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
        n = check_packing(got, capacity)
        assert n >= -(-sum(r.length for r in got) // capacity)


def test_every_letter_before_every_sign():
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(tokenizer_path()), WordEncoder(tokenizer_path())
    letters = [chr(c) for c in (*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0xC0, 0x180))]
    signs = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    texts = [f"s{a}{b} k{a}{b}x" for a in letters for b in signs] + ["SAHİBİ. ADRESİ: X"]
    wrong = [t for t in texts if b"".join(own.blocks(t.encode())) != np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes()]
    assert wrong == []


def test_blocks_and_forgetting_do_not_change_ids(monkeypatch):
    from staffline.llm import tokens

    text = " ".join(TEXTS[4:] * 20).encode()
    own = WordEncoder(tokenizer_path())
    whole = b"".join(own.blocks(text))
    monkeypatch.setattr(tokens, "REMEMBERED", 2)
    monkeypatch.setattr(tokens, "word_blocks", lambda data: ([w] for w in data.split()))
    assert b"".join(WordEncoder(tokenizer_path()).blocks(text)) == whole


def test_empty_table(spark):
    assert P.pack(spark, frame(spark, [])).collect() == []

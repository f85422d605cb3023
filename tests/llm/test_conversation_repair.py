"""Conversation repair: all edits tried out, a plain forward search, grammar and chain on random symbols, awkward rows."""

import hashlib
import itertools
import random
import re

import pytest

from staffline.llm import conversation_repair as cr
from tests.llm.helpers import SPACE

TURNS = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def by_trying(symbols):
    """(cost, audit) over all edits with at most two insertions at any place."""
    best = None
    gaps = [[("I" * len(w), w, 2 * len(w)) for w in ("", "u", "a", "ua", "au")]]
    for s in symbols:
        ways = [("D", "", 3)]
        if s != "X":
            extra = s.isupper()
            ways += [("K", s.lower(), extra)] + [("R", r, 2 + extra) for r in "ua"]
        gaps += [ways, gaps[0]]
    for choice in itertools.product(*gaps):
        if LEGAL.fullmatch("".join(c[1] for c in choice)):
            found = sum(c[2] for c in choice), "".join(c[0] for c in choice)
            best = found if best is None or found < best else best
    return best


def by_search(symbols):
    """(cost, audit) by a forward search over states, row by row."""
    ways = {0: (0, "")}

    def step(ways, moves):
        out = {}
        for p, (cost, audit) in ways.items():
            for q, c, letter in moves(p):
                found = cost + c, audit + letter
                out[q] = min(out.get(q, found), found)
        return out

    def insert(p):
        due = 3 if p == 2 else 2
        return [(p, 0, ""), (due, 2, "I")] + ([(5 - due, 4, "II")] if p in (0, 1) else [])

    def edit(s):
        def moves(p):
            due, extra = (3 if p == 2 else 2), int(s.isupper())
            yield p, 3, "D"
            if s != "X":
                yield due, 2 + extra, "R"
                if s.lower() == ("a" if due == 3 else "u"):
                    yield due, extra, "K"
                if s.lower() == "s" and p == 0:
                    yield 1, extra, "K"
        return moves

    for s in symbols:
        ways = step(step(ways, insert), edit(s))
    return min(w for q, w in step(ways, insert).items() if q in (0, 3))


ALPHABET = cr.GONE + cr.ROLES + cr.ROLES.upper()


def test_search_tries_enough():
    for symbols in itertools.chain(*(itertools.product(ALPHABET, repeat=n) for n in (1, 2))):
        assert by_search(symbols) == by_trying(symbols), symbols
    rng = random.Random(5)
    for _ in range(12):
        symbols = rng.choices(ALPHABET, k=3)
        assert by_search(symbols) == by_trying(symbols), symbols


@pytest.mark.parametrize("rules", [[], ["ua", "au", "\ue000\ue000", "UA", "X\ue002"]])
def test_pieces_in_any_grouping(rules):
    rng, of = random.Random(7), cr.matrices(rules)
    for n in [*range(1, 9), 40, 300]:
        symbols = "".join(rng.choices(ALPHABET + "uauaua", k=n))
        chain, at = cr.Chain(), 0
        while at < n:
            stop = at + rng.choice((1, 2, 7, 90))
            chain.append(*cr.flat(cr.piece_matrix(symbols[at:stop], rules, of)))
            at = stop
        assert chain.finish() == by_search(symbols), symbols


def test_ropes_compare_like_strings():
    rng = random.Random(3)

    def rope(text):
        if len(text) < 2 or rng.random() < 0.2:
            return text
        cut = rng.randrange(1, len(text))
        return (len(text), rope(text[:cut]), rope(text[cut:]))

    for _ in range(300):
        x, y = ("".join(rng.choices("DK", k=rng.randrange(6))) for _ in range(2))
        assert cr.less(rope(x), rope(y)) == (x < y)
        assert "".join(cr.strings(cr.joined(rope(x), rope(y)))) == x + y


def plain(rows):
    """The contract for rows (conv_id, turn, role, text) as they are."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()))
        seen, symbols, faults = set(), "", ""
        for _, role, text in own:
            bare = SPACE.sub(" ", text).strip(" ")
            fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else " "
            seen.add((role, text))
            kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
            symbols += "X" if fault in "bd" else kind.upper() if fault == "t" else kind
            faults += fault
        cost, audit = by_search(symbols)
        turns = [t for t, _, _ in own if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        lines, left, user = [], iter(own), True
        for letter in audit:
            _, role, text = (None, None, "") if letter == "I" else next(left)
            if letter == "D":
                continue
            if letter != "K":
                role = "user" if user else "assistant"
            user = role[0] in "sa"
            lines.append(f"{role}:{text}")
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *map(faults.count, "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines)
    return out


def rows_of(rng, conv, n):
    roles = ["user", "assistant"] * 6 + ["system", "user", "tool", None, "", "User"]
    texts = ["Yes.", "No", "", None, "Why?\n", "x" * 3000 + "!", " \t", "é…", "a.b "]
    return [(conv, rng.choice((i, i, i, i + 1, None)), rng.choice(roles), rng.choice(texts) if rng.random() < 0.4 else f"turn {i}" + rng.choice(("", ".", "!"))) for i in range(n)]


@pytest.mark.parametrize("piece", [3, cr.PIECE])
def test_plain_version(spark, monkeypatch, piece):
    monkeypatch.setattr(cr, "PIECE", piece)
    rng = random.Random(piece)
    rows = [r for conv in [*range(40), None] for r in rows_of(rng, conv, rng.randrange(1, 12))] + rows_of(rng, 99, 700)
    rows += [(50, 1, "user", "Hi."), (50, 2, "assistant", "Hi.")] + [(51, 3, "user", "again.")] * 9
    turns = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], TURNS + ", digest string, id int, first int").repartition(5, "text")
    audits, kept = cr.repair(spark, turns)
    found = {r.conv_id: tuple(r)[1:] for r in cr.conversations(turns, audits, cr.repaired_sha256(kept, audits)).collect()}
    want = plain(rows)
    assert found == {c: w[:-1] for c, w in want.items()}
    lines = {}
    for r in sorted(cr.repaired(kept, audits).collect(), key=lambda r: r.place):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert lines == {c: w[-1] for c, w in want.items() if w[-1]}


def test_empty_and_missing_conversations(spark):
    none = spark.createDataFrame([], TURNS)
    audits, kept = cr.repair(spark, none)
    ids = spark.createDataFrame([(4, 1, "user", "x")], TURNS)
    (row,) = cr.conversations(ids, audits, cr.repaired_sha256(kept, audits)).collect()
    assert tuple(row) == (4, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert cr.repaired(kept, audits).collect() == []


def test_rules_cover_frequent_pairs(spark):
    pieces = spark.createDataFrame([("ua" * 8,), ("sua" * 3,), ("uauX",)], "symbols string")
    rules = cr.re_pair(pieces)
    assert rules[0] == "ua" and len(cr.compressed("ua" * 8, rules)) < 6

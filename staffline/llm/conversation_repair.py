"""Cheapest repair of conversations' turns, by dynamic programming over a grammar.

A conversation is read as a string with one symbol a row: its role and its fault. A repair moves an automaton of four states
(nothing yet, system seen, user seen, assistant seen); what a row can do, with insertions before it, is a 4 x 4 matrix of
(cost, audit) over "cheapest, then least audit" and "add, then append". A path's audit tells its end and cost, so of
two equally cheap audits none begins the other, and matrices may be multiplied in any grouping.

Strings are cut into pieces of at most ``PIECE`` rows, wherever partitions end, and reduced to distinct pieces. Re-Pair replaces the most
frequent pairs of symbols in them by rules, round by round; the pairs are counted in the tasks. Each rule has one matrix, the product of its two
parts', whose audits are ropes that share theirs. A distinct piece is the product of its few symbols, found once for all conversations
that have it. The pieces of a conversation are then chained in order as a stream, so a conversation that holds a third of all
rows costs one task a row of its pieces at a time, besides its audit.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from staffline.llm.common import shared_folder, ship_package, small_side, stored

#: Costs of the edits; an audit is made of their initials.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn. A conversation may end in FINAL.
STATES, FINAL = range(4), (0, 3)
BLANK = " \t\n\x0b\x0c\r"
#: A row that must go. Other rows are their role's initial (``o``: none of the three), in upper case if truncated.
GONE, ROLES = "X", "suao"
PIECE = 256
MAX_RULES, RULES_A_ROUND = 256, 32
#: Rules are named by characters from here on.
FIRST_RULE = 0xE000

Rope = str | tuple  # a string, or (length, rope, rope)
Matrix = list[list[tuple[int, Rope] | None]]


# ---------------------------------------------------------------- ropes and matrices


def joined(x: Rope, y: Rope) -> Rope:
    if not x or not y:
        return x or y
    size = sum(len(r) if isinstance(r, str) else r[0] for r in (x, y))
    return x + y if size <= 32 and isinstance(x, str) and isinstance(y, str) else (size, x, y)


def strings(rope: Rope) -> Iterator[str]:
    waiting = [rope]
    while waiting:
        top = waiting.pop()
        if isinstance(top, str):
            yield top
        else:
            waiting += [top[2], top[1]]


def less(x: Rope, y: Rope) -> bool:
    """Whether ``x`` comes before ``y``, reading no further than their first difference."""
    left, right, a, b = strings(x), strings(y), "", ""
    while True:
        a, b = a or next(left, ""), b or next(right, "")
        n = min(len(a), len(b))
        if not n or a[:n] != b[:n]:
            return a < b
        a, b = a[n:], b[n:]


def times(x: Matrix, y: Matrix) -> Matrix:
    """The matrix of doing ``x``, then ``y``."""
    out: Matrix = [[None] * 4 for _ in STATES]
    for p in STATES:
        for q in STATES:
            best = None
            for r in STATES:
                a, b = x[p][r], y[r][q]
                if a is None or b is None:
                    continue
                cost = a[0] + b[0]
                if best is None or cost < best[0] or (cost == best[0] and less(joined(a[1], b[1]), joined(*best[1:]))):
                    best = cost, a[1], b[1]
            if best:
                out[p][q] = best[0], joined(*best[1:])
    return out


def _next(state: int) -> int:
    """The state after a user or assistant turn, whichever is due."""
    return 3 if state == 2 else 2


def insertions() -> Matrix:
    """Any number of insertions. Two are enough from every state to every other that they can lead to."""
    out: Matrix = [[(0, "") if p == q else None for q in STATES] for p in STATES]
    for p in STATES:
        at = p
        for n in (1, 2):
            at = _next(at)
            if out[p][at] is None:
                out[p][at] = n * INSERT, "I" * n
    return out


def row_matrix(symbol: str) -> Matrix:
    """One row, with insertions before it."""
    edit: Matrix = [[(DELETE, "D") if p == q else None for q in STATES] for p in STATES]
    if symbol != GONE:
        extra = TRUNCATED if symbol.isupper() else 0
        for p in STATES:
            due = _next(p)
            edit[p][due] = (KEEP + extra, "K") if symbol.lower() == ("a" if due == 3 else "u") else (REROLE + extra, "R")
        if symbol.lower() == "s":
            edit[0][1] = KEEP + extra, "K"
    return times(insertions(), edit)


# ---------------------------------------------------------------- the grammar


def compressed(symbols: str, rules: list[str]) -> str:
    for i, pair in enumerate(rules):
        symbols = symbols.replace(pair, chr(FIRST_RULE + i))
    return symbols


def re_pair(pieces: DataFrame, max_rules: int = MAX_RULES) -> list[str]:
    """Pairs of symbols that rules stand for, in order; later rules may hold earlier ones. In each round all ``pieces``' (symbols) pairs are
    counted and the most frequent ones become rules, as long as they cannot overlap. Driver and tasks hold at most ``max_rules``."""
    rules: list[str] = []
    while len(rules) < max_rules:
        known = list(rules)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pairs: Counter[str] = Counter()
            for batch in batches:
                for symbols in batch.column("symbols").to_pylist():
                    code = compressed(symbols, known)
                    pairs.update(map("".join, zip(code, code[1:], strict=False)))
            yield pa.RecordBatch.from_pydict({"pair": pa.array(pairs.keys(), pa.string()), "n": pa.array(pairs.values(), pa.int64())})

        counted = pieces.mapInArrow(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1")
        first, last, fresh = set(), set(), []
        for row in counted.orderBy(F.desc("n"), "pair").limit(4 * RULES_A_ROUND).collect():
            left, right = row["pair"]
            if left not in last and right not in first and len(fresh) < min(RULES_A_ROUND, max_rules - len(rules)):
                fresh.append(row["pair"])
                first.add(left), last.add(right)
        if not fresh:
            break
        rules += fresh
    return rules


def matrices(rules: list[str]) -> dict[str, Matrix]:
    """One matrix for each symbol and rule, rules from the bottom up."""
    of = {symbol: row_matrix(symbol) for symbol in GONE + ROLES + ROLES.upper()}
    for i, (left, right) in enumerate(rules):
        of[chr(FIRST_RULE + i)] = times(of[left], of[right])
    return of


def piece_matrix(symbols: str, rules: list[str], of: dict[str, Matrix]) -> Matrix:
    code = compressed(symbols, rules)
    product = of[code[0]]
    for symbol in code[1:]:
        product = times(product, of[symbol])
    return product


class Chain:
    """The cheapest ways to each state, while matrices are appended. For each two of them it knows how their audits go on after
    what they share: one character each, or what the longer has more. So ties need no look back."""

    def __init__(self):
        self.ways: dict[int, tuple] = {0: (0, None)}  # state: (cost, (earlier links, audit))
        self.rest: dict[tuple[int, int], tuple[str, str]] = {(0, 0): ("", "")}

    def _rest(self, r: int, a: str, s: int, b: str) -> tuple[str, str]:
        x, y = self.rest[r, s]
        if x and y:
            return x, y
        x, y = x + a, y + b
        n = len(commonprefix([x, y]))
        x, y = x[n:], y[n:]
        return (x[:1], y[:1]) if x and y else (x, y)

    def append(self, costs: list[int | None], audits: list[str | None]) -> None:
        """``costs`` and ``audits`` by 4 * state before + state after."""
        came: dict[int, tuple[int, int, str]] = {}
        for q in STATES:
            for r, (cost, _) in self.ways.items():
                own = costs[4 * r + q]
                if own is None:
                    continue
                new, best = (cost + own, r, audits[4 * r + q]), came.get(q)
                if best is None or new[0] < best[0]:
                    came[q] = new
                elif new[0] == best[0]:
                    x, y = self._rest(r, new[2], best[1], best[2])
                    if x < y:
                        came[q] = new
        rest = {(p, q): self._rest(r, a, s, b) for p, (_, r, a) in came.items() for q, (_, s, b) in came.items()}
        self.ways = {q: (cost, (self.ways[r][1], audit) if audit else self.ways[r][1]) for q, (cost, r, audit) in came.items()}
        self.rest = rest

    def finish(self) -> tuple[int, str]:
        self.append(*flat(insertions()))
        best = None
        for q in FINAL:
            if q in self.ways and (best is None or self.ways[q][0] < self.ways[best][0] or (self.ways[q][0] == self.ways[best][0] and self.rest[q, best][0] < self.rest[q, best][1])):
                best = q
        cost, link = self.ways[best]
        parts = []
        while link:
            link, part = link
            parts.append(part)
        return cost, "".join(reversed(parts))


def flat(matrix: Matrix) -> tuple[list[int | None], list[str | None]]:
    cells = [cell for row in matrix for cell in row]
    return [c and c[0] for c in cells], [c and "".join(strings(c[1])) for c in cells]


# ---------------------------------------------------------------- Spark jobs


PIECE_FIELDS = (
    "part long, no long, symbols string, first string, last string, illegal long, blank long, duplicate long, truncated long, "
    "low long, high long, turns long"
)


def _with(schema: T.StructType, column: str, rest: str) -> T.StructType:
    return T.StructType([schema[column], *T._parse_datatype_string(rest).fields])


def _batches(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = to_arrow_schema(schema)
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, kinds, strict=True)], names=kinds.names)


def _rows(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, digest and id of each row, nulls as one space."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), digest.alias("digest"), F.monotonically_increasing_id().alias("id"))


def _symbols(rows: DataFrame, folder: str) -> DataFrame:
    """conv_id, turn, role, digest, id, symbol and fault (b, d, t or a space) of each row."""
    bare = F.rtrim(F.col("text"), F.lit(BLANK))
    narrow = rows.select("conv_id", "turn", "role", "digest", "id", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(*".!?")).alias("open"))
    seen = narrow.groupBy("conv_id", "digest").agg(F.min(F.struct("turn", "id")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    seen = stored(seen.select(F.col("conv_id").alias("of"), F.col("digest").alias("same"), F.col("first.id").alias("first")), f"{folder}/seen")
    told = narrow.join(small_side(seen), F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("same")), "left")
    fault = F.when(F.col("blank"), "b").when(F.col("first") != F.col("id"), "d").when(F.col("open"), "t").otherwise(" ")
    initial = F.substring("role", 1, 1)
    role = F.when(initial.isin(*"sua"), initial).otherwise("o")
    symbol = F.when(F.col("fault").isin("b", "d"), GONE).when(F.col("fault") == "t", F.upper(role)).otherwise(role)
    return told.withColumn("fault", fault).select("conv_id", "turn", "role", "digest", "id", symbol.alias("symbol"), "fault")


def _pieces(symbols: DataFrame) -> DataFrame:
    """Runs of at most PIECE rows of a conversation that lie beside each other in a partition, in order by (part, no)."""
    in_order = symbols.repartitionByRange("conv_id", "turn", "role", "digest", "id").sortWithinPartitions("conv_id", "turn", "role", "digest", "id")
    schema = _with(symbols.schema, "conv_id", PIECE_FIELDS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, rows, found = TaskContext.get().partitionId(), 0, [], []

        def piece() -> tuple:
            _, turns, roles, marks, faults = zip(*rows, strict=True)
            initials, known = [r[:1] for r in roles], [t for t in turns if t is not None]
            wrong = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
            of = [faults.count(f) for f in "bdt"]
            return rows[0][0], part, no, "".join(marks), initials[0], initials[-1], wrong, *of, min(known, default=None), max(known, default=None), len(set(known))

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "symbol", "fault")), strict=True):
                if rows and (len(rows) == PIECE or row[0] != rows[-1][0]):
                    found.append(piece())
                    no, rows = no + 1, []
                rows.append(row)
            yield _batches(found, schema)
            found = []
        if rows:
            yield _batches([piece()], schema)

    return in_order.mapInArrow(cut, schema)


def repair(spark: SparkSession, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row for each conversation of ``turns``, the rows of ``turns`` as ``repaired`` takes them). ``turns``: conv_id, turn, role, text.

    A conversation's rows are taken by turn (null first); rows that share it by role, then by a digest of role and text. A null role or text
    is one space; a null conv_id is a conversation of its own. A row's first fault counts: blank (nothing but white
    space), duplicate (its role and text came before in the conversation; of repeated rows all but the first), truncated (the
    last character besides white space is not ``.``, ``!`` or ``?``). Keeping a row is free, giving it the role user or assistant costs
    2, deleting it 3 (a must for the first two faults), inserting an empty user or assistant turn 2; a truncated row that stays costs 1
    more. The roles' initials must then read ``(s?(ua)+)?``. Columns: conv_id, gaps (turn numbers missing between the least and the largest),
    blank, duplicate, truncated, illegal (neighbours that are not su, ua or au), cost and audit: the initials of the cheapest edits in
    order, the ASCII-least of equally cheap ones. Texts and conversations may have any length. No rows give an empty result.
    """
    ship_package(spark)
    folder = shared_folder(spark)
    rows = stored(_rows(turns), f"{folder}/rows")
    pieces = stored(_pieces(_symbols(rows, folder)), f"{folder}/pieces")
    distinct = stored(pieces.select("symbols").distinct(), f"{folder}/distinct")
    rules = re_pair(distinct)
    of = matrices(rules)
    cells = T._parse_datatype_string("symbols string, costs array<long>, audits array<string>")

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                some = batch.column("symbols").slice(first, 500).to_pylist()
                yield _batches([(s, *flat(piece_matrix(s, rules, of))) for s in some], cells)

    products = stored(distinct.mapInArrow(evaluate, cells), f"{folder}/products")
    chained = pieces.join(products.hint("merge"), "symbols").repartition("conv_id").sortWithinPartitions("conv_id", "part", "no")
    schema = _with(turns.schema, "conv_id", "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found = None, []

        def finished() -> tuple:
            gaps = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["turns"]
            return now["conv_id"], gaps, *(now[k] for k in ("blank", "duplicate", "truncated", "illegal")), *now["chain"].finish()

        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                for row in batch.slice(first, 1000).to_pylist():
                    if now and now["conv_id"] == row["conv_id"]:
                        row["illegal"] += now["last"] + row["first"] not in ("su", "ua", "au")
                        for k in ("illegal", "blank", "duplicate", "truncated"):
                            now[k] += row[k]
                        if row["low"] is not None:
                            now["turns"] += row["turns"] - (now["high"] == row["low"])
                            now["low"], now["high"] = row["low"] if now["low"] is None else now["low"], row["high"]
                        now["last"] = row["last"]
                    else:
                        if now:
                            found.append(finished())
                        now = row | {"chain": Chain()}
                    now["chain"].append(row["costs"], row["audits"])
                if found:
                    yield _batches(found, schema)
                    found = []
        if now:
            yield _batches([finished()], schema)

    return stored(chained.mapInArrow(chain, schema), f"{folder}/audits"), rows


# ---------------------------------------------------------------- what the audits make


def _in_order(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order, in one partition."""
    of_audit = audits.select("conv_id", F.lit(0).alias("kind"), F.col("audit").alias("text"))
    lines = rows.withColumn("kind", F.lit(1)).unionByName(of_audit, allowMissingColumns=True)
    order = ["conv_id", "kind", "turn", "role", "digest", "id"]
    return lines.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "kind", "role", "text")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, role, text) of each turn after repair, as a stream, and (conv_id, None, None) after each conversation."""
    audit, at, state, key = "", 0, 0, ()

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while audit[at : at + 1] == "I":
            at, state = at + 1, _next(state)
            yield key, "assistant" if state == 3 else "user", ""

    for some in (batch.slice(first, 200) for batch in batches for first in range(0, batch.num_rows, 200)):
        for conv, kind, role, text in zip(*(c.to_pylist() for c in some.columns), strict=True):
            if kind == 0:
                if key != ():
                    yield from inserted()
                    yield key, None, None
                audit, at, state, key = text, 0, 0, conv
                continue
            yield from inserted()
            letter, at = audit[at], at + 1
            if letter == "K":
                state = {"s": 1, "u": 2, "a": 3}[role[0]]
                yield conv, role, text
            elif letter == "R":
                state = _next(state)
                yield conv, "assistant" if state == 3 else "user", text
    if key != ():
        yield from inserted()
        yield key, None, None


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role, text of the turns after the repair. ``rows`` and ``audits`` come from ``repair``."""
    schema = _with(rows.schema, "conv_id", "place long, role string, text string")

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, found = 0, []
        for conv, role, text in _edited(batches):
            if role is None:
                place = 0
                continue
            found.append((conv, place, role, text))
            place += 1
            if len(found) == 500:
                yield _batches(found, schema)
                found = []
        yield _batches(found, schema)

    return _in_order(rows, audits).mapInArrow(edit, schema)


def repaired_sha256(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256 of ``role:text`` of the turns after the repair, joined by line ends. SHA-256 goes through a text in order, so
    a conversation's texts pass through one task, as a stream."""
    schema = _with(rows.schema, "conv_id", "repaired_sha256 string")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, between, found = hashlib.sha256(), b"", []
        for conv, role, text in _edited(batches):
            if role is None:
                found.append((conv, state.hexdigest()))
                state, between = hashlib.sha256(), b""
            else:
                state.update(between + f"{role}:{text}".encode())
                between = b"\n"
            if len(found) == 500:
                yield _batches(found, schema)
                found = []
        yield _batches(found, schema)

    return _in_order(rows, audits).mapInArrow(digest, schema)


def conversations(turns: DataFrame, audits: DataFrame, digests: DataFrame) -> DataFrame:
    """Every conv_id of ``turns`` with its row of ``audits`` and ``digests``; one without rows has zeros, no edits and the hash of nothing."""
    ids = turns.select("conv_id").distinct()
    same: Column = F.col("conv_id").eqNullSafe(F.col("_id"))
    found = audits.withColumnRenamed("conv_id", "_id").join(digests.withColumnRenamed("conv_id", "_of"), F.col("_id").eqNullSafe(F.col("_of")))
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    nothing = hashlib.sha256().hexdigest()
    return ids.join(found, same, "left").select(
        "conv_id",
        *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )

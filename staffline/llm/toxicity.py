"""Toxicity: a weighted finite-state grammar over clauses.

Words are read as classes (insult, intent, harm, target, negation, report, other) and five transducers are composed
into one machine: insults and threats mark cores, negation and reported speech qualify them, and the target
transducer holds a core back until it knows whether its clause is aimed at someone. The machine's outputs are matched
clauses such as ``insult+aimed`` or ``threat+reported``; a text's score is a logistic function of the sum of their weights.

Closed classes are fixed word lists of four languages. Insults are seeds and word stems that the labelled rows show to be insults, so
inflected forms and other languages count; the weights of the outputs are fitted to the labelled rows, starting
from prior weights. A quotation goes on over the ends of sentences until it is closed or its paragraph ends.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staffline.llm.common import shared_folder, ship_package, stored

OTHER, END, QUOTE, INSULT, INTENT, HARM, TARGET, NEGATION, REPORT, PARAGRAPH = range(10)
#: Words by class: English, German, French, Spanish.
CLASSES: dict[int, str] = {
    INSULT: "idiot idiots moron morons stupid imbecile dumb fool foolish loser losers scum trash garbage worthless pathetic disgusting "
    "vermin pig filth filthy jerk clown clowns dimwit cretin retard retarded bastard bastards bitch asshole "
    "dumm dumme dummer dummkopf trottel arschloch abschaum wertlos "
    "imbécile imbéciles crétin crétins débile connard connasse salaud salope ordure "
    "idiota idiotas estúpido estúpida estúpidos imbécil imbéciles pendejo cabrón gilipollas escoria",
    INTENT: "will gonna going shall must should deserve deserves ought "
    "werde wirst wird werden sollst sollte verdienst vais vas va vont mérites voy vas vamos van mereces",
    HARM: "kill hurt beat burn destroy shoot stab hang hunt crush murder die punch strangle "
    "töten umbringen schlagen verprügeln verbrennen tuer frapper brûler étrangler matar golpear quemar",
    TARGET: "you your yours yourself he him his she her they them their these those people everyone "
    "du dich dir dein deine er ihn ihm sie ihnen ihr euch eure tu te toi ton ta tes vous votre vos il lui elle ils elles eux leur leurs "
    "tú ti tus usted ustedes vosotros él ella ellos ellas",
    NEGATION: "not no never neither nor without isn't aren't wasn't don't doesn't didn't won't can't cannot "
    "nicht kein keine keinen keinem keiner nie niemals weder ohne ne pas jamais aucun aucune sans ni nunca jamás tampoco ningún ninguna sin",
    REPORT: "said says say wrote writes claimed claims called calls quoted reported according alleged tweeted "
    "sagte sagt schrieb schreibt behauptete behauptet nannte nennt laut angeblich "
    "dit disait déclare déclaré écrit affirme affirmé appelle appelé selon prétend dijo dice escribió escribe afirma afirmó llamó llama según",
}
#: Shortened words that stand before an apostrophe; the word after it has its own class. The first one is a negation.
ELISIONS = ("n", "l", "d", "j", "m", "t", "s", "c", "qu")
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n\"“”„‟«»‹›]")
#: Signs that open a quotation where none is open, and close one where it is: languages use them either way.
_QUOTES = frozenset('"“”„‟«»‹›')
_APOSTROPHES = "’ʼ‘´`"
#: How many words an intent reaches to a harm, and a negation to a core.
THREAT_REACH, NEGATION_REACH = 4, 3

KINDS, QUALIFIERS, AIMS = ("insult", "threat"), ("plain", "negated", "reported"), ("loose", "aimed")
LABELS = [f"{k}+{q}+{a}" for k in KINDS for q in QUALIFIERS for a in AIMS]
#: Weights that the fit starts from and is held to: an asserted clause counts, a negated or reported one little.
PRIOR = np.array([{"plain": 5.0, "negated": 1.0, "reported": 2.0}[q] + 0.5 * (a == "aimed") for _ in KINDS for q in QUALIFIERS for a in AIMS])
PRIOR_BIAS = -3.0


# ---------------------------------------------------------------- transducers


@dataclass(frozen=True)
class Transducer:
    """A deterministic machine: ``step(state, symbol)`` gives the next state and the symbols put out.

    Symbols are ints: token classes, or core marks from CORE on. States are hashable.
    """

    start: object
    step: Callable[[object, int], tuple[object, tuple[int, ...]]]


CORE = 100  # CORE + index in LABELS; before the last transducer the aim is still 'loose'


def mark(kind: int, qualifier: int = 0, aim: int = 0) -> int:
    return CORE + (kind * len(QUALIFIERS) + qualifier) * len(AIMS) + aim


def insult_step(state: object, symbol: int) -> tuple[object, tuple[int, ...]]:
    return state, (mark(0) if symbol == INSULT else symbol,)


def threat_step(state: int, symbol: int) -> tuple[int, tuple[int, ...]]:
    """An intent followed within reach by a harm is a threat; a harm alone is an ordinary word."""
    if symbol in (END, PARAGRAPH, QUOTE):
        return 0, (symbol,)
    if symbol == INTENT:
        return THREAT_REACH, (symbol,)
    if symbol == HARM:
        return 0, (mark(1) if state else OTHER,)
    return max(0, state - 1), (symbol,)


def negation_step(state: int, symbol: int) -> tuple[int, tuple[int, ...]]:
    if symbol in (END, PARAGRAPH):
        return 0, (symbol,)
    if symbol == NEGATION:
        return NEGATION_REACH, (symbol,)
    if symbol >= CORE and state:
        return state - 1, (symbol + len(AIMS),)
    return max(0, state - 1), (symbol,)


def report_step(state: tuple[bool, bool], symbol: int) -> tuple[tuple[bool, bool], tuple[int, ...]]:
    """What follows a verb of saying in its sentence, or stands in quotes, is reported (unless negated already). Quotes last until they are
    closed, a paragraph long at most."""
    said, quoted = state
    if symbol == END:
        return (False, quoted), (symbol,)
    if symbol == PARAGRAPH:
        return (False, False), (symbol,)
    if symbol == QUOTE:
        return (said, not quoted), (symbol,)
    if symbol == REPORT:
        return (True, quoted), (symbol,)
    if symbol >= CORE and (said or quoted) and (symbol - CORE) // len(AIMS) % len(QUALIFIERS) == 0:
        return state, (symbol + 2 * len(AIMS),)
    return state, (symbol,)


def target_step(state: tuple[bool, int], symbol: int) -> tuple[tuple[bool, int], tuple[int, ...]]:
    """Holds the last core of the clause back until a target, another core or the clause's end."""
    aimed, held = state
    if symbol in (END, PARAGRAPH):
        return (False, 0), ((held + aimed,) if held else ())
    if symbol == TARGET:
        return (True, held), ()
    if symbol >= CORE:
        return (aimed, symbol), ((held + aimed,) if held else ())
    return state, ()


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The machine that feeds what ``first`` puts out to ``second``."""

    def step(state: tuple, symbol: int) -> tuple[tuple, tuple[int, ...]]:
        a, middle = first.step(state[0], symbol)
        b, out = state[1], ()
        for m in middle:
            b, more = second.step(b, m)
            out += more
        return (a, b), out

    return Transducer((first.start, second.start), step)


def compiled(machine: Transducer, symbols: range = range(10)) -> tuple[list[list[int]], list[list[tuple[int, ...]]]]:
    """Tables of next states and outputs (as indices of LABELS) over all reachable states; 0 is the start."""
    number, order = {machine.start: 0}, [machine.start]
    following: list[list[int]] = []
    output: list[list[tuple[int, ...]]] = []
    for state in order:
        row_next, row_out = [], []
        for symbol in symbols:
            after, out = machine.step(state, symbol)
            if after not in number:
                number[after] = len(order)
                order.append(after)
            row_next.append(number[after])
            row_out.append(tuple(x - CORE for x in out))
        following.append(row_next)
        output.append(row_out)
    return following, output


def grammar() -> Transducer:
    machine = Transducer(None, insult_step)
    for start, step in ((0, threat_step), (0, negation_step), ((False, False), report_step), ((False, 0), target_step)):
        machine = compose(machine, Transducer(start, step))
    return machine


FOLLOWING, OUTPUT = compiled(grammar())
#: The states in which a clause begins: outside a quotation, and in one.
BEGIN = (0, FOLLOWING[FOLLOWING[0][QUOTE]][END])


# ---------------------------------------------------------------- texts


def base_classes() -> dict[str, int]:
    return {word: c for c, words in CLASSES.items() for word in words.split()} | dict.fromkeys(".!?;:", END) | {"\n": PARAGRAPH} | dict.fromkeys(_QUOTES, QUOTE)


def tokens(text: str) -> list[str]:
    text = text.lower()
    for sign in _APOSTROPHES:
        text = text.replace(sign, "'")
    return _TOKEN.findall(text)


def clause_counts(text: str, lexicon: Lexicon) -> np.ndarray:
    """How often each of LABELS is matched in ``text``. Clauses without a core put nothing out and are passed over; of what is before a
    clause only matters whether it leaves a quotation open."""
    counts = np.zeros(len(LABELS))
    found = [lexicon[token] for token in tokens(text)]
    codes = np.array(found, np.uint8)
    cores = np.flatnonzero((codes == INSULT) | (codes == HARM))
    if not len(cores):
        return counts
    ends = np.concatenate([[-1], np.flatnonzero((codes == END) | (codes == PARAGRAPH)), [len(codes)]])
    quotes = np.concatenate([[0], np.cumsum(codes == QUOTE)])  # before each place
    paragraphs = np.concatenate([[0], np.flatnonzero(codes == PARAGRAPH) + 1])
    for clause in np.unique(np.searchsorted(ends, cores)):
        start = ends[clause - 1] + 1
        state = BEGIN[(quotes[start] - quotes[paragraphs[np.searchsorted(paragraphs, start, "right") - 1]]) % 2]
        for symbol in (*found[start : ends[clause]], END):
            for label in OUTPUT[state][symbol]:
                counts[label] += 1
            state = FOLLOWING[state][symbol]
    return counts


class Lexicon(dict):
    """Token -> class. A word that begins with a learned stem is an insult, or is one that is shorter than STEM_LENGTHS; looked-up words are remembered."""

    REMEMBERED = 300_000

    def __init__(self, stems: list[str]):
        super().__init__(base_classes())
        self.stems = frozenset(stems)
        self.lengths = sorted({len(x) for x in stems if len(x) >= STEM_LENGTHS[0]})

    def __missing__(self, token: str) -> int:
        if len(self) > self.REMEMBERED:
            self.clear()
            self.update(base_classes())
        head, apostrophe, tail = token.partition("'")
        if token in self.stems or any(token[:n] in self.stems for n in self.lengths):
            found = INSULT
        elif apostrophe and head in ELISIONS:
            found = NEGATION if head == ELISIONS[0] else self[tail]
        else:
            found = OTHER
        self[token] = found
        return found


@dataclass(frozen=True)
class ToxicityModel:
    stems: list[str]
    bias: float
    weights: np.ndarray


def score_counts(counts: np.ndarray, model: ToxicityModel) -> float:
    return float(1 / (1 + np.exp(-np.clip(model.bias + counts @ model.weights, -500, 500))))


# ---------------------------------------------------------------- learning


def labelled_sample(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows_per_label: int) -> tuple[DataFrame, dict[int, float]]:
    """(text, toxic) of about ``rows_per_label`` documents of either label, and the share that was taken of each.

    The sample's ids are bounded by that parameter and are broadcast. Rows with a null id or label are left out;
    a document that has both labels counts as toxic.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    there = {row["toxic"]: row["count"] for row in known.groupBy("toxic").count().collect()}
    share = {k: min(1.0, rows_per_label / n) for k, n in there.items()}
    place = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(place < F.when(F.col("toxic") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)))
    sample = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    return stored(sample, f"{shared_folder(spark)}/labelled"), share


#: Lengths of the stems that are counted; a shorter word is a stem itself.
STEM_LENGTHS = range(4, 9)


def stems_of(text: str) -> set[str]:
    words = {w for w in tokens(text) if len(w) > 2}
    return {w[:n] for w in words for n in STEM_LENGTHS if n <= max(len(w), STEM_LENGTHS[0])}


def learned_stems(sample: DataFrame, support: int = 3, least_z: float = 3.5, least_odds: float = 3.0, most: int = 500) -> list[str]:
    """Stems that mark toxic texts: log-odds of at least ``least_odds`` and ``least_z`` standard errors.

    Equal texts count once. Of stems that contain each other the surer one is taken, the longer if equal, and the shorter
    only if it is found in more toxic texts. At most ``most`` stems, the surest.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_label = (Counter(), Counter())
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                by_label[toxic].update(stems_of(text))
            stems = list(by_label[0] | by_label[1])
            counts = {k: pa.array([c[x] for x in stems], pa.int64()) for k, c in zip(("clean", "toxic"), by_label, strict=True)}
            yield pa.RecordBatch.from_pydict({"stem": pa.array(stems, pa.string())} | counts)

    texts = sample.dropDuplicates(["text"])
    size = {row["toxic"]: row["count"] for row in texts.groupBy("toxic").count().collect()}
    if len(size) < 2:
        return []
    stems = texts.mapInArrow(count, "stem string, clean long, toxic long").groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))

    def odds(column: str, n: int) -> Column:
        return (F.col(column) + 0.5) / (n - F.col(column) + 0.5)

    log_odds = F.log(odds("toxic", size[1]) / odds("clean", size[0]))
    z = log_odds / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    found = stems.where((F.col("toxic") >= support) & (log_odds >= least_odds)).withColumn("z", z).where(F.col("z") >= least_z)
    taken: dict[str, int] = {}
    for row in found.orderBy(F.desc("z"), F.desc(F.length("stem")), "stem").limit(20 * most).collect():
        stem, n = row["stem"], row["toxic"]
        if any(stem[:k] in taken for k in range(STEM_LENGTHS[0], len(stem))):
            continue
        if len(stem) >= STEM_LENGTHS[0] and 1.05 * sum(m for longer, m in taken.items() if longer.startswith(stem)) >= n:
            continue
        taken[stem] = n
    return list(taken)[:most]


def fit_weights(counts: np.ndarray, toxic: np.ndarray, importance: np.ndarray, ridge: float = 1.0) -> tuple[float, np.ndarray]:
    """Logistic regression by Newton steps, held to the prior weights by ``ridge``."""
    x = np.hstack([np.ones((len(counts), 1)), counts])
    prior = np.concatenate([[PRIOR_BIAS], PRIOR])
    w, hold = prior.copy(), np.full(len(prior), ridge)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (importance * (p - toxic)) + hold * (w - prior)
        hessian = (x * (importance * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(hold)
        move = np.linalg.solve(hessian, gradient)
        w -= move * min(1.0, 2.0 / max(1e-12, np.abs(move).max()))
        if np.abs(move).max() < 1e-8:
            break
    return float(w[0]), w[1:]


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows_per_label: int = 10_000) -> ToxicityModel:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); without both labels the prior weights stand.

    Words and weights are fitted on at most about ``rows_per_label`` documents of either label (all, if there are
    fewer), weighted back to the proportions of all labelled rows. What the driver gathers is bounded by it.
    """
    ship_package(spark)
    sample, share = labelled_sample(spark, docs, labels, rows_per_label)
    stems = learned_stems(sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(stems)
        for batch in batches:
            rows = [clause_counts(text, lexicon) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"counts": pa.array(rows, pa.list_(pa.float64())), "toxic": batch.column("toxic")})

    rows = sample.mapInArrow(count, "counts array<double>, toxic int").collect()
    if len({row["toxic"] for row in rows}) < 2:
        return ToxicityModel(stems, PRIOR_BIAS, PRIOR)
    counts, toxic = np.array([row["counts"] for row in rows]), np.array([row["toxic"] for row in rows], float)
    importance = np.where(toxic == 1, 1 / share[1], 1 / share[0])
    return ToxicityModel(stems, *fit_weights(counts, toxic, importance / importance.mean()))


def toxicity(spark: SparkSession, docs: DataFrame, model: ToxicityModel, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with score, predicted (score >= 0.5) and clauses (matched labels and how often).

    Only ``text`` is an input, and all of it. A null, empty or unmatched text has the score of no clauses.
    Equal texts have equal scores.
    """
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    fields = docs.select(*keep).schema.fields
    names = [f.name for f in fields]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        lexicon = Lexicon(own.stems)
        for batch in batches:
            counts = [clause_counts(t.as_py() or "", lexicon) for t in batch.column("__text")]
            scores = [score_counts(c, own) for c in counts]
            clauses = [[{"label": LABELS[i], "n": int(c[i])} for i in np.flatnonzero(c)] for c in counts]
            made = {
                "score": pa.array(scores, pa.float64()),
                "predicted": pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                "clauses": pa.array(clauses, pa.list_(pa.struct([("label", pa.string()), ("n", pa.int64())]))),
            }
            yield pa.RecordBatch.from_pydict({k: batch.column(k) for k in names} | made)

    clause = T.StructType().add("label", T.StringType()).add("n", T.LongType())
    schema = T.StructType([*fields]).add("score", T.DoubleType()).add("predicted", T.IntegerType()).add("clauses", T.ArrayType(clause))
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(score, schema)

"""Log probabilities of documents under a gated recurrent language model.

The most frequent words (``symbols``) are the network's symbols; all others share one symbol and are told apart
by their corpus counts, so the model is a proper distribution over all words. Counts come from all training
documents and stay a distributed table. The most frequent ``head`` words' counts are broadcast; the rare rest of
each document's words is joined with the table.

The network is trained on all training documents in shards: every shard goes through truncated backpropagation in its own task,
and Spark averages the shards' weights, a few rounds of it. Whole documents are scored, the state
carried from window to window.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staffline.llm import gru
from staffline.llm.common import shared_folder, ship_package, stored, word_blocks

#: The end token. No word contains a space.
END = b" "
#: Distinct words that a counting task holds before it passes them on.
HELD = 200_000
#: Bytes of texts that a task turns into tokens together; a longer text is cut into parts at white space.
BLOCK = 1 << 22
SPACES = b" \t\n\r\x0b\x0c"
IS_SPACE = bytes(i in SPACES for i in range(256))


# ---------------------------------------------------------------- tokens


def token_blocks(texts: pa.Array, size: int = BLOCK) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """The tokens of ``texts`` (binary; null is empty) in order, about ``size`` bytes at a time: tokens, and for each part of a text in the block
    the text's number and how many tokens the part has. END follows a text's last word; a text may go on in the next block."""
    parts: list[bytes] = []
    of, last, held = [], [], 0
    for i, text in enumerate(texts):
        data, start = text.as_py() or b"", 0
        while True:
            stop = start + size
            while stop < len(data) and data[stop] not in SPACES:
                stop += 1
            parts.append(data[start:stop])
            of.append(i)
            last.append(stop >= len(data))
            held, start = held + len(parts[-1]) + 1, stop
            if held >= size:
                yield _tokens(parts, of, last)
                parts, of, last, held = [], [], [], 0
            if start >= len(data):
                break
    if parts:
        yield _tokens(parts, of, last)


def _tokens(parts: list[bytes], of: list[int], last: list[bool]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    joined = END.join([*parts, b""]).lower()  # a space after each part: the END token where a text ends
    after = np.cumsum([len(p) + 1 for p in parts])
    end = after[np.array(last)] - 1
    kept = np.ones(len(joined) + 2, bool)
    kept[0] = kept[-1] = False
    kept[1:-1] = ~np.frombuffer(joined.translate(IS_SPACE), bool)
    starts, stops = kept[1:-1] & ~kept[:-2], kept[1:-1] & ~kept[2:]
    starts[end] = stops[end] = True
    kept = kept[1:-1]
    kept[end] = True
    first = np.flatnonzero(starts)
    offsets = np.zeros(len(first) + 1, np.int64)
    np.cumsum(np.flatnonzero(stops) + 1 - first, out=offsets[1:])
    data = np.frombuffer(joined, np.uint8)[kept]
    tokens = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return tokens, np.array(of), np.diff(np.searchsorted(first, after), prepend=0)


# ---------------------------------------------------------------- counts


def token_counts(docs: DataFrame) -> DataFrame:
    """(token binary, c) over all of ``docs`` (text): lower-case words, and one END for each document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for tokens, _, _ in token_blocks(batch.column("text")):
                counts = tokens.value_counts()
                held.append(pa.table({"token": counts.field(0), "n": counts.field(1)}))
                if sum(t.num_rows for t in held) > HELD:
                    held = [_merged(held)]
                    if held[0].num_rows > HELD:
                        yield from _rows(held.pop())
        if held:
            yield from _rows(_merged(held))

    partial = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "token binary, n long")
    return partial.groupBy("token").agg(F.sum("n").alias("c"))


def _merged(counts: list[pa.Table]) -> pa.Table:
    sums = pa.concat_tables(counts).group_by("token", use_threads=False).aggregate([("n", "sum")])
    return sums.select(["token", "n_sum"]).rename_columns(["token", "n"])


def _rows(counts: pa.Table) -> list[pa.RecordBatch]:
    return counts.set_column(0, "token", counts.column("token").cast(pa.binary())).to_batches()


@dataclass
class Vocabulary:
    """The most frequent words by falling count; of them, the first ``symbols`` are the network's own."""

    words: list[bytes]
    counts: np.ndarray
    symbols: int
    tokens: int  # N: all training tokens
    distinct: int  # V

    def __post_init__(self) -> None:
        self.place = {w: i for i, w in enumerate(self.words)}
        self.known = pa.array(self.words, pa.large_binary())
        self.log_counts = np.log10(self.counts + 1.0)
        self.rest = self.symbols  # the symbol of all other words
        own = int(self.counts[: self.symbols].sum())
        #: Tokens, distinct words and one unseen word: what the other words' probabilities are shares of.
        self.rest_mass = self.tokens - own + self.distinct - self.symbols + 1
        self.symbol_counts = np.append(self.counts[: self.symbols], max(1, self.tokens - own)).astype(float)
        self.start = self.place.get(END, self.rest)
        if self.start > self.rest:
            self.start = self.rest

    def places(self, words: list[bytes]) -> np.ndarray:
        get = self.place.get
        return np.fromiter((get(w, -1) for w in words), np.int32, len(words))

    def places_of(self, tokens: pa.Array) -> np.ndarray:
        return pc.index_in(tokens, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False)

    def symbols_of(self, places: np.ndarray) -> np.ndarray:
        return np.where((places < 0) | (places >= self.symbols), self.rest, places).astype(np.int32)


def vocabulary(counts: DataFrame, head: int, symbols: int) -> Vocabulary:
    """``counts`` is a stored table. At most ``head`` words are gathered: those with at least a count that the
    histogram of counts shows to be frequent enough; ties at the limit stay out."""
    steps = F.floor(F.log2("c") * 16)
    histogram = counts.groupBy(steps.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.sum("c").alias("tokens"), F.min("c").alias("least")).collect()
    least, taken = None, 0
    for row in sorted(histogram, key=lambda r: -r["step"]):
        taken += row["words"]
        if taken > head:
            break
        least = row["least"]
    frequent = counts.where(F.col("c") >= least).toArrow() if least is not None else pa.table({"token": pa.array([], pa.binary()), "c": pa.array([], pa.int64())})
    pairs = sorted(zip(frequent.column("token").to_pylist(), frequent.column("c").to_pylist(), strict=True), key=lambda p: (-p[1], p[0]))
    return Vocabulary(
        [w for w, _ in pairs],
        np.array([c for _, c in pairs], np.int64),
        min(symbols, len(pairs)),
        sum(row["tokens"] for row in histogram),
        sum(row["words"] for row in histogram),
    )


# ---------------------------------------------------------------- training


@dataclass
class LanguageModel:
    vocabulary: Vocabulary
    network: gru.Network
    counts: DataFrame  # token, c: the whole table

    def for_tasks(self, spark: SparkSession) -> Broadcast:
        return spark.sparkContext.broadcast((self.vocabulary, self.network))


def fit(
    spark: SparkSession,
    docs: DataFrame,
    head: int = 200_000,
    symbols: int = 4095,
    hidden: int = 16,
    share: float = 1,
    least_docs: int = 0,
    docs_per_shard: int = 2500,
    rounds: int = 2,
    rate: float = 0.3,
) -> LanguageModel:
    """Learn from ``docs`` (doc_id, text). All documents are counted.

    The network's weights are trained on all documents too, in shards of about ``docs_per_shard``: what training reads grows
    with the corpus, and each task's part and the weights that the driver takes are bounded by the parameters. A caller who
    asks for a ``share`` below 1 has that share plus ``least_docs`` of them, drawn by a hash of doc_id and text, so that
    copies of a text are drawn each for itself. A null text is empty; empty documents
    teach the END token. Without documents every text has the probability 1 of an unseen word.
    """
    ship_package(spark)
    folder = shared_folder(spark)
    counts = stored(token_counts(docs), f"{folder}/counts")
    words = vocabulary(counts, head, symbols)
    network = gru.Network.untrained(words.symbol_counts, hidden)

    n = docs.count()
    drawn = docs
    if n * share + least_docs < n:
        place = F.pmod(F.xxhash64("doc_id", "text", F.lit("language model")), F.lit(1 << 30)) / float(1 << 30)
        drawn = docs.where(place < (n * share + least_docs) / n)
    texts = drawn.select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    sample = stored(with_symbols(spark, texts, words), f"{folder}/sample")
    shards = max(1, math.ceil(sample.count() / docs_per_shard))
    for _ in range(rounds if n else 0):
        network = _averaged_round(spark, sample, shards, words, network, rate)
    return LanguageModel(words, network, counts)


def with_symbols(spark: SparkSession, texts: DataFrame, words: Vocabulary) -> DataFrame:
    """``texts`` (text binary) and ``symbols``: the numbers of their symbols, one after the other, little-endian."""
    shared, kind = spark.sparkContext.broadcast(words), _number(words)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n in runs(batch.column("text")):
                texts = batch.column("text").slice(first, n)
                places, sizes, _ = placed(texts, shared.value)
                numbers = shared.value.symbols_of(places).astype(kind)
                made = [x.tobytes() for x in np.split(numbers, np.cumsum(sizes)[:-1])]
                yield pa.RecordBatch.from_arrays([texts, pa.array(made, pa.binary())], ["text", "symbols"])

    return texts.mapInArrow(encode, "text binary, symbols binary")


def _number(words: Vocabulary) -> str:
    return "<u2" if words.rest < 1 << 16 else "<u4"


#: Weights of a network that are averaged together.
SLICE = 1024


def _averaged_round(spark: SparkSession, sample: DataFrame, shards: int, words: Vocabulary, network: gru.Network, rate: float) -> gru.Network:
    """Each shard trains from the same weights; the mean of what they reach, weighted by documents."""
    shared, kind, start = spark.sparkContext.broadcast(network), _number(words), words.start

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, history, n = shared.value.like(shared.value.flat()), None, 0
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                documents = [np.frombuffer(s, kind) for s in batch.column("symbols").slice(first, 500).to_pylist()]
                history = gru.train(own, documents, start, history, rate)
                n += len(documents)
        if n:
            blocks = np.split(own.flat().astype("<f4"), range(SLICE, len(own.flat()), SLICE))
            yield pa.RecordBatch.from_pydict({"place": pa.array(range(len(blocks)), pa.int32()), "n": pa.array([n] * len(blocks), pa.int64()), "weights": pa.array([b.tobytes() for b in blocks])})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        documents: dict[int, int] = {}
        for batch in batches:
            for place, n, weights in zip(*(batch.column(c).to_pylist() for c in ("place", "n", "weights")), strict=True):
                sums[place] = sums.get(place, 0.0) + np.frombuffer(weights, "<f4").astype(float) * n
                documents[place] = documents.get(place, 0) + n
        mean = [(sums[place] / documents[place]).astype("<f8").tobytes() for place in sums]
        yield pa.RecordBatch.from_pydict({"place": pa.array(sums, pa.int32()), "weights": pa.array(mean, pa.binary())})

    trained = sample.select("symbols").repartition(shards).mapInArrow(learn, "place int, n long, weights binary")
    mean = trained.repartition("place").mapInArrow(add, "place int, weights binary")  # all of a place's rows come to one task, as a stream
    table = stored(mean, f"{shared_folder(spark)}/weights").toArrow().sort_by("place")
    if not table.num_rows:
        return network
    return network.like(np.frombuffer(b"".join(table.column("weights").to_pylist()), "<f8"))


#: Bytes of texts whose symbols a task holds together.
TOGETHER = 1 << 24


def runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, how many) of runs of rows with about TOGETHER bytes of text each, a longer text alone or last."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        before = ends[first - 1] if first else 0
        to = min(len(texts), int(np.searchsorted(ends, before + TOGETHER)) + 1)
        yield first, to - first
        first = to


def placed(texts: pa.Array, words: Vocabulary) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
    """The places of all tokens of ``texts`` (-1: not among the frequent ones), the number of tokens of each text, and the tokens with -1."""
    places, sizes, rest = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64), []
    for tokens, of, n in token_blocks(texts):
        places.append(words.places_of(tokens))
        np.add.at(sizes, of, n)
        rest.append(tokens.filter(pa.array(places[-1] < 0)).cast(pa.binary()))
    return np.concatenate(places), sizes, rest


def encoded(text: bytes, words: Vocabulary) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """The symbols of a text, block by block, each with the words that are not among the frequent ones; END last."""
    for block in (*word_blocks(text.lower()), [END]):
        places = words.places(block)
        yield words.symbols_of(places), [block[i] for i in np.flatnonzero(places < 0)]


# ---------------------------------------------------------------- scoring

LN10 = math.log(10)


def score(spark: SparkSession, docs: DataFrame, model: LanguageModel, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` (text) with n_tokens, n_known, train_tokens, base_score and score.

    n_known counts tokens seen in training; base_score is the add-one unigram log10 probability, score the model's.
    A null text is empty: the END token alone. Whole texts are scored, whatever their length; repeated rows
    get equal rows. An empty table gives an empty result.
    """
    ship_package(spark)
    folder = shared_folder(spark)
    words = model.vocabulary
    shared = model.for_tasks(spark)
    fields = docs.select(*keep).schema.fields
    names = [f.name for f in fields]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, network = shared.value
        log_counts = np.append(vocabulary.log_counts, 0)  # that of -1 is the last
        for batch in batches:
            for first, n in runs(batch.column("__text")):
                here = batch.slice(first, n)
                places, sizes, rest = placed(here.column("__text"), vocabulary)
                symbols, starts = vocabulary.symbols_of(places), np.cumsum(sizes) - sizes
                logs, other = log_counts[places], symbols == vocabulary.rest
                likely = gru.document_scores(network, np.split(symbols, starts[1:]), vocabulary.start) / LN10
                unknown = np.add.reduceat(places < 0, starts, dtype=np.int64)
                made = {
                    "n": pa.array(sizes),
                    "known": pa.array(sizes - unknown),
                    "base": pa.array(np.add.reduceat(logs, starts)),
                    "others": pa.array(np.add.reduceat(np.where(other, logs, 0), starts)),
                    "n_rest": pa.array(np.add.reduceat(other, starts, dtype=np.int64)),
                    "likely": pa.array(likely),
                    "rest": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(unknown)), pa.int32()), pa.concat_arrays(rest)),
                }
                yield pa.RecordBatch.from_pydict({f"kept_{k}": here.column(k) for k in names} | made)

    schema = T.StructType([T.StructField(f"kept_{f.name}", f.dataType) for f in fields])
    for name, kind in (("n", T.LongType()), ("known", T.LongType()), ("base", T.DoubleType()), ("others", T.DoubleType()), ("n_rest", T.LongType()), ("likely", T.DoubleType()), ("rest", T.ArrayType(T.BinaryType()))):
        schema = schema.add(name, kind)
    measured = docs.select(*keep, F.col("text").cast("binary").alias("__text")).mapInArrow(measure, schema)
    measured = stored(measured.withColumn("uid", F.monotonically_increasing_id()), f"{folder}/measured")

    # The rare words: joined with the whole table of counts, then summed by document.
    rare = measured.select("uid", F.explode("rest").alias("token")).join(model.counts, "token", "left")
    sums = rare.groupBy("uid").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("rare"), F.count("c").alias("rare_known"))
    both = measured.drop("rest").join(sums, "uid", "left")
    rare_sum: Column = F.coalesce("rare", F.lit(0.0))
    return both.select(
        *(F.col(f"kept_{k}").alias(k) for k in names),
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + rare_sum - F.col("n") * math.log10(words.tokens + words.distinct + 1)).alias("base_score"),
        (F.col("likely") + F.col("others") + rare_sum - F.col("n_rest") * math.log10(words.rest_mass)).alias("score"),
    )

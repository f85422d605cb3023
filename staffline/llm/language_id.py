"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1- to 3-grams are gathered from labelled documents, the log-probability matrix
(buckets x languages, bounded) is broadcast, and texts are scored in batches: the n-grams of a batch are
one array of bucket numbers with a row pointer for each document (the unit-valued form of a sparse
matrix), multiplied with the matrix by a gather and a segmented sum.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staffline.llm.common import shared_folder, ship_package, stored

ORDERS = 3
BUCKET_BITS = 16
#: The matrix, and what the driver gathers for it, holds at most this many languages.
MAX_LANGUAGES = 100
UNDETERMINED = "und"
#: Rows of a batch whose texts are Python strings at the same time.
ROWS = 500
#: Characters scored together: small enough for the arrays made of them to stay in the processor's cache.
SLICE = 1 << 16
_NOT_LETTERS = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    log_prior: np.ndarray  # (languages,)
    log_prob: np.ndarray  # (buckets, languages), float32


def cleaned(text: str) -> str:
    """Lower case, each run of other signs than letters as one space, a space at either end."""
    return f" {_NOT_LETTERS.sub(' ', text.lower()).strip()} "


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def slices(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Groups of (index of the text, piece) of about SLICE characters. A piece of a longer text also
    holds the first characters of the next one, so that each n-gram begins in exactly one piece."""
    index: list[int] = []
    pieces: list[str] = []
    held = 0
    for i, text in enumerate(texts):
        clean = cleaned(text)
        for start in range(0, len(clean), SLICE):
            own = min(SLICE, len(clean) - start)
            piece = clean[start : start + own + ORDERS - 1].ljust(own + ORDERS - 1)
            index.append(i)
            pieces.append(piece)
            held += len(piece)
            if held >= SLICE:
                yield index, pieces
                index, pieces, held = [], [], 0
    if pieces:
        yield index, pieces


def bucket_rows(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets by order and first character, where each piece starts, which positions begin n-grams)."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(lengths)
    codes = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
    padded = np.concatenate([codes, np.full(ORDERS - 1, 32, np.uint32)])
    n = len(codes)
    buckets = np.empty((ORDERS, n), np.int32)
    mixed = np.zeros(n, np.uint32)
    for order in range(ORDERS):
        mixed = mixed * np.uint32(0x01000193) + padded[order : order + n] + np.uint32(order + 1)
        buckets[order] = (mixed * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)
    begins = np.ones(n, bool)
    for back in range(1, ORDERS):
        begins[ends - back] = False
    return buckets, ends - lengths, begins


def log_likelihoods(texts: list[str], model: LanguageModel) -> np.ndarray:
    """(texts, languages): log prior plus the log probabilities of all n-grams."""
    out = np.tile(model.log_prior, (len(texts), 1))
    for index, pieces in slices(texts):
        buckets, starts, begins = bucket_rows(pieces)
        gathered = sum(model.log_prob[row] for row in buckets)
        gathered[~begins] = 0
        np.add.at(out, index, np.add.reduceat(gathered, starts, axis=0, dtype=np.float64))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        by_language: dict[str, list[str]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            by_language.setdefault(lang, []).append(text)
        for lang, texts in by_language.items():
            total = counts.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
            for _, pieces in slices(texts):
                buckets, _, begins = bucket_rows(pieces)
                for row in buckets:
                    total += np.bincount(row[begins], minlength=len(total))
    for lang, total in counts.items():
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(found)), "bucket": found, "n": total[found]})


def fit(spark: SparkSession, labelled: DataFrame, docs_per_language: int = 8000, tasks: int = 16) -> LanguageModel:
    """Learn from ``labelled`` (doc_id, text, lang); rows without text or lang teach nothing.

    Of each language about ``docs_per_language`` documents are used (all, if there are fewer), chosen by a
    hash of the doc_id; the class priors count all rows. The sample, so its shuffle and what the ``tasks``
    tasks emit, is bounded by these parameters and ``MAX_LANGUAGES``; more languages raise ValueError.
    """
    ship_package(spark)
    usable = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    known = usable.groupBy("lang").count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(known) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    size = 1 << BUCKET_BITS
    if not known:
        return LanguageModel([], np.zeros(0), np.zeros((size, 0), np.float32))
    share = F.create_map([F.lit(x) for row in known for x in (row["lang"], min(1.0, docs_per_language / row["count"]))])
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    sample = usable.where(place < share[F.col("lang")]).repartition(tasks, "doc_id")
    grams = sample.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = stored(grams, f"{shared_folder(spark)}/grams").toArrow()

    languages = [row["lang"] for row in known]
    counts = np.zeros((size, len(languages)))
    column = {lang: i for i, lang in enumerate(languages)}
    which = np.array([column[x] for x in rows.column("lang").to_pylist()], np.int64)
    counts[rows.column("bucket").to_numpy(), which] = rows.column("n").to_numpy()
    log_prob = np.log((counts + 1) / (counts.sum(axis=0) + size))
    seen = np.array([row["count"] for row in known], float)
    return LanguageModel(languages, np.log(seen / seen.sum()), log_prob.astype(np.float32))


def predict_texts(texts: list[str | None], model: LanguageModel) -> tuple[list[str], np.ndarray]:
    names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    spoken = [i for i, text in enumerate(texts) if has_letter(text)] if model.languages else []
    if spoken:
        likely = log_likelihoods([texts[i] for i in spoken], model)
        best = likely.argmax(axis=1)
        scores[spoken] = 1 / np.exp(likely - likely.max(axis=1, keepdims=True)).sum(axis=1)
        for i, b in zip(spoken, best, strict=True):
            names[i] = model.languages[b]
    return names, scores


def identify(spark: SparkSession, docs: DataFrame, model: LanguageModel, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred and score (the winner's posterior probability).

    Only ``text`` is an input. A text that is null or has no letter, and every text under a model that
    learned nothing, is ``und`` with score 0. Of equally likely languages the alphabetically first wins.
    Whole texts count, however long. Rows are independent: repeated rows get equal results.
    """
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    fields = docs.select(*keep).schema.fields
    kept = [f.name for f in fields]
    source = "text" if "text" in kept else "__text"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                names, scores = predict_texts(part.column(source).to_pylist(), shared.value)
                columns = {k: part.column(k) for k in kept}
                yield pa.RecordBatch.from_pydict(columns | {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores)})

    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    read = keep if source == "text" else [*keep, F.col("text").alias("__text")]
    return docs.select(*read).mapInArrow(score, schema)


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32 of the doc_id as text leaves ``remainder``; a row without doc_id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(True))

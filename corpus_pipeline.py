"""From raw documents to packed training sequences, stage by stage.

Every stage reads what the stage before it kept, written as Parquet in the shared folder, and works on all of it. The
filtering stages return whole rows of ``documents`` with all their columns; the last returns the packing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staffline.llm.common import file_locator, shared_folder, small_side, stored, table
from staffline.llm.decontaminate import contained_items
from staffline.llm.exact_dedup import exact_dedup
from staffline.llm.language_id import fit, held_out, identify
from staffline.llm.packing import pack
from staffline.llm.simhash import near_duplicates

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def on_files(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` if its rows lie in files, else written to the shared folder: rows are told apart by their place."""
    try:
        docs.select(file_locator(docs))
    except AnalysisException:
        return stored(docs, f"{shared_folder(spark)}/documents")
    return docs


def without(spark: SparkSession, docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose locator is not in ``gone`` (locator), in all their columns."""
    gone = stored(gone.select("locator"), f"{shared_folder(spark)}/gone")
    rows = docs.select(F.struct("*").alias("row"), file_locator(docs).alias("locator"))
    return rows.join(small_side(gone), "locator", "left_anti").select("row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told: no letters, or no language at least as likely as all others
    together. The model learns from the stage's own labelled documents; where none has a label, only letters count."""
    model = fit(spark, docs.where(~held_out(4, 2)))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    others = F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("row")
    told = identify(spark, docs.select(others, "text"), model, ["row", "text"]).where("lang_pred != 'und' AND score >= 0.5")
    return told.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one document stays."""
    docs = on_files(spark, docs)
    return without(spark, docs, exact_dedup(spark, docs, file_locator(docs)).where("NOT kept"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (fingerprints of 3-word shingles, linked at 2 bits), one document stays."""
    docs = on_files(spark, docs)
    return without(spark, docs, near_duplicates(spark, docs, file_locator(docs)).where("NOT kept"))


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain an item of ``benchmark``."""
    docs = on_files(spark, docs)
    return without(spark, docs, contained_items(spark, docs, table(spark, sf_dir, "benchmark"), file_locator(docs)).select("locator").distinct())


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens."""
    return pack(spark, docs)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", language),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark_items),
    ("best-fit packing", packing),
]

#: SQL has neither XXH64 nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is a table in the shared folder that the next stage reads."""
    folder = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/stage-{number}")
    return docs

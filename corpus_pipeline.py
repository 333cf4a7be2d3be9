"""The corpus pipeline: quality, exact and near duplicates, mixing, tokens. Each stage is one operator of the llm subpackage, applied in full.

A row is known by the file and the place in it that it is read from, and a stage's decisions are joined back by it, so rows without doc_id, and
rows that share one, are decided each by itself. A null, empty or blank text is rejected by the first stage; the others treat it as their
operators say. Texts of any length are taken whole. A stage of an empty table gives an empty table; columns besides those of documents are not
passed on.

A stage's result is to be written before the next stage is called, as run() does: the next stage deletes what the one before it left behind."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm import bpe, exact_dedup, jaccard_join, kneser_ney, mixing
from turnloom.llm.line_dedup import ranked
from turnloom.llm.shared import drop, is_scan, recorded, release, shrink_executors, stored
from turnloom.session import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ROW = ["file", "at"]
BROADCAST_IDS = 2_000_000
#: No SQL: training a language model, components of a similarity join, Newton iterations and BPE are beyond it.
ORACLE_SQL = None
_left: list[str] = []  # scratch tables of the stage before


def _stage(f):
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles()
        for path in _left:
            if not any(path.split("://")[-1].split("/")[-1] in x for x in read):
                drop(spark, path)
        _left.clear()
        release(spark)
        shrink_executors(spark)
        with recorded() as made:
            out = f(spark, docs, sf_dir)
        _left.extend(made)
        return out

    return run_stage


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with file and at, which name the row; what is not read straight from files is stored first."""
    docs = docs.select(*COLUMNS)
    if not is_scan(docs):
        docs, _ = stored(docs, "stage-rows")
    return docs.withColumn("file", F.xxhash64("_metadata.file_path")).withColumn("at", F.col("_metadata.row_index"))


def _placed(docs: DataFrame) -> DataFrame:
    """file, at and place of each of docs: places count the rows in the order of doc_id, those without one last, so a place decides as a doc_id does."""
    place = ranked(docs.select(*ROW, F.col("doc_id").isNull().alias("none"), "doc_id"), "none", "doc_id", *ROW)
    return stored(place.select(*ROW, F.col("rank").cast("long").alias("place")), "stage-places")[0]


def _by_row(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    return docs.join(F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows, ROW, how)


def _under_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    return _by_row(docs, places, "inner").drop("doc_id").withColumnRenamed("place", "doc_id")


def _only(docs: DataFrame, places: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs whose places are kept."""
    rows, _ = stored(places.join(kept.select(F.col("doc_id").alias("place")), "place", "left_semi").select(*ROW), "stage-kept")
    return _by_row(docs, rows, "left_semi").select(*COLUMNS)


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    docs = _numbered(docs)
    judged = kneser_ney.quality(docs, table(spark, sf_dir, "labels"), carry=ROW)
    kept, _ = stored(judged.where("kept").select(*ROW), "stage-kept")
    return _by_row(docs, kept, "left_semi").select(*COLUMNS)


@_stage
def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    docs = _numbered(docs)
    places = _placed(docs)
    return _only(docs, places, exact_dedup.exact_dedup(_under_places(docs, places), locator=tuple(ROW)).where("kept"))


@_stage
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: the one with the smallest id."""
    docs = _numbered(docs)
    places = _placed(docs)
    return _only(docs, places, jaccard_join.jaccard_components(_under_places(docs, places)).where("doc_id = component_id"))


@_stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    docs = _numbered(docs)
    copies, _ = stored(mixing.mix(docs)[0].where("copies > 0").select(*ROW, "copies"), "stage-mix")
    both = _by_row(docs, copies, "inner")
    return both.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*COLUMNS)


@_stage
def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document of the mix its BPE ids' number and digests, encoded and decoded."""
    return bpe.bpe_round_trip(docs, bpe.tokenizer_path())


STAGES = [("quality classifier", quality_stage), ("exact dedup", exact_stage), ("n-gram jaccard join", near_stage), ("mixing sources", mixing_stage), ("bpe", token_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not token_stage:
            docs, path = stored(docs, "pipeline")
            if before:
                drop(spark, before)
            before = path
    return docs

"""Corpus pipeline: five stages, each a corpus operator whose decisions the next stage works on.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next stage's `docs`. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platterlake.llm import decontam, forest, mixing, quality, templates
from platterlake.llm.shared import fold, table, written


def _columns(docs: DataFrame, decided: DataFrame) -> DataFrame:
    return decided.select(*docs.columns)


def _packed(docs: DataFrame) -> DataFrame:
    """The id, the text and all other columns as one, whose names then clash with nothing."""
    return docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("row"))


def _unpacked(docs: DataFrame, decided: DataFrame, **changed: Column) -> DataFrame:
    return decided.select(*[changed[c].alias(c) if c in changed else F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; all their columns.

    Null and empty texts are scored like others; null, shared and repeated ids go by the row's own text. Without labels
    every score is 1/2, and all stay. Empty table: no rows.
    """
    use = fold(F.col("doc_id")) != 0
    model = quality.train(docs, table(spark, sf_dir, "labels"), use)
    scored = quality.score_quality(_packed(docs), model, keep=("row", "text"))
    return _unpacked(docs, scored.where(F.col("score") >= quality.THRESHOLD))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that recur; one goes whole only where lines were cut and no line that isn't blank is left.

    Null and empty texts stay as they are. Null and shared ids: a document is an id and a text; repeated rows are cut
    alike. Empty table: no rows.
    """
    left = templates.drop_recurring_lines(_packed(docs), keep=("row",))
    left = left.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"\S"))
    return _unpacked(docs, left, n_chars=F.length("text").cast("long"))


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of least id, then of least text hash; of equal rows one.

    Null ids come last and are joined like others. Texts without words all stay. Empty table: no rows.
    """
    return _columns(docs, forest.one_of_each(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark.

    A row goes for its own text: null ids go like others, and a clean row stays whatever rows share its id. Null and
    empty texts are clean. Repeated rows are decided alike. Empty tables: no rows, or all rows where the benchmark is.
    """
    hit = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).where(F.size("spans") > 0)
    hit = hit.select(F.col("doc_id").alias("_hit_id"), F.col("text_hash").alias("_hit_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_hit_id")) & (F.xxhash64("text") == F.col("_hit_hash"))
    return _columns(docs, docs.join(hit, same, "left_anti"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document.

    Null or empty text: size 0. Null source: a source of its own. Repeated rows: a result each. Empty table: no rows.
    """
    return mixing.mix_sources(docs)


STAGES = [
    ("quality classifier", classify_quality),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", join_near_copies),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
]

#: A trained classifier, a log-template tree and an LSH forest come first, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each returns is written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.llm import linededup, nearcopies, packing, pii, quality
from voxelith.llm.common import discard, hot_join, materialize

#: The SQL of run()'s rows: none, as neither fingerprints' bit sums, nor token ids are SQL's.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects.

    A null or empty text has too few words and goes.  Repeated rows are judged alike; an empty table
    stays empty; all columns stay as they are, whatever their names."""
    return quality.quality_rules(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines; n_chars follows the text.

    No row goes: a document of boilerplate alone has an empty text, a null text stays null.  A null
    source is a source.  Repeated rows count as pages each.  An empty table stays empty; columns of
    other names stay as they are."""
    return _counted(linededup.line_dedup(docs, "source", counts=False), docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest doc_id.

    Near copies are texts whose fingerprints of five-word shingles have a similarity of 0.8 or more,
    and what such links connect: the SimHash operator with 256 bits (op8's query has its own size and
    radius).  Rows go by doc_id and text: an id that two
    different texts share stands for two documents, of which each stays or goes by its own group;
    in one group the one with the smaller hash of its text stays.  Of rows of one id and text, the
    one whose columns are least stays.  A null id is greater than any other.  Texts without words
    (null, empty) are copies of each other.  An empty table stays empty; columns stay as they are.

    The ids that go are fewer than those that stay, so they are what the texts are held against, by a
    merge join at every size: they grow with the corpus, so they are never broadcast."""
    copies = materialize(nearcopies.near_copies(docs), "copies")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    groups = copies.groupBy("group").agg(F.min(row).alias("first"), F.count("*").alias("n")).where("n > 1")
    # Of each group's rows: those that go, and the one that stays if it is repeated.
    rows = hot_join(copies, groups, "group", "n", copies.count()).groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(
        F.count("*").alias("_n"), F.first(row == F.col("first")).alias("_stays")
    )
    gone = materialize(rows.where("not _stays or _n > 1").select("_id", "_key", "_stays"), "gone")
    # The row in one struct, so that its columns' names cannot clash.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    held = docs.select(row.alias("_row"), F.col("doc_id").alias("_doc"), nearcopies.text_key().alias("_k"))
    same = held["_doc"].eqNullSafe(gone["_id"]) & (held["_k"] == gone["_key"])
    rest = held.join(gone.hint("merge"), same, "left_anti").select("_row.*")
    repeated = held.join(gone.where("_stays"), same).groupBy("_id", "_key").agg(F.min("_row").alias("_row"))
    return rest.unionByName(repeated.select("_row.*"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with entities and disclosing terms masked; n_chars follows the text.

    A null text stays null; repeated rows are masked alike; an empty table stays empty; other columns
    stay as they are."""
    return _counted(pii.sanitise(docs), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of the documents' tokens in sequences of 4096.

    A null or empty text is its end token; repeated rows have places of their own; an empty table has
    none; other columns are ignored."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def _counted(out: DataFrame, docs: DataFrame) -> DataFrame:
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_stage),
    ("pii", pii_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        done = materialize(stage(spark, docs, sf_dir), name)
        discard(docs)  # what the stage before has written; the input is not
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}

"""A corpus pipeline of the operators in weft.llm: language ID, near-duplicates, repeated passages, packing."""

from __future__ import annotations

import uuid

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from weft.llm import lang_id, near_dedup, packing, substring_dedup
from weft.llm.common import bounded_batches, cut, redealt, shared_dir, table
from weft.operators.storage import deleted

#: Texts with less than this share of n-grams known in their language are in none of those learned.
LEAST_SCORE = 0.1
#: Texts of fewer n-grams are too short to tell that, and stay if they have letters.
LEAST_GRAMS = 20


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; texts without letters, null texts and texts of unknown languages go.

    A text is judged as unknown only if it has LEAST_GRAMS n-grams; shorter ones with letters stay.
    If no row is labelled there is nothing to tell languages by, and documents with letters stay.
    """
    bounded_batches(spark)
    model = lang_id.learn(docs)
    if not model.languages:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    clashes = {"score": "_score", "lang_pred": "_lang_pred", "n_grams": "_n_grams"}
    found = lang_id.predict(docs.withColumnsRenamed(clashes), model, n_grams=True)
    known = (F.col("score") >= LEAST_SCORE) | (F.col("n_grams") < LEAST_GRAMS)
    kept = found.where((F.col("lang_pred") != lang_id.UNDETERMINED) & known).drop(*clashes)
    return kept.withColumnsRenamed({v: k for k, v in clashes.items()}).select(*docs.columns)


def numbered(docs: DataFrame, row: str) -> DataFrame:
    """docs with a number for each row that stays the same whenever docs is read: by file and place in it, or else stored."""
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        return cut(docs.withColumn(row, F.monotonically_increasing_id()))
    path = docs.metadataColumn("_metadata")["file_path"]
    files = sorted(r[0] for r in docs.select(path).distinct().collect())
    known = docs.sparkSession.createDataFrame([(f, i) for i, f in enumerate(files)], "_file string, _file_no long")
    number = F.shiftleft("_file_no", 40) + docs.metadataColumn("_metadata")["row_index"]
    return docs.join(F.broadcast(known), path == F.col("_file")).select(*(docs[c] for c in docs.columns), number.alias(row))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, the one of the smallest doc_id (null is the largest).

    Rows are told apart by numbers of their own, so repeated rows and rows without an id are in groups
    like all others. Rows of one doc_id whose texts are no near-duplicates are not in one group.
    """
    bounded_batches(spark)
    row = "_row"
    while row in docs.columns:
        row = f"_{row}"
    rows = numbered(docs, row)
    copies = cut(near_dedup.near_duplicates(rows.select(row, "text"), row).where("NOT kept").select(F.col("doc_id").alias("_node"), "component_id"))
    members = copies.unionByName(copies.select(F.col("component_id").alias("_node"), "component_id").distinct())
    ranked = members.join(rows.select(F.col(row).alias("_node"), F.struct(F.col("doc_id").isNull(), "doc_id", row).alias("_rank")), "_node")
    best = ranked.groupBy("component_id").agg(F.min("_rank")[row].alias("_best"))
    found = members.join(redealt(best), "component_id").where("_node <> _best").select(F.col("_node").alias(row))
    return rows.join(found, row, "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of windows that start elsewhere too; texts without such words stay as they are.

    Null and empty texts stay; repeated rows repeat all their windows; an empty table stays empty; columns
    named as the operator's results are kept under their names.
    """
    bounded_batches(spark)
    clashes = {c: f"_{c}" for c in ("n_words", "n_removed", "kept_sha256", "kept_text") if c in docs.columns}
    found = substring_dedup.remove_repeats(docs.withColumnsRenamed(clashes), kept_text=True)
    columns = {"text": F.col("kept_text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return found.select(*[columns.get(c, F.col(clashes.get(c, c))).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; a null or empty text is one piece. Other columns go; an empty table gives none."""
    bounded_batches(spark)
    return packing.pack(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", packed)]

#: No SQL: language ID and packing are not expressible; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again.

    The last stage stores what its result needs, so the stages before it are deleted, also if one fails.
    Nulls, repeated rows, clashing columns and empty tables are as each stage has them.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    try:
        for name, stage in STAGES[:-1]:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        deleted(spark, folder)

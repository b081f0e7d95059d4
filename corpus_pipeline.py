"""The corpus pipeline: five stages, each written as Parquet and read again.

Each stage takes all that the one before it kept. The first four return the
columns of ``documents``; the last returns pieces packed into sequences.

Results for odd input, in all stages: an empty table gives an empty one; columns
besides those of ``documents`` are carried along under any name, by the last stage
not at all; texts of any length are taken whole; ids that aren't whole numbers end
in a cast error where a stage needs them. What a stage does with nulls, ties and
repeated rows stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import linededup, minhash, mixing, packing, quality
from riskloom.llm.base import table
from riskloom.llm.queries import MIX_WEIGHTS, domain_of_source, vocabulary
from riskloom.scratch import Scratch

#: The share of its input's tokens that the mix keeps; no document is taken twice.
MIX_SHARE = 0.9


def _quoted(docs: DataFrame) -> list[str]:
    return ["`" + c.replace("`", "``") + "`" for c in docs.columns]


def _with_text(docs: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """rows (_row: the columns besides the text) with a new text and its length, as docs has its columns."""
    new = {"text": F.col(text), "n_chars": F.length(F.coalesce(text, F.lit(""))).cast("long")}
    return rows.select(*(new[c].alias(c) if c in new else F.col(f"_row.{q}").alias(c) for c, q in zip(docs.columns, _quoted(docs), strict=True)))


def _row(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(*(c for c in _quoted(docs) if c not in ("`text`", "`n_chars`"))).alias("_row"), "text")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that failed.

    Null and empty texts have no words and go. Rows are judged one by one, so an id
    may be null or repeated, and equal rows stay or go together.
    """
    judged = quality.quality_rules(_row(docs), id_col="_row").withColumnRenamed("doc_id", "_row")
    return _with_text(docs, judged.filter("kept"), "clean_text")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of lines that stand earlier; those of which nothing is left go.

    Null and empty texts hold no run and stay, with 0 characters. Earlier is by id (null
    first) and then by the text's hash, so texts under one id are told apart; rows
    that agree in both are one document given twice and are treated alike.
    """
    left = linededup.dedup_lines(_row(docs), id_col="_row").filter("n_deleted = 0 or trim(text) <> ''")
    return _with_text(docs, left, "text")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class, by id (null first) and then by the text's hash, and all rows with a null text.

    Texts without words are one class. A document given twice stays once; different
    texts under one id, or none, are different documents.
    """
    return minhash.first_documents(docs).select(*_quoted(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of what is left, by the weights of the registered query.

    A null language or source is named ''. Null and empty texts have no tokens and
    come with the prefix they fall in. Rows of one id (null is one) have one place in
    the order and come or go together.
    """
    return mixing.mix(docs, domain_of_source(), MIX_WEIGHTS, budget_share=MIX_SHARE, max_epochs=1).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences.

    A null text is an empty one, of which the end's id is left. Every row is a document
    of its own, also if its id is null or repeated.
    """
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("line dedup", line_dedup_stage),
    ("near duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: Signatures, tokenizers and packing have no SQL form; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, scratch.put(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.free(before)
    return docs

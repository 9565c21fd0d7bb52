"""A corpus pipeline of five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows to the
shared folder and reads them again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogmill.llm.bpe import encode_digests
from dialogmill.llm.common import materialize, table
from dialogmill.llm.line_dedup import line_dedup
from dialogmill.llm.mixing import mix
from dialogmill.llm.shingles import SIMILAR
from dialogmill.llm.simhash import near_components
from dialogmill.llm.weak_label import classify


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed(docs: DataFrame, *own: str) -> DataFrame:
    """``own`` and the other columns as one, so that no name clashes with what an operator adds."""
    rest, filler = [F.col(quoted(c)) for c in docs.columns if c not in own], "_"
    while filler in docs.columns:
        filler += "_"
    return docs.select(*own, F.struct(*rest, F.lit(0).alias(filler)).alias("__rest"))


def unpacked(rows: DataFrame, names: list[str], own: dict[str, Column]) -> DataFrame:
    return rows.select(*[own[c].alias(c) if c in own else F.col(f"__rest.{quoted(c)}").alias(c) for c in names])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null, empty and blank texts score 0 and go; texts are scored whole; scores at the threshold stay; repeated rows stay or go
    together, also those without an id; an empty table stays empty; extra columns stay, whatever their names.
    """
    kept = classify(packed(docs, "doc_id", "text")).where("kept")
    return unpacked(kept, docs.columns, {"doc_id": F.col("doc_id"), "text": F.col("text")})


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines seen earlier go, and documents of which no line is left; n_chars follows the text.

    Documents without a line (null, empty and blank texts) stay as they are; lines are of any length; the order (doc_id, hash of the
    text, line number) has no ties; repeated rows keep the same lines; rows without an id come first; an empty table stays empty;
    extra columns stay, whatever their names.
    """
    out = line_dedup(packed(docs, "doc_id", "text")).where("n_kept > 0 OR n_lines = 0")
    return unpacked(out, docs.columns, {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")})


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the smallest (doc_id, hash of the text), rows without an id last.

    Links are those of op10_simhash and all pairs whose five-word shingles have a Jaccard similarity of SIMILAR or more. Where
    an id has several texts, only the smallest one of a component stays. Repeated rows are one document and stay or go together. Null,
    empty and blank texts are one component; texts are taken whole; an empty table stays empty; extra columns stay, whatever their names.
    """
    keep = near_components(docs.select("doc_id", "text"), similar=SIMILAR).where("keeper").select(F.col("doc_id").alias("__keep"), F.col("t").alias("__t")).distinct()
    kept = packed(docs, "doc_id", "text").join(keep, F.col("doc_id").eqNullSafe(F.col("__keep")) & (F.xxhash64("text") == F.col("__t")), "left_semi")
    return unpacked(kept, docs.columns, {"doc_id": F.col("doc_id"), "text": F.col("text")})


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, those of small sources up to twice.

    Documents without a source are a source of their own; texts without words pass once; repeated rows and ties of a place enter or
    stay out together; an empty table stays empty; extra columns stay, whatever their names.
    """
    out = mix(packed(docs, "doc_id", "text", "source"))
    return unpacked(out, docs.columns, {c: F.col(c) for c in ("doc_id", "text", "source")})


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (the tokens to train on) and the digests of ids and of the decoded text, for every row.

    Null and empty texts have no tokens; texts are encoded whole; repeated rows are encoded one by one; an empty table gives an
    empty result; other columns don't matter.
    """
    return encode_digests(docs, with_ids=True)


STAGES = [("quality classifier", quality_classifier), ("line dedup", dedup_lines), ("simhash near-dedup", near_dedup), ("mixing", mix_sources), ("bpe", encode_bpe)]

#: Models, components and a tokenizer have no SQL; tests/llm holds run() and each stage against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs

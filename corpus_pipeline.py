"""The corpus pipeline: five stages over documents, each on what the last kept.

Columns besides those of documents are carried through the filtering stages
as they are. Rows with a null text or doc_id pass every filter; an empty
table passes as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.decontam import leaks
from plumbline.llm.near_dedup import near_duplicates
from plumbline.llm.packing import best_fit
from plumbline.llm.shared import materialize, table
from plumbline.llm.suffix_dedup import remove_repeats
from plumbline.llm.toxicity import THRESHOLD, fit, with_scores

#: Bytes of a repeated passage that goes: 50 words of the shortest sort.
PASSAGE_BYTES = 200


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Texts are scored whole, whatever their length. A null or empty text has
    the score of no words; equal texts, and so repeated rows, share their fate.
    """
    score = next(name for name in (f"_toxic{i}" for i in range(len(docs.columns) + 1)) if name not in {c.lower() for c in docs.columns})
    scored = with_scores(docs, fit(docs, table(spark, sf_dir, "labels")), score)
    return scored.where(F.col(score) < THRESHOLD).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, similarity 0.8.

    The one of the smallest doc_id stays, with all its rows if it is repeated.
    Null, empty and blank texts, and rows without doc_id, all stay.
    """
    gone = near_duplicates(docs, size=5, percent=80).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur again anywhere are cut out of the texts.

    A character that a cut leaves incomplete goes too. A document stays even
    if nothing of it is left, as repeated rows of a text of PASSAGE_BYTES or
    more do; n_chars is that of the new text. A null text becomes empty.
    """
    rest = {f"_x{i}": c for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "n_chars")}
    plain = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(x) for x, c in rest.items()))
    left = remove_repeats(plain, length=PASSAGE_BYTES, carry=tuple(rest), as_text=True)
    made = {"doc_id": "doc_id", "text": "kept", **{c: x for x, c in rest.items()}}
    cut = left.withColumn("n_chars", F.length("kept").cast("long"))
    return cut.select(*(F.col(made.get(c, c)).alias(c) for c in docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, with all rows of their doc_id.

    Texts are searched whole. Rows without doc_id stay, as nothing names them;
    null and empty texts hold no item.
    """
    gone = leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences.

    Null and empty texts have no piece; repeated rows are told apart by copy.
    Longer texts than a sequence are cut into several pieces.
    """
    return best_fit(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

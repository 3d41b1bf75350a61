"""A corpus pipeline of five stages; each works on what its predecessor kept.

Language ID (rejected documents go), near-duplicates (the smallest id of each group stays), benchmark decontamination
(documents that hold an item go), personal data (spans are replaced by their kind; n_chars is that of the new
text), packing (the pieces of the sequences). All stages but the last return the columns of documents, whatever others there are
and whatever their names. An empty table gives an empty one in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanalytics.llm import common, decontaminate, langid, neardup, packing, pii
from spanalytics.llm.registry import tokenizer_files


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language one of the models accepts.

    Null, empty and letterless texts are rejected; so is all where no language was learned. Rows that repeat (an id, a text, or
    both) are judged each, by the text alone. Null ids, languages and other columns pass as they are; rows with a null
    language teach nothing.
    """
    model = langid.train(docs, common.fold(F.col("doc_id")) != 2)
    rejected = common.free(docs.columns, ["rejected"])[0]
    return langid.identify(docs, model, docs.columns).filter(~F.col(rejected)).select(*map(common.quoted, docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of copies, 5-word shingles at similarity 0.8 or more: that of the smallest id.

    Of rows that repeat this id one stays: of several texts the shortest, and of these the first in the order of the text
    (then of the other columns); a null text counts as the longest. Rows with a null id all stay, as do texts without words, which
    are alike to nothing.
    """
    judged = neardup.near_duplicates(docs, "doc_id").filter("doc_id is not null")
    per = judged.groupBy("doc_id").agg(F.count("*").alias("rows"), F.bool_or("kept").alias("kept"))
    # ids that go, or that have several rows: few beside all, so that the other texts need not be shuffled for them
    odd = common.materialize(per.filter("not kept or rows > 1"), "odd")
    cols = [common.quoted(c) for c in docs.columns]
    single = docs.join(odd.select("doc_id"), "doc_id", "left_anti").select(*cols)
    order = F.struct(F.col("text").isNull(), F.length("text"), "text", *(F.col(c).cast("string") for c in cols))
    several = docs.join(odd.filter("kept").select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*cols), order).alias("row"))
    return single.union(several.select(*(F.col("row")[c].alias(c) for c in docs.columns)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no benchmark item. Null, empty and wordless texts hold none and stay, and null, empty and
    wordless items are held by none; repeated rows are judged each, and repeated items count as one."""
    got = decontaminate.decontaminate(docs, common.read(spark, sf_dir, "benchmark"), docs.columns)
    return got.filter(F.size(common.free(docs.columns, ["hits"])[0]) == 0).select(*map(common.quoted, docs.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts, of every row alone. A null text stays null, and n_chars changes only where the
    text does."""
    got = pii.find_personal_data(docs, docs.columns)
    spans, text = common.free(docs.columns, ["spans", "redacted"])
    return got.withColumns({"text": F.col(text), "n_chars": F.when(F.size(spans) > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))}).select(*map(common.quoted, docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into sequences of 2048 tokens. A null or empty text is its end token alone; repeated rows and rows with
    a null id are packed each."""
    return packing.pack(docs, *tokenizer_files())


STAGES = [("language ID", language), ("near-duplicates", near_duplicates), ("decontamination", decontamination), ("personal data", personal_data), ("packing", pack)]

#: SQL can express neither the models nor the packing; tests/llm/test_corpus_operators.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each one's result written as Parquet in the shared folder and read again."""
    docs = common.read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.materialize(docs, name.replace(" ", "-"))
    return docs

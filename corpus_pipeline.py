"""A corpus pipeline of five stages, each (spark, docs, sf_dir) -> DataFrame on what its predecessor kept.

All stages read the columns of documents and no others, whatever a table has besides; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terncube.llm.jaccard import Measure, jaccard_components
from terncube.llm.langid import fit, fold, predict
from terncube.llm.lines import dedup_lines
from terncube.llm.mixing import first_words, mix
from terncube.llm.packing import pack_documents
from terncube.llm.runtime import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars following the text."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def identify(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (a null text, or one without a letter) go; the others carry the language found, which
    replaces the label, null or not. Rows are judged each on its own: repeated ones all stay."""
    model = fit(docs.where(fold() != 2))
    found = predict(docs.select(*COLUMNS), model)
    return _documents(found.where("lang_pred <> 'und'").withColumn("lang", F.col("lang_pred")))


def dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines alike the first stays, by document id (null last), text and line; blank lines stay. Documents left without a
    line that is not blank go, as do null and empty texts; of repeated rows the first keeps its lines and the others go."""
    out = dedup_lines(docs.select(*COLUMNS))
    return _documents(out.where(F.col("text").rlike(r"\S")))


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose sets of five-word shingles link at a similarity of 0.8 one row stays, that with the smallest id (a
    null id after all others; then the smaller digest of the text). Rows are told apart by id and text, so that two texts
    under one id are judged each; of rows alike in both one stays. Texts without a word link with nothing and stay."""
    found = jaccard_components(docs, Measure(5, 80, 100), sets=True)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    linked = found.where("link_set is not null").groupBy("link_set").agg(F.min(place).alias("p")).select("p.doc_id", "p.digest")
    alone = found.where("link_set is null").select("doc_id", "digest")
    stays = linked.unionByName(alone).distinct().select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"))
    digest = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    rows = docs.select(*COLUMNS).withColumn("__md5", digest)
    kept = rows.join(stays, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__md5") == F.col("__digest")), "left_semi")
    once = Window.partitionBy("doc_id", "__md5").orderBy("lang", "source")
    return _documents(kept.withColumn("__k", F.row_number().over(once)).where("__k = 1"))


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the one at a source's cut in part, up to the word of the cut. A document
    without words is taken as a whole or not at all; null sources are one source; repeated rows are taken each."""
    taken = mix(docs, keep=("text", "lang", "n_chars"))
    times = F.ceil(F.col("taken") / F.greatest("size", F.lit(1))).cast("int")
    copies = taken.where("taken > 0").withColumn("__i", F.explode(F.sequence(F.lit(1), times)))
    left = F.least("size", F.col("taken") - (F.col("__i") - 1) * F.col("size"))
    cut = copies.withColumn("__left", left)
    cut = cut.where("__left < size").withColumn("text", first_words("text", "__left")).unionByName(cut.where("__left >= size"))
    return _documents(cut)


def pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row for each piece; a null or empty text is the closing id alone, repeated rows are packed each."""
    return pack_documents(docs)


STAGES = [("language", identify), ("line dedup", dedup), ("near duplicates", near_duplicates), ("mix", mix_sources), ("pack", pack)]

#: Fitted models, shingle joins and tokenizers are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

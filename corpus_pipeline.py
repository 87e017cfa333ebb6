"""A training corpus from documents: toxicity, near-duplicates, benchmark contamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that its predecessor kept. All but the last
return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.llm import bpe, decontaminate, minhash, secret_scan, toxicity
from seqlake.llm.common import cut, table
from seqlake.llm.queries import RANKS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of all usable labels does not call toxic. The model learns from the documents table, not from what is left of it."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), usable=~toxicity.held_out(F.col("id")))
    scored = toxicity.score(docs.withColumn("__copy", docs["text"]), model, text_col="__copy", keep=tuple(COLUMNS))
    return scored.where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words to a shingle, similarity 0.8): that of the smallest id.

    Of rows with equal id and text (null counts as empty) one stays: a text before null, then the least lang, source and n_chars, null first."""
    found = minhash.near_duplicates(docs, width=5, percent=80)
    kept = found.where("kept").select("k1", "k2", "component_id").distinct()
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumns({"k1": F.xxhash64(F.col("doc_id").cast("string"), text), "k2": F.hash(text, F.col("doc_id").cast("string"))})
    return keyed.join(cut(kept, "pipeline-kept"), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.min_by(F.struct(*COLUMNS), F.struct(F.col("text").isNull(), "lang", "source", "n_chars")).alias("r")).select("r.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which windows of benchmark items cover less than a twentieth of the words."""
    found = decontaminate.scan(docs.withColumn("__copy", docs["text"]), table(spark, sf_dir, "benchmark"), text_col="__copy", keep=tuple(COLUMNS))
    return found.where("not contaminated").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; a null text stays null, n_chars follows the text."""
    out = secret_scan.scan(docs, F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))
    text = F.when(F.col("text").isNotNull(), F.col("_scan.redacted"))
    return out.select("doc_id", text.alias("text"), "lang", "source", F.when(text.isNotNull(), F.char_length(text).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and the digests of the ids and of the bytes they decode to."""
    return bpe.round_trip(docs, RANKS).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("tokens", tokenize),
]

#: SQL can express neither the model nor the merges; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}

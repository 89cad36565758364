"""A corpus pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents``. Toxic documents go; boilerplate lines go from their sites'
texts; one document of each group of near copies stays; documents that contain benchmark
windows go; what is left is packed into sequences. Clean documents stay throughout.

Cases: null, empty and wordless texts are copies of each other, of which one stays; rows
without an id are documents like others; rows that share an id but not a text are different
documents; equal rows count as one from near copies on; an empty table stays empty; other
columns go along, names that begin with ``_tw_`` excepted; without ``n_chars`` none is made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import decontaminate, linededup, ngramjoin, packing, toxicity
from tidewater.llm.common import checkpoint, table, tokenizer_path

BROADCAST_BYTES = 32_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold."""
    tagger = toxicity.train(toxicity.training(docs), toxicity.training(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, tagger, where=toxicity.THRESHOLD).select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that their sites repeat; copies of a text are one page of its site."""
    out = linededup.drop_boilerplate(docs)
    if "n_chars" not in docs.columns:
        return out.select(docs.columns)
    chars = F.when(F.col("_tw_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", chars).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one with the least id (null last) and key; ids that stand for several texts are told apart by the texts."""
    key = [ngramjoin.row_key("doc_id", "text", half) for half in (0, 1)]
    keyed = docs.withColumns({"_tw_a": key[0], "_tw_b": key[1]})
    found = checkpoint(ngramjoin.join(keyed, keep=["_tw_a", "_tw_b"]))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_tw_a", "_tw_b")
    first = found.groupBy("class_key").agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    mates = checkpoint(found.join(first, "class_key").select("_tw_a", "_tw_b", (order != F.col("_first")).alias("gone")).groupBy("_tw_a", "_tw_b", "gone").agg(F.count(F.lit(1)).alias("rows")))

    def part(keys: DataFrame, rows: DataFrame, how: str) -> DataFrame:
        small = keys.count() * 16 <= BROADCAST_BYTES  # two numbers a key
        return rows.join(F.broadcast(keys) if small else keys, ["_tw_a", "_tw_b"], how)

    kept = part(mates.where("gone").select("_tw_a", "_tw_b"), keyed, "left_anti")
    repeated = mates.where("not gone and rows > 1").select("_tw_a", "_tw_b")  # equal rows, of which one stays
    if repeated.isEmpty():
        return kept.select(docs.columns)
    once = part(repeated, kept, "left_semi").dropDuplicates(["_tw_a", "_tw_b"])
    return part(repeated, kept, "left_anti").unionByName(once).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("_tw_spans") == 0).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets."""
    return packing.pack_pieces(packing.pieces(docs, tokenizer_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("swap_packing", pack),
]
#: SQL can't express the tagger, the tokenizer or the packing; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs

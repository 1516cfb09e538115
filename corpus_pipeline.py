"""From documents to token ids: language, exact and near copies, source weights, pieces.

Every stage takes the documents that the one before kept and returns those it keeps; the last returns their
token ids. STAGES are run one by one, each on the Parquet that the one before wrote, or all by run().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import exact, langid, minhash, mixing, pieces
from barloom.llm.queries import piece_model
from barloom.session import ship
from barloom.staging import stage

#: A document goes if its language cannot be told: no letter, or a posterior below this and below LEAST_LIFT times an even share.
LEAST_SCORE, LEAST_LIFT = 0.3, 1.2
#: So many rows of decisions are broadcast to the documents; more are joined.
BROADCAST_ROWS = 500_000

#: Language identification, MinHash and SentencePiece have no SQL form.
ORACLE_SQL = None


def _free(docs: DataFrame, name: str) -> str:
    """A name that no column of docs has, however its letters are cased."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column that tells rows apart, and its name: the doc_id, or a row number if ids are null or repeated."""
    row = _free(docs, "row")
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id is null or n > 1").isEmpty():
        return docs.withColumn(row, F.col("doc_id").cast("long")), row
    return stage(docs.withColumn(row, F.monotonically_increasing_id()), "keyed"), row


def _decided(docs: DataFrame, decisions: DataFrame, row: str, how: str) -> DataFrame:
    """docs joined on row with a narrow table, broadcast if it is small."""
    decisions = stage(decisions, "decisions")
    return docs.join(F.broadcast(decisions) if decisions.count() <= BROADCAST_ROWS else decisions, row, how)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told. Null, empty and letterless texts go; nothing else changes.

    Where no document has a language, nothing is learnt and all texts with a letter stay. Each row is judged by
    its text alone: null and repeated ids, and repeated rows, are kept or go like any. Columns of any other
    names are returned as they are; an empty table gives none.
    """
    ship(spark)
    added = ("held_out", "lang_pred", "lang_score")
    clashing = {c: _free(docs, f"own_{c.lower()}") for c in docs.columns if c.lower() in added}
    flagged, model = langid.learn(docs.withColumnsRenamed(clashing))
    if model.langs:
        told = langid.predict(flagged, model)
        told = told.where((F.col("lang_pred") != langid.NONE) & (F.col("lang_score") >= min(LEAST_SCORE, LEAST_LIFT / len(model.langs))))
    else:
        told = flagged.where(F.col("text").rlike(r"\p{L}"))
    return told.select(*[F.col(clashing.get(c, c)).alias(c) for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (white space aside): the longest, then the smallest id.

    Where ids are null or repeated, rows are told apart by their place instead, so that one row of a group stays
    all the same. All null, empty and blank texts are one group. An empty table gives none.
    """
    keyed, row = _keyed(docs)
    found = exact.dedup_exact(keyed.select(F.col(row).alias("doc_id"), "text"))
    return _decided(keyed, found.where("not kept").select(F.col("doc_id").alias(row)), row, "left_anti").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates (five words, similarity 0.8): the smallest id.

    Where ids are null or repeated, rows are told apart by their place instead. Texts without words are like
    nothing and stay. An empty table gives none.
    """
    ship(spark)
    keyed, row = _keyed(docs)
    found = minhash.near_duplicates(keyed.select(F.col(row).alias("doc_id"), "text"))
    return _decided(keyed, found.where("not kept").select(F.col("doc_id").alias(row)), row, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target weight takes it, copies as rows of their own.

    A null source is a source; null and empty texts have no words and are taken at their source's rate. Where
    ids are null or repeated, each row is a document. An empty table gives none.
    """
    keyed, row = _keyed(docs)
    copies = _free(keyed, "copies")
    mixed = mixing.mix(keyed.select(F.col(row).alias("doc_id"), "text", "source"))
    taken = mixed.where("copies > 0").select(F.col("doc_id").alias(row), F.col("copies").cast("int").alias(copies))
    return _decided(keyed, taken, row, "inner").withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, the text's token ids, their number, and hashes of the ids and of the decoded text.

    One row for each row of docs, with its doc_id, source and lang as they are, null and repeated ones too; null
    and empty texts have no ids. Other columns are left out. An empty table gives none.
    """
    ship(spark)
    encoded = pieces.encode(docs.select("doc_id", "source", "lang", "text"), piece_model())
    return pieces.digest(encoded.withColumn("token_ids", F.col("piece_ids"))).drop("text")


STAGES = [("language_id", identify_language), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("sentencepiece", encode_pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each staged in the shared folder for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs

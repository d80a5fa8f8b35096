"""The operators bound to the tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, common, decontaminate, hard_negatives, jaccard_join, langid, licenses, maxent_lm, mixing, oracles, token_files, toxicity, vector_codes, vectors, warc

#: Folder of the public tokenizer files; a parameter of the queries, never copied.
TOKENIZERS = "/opt/tokenizers"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the tokenizer file is: by the package that brings them, else in TOKENIZERS."""
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return f"{TOKENIZERS}/{name}"
    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents: sources weigh 1, 2, 3, ..., at most 3 copies."""
    m = mixing.mix(_table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "inclusion")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in benchmark windows."""
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def license_files(docs: DataFrame) -> DataFrame:
    """Documents as a source tree: source/lang/hundred/name; every 20th is a licence file, every 200th one level up."""
    hundred = F.floor(F.col("doc_id") / 100).cast("string")
    base = F.concat_ws("/", F.coalesce("source", F.lit("nosource")), F.coalesce("lang", F.lit("nolang")))
    i = F.col("doc_id").cast("string")
    path = F.when(F.col("doc_id") % 200 == 0, F.concat(base, F.lit("/LICENSE-"), i)).when(F.col("doc_id") % 20 == 0, F.concat(base, F.lit("/"), hundred, F.lit("/LICENSE-"), i)).otherwise(F.concat(base, F.lit("/"), hundred, F.lit("/"), i, F.lit(".txt")))
    return docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), "text")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents, their own or inherited."""
    found = licenses.scan(license_files(_table(spark, sf_dir, "documents")))
    return found.withColumnRenamed("file_id", "doc_id")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets overlap to 90 %."""
    return jaccard_join.join(_table(spark, sf_dir, "documents"), 3, 90).select("doc_id", "n_shingles", "component_id")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All maximal conversations, rendered."""
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op6_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every 20th, by largest inner product."""
    rows = vectors.usable(_table(spark, sf_dir, "embeddings"))
    return vectors.search(rows, rows.where("id % 20 = 0"), k=20)


def op7_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document under the maximum-entropy model."""
    return maxent_lm.score(_table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write token-id shards of all documents and read every document back through the index."""
    folder = common.shared_dir(spark)
    docs = _table(spark, sf_dir, "documents")
    manifest = token_files.write(docs, folder, tokenizer_path())
    return token_files.read(spark, folder, manifest, docs.select("doc_id"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, merge the capture index, and read every record back."""
    _, captures = warc.archive(spark, _table(spark, sf_dir, "pages"), common.shared_dir(spark))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by class-conditional Kneser-Ney models."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors: 16 codebooks of 64 entries, two rounds of exponion search."""
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 100th vector; labels of every 7th are moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding"), 100)


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by character models."""
    docs = _table(spark, sf_dir, "documents")
    told = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return told.select("doc_id", toxicity.held_out().alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_decontamination": op2_decontamination,
    "op3_license_scan": op3_license_scan,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_chat_format": op5_chat_format,
    "op6_permutation_index": op6_permutation_index,
    "op7_maxent_lm": op7_maxent_lm,
    "op8_token_files": op8_token_files,
    "op9_warc": op9_warc,
    "op10_toxicity": op10_toxicity,
    "op11_vector_codes": op11_vector_codes,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_language_id": op13_language_id,
}

ORACLES = oracles.ORACLES

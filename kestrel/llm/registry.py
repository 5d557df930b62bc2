"""One query per operator, with production parameters over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import crc_remainder, read_table
from kestrel.llm.oracles import WARC_SQL, centroids_sql, vector_codes_sql


def vocabulary() -> str:
    """Place of the public vocabulary that the token queries use."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def held_out(modulus: int):
    """Whether crc32 of the id as text leaves remainder 2; false for a null id."""
    return F.coalesce(crc_remainder("doc_id", modulus) == 2, F.lit(False))


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by the tree model."""
    from kestrel.llm.html_text import extract_main_text
    texts = extract_main_text(read_table(spark, sf_dir, "pages"))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by the span tagger, learnt outside the held-out quarter."""
    from kestrel.llm.toxicity import score_toxicity
    scored = score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), ~held_out(4))
    return scored.select("doc_id", held_out(4).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed along the Hilbert curve into sequences of 4096 ids."""
    from kestrel.llm.packing import pack_documents
    return pack_documents(read_table(spark, sf_dir, "documents"), vocabulary(), end_id=2, length=4096, emit="crc32")


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on 2-word shingles at 0.8."""
    from kestrel.llm.near_dup import near_duplicates
    return near_duplicates(read_table(spark, sf_dir, "documents"), width=2, percent=80)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt outside the held-out quarter."""
    from kestrel.llm.language import identify_language
    found = identify_language(read_table(spark, sf_dir, "documents"), ~held_out(4))
    return found.select("doc_id", held_out(4).alias("held_out"), "lang_pred", "score")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and their decoded text, as digests."""
    from kestrel.llm.bpe import round_trip_digests
    return round_trip_digests(read_table(spark, sf_dir, "documents"), vocabulary())


def op7_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact top 10 of every hundredth embedding by the threshold algorithm."""
    from kestrel.llm.threshold_search import exact_top_k
    return exact_top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document written to Huffman-coded files and read back."""
    from kestrel.llm.token_files import write_and_read
    return write_and_read(read_table(spark, sf_dir, "documents"), vocabulary(), end_id=1, emit="crc32")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document by the maximum-entropy model, learnt outside the held-out seventh."""
    from kestrel.llm.lm import score_documents
    return score_documents(read_table(spark, sf_dir, "documents"), held_out(7))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate top 20 of every twentieth embedding by collision counting."""
    from kestrel.llm.ann import nearest
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every embedding from codebooks of 8 parts, nearest entries by memoised grid cells."""
    from kestrel.llm.vector_codes import compressed_with_errors
    found = compressed_with_errors(read_table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of every embedding of 64 components around 16 centroids, by a pivot table."""
    from kestrel.llm.centroids import clustered_with_inertia
    found = clustered_with_inertia(read_table(spark, sf_dir, "embeddings"), dims=64, centroids=16, rounds=3, scale=64, seed=1)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back, with every record checked."""
    from kestrel.llm.warc import archive_round_trip
    found = archive_round_trip(read_table(spark, sf_dir, "pages"))
    sound = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat("archive", F.lit(": "), "problem"))).otherwise(F.col("record_type"))
    return found.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", sound.alias("record_type"), F.col("refers_to_id").alias("refers_to"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over documents."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_html_text, op2_toxicity, op3_packing, op4_near_dup, op5_language, op6_bpe, op7_threshold, op8_token_files, op9_lm_score, op10_ann,
                                 op11_vector_codes, op12_centroids, op13_warc, pipeline)}
ORACLE_SQL: dict[str, str] = {"op11_vector_codes": vector_codes_sql(), "op12_centroids": centroids_sql(), "op13_warc": WARC_SQL}

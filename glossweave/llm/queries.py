"""The registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from glossweave.llm import bytecnn, density, hyperminhash, langmix, merkle, mixing, phrases, pq, suffixes, tokens, urls, warc, wordcnn
from glossweave.llm.learning import id_remainder
from glossweave.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: DuckDB SQL for the same rows, where SQL can express them.
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


@query(mixing.SQL)
def op7_mix_sources(spark: SparkSession, root: str) -> DataFrame:
    """Sources weighing 1, 2, 3, repeating, share all words; at most three times a source's or document's size."""
    return mixing.mix(table(spark, root, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query()
def op10_token_counts(spark: SparkSession, root: str) -> DataFrame:
    """Tokens of every text by the byte-level BPE of 50k entries."""
    import public_tokenizers

    return tokens.count_tokens(table(spark, root, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query(warc.SQL)
def op3_warc_round_trip(spark: SparkSession, root: str) -> DataFrame:
    """A WARC record for every page, written to archives and read back by the salvage reader."""
    found = warc.round_trip(spark, table(spark, root, "pages")).filter("problem IS NULL")
    return found.select(
        F.col("page_id").cast("long"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long"))


@query(urls.SQL)
def op2_url_filter(spark: SparkSession, root: str) -> DataFrame:
    """Verdicts on all page URLs by the five listed entries; what none fits is allowed."""
    listed = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    return urls.judge_urls(table(spark, root, "pages"), listed).select("page_id", "host", "path", "rule", "verdict")


@query()
def op6_main_text(spark: SparkSession, root: str) -> DataFrame:
    """The main text of every page."""
    return density.extract_text(table(spark, root, "pages"))


@query(suffixes.SQL)
def op1_decontamination(spark: SparkSession, root: str) -> DataFrame:
    """Words of every document inside occurrences of 13-word windows of the benchmark items."""
    found = suffixes.find_matches(table(spark, root, "documents"), table(spark, root, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated", "longest")


@query()
def op9_quality(spark: SparkSession, root: str) -> DataFrame:
    """Quality of every text; a fifth of the ids is held out from fitting."""
    docs, held_out = table(spark, root, "documents"), id_remainder(F.col("doc_id"), 5) == 0
    model = bytecnn.fit_quality(docs, table(spark, root, "labels"), ~held_out, threshold=0.3)
    return bytecnn.score(docs, model, threshold=0.3).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query()
def op4_toxicity(spark: SparkSession, root: str) -> DataFrame:
    """Toxicity of every text; a third of the ids is held out from fitting. flagged: by the threshold of the language."""
    docs, held_out = table(spark, root, "documents"), id_remainder(F.col("doc_id"), 3) == 1
    model = wordcnn.fit_toxicity(docs, table(spark, root, "labels"), ~held_out, threshold=0.7)
    found = wordcnn.score(docs, model, keep=("doc_id", "lang"), language="lang")
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted", "flagged")


@query(hyperminhash.SQL_PAIRS)
def op5_near_duplicates(spark: SparkSession, root: str) -> DataFrame:
    """Groups of documents with a Jaccard similarity of 0.85 or more on three-word shingles."""
    found = hyperminhash.near_duplicates(table(spark, root, "documents"), width=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query(pq.SQL)
def op8_near_vectors(spark: SparkSession, root: str) -> DataFrame:
    """Vectors of one label with a cosine of 0.93 or more."""
    return pq.near_vectors(table(spark, root, "embeddings"), cosine=0.93)


@query()
def op11_language_mixture(spark: SparkSession, root: str) -> DataFrame:
    """Language of every text by its mixture of languages; a third of the ids is held out from learning."""
    docs, held_out = table(spark, root, "documents"), id_remainder(F.col("doc_id"), 3) == 1
    found = langmix.predict(docs, langmix.fit(docs, ~held_out))
    shares = F.array_join(F.transform("languages", lambda x: F.concat(x["lang"], F.lit(" "), F.round(x["share"], 3).cast("string"))), ", ")
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", shares.alias("languages"))


@query(merkle.SQL)
def op12_merkle_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Leaf, roots and verified proof of every document; where 5 divides the crc32 of the id, of a tampered text."""
    return merkle.prove_documents(table(spark, root, "documents"))


@query(phrases.SQL)
def op13_phrases(spark: SparkSession, root: str) -> DataFrame:
    """Each language's first 2000 collocations of two or three words that occur ten times or more."""
    return phrases.collocations(table(spark, root, "documents"), most=3, least=10, share=50, top=2000)

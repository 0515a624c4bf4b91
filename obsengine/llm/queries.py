"""One query for each operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, html, mixing, neighbours, oracle, packing, phrases, simhash, sketch, subwords, tokens, toxicity, warc
from .common import shared_dir, table

CAPACITY = 4096
#: Sources stand in three domains by their number; weights of nodes that aren't named are 1.
DOMAINS = ("web", "books", "forums")
WEIGHTS = {("web",): 5.0, ("books",): 3.0, ("forums",): 2.0, **{(d, "en"): 4.0 for d in DOMAINS}, **{(d, "de"): 2.0 for d in DOMAINS}}


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def levels() -> dict:
    number = F.coalesce(F.try_to_number(F.regexp_extract("source", r"(\d+)", 1), F.lit("999999999")).cast("int"), F.lit(0))
    domain = F.element_at(F.array(*map(F.lit, DOMAINS)), F.pmod(number, F.lit(len(DOMAINS))) + 1)
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), CAPACITY)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"), html.fitted())


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{shared_dir(spark)}/warc-{uuid.uuid4()}"
    warc.write(warc.with_revisits(table(spark, sf_dir, "pages")), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.edited_likeness(table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = F.lit("\\### Assistant: </turn> ok")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), tricky.alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_back(chat.windows(rows))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    drawn = mixing.mix(docs, levels(), WEIGHTS, share=1.0, epochs=3, epoch_to="epoch")
    return drawn.select("doc_id", "lang", "source", F.col("epoch").cast("long").alias("epoch"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = subwords.encode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), packed=True, decoded=True)
    n = (F.octet_length("ids") / 4).cast("long")
    return found.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), F.crc32(F.concat("starts", "ends")).alias("ranges_crc32"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_simhash, op2_packing, op3_token_counts, op4_html_text, op5_toxicity, op6_warc, op7_sketch, op8_chat, op9_mixing, op10_neighbours, op11_alignment, op12_sentencepiece, op13_collocations)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op8_chat": oracle.chat_sql(), "op9_mixing": oracle.mixing_sql(DOMAINS, WEIGHTS, 3, 42), "op13_collocations": oracle.collocations_sql(100, 2000)}

"""Queries over the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import decontaminate, embeddings, langid, licences, mixing, simhash, sql, substring, suffixdedup, tokens, urlfilter
from .common import materialize, own_path, table


def op1_substring(spark, sf_dir) -> DataFrame:
    out = substring.remove_repeated_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_decontaminate(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op3_token_counts(spark, sf_dir) -> DataFrame:
    """Estimates first (a quarter of the characters), revised to counts of the whole text, documents without a token deleted;
    the second batch comes twice and counts once."""
    docs = table(spark, sf_dir, "documents").select("source", "lang", "text")
    counted = tokens.count_tokens(docs.withColumn("old_tokens", F.ceil(F.coalesce(F.length("text"), F.lit(0)) / 4).cast("long")))
    counted = materialize(counted, "tokens")
    roll = tokens.TokenRollup(spark, own_path(spark, "rollup"))
    roll.commit("1-estimates", tokens.inserts(counted.withColumn("tokens", F.col("old_tokens"))))
    roll.commit("2-counts", tokens.revisions(counted))
    roll.commit("3-empty", tokens.deletes(counted.where("tokens = 0")))
    roll.commit("2-counts", tokens.revisions(counted))
    return roll.totals()


def op4_simhash(spark, sf_dir) -> DataFrame:
    return simhash.simhash(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fingerprint", "component_id")


def op5_language(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(langid.training_rows(docs))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op6_embeddings(spark, sf_dir) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_mixing(spark, sf_dir) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op8_licences(spark, sf_dir) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_urls(spark, sf_dir) -> DataFrame:
    """An assumption: labels.doc_id is taken as the page_id of the page that a document came from; bad: toxic or of low quality. The
    operator itself takes any table of outcomes (id, bad)."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0).alias("bad"))
    return urlfilter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), labels).select("page_id", "host", "path", "rule", "verdict")


def op10_suffix_array(spark, sf_dir) -> DataFrame:
    out = suffixdedup.remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def pipeline(spark, sf_dir) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "pipeline": pipeline,
        "op1_substring": op1_substring, "op10_suffix_array": op10_suffix_array,
        "op2_decontaminate": op2_decontaminate, "op3_token_counts": op3_token_counts, "op4_simhash": op4_simhash, "op5_language": op5_language,
        "op6_embeddings": op6_embeddings, "op7_mixing": op7_mixing, "op8_licences": op8_licences, "op9_urls": op9_urls,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_substring": sql.OP1_SUBSTRING, "op2_decontaminate": sql.OP2_DECONTAMINATE, "op4_simhash": sql.op4_simhash(), "op6_embeddings": sql.OP6_EMBEDDINGS, "op7_mixing": sql.op7_mixing(), "op8_licences": sql.op8_licences(), "op9_urls": sql.op9_urls(), "op10_suffix_array": sql.OP10_SUFFIX_ARRAY}

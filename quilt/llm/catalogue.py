"""The registered queries of the corpus operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from quilt.llm import common, decontam, html_crf, line_dedup, mixing, quality, secret_scan, simhash, token_count, tokenfile, url_rank


def tokenizer_path() -> str:
    """The byte-level vocabulary of the contracts; a file of the tokenizer package, never copied."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_html_text(spark, sf_dir):
    return html_crf.main_text(common.table(spark, sf_dir, "pages"))


def op2_simhash(spark, sf_dir):
    return simhash.near_duplicates(common.table(spark, sf_dir, "documents"))


def op3_token_file(spark, sf_dir):
    path = common.new_path(spark, "tokens")
    schema = tokenfile.write(common.table(spark, sf_dir, "documents"), path, tokenizer_path())
    return tokenfile.digests(spark, path, schema)


def op4_source_mix(spark, sf_dir):
    return mixing.mix(common.table(spark, sf_dir, "documents"))


def op5_quality_rules(spark, sf_dir):
    return quality.quality(common.table(spark, sf_dir, "documents"))


def op6_secret_scan(spark, sf_dir):
    return secret_scan.secrets(common.table(spark, sf_dir, "documents"))


def op7_line_dedup(spark, sf_dir):
    found = line_dedup.dedup_lines(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_deleted", F.md5("text").alias("text_md5"))


def op8_decontaminate(spark, sf_dir):
    found = decontam.search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    ids = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), (F.size("items") >= decontam.MIN_ITEMS).alias("contaminated"),
    )


def op9_token_counts(spark, sf_dir):
    return token_count.token_counts(common.table(spark, sf_dir, "documents"), tokenizer_path())


def op10_url_rank(spark, sf_dir):
    return url_rank.judge_urls(common.table(spark, sf_dir, "pages"))


def queries():
    return {f.__name__: f for f in (op1_html_text, op2_simhash, op3_token_file, op4_source_mix, op5_quality_rules, op6_secret_scan, op7_line_dedup, op8_decontaminate, op9_token_counts, op10_url_rank)}


def oracle_sql():
    return {
        "op4_source_mix": mixing.ORACLE,
        "op5_quality_rules": quality.ORACLE,
        "op7_line_dedup": line_dedup.ORACLE,
        "op8_decontaminate": decontam.ORACLE,
        "op10_url_rank": url_rank.ORACLE,
    }

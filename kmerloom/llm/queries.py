"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import bpe, common, langid, minhash, mixing, quality_classifier, quality_rules, suffix_dedup, token_counts, topk, toxicity


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_near_duplicates(spark, sf_dir):
    return minhash.near_duplicates(common.documents(spark, sf_dir))


def op2_top_k(spark, sf_dir):
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_toxicity(spark, sf_dir):
    return toxicity.toxicity(common.documents(spark, sf_dir), labels(spark, sf_dir))


def op4_mix_sources(spark, sf_dir):
    return mixing.mix_report(common.documents(spark, sf_dir))


def op5_quality_rules(spark, sf_dir):
    return quality_rules.quality_report(common.documents(spark, sf_dir), labels(spark, sf_dir))


def op6_token_counts(spark, sf_dir):
    return token_counts.token_counts(common.documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op7_language_id(spark, sf_dir):
    return langid.language_report(common.documents(spark, sf_dir))


def op8_bpe_round_trip(spark, sf_dir):
    return bpe.encode_digests(common.documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op9_repeated_strings(spark, sf_dir):
    return suffix_dedup.repeat_report(common.documents(spark, sf_dir))


def op10_quality_classifier(spark, sf_dir):
    return quality_classifier.classify(common.documents(spark, sf_dir), labels(spark, sf_dir))


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql():
    return {"op1_near_duplicates": minhash.NEAR_SQL, "op2_top_k": topk.TOP_SQL, "op4_mix_sources": mixing.MIX_SQL}

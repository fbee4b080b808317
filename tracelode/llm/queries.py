"""The queries of this subpackage: one per operator, over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelode.llm.common import documents


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelode.llm.line_dedup import report

    return report(documents(spark, sf_dir), least=1)


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelode.llm.token_output import token_records

    return token_records(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), end_id=0)


def op3_evidence_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelode.llm.language import judged, learned

    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), learned(documents(spark, sf_dir)))


def op4_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelode.llm.packing import packed

    return packed(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), end_id=1, capacity=4096)


def op5_grammar_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelode.llm.secrets import scan

    return scan(documents(spark, sf_dir))


def op6_attention_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelode.llm.quality import scored, trained

    docs = documents(spark, sf_dir)
    return scored(docs, trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op7_count_vector_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelode.llm.jaccard_join import linked

    return linked(documents(spark, sf_dir), n=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op8_signature_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelode.llm.media import media_features

    return media_features(documents(spark, sf_dir))


def op9_merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelode.llm.token_counts import token_counts

    return token_counts(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), limit=1024)


def op10_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelode.llm.decontamination import contamination

    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def op11_merkle_butterfly(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelode.llm.manifest import manifest

    return manifest(documents(spark, sf_dir))


def op12_diagonal_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelode.llm.licenses import scanned

    return scanned(documents(spark, sf_dir))


def op13_rollup_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelode.llm.collocations import mined

    return mined(documents(spark, sf_dir), least=30, top=2000)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_template_tree": op1_template_tree,
        "op2_token_records": op2_token_records,
        "op3_evidence_fusion": op3_evidence_fusion,
        "op4_best_two_fit": op4_best_two_fit,
        "op5_grammar_inference": op5_grammar_inference,
        "op6_attention_bags": op6_attention_bags,
        "op7_count_vector_rtree": op7_count_vector_rtree,
        "op8_signature_sniffing": op8_signature_sniffing,
        "op9_merge_counts": op9_merge_counts,
        "op10_suffix_automaton": op10_suffix_automaton,
        "op11_merkle_butterfly": op11_merkle_butterfly,
        "op12_diagonal_votes": op12_diagonal_votes,
        "op13_rollup_phrases": op13_rollup_phrases,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    from tracelode.llm import oracles

    return {
        "op11_merkle_butterfly": oracles.manifest(),
        "op12_diagonal_votes": oracles.licenses(),
        "op13_rollup_phrases": oracles.collocations(),
    }

"""The numbered queries and the SQL of those that SQL can express."""

from __future__ import annotations

from veriframe.llm import bpe, fill_middle, language, order_minhash, packing, pages, prefix_trie, quality, sharding, simhash, token_files, toxicity, warc


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


QUERIES = {
    "op1_string_kernel_toxicity": lambda spark, sf_dir: toxicity.score_documents(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")),
    "op2_best_fit_packing": lambda spark, sf_dir: packing.pack_documents(_docs(spark, sf_dir)),
    "op3_addressable_codes": lambda spark, sf_dir: token_files.token_round_trip(_docs(spark, sf_dir)),
    "op4_rendezvous_sharding": lambda spark, sf_dir: sharding.shard_documents(_docs(spark, sf_dir)),
    "op5_pair_index_bpe": lambda spark, sf_dir: bpe.encode_documents(_docs(spark, sf_dir)),
    "op6_order_minhash": lambda spark, sf_dir: order_minhash.edited_fingerprints(_docs(spark, sf_dir)),
    "op7_simhash_trie_join": lambda spark, sf_dir: simhash.near_duplicates(_docs(spark, sf_dir)),
    "op8_output_code_language": lambda spark, sf_dir: language.identify(_docs(spark, sf_dir)),
    "op9_host_suffix_array": lambda spark, sf_dir: pages.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")),
    "op10_mcd_quality_rules": lambda spark, sf_dir: quality.quality_verdicts(_docs(spark, sf_dir)),
    "op11_warc_salvage": lambda spark, sf_dir: warc.archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")),
    "op12_seekable_fill_middle": lambda spark, sf_dir: fill_middle.fill_in_middle(_docs(spark, sf_dir)),
    "op13_veb_prefix_trie": lambda spark, sf_dir: prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")),
}

ORACLES = {
    "op4_rendezvous_sharding": sharding.oracle(),
    "op11_warc_salvage": warc.ORACLE,
    "op12_seekable_fill_middle": fill_middle.ORACLE,
    "op13_veb_prefix_trie": prefix_trie.oracle(),
}

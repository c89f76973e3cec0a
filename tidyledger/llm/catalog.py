"""Registered queries of the operators, with SQL where it can express them."""

from __future__ import annotations

from public_tokenizers import path as vocabulary
from pyspark.sql import functions as F

from tidyledger.llm import exact_dedup, html_extract, licenses, mixing, neighbours, packing, prefix_trie, quality, simhash
from tidyledger.llm import substring, suffixes, warc, whitening
from tidyledger.llm.common import table


def op1_substring(spark, sf_dir):
    return substring.deduplicate(table(spark, sf_dir, "documents"), with_text=False)


def op2_neighbours(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_simhash(spark, sf_dir):
    return simhash.near_groups(table(spark, sf_dir, "documents"), shingle=4, distance=4)


def op4_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op6_suffixes(spark, sf_dir):
    return suffixes.deduplicate(table(spark, sf_dir, "documents"), with_text=False)


def op7_quality(spark, sf_dir):
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_html_extract(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op9_mixing(spark, sf_dir):
    return mixing.mixture_report(table(spark, sf_dir, "documents"))


def op10_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op11_whitening(spark, sf_dir):
    return whitening.whitening_report(table(spark, sf_dir, "embeddings"))


def op12_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op13_prefix_trie(spark, sf_dir):
    return prefix_trie.prefix_nodes(table(spark, sf_dir, "conversations"), chains=prefix_trie.forked)


QUERIES = {
    "op1_substring": op1_substring,
    "op2_neighbours": op2_neighbours,
    "op3_simhash": op3_simhash,
    "op4_licenses": op4_licenses,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_suffixes": op6_suffixes,
    "op7_quality": op7_quality,
    "op8_html_extract": op8_html_extract,
    "op9_mixing": op9_mixing,
    "op10_packing": op10_packing,
    "op11_whitening": op11_whitening,
    "op12_warc": op12_warc,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLES = {
    "op1_substring": substring.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op12_warc": warc.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}

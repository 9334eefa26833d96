"""The ten operators as registered queries, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers

from geoskein.llm import ann, exact_dedup, jaccard_join, lattice_lm, line_templates, packing, quality, sp_viterbi, toxicity, warc
from geoskein.llm.common import table

QUERIES = {}
ORACLE_SQL = {}


def op4_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


QUERIES["op4_exact_dedup"] = op4_exact_dedup
ORACLE_SQL["op4_exact_dedup"] = exact_dedup.SQL


def op5_best_fit_packing(spark, sf_dir):
    return packing.packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), encode_special_tokens=False)


QUERIES["op5_best_fit_packing"] = op5_best_fit_packing


def op10_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fitted(docs, table(spark, sf_dir, "labels")))


QUERIES["op10_quality_classifier"] = op10_quality_classifier


def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))


QUERIES["op7_toxicity"] = op7_toxicity


def op8_sentencepiece(spark, sf_dir):
    return sp_viterbi.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES["op8_sentencepiece"] = op8_sentencepiece


def op1_ivf_pq_search(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


QUERIES["op1_ivf_pq_search"] = op1_ivf_pq_search


def op2_warc_derivatives(spark, sf_dir):
    return warc.page_derivatives(table(spark, sf_dir, "pages"))


QUERIES["op2_warc_derivatives"] = op2_warc_derivatives


def op6_lattice_likelihood(spark, sf_dir):
    return lattice_lm.scored(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES["op6_lattice_likelihood"] = op6_lattice_likelihood


def op3_line_templates(spark, sf_dir):
    return line_templates.digests(table(spark, sf_dir, "documents"))


QUERIES["op3_line_templates"] = op3_line_templates
ORACLE_SQL["op3_line_templates"] = line_templates.SQL


def op3_split_line_templates(spark, sf_dir):
    """With several templates in a leaf, which the SQL of op3_line_templates doesn't have."""
    return line_templates.digests(table(spark, sf_dir, "documents"), split=True)


QUERIES["op3_split_line_templates"] = op3_split_line_templates


def op9_jaccard_join(spark, sf_dir):
    return jaccard_join.joined(table(spark, sf_dir, "documents"))


QUERIES["op9_jaccard_join"] = op9_jaccard_join

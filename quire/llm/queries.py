"""Queries of the llm problems.  SQL can express none of them over whole tables; each operator is tested
against brute force, a round trip or planted cases."""

from __future__ import annotations

from quire.llm import alignment, mixing, packing, scans, splitting, tokenizer, truncation
from quire.session import table


def p1_found(spark, sf_dir):
    return scans.found(table(spark, sf_dir, "structural_nodes"))


def p1_paragraphs(spark, sf_dir):
    return scans.paragraphs(table(spark, sf_dir, "structural_nodes"))


def p2_found(spark, sf_dir):
    return alignment.found(table(spark, sf_dir, "translation_units"))


def p2_pairs(spark, sf_dir):
    return alignment.align(table(spark, sf_dir, "translation_units"))


def p3_found(spark, sf_dir):
    return splitting.found(table(spark, sf_dir, "structural_nodes"))


def p3_pieces(spark, sf_dir):
    return splitting.split_nodes(table(spark, sf_dir, "structural_nodes"))


def p4_found(spark, sf_dir):
    return packing.perfect(table(spark, sf_dir, "structural_nodes"))


def p4_containers(spark, sf_dir):
    return packing.containers(table(spark, sf_dir, "structural_nodes"))


def p6_ids(spark, sf_dir):
    return tokenizer.encode(table(spark, sf_dir, "documents"))


def p7_mixture(spark, sf_dir):
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark, sf_dir):
    return mixing.shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_found(spark, sf_dir):
    return truncation.found(table(spark, sf_dir, "documents"))


def p8_sources(spark, sf_dir):
    return truncation.by_source(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_paragraphs, p2_found, p2_pairs, p3_found, p3_pieces, p4_found, p4_containers, p6_ids, p7_mixture, p7_shares, p8_found, p8_sources)}
SQL: dict[str, str] = {}

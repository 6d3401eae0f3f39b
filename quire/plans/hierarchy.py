"""Queries of the hierarchy problem.  Their SQL would be recursive over the whole table: none is given,
the operator is tested against a walk of each chain."""

from __future__ import annotations

from quire.operators import hierarchy
from quire.session import table


def p5_found(spark, sf_dir):
    return hierarchy.faults(table(spark, sf_dir, "structural_nodes"))


def p5_hierarchy(spark, sf_dir):
    return hierarchy.tree_table(table(spark, sf_dir, "structural_nodes"))


QUERIES = {"p5_found": p5_found, "p5_hierarchy": p5_hierarchy}
SQL: dict[str, str] = {}

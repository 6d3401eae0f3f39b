"""Parent-child rows to full hierarchies, by heavy-path decomposition after cycle separation.

All loops are over powers of two or over light edges, so the number of rounds grows with the
logarithm of the depth, not with the depth; each round is one equi-join on ids.  All joins are between
tables that grow with the rows, whose written sizes say little about memory, so none of them is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.prefix import running_total
from quire.session import Stage

SEPARATOR = " / "


def title_of(text: Column) -> Column:
    """The text of a heading after its leading # signs, trimmed."""
    return F.regexp_replace(F.regexp_replace(text, r"^#+", ""), r"(?U)^\s+|\s+$", "")


def _nodes(nodes: DataFrame) -> DataFrame:
    """One row per id; of rows that share an id and differ, the least in the order of the fields."""
    cols = ["document_id", "parent_id", "heading_level", "heading_path"]
    is_heading = F.col("node_type") == "heading"
    return (
        nodes.filter(F.col("id").isNotNull())
        .select(
            "id",
            F.struct(
                *cols,
                is_heading.alias("is_heading"),
                F.when(is_heading, title_of(F.coalesce("source_text", F.lit("")))).alias("title"),
            ).alias("s"),
        )
        .groupBy("id")
        .agg(F.min("s").alias("s"))
        .select("id", "s.*")
        .withColumn("is_heading", F.coalesce("is_heading", F.lit(False)))
    )


def _double(stage: Stage, state: DataFrame, name: str, sums: list[str], sizes: bool) -> DataFrame:
    """One round of pointer doubling: anc from the ancestor 2^k above to that 2^(k+1) above."""
    up = state.select(
        F.col("id").alias("u_id"), F.col("anc").alias("u_anc"), F.col("top").alias("u_top"), *[F.col(c).alias(f"u_{c}") for c in sums]
    )
    new = state.filter(F.col("anc").isNotNull()).join(up.hint("merge"), F.col("anc") == F.col("u_id")).select(
        "id", F.col("u_anc").alias("anc"), F.col("u_top").alias("top"),
        *[(F.col(c) + F.col(f"u_{c}")).alias(c) for c in sums],
        *[c for c in state.columns if c not in ("id", "anc", "top", *sums)],
    ).unionByName(state.filter(F.col("anc").isNull()))
    if sizes:
        add = state.filter(F.col("anc").isNotNull()).groupBy(F.col("anc").alias("a_id")).agg(F.sum("size").alias("add"))
        new = new.join(add.hint("merge"), F.col("id") == F.col("a_id"), "left").withColumn("size", F.col("size") + F.coalesce("add", F.lit(0))).drop("a_id", "add")
    out = stage.write(new, name)
    stage.drop(state)
    return out


def _separate(stage: Stage, base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state of the nodes whose chain ends, ids on or below a cycle with on_cycle).

    After k rounds each node at depth < 2^k is done.  As a node at depth d has an ancestor at each
    depth below d, a round in which no node gets done shows that all the rest are on or below a
    cycle.  For those the set of pointers shrinks with each round until it is the set of nodes on
    cycles; two sets of one size are the same set, as each is part of the one before.
    """
    state = stage.write(
        base.select(
            "id", F.col("parent").alias("anc"), F.col("id").alias("top"), F.lit(1).cast("bigint").alias("depth"),
            F.col("broken").cast("bigint").alias("broken"), F.lit(1).cast("bigint").alias("size"),
        ),
        "jump",
    )
    active, images = state.filter("anc IS NOT NULL").count(), -1
    while active:
        state = _double(stage, state, "jump", ["depth", "broken"], sizes=True)
        left, seen = state.filter("anc IS NOT NULL").agg(F.count(F.lit(1)), F.count_distinct("anc")).first()
        if left == active and seen == images:
            break
        images = seen if left == active else -1
        active = left
    rest = state.filter("anc IS NOT NULL")
    on = rest.select(F.col("anc").alias("c_id")).distinct()
    cyclic = rest.select("id").join(on.hint("merge"), F.col("id") == F.col("c_id"), "left").select("id", F.col("c_id").isNotNull().alias("on_cycle"))
    return state.filter("anc IS NULL").drop("anc").withColumnRenamed("top", "root").withColumn("depth", F.col("depth") - 1), cyclic


def hierarchy(nodes: DataFrame) -> tuple[DataFrame, DataFrame, Stage]:
    """(one row per node, cyclic ids, the stage that holds the tables).

    ``nodes`` has id, document_id, parent_id, node_type, heading_level, heading_path and source_text;
    other columns are ignored.  Rows with a null id are left out; rows that share an id count once.

    The result has id, document_id, parent_id, parent_exists, parent_document_id, parent_is_heading,
    parent_level, heading_level, is_heading, heading_path and, for a node whose chain of parents ends
    (else null): root_id, depth (0 at a root), path (titles of the headings on the chain joined by
    ' / '), pre and subtree_size: the descendants of a node are the nodes of its root whose pre is
    above its own and below pre + subtree_size; intact: the chain ends at a node without parent_id
    and stays in one file.  A parent_id that names no row ends a chain.
    """
    spark = nodes.sparkSession
    stage = Stage(spark, "hierarchy")
    n = stage.write(_nodes(nodes), "nodes")
    rows = n.count()
    par = n.select(
        F.col("id").alias("p_id"), F.col("document_id").alias("p_document_id"), F.col("is_heading").alias("p_is_heading"), F.col("heading_level").alias("p_level")
    )
    linked = n.join(par.hint("merge"), F.col("parent_id") == F.col("p_id"), "left")
    base = linked.select(
        "id", F.col("p_id").alias("parent"),
        ((F.col("parent_id").isNotNull() & F.col("p_id").isNull()) | (F.col("p_id").isNotNull() & ~F.col("document_id").eqNullSafe(F.col("p_document_id")))).alias("broken"),
    )
    tree, cyclic = _separate(stage, base)

    # heavy child: the largest subtree, of equals the least id; partial aggregates absorb hot parents
    t = tree.join(n.select("id", "parent_id", "is_heading", "title").hint("merge"), "id").withColumn(
        "parent_id", F.when(F.col("depth") > 0, F.col("parent_id"))
    )
    t = stage.write(t, "tree")
    kids = t.filter("parent_id IS NOT NULL")
    heavy = kids.groupBy(F.col("parent_id").alias("h_parent")).agg(F.max(F.struct("size", (-F.col("id")).alias("neg"))).alias("h"))
    heavy = heavy.select("h_parent", (-F.col("h.neg")).alias("heavy_id"), F.col("h.size").alias("heavy_size"))
    heavy = stage.write(heavy, "heavy")
    inner = t.join(heavy.hint("merge"), F.col("id") == F.col("h_parent"), "left_semi")
    # chains over the inner nodes only: a leaf takes its place from its parent
    links = inner.join(heavy.select("heavy_id", "h_parent").hint("merge"), F.col("id") == F.col("heavy_id"), "left")
    state = stage.write(links.select("id", F.col("h_parent").alias("anc"), F.col("id").alias("top")), "chain")
    while not state.filter("anc IS NOT NULL").isEmpty():
        state = _double(stage, state, "chain", [], sizes=False)
    # light siblings after the heavy child, in any fixed order: here that of a hash of the id
    light = kids.join(heavy.select("heavy_id").hint("merge"), F.col("id") == F.col("heavy_id"), "left_anti")
    light = running_total(light.select("id", "parent_id", "size"), ["parent_id"], F.xxhash64("id"), ["id"], F.col("size"), "before", rows)
    light = light.join(heavy.select("h_parent", "heavy_size").hint("merge"), F.col("parent_id") == F.col("h_parent")).select(
        F.col("id").alias("l_id"), (F.col("before") + F.col("heavy_size") + 1).alias("offset")
    )
    light = stage.write(light, "light")
    member = inner.join(state.select(F.col("id").alias("m_id"), F.col("top").alias("head")).hint("merge"), F.col("id") == F.col("m_id")).drop("m_id")
    member = stage.write(member, "member")
    # a chain is part of one path from a root, so its array is no longer than the tree is deep
    segments = member.groupBy("head").agg(
        F.sort_array(F.collect_list(F.struct("depth", F.when(F.col("is_heading"), F.col("title")).alias("title")))).alias("seg")
    )
    heads = member.filter("id = head").select("head", "parent_id", "depth").join(light.hint("merge"), F.col("head") == F.col("l_id"), "left").drop("l_id")
    up = member.select(F.col("id").alias("a_id"), F.col("head").alias("a_head"), F.col("depth").alias("a_depth"))
    heads = heads.join(up.hint("merge"), F.col("parent_id") == F.col("a_id"), "left").join(segments.hint("merge"), "head")
    heads = stage.write(heads.select("head", "depth", "offset", "a_head", "a_depth", "seg"), "heads")

    def titles(seg: Column, upto: Column) -> Column:
        return F.transform(F.filter(seg, lambda x: (x["depth"] <= upto) & x["title"].isNotNull()), lambda x: x["title"])

    done = stage.write(heads.filter("a_head IS NULL").select("head", "depth", "seg", F.array().cast("array<string>").alias("prefix"), F.lit(0).cast("bigint").alias("start")), "done")
    parts = [done]
    # each light edge at least halves the subtree: at most log2(rows) rounds
    while True:
        f = done.select(F.col("head").alias("f_head"), F.col("depth").alias("f_depth"), F.col("seg").alias("f_seg"), F.col("prefix").alias("f_prefix"), F.col("start").alias("f_start"))
        nxt = heads.join(f.hint("merge"), F.col("a_head") == F.col("f_head")).select(
            "head", "depth", "seg",
            F.concat("f_prefix", titles(F.col("f_seg"), F.col("a_depth"))).alias("prefix"),
            (F.col("f_start") + F.col("a_depth") - F.col("f_depth") + F.col("offset")).alias("start"),
        )
        done = stage.write(nxt, "done")
        if done.isEmpty():
            break
        parts.append(done)
    chains = parts[0]
    for p in parts[1:]:
        chains = chains.unionByName(p)
    placed = chains.select(
        F.col("head").alias("c_head"), F.col("depth").alias("c_depth"), "start", "prefix", "seg"
    ).join(member.select("id", "head", "depth").hint("merge"), F.col("c_head") == F.col("head")).select(
        F.col("id").alias("i_id"),
        F.concat("prefix", titles(F.col("seg"), F.col("depth"))).alias("i_titles"),
        (F.col("start") + F.col("depth") - F.col("c_depth")).alias("i_pre"),
    )
    placed = stage.write(placed, "placed")
    none = F.array().cast("array<string>")
    own = F.when(F.col("is_heading"), F.array("title")).otherwise(none)
    a = t.join(placed.hint("merge"), F.col("id") == F.col("i_id")).select("id", "root", "depth", "size", "broken", F.array_join("i_titles", SEPARATOR).alias("path"), F.col("i_pre").alias("pre"))
    leaves = t.join(heavy.hint("merge"), F.col("id") == F.col("h_parent"), "left_anti")
    b = (
        leaves.join(placed.hint("merge"), F.col("parent_id") == F.col("i_id"), "left")
        .join(light.hint("merge"), F.col("id") == F.col("l_id"), "left")
        .select(
            "id", "root", "depth", "size", "broken",
            F.array_join(F.concat(F.coalesce("i_titles", none), own), SEPARATOR).alias("path"),
            F.when(F.col("parent_id").isNull(), F.lit(0)).otherwise(F.col("i_pre") + F.coalesce("offset", F.lit(1))).cast("bigint").alias("pre"),
        )
    )
    known = a.unionByName(b).select(
        F.col("id").alias("k_id"), F.col("root").alias("root_id"), "depth", "path", "pre", F.col("size").alias("subtree_size"), (F.col("broken") == 0).alias("intact")
    )
    out = linked.join(known.hint("merge"), F.col("id") == F.col("k_id"), "left").select(
        "id", "document_id", "parent_id", F.col("p_id").isNotNull().alias("parent_exists"), F.col("p_document_id").alias("parent_document_id"),
        F.col("p_is_heading").alias("parent_is_heading"), F.col("p_level").alias("parent_level"), "heading_level", "is_heading", "heading_path",
        "root_id", "depth", "path", "pre", "subtree_size", "intact",
    )
    return out, cyclic, stage


def faults(nodes: DataFrame) -> DataFrame:
    """(node_id, fault): the rows whose links, heading_path or heading_level can't be right.

    A node on a cycle has 'cycle', one below it 'below_cycle'.  A link is 'foreign_parent' where the
    two document_ids differ, null being a value of its own.  'level_mismatch' holds for a heading
    that is its own parent, as its level isn't greater than itself.  An empty table gives no rows.
    """
    h, cyclic, _ = hierarchy(nodes)
    linked = F.col("parent_exists")
    same = F.col("document_id").eqNullSafe(F.col("parent_document_id"))
    row = h.select(
        F.col("id").alias("node_id"),
        F.array_compact(
            F.array(
                F.when(F.col("parent_id").isNotNull() & ~linked, F.lit("lost_parent")),
                F.when(linked & ~same, F.lit("foreign_parent")),
                F.when(linked & same & F.col("is_heading") & F.col("parent_is_heading") & (F.col("heading_level") <= F.col("parent_level")), F.lit("level_mismatch")),
                F.when(F.col("heading_path").isNotNull() & F.col("intact") & (F.col("heading_path") != F.col("path")), F.lit("path_mismatch")),
            )
        ).alias("f"),
    )
    loops = cyclic.select(F.col("id").alias("node_id"), F.when(F.col("on_cycle"), F.lit("cycle")).otherwise(F.lit("below_cycle")).alias("fault"))
    return row.select("node_id", F.explode("f").alias("fault")).unionByName(loops)


def tree_table(nodes: DataFrame) -> DataFrame:
    """(node_id, root_id, depth, path, pre, subtree_size) of every node; nulls on or below a cycle."""
    h, _, _ = hierarchy(nodes)
    return h.select(F.col("id").alias("node_id"), "root_id", "depth", "path", "pre", "subtree_size")

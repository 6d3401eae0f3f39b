"""Knowledge documents: generated index blocks, lint rules, links between documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What encloses a generated index, and what its first line inside says.
BEGIN, END = "<!-- BEGIN GENERATED INDEX -->", "<!-- END GENERATED INDEX -->"
CHECKSUM = r"<!-- checksum: ([0-9a-f]{16}) -->"


def escape_cell(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def summarize(values: Column, limit: int = 3) -> Column:
    """The first values as table cells, with ' ...' if there are more; '-' for none."""
    shown = F.array_join(F.transform(F.slice(values, 1, limit), escape_cell), "<br>")
    return F.when(F.coalesce(F.size(values), F.lit(0)) <= 0, "-").otherwise(F.concat(shown, F.when(F.size(values) > limit, " ...").otherwise("")))


def index_blocks(concepts: DataFrame, scope: str = "scope") -> DataFrame:
    """(scope, entries, block): a table of the concepts of each scope, by path, with the checksum of its lines.
    ``concepts`` has scope, path, type, title and hints; a scope is a folder and bounds the block."""
    line = F.concat(F.lit("| ["), "path", F.lit("]("), "path", F.lit(") | `"), escape_cell(F.col("type")), F.lit("` | "), escape_cell(F.col("title")), F.lit(" | "), summarize(F.col("hints")), F.lit(" |"))
    g = concepts.select(scope, F.struct("path", line.alias("line")).alias("s")).groupBy(scope).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["line"]), "\n").alias("rows"), F.count(F.lit(1)).alias("entries"))
    inner = F.concat(F.lit("| Path | Type | Title | Hints |\n|------|------|-------|-------|\n"), "rows")
    block = F.concat(F.lit(BEGIN + "\n<!-- checksum: "), F.substring(F.sha2(inner, 256), 1, 16), F.lit(" -->\n"), inner, F.lit("\n" + END))
    return g.select(scope, "entries", block.alias("block"))


def put_block(text: Column, block: Column) -> Column:
    """A document with its generated block replaced, or added at its end; line ends are normalized."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    before, after = F.regexp_replace(F.substring_index(t, BEGIN, 1), r"\s+\z", ""), F.regexp_replace(F.substring_index(t, END, -1), r"^\s+", "")
    swapped = F.concat(before, F.lit("\n\n"), block, F.lit("\n\n"), after)
    added = F.concat(F.regexp_replace(t, r"\s+\z", ""), F.lit("\n\n"), block)
    return F.concat(F.regexp_replace(F.when(F.contains(t, F.lit(BEGIN)) & F.contains(t, F.lit(END)), swapped).otherwise(added), r"\s+\z", ""), F.lit("\n"))


def block_state(text: Column) -> Column:
    """'none', 'unbalanced', 'no_checksum', 'stale' or 'ok' of the generated block in a document."""
    n = lambda m: F.regexp_count(text, F.lit(m.replace("!", "\\!")))
    between = F.trim(F.substring_index(F.substring_index(text, BEGIN + "\n", -1), "\n" + END, 1))
    told = F.regexp_extract(between, CHECKSUM, 1)
    inner = F.regexp_replace(between, "^" + CHECKSUM + "\n", "")
    return (
        F.when(n(BEGIN) != n(END), "unbalanced").when(n(BEGIN) == 0, "none").when(told == "", "no_checksum").when(told != F.substring(F.sha2(inner, 256), 1, 16), "stale").otherwise("ok")
    )


def lint(notes: DataFrame, required: list[str], allowed: dict[str, list[str]], sections: list[str] = ()) -> DataFrame:
    """(id, code, detail) of the rules that a document breaks.  ``notes`` has id, fields MAP and body."""
    f = lambda k: F.element_at("fields", k)
    found = [F.when(F.coalesce(f(k), F.lit("")) == "", F.struct(F.lit("field_missing").alias("code"), F.lit(k).alias("detail"))) for k in required]
    found += [F.when(f(k).isNotNull() & ~f(k).isin(*v), F.struct(F.lit("enum_invalid").alias("code"), F.concat(F.lit(f"{k}="), f(k)).alias("detail"))) for k, v in allowed.items()]
    found += [F.when(~F.col("body").rlike(rf"(?m)^#[ \t]+\Q{s}\E[ \t]*$"), F.struct(F.lit("section_missing").alias("code"), F.lit(s).alias("detail"))) for s in sections]
    return notes.select("id", F.explode(F.array_compact(F.array(*found))).alias("x")).select("id", "x.code", "x.detail")


def split_relation(relation: Column) -> tuple[Column, Column]:
    """(kind, target) of 'kind:target'; a target alone is 'related_to'."""
    kind = F.trim(F.substring_index(relation, ":", 1))
    plain = ~F.contains(relation, F.lit(":"))
    return F.when(plain | (kind == ""), "related_to").otherwise(kind), F.trim(F.regexp_replace(relation, r"^[^:]*:", ""))


def resolve_link(source: Column, target: Column) -> Column:
    """The path that a relative or rooted link leads to; null for an external or empty one."""
    t = F.regexp_replace(F.trim(target), "#.*$", "")
    folder = F.regexp_replace(source, "[^/]*$", "")
    joined = F.when(t.startswith("/"), t).otherwise(F.concat(folder, t))
    parts = F.filter(F.split(joined, "/"), lambda x: ~x.isin("", "."))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    return F.when((t != "") & ~t.rlike(r"(?i)^(https?:|mailto:|tel:)"), F.array_join(walked, "/"))

"""Markdown and record sources: front matter, titles, sections, blocks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRONT = r"(?s)^---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)"


def read_text_files(spark: SparkSession, path: str, glob: str = "*.md", recursive: bool = True) -> DataFrame:
    """(path, text, valid): whole files as UTF-8 without a byte order mark; valid is false, and text null,
    where the bytes aren't UTF-8."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
    text = F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), "^﻿", "")
    return files.select("path", text.alias("text"), text.isNotNull().alias("valid"))


def front_matter(text: Column) -> Column:
    """The block between the leading --- lines, null without one or where it isn't closed."""
    return F.nullif(F.regexp_extract(text, FRONT, 1), F.lit(""))


def body(text: Column) -> Column:
    return F.regexp_replace(text, FRONT, "")


def front_state(text: Column) -> Column:
    """'ok', 'missing' or 'unclosed'."""
    return F.when(~text.rlike(r"^---[ \t]*\r?\n"), "missing").when(text.rlike(FRONT), "ok").otherwise("unclosed")


def flat_fields(block: Column) -> Column:
    """Map of the ``key: value`` lines of flat front matter, quotes taken off; of a repeated key the first."""
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z_][\w.-]*\s*:"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^:]+):", 1)).alias("key"), F.regexp_replace(F.trim(F.regexp_extract(x, r"^[^:]+:(.*)$", 1)), r"""^(["'])(.*)\1$""", "$2").alias("value")))
    first = F.aggregate(pairs, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, p: F.when(F.map_contains_key(m, p["key"]), m).otherwise(F.map_concat(m, F.map_from_arrays(F.array(p["key"]), F.array(p["value"])))))
    return F.coalesce(first, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


_KEY = re.compile(r"""^("[^"]*"|'[^']*'|[^\s:#][^:]*?)\s*:(?:\s+(.*))?$""")


def _scalar(text: str) -> str:
    t = text.strip()
    if t[:1] in "\"'" and len(t) > 1 and t[-1] == t[0]:
        return t[1:-1]
    t = re.sub(r"\s+#.*$", "", t)
    return "" if t in ("null", "~", "Null", "NULL") else t.lower() if t in ("True", "False", "TRUE", "FALSE") else t


def _items(flow: str) -> list[str]:
    """The items of [a, "b, c"]."""
    parts = re.findall(r"""\s*("[^"]*"|'[^']*'|[^,]*)\s*(?:,|$)""", flow.strip()[1:-1])
    return [_scalar(x) for x in parts if x.strip()]


def parse_fields(block: str) -> tuple[dict[str, str | list[str]], str | None]:
    """Nested front matter as dotted keys (a.b.c) with texts or lists of texts, and what is wrong: null, 'duplicate_key: k' or 'unreadable: line n'.

    Null is the empty text, an empty mapping an empty list; timestamps and numbers stay as written.  Lists are in
    brackets or lines with a dash; a text after | or > is the deeper lines below it."""
    out: dict[str, str | list[str]] = {}
    seen: set[str] = set()
    open_keys: list[tuple[int, str]] = []  # indent and dotted key of the mappings around a line
    last: tuple[int, str] | None = None  # a key whose value may follow below
    lines = block.split("\n")
    k = 0
    while k < len(lines):
        line, no = lines[k].rstrip(), k + 1
        k += 1
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        indent = len(line) - len(line.lstrip(" "))
        text = line.strip()
        if text == "-" or text.startswith("- "):
            if last is None or indent < last[0] or not isinstance(out.get(last[1], []), list):
                return out, f"unreadable: line {no}"
            out.setdefault(last[1], []).append(_scalar(text[1:]))
            continue
        m = _KEY.match(text)
        if not m:
            return out, f"unreadable: line {no}"
        while open_keys and open_keys[-1][0] >= indent:
            open_keys.pop()
        if last is not None and indent > last[0]:
            if last[1] in out:
                return out, f"unreadable: line {no}"
            open_keys.append(last)
        elif last is not None and last[1] not in out:
            out[last[1]] = ""
        key = ".".join([*(open_keys[-1][1:] if open_keys else ()), m[1].strip("\"'")])
        if key in seen:
            return out, f"duplicate_key: {key}"
        seen.add(key)
        value = (m[2] or "").strip()
        last = (indent, key)
        if value in ("|", ">", "|-", ">-"):
            held = []
            while k < len(lines) and (not lines[k].strip() or len(lines[k]) - len(lines[k].lstrip(" ")) > indent):
                held.append(lines[k].strip())
                k += 1
            out[key] = ("\n" if value[0] == "|" else " ").join(held).strip()
        elif value.startswith("[") and value.endswith("]"):
            out[key] = _items(value)
        elif value == "{}":
            out[key] = []
        elif value and not value.startswith("#"):
            out[key] = _scalar(value)
    if last is not None and last[1] not in out and not any(x.startswith(last[1] + ".") for x in out):
        out[last[1]] = ""
    return out, None


_FIELD = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType()), T.StructField("items", T.ArrayType(T.StringType()))])


@F.pandas_udf(T.StructType([T.StructField("fields", T.ArrayType(_FIELD)), T.StructField("error", T.StringType())]))
def nested_fields(block: pd.Series) -> pd.DataFrame:
    """Dotted keys of nested front matter in their order, each with a text or a list, and what is wrong with the block."""
    rows = []
    for b in block:
        fields, error = parse_fields(b.replace("\r\n", "\n")) if b is not None else ({}, None)
        rows.append(([{"key": k, "value": None if isinstance(v, list) else v, "items": v if isinstance(v, list) else None} for k, v in fields.items()], error))
    return pd.DataFrame(rows, columns=["fields", "error"])


def decode_problems(fields: Column, error: Column, content: Column, required: list[str], optional: list[str] = (), version: tuple[str, str] | None = None, hash_key: str | None = None) -> Column:
    """What keeps a record from being taken: the front matter's error, missing and unknown keys, another version,
    and a stored hash that isn't that of the content."""
    keys = F.transform(fields, lambda x: x["key"])
    value = lambda k: F.get(F.filter(fields, lambda x: x["key"] == k), F.lit(0))["value"]
    out = [F.array_compact(F.array(error)), F.transform(F.array_except(F.array(*[F.lit(k) for k in required]), keys), lambda k: F.concat(F.lit("key_missing:"), k))]
    out.append(F.transform(F.array_except(keys, F.array(*[F.lit(k) for k in (*required, *optional)])), lambda k: F.concat(F.lit("key_unknown:"), k)))
    if version:
        out.append(F.array_compact(F.array(F.when(value(version[0]) != version[1], F.lit("version")))))
    if hash_key:
        out.append(F.array_compact(F.array(F.when(value(hash_key) != F.sha2(content, 256), F.lit("hash_mismatch")))))
    return F.concat(*out)


def flow_list(value: Column) -> Column:
    """[a, b c] as an array of trimmed strings; empty for null or no brackets."""
    inner = F.regexp_extract(F.coalesce(value, F.lit("")), r"^\[(.*)\]$", 1)
    return F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x)), lambda x: x != "")


def title(text: Column) -> Column:
    """The first heading of level 1, trimmed; empty without one."""
    return F.trim(F.regexp_extract(text, r"(?m)^#[ \t]+(.+?)[ \t]*$", 1))


def memory_records(documents: DataFrame) -> DataFrame:
    """Records from notes with front matter: memory_id, path, memory_type, status, tags, title, description,
    content and null scope and validity columns.  Notes without closed front matter are left out; see front_state."""
    from quire.operators.catalog import description

    fields = flat_fields(front_matter(F.col("text")))
    content = body(F.col("text"))
    none = F.lit(None)
    return documents.filter(front_state(F.col("text")) == "ok").withColumn("m", fields).select(
        F.format_string("MEM-%010d", "doc_id").alias("memory_id"), F.format_string("memory/MEM-%010d.md", "doc_id").alias("path"), "doc_id",
        F.element_at("m", "memory_type").alias("memory_type"), F.element_at("m", "status").alias("status"), flow_list(F.element_at("m", "tags")).alias("tags"),
        title(content).alias("title"), description(content).alias("description"), content.alias("content"),
        none.cast("timestamp").alias("valid_from"), none.cast("timestamp").alias("valid_until"),
    )

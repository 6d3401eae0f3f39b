"""Identifiers, canonical JSON, headers and replies of services, versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The signs of identifiers, and their form.
BASE32 = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
MEMORY_ID = r"^MEM-[0-7][0-9A-HJKMNP-TV-Z]{25}$"
#: Labels that a page's layout always leaves out.
PAGE_CHROME = ("number", "header", "header_image", "footer", "footer_image")


def memory_id(at: Column, entropy: Column) -> Column:
    """MEM- and 26 signs of base 32: 48 bits of milliseconds of a timestamp, then 80 bits given as 20 hex digits."""
    ms = F.lpad(F.hex(F.unix_millis(at)), 12, "0")
    # 128 bits and two leading zero bits make 26 groups of five
    bits = F.concat(F.lit("00"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.lpad(F.conv(F.substring(F.upper(F.concat(ms, entropy)), i, F.lit(1)), 16, 2), 4, "0")), ""))
    signs = F.transform(F.sequence(F.lit(0), F.lit(25)), lambda i: F.substring(F.lit(BASE32), F.conv(F.substring(bits, i * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1)))
    return F.concat(F.lit("MEM-"), F.array_join(signs, ""))


def is_memory_id(c: Column) -> Column:
    return F.coalesce(c.rlike(MEMORY_ID), F.lit(False))


def canonical_json(**fields: Column) -> Column:
    """JSON of the fields in the order of their names, nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def fingerprint(**fields: Column) -> Column:
    """SHA-256 of the canonical JSON of settings, so that equal settings have equal fingerprints."""
    return F.sha2(canonical_json(**fields), 256)


def retry_after(header: Column) -> Column:
    """Seconds of a Retry-After header, at most 300; null for a date, a negative or no number."""
    text = F.trim(header)
    return F.when(text.rlike(r"^\d+(\.\d+)?$"), F.least(text.try_cast("double"), F.lit(300.0)))


def backoff(attempt: Column) -> Column:
    """Seconds to wait before the next attempt: 2^(n-1), at most 8."""
    return F.least(F.pow(F.lit(2.0), attempt - 1), F.lit(8.0))


def chat_text(reply: Column) -> Column:
    """The text of a chat reply in JSON, a string or a list of parts; null if there is none."""
    plain = F.get_json_object(reply, "$.choices[0].message.content")
    parts = F.from_json(plain, "array<struct<text:string>>")
    joined = F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda x: x.isNotNull()), "")
    return F.when(plain.startswith("["), F.coalesce(F.nullif(joined, F.lit("")), F.when(parts.isNull(), plain))).otherwise(plain)


def usage_field(usage: Column, *names: str) -> Column:
    """The first of the fields of a JSON object that isn't null or 0, else 0."""
    return F.coalesce(*[F.nullif(F.get_json_object(usage, f"$.{n}").cast("bigint"), F.lit(0)) for n in names], F.lit(0))


def ignore_labels(drop_footnotes: Column, drop_asides: Column) -> Column:
    return F.array_compact(F.concat(F.array(*[F.lit(x) for x in PAGE_CHROME]), F.array(F.when(drop_footnotes, "footnote"), F.when(drop_asides, "aside_text"))))


def is_semver(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(-[0-9A-Za-z.-]+)?(\+[0-9A-Za-z.-]+)?$"), F.lit(False))


def is_instant(c: Column) -> Column:
    """ISO 8601 with date, time and zone."""
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"), F.lit(False))


def version_state(has: Column, wants: Column) -> Column:
    """'same', 'behind' or 'ahead' by the three numbers of two versions; 'unknown' where one isn't a version."""
    number = lambda c: F.transform(F.split(F.regexp_extract(c, r"^(\d+\.\d+\.\d+)", 1), r"\."), lambda x: x.try_cast("bigint"))
    a, b = number(has), number(wants)
    return F.when(~is_semver(has) | ~is_semver(wants), "unknown").when(a == b, "same").when(a < b, "behind").otherwise("ahead")

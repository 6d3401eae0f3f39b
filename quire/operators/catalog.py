"""Queries over a catalog of knowledge records: filters, keyword and full-text search, one-hop relations, ranks."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators.state import digest
from quire.sources import stores

#: The parameters of the BM25 of the reference's index.
K1, B = 1.2, 0.75
FIELDS = ("title", "description", "content", "tags")


@dataclass(frozen=True)
class Request:
    """What is asked of the catalog.  Empty tuples and None ask nothing, but for statuses."""

    memory_ids: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ("active",)
    tags: tuple[str, ...] = ()
    scope: dict[str, str] | None = None
    entity_ids: tuple[str, ...] = ()
    valid_at: str | None = None
    text: str | None = None
    text_mode: str = "keyword"
    include_related: bool = False
    relation_types: tuple[str, ...] = ()
    limit: int = 20
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        if not 1 <= self.limit <= 1000:
            raise ValueError("limit must be from 1 to 1000")
        if not self.statuses:
            raise ValueError("at least one status")
        if self.relation_types and not self.include_related:
            raise ValueError("relation_types needs include_related")
        if self.text_mode not in ("keyword", "fts"):
            raise ValueError("text_mode is keyword or fts")
        if any(p.startswith("/") or ".." in p.split("/") for p in self.paths):
            raise ValueError("paths are relative")


def valid_at(at: Column, start: Column, end: Column) -> Column:
    """Whether an instant is in [start, end], both included; a null end is open."""
    return (start.isNull() | (start <= at)) & (end.isNull() | (at <= end))


def scope_matches(scope: dict[str, str], entities: tuple[str, ...] = ()) -> Column:
    """The namespace and each level that is asked for are equal, and the record has all asked entities."""
    c = F.lit(True)
    for name, value in scope.items():
        c = c & (F.col(name) == F.lit(value))
    if entities:
        c = c & (F.size(F.array_except(F.array(*[F.lit(x) for x in entities]), "entity_ids")) == 0)
    return c


def matches(request: Request) -> Column:
    """The conditions on a record's own columns as one predicate, which Catalyst pushes down as far as it goes."""
    c = F.col("status").isin(*request.statuses)
    if request.memory_ids:
        c = c & F.col("memory_id").isin(*request.memory_ids)
    if request.paths:
        c = c & F.col("path").isin(*request.paths)
    for t in request.tags:
        c = c & F.array_contains("tags", t)
    if request.scope is not None:
        c = c & scope_matches(request.scope, request.entity_ids)
    if request.valid_at is not None:
        c = c & valid_at(F.lit(request.valid_at).cast("timestamp"), F.col("valid_from"), F.col("valid_until"))
    return c


def keyword_fields(keyword: str) -> Column:
    """The fields in which the keyword stands, whatever its case, in the order of FIELDS."""
    k = keyword.lower()
    value = {f: F.col(f) if f != "tags" else F.array_join("tags", " ") for f in FIELDS}
    return F.array_compact(F.array(*[F.when(F.instr(F.lower(value[f]), k) > 0, F.lit(f)) for f in FIELDS]))


def _bases() -> tuple[str, str]:
    """Letters with marks and their bases, by Unicode's decomposition."""
    pairs = []
    for k in range(0xC0, 0x2000):
        d = unicodedata.normalize("NFD", chr(k))
        if len(d) > 1 and all(unicodedata.combining(c) for c in d[1:]):
            pairs.append((chr(k), d[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKED, BASES = _bases()


def fold(text: Column) -> Column:
    """Lower case without diacritics, in the JVM."""
    return F.translate(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\p{M}", ""), MARKED, BASES)


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case and without diacritics, as the index has them."""
    return F.filter(F.split(fold(text), r"(?U)[^\p{L}\p{N}]+"), lambda x: x != "")


class MatchSyntax(ValueError):
    """A full-text question that can't be read."""


_PART = re.compile(r'\s*("[^"]*"|\(|\)|[^\s()"]+)')


def parse_match(text: str) -> tuple:
    """('term', words), ('and', ...), ('or', ...) or ('not', x, y): words and "phrases" with AND, OR, NOT and
    brackets; words side by side must all be there.  Anything else raises MatchSyntax."""
    parts, at = [], 0
    while at < len(text.rstrip()):
        m = _PART.match(text, at)
        if not m:
            raise MatchSyntax(f"unreadable at {at}: {text!r}")
        parts.append(m[1])
        at = m.end()
    place = 0

    def peek() -> str | None:
        return parts[place] if place < len(parts) else None

    def take() -> str:
        nonlocal place
        place += 1
        return parts[place - 1]

    def single() -> tuple:
        x = peek()
        if x is None or x in (")", "AND", "OR", "NOT"):
            raise MatchSyntax(f"a word is missing in {text!r}")
        take()
        if x == "(":
            inner = either()
            if peek() != ")":
                raise MatchSyntax(f"a bracket is open in {text!r}")
            take()
            return inner
        words = re.findall(r"[^\W_]+", "".join(c for c in unicodedata.normalize("NFD", x.lower()) if not unicodedata.combining(c)))
        if not words or (x[0] != '"' and re.search(r"[^\w]", x)):
            raise MatchSyntax(f"not a word: {x!r}")
        return ("term", " ".join(words))

    def negated() -> tuple:
        left = single()
        while peek() == "NOT":
            take()
            left = ("not", left, single())
        return left

    def both() -> tuple:
        out = [negated()]
        while peek() not in (None, ")", "OR"):
            if peek() == "AND":
                take()
            out.append(negated())
        return out[0] if len(out) == 1 else ("and", *out)

    def either() -> tuple:
        out = [both()]
        while peek() == "OR":
            take()
            out.append(both())
        return out[0] if len(out) == 1 else ("or", *out)

    if not parts:
        raise MatchSyntax("nothing is asked")
    tree = either()
    if peek() is not None:
        raise MatchSyntax(f"a bracket too many in {text!r}")
    return tree


def _phrases(tree: tuple) -> list[str]:
    return [tree[1]] if tree[0] == "term" else list(dict.fromkeys(x for t in tree[1:] for x in _phrases(t)))


def match(records: DataFrame, text: str, key: str = "memory_id") -> DataFrame:
    """(key, score, matched_fields) of the records that a full-text question asks for; a phrase stands in one
    field.  The score is BM25 over the question's words and phrases, as in ``bm25``; one pass over the records
    without a shuffle but for the figures of the whole, which are one row."""
    tree = parse_match(text)
    asked = _phrases(tree)
    value = {f: F.col(f) if f != "tags" else F.array_join("tags", " ") for f in FIELDS}
    # each word has blanks of its own, so that occurrences side by side don't share one
    spaced = lambda c: F.concat_ws("", F.transform(tokens(c), lambda t: F.concat(F.lit(" "), t, F.lit(" "))))
    r = records.select(key, *[spaced(value[f]).alias(f"__{f}") for f in FIELDS])
    size = F.lit(0)
    for f in FIELDS:
        size = size + F.size(tokens(value[f]))
    r = records.select(key, size.alias("__len"), *[spaced(value[f]).alias(f"__{f}") for f in FIELDS])

    def occurs(phrase: str, name: str) -> Column:
        pattern = "".join(f" {w} " for w in phrase.split(" "))
        return (F.length(f"__{name}") - F.length(F.replace(F.col(f"__{name}"), F.lit(pattern), F.lit("")))) / len(pattern)

    for k, phrase in enumerate(asked):
        total = F.lit(0)
        for f in FIELDS:
            total = total + occurs(phrase, f)
        r = r.withColumn(f"__tf{k}", total)

    def holds(t: tuple) -> Column:
        if t[0] == "term":
            return F.col(f"__tf{asked.index(t[1])}") > 0
        parts = [holds(x) for x in t[1:]]
        out = parts[0]
        for x in parts[1:]:
            out = out & x if t[0] == "and" else out | x if t[0] == "or" else out & ~x
        return out

    corpus = r.agg(F.count(F.lit(1)).alias("__n"), F.avg("__len").alias("__avg"), *[F.count_if(F.col(f"__tf{k}") > 0).alias(f"__df{k}") for k in range(len(asked))])
    r = r.filter(holds(tree)).join(F.broadcast(corpus))  # one row
    score = F.lit(0.0)
    for k in range(len(asked)):
        idf = F.log((F.col("__n") - F.col(f"__df{k}") + 0.5) / (F.col(f"__df{k}") + 0.5))
        idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
        tf = F.col(f"__tf{k}")
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("__len") / F.col("__avg")))).otherwise(0.0)
    fields = F.array_compact(F.array(*[F.when(F.greatest(*[occurs(p, f) for p in asked], F.lit(0.0)) > 0, F.lit(f)) for f in FIELDS]))
    return r.select(key, F.greatest(score, F.lit(0.0)).alias("score"), fields.alias("matched_fields"))


def postings(records: DataFrame, key: str = "memory_id") -> DataFrame:
    """(key, field, term, tf): the inverted index as a table."""
    parts = F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f) if f != "tags" else F.array_join("tags", " ")).alias("terms")) for f in FIELDS])
    return (
        records.select(key, F.explode(parts).alias("p"))
        .select(key, "p.field", F.explode("p.terms").alias("term"))
        .groupBy(key, "field", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def bm25(records: DataFrame, terms: list[str], key: str = "memory_id") -> DataFrame:
    """(key, score, matched_fields) of the records that have all terms, over all fields together.

    idf is ln((N - n + 0.5) / (n + 0.5)), or 1e-6 where that isn't positive.  The postings of the asked
    terms only are kept; the corpus figures are one row, which is broadcast.
    """
    terms = [w for t in dict.fromkeys(terms) for w in _phrases(parse_match(t))]
    if not terms:
        raise ValueError("no terms")
    size = F.lit(0)
    for f in FIELDS:
        size = size + F.size(tokens(F.col(f) if f != "tags" else F.array_join("tags", " ")))
    lengths = records.select(key, size.alias("len"))
    corpus = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"))
    hits = postings(records, key).filter(F.col("term").isin(*terms))
    per = hits.groupBy(key, "term").agg(F.sum("tf").alias("tf"), F.collect_set("field").alias("fields"))
    df = per.groupBy(F.col("term").alias("d_term")).agg(F.count(F.lit(1)).alias("df"))  # one row for each asked term
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
    norm = F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len"))
    scored = (
        per.join(F.broadcast(df), F.col("term") == F.col("d_term")).join(lengths, key).join(F.broadcast(corpus))
        .withColumn("s", idf * F.col("tf") * (K1 + 1) / norm)
        .groupBy(key)
        .agg(F.sum("s").alias("score"), F.count(F.lit(1)).alias("found"), F.array_distinct(F.flatten(F.collect_list("fields"))).alias("fields"))
        .filter(F.col("found") == len(terms))
    )
    order = F.array(*[F.lit(f) for f in FIELDS])
    return scored.select(key, F.greatest("score", F.lit(0.0)).alias("score"), F.filter(order, lambda f: F.array_contains("fields", f)).alias("matched_fields"))


def direct(records: DataFrame, request: Request) -> DataFrame:
    """(memory_id, score, matched_fields, match_reasons, warnings) of the records that the request asks for."""
    kept = records.filter(matches(request))
    fields, reasons = [], []
    if request.memory_ids:
        fields.append(F.lit("memory_id"))
        reasons.append(F.concat(F.lit("memory_id:"), "memory_id"))
    if request.paths:
        fields.append(F.lit("path"))
        reasons.append(F.concat(F.lit("path:"), "path"))
    if request.tags:
        fields.append(F.lit("tags"))
        reasons += [F.lit(f"tag:{t}") for t in request.tags]
    if request.scope is not None:
        fields.append(F.lit("scope"))
        reasons.append(F.lit(f"scope:{request.scope.get('namespace')}"))
    fields.append(F.lit("status"))
    reasons.append(F.concat(F.lit("status:"), "status"))
    if request.valid_at is not None:
        fields.append(F.lit("validity"))
        reasons.append(F.lit(f"valid_at:{request.valid_at}"))
    score, found = F.lit(None).cast("double"), F.array().cast("array<string>")
    if request.text is not None and request.text_mode == "keyword":
        kept = kept.withColumn("__f", keyword_fields(request.text)).filter(F.size("__f") > 0)
        score, found = F.size("__f").cast("double"), F.col("__f")
        reasons.append(F.lit(f"keyword:{request.text}"))
    elif request.text is not None:
        ranked = match(records, request.text).select(F.col("memory_id").alias("__id"), F.col("score").alias("__s"), F.col("matched_fields").alias("__f"))
        kept = kept.join(ranked, F.col("memory_id") == F.col("__id"))
        score, found = F.col("__s"), F.col("__f")
        reasons.append(F.lit(f"fts:{request.text}"))
    warnings = [F.when(F.col("status") != "active", F.concat(F.lit("excluded from ordinary queries: status "), "status"))]
    if request.valid_at is None:
        warnings.append(F.when(F.col("valid_from").isNotNull() | F.col("valid_until").isNotNull(), F.lit("validity not evaluated")))
    return kept.select(
        "memory_id", score.alias("score"), F.array_distinct(F.concat(F.array(*fields), found)).alias("matched_fields"),
        F.array_distinct(F.array(*reasons)).alias("match_reasons"), F.array_compact(F.array(*warnings)).alias("warnings"),
    )


def one_hop(hits: DataFrame, relations: DataFrame, records: DataFrame, request: Request) -> DataFrame:
    """The records one relation away from any hit (before the limit): of several edges to a target the one
    of the best hit, then of the least type.  Status, validity and scope hold for the target, text and tags don't."""
    edges = relations if not request.relation_types else relations.filter(F.col("relation_type").isin(*request.relation_types))
    rank = F.struct(F.coalesce(-F.col("score"), F.lit(0.0)), F.col("h.memory_id"), F.col("relation_type"))
    reached = (
        hits.alias("h").join(edges.alias("e"), F.col("h.memory_id") == F.col("e.memory_id"))
        .groupBy("target_memory_id").agg(F.min(rank).alias("r"))
        .select(F.col("target_memory_id").alias("memory_id"), F.col("r.memory_id").alias("source_id"), F.col("r.relation_type").alias("relation_type"))
        .join(hits.select("memory_id"), "memory_id", "left_anti")
    )
    narrow = Request(statuses=request.statuses, scope=request.scope, entity_ids=request.entity_ids, valid_at=request.valid_at)
    return reached.join(records.filter(matches(narrow)).select("memory_id"), "memory_id", "left_semi")


def query(records: DataFrame, relations: DataFrame | None, request: Request) -> DataFrame:
    """(rank, memory_id, score, relation_source_id, matched_fields, match_reasons): direct hits by falling
    score, then related records in the order of their sources; the limit counts both."""
    hits = direct(records, request)
    out = hits.select(F.lit(0).alias("part"), (-F.coalesce("score", F.lit(0.0))).alias("by"), F.col("memory_id").alias("by_id"), "memory_id", "score", F.lit(None).cast("string").alias("relation_source_id"), "matched_fields", "match_reasons")
    if request.include_related and relations is not None:
        hop = one_hop(hits, relations, records, request)
        scores = hits.select(F.col("memory_id").alias("s_id"), F.coalesce("score", F.lit(0.0)).alias("s"))
        more = hop.join(scores, F.col("source_id") == F.col("s_id")).select(
            F.lit(1).alias("part"), (-F.col("s")).alias("by"), F.col("source_id").alias("by_id"), "memory_id", F.lit(None).cast("double").alias("score"),
            F.col("source_id").alias("relation_source_id"), F.array(F.lit("relations")).alias("matched_fields"), F.array(F.concat(F.lit("relation:"), "relation_type")).alias("match_reasons"),
        )
        out = out.unionByName(more)
    top = out.orderBy("part", "by", "by_id", "memory_id").limit(request.limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("part", "by", "by_id", "memory_id"))).select("rank", "memory_id", "score", "relation_source_id", "matched_fields", "match_reasons")


def description(content: Column, limit: int = 280) -> Column:
    """The lines that aren't headings of the first block that has any, joined; else all lines without their # signs."""
    def lines(block: Column) -> Column:
        trimmed = F.transform(F.split(block, "\n"), lambda x: F.trim(x))
        return F.array_join(F.filter(trimmed, lambda x: (x != "") & ~x.startswith("#")), " ")

    blocks = F.filter(F.transform(F.split(content, "\n\n"), lines), lambda x: x != "")
    plain = F.array_join(F.filter(F.transform(F.split(content, "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), "^#+", ""))), lambda x: x != ""), " ")
    return F.substring(F.when(F.size(blocks) > 0, F.get(blocks, F.lit(0))).otherwise(plain), 1, limit)


def request_problems(limit: Column, statuses: Column, relation_types: Column, include_related: Column, path: Column) -> Column:
    """What is wrong with requests that are rows: 'limit', 'statuses', 'relation_types', 'path'."""
    up = F.exists(F.split(path, "/"), lambda x: x.isin("..", ".", ""))
    return F.array_compact(F.array(
        F.when(F.coalesce(~limit.between(1, 1000), F.lit(True)), "limit"), F.when(F.coalesce(F.size(statuses), F.lit(0)) <= 0, "statuses"),
        F.when((F.coalesce(F.size(relation_types), F.lit(0)) > 0) & ~include_related, "relation_types"), F.when(F.coalesce(up, F.lit(False)), "path"),
    ))


def provenance(sources: Column) -> Column:
    """'type:locator' of each source, joined by ' | '; the locator is the first of uri, id and actor, else 'unknown'."""
    return F.array_join(F.transform(sources, lambda x: F.concat(x["type"], F.lit(":"), F.coalesce(x["uri"], x["id"], x["actor"], F.lit("unknown")))), " | ")


TABLES = ("memories", "tags", "relations", "terms")


def derive(records: DataFrame, relations: DataFrame) -> dict[str, DataFrame]:
    """The tables of a catalog from its records and their relations."""
    return {
        "memories": records,
        "tags": records.select("memory_id", F.posexplode("tags").alias("position", "tag")),
        "relations": relations,
        "terms": postings(records),
    }


def _figures(tables: dict[str, DataFrame]) -> DataFrame:
    """(key, value): counts of all tables and a digest of the memories."""
    counts = None
    for name, t in tables.items():
        one = t.agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit(f"{name}_count").alias("key"), "value")
        counts = one if counts is None else counts.unionByName(one)
    m = digest(tables["memories"], F.col("memory_id"), F.sha2("content", 256))
    return counts.unionByName(m.select(F.lit("digest").alias("key"), F.col("digest").alias("value")))


def rebuild(records: DataFrame, relations: DataFrame, folder: str) -> DataFrame:
    """Writes the catalog's tables and its metadata (key, value), each whole or not at all; the metadata come last."""
    spark = records.sparkSession
    for name, t in derive(records, relations).items():
        stores.replace(t, f"{folder}/{name}")
    written = {name: spark.read.parquet(f"{folder}/{name}") for name in TABLES}
    stores.replace(_figures(written), f"{folder}/metadata")
    return spark.read.parquet(f"{folder}/metadata")


def verify(spark: SparkSession, folder: str) -> DataFrame:
    """(key, stored, actual, ok): the metadata of a catalog against its tables as they are."""
    tables = {name: spark.read.parquet(f"{folder}/{name}") for name in TABLES}
    actual = _figures(tables).select(F.col("key").alias("a_key"), F.col("value").alias("actual"))
    stored = spark.read.parquet(f"{folder}/metadata").withColumnRenamed("value", "stored")
    j = stored.join(actual, F.col("key") == F.col("a_key"), "full_outer")
    return j.select(F.coalesce("key", "a_key").alias("key"), "stored", "actual", F.col("stored").eqNullSafe(F.col("actual")).alias("ok"))

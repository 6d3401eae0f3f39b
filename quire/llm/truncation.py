"""Detection of texts that lost their end, by the vocabulary of the corpus.

One pass of Arrow batches reads each text whole and gives a row per document (how its end looks) and
each task's counts: of words and of the pairs of characters of a wide script, each also where it ends a
sentence, of lines that need no full stop, and of how paragraphs and such lines end.  The counts are
summed, the known words and lines are laid out as the nodes of a trie that the asked ends can hit, and
the ends of the documents are looked up in it by equi-joins.  A missing full stop alone is never
evidence; see ``judged`` for what is.  What is collected is the list of different lengths of the asked
ends.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from operator import add

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.tokens import WIDE_CLASS
from quire.session import Stage, ship

#: A known token that never ends a sentence is a proper prefix of a known word if the words that go on are so many times as frequent.
DWARFED = 50
#: A token doesn't end sentences if it does so at most this many times less often than tokens do on the whole, where so many ends are expected.
RARELY, EXPECTED = 20, 4.0
#: A sentence of more words (a wide character is half of one) is a long one: too long for a caption or title.
LONG = 12
#: A line below this share of the widest line of its text, or any line of a text that is so narrow, ends on purpose.
SHORT_LINE, NARROW = 0.6, 40
#: An ending of at least this share of the lines of its source and kind is a usual one ...
USUAL = 0.005
#: ... and decides where the usual endings make up this share of the lines.
CONCENTRATED = 0.97
#: A length is a pile-up where it has at least so many different texts of a source and so many times the mean.
PILE_TEXTS, PILE_TIMES = 5, 20

#: Kinds of evidence.
REASONS = ("open", "word", "phrase", "line", "limit", "end", "sentence", "mark")

#: Marks of omission at the end of a text.
_MARKS = ("…", "...")
_BRACKETED = {"]": ("[", {"…", "...", "truncated", "cut", "more"}), ")": ("(", {"…", "...", "truncated", "continued", "more"})}
_STOP = re.compile(r"[.!?。！？](?:[\"'”’)\]）」』*_]|\s?\[\d+\])*$")
_ABBREVIATION = re.compile(r"\b(?:Fig|Figs|Eq|Eqs|No|Vol|Ch|Sec|vs|cf|e\.g|i\.e)\.$")
_GOES_ON = re.compile(r"[,;:，；：、(（\-–—]$")
_LIST = re.compile(r"\s*(?:[-*+]|\d{1,3}[.)])(?:\s+|$)")
_NARROW = "[^\\W\\d_" + WIDE_CLASS[1:]  # a letter that isn't of a wide script
_WORD = re.compile(rf"{_NARROW}+(?:['’-]{_NARROW}+)*")
_RUN = re.compile(WIDE_CLASS + "+")
_CLOSING = r"(?:[\"'”’)\]]|\s?\[\d+\])*"
_FULL_STOP = re.compile(r"[.!?](?=[\"'”’)\]\s]|$)")
_CITED = re.compile(r"(?:\s?\[\d+\])+$")
_ENDED_WIDE = re.compile(rf"({WIDE_CLASS}{{2}})(?=[\"'”’)\]）」』]*(?:\s?\[\d+\])*[。！？])")
#: A full stop that another sentence of the same paragraph follows.
_INNER = re.compile(rf"[。！？][”’」』）]*(?:\s?\[\d+\])*\s*(?=\S)|[.!?]{_CLOSING}\s+(?=[\"“(]*(?:[A-Z]|{WIDE_CLASS}))")
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
_BULLETS = frozenset("-*+0123456789")
_URL = re.compile(r"https?://\S*$")
_IMAGE = re.compile(r"!\[[^\]]*\]\([^()\s]+\)$")
_WIDE = re.compile(WIDE_CLASS)
_DIGITS = re.compile(r"\d+")
_TAGS = re.compile(r"<(/?)(table|div|thead|tbody|ul|ol|pre)\b[^>]*>", re.I)


def line_kind(line: str) -> tuple[str, str] | None:
    """(kind, content with digits masked) of a line that needs no full stop, else None."""
    s = line.strip()
    if "://" in s and (m := _URL.search(s)):
        return "url", m.group()
    if s.startswith("#"):
        return "heading", _DIGITS.sub("#", s.lstrip("#").strip())
    if s[:1] in _BULLETS and (m := _LIST.match(line)):
        return "list", _DIGITS.sub("#", line[m.end() :].strip())
    return None


def ended_words(low: str) -> Iterator[str]:
    """The words that stand before a full stop, citations and closing marks aside."""
    pieces = _FULL_STOP.split(low)
    for piece in pieces[:-1]:
        if piece.endswith("]"):
            piece = _CITED.sub("", piece)
        word = piece[piece.rfind(" ") + 1 :].rstrip("\"'”’)")
        if not word.isalpha():
            word = final_word(word)
        if word and not _WIDE.search(word):
            yield word


def last_word(content: str) -> str:
    parts = content.split()
    return parts[-1].lower() if parts else ""


def _without_mark(tail: str) -> str | None:
    """The text before the mark of omission at its end, None if there is none."""
    for mark in _MARKS:
        if tail.endswith(mark):
            return tail[: -len(mark)]
    opening, words = _BRACKETED.get(tail[-1:], ("", ()))
    at = tail.rfind(opening) if opening else -1
    return tail[:at] if at >= 0 and tail[at + 1 : -1].strip().lower() in words else None


def _trimmed(text: str) -> tuple[str, bool]:
    """The text without marks of omission and white space at its end, and whether it had such a mark."""
    tail, marked = text.rstrip(), False
    while (before := _without_mark(tail)) is not None and before.strip():
        tail, marked = before.rstrip(), True
    return tail, marked


def final_word(tail: str) -> str:
    """The letters at the end, with apostrophes and hyphens inside; empty if the text ends otherwise."""
    k = len(tail)
    while k and (tail[k - 1].isalpha() or (tail[k - 1] in "'’-" and k < len(tail))):
        k -= 1
    return tail[k:].lstrip("'’-")


def size(sentence: str) -> float:
    """Words, a wide character being half of one."""
    return len(_WORD.findall(sentence)) + len(_WIDE.findall(sentence)) / 2


def shape(paragraph: str) -> str:
    """'running' where a sentence of it has ended before the last, else 'long' or 'short'."""
    return "running" if _INNER.search(paragraph) else "long" if size(paragraph) > LONG else "short"


def last_shape(tail: str) -> tuple[str, bool]:
    """(shape, titled) of the paragraph at the end of a text.  A last line after one that ends on purpose
    is a paragraph of its own, as in verse or a name under a letter; titled: all longer words have capitals."""
    cut = 0
    for m in _PARAGRAPH.finditer(tail):
        cut = m.end()
    last = tail[cut:]
    lines = last.split("\n")
    if len(lines) > 1:
        before, own = lines[-2].strip(), lines[-1].strip()
        widest = max(map(len, tail.split("\n")))
        narrow = widest < NARROW or len(before) < SHORT_LINE * widest
        if narrow and own[:1].isupper() and size(own) <= LONG:
            last = own
    words = [w for w in _WORD.findall(last) if len(w) > 3]
    return shape(last), all(w[0].isupper() for w in words)


def ending(text: str) -> tuple[str, str, bool]:
    """(state, kind, marked) of the end of a text that isn't blank.

    state: 'cut' where the form alone shows that something is open, 'complete', or 'check' where the
    last line is of a kind that needs no full stop or is prose without one."""
    tail, marked = _trimmed(text)
    last = tail.rsplit("\n", 1)[-1].strip()
    if tail.endswith("�"):
        return "cut", "bytes", marked
    first = tail.lstrip()
    if first.startswith("{") or re.match(r"\[\s*[{\"\[]", first):
        try:
            json.loads(tail.strip(), strict=False)
            return "complete", "json", marked
        except ValueError:
            if not tail.endswith(("}", "]")) or tail.count("{") > tail.count("}") or tail.count('"') % 2:
                return "cut", "json", marked
            return "complete", "json", marked
    if first.startswith("---\n") and "\n---" not in first[3:]:
        return "cut", "front matter", marked
    fences = [x for x in tail.split("\n") if x.lstrip().startswith("```")]
    if len(fences) % 2 or (last.startswith("``") and last.strip("`") == "" and len(last) < 3):
        return "cut", "code", marked
    if last.startswith("```"):
        return "complete", "code", marked
    if tail.count("$$") % 2 or last == "$":
        return "cut", "formula", marked
    if tail.rfind("\\[") > tail.rfind("\\]"):
        return "cut", "formula", marked
    if last.endswith(("$$", "\\]")):
        return "complete", "formula", marked
    opened = Counter()
    for t in _TAGS.finditer(tail):
        opened[t.group(2).lower()] += -1 if t.group(1) else 1
    if any(n > 0 for n in opened.values()) or tail.rfind("<!--") > tail.rfind("-->") or re.search(r"<[a-zA-Z/!][^<>]*$", last):
        return "cut", "tag", marked
    if last.startswith("<") and last.endswith(">"):
        return "complete", "tag", marked
    if last.startswith("|"):
        lines = tail.split("\n")
        k = len(lines) - 1
        while k > 0 and lines[k - 1].strip().startswith("|"):
            k -= 1
        whole = last.endswith("|") and len(last) > 1 and last.count("|") >= lines[k].count("|")
        return ("complete" if whole else "cut"), "row", marked
    if _IMAGE.search(last):
        return "complete", "image", marked
    if last.startswith("!["):
        return "cut", "image", marked
    if _STOP.search(last) and not _ABBREVIATION.search(last):
        return "complete", "prose", marked
    kind = line_kind(tail.rsplit("\n", 1)[-1])
    if kind:
        return "check", kind[0], marked
    return ("cut" if _GOES_ON.search(last) or _ABBREVIATION.search(last) else "check"), "prose", marked


def prose_end(line: str) -> str | None:
    """How a stripped line of prose ends: '.' for any full stop, else its last word; None if it isn't prose."""
    if line.startswith(("|", "<", "![", "$$", "---", "***", "===", "{", "```")) or line.endswith(("$$", "\\]", "---")) or _GOES_ON.search(line):
        return None
    return "." if _STOP.search(line) and not _ABBREVIATION.search(line) else last_word(line)


_SCHEMA = (
    "what STRING, doc_id BIGINT, source STRING, kind STRING, text STRING, n BIGINT, e BIGINT, word STRING, pair STRING, end STRING, state STRING, "
    "marked BOOLEAN, bytes BIGINT, same BIGINT, shape STRING, lower BOOLEAN, titled BOOLEAN"
)
_ARROW = {"STRING": pa.string(), "BIGINT": pa.int64(), "BOOLEAN": pa.bool_()}


def _read(documents: DataFrame) -> DataFrame:
    ship(documents.sparkSession)
    kinds = pa.schema([(name, _ARROW[kind]) for name, kind in (x.split() for x in _SCHEMA.split(", "))])
    pad = (None,) * (len(kinds) - 7)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs, last_words, last_pairs, lines, ends = (Counter() for _ in range(6))

        def counted() -> pa.RecordBatch:
            rows = [("word", None, None, "word", w, n, last_words.get(w, 0), *pad) for w, n in words.items()]
            rows += [("word", None, None, "pair", w, n, last_pairs.get(w, 0), *pad) for w, n in pairs.items()]
            rows += [("line", None, None, k, x, n, None, *pad) for (k, x), n in lines.items()]
            rows += [("end", None, s, k, x, n, None, *pad) for (s, k, x), n in ends.items()]
            for c in (words, pairs, last_words, last_pairs, lines, ends):
                c.clear()
            return batch(rows)

        for b in batches:
            rows = []
            for d, source, text in zip(*(c.to_pylist() for c in b.columns)):
                if not text or text.isspace():
                    continue
                state, kind, marked = ending(text)
                tail, _ = _trimmed(text)
                raw = text.encode("utf-8", "replace")
                final = final_word(tail)
                inside = tail[: len(tail) - len(final)].replace("-\n", "")  # a word broken at a line end is one word
                low = inside.lower()
                words.update(_WORD.findall(low))
                last_words.update(ended_words(low))
                for r in _RUN.findall(inside):
                    pairs.update(map(add, r, r[1:]))
                last_pairs.update(_ENDED_WIDE.findall(inside))
                parts, fenced, opened = tail.split("\n"), False, 0
                for i, line in enumerate(parts):
                    k = line_kind(line)
                    ends_here = i + 1 < len(parts) and not parts[i + 1].strip()
                    if line.lstrip().startswith("```"):
                        fenced = not fenced
                    elif k is None and not fenced and kind != "json" and ends_here and line.strip():
                        end = prose_end(line.strip())  # a paragraph inside the text is whole
                        if end is not None:
                            ends[source, shape("\n".join(parts[opened : i + 1])), "." if end == "." else ""] += 1
                    if k:
                        ends[source, k[0], last_word(k[1])] += 1
                        if i < len(parts) - 1:
                            lines[k] += 1
                    if ends_here or k:
                        opened = i + 1
                k = line_kind(parts[-1]) if state == "check" else None
                wide = bool(_WIDE.search(tail[-1:]))
                word = final.lower() if final and not _WIDE.search(final) else None
                pair = tail[-2:] if wide and _WIDE.match(tail[-2:]) else None
                form, titled = last_shape(tail) if state == "check" and kind == "prose" else (None, None)
                rows.append(("doc", d, source, kind, k[1] if k else None, len(text), None, word, pair, last_word(k[1]) if k else None, state, marked, len(raw), xxhash.xxh64_intdigest(raw) - (1 << 63), form, final[:1].islower(), titled))
            yield batch(rows)
            if len(words) + len(pairs) + len(lines) + len(ends) > 300_000:
                yield counted()
        yield counted()

    return documents.select("doc_id", "source", "text").mapInArrow(run, _SCHEMA)


def _same(a: str, b: str, *keys: str) -> list[Column]:
    return [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]


def _known(stage: Stage, raw: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kind, text, is_prefix, ends_nothing) of the final tokens asked for, and (kind, text) of the last
    lines that are no known line but a proper prefix of lines known from two places.

    The nodes of the trie that can be hit are those at the lengths of the asked ends, so each known word
    or line is laid out at those only; a node is named by its length and two hashes."""
    entries = stage.write(raw.filter("what IN ('word', 'line')").groupBy("kind", "text").agg(F.sum("n").alias("n"), F.sum("e").alias("e")), "entries")
    checked = docs.filter("state = 'check'")
    asked = stage.write(
        checked.select(F.explode(F.array(
            F.struct(F.lit("word").alias("kind"), F.col("word").alias("text")), F.struct(F.lit("pair").alias("kind"), F.col("pair").alias("text")), F.struct(F.col("kind").alias("kind"), F.col("line").alias("text")),
        )).alias("x")).select("x.*").filter("length(text) > 0").distinct(), "asked",
    )
    lengths = [r.n for r in asked.filter("kind <> 'pair'").select(F.length("text").alias("n")).distinct().collect()]
    node = lambda c: F.struct(F.length(c).alias("l"), F.xxhash64(c).alias("h"), F.hash(c).alias("g"))
    at = F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]) if lengths else F.array().cast("array<int>"), lambda n: n < F.length("text"))
    trie = (
        entries.filter("kind <> 'pair'").select("kind", "n", F.explode(F.transform(at, lambda n: node(F.substring("text", F.lit(1), n)))).alias("node"))
        .groupBy("kind", "node.l", "node.h", "node.g").agg(F.sum("n").alias("mass"), F.max("n").alias("most"))
    ).alias("t")
    a = asked.withColumn("node", node(F.col("text"))).alias("a")
    known = (
        a.join(entries.alias("k"), (F.col("a.kind") == F.col("k.kind")) & (F.col("a.text") == F.col("k.text")), "left")
        .join(trie, (F.col("a.kind") == F.col("t.kind")) & (F.col("a.node.l") == F.col("t.l")) & (F.col("a.node.h") == F.col("t.h")) & (F.col("a.node.g") == F.col("t.g")), "left")
        .select("a.kind", "a.text", F.col("k.n"), F.coalesce("k.e", F.lit(0)).alias("e"), F.coalesce("mass", F.lit(0)).alias("mass"), F.coalesce("most", F.lit(0)).alias("most"))
    )
    known = stage.write(known, "known")
    # one row for either script: how often a token ends a sentence
    rate = entries.filter("kind IN ('word', 'pair')").groupBy(F.col("kind").alias("r_kind")).agg((F.sum("e") / F.sum("n")).alias("rate"))
    tokens = known.join(F.broadcast(rate), F.col("kind") == F.col("r_kind")).select(
        "kind", "text",
        ((F.col("mass") >= 2) & (F.col("kind") == "word") & (F.col("n").isNull() | ((F.col("e") == 0) & (F.col("n") * DWARFED <= F.col("mass"))))).alias("is_prefix"),
        ((F.col("n") * F.col("rate") >= EXPECTED) & (F.col("e") * RARELY <= F.col("n") * F.col("rate"))).alias("ends_nothing"),
    ).filter("is_prefix OR ends_nothing")
    lines = known.filter("kind NOT IN ('word', 'pair') AND n IS NULL AND most >= 2").select("kind", "text")
    return tokens, lines


def judged(documents: DataFrame) -> DataFrame:
    """(doc_id, source, n_chars, kind, marked, at_limit, is_cut, reason) of each text that isn't blank.

    reason, the first that holds: 'open' (a row, block, formula, tag or JSON value is open by its form, or
    a sentence by a comma, colon or abbreviation at its end), 'word' (the final token is no known word, or one
    that never ends a sentence and is rare beside the words it begins, and a proper prefix of known ones),
    'phrase' (the final token, in small letters or a wide script, is known and common, but sentences don't
    end with it), 'line' (the last line is no known line but a proper prefix of known ones), 'limit' (the
    length in characters or bytes is one at which texts of the source pile up), 'end' (the last word never
    ends a line of its kind in a source whose lines nearly all end in few ways), 'sentence' (an earlier
    sentence of the last paragraph has its full stop, or the last one is too long for a caption, and the
    paragraphs of that shape inside the texts of the source nearly all end with one, as they do on the whole where it has none), 'mark' (a
    mark of omission follows); else null.

    All but 'open' hold only for ends without a full stop.  Such an end alone is no evidence: a caption,
    title, verse, name or date that ends with a word that can end a sentence stays unflagged; a word with a
    capital in a short titled paragraph isn't judged as a prefix, as it may be a name.
    at_limit never overrules a complete end, as texts of just that length can be whole.

    A null source is a source like any other; null, empty and blank texts give no rows; repeated rows
    and equal texts are judged one by one.  An empty table gives no rows.
    """
    stage = Stage(documents.sparkSession, "truncation")
    raw = stage.write(_read(documents), "read")
    docs = raw.filter("what = 'doc'").select("doc_id", "source", "kind", F.col("text").alias("line"), "word", "pair", "end", "state", "marked", F.col("n").alias("n_chars"), "bytes", "same", "shape", "lower", "titled")
    tokens, lines = _known(stage, raw, docs)
    ends = raw.filter("what = 'end'").groupBy("source", "kind", F.col("text").alias("end")).agg(F.sum("n").alias("n"))
    prose = F.col("kind").isin("running", "long", "short")
    total = ends.filter(~prose).groupBy("source", "kind").agg(F.sum("n").alias("total"))
    shares = ends.filter(~prose).alias("a").join(total.alias("b"), _same("a", "b", "source", "kind")).select(
        "a.source", "a.kind", "end", "n", ((F.col("n") >= 3) & (F.col("n") >= F.col("total") * USUAL)).alias("usual"), "total"
    )
    cover = shares.groupBy("source", "kind").agg((F.sum(F.when(F.col("usual"), F.col("n")).otherwise(0)) / F.max("total")).alias("cover"))
    usual = shares.filter("usual").select("source", "kind", "end")
    with_stop = F.sum(F.when(F.col("end") == ".", F.col("n")).otherwise(0))
    shapes = ends.filter(prose).groupBy("source", F.col("kind").alias("shape")).agg((with_stop / F.sum("n")).alias("stopped"))
    overall = ends.filter(prose).groupBy(F.col("kind").alias("o_shape")).agg((with_stop / F.sum("n")).alias("o_stopped"))
    # copies of a text have its length by nature, so they count once
    lengths = docs.select("source", "n_chars", "bytes", "same").distinct().select("source", F.explode(F.array(F.struct(F.lit("n_chars").alias("unit"), F.col("n_chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length")))).alias("x")).groupBy("source", "x.unit", "x.length").agg(F.count(F.lit(1)).alias("n"))
    mean = lengths.groupBy("source", "unit").agg(F.avg("n").alias("mean"))
    piles = lengths.alias("a").join(mean.alias("b"), _same("a", "b", "source", "unit")).filter((F.col("n") >= PILE_TEXTS) & (F.col("n") >= PILE_TIMES * F.col("mean"))).select("a.source", "a.unit", "length")
    chars = piles.filter("unit = 'n_chars'").select("source", F.col("length").alias("n_chars"))
    octets = piles.filter("unit = 'bytes'").select("source", F.col("length").alias("bytes"))

    d = docs.alias("d")
    d = d.join(chars.alias("c"), _same("d", "c", "source", "n_chars"), "left").join(octets.alias("o"), _same("d", "o", "source", "bytes"), "left")
    d = d.select("d.*", (F.col("c.n_chars").isNotNull() | F.col("o.bytes").isNotNull()).alias("at_limit")).alias("d")
    checked = F.col("d.state") == "check"
    d = d.join(tokens.alias("w"), checked & (F.col("w.kind") == F.when(F.col("d.word").isNotNull(), "word").otherwise("pair")) & (F.coalesce("d.word", "d.pair") == F.col("w.text")), "left")
    d = d.join(lines.alias("l"), checked & (F.col("d.kind") == F.col("l.kind")) & (F.col("d.line") == F.col("l.text")), "left")
    d = d.join(cover.alias("v"), _same("d", "v", "source", "kind"), "left").join(usual.alias("u"), _same("d", "u", "source", "kind", "end"), "left")
    d = d.join(shapes.alias("s"), _same("d", "s", "source", "shape"), "left").join(F.broadcast(overall), F.col("d.shape") == F.col("o_shape"), "left")  # three rows
    prose = F.col("d.kind") == "prose"
    name = F.coalesce("d.titled", F.lit(False)) & (F.col("d.shape") == "short") & ~F.col("d.lower")
    stopped = F.coalesce("s.stopped", "o_stopped", F.lit(1.0)) >= CONCENTRATED
    reason = (
        F.when(F.col("d.state") == "cut", "open")
        .when(checked & F.col("w.is_prefix") & ~(prose & name & ~F.col("at_limit")), "word")
        .when(checked & prose & F.col("w.ends_nothing") & (F.col("d.lower") | F.col("d.pair").isNotNull()), "phrase")
        .when(checked & F.col("l.text").isNotNull(), "line")
        .when(checked & F.col("at_limit") & (prose | (F.col("u.kind").isNull() & (F.col("d.end") == ""))), "limit")
        .when(checked & ~prose & F.col("u.kind").isNull() & (F.coalesce("v.cover", F.lit(0.0)) >= CONCENTRATED), "end")
        .when(checked & prose & F.col("d.shape").isin("running", "long") & stopped, "sentence")
        .when(checked & F.col("d.marked"), "mark")
    )
    return d.select("d.doc_id", "d.source", "d.n_chars", "d.kind", "d.marked", "at_limit", reason.isNotNull().alias("is_cut"), reason.alias("reason"))


def found(documents: DataFrame) -> DataFrame:
    """(doc_id): the documents whose text was cut, each id once."""
    return judged(documents).filter("is_cut").select("doc_id").distinct()


def by_source(documents: DataFrame) -> DataFrame:
    """(source, texts, cut, cut_share, at_limit, by_open, by_word, ...): how often each source truncates and on
    which evidence; blank texts don't count."""
    return judged(documents).groupBy("source").agg(
        F.count(F.lit(1)).alias("texts"), F.sum(F.col("is_cut").cast("bigint")).alias("cut"),
        F.avg(F.col("is_cut").cast("double")).alias("cut_share"), F.sum(F.col("at_limit").cast("bigint")).alias("at_limit"),
        *[F.count_if(F.col("reason") == r).alias(f"by_{r}") for r in REASONS],
    )

"""Repair of text from scanned pages.

One pass over all nodes counts the words of text that has no page layout, and picks out the nodes that
have one.  Of those, lines are matched with the titles of their file and with lines that recur in it
(running headers), numbers with the pages of the node, and words with the counted ones of the same
glyph skeleton.  All matching is by equi-joins on words or on (document_id, line key); the only
broadcast is a fixed number of the commonest words, which spares most words the join.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.tokens import WIDE_CLASS
from quire.session import Stage, ship

#: A node has page layout if most of its lines are at most so wide; a wide character counts twice.
LINE_WIDTH = 100
#: A word is known from so many occurrences in text without page layout, unless a word that it can be a
#: misreading of is so many times as frequent: in a large corpus misreadings occur there too.
KNOWN, DWARFED = 3, 2_000
#: Commonest words that are sent to all tasks, so that they needn't be joined.
COMMON = 5_000
#: Words of up to so many letters are also checked by their neighbours, as a misreading may be a word itself.
CONTEXT_LETTERS = 3

#: A line apart from the text is a running header wherever it stands if it recurs in each of so many files.
FILES = 2

#: Pairs of glyph strings that scanning confuses.
CONFUSED = (
    ("e", "c"), ("a", "o"), ("o", "0"), ("s", "5"), ("t", "f"), ("i", "!"), ("i", "1"), ("i", "l"), ("i", "|"), ("l", "1"), ("l", "!"),
    ("l", "|"), ("n", "ri"), ("d", "cl"), ("u", "ii"), ("h", "b"), ("h", "li"), ("m", "rn"), ("g", "9"), ("g", "q"), ("w", "vv"), ("b", "6"), ("z", "2"), ("t", "7"), ("nn", "rm"),
)
#: The skeleton of a word: glyphs that take part in the same confusions get the same letters.
_ONE = ("l1!|jr5$0ace9q62f7", "iiiiiissooooggbztt")
_MANY = (("m", "iii"), ("n", "ii"), ("h", "ii"), ("b", "ii"), ("u", "ii"), ("d", "oi"), ("w", "vv"))
_TABLE = str.maketrans(*_ONE)
_PUNCTUATED = str.maketrans("!|$", "iii")

MARKS = "-­¬‐"
_WIDE = re.compile(WIDE_CLASS)
_TOKEN = re.compile(r"[^\W_!|$](?:[^\W_]|[!|$])*(?:['’-](?:[^\W_]|[!|$])+)*|[!|](?:[^\W_]|[!|$])+(?:['’-](?:[^\W_]|[!|$])+)*")
_LAST = re.compile(r"((?:[^\W_]|[!|$])+(?:['’-](?:[^\W_]|[!|$])+)*)[" + MARKS + r"]$")
_NUMBER = r"[0-9lI|!OoSsgqBZzi]{1,6}"
_EDGE = r"[-–—•·*~|]*"
_OF = rf"(?:\s*(?:of|0f|/|，?\s*共)\s*{_NUMBER}\s*页?)?\s*页?\s*{_EDGE}[\])]?$"
_BARE = re.compile(rf"^[\[(]?{_EDGE}\s*(?P<word>第)?\s*(?P<n>{_NUMBER}){_OF}")
_WORDED = re.compile(rf"^[\[(]?{_EDGE}\s*(?P<word>[A-Za-z0-9!|]{{1,5}})[.:]?\s*(?P<n>{_NUMBER}){_OF}")
_DIGIT = str.maketrans("lI|!iOoSsgqBZz", "11111005599822")
_LEFT = re.compile(rf"^\s*{_NUMBER}(?:\s*[|·—–/:-]\s*|\s{{2,}})(?=\S)")
_RIGHT = re.compile(rf"(?<=\S)(?:\s*[|·—–/-]\s*|\s{{2,}}){_NUMBER}\s*$")
_TERMINAL = re.compile(r"[.!?。！？,，;；:：]$")
_DIGITS = re.compile(r"\d+")
_NOISE = re.compile(r"[\W_]+")
_RANGE = re.compile(r"(\d+)(?:\s*[-–—~]\s*(\d+))?")


def skeleton(word: str) -> str:
    s = word.lower().translate(_TABLE)
    for a, b in _MANY:
        s = s.replace(a, b)
    return s


def skeleton_column(c: Column) -> Column:
    c = F.translate(F.lower(c), *_ONE)
    for a, b in _MANY:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


_PAIRS = tuple({(a, b) for a, b in CONFUSED} | {(b, a) for a, b in CONFUSED})


@lru_cache(maxsize=100_000)
def confusions(seen: str, word: str) -> int:
    """The least number of confusions that make `word` look like `seen`, or 99."""
    # equal ends take no confusion; two glyphs of them stay, as the longest forms have two
    k = 0
    while k < min(len(seen), len(word)) and seen[k] == word[k]:
        k += 1
    seen, word = seen[max(0, k - 2) :], word[max(0, k - 2) :]
    k = 0
    while k < min(len(seen), len(word)) and seen[-1 - k] == word[-1 - k]:
        k += 1
    seen, word = (x[: len(x) - max(0, k - 2)] for x in (seen, word))
    n, m = len(seen), len(word)
    best = [[99] * (m + 1) for _ in range(n + 1)]
    best[0][0] = 0
    for i in range(n + 1):
        for j in range(m + 1):
            k = best[i][j]
            if k >= 99:
                continue
            if i < n and j < m and seen[i] == word[j]:
                best[i + 1][j + 1] = min(best[i + 1][j + 1], k)
            for a, b in _PAIRS:
                if seen.startswith(a, i) and word.startswith(b, j):
                    x, y = i + len(a), j + len(b)
                    best[x][y] = min(best[x][y], k + 1)
    return best[n][m]


def misread_of(seen: str, candidates: list[tuple[int, str]]) -> tuple[str, int] | None:
    """The commonest candidate that `seen` can be a misreading of, with a confusion in every fourth letter at most."""
    for n, w in sorted(candidates, reverse=True):
        if w != seen and confusions(seen, w) <= 1 + len(w) // 4:
            return w, n
    return None


def pages_of(text: str | None) -> list[tuple[int, int]]:
    """'p. 3', '3-4', '1,2', 'pp. 5–6' as ranges; nothing for null or no number."""
    return [(int(a), int(b or a)) for a, b in _RANGE.findall(text or "")]


_PAGE_WORDS = frozenset(skeleton(w) for w in ("page", "p", "pg", "pp"))


def page_number(line: str, pages: list[tuple[int, int]]) -> bool:
    """Whether the line is nothing but the number of a page of the node.  Without known pages a bare
    number of up to three digits, or one with a mark or word for a page, is taken for one."""
    s = line.strip()
    m = _BARE.match(s)
    word = m["word"] if m else None
    if not m:
        m = _WORDED.match(s)
        if not m or skeleton(m["word"]) not in _PAGE_WORDS:
            return False
        word = m["word"]
    digits = m["n"].translate(_DIGIT)
    if not digits.isdigit():
        return False
    n = int(digits)
    if pages:
        return any(a <= n <= b for a, b in pages)
    return bool(word) or s != m["n"] or (m["n"].isdigit() and len(digits) <= 3)


def line_key(text: str) -> str:
    """What stays of a line under misreadings, case, spaces and punctuation."""
    return _NOISE.sub("", skeleton(text.translate(_PUNCTUATED)))


def header_keys(line: str) -> list[str]:
    """Keys of a line as it stands and without a page number on either side."""
    s = line.strip()
    forms = dict.fromkeys((s, _LEFT.sub("", s), _RIGHT.sub("", s)))
    return [k for k in dict.fromkeys(line_key(x) for x in forms) if len(k) > 1]


def width(line: str) -> int:
    return len(line) + len(_WIDE.findall(line))


def has_layout(text: str) -> bool:
    """Whether more than half of the lines that aren't blank fit a page; a wide one among them may be anything."""
    widths = sorted(width(x) for x in text.split("\n") if x.strip())
    return bool(widths) and widths[len(widths) // 2] <= LINE_WIDTH


def words_of(text: str) -> list[str]:
    found = _TOKEN.findall(text)
    if "!" in text or "|" in text or "$" in text:
        return [t for t in (m.rstrip("!|$") for m in found) if t]
    return found


def _is_word(t: str) -> bool:
    """Has a letter, isn't of a wide script, and isn't a label like K9."""
    return any(c.isalpha() for c in t) and not _WIDE.search(t) and not re.fullmatch(r"[A-Z]\d{1,4}", t)


#: Node types whose text counts for the vocabulary.
_PROSE = {"paragraph", "list", "blockquote", "reference", "heading"}


def _read(nodes: DataFrame) -> DataFrame:
    ship(nodes.sparkSession)

    kinds = pa.schema([("what", pa.string()), ("id", pa.int64()), ("document_id", pa.int64()), ("n", pa.int64()), ("key", pa.string()), ("text", pa.string()), ("apart", pa.bool_())])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)

    def counted(words: Counter, pairs: Counter) -> pa.RecordBatch:
        rows = [("word", None, None, n, w, None, None) for w, n in words.items()]
        rows += [("pair", None, None, n, f"{x} {y}", None, None) for (x, y), n in pairs.items() if len(x) <= CONTEXT_LETTERS or len(y) <= CONTEXT_LETTERS]
        words.clear()
        pairs.clear()
        return batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = Counter(), Counter()
        for b in batches:
            rows = []
            for i, d, kind, pages, text in zip(*(c.to_pylist() for c in b.columns)):
                if not text or kind not in _PROSE:
                    continue
                if kind == "heading":
                    k = line_key(text.strip().lstrip("#"))
                    if len(k) > 1:
                        rows.append(("title", None, d, None, k, None, re.match(r"\s*#(?!#)", text) is not None))
                if kind != "paragraph" or not has_layout(text):
                    w = words_of(text.lower())
                    words.update(w)
                    pairs.update(zip(w, w[1:]))
                    continue
                if i is None:
                    continue
                rows.append(("node", i, d, None, pages, text, None))
                spans, lines = pages_of(pages), [x.rstrip() for x in text.split("\n")]
                while lines and not lines[-1]:
                    lines.pop()
                full = max(width(x) for x in lines)
                for no, line in enumerate(lines):
                    if not line.strip() or _TERMINAL.search(line) or page_number(line, spans):
                        continue
                    before, after = lines[no - 1] if no else "", lines[no + 1] if no + 1 < len(lines) else ""
                    alone = not before.strip() or not after.strip() or page_number(before, spans) or page_number(after, spans)
                    head = after.split(None, 1)
                    short = bool(head) and width(line) + 1 + (2 if _WIDE.match(head[0]) else width(head[0])) <= full - 2
                    apart = len(lines) > 1 and (alone or short)
                    if not apart and line.lstrip()[0].islower():  # in the midst of the text, and no title
                        continue
                    keys = header_keys(line)
                    # the number of a page is gone from the last key; any other digits may differ between files
                    masked = (header_keys(_DIGITS.sub("0", line))[-1:] or keys[-1:]) if apart and _DIGITS.search(line) else keys[-1:]
                    for k in keys:
                        rows.append(("line", i, d, no + 1, k, masked[0], apart))
            yield batch(rows)
            if len(pairs) > 300_000:
                yield counted(words, pairs)
        yield counted(words, pairs)

    return nodes.select("id", "document_id", "node_type", "source_pages", "source_text").mapInArrow(
        run, "what STRING, id BIGINT, document_id BIGINT, n BIGINT, key STRING, text STRING, apart BOOLEAN"
    )


def _headers(raw: DataFrame) -> DataFrame:
    """(h_id, headers): the header lines of each node.  A line is one if it is the title of a heading of
    its file, or if it stands apart from the running text and recurs in another node of its file or,
    whatever its digits, does so in FILES files, or is the title of FILES files."""
    lines = raw.filter("what = 'line'").select("id", "document_id", F.col("n").alias("line_no"), "key", F.col("text").alias("masked"), "apart").distinct()
    titles = raw.filter("what = 'title'").select(F.col("document_id").alias("t_document_id"), F.col("key").alias("t_key")).distinct()
    by_title = lines.join(titles.hint("merge"), F.col("document_id").eqNullSafe(F.col("t_document_id")) & (F.col("key") == F.col("t_key")), "left_semi")
    apart = lines.filter("apart")
    recurring = (
        apart.groupBy(F.col("document_id").alias("r_document_id"), F.col("key").alias("r_key")).agg(F.count_distinct("id").alias("nodes")).filter("nodes >= 2")
    )
    by_file = apart.join(recurring.hint("merge"), F.col("document_id").eqNullSafe(F.col("r_document_id")) & (F.col("key") == F.col("r_key")), "left_semi")
    again = apart.groupBy("document_id", "masked").agg(F.count_distinct("id").alias("nodes")).filter("nodes >= 2")
    everywhere = again.groupBy(F.col("masked").alias("e_key")).agg(F.count(F.lit(1)).alias("files")).filter(F.col("files") >= FILES)
    by_all = apart.join(everywhere.hint("merge"), F.col("masked") == F.col("e_key"), "left_semi")
    books = raw.filter("what = 'title' AND apart").groupBy(F.col("key").alias("b_key")).agg(F.count_distinct("document_id").alias("files")).filter(F.col("files") >= FILES)
    by_book = apart.join(books.hint("merge"), F.col("key") == F.col("b_key"), "left_semi")
    found = by_title.unionByName(by_file).unionByName(by_all).unionByName(by_book)
    return found.groupBy(F.col("id").alias("h_id")).agg(F.collect_set("line_no").alias("headers"))


def _vocabulary(stage: Stage, raw: DataFrame) -> DataFrame:
    v = raw.filter("what = 'word'").groupBy(F.col("key").alias("word")).agg(F.sum("n").alias("n")).filter(F.col("n") >= KNOWN)
    return stage.write(v.withColumn("skel", skeleton_column(F.col("word"))), "vocabulary")


def line_kinds(lines: list[str], spans: list[tuple[int, int]], headers: set[int]) -> list[str]:
    return ["blank" if not x.strip() else "page_number" if page_number(x, spans) else "header" if no in headers else "text" for no, x in enumerate(lines, 1)]


def _scan(nodes: DataFrame, common: list[str], twins: dict[str, list[str]]) -> DataFrame:
    """Of each node its page numbers and headers, the words that need a look-up, and the words broken at a line end."""
    known = nodes.sparkSession.sparkContext.broadcast((frozenset(common), twins))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common, twins = known.value
        for b in batches:
            rows = []
            for i, pages, text, headers in zip(b["id"], b["pages"], b["text"], b["headers"]):
                lines = [x.rstrip() for x in text.split("\n")]
                kinds = line_kinds(lines, pages_of(pages), set() if headers is None else {int(x) for x in headers})
                rows += [(i, no, k, None, None, None, None, None) for no, k in enumerate(kinds, 1) if k in ("page_number", "header")]
                running = [no for no, k in enumerate(kinds) if k == "text"]
                cut_first = False
                for at, no in enumerate(running):
                    line = lines[no]
                    after = running[at + 1] if at + 1 < len(running) else None
                    words = words_of(line)
                    if cut_first and words:
                        words = words[1:]
                    cut_first = False
                    head = _TOKEN.match(lines[after].lstrip()) if after is not None else None
                    m = _LAST.search(line) if head else None
                    mark = line[-1] if m else ""
                    if head and not m and _WIDE.search(line) and re.search(r"[A-Za-z0-9!|]$", line) and words and _is_word(words[-1]):
                        m = re.search(r"((?:[^\W_]|[!|$])+)$", line)  # text of a wide script is broken anywhere, without a mark
                        if _WIDE.search(m.group(1)):
                            m = re.search(r"([A-Za-z0-9!|$]+)$", line)
                    if m and head and any(c.isalpha() for c in m.group(1)) and any(c.isalpha() for c in head.group()):
                        a, c = m.group(1).lower(), head.group().rstrip("!|$").lower()
                        rows.append((i, no + 1, "break", mark, a, c, after + 1, None))
                        words, cut_first = words[:-1], True
                    low = [x.lower() for x in words]
                    seen = set()
                    for k, (w, x) in enumerate(zip(words, low)):
                        if x in twins and k and k + 1 < len(low):
                            rows += [(i, no + 1, "context", low[k - 1], x, low[k + 1], None, y) for y in twins[x]]
                        if x in common or x in seen or not _is_word(w):
                            continue
                        seen.add(x)
                        rows.append((i, no + 1, "word", None, x, None, None, None))
            out = pd.DataFrame(rows, columns=["node_id", "line_no", "what", "mark", "a", "b", "next_no", "twin"])
            yield out.astype({"node_id": "Int64", "line_no": "Int64", "next_no": "Int64"})

    return nodes.select("id", "pages", "text", "headers").mapInPandas(
        run, "node_id BIGINT, line_no INT, what STRING, mark STRING, a STRING, b STRING, next_no INT, twin STRING"
    )


def _look_up(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, n, best, best_n): the count of each token itself and the word that it is a misreading of."""
    # numbers share few skeletons and are never what a word should be
    classes = vocabulary.filter(F.col("word").rlike(r"\p{L}")).groupBy(F.col("skel").alias("c_skel")).agg(F.collect_list(F.struct("n", "word")).alias("c"), F.max("n").alias("most"))

    @F.pandas_udf("best STRING, best_n BIGINT")
    def best(token: pd.Series, n: pd.Series, c: pd.Series) -> pd.DataFrame:
        out = []
        for t, own, cands in zip(token, n, c):
            x = None
            if cands is not None:
                x = misread_of(t, [(int(y["n"]), y["word"]) for y in cands if y["n"] >= DWARFED * own and any(ch.isalpha() for ch in y["word"])])
            out.append(x or (None, None))
        return pd.DataFrame(out, columns=["best", "best_n"]).astype({"best_n": "Int64"})

    t = tokens.withColumn("skel", skeleton_column(F.col("token")))
    t = t.join(vocabulary.select("word", "n").hint("merge"), F.col("token") == F.col("word"), "left").join(classes.hint("merge"), F.col("skel") == F.col("c_skel"), "left")
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    asked = F.coalesce(F.col("most") >= DWARFED * n, F.lit(False))
    unknown = t.filter(asked).withColumn("x", best("token", n, "c")).select("token", F.when(F.col("x.best").isNull(), n).otherwise(0).alias("n"), "x.best", "x.best_n")
    rest = t.filter(~asked).select("token", n.alias("n"), F.lit(None).cast("string").alias("best"), F.lit(None).cast("bigint").alias("best_n"))
    return unknown.unionByName(rest)


def _edge(seen: Column, best: Column, cut: Column) -> tuple[Column, Column]:
    """Whether the part of `seen` that differs from `best` reaches into the characters before and after `cut`."""
    n, m = F.length(seen), F.length(best)
    least = F.least(n, m)
    same = lambda f: F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), least), f)), F.lit(0))
    p = same(lambda k: F.substring(seen, F.lit(1), k) == F.substring(best, F.lit(1), k))
    q = same(lambda k: F.right(seen, k) == F.right(best, k))
    return p < cut, (n - q) > cut


def findings(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, scanned nodes).  lines: (node_id, line_no, noise_kind, a, best, next_no): one row per finding;
    for 'characters' a is the word as read and best as it should be, for 'hyphen' next_no is the line in
    which the word goes on."""
    stage = Stage(nodes.sparkSession, "scans")
    raw = stage.write(_read(nodes), "read")
    vocabulary = _vocabulary(stage, raw)
    common = {r.word: r.n for r in vocabulary.orderBy(F.desc("n"), "word").limit(COMMON).collect()}
    short = [w for w in common if len(w) <= CONTEXT_LETTERS and w.isalpha()]
    twins = {w: t for w in short if (t := [x for x in short if x != w and confusions(w, x) == 1])}
    scanned = raw.filter("what = 'node'").groupBy("id").agg(F.min(F.struct("text", F.col("key").alias("pages"))).alias("s")).select("id", "s.*")
    scanned = scanned.join(_headers(raw).hint("merge"), F.col("id") == F.col("h_id"), "left").drop("h_id")
    scanned = stage.write(scanned, "scanned")
    seen = stage.write(_scan(scanned, list(common), twins), "seen")

    words, breaks = seen.filter("what = 'word'"), seen.filter("what = 'break'")
    breaks = breaks.select("node_id", "line_no", "next_no", "mark", "a", "b", F.concat("a", "b").alias("joined"), F.concat("a", F.lit("-"), "b").alias("dashed"))
    tokens = words.select(F.col("a").alias("token")).unionByName(breaks.select(F.explode(F.array("a", "b", "joined", "dashed")).alias("token"))).distinct()
    found = stage.write(_look_up(tokens, vocabulary), "found")
    bad = found.filter("best IS NOT NULL")
    characters = words.join(bad.hint("merge"), F.col("a") == F.col("token")).select("node_id", "line_no", "a", "best")

    # both parts and both ways to join them are looked up in one join
    names, keys = ("a", "b", "joined", "dashed"), breaks.columns
    parts = breaks.select("*", F.posexplode(F.array(*names)).alias("which", "part")).join(found.hint("merge"), F.col("part") == F.col("token"), "left")
    any_n = F.coalesce(F.when(F.col("n") > 0, F.col("n")), "best_n", F.lit(0))
    of = lambda k, c: F.max(F.when(F.col("which") == k, c))
    breaks = parts.groupBy(*keys).agg(*[of(k, any_n).alias(f"{x}_any") for k, x in enumerate(names)], *[of(k, F.col("best")).alias(f"{x}_best") for k, x in enumerate(names)])
    compound = (F.col("joined_any") == 0) & (F.col("dashed_any") == 0) & (F.col("a_any") > 0) & (F.col("b_any") > 0)
    marked = F.col("mark") != ""
    case = marked & ((F.col("mark").isin("­", "¬")) | ((F.col("dashed_any") <= F.col("joined_any")) & ~compound))
    breaks = stage.write(breaks.withColumn("case", case), "breaks")
    hyphens = breaks.filter("case").select("node_id", "line_no", F.lit("hyphen").alias("noise_kind"), F.col("joined").alias("a"), F.lit(None).cast("string").alias("best"), "next_no")
    whole = F.when(F.col("case") | (F.col("mark") == ""), F.struct(F.col("joined").alias("t"), F.col("joined_best").alias("best"))).otherwise(F.struct(F.col("dashed").alias("t"), F.col("dashed_best").alias("best")))
    split = breaks.withColumn("w", whole).filter("w.best IS NOT NULL").select("node_id", "line_no", "next_no", F.length("a").alias("cut"), "w.t", "w.best")
    first, second = _edge(F.col("t"), F.col("best"), F.col("cut"))
    split = split.withColumn("first", first).withColumn("second", second)
    characters = characters.unionByName(split.filter("first").select("node_id", "line_no", F.col("t").alias("a"), "best")).unionByName(
        split.filter("second").select("node_id", F.col("next_no").alias("line_no"), F.col("t").alias("a"), "best")
    )

    # a short word that is itself known: its neighbours must never go with it and often with its twin
    context = seen.filter("what = 'context'")
    triples = context.select(F.col("mark").alias("before"), "a", F.col("b").alias("after"), "twin").distinct()
    pairs = raw.filter("what = 'pair'").groupBy("key").agg(F.sum("n").alias("n"))
    looked = triples.select("*", F.explode(F.array(
        F.struct(F.concat_ws(" ", "before", "a").alias("key"), F.lit(True).alias("own")), F.struct(F.concat_ws(" ", "a", "after").alias("key"), F.lit(True).alias("own")),
        F.struct(F.concat_ws(" ", "before", "twin").alias("key"), F.lit(False).alias("own")), F.struct(F.concat_ws(" ", "twin", "after").alias("key"), F.lit(False).alias("own")),
    )).alias("x")).select("before", "a", "after", "twin", "x.*")
    score = looked.join(pairs.hint("merge"), "key", "left").groupBy("before", "a", "after", "twin").agg(
        F.sum(F.when(F.col("own"), F.coalesce("n", F.lit(0))).otherwise(0)).alias("own"), F.sum(F.when(~F.col("own"), F.coalesce("n", F.lit(0))).otherwise(0)).alias("other")
    ).filter("other >= 20 AND other >= 50 * own").select(F.col("before").alias("s_before"), F.col("a").alias("s_a"), F.col("after").alias("s_after"), F.col("twin").alias("s_twin"))
    odd = context.join(score.hint("merge"), (F.col("mark") == F.col("s_before")) & (F.col("a") == F.col("s_a")) & (F.col("b") == F.col("s_after")) & (F.col("twin") == F.col("s_twin")))
    characters = characters.unionByName(odd.select("node_id", "line_no", "a", F.col("twin").alias("best")))

    none = F.lit(None)
    lines = (
        seen.filter("what IN ('header', 'page_number')").select("node_id", "line_no", F.col("what").alias("noise_kind"), none.cast("string").alias("a"), none.cast("string").alias("best"), none.cast("int").alias("next_no"))
        .unionByName(hyphens)
        .unionByName(characters.select("node_id", "line_no", F.lit("characters").alias("noise_kind"), "a", "best", none.cast("int").alias("next_no")))
    )
    return lines, scanned


def found(nodes: DataFrame) -> DataFrame:
    """(node_id, line_no, noise_kind), each once.

    Lines are split at line feeds and numbered from 1; kinds are 'hyphen', 'characters', 'header' and
    'page_number'.  Only paragraphs whose lines all fit a page are looked at.  Null ids, null and blank
    texts give no rows; a repeated id counts once, with the least of its texts; a null document_id is a
    file like any other.  An empty table gives no rows.
    """
    lines, _ = findings(nodes)
    return lines.select("node_id", "line_no", "noise_kind").distinct()


def paragraphs(nodes: DataFrame) -> DataFrame:
    """(node_id, paragraph_no, text): the continuous text of the scanned nodes, without headers and page numbers, with
    misread words and broken lines mended.  A blank line that no header or page number explains ends a
    paragraph; lines of a wide script join without a space."""
    lines, scanned = findings(nodes)
    stage = Stage(nodes.sparkSession, "reflow")
    fixes = lines.groupBy(F.col("node_id").alias("f_id")).agg(F.collect_list(F.struct("line_no", "noise_kind", "a", "best", "next_no")).alias("fixes"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, text, fixes in zip(b["id"], b["text"], b["fixes"]):
                all_fixes = [] if fixes is None else list(fixes)
                drop = {f["line_no"] for f in all_fixes if f["noise_kind"] in ("header", "page_number")}
                hyphen = {f["line_no"]: f["next_no"] for f in all_fixes if f["noise_kind"] == "hyphen"}
                swap: dict[int, dict[str, str]] = {}
                for f in all_fixes:
                    if f["noise_kind"] == "characters":
                        swap.setdefault(f["line_no"], {})[f["a"]] = f["best"]
                lines = [x.strip() for x in text.split("\n")]
                glued = ""
                near = False  # a header or number stood since the last text line
                blank = False
                for no, line in enumerate(lines, 1):
                    if no in drop:
                        near = True
                        continue
                    if not line:
                        blank = True
                        continue
                    line, glued = glued + line, ""
                    if no in hyphen:
                        stem, _, last = line.rpartition(" ")
                        glued, line = last[:-1], stem

                    def mend(m: re.Match, own: dict[str, str] = swap.get(no, {})) -> str:
                        best = own.get(m.group().rstrip("!|$").lower())
                        return m.group() if best is None else best.capitalize() if m.group()[:1].isupper() else best

                    line = _TOKEN.sub(mend, line)
                    rows.append((i, no, line, blank and not near))
                    near = blank = False
                if glued:
                    rows.append((i, len(lines) + 1, glued, False))
            yield pd.DataFrame(rows, columns=["node_id", "line_no", "line", "opens"])

    kept = scanned.join(fixes.hint("merge"), F.col("id") == F.col("f_id"), "left").select("id", "text", "fixes").mapInPandas(run, "node_id BIGINT, line_no INT, line STRING, opens BOOLEAN")
    kept = stage.write(kept, "lines")
    by_node = Window.partitionBy("node_id").orderBy("line_no")
    kept = kept.withColumn("paragraph_no", (F.sum(F.col("opens").cast("int")).over(by_node) + 1).cast("int"))
    wide = lambda c: c.rlike(WIDE_CLASS)
    inside = Window.partitionBy("node_id", "paragraph_no").orderBy("line_no")
    before = F.lag("line").over(inside)
    # a hyphen that is part of its word joins the lines, as does a wide script
    space = F.when((wide(F.right(before, F.lit(1))) & wide(F.left("line", F.lit(1)))) | before.rlike(r"[^\W\d_][-‐]$"), "").otherwise(" ")
    kept = kept.withColumn("piece", F.concat(F.when(before.isNull(), "").otherwise(space), "line"))
    return kept.groupBy("node_id", "paragraph_no").agg(F.sort_array(F.collect_list(F.struct("line_no", "piece"))).alias("x")).select(
        "node_id", "paragraph_no", F.trim(F.array_join(F.col("x.piece"), "")).alias("text")
    )

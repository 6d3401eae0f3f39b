"""Byte-level BPE encoding of a corpus: a minimal perfect hash for whole pre-tokens, a heap for the rest.

The vocabulary (some 50 000 entries, whatever the corpus) is read once on the driver, turned into the
hash and broadcast; encoding is one pass of Arrow batches without a shuffle.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from quire.session import ship

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Different pre-tokens whose ids a task keeps at hand; the store is emptied when full.
MEMO = 300_000


class PerfectHash:
    """Minimal perfect hash of byte strings: each bucket of keys has a seed under which all its keys fall
    on free slots.  ``get`` compares the key in the slot, so a string that isn't a key gives None."""

    def __init__(self, items: dict[bytes, int], load: int = 4):
        n = max(1, len(items))
        self.buckets = n // load + 1
        self.seeds = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * n
        self.values = [0] * n
        groups: list[list[bytes]] = [[] for _ in range(self.buckets)]
        for k in items:
            groups[xxhash.xxh3_64_intdigest(k) % self.buckets].append(k)
        for b in sorted(range(self.buckets), key=lambda b: -len(groups[b])):
            seed = 1
            while groups[b]:
                slots = [xxhash.xxh3_64_intdigest(k, seed) % n for k in groups[b]]
                if len(set(slots)) == len(slots) and all(self.keys[s] is None for s in slots):
                    for k, s in zip(groups[b], slots):
                        self.keys[s], self.values[s] = k, items[k]
                    break
                seed += 1
            self.seeds[b] = seed

    def get(self, key: bytes) -> int | None:
        h = xxhash.xxh3_64_intdigest
        slot = h(key, self.seeds[h(key) % self.buckets]) % len(self.keys)
        return self.values[slot] if self.keys[slot] == key else None


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """BPE of one pre-token: a heap of the pairs by rank over a linked list of byte spans."""
    n = len(piece)
    end = list(range(1, n + 1))  # the part that starts at i ends at end[i]
    prev = list(range(-1, n - 1))
    alive = [True] * n
    heap = []
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n:
            continue
        j = end[i]
        if end[j] != stop:  # one of the two parts has grown since
            continue
        end[i], alive[j] = stop, False
        if stop < n:
            prev[stop] = i
            r = ranks.get(piece[i : end[stop]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        p = prev[i]
        if p >= 0:
            r = ranks.get(piece[p:stop])
            if r is not None:
                heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Text to ids.  Whole pre-tokens that the merges also give as one token are in the perfect hash."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        whole = {k: v for k, v in self.ranks.items() if len(k) == 1 or merge(k, self.ranks) == [v]}
        self.table = PerfectHash(whole)
        self.pattern = pattern
        self._setup()

    def _setup(self) -> None:
        self.find = regex.compile(self.pattern).findall
        self.memo: dict[str, list[int]] = {}

    def __getstate__(self):
        return {"ranks": self.ranks, "table": self.table, "pattern": self.pattern}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._setup()

    def _piece(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8", "surrogatepass")
        i = self.table.get(raw)
        ids = [i] if i is not None else merge(raw, self.ranks)
        if len(self.memo) >= MEMO:
            self.memo.clear()
        self.memo[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            get = self.memo.get
            for p in self.find(text):
                out += get(p) or self._piece(p)
        return out


def default_encoder(path: str | None = None, pattern: str | None = None) -> Encoder:
    """The encoder of byte_bpe_50k.  Both parameters default to what the package public_tokenizers gives."""
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN
    return Encoder(path, pattern)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, ids ARRAY<INT>): one row per row of ``df``, repeated keys included.

    A null and an empty text both have an empty list; a null key stays null.  An empty table gives no
    rows; other columns are ignored.
    """
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(default_encoder(path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value
        kind = pa.list_(pa.int32())
        for b in batches:
            ids = [encoder.encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, kind)], [key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids ARRAY<INT>")


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The columns ``keep`` and tokens BIGINT, the number of ids of each row's text."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(default_encoder(path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value
        for b in batches:
            n = [len(encoder.encode(t)) for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(n, pa.int64())], [*keep, "tokens"])

    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    return df.select(*keep, text).mapInArrow(run, f"{schema}, tokens BIGINT")

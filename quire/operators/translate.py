"""Translation of units by a function that the caller gives, with protected spans, retries, halving and fallback."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import markdown as M
from quire.session import ship

#: A chat function gets (unit_key, text with tokens) and gives (reply, finish_reason, prompt_tokens, completion_tokens).
Chat = Callable[[str, str], tuple[str, str, int, int]]


def extract_reply(raw: str, unit_key: str) -> str:
    """What stands between the marks of the unit in a reply, else the whole reply; trimmed, with a line feed."""
    begin, end = f"<<<UNIT:{unit_key}:BEGIN>>>", f"<<<UNIT:{unit_key}:END>>>"
    at = raw.find(begin)
    stop = raw.find(end, at + len(begin)) if at >= 0 else -1
    return (raw[at + len(begin) : stop] if stop >= 0 else raw).strip() + "\n"


def reply_between_marks(raw: Column, unit_key: Column) -> Column:
    """``extract_reply`` as a column."""
    begin, end = F.concat(F.lit("<<<UNIT:"), unit_key, F.lit(":BEGIN>>>")), F.concat(F.lit("<<<UNIT:"), unit_key, F.lit(":END>>>"))
    at = F.instr(raw, begin)
    rest = F.substring(raw, at + F.length(begin), F.length(raw))
    stop = F.instr(rest, end)
    inner = F.when((at > 0) & (stop > 0), F.substring(rest, F.lit(1), stop - 1)).otherwise(raw)
    return F.concat(F.regexp_replace(inner, r"^\s+|\s+\z", ""), F.lit("\n"))


class Failed(Exception):
    pass


def once(chat: Chat, key: str, text: str) -> tuple[str, int, int]:
    """One call for one text; protected spans must come back whole."""
    shielded, spans = M.protect(text)
    raw, reason, prompt, completion = chat(key, shielded)
    if reason not in ("stop", None, ""):
        raise Failed(f"finish_reason={reason}")
    back = M.restore(extract_reply(raw, key), spans)
    if back is None:
        raise Failed("protected spans were lost, repeated or changed")
    return back, prompt or 0, completion or 0


def flat(chat: Chat, key: str, text: str) -> tuple[str, int, int]:
    """A text in one go: spans that pass through stay as they are, the rest goes piece by piece; the counts are
    those of the last piece that was sent."""
    out, counts = [], (0, 0)
    for kind, piece in M.passthrough(text):
        if kind != "text" or not piece.strip():
            out.append(piece)
            continue
        lead, tail = piece[: len(piece) - len(piece.lstrip())], piece[len(piece.rstrip()) :]
        back, *counts = once(chat, key, piece.strip())
        out.append(lead + back.strip() + tail)
    return "".join(out), counts[0], counts[1]


def ladder(chat: Chat, key: str, text: str, retries: int) -> tuple[str, str, str | None, int, int, int]:
    """(translation, status, error, attempts, prompt tokens, completion tokens): retries, then both halves
    once, then the source text as a marked fallback."""
    error, attempts = "", 0
    for _ in range(retries + 1):
        attempts += 1
        try:
            out, p, c = once(chat, key, text)
            return out, "done", None, attempts, p, c
        except Exception as e:  # noqa: BLE001 - any failure of the given function leads down the ladder
            error = str(e)
    halves = M.bisect(text)
    if halves:
        try:
            parts = [once(chat, f"{key}:{s}", h) for s, h in zip("ab", halves)]
            joined = parts[0][0].rstrip() + "\n\n" + parts[1][0].strip() + "\n"
            return joined, "done", "bisected", attempts + 2, parts[0][1] + parts[1][1], parts[0][2] + parts[1][2]
        except Exception as e:  # noqa: BLE001
            error, attempts = str(e), attempts + 2
    return text.strip() + "\n", "fallback", error, attempts, 0, 0


def translate(units: DataFrame, chat: Chat, retries: int = 1, calls: int | None = None) -> DataFrame:
    """(id, status, translation_text, warning, attempts, prompt_tokens, completion_tokens) of the units that aren't done.

    ``chat`` runs in the workers and must be picklable; ``calls`` limits how many run at a time, by the
    number of partitions.  A unit that is done with text keeps it and isn't sent; null text is empty.
    """
    ship(units.sparkSession)
    todo = units.filter(~((F.col("status") == "done") & (F.coalesce(F.length("translation_text"), F.lit(0)) > 0)) | F.col("status").isNull())
    todo = todo.select("id", "unit_key", F.coalesce("source_text", F.lit("")).alias("source_text"))
    if calls:
        todo = todo.repartition(calls, "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *ladder(chat, k or "", t, retries)) for i, k, t in zip(b["id"], b["unit_key"], b["source_text"])]
            yield pd.DataFrame(rows, columns=["id", "translation_text", "status", "warning", "attempts", "prompt_tokens", "completion_tokens"])

    return todo.mapInPandas(run, "id BIGINT, translation_text STRING, status STRING, warning STRING, attempts INT, prompt_tokens BIGINT, completion_tokens BIGINT")


def echo(key: str, text: str) -> tuple[str, str, int, int]:
    """A function for tests: gives the text back between its marks, in capitals but for its tokens."""
    body = "".join(p if p.startswith("@@") else p.upper() for p in re.split(r"(@@[A-Z]+_\d{5}@@)", text))
    return f"<<<UNIT:{key}:BEGIN>>>{body}<<<UNIT:{key}:END>>>", "stop", len(text), len(body)

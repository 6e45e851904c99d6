"""Chat formatting by incremental black-box rendering.

A template is any function from the turns so far to text.  Its output is rendered for each prefix of
a conversation; what two consecutive outputs share is kept history, and what the later one adds is
the span of the new turn.  A template that changes earlier output is found by the same comparison.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Template = Callable[[list[tuple[str, str]]], str]
HEAD, CLOSE = "### ", " </turn>\n"
_ESCAPED = re.compile(r"\\|### |</turn>")
_UNESCAPED = re.compile(r"\\(\\|### |</turn>)")
_TURN = re.compile(r"### ((?:[^\\\n]|\\.)*?):\n((?:[^\\<]|\\.|<(?!/turn>))*) </turn>\n", re.S)


def escape(text: str) -> str:
    """Control strings with a backslash before them; backslashes doubled, so that nothing else looks so."""
    return _ESCAPED.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n").replace(":", "\\:")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|### |</turn>|n|:)", lambda m: "\n" if m[1] == "n" else m[1], role)


@lru_cache(maxsize=4096)
def _turn(role: str, text: str) -> str:
    return f"{HEAD}{escape_role(role)}:\n{escape(text)}{CLOSE}"


def turn_template(turns: list[tuple[str, str]]) -> str:
    """``### role:``, the text and ``</turn>``, with control strings escaped."""
    return "".join([_turn(role, text) for role, text in turns])


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end of the escaped text) of each turn that ``turn_template`` wrote."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape_role(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return out


def spans(turns: list[tuple[str, str]], template: Template) -> tuple[str, list[tuple[int, int]], bool]:
    """The whole output, the span of each turn in it, and whether some turn rewrote history.

    Every prefix is rendered.  While the last output stays as it is, the new turn's span is what
    follows it.  Where it changes, the outputs' common head is the history kept so far: spans that
    reach beyond it are cut there, the new turn's starts there, and the flag is set.
    """
    whole, found, _, rewrites = text_spans(turns, template, lambda role: False, escape)
    return whole, found, rewrites


def text_spans(turns: list[tuple[str, str]], template: Template, wanted: Callable[[str], bool], encode: Callable[[str], str]) -> tuple[str, list[tuple[int, int]], list[tuple[int, int] | None], bool]:
    """``spans`` with the place of each wanted role's text: the turn is rendered with a mark in place of the
    text too, and the text stands where the mark does.  A template that shows the mark elsewhere as well, or
    treats other texts otherwise, is rendered with an empty text: what the outputs don't share is the text."""
    before, found, texts, rewrites = template([]), [], [], False
    for k, (role, text) in enumerate(turns):
        now = template(turns[: k + 1])
        kept = len(before)
        if not now.startswith(before):
            rewrites, kept = True, _common(before, now)
            found = [(min(a, kept), min(b, kept)) for a, b in found]
            texts = [t and (min(t[0], kept), min(t[1], kept)) for t in texts]
        found.append((kept, len(now)))
        texts.append(_text_place(now, kept, lambda said, k=k, role=role: template([*turns[:k], (role, said)]), encode(text)) if wanted(role) else None)
        before = now
    return before, found, texts, rewrites


MARK = "\ue000"


def _text_place(now: str, kept: int, render: Callable[[str], str], shown: str) -> tuple[int, int]:
    marked = render(MARK)
    at = marked.find(MARK, kept)
    if at >= 0 and marked.count(MARK, kept) == 1 and len(marked) - len(MARK) + len(shown) == len(now) and now.startswith(shown, at):
        return at, at + len(shown)
    empty = render("")
    head, more = _common(now, empty), max(0, len(now) - len(empty))
    return min(head, len(now) - more), min(head, len(now) - more) + more


def _common(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def format_conversations(turns: DataFrame, template: Template = turn_template, encode: Callable[[str], str] = escape, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, turn_spans and loss_spans (code points, half open)
    of its turns and of the assistant's escaped texts, rewrites (the template changed earlier output).

    Turns are in order of ``turn``, nulls first, then role and text; a null role or text is empty; a
    null conv_id is a conversation.  A conversation's rows are needed together, as its output is one
    value.  ``encode`` is what the template does to a text; the text under the loss mask is found by
    rendering (an empty span where a template leaves the text out).
    """
    names = {"conv_id": conv_id, "turn": turn, "role": role, "text": text}
    rows = turns.select(*[F.col(c).alias(n) for n, c in names.items()])
    grouped = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(F.struct(
        F.coalesce(F.col("turn").cast("long"), F.lit(-(2**63))).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pairs = [(t["role"], t["text"]) for t in said]
                whole, where, texts, rewrites = text_spans(pairs, template, "assistant".__eq__, encode)
                loss = [t for t in texts if t]
                pick = lambda s: [{"start": x, "end": y} for x, y in s]
                out.append((conv, whole, pick(where), pick(loss), rewrites))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), span, span, pa.bool_()), strict=True)], ["conv_id", "formatted", "turn_spans", "loss_spans", "rewrites"])

    return grouped.mapInArrow(run, "conv_id long, formatted string, turn_spans array<struct<start:long,end:long>>, loss_spans array<struct<start:long,end:long>>, rewrites boolean")


def format_digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from the output: conv_id, n_turns, turns_sha256 (role, line end, text,
    line end per turn), loss_chars and loss_sha256 of all unescaped text under the loss spans, formatted_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, out = batch.to_pydict(), []
            for conv, whole, loss in zip(b["conv_id"], b["formatted"], b["loss_spans"], strict=True):
                read = parse(whole)
                said = "".join(f"{r}\n{t}\n" for r, t, _, _ in read)
                words = "".join(unescape(whole[s["start"] : s["end"]]) for s in loss)
                out.append((conv, len(read), hashlib.sha256(said.encode()).hexdigest(), len(words), hashlib.sha256(words.encode()).hexdigest(), len(whole)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

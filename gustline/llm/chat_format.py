"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. It is
never looked into: the turns of a conversation are rendered prefix by prefix,
and consecutive outputs are compared. What the longer output adds is the turn's
span. If the longer output doesn't begin with the shorter one, the template has
rewritten history at that turn: earlier spans no longer stand, and the turn is
reported as such. Two further renderings with a one-letter text show where the
text lies inside the span, for the loss mask.

``format_turns`` gives one row per turn, so no row holds a conversation;
``digests`` reads the formatted stream back and reduces it to one row per
conversation while it streams. A conversation is read in order by one task,
because a SHA-256 can't be put together from parts; the task holds only the
rendered window and the open turn, whatever the conversation's length.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain, groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustline.llm.common import col

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

START, END = "<|im_start|>", "<|im_end|>"
PROBES = ("0", "1")  # texts that differ from their first to their last letter
WINDOW_CHARS = 1 << 20  # a window that may be cut is cut beyond this
ROWS_PER_BATCH = 512
CHARS_PER_BATCH = 4 << 20

_OPENING = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)


def escape(text: str) -> str:
    """``text`` without any ``<|``: one more backslash between the two. Texts
    that already hold ``<\\|`` get another one, so it can be undone."""
    return _OPENING.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role in one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def im_template(turns: list[Turn]) -> str:
    """Marked turns, control strings inside roles and texts escaped."""
    return "".join(f"{START}{escape_role(r)}\n{escape(t)}{END}\n" for r, t in turns)


class Piece(NamedTuple):
    start: int  # code points of the earlier output that stay
    text: str  # what stands behind them
    inside: tuple[int, int] | None  # the turn's own text in it, None if not found
    rewrites: bool  # the earlier output was longer


def _inside(template: Template, before: list[Turn], shown: str, role: str, piece: str) -> tuple[int, int] | None:
    """Where a turn's text lies in its piece: the same turn with two other
    texts shows what stands around it."""
    a, b = (template([*before, (role, x)]) for x in PROBES)
    if not (a.startswith(shown) and b.startswith(shown)):
        return None
    a, b = a[len(shown):], b[len(shown):]
    head = os.path.commonprefix([a, b])
    tail = os.path.commonprefix([a[len(head):][::-1], b[len(head):][::-1]])[::-1]
    if a != head + PROBES[0] + tail or b != head + PROBES[1] + tail:
        return None
    if len(piece) < len(head) + len(tail) or not piece.startswith(head) or not piece.endswith(tail):
        return None
    return len(head), len(piece) - len(tail)


def rendered(turns: Iterator[Turn], template: Template, looked_for: frozenset[str] | None = None,
             window_turns: int | None = None) -> Iterator[Piece]:
    """The pieces of one conversation.

    Without ``window_turns`` every prefix is rendered whole: right for any
    template, at a cost that grows with the square of the length. With it, the
    prefixes start at most that many turns back (or ``WINDOW_CHARS`` code
    points): right for templates whose output for a turn depends on nothing
    but the turn itself and the one before it. At each cut the last turn is
    rendered as the first of the next window; a template that shows it
    differently there looks further back, and its window goes on growing.
    """
    window: list[Turn] = []
    shown, total, held = "", 0, 0
    limit = window_turns
    for role, text in turns:
        now = template([*window, (role, text)])
        stays = len(shown) if now.startswith(shown) else len(os.path.commonprefix([shown, now]))
        piece = now[stays:]
        rewrites = stays < len(shown)
        inside = None
        if not rewrites and (looked_for is None or role in looked_for):
            inside = _inside(template, window, shown, role, piece)
        yield Piece(total - (len(shown) - stays), piece, inside, rewrites)
        total += len(now) - len(shown)
        window.append((role, text))
        held += len(text)
        shown = now
        if limit is not None and (len(window) >= limit or held > WINDOW_CHARS):
            alone = template(window[-1:])
            if not rewrites and alone.endswith(piece):
                window, shown, held = window[-1:], alone, 0
            else:
                limit *= 2


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield tuple(c[k].as_py() for c in batch.columns)


def _batched(rows: Iterator[tuple], schema: pa.Schema, weight: int) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded length; ``weight`` is the place of the long string."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[weight] or "")
        if len(held) == ROWS_PER_BATCH or size > CHARS_PER_BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def format_turns(df: DataFrame, template: Template = im_template, loss_roles: tuple[str, ...] = ("assistant",),
                 window_turns: int | None = None, id_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """All conversations, formatted: one row per turn with ``id_col``,
    ``place`` (from 0), ``start`` (code points of the conversation's output
    before it), ``piece``, ``loss_start`` and ``loss_end`` (the text under the
    loss mask, in code points of the piece; NULL where there is none) and
    ``rewrites`` (the template changed earlier output; ``start`` is then where
    the change begins). The pieces of a conversation, put together in order,
    are its formatted text.

    Turns are in the order of ``turn_col``, then role and text, NULLs first;
    repeated rows are turns of their own. NULL text and role are empty. Rows
    without a conversation id form one conversation. An empty table gives an
    empty result; other columns, clashing names included, are left out. Each
    partition holds whole conversations in order.
    """
    key = df.schema[id_col].dataType
    schema = T.StructType([
        T.StructField(id_col, key), T.StructField("place", T.LongType()), T.StructField("start", T.LongType()),
        T.StructField("piece", T.StringType()), T.StructField("loss_start", T.LongType()),
        T.StructField("loss_end", T.LongType()), T.StructField("rewrites", T.BooleanType())])
    turns = df.select(col(id_col).alias("id"), col(turn_col).alias("turn"),
                      F.coalesce(col(role_col).cast("string"), F.lit("")).alias("role"),
                      F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    ordered = turns.repartition("id").sortWithinPartitions("id", "turn", "role", "text").select("id", "role", "text")
    looked_for = frozenset(loss_roles)

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        out = pa.schema([(id_col, first.schema.field(0).type), ("place", pa.int64()), ("start", pa.int64()),
                         ("piece", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()),
                         ("rewrites", pa.bool_())])

        def pieces() -> Iterator[tuple]:
            for conv, rows in groupby(_rows(chain([first], batches)), key=lambda r: r[0]):
                for place, p in enumerate(rendered(((r, t) for _, r, t in rows), template, looked_for, window_turns)):
                    yield (conv, place, p.start, p.text, *(p.inside or (None, None)), p.rewrites)

        yield from _batched(pieces(), out, 3)

    return ordered.mapInArrow(formatted, schema)


def digests(pieces: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row per conversation, read back from the formatted stream of
    ``im_template``: ``n_turns``, ``turns_sha256`` (role, line feed, text, line
    feed of each turn), ``loss_chars`` and ``loss_sha256`` (all text under the
    loss mask), ``formatted_chars``, ``rewrites`` (turns that changed earlier
    output). Roles and texts are unescaped.

    ``pieces`` holds whole conversations in order in each partition, as
    ``format_turns`` leaves them. Where a turn rewrote history, the earlier
    pieces no longer stand: the digests, and all but ``rewrites``, are NULL.
    Output that isn't made of marked turns raises an error.
    """
    schema = T.StructType([
        T.StructField(id_col, pieces.schema[id_col].dataType), T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()),
        T.StructField("rewrites", T.LongType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        out = pa.schema([(id_col, first.schema.field(0).type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                         ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
                         ("rewrites", pa.int64())])

        def rows() -> Iterator[tuple]:
            for conv, own in groupby(_rows(chain([first], batches)), key=lambda r: r[0]):
                yield (conv, *_read_back((p, a, b, w) for _, p, a, b, w in own))

        yield from _batched(rows(), out, 2)

    return pieces.select(col(id_col), "piece", "loss_start", "loss_end", "rewrites").mapInArrow(read, schema)


def _read_back(pieces: Iterator[tuple]) -> tuple:
    turns, loss = hashlib.sha256(), hashlib.sha256()
    n = loss_chars = chars = rewrites = 0
    rest = ""
    for piece, start, end, rewritten in pieces:
        rewrites += rewritten
        if rewrites:
            continue
        chars += len(piece)
        rest += piece
        at = 0
        while m := _TURN.match(rest, at):
            n += 1
            turns.update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
            at = m.end()
        rest = rest[at:]
        if start is not None:
            text = unescape(piece[start:end])
            loss_chars += len(text)
            loss.update(text.encode())
    if rewrites:
        return None, None, None, None, None, rewrites
    if rest:
        raise ValueError("formatted output ends within a turn")
    return n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, rewrites

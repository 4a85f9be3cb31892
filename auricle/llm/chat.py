r"""Chat formatting by incremental rendering of a template that is a black box.

A template is a function from a list of (role, text) to one string. It is rendered for successive prefixes of a
conversation; what a rendering adds to the one before is the span of its last turn. When a rendering does not
begin with the one before, the template rewrote history: the turn where that shows is reported and the
conversation has no spans from there on. Inside a span, rendering the turn with two other texts that differ
in every character tells the template's own head and tail from the content.

Rows of a conversation stream through one task in order. With ``history=None`` every prefix is rendered as a whole and
compared with the one before, so nothing has to be known of a template; that takes time with the square of a
conversation's turns, and a task holds its conversation's turns and three renderings. Two kinds of templates go without
whole prefixes, in memory that does not grow with a conversation, on their word, which nothing checks: one that says how
many turns it looks back (``Near``) is rendered for so many turns and the next; one that can go on from a state
(``Resumable``) for each turn alone.

With a ``history`` at most twice as many turns of such a black box are held: where it is cut, the last turn is rendered
again, and a template that looks further back (or refuses a history that begins in the middle) has no spans from there
on. Nothing was rewritten then, so this is a state of its own, ``cut``; rewriting that begins only beyond is not seen.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: What is known of a turn's rendering: earlier output is kept, was rewritten, or cannot be told since the history was cut.
KEPT, REWRITTEN, CUT = "kept", "rewritten", "cut"
HISTORY = 64
LOSS_ROLE = "assistant"
BEGIN, ROLE, TEXT, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROLS = (BEGIN, ROLE, TEXT, END)
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(\\?)")
_MARKED = re.compile(re.escape(BEGIN + ROLE) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END) + "\n", re.DOTALL)


def escape(text: str) -> str:
    r"""Doubles backslashes and breaks control strings by one after their first character."""
    text = text.replace("\\", "\\\\")
    if "<" in text or "[" in text:  # every control string begins so; whole prefixes escape a text many times
        text = _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def marked(turns: list[Turn]) -> str:
    """The template of this module: ``<s>[INST]role[/INST]text</s>`` and a line end for each turn."""
    return "".join(f"{BEGIN}{ROLE}{escape(r)}{TEXT}{escape(t)}{END}\n" for r, t in turns)


def read_marked(output: str) -> list[Turn]:
    """The turns of a ``marked`` output."""
    return [(unescape(r), unescape(t)) for r, t in _MARKED.findall(output)]


def _shared(a: str, b: str) -> int:
    """Length of the common beginning."""
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Resumable:
    """A template that goes on from a state, so that no earlier turn has to be rendered again.

    ``begin()`` gives (what is said before any turn, state); ``turn(state, (role, text))`` gives (what the turn adds,
    the next state). Output is only ever added to; a state is never changed in place.
    """

    def begin(self) -> tuple[str, object]:
        raise NotImplementedError

    def turn(self, state, turn: Turn) -> tuple[str, object]:
        raise NotImplementedError


@dataclass(frozen=True)
class Near:
    """A caller's word that a black box renders a turn by at most the ``reach`` turns before it and keeps earlier output, so
    that prefixes of the last turns add what whole prefixes would add. Whole prefixes are not rendered, so a template that
    rewrites history or looks further back goes unnoticed; ``history=None`` without ``Near`` takes nobody's word."""

    render: Template
    reach: int = 0

    def __call__(self, turns: list[Turn]) -> str:
        return self.render(turns)


_PROBES = ("\ue000", "\ue001")


@dataclass
class Renderer:
    """One conversation; ``add`` gives (piece, start, content start, content end, status) of its next turn."""

    template: Template | Near | Resumable
    history: int | None = HISTORY
    turns: list[Turn] = field(default_factory=list)
    output: str = ""
    length: int = 0
    status: str = KEPT
    state: object = None

    def __post_init__(self):
        if isinstance(self.template, Resumable):
            self.output, self.state = self.template.begin()
        else:
            self.output = self.template([])

    def _cut(self) -> None:
        """Forget all but the last ``history`` turns; the last turn's span must not change by that."""
        last = self.turns[-self.history - 1 :]
        whole = self.template(self.turns[:-1])
        try:
            before, after = self.template(last[:-1]), self.template(last)
            same = after.startswith(before) and after[len(before) :] == self.output[len(whole) :]
            self.output = self.template(last[1:])
        except Exception:  # the template's own: it wants the beginning of the conversation
            same = False
        self.turns = last[1:]
        if not same:
            self.status = CUT

    def _added(self, turn: Turn) -> tuple[str, str, str] | None:
        """What the turn adds, and what it would add with two other texts; None where the template rewrote history."""
        said = [turn, *[(turn[0], x) for x in _PROBES]]
        opening = self.output if not self.length else ""  # what is said before any turn belongs to the first span
        if isinstance(self.template, Resumable):
            (piece, state), *probes = (self.template.turn(self.state, t) for t in said)
            self.state = state
            return opening + piece, *(opening + p for p, _ in probes)
        before, added = self.output, []
        for t in said:
            output = self.template([*self.turns, t])
            if not output.startswith(before):
                return None
            if not added:
                self.output = output
            added.append(opening + output[len(before) :])
        self.turns.append(turn)
        if isinstance(self.template, Near) and len(self.turns) > self.template.reach:
            self.turns = self.turns[len(self.turns) - self.template.reach :]
            self.output = self.template(self.turns)
        return tuple(added)

    def add(self, turn: Turn) -> tuple[str | None, int | None, int | None, int | None, str]:
        cuts = self.history is not None and not isinstance(self.template, Near)
        if cuts and len(self.turns) >= 2 * self.history:
            self._cut()
        added = self._added(turn) if self.status == KEPT else None
        if added is None:
            self.status = REWRITTEN if self.status == KEPT else self.status
            self.turns.clear()
            return None, None, None, None, self.status
        piece, x, y = added
        head, tail = _shared(x, y), _shared(x[::-1], y[::-1])
        start = self.length
        self.length += len(piece)
        fits = piece.startswith(x[:head]) and piece.endswith(x[len(x) - tail :]) and len(piece) >= head + tail
        if not fits:
            return piece, start, None, None, KEPT
        return piece, start, start + head, start + len(piece) - tail, KEPT


FORMATTED = (
    "conv_id long, position long, role string, piece string, start long, content_start long, content_end long, "
    "loss boolean, status string"
)


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[bool, list]]:
    """Rows as lists; the flag marks the first row of a conversation."""
    last, begun = None, False
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            yield not begun or row[0] != last, row
            last, begun = row[0], True


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 4_000_000, width: int = 3) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += 200 + len(row[width] or "")
        if weight > size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_FORMATTED_ARROW = pa.schema(
    [
        ("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("piece", pa.string()),
        ("start", pa.int64()), ("content_start", pa.int64()), ("content_end", pa.int64()),
        ("loss", pa.bool_()), ("status", pa.string()),
    ]
)


def format_turns(
    conversations: DataFrame,
    template: Template | Near | Resumable = marked,
    history: int | None = HISTORY,
    loss_role: str = LOSS_ROLE,
) -> DataFrame:
    """One row per row of ``conversations`` (``conv_id, turn, role, text``): its piece of the conversation's output,
    where it starts, where its content lies (null when the template changes the content's surroundings),
    whether it is trained on, and its ``status``: ``kept`` while every rendering kept the earlier ones, ``rewritten``
    from the first that did not, ``cut`` where a black box could not be followed past a cut history (never without a
    ``history``, nor for a template that is ``Near`` or ``Resumable``). Pieces and places are null unless the status is ``kept``.

    Rows of a conversation come together and in order of turn; equal turns are ordered by role and text, and
    repeated rows are turns of their own. Null roles and texts are empty, a null turn comes first, rows without
    ``conv_id`` are one conversation. Other columns are ignored; an empty table gives no rows.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")

    def run(batches):
        def formatted():
            renderer, position = Renderer(template, history), 0
            for first, (conv, role, text) in _conversations(batches):
                if first:
                    renderer, position = Renderer(template, history), 0
                piece, start, lo, hi, status = renderer.add((role, text))
                yield conv, position, role, piece, start, lo, hi, role == loss_role, status
                position += 1

        yield from _batched(formatted(), _FORMATTED_ARROW)

    return ordered.mapInArrow(run, FORMATTED)


DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)
_DIGESTS_ARROW = pa.schema(
    [
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
    ]
)


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the pieces of ``format_turns`` with the ``marked`` template alone: turns read back,
    their digest, the text under the loss mask and the length of the output. Hashes are fed turn by turn. A conversation
    without all its pieces cannot be read back and is an error."""

    def run(batches):
        def one(conv, turns, loss, counts):
            return conv, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]

        def all_():
            turns, loss, counts, conv, begun = None, None, None, None, False
            for first, (conv_id, piece, start, lo, hi, masked) in _conversations(batches):
                if first:
                    if begun:
                        yield one(conv, turns, loss, counts)
                    turns, loss, counts, conv, begun = hashlib.sha256(), hashlib.sha256(), [0, 0, 0], conv_id, True
                if piece is None:
                    raise ValueError(f"conversation {conv_id}: the template rewrote what it had said, or its history was cut")
                for role, text in read_marked(piece):
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    counts[0] += 1
                if masked:
                    text = unescape(piece[lo - start : hi - start])
                    loss.update(text.encode("utf-8", "surrogatepass"))
                    counts[1] += len(text)
                counts[2] += len(piece)
            if begun:
                yield one(conv, turns, loss, counts)

        yield from _batched(all_(), _DIGESTS_ARROW, width=2)

    narrow = formatted.select("conv_id", "piece", "start", "content_start", "content_end", "loss")
    return narrow.mapInArrow(run, DIGESTS)

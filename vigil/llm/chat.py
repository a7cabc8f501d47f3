"""Chat formatting with a grammar round trip.

A turn is rendered as ``<s>`` role ``[INST]`` text ``[/INST]</s>``.  Role and text must
not be read as marks, so every rendered turn is parsed again by a deterministic parser;
while what comes back differs from the source, the conflicting spans are escaped by one
more backslash inside the mark (``[INST]`` becomes ``[\\INST]``, ``[\\INST]`` becomes
``[\\\\INST]``), which the parser takes away again.  As a turn carries its own start and
end, the rendering of a conversation is that of its turns in order, and so is its parse.

Turns are rendered where they lie.  Reading back sorts the rendered turns by
conversation and streams over them with running digests, so that a conversation with a
third of all rows needs no more memory than another one.

Defined cases: null role and text are empty; a null conversation id is a conversation of
its own; a null turn number comes first; rows with the same number are ordered by role
and text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The marks of the template.
START, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"

_MARKS = re.compile(r"(</?s>|\[/?INST\])")
_QUOTABLE = re.compile(r"<(?=\\*/?s>)|\[(?=\\*/?INST\])")
_QUOTED = re.compile(r"(<)\\(?=\\*/?s>)|(\[)\\(?=\\*/?INST\])")


def escape(text: str) -> str:
    """One backslash more inside every mark and every escaped mark."""
    return _QUOTABLE.sub(r"\g<0>\\", text)


def unescape(text: str) -> str:
    """The inverse of ``escape``."""
    return _QUOTED.sub(r"\1\2", text)


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """``(role, text, start, end)`` of the turns; start and end of the text as rendered.

    Grammar: (START words OPEN words CLOSE END)*, where words hold no mark.  Raises
    ValueError on anything else.
    """
    parts = _MARKS.split(rendered)
    if parts[-1] or len(parts) % 8 != 1:
        raise ValueError("not a sequence of turns")
    found, at = [], 0
    for i in range(0, len(parts) - 1, 8):
        before, start, role, opened, text, closed, between, end = parts[i : i + 8]
        if before or between or (start, opened, closed, end) != (START, OPEN, CLOSE, END):
            raise ValueError("not a turn")
        first = at + len(start) + len(role) + len(opened)
        found.append((unescape(role), unescape(text), first, first + len(text)))
        at = first + len(text) + len(closed) + len(end)
    return found


def render(role: str, text: str) -> str:
    """The turn; parts that the parser does not give back as they were are escaped."""
    parts = (role, text)
    while True:
        rendered = f"{START}{parts[0]}{OPEN}{parts[1]}{CLOSE}{END}"
        try:
            back = [turn[:2] for turn in parse(rendered)]
        except ValueError:
            back = []
        if back == [(role, text)]:
            return rendered
        more = tuple(escape(source) if _MARKS.search(part) or unescape(part) != source else part for part, source in zip(parts, (role, text)))
        if more == parts:
            raise ValueError("a turn cannot be rendered reversibly")
        parts = more


def format_turns(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, rendered, loss_start, loss_end)``, one row per turn.

    The loss mask covers the code points ``[loss_start, loss_end)`` of ``rendered``: the
    text of assistant turns; others have an empty mask.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rendered, start, end = [], [], []
            for role, text in zip(batch["role"].to_pylist(), batch["text"].to_pylist()):
                line = render(role, text)
                masked = role == "assistant"
                [(_, _, first, last)] = parse(line)
                rendered.append(line)
                start.append(first if masked else 0)
                end.append(last if masked else 0)
            yield pa.RecordBatch.from_arrays(
                [batch["conv_id"], batch["turn"], batch["role"], pa.array(rendered, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                ["conv_id", "turn", "role", "rendered", "loss_start", "loss_end"],
            )

    chosen = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return chosen.mapInArrow(
        run, "conv_id long, turn long, role string, rendered string, loss_start long, loss_end long"
    )


class _Digests:
    """Running digests of the turns of one conversation."""

    def __init__(self) -> None:
        self.turns = self.loss_chars = self.chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, rendered: str, start: int, end: int) -> None:
        self.chars += len(rendered)
        for role, text, _, _ in parse(rendered):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        if end > start:
            masked = unescape(rendered[start:end])
            self.loss_chars += len(masked)
            self.loss.update(masked.encode())


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted turns say, by conversation, parsed from ``rendered`` alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        current, state, done = None, None, []

        def row() -> tuple:
            return current, state.turns, state.all.hexdigest(), state.loss_chars, state.loss.hexdigest(), state.chars

        def flush() -> pa.RecordBatch:
            columns = zip(*done)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            for conv, line, start, end in zip(*(batch[c].to_pylist() for c in ("conv_id", "rendered", "loss_start", "loss_end"))):
                if state is None or conv != current:
                    if state is not None:
                        done.append(row())
                    current, state = conv, _Digests()
                state.add(line, start, end)
            if len(done) >= 10_000:
                yield flush()
                done = []
        if state is not None:
            done.append(row())
            yield flush()

    return (
        formatted.repartition("conv_id")
        # escaped text sorts like its source only among equal turns, where any fixed order will do
        .sortWithinPartitions("conv_id", "turn", "role", "rendered")
        .mapInArrow(
            run,
            "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
        )
    )

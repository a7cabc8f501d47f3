"""Conversation structure repair by a grammar-compressed dynamic programme.

A conversation is a row of symbols, one a turn: the initial of its role (s, u, a or
another one) and its first fault.  Repairing it means choosing edits of least cost after
which the initials read ``(s?(ua)+)?``.  That language has four states, so a turn is a
four by four matrix of ``(cost, audit)`` in the min-plus semiring, where an audit is the
text of the edits and equal costs are settled by ASCII order; a conversation is the
product of its turns' matrices, in any bracketing.

1. Symbols are laid out in order and cut into segments; of all different segments one is
   kept.  Re-Pair rounds count adjacent pairs over these and replace frequent pairs by
   new symbols, which gives one grammar for all conversations.
2. Every rule gets the product of its two sides, bottom-up and once.  Audits are ropes:
   a rule's audit points at those of its sides, and no text is copied.
3. A segment is the product of its few compressed symbols.  A conversation, whose
   segments may have come from many tasks, is the product of its segments.

No two audits of one cell that cost the same are prefixes of each other, as both hold an
edit for each turn and end with one; so the least audit of a product is made of the
least audits of its sides, and the result does not depend on the grammar.

Edits: Keep costs 0, Rerole (to user or assistant) 3, Delete 4, Insert (an empty turn of
user or assistant) 3, and a truncated turn that stays 3 more.  Blank and repeated turns
have to be deleted.  What a reroled or inserted turn becomes follows from the state, so
the audit alone says what the repaired conversation is.

Defined cases: a null role or text is one space; a null conversation id is a conversation
of its own; a null turn number comes first; turns with one number are ordered by role and
the digest of their text; a role that is empty or begins with another letter can only be
reroled or deleted; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import join_groups
from vigil.session import settle

# Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

# States: nothing yet, after a system turn, after a user turn, after an assistant turn.
STATES = 4
_FINAL = (0, 3)
# The state after an inserted or reroled turn, which is of the user but after a user.
_NEXT = (2, 2, 3, 2)
_ROLE = ("user", "user", "assistant", "user")

_INITIALS = "sua-"
_FAULTS = ("", "blank", "duplicate", "truncated")
_FIRST = ord("a")
_LEGAL = {"su", "ua", "au"}

# Bounds of the grammar and of a segment; they change the work, not the result.
RULES = 256
SEGMENT = 4096

EDITS = {"K": "keep", "R": "rerole", "D": "delete", "I": "insert"}


# --- symbols --------------------------------------------------------------------

def symbol(initial: str, fault: str) -> str:
    """The letter of a turn."""
    place = _INITIALS.find(initial) if initial else -1
    return chr(_FIRST + (place if place >= 0 else 3) * 4 + _FAULTS.index(fault))


def _meaning(letter: str) -> tuple[str, str]:
    initial, fault = divmod(ord(letter) - _FIRST, 4)
    return _INITIALS[initial], _FAULTS[fault]


# --- audits as ropes -------------------------------------------------------------

Rope = str | tuple  # a text, or (left rope, right rope)


def flatten(rope: Rope) -> str:
    """The text of a rope."""
    parts, open_ = [], [rope]
    while open_:
        top = open_.pop()
        if isinstance(top, tuple):
            open_ += (top[1], top[0])
        else:
            parts.append(top)
    return "".join(parts)


def less(a: Rope, b: Rope) -> bool:
    """Whether the text of ``a`` comes before that of ``b``; parts both share are not read."""
    left, right = [a], [b]
    while left and right:
        if left[-1] is right[-1]:
            left.pop()
            right.pop()
        elif isinstance(left[-1], tuple):
            x, y = left.pop()
            left += (y, x)
        elif isinstance(right[-1], tuple):
            x, y = right.pop()
            right += (y, x)
        else:
            x, y = left.pop(), right.pop()
            n = min(len(x), len(y))
            if x[:n] != y[:n]:
                return x[:n] < y[:n]
            if x[n:]:
                left.append(x[n:])
            if y[n:]:
                right.append(y[n:])
    return not left and bool(right)


# --- matrices --------------------------------------------------------------------

Cell = tuple[int, Rope] | None
Matrix = list[list[Cell]]


def _better(a: Cell, b: Cell) -> Cell:
    if a is None or b is None:
        return b if a is None else a
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return b if less(b[1], a[1]) else a


def _join(a: Rope, b: Rope) -> Rope:
    if not a or not b:
        return a or b
    return (a, b)


def times(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product; ``a`` may have fewer rows than states."""
    out = []
    for row in a:
        line: list[Cell] = []
        for j in range(STATES):
            best = None
            for k in range(STATES):
                if row[k] is not None and b[k][j] is not None:
                    cost = row[k][0] + b[k][j][0]
                    if best is None or cost <= best[0]:
                        best = _better(best, (cost, _join(row[k][1], b[k][j][1])))
            line.append(best)
        out.append(line)
    return out


def _empty() -> Matrix:
    return [[None] * STATES for _ in range(STATES)]


def identity() -> Matrix:
    out = _empty()
    for i in range(STATES):
        out[i][i] = (0, "")
    return out


def inserts() -> Matrix:
    """Any number of inserted turns; three of them lead to no new state."""
    out = identity()
    for i in range(STATES):
        state, cost, audit = i, 0, ""
        for _ in range(3):
            state, cost, audit = _NEXT[state], cost + INSERT, audit + "I"
            out[i][state] = _better(out[i][state], (cost, audit))
    return out


def edits(letter: str) -> Matrix:
    """What may be done with one turn."""
    initial, fault = _meaning(letter)
    out = _empty()
    more = TRUNCATED if fault == "truncated" else 0
    for i in range(STATES):
        out[i][i] = (DELETE, "D")
        if fault in ("blank", "duplicate"):
            continue
        out[i][_NEXT[i]] = _better(out[i][_NEXT[i]], (REROLE + more, "R"))
        kept = 1 if initial == "s" and i == 0 else _NEXT[i] if initial == _ROLE[i][0] else None
        if kept is not None:
            out[i][kept] = _better(out[i][kept], (more, "K"))
    return out


def turn_matrix(letter: str) -> Matrix:
    return times(inserts(), edits(letter))


class Grammar:
    """Rules ``new symbol: (left, right)`` in the order they were made, with their matrices."""

    def __init__(self, rules: list[tuple[str, str]] = ()):
        self.rules: list[tuple[str, str]] = []
        self.matrices = {chr(_FIRST + i): turn_matrix(chr(_FIRST + i)) for i in range(16)}
        for left, right in rules:
            self.add(left, right)

    @staticmethod
    def name(number: int) -> str:
        return chr(0x100 + number)

    def add(self, left: str, right: str) -> None:
        self.matrices[self.name(len(self.rules))] = times(self.matrices[left], self.matrices[right])
        self.rules.append((left, right))

    def compress(self, symbols: str) -> str:
        """The symbols with the rules applied in order."""
        for i, (left, right) in enumerate(self.rules):
            symbols = symbols.replace(left + right, self.name(i))
        return symbols

    def matrix(self, symbols: str) -> Matrix:
        """The product of all symbols, halved again and again."""
        parts = [self.matrices[s] for s in self.compress(symbols)]
        if not parts:
            return identity()
        while len(parts) > 1:
            paired = [times(a, b) for a, b in zip(parts[::2], parts[1::2])]
            parts = paired + parts[len(paired) * 2 :]
        return parts[0]


def choose_pairs(counts: dict[str, int], room: int) -> list[str]:
    """The most frequent pairs that cannot overlap one another, at most ``room``.

    A symbol that is the left side of one chosen pair is the right side of none.
    """
    lefts: set[str] = set()
    rights: set[str] = set()
    chosen = []
    for pair, n in sorted(counts.items(), key=lambda c: (-c[1], c[0])):
        if n < 2 or len(chosen) == room:
            break
        a, b = pair
        if a not in rights and b not in lefts:
            chosen.append(pair)
            lefts.add(a)
            rights.add(b)
    return chosen


def count_pairs(symbols: str) -> Counter[str]:
    """Adjacent pairs; a run of one symbol counts as many pairs as fit side by side."""
    found = Counter(map("".join, zip(symbols, symbols[1:])))
    for pair in found:
        if pair[0] == pair[1]:
            found[pair] = symbols.count(pair)
    return found


def learn_grammar(segments: DataFrame, rules: int = RULES) -> Grammar:
    """Re-Pair over the column ``symbols``: rounds of counting and replacing, until no pair repeats.

    A round counts pairs of at most 16 + ``rules`` symbols, whatever the input, and adds
    all frequent pairs that do not overlap.
    """
    grammar = Grammar()
    while len(grammar.rules) < rules:
        learned = list(grammar.rules)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, total = Grammar(learned), Counter()
            for batch in batches:
                for symbols in batch["symbols"].to_pylist():
                    total.update(count_pairs(known.compress(symbols)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total.keys()), pa.string()), pa.array(list(total.values()), pa.int64())], ["pair", "n"]
            )

        counted = segments.mapInArrow(run, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        chosen = choose_pairs({r["pair"]: r["n"] for r in counted.where("n > 1").collect()}, rules - len(grammar.rules))
        if not chosen:
            break
        for pair in chosen:
            grammar.add(*pair)
    return grammar


# --- turns -----------------------------------------------------------------------

_ORDER = ("numbered", "turn", "role", "digest")


def plain_turns(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` with nulls of role and text as one space."""
    space = F.lit(" ")
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"),
    )


def damage(turns: DataFrame) -> DataFrame:
    """Turns with planted faults, chosen by the checksum of ``conv_id:turn``.

    Of twenty remainders 0 drops a turn, 1 empties it, 2 takes its sentence ends, 3
    repeats it, 4 makes it the user's.
    """
    plain = plain_turns(turns)
    written = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(written[0], F.lit(":"), written[1])) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return plain.withColumn("kind", kind).where("kind <> 0").select(
        "conv_id", "turn", role.alias("role"), text.alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


_WHITE = r"\x20\x09-\x0D"


def _keyed(rows: DataFrame) -> DataFrame:
    """Turns with what orders them."""
    return rows.withColumns({"numbered": F.col("turn").isNotNull(), "digest": F.sha2(F.col("text").cast("binary"), 256)})


def _shapes(rows: DataFrame) -> DataFrame:
    """Every different turn of a conversation with its symbol and how often it stands there.

    Texts stay behind; of them only a digest goes on.  Equal turns are counted where they
    lie, so one that makes up a third of all rows is a row a task.
    """
    blank = ~F.col("text").rlike(f"[^{_WHITE}]")
    fault: Column = F.when(blank, 1).when(~F.col("text").rlike(rf"[.!?][{_WHITE}]*\z"), 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    each = _keyed(rows).select("conv_id", *_ORDER, (place * 4 + fault).alias("shape"))
    counted = settle(each.groupBy("conv_id", *_ORDER, "shape").agg(F.count("*").alias("n")), "turns")
    # A text and role are a duplicate everywhere but at the first number they stand at.
    first = counted.groupBy(
        F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")
    ).agg(F.min(F.struct("numbered", "turn")).alias("first"), F.count("*").alias("places"))
    again = first.where("places > 1").drop("places")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    seen = F.col("first").isNotNull() & ~F.struct("numbered", "turn").eqNullSafe(F.col("first"))
    return counted.join(again, same, "left").select("conv_id", *_ORDER, "shape", "n", seen.alias("seen"))


def _segments(shapes: DataFrame) -> DataFrame:
    """The symbols of each conversation in order: ``(conv_id, part, number, symbols)``.

    Rows are ranged by conversation and turn, so a long conversation is dealt over many
    tasks; parts and numbers say how its segments follow each other.
    """
    schema = "conv_id long, part int, number long, symbols string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, current, open_, started, done = TaskContext.get().partitionId(), 0, None, "", False, []

        def close() -> None:
            nonlocal number, open_
            if open_:
                done.append((current, part, number, open_))
                number, open_ = number + 1, ""

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * 4
            done.clear()
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "part", "number", "symbols"])

        for batch in batches:
            for conv, shape, n, seen in zip(*(batch[c].to_pylist() for c in ("conv_id", "shape", "n", "seen"))):
                if not started or conv != current:
                    close()
                    current, started = conv, True
                again = shape if shape % 4 == 1 else shape - shape % 4 + 2
                letters = chr(_FIRST + again)
                open_ += letters if seen else chr(_FIRST + shape)
                left = n - 1
                while left or len(open_) >= SEGMENT:
                    if len(open_) >= SEGMENT:
                        close()
                    take = min(left, SEGMENT - len(open_))
                    open_ += letters * take
                    left -= take
            if len(done) >= 10_000:
                yield flush()
        close()
        yield flush()

    ordered = shapes.repartitionByRange("conv_id", *_ORDER).sortWithinPartitions("conv_id", *_ORDER)
    return ordered.select("conv_id", "shape", "n", "seen").mapInArrow(run, schema)


_CELL = "struct<cost: long, audit: string>"
_VALUED = f"symbols string, cells array<{_CELL}>, blank long, duplicate long, truncated long, illegal long"


def _valued(different: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """The matrix of every different segment, row by row, and what it counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(rules)
        cell = pa.struct([("cost", pa.int64()), ("audit", pa.string())])
        for batch in batches:
            for some in batch["symbols"].to_pylist():
                matrix = grammar.matrix(some)
                cells = [None if c is None else {"cost": c[0], "audit": flatten(c[1])} for row in matrix for c in row]
                told = [_meaning(s) for s in some]
                faults = Counter(fault for _, fault in told)
                illegal = sum(a + b not in _LEGAL for (a, _), (b, _) in zip(told, told[1:]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([some]), pa.array([cells], pa.list_(cell)), *(pa.array([faults[f]], pa.int64()) for f in _FAULTS[1:]),
                     pa.array([illegal], pa.int64())],
                    ["symbols", "cells", "blank", "duplicate", "truncated", "illegal"],
                )

    return different.select("symbols").mapInArrow(run, _VALUED)


_REPORT = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _combined(pieces: DataFrame) -> DataFrame:
    """Conversations from their valued segments, streamed in order.

    What is carried from one segment to the next is a row of four cells.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, row, counts, last, done = None, None, None, "", []

        def close() -> None:
            if row is not None:
                final = times([row], inserts())[0]
                cost, audit = None, ""
                for state in _FINAL:
                    cell = final[state]
                    if cell is not None and (cost is None or _better((cost, audit), cell) is cell):
                        cost, audit = cell
                done.append((current, *counts, cost, flatten(audit)))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * 7
            done.clear()
            kinds = [pa.int64()] * 6 + [pa.string()]
            names = ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        names = ("conv_id", "symbols", "cells", "blank", "duplicate", "truncated", "illegal")
        for batch in batches:
            for conv, some, cells, *counted in zip(*(batch[c].to_pylist() for c in names)):
                if row is None or conv != current:
                    close()
                    current, row, counts, last = conv, identity()[0], [0] * 4, ""
                found = [None if c is None else (c["cost"], c["audit"]) for c in cells]
                row = times([row], [found[i : i + STATES] for i in range(0, STATES * STATES, STATES)])[0]
                counts = [a + b for a, b in zip(counts, counted)]
                counts[3] += bool(last) and last + _meaning(some[0])[0] not in _LEGAL
                last = _meaning(some[-1])[0]
            if len(done) >= 10_000:
                yield flush()
        close()
        yield flush()

    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number")
    return ordered.mapInArrow(run, _REPORT)


def audits(rows: DataFrame, rules: int = RULES) -> DataFrame:
    """``(conv_id, blank, duplicate, truncated, illegal, cost, audit)`` of every conversation that has turns.

    ``rows`` are plain turns.  ``illegal`` counts neighbours whose role initials are not
    su, ua or au; the audit is the least one of least cost.
    """
    segments = settle(_segments(settle(_shapes(rows), "shapes")), "segments")
    different = settle(segments.groupBy("symbols").agg(F.count("*").alias("n")), "different")
    grammar = learn_grammar(different, rules)
    valued = settle(_valued(different, grammar.rules), "valued")
    # Conversations of one shape may be a third of all: their segments stay where they are.
    pieces = join_groups(segments, valued.join(different, "symbols"), "symbols", "n")
    return _combined(pieces.drop("n"))


def _walk(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """``(edit, role, text)`` of the turns that are there after the edits."""
    state = 0
    for edit in audit:
        if edit == "D":
            next(turns)
        elif edit == "K":
            role, text = next(turns)
            yield "keep", role, text
            state = 1 if state == 0 and role[:1] == "s" else _NEXT[state]
        else:
            text = "" if edit == "I" else next(turns)[1]
            yield EDITS[edit], _ROLE[state], text
            state = _NEXT[state]


def _streamed(rows: DataFrame, told: DataFrame, schema: str, make) -> DataFrame:
    """``make(conv_id, repaired turns)`` for each conversation, as rows of ``schema``.

    The audit of a conversation comes before its turns; both are streamed.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch[c].to_pylist() for c in ("conv_id", "audit", "role", "text")))

        source, done = rows_of(), []
        kinds = [pa.string() if c.split()[1] == "string" else pa.int64() for c in schema.split(", ")]

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * len(names)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for conv, audit, _, _ in source:
            held = 0
            for made in make(conv, _walk(audit, ((role, text) for _, _, role, text in source))):
                done.append(made)
                held += sum(len(v) for v in made if isinstance(v, str))
                if len(done) >= 1000 or held > 1 << 24:
                    yield flush()
                    held = 0
        yield flush()

    marks = told.select("conv_id", "audit")
    both = _keyed(rows).withColumn("audit", F.lit(None).cast("string")).unionByName(marks, allowMissingColumns=True)
    return (
        both.withColumn("turns", F.col("audit").isNull())
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turns", *_ORDER)
        .select("conv_id", "audit", "role", "text")
        .mapInArrow(run, schema)
    )


def repaired_turns(rows: DataFrame, told: DataFrame) -> DataFrame:
    """The turns after the edits of ``audits``: ``(conv_id, place, role, text, edit)``."""

    def make(conv, turns):
        for place, (edit, role, text) in enumerate(turns):
            yield conv, place, role, text, edit

    return _streamed(rows, told, "conv_id long, place long, role string, text string, edit string", make)


def repaired_digests(rows: DataFrame, told: DataFrame) -> DataFrame:
    """The digest of every repaired conversation, its turns as ``role:text`` lines."""

    def make(conv, turns):
        digest = hashlib.sha256()
        for place, (_, role, text) in enumerate(turns):
            digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
        yield conv, digest.hexdigest()

    return _streamed(rows, told, "conv_id long, repaired_sha256 string", make)


def report(turns: DataFrame, rows: DataFrame) -> DataFrame:
    """Gaps, faults, cost, audit and digest of every conversation of ``turns``, given its ``rows`` to repair.

    Conversations without rows have zeros, an empty audit and the digest of no text.
    """
    told = settle(audits(rows), "audits")
    digests = settle(repaired_digests(rows, told), "digests")
    numbers = rows.select("conv_id", "turn").distinct()
    spans = numbers.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
    )
    every = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for side in (spans, told, digests):
        key = side.withColumnRenamed("conv_id", "_conv")
        every = every.join(key, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    zero = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.select(
        "conv_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in zero],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )

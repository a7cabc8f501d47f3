"""Best-fit packing of token sequences by a linear grouping scheme.

Documents are tokenised where they lie; what is longer than a sequence is cut.  Of the
pieces only their lengths, at most ``capacity`` different ones, go to the driver as a
histogram, where the plan is made:

1. Large lengths are sorted downwards and cut into groups of equal cardinality; each
   group is rounded up to its longest member.
2. Over these few sizes, configurations (how many of each size a sequence takes) are
   optimised by column generation: a simplex over configurations whose prices come from
   a knapsack over the sizes.  The fractions left after rounding down are filled by
   first-fit decreasing.
3. Actual pieces take the places of their group by rank.
4. What is then really left in each sequence, again a histogram, is filled with the small
   pieces by best fit, from the longest.

Ranks within a length are counted in shares of it, so that a length that a third of the
pieces have is not one task.  Sequence ids are ``full`` pieces first, then planned ones.

Defined cases: null text is empty text, which has the end id only; a null id is kept;
repeated rows are packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import ranked, text_of
from vigil.session import settle

CAPACITY = 1024
END_ID = 2
GROUPS = 256
# Lengths over this share of a sequence are large.
LARGE = 0.4
# Word forms whose ids a task remembers.
REMEMBERED = 200_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class TokenIds:
    """Token ids of texts as little-endian 32-bit bytes, from a byte-level BPE file.

    Merges never cross a space before a word, so the ids of a text without runs of white
    space are those of its space-separated parts, which repeat.  Parts are merged by the
    ranks of the same vocabulary; other texts go to the tokenizer as they are.
    """

    def __init__(self, file: str):
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        with open(file, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f).get("added_tokens", [])]
        self.tokenizer = Tokenizer.from_file(file)
        letters = _byte_letters()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        ranks = {bytes(letters[c] for c in word): i for word, i in vocabulary.items() if all(c in letters for c in word) and word not in self.special}
        self.merges = tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.runs = regex.compile(r"[\s\x1c-\x1f]{2}")
        self.known: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        return np.array(self.merges.encode_ordinary(part), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if self.runs.search(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = text.split(" ")
        known = self.known
        found = list(map(known.get, rest))
        for i, ids in enumerate(found):
            if ids is None:
                ids = known.get(rest[i])
                if ids is None:
                    ids = self._part(" " + rest[i])
                    if len(rest[i]) <= 64:
                        known[rest[i]] = ids
                found[i] = ids
        if len(known) > REMEMBERED:
            known.clear()
        return self._part(first) + b"".join(found)


# Fixed value: how byte-level BPE cuts a text before merging.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones as they are."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def default_tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, tokenizer_file: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents: PIECES, with ``ids`` left out but their CRC-32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = TokenIds(tokenizer_file or default_tokenizer_file())
        end, step = np.array([end_id], "<u4").tobytes(), capacity * 4
        for batch in batches:
            rows = []
            for doc, text in zip(batch["__id"].to_pylist(), batch["__text"].to_pylist()):
                ids = encode(text) + end
                # The remainder comes first.
                cuts = [0, *range(len(ids) % step or step, len(ids) + 1, step)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((doc, i, a // 4, (b - a) // 4, zlib.crc32(ids[a:b])))
            for at in range(0, len(rows), 50_000):
                columns = zip(*rows[at : at + 50_000])
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("__id"), text_of().alias("__text")).mapInArrow(run, PIECES)


# ---- the plan, made from histograms ------------------------------------------------


def _best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable sizes that fit one sequence (each any number of times)."""
    useful = np.flatnonzero(values > 0)
    best, layers = np.zeros(capacity + 1), []
    # One more piece in each layer; sizes are large, so there are few layers.
    for _ in range(capacity // int(sizes.min())):
        worth = np.full((len(useful), capacity + 1), -1.0)
        for row, i in enumerate(useful):
            worth[row, sizes[i] :] = best[: capacity + 1 - sizes[i]] + values[i]
        last = worth.argmax(axis=0)
        top = worth[last, np.arange(capacity + 1)]
        more = top > best + 1e-12
        layers.append(np.where(more, useful[last], -1))
        if not more.any():
            break
        best = np.where(more, top, best)
    counts, room = np.zeros(len(sizes), int), capacity
    for took in reversed(layers):
        if took[room] >= 0:
            counts[took[room]] += 1
            room -= sizes[took[room]]
    return best[capacity], counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 3000) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often to use each, so that every size is placed ``demand`` times."""
    n = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(rounds):
        amounts = np.linalg.solve(basis, demand.astype(float))
        prices = np.linalg.solve(basis.T, np.ones(n))
        value, column = _best_configuration(sizes, prices, capacity)
        if value <= 1 + 1e-7:
            break
        change = np.linalg.solve(basis, column.astype(float))
        ratio = np.where(change > 1e-9, amounts / np.where(change > 1e-9, change, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    amounts = np.linalg.solve(basis, demand.astype(float))
    plan, left = [], demand.astype(int).copy()
    for j in np.argsort(-amounts):
        column = np.round(basis[:, j]).astype(int)
        used = column > 0
        times = min(int(max(amounts[j], 0) + 1e-9), int((left[used] // column[used]).min()))
        if times > 0:
            plan.append((column, times))
            left -= column * times
    # First-fit decreasing for the few that rounding down has left.
    opened: list[tuple[np.ndarray, int]] = []
    for i in np.argsort(-sizes):
        for _ in range(left[i]):
            for k, (column, room) in enumerate(opened):
                if room >= sizes[i]:
                    column[i] += 1
                    opened[k] = (column, room - sizes[i])
                    break
            else:
                column = np.zeros(n, int)
                column[i] = 1
                opened.append((column, capacity - sizes[i]))
    return plan + [(column, 1) for column, _ in opened]


class LargePlan:
    """Which sequence a large piece goes to, by its rank among the large ones (longest first)."""

    def __init__(self, histogram: dict[int, int], capacity: int, groups: int):
        self.before: dict[int, int] = {}
        total = 0
        for length in sorted(histogram, reverse=True):
            self.before[length] = total
            total += histogram[length]
        self.sequences = 0
        self.group_starts = np.zeros(0, np.int64)
        if not total:
            return
        # Equal cardinality; groups whose longest members are equal are one size.
        count = min(groups, total)
        bounds = [total * g // count for g in range(count)]
        lengths = np.array(sorted(histogram, reverse=True))
        starts = np.array([self.before[x] for x in lengths])
        longest = [int(lengths[np.searchsorted(starts, b, "right") - 1]) for b in bounds]
        keep = [i for i in range(count) if i == 0 or longest[i] != longest[i - 1]]
        self.group_starts = np.array([bounds[i] for i in keep], np.int64)
        sizes = np.array([longest[i] for i in keep])
        demand = np.diff(np.append(self.group_starts, total))
        # Of each group: (first place, first sequence, how many of it a sequence takes).
        self.places: list[list[tuple[int, int, int]]] = [[] for _ in keep]
        taken = np.zeros(len(keep), int)
        for column, times in configurations(sizes, demand, capacity):
            for g in np.flatnonzero(column):
                self.places[g].append((int(taken[g]), self.sequences, int(column[g])))
            taken += column * times
            self.sequences += times
        self.tables = [tuple(np.array(x, np.int64) for x in zip(*p)) for p in self.places]

    def sequence_of(self, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        order = rank + np.array([self.before[int(x)] for x in length], np.int64)
        group = np.searchsorted(self.group_starts, order, "right") - 1
        place, out = order - self.group_starts[group], np.zeros(len(order), np.int64)
        for g in np.unique(group):
            mine = group == g
            first, sequence, copies = self.tables[g]
            k = np.searchsorted(first, place[mine], "right") - 1
            out[mine] = sequence[k] + (place[mine] - first[k]) // copies[k]
        return out


def best_fit(rooms: dict[int, int], small: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Where small pieces go, whole classes at a time.

    ``rooms``: sequences by what is left in them; ``small``: pieces by length.  Gives
    ``(length, first rank, count, room, first rank of the sequence among those with that
    room)`` and the number of new sequences; room -1 stands for these.
    """
    free: dict[int, deque] = defaultdict(deque)
    for room, count in rooms.items():
        free[room].append((room, 0, count))
    moves, opened = [], 0
    for length in sorted(small, reverse=True):
        placed, left = 0, small[length]
        while left:
            room = next((r for r in range(length, capacity + 1) if free.get(r)), None)
            if room is None:
                # A new sequence for each of the pieces that do not fit together.
                count = -(-left // (capacity // length))
                free[capacity].append((-1, opened, count))
                opened += count
                continue
            origin, first, count = free[room].popleft()
            times = min(left, count)
            moves.append((length, placed, times, origin, first))
            if room > length:
                free[room - length].appendleft((origin, first, times))
            if times < count:
                free[room].appendleft((origin, first + times, count - times))
            placed, left = placed + times, left - times
    return moves, opened


def _map_column(df: DataFrame, name: str, function, inputs: tuple[str, ...], kind: str) -> DataFrame:
    """``df`` with the numpy ``function`` of two columns, by batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = function(*(batch[c].to_numpy(zero_copy_only=False) for c in inputs))
                for field, column in zip(name.split(), values):
                    batch = batch.append_column(field, pa.array(column, pa.int64()))
                yield batch

    fields = ", ".join(f"{c} {t}" for c, t in df.dtypes)
    return df.mapInArrow(run, f"{fields}, {kind}")


def pack(rows: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, large: float = LARGE) -> DataFrame:
    """``rows`` (with ``length`` from 1 to ``capacity``) and ``sequence_id``, ``offset``."""
    rows = settle(rows.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    # At most ``capacity`` rows.
    histogram = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    full = histogram.pop(capacity, 0)
    limit = int(capacity * large)
    plan = LargePlan({k: n for k, n in histogram.items() if k > limit}, capacity, groups)
    numbered = settle(ranked(rows, "length", "__row"), "ranks")
    whole = numbered.where(F.col("length") == capacity).withColumn("sequence_id", F.col("rank"))
    big = numbered.where((F.col("length") < capacity) & (F.col("length") > limit))
    big = _map_column(big, "sequence_id", lambda x, r: [plan.sequence_of(x, r) + full], ("length", "rank"), "sequence_id long")
    big = settle(big, "large")

    rooms = big.groupBy("sequence_id").agg((F.lit(capacity) - F.sum("length")).alias("room"))
    rooms = settle(ranked(settle(rooms, "rooms"), "room", "sequence_id"), "room_ranks")
    left = {r["room"]: r["count"] for r in rooms.groupBy("room").count().collect()}
    small = {k: n for k, n in histogram.items() if k <= limit}
    moves, _ = best_fit({k: n for k, n in left.items() if k > 0}, small, capacity)
    tables: dict[int, tuple[np.ndarray, ...]] = {}
    for length in small:
        mine = [m[1:] for m in moves if m[0] == length]
        tables[length] = tuple(np.array(c, np.int64) for c in zip(*mine))
    opened_from = full + plan.sequences

    def room_of(length: np.ndarray, rank: np.ndarray) -> list[np.ndarray]:
        room, place = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for x in np.unique(length):
            mine = length == x
            first, _, origin, start = tables[int(x)]
            k = np.searchsorted(first, rank[mine], "right") - 1
            room[mine] = origin[k]
            place[mine] = start[k] + rank[mine] - first[k]
        return [room, place]

    little = numbered.where(F.col("length") <= limit)
    little = _map_column(little, "__room __place", room_of, ("length", "rank"), "__room long, __place long")
    known = rooms.select(F.col("room").alias("__room"), F.col("rank").alias("__place"), "sequence_id")
    little = little.join(known, ["__room", "__place"], "left").withColumn(
        "sequence_id", F.coalesce("sequence_id", F.col("__place") + opened_from)
    ).drop("__room", "__place")
    packed = whole.unionByName(big).unionByName(little)
    # A sequence has at most ``capacity`` pieces.
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "__row").rowsBetween(Window.unboundedPreceding, -1)
    return packed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("__row", "rank")


def pack_documents(docs: DataFrame, tokenizer_file: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """PIECES of all documents with ``sequence_id`` and ``offset``."""
    return pack(pieces(docs, tokenizer_file, capacity, end_id), capacity)

"""Groups of near-duplicate documents by an exact n-gram Jaccard join with adaptive prefixes.

Texts become sets of word n-grams; equal sets are one.  Under a common order, rarest
first, two sets that are similar enough share at least l grams in their l-prefixes, the
first ``size - ceil(t * size) + l`` grams, for every l.  Each set takes the l whose
estimated cost is least: a longer prefix means more list entries to read, but more shared
grams are asked for before a pair is verified.  A pair is held to the smaller l of the two.

The order is by how many documents are expected to hold a gram: the product of its words'
shares, or its own count where that stands out.  Both come from count sketches over all
documents (a fixed number of counters; any order gives the same result).  A passage of rare
words that many documents share looks rare to them.  So the smallest gram of every window
of WINDOW grams is counted exactly, which is the same one in every copy of a passage; where
it occurs in more than LONG_LIST documents, the grams of its window are counted too, and
those as frequent come last in the order.  Only prefixes are shuffled; grams that a single
set has in its prefix fall out by a count.

The result is connected components, so pairs inside a component need no verification:

1. For each of STARS orders every set is verified against one partner, the first member of
   most of the lists it is in, which is linear in the lists however large a group is.
2. Lists whose members are by then in one component are done.  Of the others up to LONG
   entries all pairs from different components that share enough prefix grams are verified.
3. Longer lists are of groups of near copies, whose pairs are not made.  Each set is taken as
   what sets it apart from the grams that most of a sample of the group have; two sets differ
   by what they do not share of that.  Sets whose differences are few enough in sum are linked,
   each with the one nearest to the group's grams; any other link needs common differences, and
   those are joined by prefixes as the grams were.  The sample decides the work, no result.

All give exact links; together they miss none between components.  What is verified is
gathered through a fixed-size Bloom filter of text hashes, so sets without a candidate are
neither cut into grams again nor moved, and bitmaps of the sets rule out most pairs before.

Sets and grams are known by 64-bit hashes.  Defined cases: null text is empty; without
words a set is empty and linked with nothing; with fewer words than a gram the whole
sequence is one gram; a null id is larger than any other; repeated rows are in one group;
an empty table gives no rows; other columns are passed through by ``one_of_each``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from vigil.llm.common import BLOOM_BITS, LOWER, bloom, components, join_groups, mix, text_of, word_hashes
from vigil.operators import sizing
from vigil.session import drop_scratch, scratch_mark, settle

WORDS = 3
PERCENT = 90
# Counters of each sketch.
SKETCH_BITS = 20
LONGEST = 4
# Grams read for the price of one list entry, when a pair is verified.
VERIFY_SHARE = 0.25
STARS = 2
# Entries of a list whose pairs are joined; longer ones are joined by differences.
LONG = 32
# Members of a family, about, that say which grams most have.
SAMPLE = 16
# Grams in a window whose smallest is counted.
WINDOW = 16
# A gram of a shared passage that more documents than this have is taken for so frequent.
LONG_LIST = 4
FREQUENT = 1000.0
# Hash remainders that say whether a prefix gram may be in two sets.
SLOT_BITS = 26
# Bits of a set's bitmap, which rules out most pairs without their grams.
BITMAP = 2048
# Grams that a task adds up before it gives them.
BATCH = 1 << 20
# Counters that travel as one row.
COUNTERS = 1 << 15


def _windows(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n words in a row; all words together where there are fewer."""
    size = min(n, len(words))
    if not size:
        return words
    hashes = mix(words[: len(words) - size + 1] + np.uint64(size))
    for k in range(1, size):
        hashes = mix(hashes * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - size + 1 + k])
    return hashes


def _words(text: str) -> np.ndarray:
    return word_hashes(text.encode().translate(LOWER))[0]


def grams(text: str, n: int) -> np.ndarray:
    """The sorted distinct n-grams of a text as 64-bit hashes."""
    return np.unique(_windows(_words(text), n))


class Order:
    """How many documents are expected to hold a gram, from sketches of grams and words."""

    def __init__(self, gram_counts: np.ndarray, word_counts: np.ndarray):
        self.bits = len(gram_counts).bit_length() - 1
        self.total = np.log2(max(word_counts.sum(), 1))
        self.words = np.log2(np.maximum(word_counts, 1)).astype(np.float64)
        # A counter holds its gram and, on average, this many others.
        self.noise = gram_counts.sum() / len(gram_counts)
        self.excess = np.maximum(gram_counts.astype(np.float64) - self.noise, 0)
        self.excess[self.excess <= 6 * np.sqrt(self.noise) + 2] = 0
        # A Bloom filter of grams that turned out to be frequent.
        self.frequent: np.ndarray | None = None

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def by_place(self, text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The grams of a text as they follow each other, and how many documents should hold each."""
        words = _words(text)
        hashes = _windows(words, n)
        size = min(n, len(words))
        if not size:
            return hashes, np.zeros(0)
        share = self.words[self.slots(words)] - self.total
        log = share[: len(hashes)].copy()
        for k in range(1, size):
            log += share[k : k + len(hashes)]
        return hashes, np.maximum(np.exp2(log + self.total), self.excess[self.slots(hashes)])

    def grams(self, text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The sorted distinct grams of a text, and how many documents should hold each."""
        hashes, expected = self.by_place(text, n)
        found, first = np.unique(hashes, return_index=True)
        expected = expected[first]
        if self.frequent is not None:
            expected = np.where(_held(self.frequent, found), np.maximum(expected, FREQUENT), expected)
        return found, expected


def _held(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes a Bloom filter may have."""
    bit = hashes.view(np.int64) % BLOOM_BITS
    return bits[bit >> 5] >> (bit & 31).astype(np.uint32) & np.uint32(1) == 1


def smallest(hashes: np.ndarray) -> np.ndarray:
    """The smallest gram of every window of WINDOW grams; of all grams where they are fewer."""
    out, width = hashes, 1
    while width < WINDOW and len(out) > 1:
        step = min(width, WINDOW - width, len(out) - 1)
        out, width = np.minimum(out[:-step], out[step:]), width + step
    return out


def _set_id(found: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def needed(size: int, percent: int) -> int:
    """Grams a set shares at least with any set it is linked with."""
    return -(-percent * size // 100)


def sketch(docs: DataFrame, n: int, bits: int = SKETCH_BITS) -> tuple[Order, np.ndarray]:
    """Counts of all documents' distinct grams, and of their words, by hash remainders; and
    a Bloom filter of the smallest grams of windows that many documents have.

    One pass: counters come out of a task at its end, smallest grams as it goes.
    """
    size = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * size, np.uint32)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                low = []
                for text in batch["text"].slice(start, 1000).to_pylist():
                    words = _words(text)
                    hashes = _windows(words, n)
                    for place, some in ((0, np.unique(hashes)), (size, words)):
                        np.add.at(counts, (some >> np.uint64(64 - bits)).astype(np.int64) + place, np.uint32(1))
                    low.append(np.unique(smallest(hashes)))
                yield from _counted(low)
        for i in range(0, 2 * size, COUNTERS):
            part = counts[i : i + COUNTERS]
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.array([i // COUNTERS], pa.int32()), pa.array([part.tobytes()], pa.binary())],
                    ["gram", "n", "part", "counts"],
                )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = np.zeros(COUNTERS, np.uint64), None
        for batch in batches:
            for part, counts in zip(batch["part"].to_pylist(), batch["counts"].to_pylist()):
                total[: len(counts) // 4] += np.frombuffer(counts, np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "counts"])

    found = settle(docs.mapInArrow(run, "gram long, n int, part int, counts binary"), "sketch")
    out = np.zeros(max(2 * size, COUNTERS), np.uint64)
    # A fixed number of counters, whatever the input.
    for row in found.where("part is not null").select("part", "counts").groupBy("part").applyInArrow(add, "part int, counts binary").collect():
        out[row["part"] * COUNTERS : (row["part"] + 1) * COUNTERS] = np.frombuffer(row["counts"], np.uint64)
    return Order(out[:size], out[size : 2 * size]), bloom(_often(found.where("part is null")), "gram")


def _counted(some: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """How many of the arrays have each gram, as rows without counters."""
    found, times = np.unique(np.concatenate(some), return_counts=True)
    for start in range(0, len(found), 100_000):
        part = found[start : start + 100_000].view(np.int64)
        times_of = pa.array(times[start : start + 100_000].astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), times_of, pa.nulls(len(part), pa.int32()), pa.nulls(len(part), pa.binary())], ["gram", "n", "part", "counts"]
        )


def _often(counted: DataFrame) -> DataFrame:
    """The grams that more than LONG_LIST documents have, as a kept table."""
    return settle(counted.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > LONG_LIST).select("gram"), "frequent")


def passages(docs: DataFrame, order: Order, often: np.ndarray, n: int) -> DataFrame:
    """``(gram, n)``: grams that look rare, in windows whose smallest gram many documents have.

    A task adds up BATCH grams at a time, so copies that lie together bring their grams once.
    """
    shared = docs.sparkSession.sparkContext.broadcast((order, often))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, often = shared.value
        some, held = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                for text in batch["text"].slice(start, 1000).to_pylist():
                    hashes, expected = order.by_place(text, n)
                    low = smallest(hashes)
                    at = np.flatnonzero(_held(often, low))
                    if not len(at):
                        continue
                    # +1 where a window begins, -1 behind its end.
                    edges = np.zeros(len(hashes) + 1, np.int64)
                    np.add.at(edges, at, 1)
                    np.add.at(edges, at + len(hashes) - len(low) + 1, -1)
                    inside = np.cumsum(edges[:-1]) > 0
                    some.append(np.unique(hashes[inside & (expected <= LONG_LIST)]))
                    held += len(some[-1])
                    if held > BATCH:
                        yield from _counted(some)
                        some, held = [], 0
        if some:
            yield from _counted(some)

    return docs.mapInArrow(run, "gram long, n int, part int, counts binary").select("gram", "n")


def adaptive_prefix(found: np.ndarray, expected: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The grams of a set's prefix, rarest first, and its l."""
    size = len(found)
    base = size - needed(size, percent)
    # Equal ones stay in the order of their hashes.
    order = np.argsort(expected, kind="stable")[: min(base + LONGEST, size)]
    entries = np.cumsum(expected[order])
    best, cost = 1, np.inf
    for length in range(1, LONGEST + 1):
        if base + length > size or length > needed(size, percent):
            break
        read = entries[base + length - 1]
        # A candidate uses up at least l list entries.
        estimate = read + base + length + VERIFY_SHARE * size * read / length
        if estimate < cost:
            best, cost = length, estimate
    return found[order[: base + best]], best


def prefixes(docs: DataFrame, order: Order, n: int, percent: int) -> DataFrame:
    """Two kinds of rows: documents ``(doc_id, set, size)``, and sets ``(set, size, l, prefix, bits, hash)``.

    The hash is of one text of the set, by which ``sets_of`` finds it.  A prefix is its grams as 64-bit integers, rarest first; bits are all grams hashed
    into BITMAP bits.  A task gives a set once, however many copies of it the task meets.
    """
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.int64())
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            for start in range(0, len(ids), 1000):
                rows = []
                texts, hashes = (batch[c].slice(start, 1000).to_pylist() for c in ("text", "hash"))
                for doc, text, hashed in zip(ids[start : start + 1000], texts, hashes):
                    found, expected = shared.value.grams(text, n)
                    which = _set_id(found) if len(found) else None
                    rows.append((doc, which, len(found), None, None, None, None))
                    if which is not None and which not in given:
                        if len(given) > 1_000_000:
                            given.clear()
                        given.add(which)
                        prefix, length = adaptive_prefix(found, expected, percent)
                        rows.append((None, which, len(found), length, prefix.tobytes(), _bitmap(found), hashed))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "set", "size", "l", "prefix", "bits", "hash"])

    return _hashed(docs, "doc_id").mapInArrow(run, "doc_id long, set long, size int, l int, prefix binary, bits array<long>, hash long")


def _hashed(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*columns, "text", F.xxhash64("text").alias("hash"))


def _bitmap(found: np.ndarray) -> np.ndarray:
    out = np.zeros(BITMAP // 64, np.uint64)
    np.bitwise_or.at(out, (found >> np.uint64(6)) % np.uint64(len(out)), np.uint64(1) << (found & np.uint64(63)))
    return out.view(np.int64)


def _slots(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - SLOT_BITS)).astype(np.uint32)


def _repeated(sets: DataFrame) -> np.ndarray:
    """For each of 2 ** SLOT_BITS hash remainders whether two prefix grams or more have it.

    A gram in two prefixes always does; the few others that do fall out later.
    """
    part_bits = SLOT_BITS - 6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = b"".join(batch["prefix"].to_pylist())
            slots, counts = np.unique(_slots(np.frombuffer(found, np.uint64)), return_counts=True)
            edges = np.searchsorted(slots, np.arange(65, dtype=np.uint64) << np.uint64(part_bits))
            for part, (a, b) in enumerate(zip(edges, edges[1:])):
                if a < b:
                    twice = slots[a:b][counts[a:b] > 1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part], pa.int32()), pa.array([slots[a:b].tobytes()], pa.binary()), pa.array([twice.tobytes()], pa.binary())],
                        ["part", "once", "twice"],
                    )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, again, part = np.zeros(1 << part_bits, bool), np.zeros(1 << part_bits, bool), None
        low = np.uint32((1 << part_bits) - 1)
        for batch in batches:
            for part, once, twice in zip(*(batch[c].to_pylist() for c in ("part", "once", "twice"))):
                slots = np.frombuffer(once, np.uint32) & low
                again[slots[seen[slots]]] = True
                again[np.frombuffer(twice, np.uint32) & low] = True
                seen[slots] = True
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(again).tobytes()], pa.binary())], ["part", "bits"])

    out = np.zeros(1 << SLOT_BITS - 3, np.uint8)
    size = len(out) // 64
    # 64 rows of a fixed size, whatever the input.
    for row in sets.mapInArrow(run, "part int, once binary, twice binary").groupBy("part").applyInArrow(add, "part int, bits binary").collect():
        out[row["part"] * size : (row["part"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return out


def _lists(sets: DataFrame) -> DataFrame:
    """``(gram, set, size, place, level, l)`` of the prefix grams that more than one set may have."""
    shared = sets.sparkSession.sparkContext.broadcast(_repeated(sets.select("prefix")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = np.frombuffer(b"".join(batch["prefix"].to_pylist()), np.uint64)
            counts = np.array([len(x) // 8 for x in batch["prefix"].to_pylist()], np.int64)
            row = np.repeat(np.arange(len(counts)), counts)
            place = np.arange(len(prefix)) - np.repeat(np.cumsum(counts) - counts, counts)
            length = batch["l"].to_numpy().astype(np.int64)[row]
            level = np.maximum(place + 1 - (counts[row] - length), 1)
            slots = _slots(prefix)
            some = np.flatnonzero(shared.value[slots >> np.uint32(3)] >> (np.uint32(7) - (slots & np.uint32(7))).astype(np.uint8) & np.uint8(1))
            for start in range(0, len(some), 100_000):
                at = some[start : start + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(prefix[at].view(np.int64)), pa.array(batch["set"].to_numpy()[row[at]]), pa.array(batch["size"].to_numpy()[row[at]]),
                        pa.array(place[at].astype(np.int32)), pa.array(level[at].astype(np.int32)), pa.array(length[at].astype(np.int32)),
                    ],
                    ["gram", "set", "size", "place", "level", "l"],
                )

    return sets.mapInArrow(run, "gram long, set long, size int, place int, level int, l int")


def _shared_lists(lists: DataFrame, by: str) -> DataFrame:
    """The entries of lists that have more than one value of ``by``."""
    mixed = lists.groupBy("gram").agg(F.min(by).alias("low"), F.max(by).alias("high")).where("low < high").select("gram")
    return lists.join(mixed, "gram", "left_semi")


def sets_of(docs: DataFrame, wanted: DataFrame, order: Order, n: int) -> DataFrame:
    """``(set, grams)`` of the wanted sets ``(set, hash)``, each once; grams in the common order.

    Only texts whose hash may be wanted are cut into grams.
    """
    shared = docs.sparkSession.sparkContext.broadcast((bloom(wanted, "hash"), order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (bits, order), given = shared.value, set()
        for batch in batches:
            which, found = [], []
            hashes = batch["hash"].to_numpy()
            at = np.flatnonzero(_held(bits, hashes))
            for hashed, text in zip(hashes[at].tolist(), batch["text"].take(pa.array(at)).to_pylist()):
                if hashed in given:
                    continue
                if len(given) > 1_000_000:
                    given.clear()
                given.add(hashed)
                mine, expected = order.grams(text, n)
                if len(mine):
                    which.append(_set_id(mine))
                    found.append(mine[np.argsort(expected, kind="stable")].view(np.int64))
            for start in range(0, len(which), 200):
                some = found[start : start + 200]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in some])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(which[start : start + 200], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(some)))], ["set", "grams"]
                )

    found = _hashed(docs).mapInArrow(run, "set long, grams array<long>")
    # Exactly the wanted ones, and each from one of the tasks that gave it.
    return found.join(wanted.select("set").distinct(), "set", "left_semi").dropDuplicates(["set"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs ``(a, b)`` those that are linked."""
    left = sets.select(F.col("set").alias("a"), F.col("grams").alias("of_a"))
    right = sets.select(F.col("set").alias("b"), F.col("grams").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    joined = pairs.join(left, "a").join(right, "b").withColumn("both", both)
    union = F.size("of_a") + F.size("of_b") - F.col("both")
    return joined.where(100 * F.col("both") >= F.lit(percent) * union).select("a", "b")


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose bitmaps do not rule them out.

    Each bit that differs is a gram that only one of the sets has, and linked sets have
    at most ``(1 - t) / (1 + t)`` of their grams for themselves.
    """
    left, right = (sets.select(F.col("set").alias(c), F.col("size").alias(f"size_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab")
    apart = F.aggregate(
        F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda so_far, n: so_far + n
    )
    joined = pairs.join(left, "a").join(right, "b")
    return joined.where((100 + percent) * apart <= (100 - percent) * (F.col("size_a") + F.col("size_b"))).select(*pairs.columns)


def _named(*names: DataFrame) -> DataFrame:
    """``set``: all that any of the tables has in any column."""
    return reduce(DataFrame.unionAll, [table.select(F.col(c).alias("set")) for table in names for c in table.columns]).distinct()


def _wanted(sets: DataFrame, *names: DataFrame) -> DataFrame:
    """``(set, hash)`` of the sets that any of the tables has in any column."""
    return sets.select("set", "hash").join(_named(*names), "set", "left_semi")


def _only(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sets of the kept ``pairs``; where they are few, the grams of all others stay where they are."""
    return sets.join(sizing.small(_named(pairs)), "set", "left_semi")


def _families(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of lists up to LONG; and of the longer ones ``(family, set, size, root)``, as a kept table.

    Lists with the same first member are a family, as those of a group mostly are.
    """
    first = F.min(F.struct(F.xxhash64("set").alias("order"), "set")).alias("first")
    long = left.groupBy("gram").agg(F.count("*").alias("n"), first).where(F.col("n") > LONG)
    long = settle(long.select("gram", F.col("first.set").alias("family")), "long")
    members = left.join(long, "gram").select("family", "set", "size", "root").distinct()
    return left.join(long, "gram", "left_anti"), settle(members, "families")


def _bases(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``(family, n, base)``: its size, and the grams that most of about SAMPLE members have."""
    sizes = settle(members.groupBy("family").agg(F.count("*").alias("n")), "sizes")
    share = F.pmod(F.xxhash64("set", F.lit(STARS)), F.lit(1 << 20))
    chosen = join_groups(members.select("family", "set"), sizes, "family", "n").where(share * F.col("n") < F.lit(SAMPLE << 20))
    chosen = sizing.small(settle(chosen.select("family", "set"), "chosen"))

    def most(table: pa.Table) -> pa.Table:
        found, times = np.unique(table["grams"].combine_chunks().flatten().to_numpy(), return_counts=True)
        base = pa.array([found[2 * times > len(table)]], pa.list_(pa.int64()))
        return pa.table([table["family"][:1], base], ["family", "base"])

    bases = sets.join(chosen, "set").groupBy("family").applyInArrow(most, "family long, base array<long>")
    return sizes.join(bases, "family", "left").withColumn("base", F.coalesce("base", F.array().cast("array<long>")))


def _apart(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members with ``delta``, the grams that only they or only their family's base have.

    Two members differ by what one of their deltas has and the other has not.  With
    ``over = (100 + percent) * |delta| - (100 - percent) * size`` they are linked if and only if
    ``over_a + over_b <= 2 * (100 + percent) * |delta_a and delta_b|``.  ``least`` is the smallest
    ``over`` of the family, ``nearest`` a member that has it.  Grams that the base has
    not come first, rarest first.
    """
    bases = settle(_bases(members, sets), "bases")
    rows = join_groups(sets.join(sizing.small(members), "set"), bases, "family", "n")
    rows = rows.withColumn("delta", F.concat(F.array_except("grams", "base"), F.array_except("base", "grams")))
    over = ((100 + percent) * F.size("delta").cast("long") - (100 - percent) * F.col("size").cast("long")).alias("over")
    bits = [
        F.aggregate(
            F.filter("delta", lambda x: F.pmod(x, F.lit(4)) == k),
            F.lit(0).cast("long"),
            lambda so_far, x: so_far.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(x, 2), F.lit(64)).cast("int"))),
        ).alias(f"bits{k}")
        for k in range(4)
    ]
    rows = settle(rows.select("family", "set", "size", "root", "delta", over, *bits), "deltas")
    least = rows.groupBy("family").agg(F.count("*").alias("n"), F.min(F.struct("over", "set")).alias("least"))
    least = settle(least.select("family", "n", F.col("least.over").alias("least"), F.col("least.set").alias("nearest")), "least")
    return join_groups(rows, least, "family", "n").drop("n")


def _differing(apart: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b, family)`` of members from different components that may be linked, but for those both linked with the nearest.

    A link shares ``needs`` grams of the deltas at least, so it shares one of the first ones.  Its
    other end is ``least`` over or more, and more than ``-least`` where this one is linked with the
    nearest; and it differs by ``(100 - percent) / percent`` of this one's grams at most.
    """
    near = F.col("over") + F.col("least") <= 0
    length = F.size("delta")
    other = F.when(near, 1 - F.col("least")).otherwise(F.col("least"))
    needs = F.greatest(
        F.lit(1).cast("long"),
        F.ceil((F.col("over") + other) / F.lit(2 * (100 + percent))),
        length - F.floor(F.col("size") * F.lit(100 - percent) / F.lit(percent)),
    )
    rows = apart.withColumn("near", near).withColumn("kept", (length - needs + 1).cast("int")).where("kept > 0")
    bits = [f"bits{k}" for k in range(4)]
    rows = rows.select("family", F.explode(F.slice("delta", F.lit(1), F.col("kept"))).alias("gram"), "set", "size", "root", "near", *bits)
    rows = settle(rows, "differences")
    a, b = (rows.select("family", "gram", *[F.col(c).alias(f"{c}_{side}") for c in ("set", "size", "root", "near", *bits)]) for side in "ab")
    # Bits that differ are grams that only one of the two has.
    differ = reduce(Column.__add__, (F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in bits))
    return (
        a.join(b, ["family", "gram"])
        .where("set_a < set_b AND root_a <> root_b AND NOT (near_a AND near_b)")
        .where((100 + percent) * differ <= (100 - percent) * (F.col("size_a") + F.col("size_b")))
        .groupBy(F.col("set_a").alias("a"), F.col("set_b").alias("b"))
        .agg(F.min("family").alias("family"))
    )


def _linked(pairs: DataFrame, apart: DataFrame, percent: int) -> DataFrame:
    """Of the kept pairs ``(a, b, family)`` those that are linked, by their deltas, which are shorter than the sets."""
    asked = _only(apart, pairs.select("a", "b"))
    left, right = (asked.select("family", F.col("set").alias(c), F.col("over").alias(f"over_{c}"), F.col("delta").alias(f"of_{c}")) for c in "ab")
    both = F.size(F.array_intersect("of_a", "of_b"))
    joined = pairs.join(left, ["family", "a"]).join(right, ["family", "b"])
    return joined.where(F.col("over_a") + F.col("over_b") <= F.lit(2 * (100 + percent)) * both).select("a", "b")


def _ranked(lists: DataFrame) -> DataFrame:
    """Entries with ``before``: how many grams before theirs in the prefix other prefixes have too."""
    return lists.withColumn("before", F.row_number().over(Window.partitionBy("set").orderBy("place")) - 1)


def _close(a: str, b: str, percent: int) -> Column:
    """Whether sets that share a gram at these places may share enough of all grams.

    ``a`` and ``b`` are the endings of the column names.  Where two sets have a gram in
    their prefixes, whatever rarer gram they share is in both prefixes as well, so it is one
    of those ``before`` it in either; what comes later is bounded by the shorter rest.
    """
    size_a, size_b = F.col(f"size{a}"), F.col(f"size{b}")
    rest = F.least(size_a - F.col(f"place{a}"), size_b - F.col(f"place{b}"))
    return (100 + percent) * (F.least(f"before{a}", f"before{b}") + rest) >= F.lit(percent) * (size_a + size_b)


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row of ``docs``."""
    members, classes = _classes(docs, words, percent)
    alone = members.where("set is null").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    found = join_groups(members.where("set is not null"), classes.select("set", "component_id", "copies"), "set", "copies")
    return found.select("doc_id", F.col("size").cast("long").alias("n_shingles"), "component_id").unionByName(alone)


def _classes(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Documents ``(doc_id, set, size)``, and sets ``(set, root, low, copies, component_id)``."""
    spark, mark = docs.sparkSession, scratch_mark(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    order, often = sketch(texts, words)
    order.frequent = bloom(_often(passages(texts, order, often, words)), "gram")
    drop_scratch(spark, mark)
    kept = settle(prefixes(texts, order, words, percent), "prefixes")
    members = settle(kept.where("prefix is null").select("doc_id", "set", "size"), "members")
    prefixed = kept.where("prefix is not null")
    sets = settle(prefixed.select("set", "size", "bits", "hash").dropDuplicates(["set"]), "bitmaps")
    lists = _lists(prefixed.select("set", "size", "l", "prefix"))
    lists = settle(_ranked(_shared_lists(lists, "set").distinct()), "lists")

    of_b = [F.col(c).alias(f"{c}_b") for c in ("size", "place", "before", "l")]
    firsts = [F.min(F.struct(F.xxhash64("set", F.lit(star)).alias("order"), F.col("set").alias("b"), *of_b)).alias(f"first{star}") for star in range(STARS)]
    # The first members of a list in all orders come out of one pass over the lists.
    first = lists.join(lists.groupBy("gram").agg(*firsts), "gram")
    first = first.select(*lists.columns, F.posexplode(F.array(*[f"first{star}" for star in range(STARS)])).alias("star", "first"))
    pairs = first.select(*lists.columns, "star", "first.*").where((F.col("set") != F.col("b")) & _close("", "_b", percent))
    shares = pairs.groupBy("star", F.col("set").alias("a"), "b").agg(F.count("*").alias("shared"), F.min(F.least("l", "l_b")).alias("l"))
    # The partner that a set shares most lists with.
    stars = shares.where("shared >= l").groupBy("star", "a").agg(F.max(F.struct("shared", "b")).alias("best")).select("a", "best.b")
    pairs = settle(_possible(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sets, percent), "pairs")
    links = settle(verified(pairs, settle(sets_of(texts, _wanted(sets, pairs), order, words), "sets"), percent), "links")
    groups = components(links, "groups")
    left = settle(_shared_lists(_labelled(lists, groups), "root"), "left")
    short, families = _families(left)
    entry = ("set", "size", "place", "before", "level", "l", "root")
    a, b = (short.select("gram", *[F.col(c).alias(f"{c}_{side}") for c in entry]) for side in "ab")
    pairs = (
        a.join(b, "gram")
        .where("set_a < set_b AND root_a <> root_b AND level_a <= l_b AND level_b <= l_a")
        .where(_close("_a", "_b", percent))
        .groupBy(F.col("set_a").alias("a"), F.col("set_b").alias("b"))
        .agg(F.count("*").alias("shared"), F.min(F.least("l_a", "l_b")).alias("l"))
        .where("shared >= l")
    )
    # A pair that has too few grams in short lists alone has another in a long one, and so a family.
    pairs = settle(_possible(pairs.select("a", "b"), sets, percent), "pairs")
    kept = settle(sets_of(texts, _wanted(sets, pairs, families.select("set")), order, words), "sets")
    found = verified(pairs, _only(kept, pairs), percent)
    if families.take(1):
        apart = settle(_apart(families, kept, percent), "apart")
        near = apart.where("over + least <= 0 AND set <> nearest").select(F.col("set").alias("a"), F.col("nearest").alias("b"))
        differing = settle(_differing(apart, percent), "differing")
        differing = settle(_possible(differing, _only(sets, differing.select("a", "b")), percent), "differing")
        found = found.unionAll(_linked(differing, apart, percent)).unionAll(near).distinct()
    found = settle(found, "links")
    if found.take(1):
        groups = components(links.unionByName(found), "groups")
    # A class for each set, however many documents have it, before documents are joined.
    of_set = members.where("set is not null").groupBy("set").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"))
    of_set = of_set.join(groups.select(F.col("node").alias("set"), "root"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    of_set = settle(of_set, "classes")
    lowest = of_set.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = settle(of_set.join(lowest, "root"), "classes")
    drop_scratch(spark, mark, but=(members, classes))
    return members, classes


def _labelled(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """Entries with the component of their set."""
    lists = lists.drop("root").join(groups.select(F.col("node").alias("set"), "root"), "set", "left")
    return lists.withColumn("root", F.coalesce("root", "set"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Of each group of ``docs`` the row with the smallest id, with all its columns.

    Rows without words are in no group and stay.
    """
    members, classes = _classes(docs, words, percent)
    first = F.min(F.struct(F.col("low").isNull().alias("none"), "low", "set")).alias("first")
    stays = classes.groupBy("root").agg(first).select(F.col("first.low").alias("__low"), F.col("first.set").alias("__stays"))
    same = (F.col("set") == F.col("__stays")) & F.col("doc_id").eqNullSafe(F.col("__low"))
    # Few rows go beside those that stay, so these are the ones to look for; texts are not moved for them.
    goes = members.where("set is not null").select("doc_id", "set").distinct().join(stays, same, "left_anti")
    goes = settle(goes.select(F.col("doc_id").alias("__goes"), F.col("set").alias("__from")), "goes")
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [grams(text or "", words) for text in batch.column(place).to_pylist()]
            yield batch.append_column("__set", pa.array([_set_id(x) if len(x) else None for x in found], pa.int64()))

    fields = StructType([*docs.schema.fields, StructField("__set", LongType())])
    some_word = text_of().rlike(r"[^\x20\x09-\x0D]")
    named = docs.where(some_word).mapInArrow(run, fields)
    # The id is part of the key, so many documents with one set are not one task.
    same = (F.col("__set") == F.col("__from")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__goes"))
    return named.join(sizing.small(goes), same, "left_anti").drop("__set").unionByName(docs.where(~some_word))

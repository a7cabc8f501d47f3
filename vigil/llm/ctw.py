"""Language-model scores by context-tree weighting over bytes.

A text is taken as its words, A-Z in lower case, joined by one space, and an end mark.
Each byte is eight binary decisions.  A node of the tree is a context (the last 0 to DEPTH
bytes) with the bits of the byte decided so far; it estimates the next bit by the
Krichevsky-Trofimov rule and weights that, half and half, with what its children, which
know one byte more, make of it.  As a node's estimate of all its training bits depends on
their counts alone, the tree is a function of the counts of (context, byte) grams, and
they are counted by a shuffle over all training texts.

Every step is a join or a group, and nothing grows in one place:

- Texts are packed into blocks of about BLOCK_BYTES.  A block gives its distinct grams and
  tokens with their counts, so what is shuffled grows with the variety of the texts.
- Contexts that share their last three bytes form a subtree of at most 2 ** 24 grams; the
  subtrees are weighted in groups.  The nodes above them are at most 2 ** 16 contexts;
  they are weighted on the driver and sent to the tasks.
- Each block gets the values of its own grams and tokens back and adds them up by text.

The unigram base counts the same tokens.  Tokens are known by 64-bit hashes.

Defined cases: null text is empty text, which has the end mark only; a null id counts as an
empty string in the split; repeated rows count each; without training texts every bit has
probability one half and the base is that of no known token; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import LOWER, text_of, word_hashes
from vigil.session import settle

DEPTH = 5
# Contexts up to this many bytes are above the subtrees.
TOP = 2
BLOCK_BYTES = 96 << 20
PACK_BYTES = 4 << 20
GROUP_GRAMS = 1 << 20
# No UTF-8 text has this byte: it ends a text and fills the context before it.
END = 255
# The end mark as a token.
END_KEY = -1
_LOG_HALF = np.log(0.5)


def held_out(id_column: str = "doc_id") -> Column:
    """Whether the CRC-32 of the id as text leaves 2 when divided by 7."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def plain(text: str) -> bytes:
    return b" ".join(text.encode().translate(LOWER).split())


def _mask(depth: int) -> np.uint64:
    return np.uint64((1 << 8 * (depth + 1)) - 1)


def gram_keys(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Of every byte and end mark the gram (context above the byte), and where each text's begin."""
    data = b"".join(bytes([END]) * depth + text + bytes([END]) for text in texts)
    raw = np.frombuffer(data, np.uint8).astype(np.uint64)
    keys = raw[depth:].copy()
    for k in range(1, depth + 1):
        keys |= raw[depth - k : len(raw) - k] << np.uint64(8 * k)
    lengths = np.array([len(text) + 1 for text in texts], np.int64)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    # Leave out the filling between the texts.
    own = np.repeat(np.arange(len(texts)) * depth, lengths) + np.arange(bounds[-1])
    return keys[own], bounds


def token_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Negative keys of the tokens, the end mark included, and where each text's begin."""
    hashes, first, _ = word_hashes(b"".join(text + b" " for text in texts))
    ends = np.searchsorted(first, np.cumsum([len(text) + 1 for text in texts]))
    keys = np.full(len(hashes) + len(texts), END_KEY, np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    keys[np.arange(len(hashes)) + owner] = -2 - (hashes >> np.uint64(2)).astype(np.int64)
    return keys, np.concatenate([[0], ends + np.arange(1, len(texts) + 1)])


# ---- the tree ----------------------------------------------------------------------


def _log_rising(n: np.ndarray, start: float) -> np.ndarray:
    """log(start * (start + 1) * ... n factors), exactly for small n, by Stirling's series beyond."""
    table = _TABLES[start]
    small = n < len(table)
    out = table[np.where(small, n, 0)]
    if not small.all():
        x = n[~small] + start
        series = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)
        out[~small] = series - (0.5 * np.log(np.pi) if start == 0.5 else 0.0)
    return out


_TABLES = {s: np.concatenate([[0.0], np.cumsum(np.log(np.arange(1 << 14) + s))]) for s in (0.5, 1.0)}


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _log_rising(zeros, 0.5) + _log_rising(ones, 0.5) - _log_rising(zeros + ones, 1.0)


class Tree:
    """Nodes of contexts from ``deep`` down to ``low`` bytes, over sorted grams and their counts.

    ``sums``: by bit, sorted node ids of the deepest nodes and the sums of their children's
    log probabilities; None if they have no children.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, deep: int, low: int, sums: list | None = None):
        self.keys, self.parents = [keys], []
        all_counts = [counts.astype(np.int64)]
        for depth in range(deep - 1, low - 1, -1):
            found, back = np.unique(self.keys[-1] & _mask(depth), return_inverse=True)
            all_counts.append(np.bincount(back, all_counts[-1], len(found)).astype(np.int64))
            self.keys.append(found)
            self.parents.append(back)
        # By bit and depth: the estimate of each gram's bit, and the weight of that estimate.
        self.estimates: list[list[tuple[np.ndarray, np.ndarray]]] = []
        # By bit: the lowest nodes' first grams and log probabilities.
        self.lowest: list[tuple[np.ndarray, np.ndarray]] = []
        for bit in range(8):
            here, first, whole = [], None, None
            for i, (grams, n) in enumerate(zip(self.keys, all_counts)):
                node = grams >> np.uint64(8 - bit)
                starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
                run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(node))))
                value = ((grams >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.int64)
                ones = np.bincount(run, n * value, len(starts)).astype(np.int64)
                zeros = np.bincount(run, n, len(starts)).astype(np.int64) - ones
                alone = log_estimate(zeros, ones)
                if i == 0 and sums is None:
                    mixed, weight = alone, np.ones(len(starts))
                else:
                    if i == 0:
                        ids, of_children = sums[bit]
                        children = of_children[np.searchsorted(ids, node[starts])]
                    else:
                        children = np.bincount(run[self.parents[i - 1][first]], whole, len(starts))
                    mixed = np.logaddexp(alone, children) + _LOG_HALF
                    weight = np.exp(_LOG_HALF + alone - mixed)
                estimate = (np.where(value == 1, ones[run], zeros[run]) + 0.5) / (zeros + ones + 1)[run]
                here.append((estimate, weight[run]))
                first, whole = starts, mixed
            self.estimates.append(here)
            self.lowest.append((first, whole))

    def mix(self, bit: int, deeper: np.ndarray | None, at: np.ndarray) -> np.ndarray:
        """The probability of a bit at the lowest depth, for the grams ``at`` of the deepest."""
        for i, (estimate, weight) in enumerate(self.estimates[bit]):
            if i:
                at = self.parents[i - 1][at]
            deeper = estimate[at] if deeper is None else weight[at] * estimate[at] + (1 - weight[at]) * deeper
        return deeper

    def child_sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bit, node id one byte shorter, sum of its children's log probabilities)."""
        out = []
        for bit, (first, whole) in enumerate(self.lowest):
            ids, back = np.unique((self.keys[-1][first] & _mask(TOP)) >> np.uint64(8 - bit), return_inverse=True)
            out.append((np.full(len(ids), bit), ids, np.bincount(back, whole, len(ids))))
        return tuple(np.concatenate(x) for x in zip(*out))


# ---- the steps ---------------------------------------------------------------------


def _packs(docs: DataFrame) -> DataFrame:
    """Texts as compressed packs: ``(ids, held, lengths, bytes, data)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        ids, held, texts, size = [], [], [], 0

        def pack() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())),
                    pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([size], pa.int64()),
                    pa.array([squeeze(b"".join(texts))], pa.binary()),
                ],
                ["ids", "held", "lengths", "bytes", "data"],
            )

        for batch in batches:
            for doc, out, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "held_out", "text"))):
                ids.append(doc)
                held.append(out)
                texts.append(plain(text))
                size += len(texts[-1])
                if size >= PACK_BYTES:
                    yield pack()
                    ids, held, texts, size = [], [], [], 0
        if ids:
            yield pack()

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    chosen = chosen.select("doc_id", held_out().alias("held_out"), "text")
    return chosen.mapInArrow(run, "ids array<long>, held array<boolean>, lengths array<long>, bytes long, data binary")


def _unpack(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[list, np.ndarray, list[bytes]]]:
    """``(ids, held, texts)`` of each pack."""
    open_ = zstandard.ZstdDecompressor().decompress
    for i in range(batch.num_rows):
        data, lengths = batch["data"][i].as_py(), batch["lengths"][i].as_py()
        data = open_(data, max_output_size=sum(lengths) + 1)
        ends = np.cumsum([0, *lengths]).tolist()
        yield batch["ids"][i].as_py(), np.array(batch["held"][i].as_py(), bool), [data[a:b] for a, b in zip(ends, ends[1:])]


def _add_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, back = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(back, np.concatenate(counts), len(found)).astype(np.int64)


def _block_counts(packs: DataFrame, depth: int) -> DataFrame:
    """``(block, key, n)``: the distinct grams and tokens of a block, n times in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, keys, counts, size = None, [], [], 0
        for batch in batches:
            block = batch["block"][0].as_py()
            for _, held, texts in _unpack(batch):
                for make in (lambda t: gram_keys(t, depth), token_keys):
                    found, bounds = make(texts)
                    train = np.repeat(~held, np.diff(bounds))
                    found, first = found.astype(np.int64), train
                    # Sorting the two parts by themselves is cheaper than an inverse.
                    for part, count in ((found[first], True), (found[~first], False)):
                        values, n = np.unique(part, return_counts=True)
                        keys.append(values)
                        counts.append(n if count else np.zeros(len(n), np.int64))
                        size += len(values)
                if size > 4 << 20:
                    keys, counts = ([x] for x in _add_up(keys, counts))
                    size = len(keys[0])
        if keys:
            all_keys, n = _add_up(keys, counts)
            for i in range(0, len(all_keys), 100_000):
                some = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n[some]), block, np.int64)), pa.array(all_keys[some]), pa.array(n[some])], ["block", "key", "n"]
                )

    return packs.select("block", "ids", "held", "lengths", "data").groupBy("block").applyInArrow(run, "block long, key long, n long")


def _gram_table(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    table = pa.Table.from_batches(batches)
    keys, counts = table["key"].to_numpy(), table["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order].astype(np.uint64), counts[order]


def gram_values(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``(key, value)``: the log10 probability the tree gives each gram's byte; grams are a kept table."""
    spark = grams.sparkSession
    groups = max(1, -(-grams.count() // GROUP_GRAMS))
    # Whole subtrees: grams with the same last three bytes of context.
    near = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * (TOP + 1)) - 1))
    grams = grams.withColumn("part", F.pmod(F.xxhash64(near), F.lit(groups)))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = _gram_table(list(batches))
        bit, node, total = Tree(keys, counts, depth, TOP + 1).child_sums()
        yield pa.RecordBatch.from_arrays([pa.array(bit, pa.int32()), pa.array(node.astype(np.int64)), pa.array(total)], ["bit", "node", "total"])

    # At most 2 ** 16 contexts with 255 nodes each, in all.
    upper = grams.groupBy("part").applyInArrow(sums, "bit int, node long, total double").groupBy("bit", "node").agg(F.sum("total").alias("total")).toArrow().to_pandas()
    pairs = grams.groupBy(F.col("key").bitwiseAND(F.lit(int(_mask(TOP)))).alias("key")).agg(F.sum("n").alias("n")).toArrow().to_pandas().sort_values("key")
    by_bit = []
    for bit in range(8):
        mine = upper[upper["bit"] == bit].sort_values("node")
        by_bit.append((mine["node"].to_numpy().astype(np.uint64), mine["total"].to_numpy()))
    top = spark.sparkContext.broadcast(Tree(pairs["key"].to_numpy().astype(np.uint64), pairs["n"].to_numpy(), TOP, 0, by_bit))

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = _gram_table(list(batches))
        tree, above = Tree(keys, counts, depth, TOP + 1), top.value
        at, everyone = np.searchsorted(above.keys[0], keys & _mask(TOP)), np.arange(len(keys))
        total = np.zeros(len(keys))
        for bit in range(8):
            total += np.log10(above.mix(bit, tree.mix(bit, None, everyone), at))
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(total)], ["key", "value"])

    return grams.groupBy("part").applyInArrow(values, "key long, value double")


class _Values:
    """Values by key, for keys that are all there: a hash table in arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(int(len(keys) * 2).bit_length(), 1)
        self.down = np.uint64(64 - bits)
        slots = self._slot(keys)
        order = np.argsort(slots)
        self.keys, self.values = keys[order], values[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(slots, minlength=1 << bits))]).astype(np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.down).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.first[self._slot(keys)]
        wrong = np.flatnonzero(self.keys[at] != keys)
        while len(wrong):
            at[wrong] += 1
            wrong = wrong[self.keys[at[wrong]] != keys[wrong]]
        return self.values[at]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, bounds[:-1]) if len(values) else np.zeros(len(bounds) - 1)


def score_documents(docs: DataFrame, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte)`` of every row."""
    packs = settle(_packs(docs).withColumn("pack", F.monotonically_increasing_id()), "packs")
    blocks = max(1, -(-(packs.agg(F.sum("bytes")).first()[0] or 0) // block_bytes))
    packs = packs.withColumn("block", F.pmod(F.xxhash64("pack"), F.lit(blocks)))
    counts = settle(_block_counts(packs, depth), "counts")
    totals = settle(counts.groupBy("key").agg(F.sum("n").alias("n")), "totals")
    tokens = totals.where("key < 0")
    n_train, variety = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    values = gram_values(totals.where("key >= 0"), depth).unionByName(tokens.select("key", F.col("n").cast("double").alias("value")))
    back = counts.select("block", "key").join(values, "key")

    def run(packs: pa.Table, values: pa.Table) -> pa.Table:
        known = _Values(values["key"].to_numpy(), values["value"].to_numpy())
        out = []
        for ids, held, texts in _unpack(packs):
            grams, bounds = gram_keys(texts, depth)
            score = _sums(known(grams.astype(np.int64)), bounds)
            tokens, token_bounds = token_keys(texts)
            seen = known(tokens)
            base = _sums(np.log10((seen + 1) / (n_train + variety + 1)), token_bounds)
            n_bytes = np.diff(bounds)
            out.append(
                pa.table(
                    {
                        "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(held),
                        "n_tokens": pa.array(np.diff(token_bounds)), "n_known": pa.array(_sums((seen > 0).astype(np.int64), token_bounds)),
                        "train_tokens": pa.array(np.full(len(ids), n_train, np.int64)), "base_score": pa.array(base),
                        "score": pa.array(score), "bits_per_byte": pa.array(-score / np.log10(2) / n_bytes),
                    }
                )
            )
        return pa.concat_tables(out)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    left = packs.select("block", "ids", "held", "lengths", "data").groupBy("block")
    return left.cogroup(back.groupBy("block")).applyInArrow(run, schema)

"""Benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment.

Test items are taken in blocks of BLOCK, so what is sent to the tasks is bounded however
many items there are.  For each block:

1. One pass over the documents counts every word n-gram of the items in them.
2. Each item's n-grams that occur in a document are its seeds, so any copied run of
   SEED_WORDS words holds one, whatever is edited around it and however often the passage
   as a whole occurs.  Those that are the rarest of some WINDOW neighbouring ones are rare.
3. A second pass finds the seeds in the documents.  Around each the words of the document
   are aligned with the item's by Smith-Waterman (all places of a batch at once), and the
   best score over that of a perfect copy is the item's score in the document.  It is a hit
   from a threshold on, or from an alignment worth LONG_RUN matched words.  Where all
   seeds of a place are common ones, it is only aligned if so many words of the item are
   there at all that the score could reach the threshold.

Texts stay where they are; what is shuffled are counts and hits.  Only words of the items
have numbers, so counting and alignment are exact.

Defined cases: null and empty texts hold no seed; items with fewer than MIN_WORDS words
cannot be told from chance and are not looked for; a copy without SEED_WORDS unedited
words in a row holds no seed and is not found; words are runs of letters and digits,
in lower case (bytes beyond ASCII count as letters, but for spaces and punctuation);
repeated rows give repeated hits; an empty table gives no rows; other columns are passed
through by ``clean_documents`` and ignored by ``contaminated``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import word_hashes

BLOCK = 2000
SEED_WORDS = 3
WINDOW = 6
# The share of a perfect copy's score from which a document is contaminated.
THRESHOLD = 0.5
MIN_WORDS = 5
# A run worth so many matched words is a copy, whatever its share of the item.
LONG_RUN = 50
MATCH, MISMATCH, GAP = 2, -1, -1
# Texts are read in blocks of about so many bytes.
AT_ONCE = 1 << 18
_OTHER_MARKS = re.compile("[\u0080-\u00bf\u2000-\u206f\u3000-\u303f\uff00-\uff0f]")
_BREAKS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def _plain(text: str) -> bytes:
    """Lower case, with a space for everything that is no letter or digit."""
    return _OTHER_MARKS.sub(" ", text.lower()).encode().translate(_BREAKS)


class Items:
    """A block of test items as numbered words, with their n-grams as sorted keys."""

    def __init__(self, rows: list[tuple[int, str]], size: int = SEED_WORDS, min_words: int = MIN_WORDS):
        hashed = [(item, word_hashes(_plain(text))[0]) for item, text in rows]
        hashed = [(item, words) for item, words in hashed if len(words) >= max(min_words, size)]
        self.ids, self.size = [item for item, _ in hashed], size
        self.vocabulary = np.unique(np.concatenate([words for _, words in hashed] or [np.zeros(0, np.uint64)]))
        self.base = np.uint64(len(self.vocabulary) + 1)
        # Most words are no item's: a small table sorts them out before the search.
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True
        self.words = [self._numbers(words) for _, words in hashed]
        grams = [(key, i, at) for i, words in enumerate(self.words) for at, key in enumerate(self.keys(words).tolist())]
        self.grams = np.array(sorted(grams), dtype=[("key", "u8"), ("item", "i4"), ("at", "i4")])
        self.distinct = np.unique(self.grams["key"])

    def _numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Words as numbers from 1, 0 for those no item has."""
        numbers = np.zeros(len(hashes), np.int32)
        some = np.flatnonzero(self.maybe[(hashes >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[some]), len(self.vocabulary) - 1)
        numbers[some] = np.where(self.vocabulary[at] == hashes[some], at + 1, 0)
        return numbers

    def read(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Blocks of texts: index of the first, their numbered words (a 0 ends each text), where each begins."""
        at = 0
        while at < len(texts):
            block, size = [], 0
            while at + len(block) < len(texts) and size < AT_ONCE:
                block.append(_plain(texts[at + len(block)]) + b" ")
                size += len(block[-1])
            hashes, first, _ = word_hashes(b"".join(block))
            ends = np.searchsorted(first, np.cumsum([len(x) for x in block]))
            numbers = np.zeros(len(hashes) + len(block), np.int32)
            owner = np.repeat(np.arange(len(block)), np.diff(ends, prepend=0))
            numbers[np.arange(len(hashes)) + owner] = self._numbers(hashes)
            yield at, numbers, np.concatenate([[0], ends + np.arange(1, len(block) + 1)])
            at += len(block)

    def keys(self, words: np.ndarray) -> np.ndarray:
        """Keys of the n-grams; 0 where one of their words is no item's."""
        count = max(len(words) - self.size + 1, 0)
        key, known = np.zeros(count, np.uint64), np.ones(count, bool)
        for k in range(self.size):
            part = words[k : k + count]
            key = key * self.base + part.astype(np.uint64)
            known &= part > 0
        return np.where(known, key, 0)

    def find(self, words: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of n-grams that are among the sorted keys ``known``, and which ones they are."""
        keys = self.keys(words)
        some = np.flatnonzero(keys)
        at = np.minimum(np.searchsorted(known, keys[some]), len(known) - 1)
        same = known[at] == keys[some]
        return some[same], at[same]

    def seeds(self, counts: dict[int, int], window: int = WINDOW) -> np.ndarray:
        """Those of ``grams`` that occur; ``rare`` are the rarest of some window of an item's."""
        chosen = []
        order = np.lexsort((self.grams["at"], self.grams["item"]))
        by_item = self.grams[order]
        bounds = np.searchsorted(by_item["item"], np.arange(len(self.words) + 1))
        for a, b in zip(bounds, bounds[1:]):
            mine = [g for g in by_item[a:b].tolist() if counts.get(g[0], 0)]
            rarity = [(counts[key], at) for key, _, at in mine]
            picked = {min(rarity[i : i + window])[1] for i in range(max(len(mine) - window + 1, 1))} if mine else set()
            chosen.extend((*g, g[2] in picked) for g in mine)
        return np.sort(np.array(chosen, dtype=[*self.grams.dtype.descr, ("rare", "?")]), order=["key", "item", "at"])


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman of each item with its passage: best score and where it ends in the passage.

    All pairs advance together, one word of the item at a time.  A gap in the passage is
    carried along the row by a running maximum, as its cost grows by the word.
    """
    n, height, width = len(items), max(map(len, items)), max(map(len, passages))
    item = np.zeros((n, height), np.int32)
    passage = np.full((n, width), -1, np.int32)
    for i, (a, b) in enumerate(zip(items, passages)):
        item[i, : len(a)], passage[i, : len(b)] = a, np.where(b == 0, -1, b)
    above = np.zeros((n, width + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    slope = np.arange(width + 1, dtype=np.int32) * GAP
    for row in range(height):
        same = np.where((item[:, row, None] == passage) & (item[:, row, None] > 0), MATCH, MISMATCH)
        here = np.zeros_like(above)
        here[:, 1:] = np.maximum(above[:, :-1] + same, above[:, 1:] + GAP)
        here = np.maximum(here, 0)
        here = np.maximum(here, np.maximum.accumulate(here - slope, axis=1) + slope)
        here[item[:, row] == 0] = 0
        top = here.argmax(axis=1)
        value = here[np.arange(n), top]
        better = value > best
        best[better], end[better] = value[better], top[better]
        above = here
    return best, end


class Finder:
    """Finds a block's items in texts by their seeds."""

    def __init__(self, items: Items, seeds: np.ndarray, threshold: float):
        self.items, self.seeds, self.threshold = items, seeds, threshold
        self.seed_keys = np.unique(seeds["key"])
        bounds = np.searchsorted(seeds["key"], np.append(self.seed_keys, np.iinfo(np.uint64).max))
        self.of_key = [seeds[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
        self.word_lists = [words.tolist() for words in items.words]

    def possible(self, item: int, passage: np.ndarray) -> bool:
        """Whether so many words of the item are in the passage that its score may reach the threshold."""
        there, mine = set(passage.tolist()), self.word_lists[item]
        return self.enough(MATCH * sum(word in there for word in mine), item)

    def enough(self, score: int, item: int) -> bool:
        """Whether an alignment's score makes the text a copy of the item or of a long run of it."""
        return score / (MATCH * len(self.word_lists[item])) >= self.threshold or score >= MATCH * LONG_RUN

    def places(self, words: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int]]:
        """``(text, item, from, to)``: stretches of the texts around seeds of the item."""
        found: dict[tuple[int, int], list[tuple[int, int, bool]]] = {}
        at, which = self.items.find(words, self.seed_keys)
        owner = np.searchsorted(starts, at, "right") - 1
        for place, key, text in zip(at.tolist(), which.tolist(), owner.tolist()):
            for _, item, offset, rare in self.of_key[key]:
                length = len(self.items.words[item])
                slack = length // 2 + 2
                a = max(place - offset - slack, int(starts[text]))
                b = min(place - offset + length + slack, int(starts[text + 1]) - 1)
                found.setdefault((text, item), []).append((a, b, rare))
        out = []
        for (text, item), spans in found.items():
            spans = sorted(set(spans))
            # Overlapping stretches are one, up to a few lengths of the item.
            longest = 4 * len(self.items.words[item]) + 16
            start, stop, sure = spans[0]
            for a, b, rare in [*spans[1:], (len(words) + longest, 0, False)]:
                if a <= stop and b - start <= longest:
                    stop, sure = max(stop, b), sure or rare
                else:
                    if sure or self.possible(item, words[start:stop]):
                        out.append((text, item, start, stop))
                    start, stop, sure = a, b, rare
        return out

    def hits(self, texts: list[str]) -> list[list[tuple[int, float, int]]]:
        """For each text ``(item id, score, last word)`` of the items found in it."""
        results: list[dict[int, tuple[float, int]]] = [{} for _ in texts]
        for first, words, starts in self.items.read(texts):
            jobs = self.places(words, starts)
            # Pairs of like size are aligned together, so that little is padded.
            jobs.sort(key=lambda j: (len(self.items.words[j[1]]), j[3] - j[2]))
            for i in range(0, len(jobs), 256):
                some = jobs[i : i + 256]
                scores, ends = align([self.items.words[j[1]] for j in some], [words[j[2] : j[3]] for j in some])
                for (text, item, a, _), score, end in zip(some, scores.tolist(), ends.tolist()):
                    share = score / (MATCH * len(self.items.words[item]))
                    mine = results[first + text]
                    if self.enough(score, item) and share > mine.get(item, (0.0, 0))[0]:
                        mine[item] = (share, a - int(starts[text]) + end)
        return [[(self.items.ids[item], *found) for item, found in sorted(r.items())] for r in results]


def _finders(docs: DataFrame, benchmark: DataFrame, threshold: float, block: int) -> Iterator[Finder]:
    """A finder for each block of items, with seeds chosen by counts over all documents."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    last = None
    while True:
        after = items if last is None else items.where(F.struct("item_id", "text") > F.struct(F.lit(last[0]).cast("long").alias("item_id"), F.lit(last[1]).alias("text")))
        rows = [tuple(r) for r in after.distinct().orderBy("item_id", "text").limit(block).collect()]
        if not rows:
            return
        last = rows[-1]
        known = Items(rows)
        if known.words:
            # At most as many rows as the block has n-grams.
            counts = {r["key"]: r["n"] for r in _gram_counts(docs, known).collect()}
            seeds = known.seeds(counts)
            if len(seeds):
                yield Finder(known, seeds, threshold)


def _gram_counts(docs: DataFrame, items: Items) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        totals = np.zeros(len(items.distinct), np.int64)
        for batch in batches:
            for _, words, _ in items.read([text or "" for text in batch["text"].to_pylist()]):
                totals += np.bincount(items.find(words, items.distinct)[1], minlength=len(totals))
        some = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(items.distinct[some].astype(np.int64)), pa.array(totals[some])], ["key", "n"])

    return docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``(doc_id, item_id, score, end_word)``: items that a document holds a copy of, edited or not."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    out = None
    for finder in _finders(chosen, benchmark, threshold, block):
        shared = docs.sparkSession.sparkContext.broadcast(finder)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = shared.value.hits(batch["text"].to_pylist())
                rows = [(doc, *hit) for doc, hits in zip(batch["doc_id"].to_pylist(), found) for hit in hits]
                columns = list(zip(*rows)) or [()] * 4
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "score", "end_word"])

        hits = chosen.mapInArrow(run, "doc_id long, item_id long, score double, end_word long")
        out = hits if out is None else out.unionByName(hits)
    return chosen.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, end_word long") if out is None else out


def clean_documents(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    place = docs.columns.index("text")
    for finder in _finders(docs.select("text"), benchmark, threshold, block):
        shared = docs.sparkSession.sparkContext.broadcast(finder)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = shared.value.hits([text or "" for text in batch.column(place).to_pylist()])
                yield batch.filter(pa.array([not hits for hits in found], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

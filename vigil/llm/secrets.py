"""Secret scans with a random forest that removes false positives.

Candidates are runs of at least SHORTEST letters, digits and ``_+/.-``, with up to two
``=`` behind them (no words of a text are dropped before this), so the name in front of
``name=value`` is no part of the value; values assigned to a name of credentials, from
SHORTEST_ASSIGNED signs of any kind but white space; and the lines of private keys.  Each
is described by its length, kinds of characters, how usual its character transitions are,
how much of it frequent words cover, its path, the words and signs next to it, and whether
it has the form of a known kind of key.  A forest is trained on labelled findings, a bounded
sample of them; candidates it takes for secrets are findings.

What is usual is learned from all documents: counts of byte pairs (2 ** 16 of them) and a
count sketch of words (a fixed number of counters).

``weak_labels`` labels candidates of unlabelled text where the text itself tells: values
assigned to a name of credentials or behind ``Bearer`` that are random to look at, known
forms of keys, JSON web tokens and lines of private keys are secrets, others are not.
Secrets of no known form that nothing names are left to the forest.

Defined cases: null text is empty; a null path is empty; texts without candidates give no
rows; repeated rows give repeated findings; without labels of both kinds nothing can be
told apart and every candidate is a finding; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import LOWER, counters, mix, text_of, word_hashes
from vigil.session import settle

SHORTEST = 16
SHORTEST_ASSIGNED = 6
SAMPLE = 4000
TREES, TREE_DEPTH = 40, 8
THRESHOLD = 0.5
WORD_BITS = 20
# A word is frequent when it is more than this share of all words.
FREQUENT = 2e-6
# Buckets for the hashed words next to a candidate and in its path.
NEAR_BUCKETS, PATH_BUCKETS = 24, 8
_CHARACTERS = np.array([chr(b) in "_+/.-" or (b < 128 and chr(b).isalnum()) for b in range(256)])
_PADDING = re.compile(rb"={1,2}(?![A-Za-z0-9_+/.=\-])")
# Kinds: 0 other, 1 digit, 2 upper case, 3 lower case.
_KIND = np.array([1 if 48 <= b < 58 else 2 if 65 <= b < 91 else 3 if 97 <= b < 123 else 0 for b in range(256)])
_HEX = re.compile(rb"(?:[0-9a-f]+|[0-9A-F]+)\Z")
_NAME = (
    r"(?:token|secret|passw(?:or)?d|passphrase|pwd|(?:api|access|private|secret|signing|encryption|account)[_-]?key|credentials?|auth)"
    r"(?:\\?[\"'])?\s*"
)
_ASSIGNED = re.compile(
    rf"(?i)(?:{_NAME}(?::|=|=>|:=)\s*(?:\\?[\"'`])?|authorization(?:\\?[\"'])?\s*[:=]\s*(?:\\?[\"'])?(?:basic|token)\s+|\bbearer\s+)\Z"
)
_SEPARATOR = re.compile(b"=>|:=|[:=]")
_NAMED = re.compile(rb"(?i)" + _NAME.encode() + rb"\Z")
_IN_QUERY = re.compile(rb"[?&][\w.-]*\Z")
# A quoted value without white space, or a run of signs up to one that ends a value.
_BLANKS = re.compile(rb"\s*+")
_QUOTED = re.compile(rb"\\?\"([^\s\"\\]++)\\?\"|\\?'([^\s'\\]++)\\?'|`([^\s`]++)`")
_RUN = re.compile(rb"[A-Za-z0-9_+/=.\-!@#$%^*~:?|&]*+")
# Addresses, numbers, versions and places to fill in are no secrets.
_PLAIN = re.compile(rb"(?:[a-z]+://|[^@\s]+@[a-z0-9-]+(?:\.[a-z]+)+\Z|v?[\d.,:/+-]+\Z|.*(?:\$\{|\{\{|%\(|<))", re.I)
_KNOWN = re.compile(
    rb"(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|xox[abeoprs]-[A-Za-z0-9-]{10,}"
    rb"|[srp]k_(?:live|test)_[A-Za-z0-9]{16,}|sk-(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{35}|npm_[A-Za-z0-9]{36}"
    rb"|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]*)\.?\Z"
)
_PEM = re.compile(rb"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:(?!-----)(?:[A-Za-z0-9+/=\s:,.\-]|\\[nr]))*(-----END)?")
_PEM_LINE = re.compile(rb"(?:\A|(?<=\s)|(?<=\\[nr]))[A-Za-z0-9+/]+={0,2}(?=\s|\\[nr]|-----|\Z)")
_NEAR = re.compile(r"[^\W_]+")


class Usual:
    """Log shares of byte pairs and counts of words, learned from all documents."""

    def __init__(self, pairs: np.ndarray, words: np.ndarray):
        rows = pairs.reshape(256, 256).astype(float) + 0.1
        self.pairs = np.log2(rows / rows.sum(axis=1, keepdims=True)).astype(np.float32)
        self.frequent = words > max(words.sum() * FREQUENT, 1)

    def transitions(self, data: np.ndarray) -> float:
        return float(self.pairs[data[:-1], data[1:]].mean()) if len(data) > 1 else 0.0

    def coverage(self, data: np.ndarray) -> float:
        """The share of letters that lie in frequent words of three to eight letters."""
        covered, letters = np.zeros(len(data), bool), _KIND[data] >= 2
        lower = np.frombuffer(data.tobytes().translate(LOWER), np.uint8)
        eight = np.ndarray((len(data),), "<u8", lower.tobytes() + bytes(8), strides=(1,))
        for size in range(min(8, len(data)), 2, -1):
            part = eight[: len(data) - size + 1] & np.uint64((1 << 8 * size) - 1 if size < 8 else 2**64 - 1)
            start = mix(np.array([size], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            hashes = mix(start * np.uint64(0xC2B2AE3D27D4EB4F) + part)
            for at in np.flatnonzero(self.frequent[(hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)]):
                covered[at : at + size] = True
        return float((covered & letters).sum() / max(letters.sum(), 1))


def _counts(texts: DataFrame) -> Usual:
    def count(counts: np.ndarray, text: str) -> None:
        data = text.encode()
        raw = np.frombuffer(data, np.uint8).astype(np.int64)
        np.add.at(counts, raw[:-1] << 8 | raw[1:], np.uint32(1))
        slots = (word_hashes(data.translate(LOWER))[0] >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        np.add.at(counts, slots + (1 << 16), np.uint32(1))

    both = counters(texts, (1 << 16) + (1 << WORD_BITS), count).astype(np.int64)
    return Usual(both[: 1 << 16], both[1 << 16 :])


def _key_lines(data: bytes) -> list[tuple[int, int]]:
    """The lines of private keys; a short one only at the end of a whole key."""
    found = []
    for block in _PEM.finditer(data) if b"PRIVATE KEY" in data else ():
        mine = []
        for line in _PEM_LINE.finditer(data, data.index(b"-----", block.start() + 5) + 5, block.start(1) if block[1] else block.end()):
            long = line.end() - line.start() >= SHORTEST
            if _random(line[0]) if long else mine and block[1]:
                mine.append(line.span())
        found += mine
    return found


def _assigned(data: bytes) -> list[tuple[int, int]]:
    """Values assigned to names of credentials.

    A run of value signs is read once, however many names and separators it holds.
    """
    found: list[tuple[int, int]] = []
    run = (0, 0)
    for sign in _SEPARATOR.finditer(data):
        # Names inside of a value belong to it.
        if found and sign.end() < found[-1][1]:
            continue
        before = data[max(sign.start() - 40, 0) : sign.start()]
        if not _NAMED.search(before):
            continue
        start = _BLANKS.match(data, sign.end()).end()
        quoted = _QUOTED.match(data, start)
        if quoted:
            start, end = quoted.span(quoted.lastindex)
        else:
            if not run[0] <= start < run[1]:
                run = (start, _RUN.match(data, start).end())
            end = run[1]
            if end == start or data[end : end + 1] in (b"(", b"["):
                continue
            if _IN_QUERY.search(before) and data.find(b"&", start, end) >= 0:
                end = data.find(b"&", start, end)
            else:
                while end > start and data[end - 1 : end] == b".":
                    end -= 1
        if end - start >= SHORTEST_ASSIGNED and not (found and start < found[-1][1]):
            found.append((start, end))
    return found


def _spans(data: bytes) -> list[tuple[int, int, bool]]:
    """``(start, end, known)`` of the candidates; ``known`` ones are keys by their form or place."""
    taken = [(*span, True) for span in _key_lines(data)]
    keys = [span[:2] for span in taken]
    for start, end in _assigned(data):
        if not any(a < end and start < b for a, b in keys):
            taken.append((start, end, bool(_KNOWN.match(data[start:end]))))
    taken.sort()
    out, at = [], 0
    edges = np.flatnonzero(np.diff(_CHARACTERS[np.frombuffer(data, np.uint8)].astype(np.int8), prepend=0, append=0))
    long = edges[1::2] - edges[0::2] >= SHORTEST - 2
    for start, end in zip(edges[0::2][long].tolist(), edges[1::2][long].tolist()):
        padding = _PADDING.match(data, end)
        end = padding.end() if padding else end
        if end - start < SHORTEST:
            continue
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if at == len(taken) or taken[at][0] >= end:
            out.append((start, end, bool(_KNOWN.match(data[start:end]))))
    return sorted(taken + out)


def _entropy(counts: np.ndarray) -> float:
    share = counts[counts > 0] / counts.sum()
    return float(-(share * np.log2(share)).sum())


def _bucket(word: str, buckets: int) -> int:
    return hashlib.blake2b(word.encode(), digest_size=4).digest()[0] % buckets


def describe(value: bytes, before: str, after: str, path: str, usual: Usual, known: bool = False) -> list[float]:
    """The features of a candidate with the text before and after it."""
    data = np.frombuffer(value, np.uint8)
    kinds = _KIND[data]
    share = np.bincount(kinds, minlength=4) / len(data)
    changes = float((kinds[1:] != kinds[:-1]).mean()) if len(data) > 1 else 0.0
    out = [
        float(len(data)), *share.tolist(), changes, _entropy(np.bincount(data)), float(bool(_HEX.match(value))),
        usual.transitions(data), usual.coverage(data),
        float(before[-1:] in "\"'`" and bool(before)), float(after[:1] in "\"'`" and bool(after)),
        float(before.rstrip("\"'` ")[-1:] in "=:" and bool(before.strip())), float(bool(path) and path.count("/") > 0),
    ]
    near, places = [0.0] * NEAR_BUCKETS, [0.0] * PATH_BUCKETS
    for word in _NEAR.findall(before.lower())[-2:] + _NEAR.findall(after.lower())[:1]:
        near[_bucket(word, NEAR_BUCKETS)] = 1.0
    for word in _NEAR.findall(path.lower()):
        places[_bucket(word, PATH_BUCKETS)] = 1.0
    return [*out, *near, *places, float(known)]


_CANDIDATES = "doc_id long, start long, length int, value_sha256 string, features array<double>, weak_label int"


def candidates(docs: DataFrame, path_column: str | None = "source") -> DataFrame:
    """``_CANDIDATES`` of every text; start counts code points, the value itself is not kept."""
    path = F.coalesce(F.col(path_column).cast("string"), F.lit("")) if path_column in docs.columns else F.lit("")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), path.alias("path"))
    shared = docs.sparkSession.sparkContext.broadcast(_counts(texts.select("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.float64()), pa.int32())
        names = [f.split()[0] for f in _CANDIDATES.split(", ")]
        for batch in batches:
            rows = []
            for doc, text, path in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "path"))):
                data, last, place = text.encode(), 0, 0
                for start, end, known in _spans(data):
                    # Code points before the candidate, counted on from the one before.
                    place, last = place + len(data[last:start].decode()), start
                    value = data[start:end]
                    before = data[max(start - 80, 0) : start].decode("utf-8", "ignore")
                    after = data[end : end + 40].decode("utf-8", "ignore")
                    features = describe(value, before, after, path, shared.value, known)
                    label = int(known or weak_label(value, before))
                    rows.append((doc, place, len(value.decode()), hashlib.sha256(value).hexdigest(), features, label))
            for i in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 5000]), kinds)], names)

    return texts.mapInArrow(run, _CANDIDATES)


def weak_label(value: bytes, before: str) -> int:
    """1 for a random-looking value assigned to a name of credentials, else 0."""
    return int(bool(_ASSIGNED.search(before)) and _random(value))


def _random(value: bytes) -> bool:
    """Whether a value is random to look at; short ones by the kinds of their characters."""
    data = np.frombuffer(value, np.uint8)
    entropy, digits = _entropy(np.bincount(data)), bool(re.search(rb"\d", value))
    if _PLAIN.match(value):
        return False
    if len(value) >= SHORTEST:
        return entropy >= 3 and digits
    kinds = _KIND[data]
    mixed = len(np.unique(kinds)) >= 3 or int((kinds[1:] != kinds[:-1]).sum()) >= 3
    return digits and bool((kinds >= 2).any()) and mixed and entropy >= 0.8 * np.log2(len(value))


def train_forest(labelled: DataFrame, sample: int = SAMPLE, seed: int = 11):
    """A forest over ``(features, label)``, at most ``sample`` of each label; None without both."""
    order = F.xxhash64("features")
    parts = [labelled.where(F.col("label") == value).orderBy(order, "features").limit(sample) for value in (0, 1)]
    rows = settle(parts[0].unionByName(parts[1]).select(array_to_vector("features").alias("vector"), F.col("label").cast("double").alias("label")), "labelled")
    if rows.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=TREES, maxDepth=TREE_DEPTH, seed=seed)
    # One partition of at most twice ``sample`` rows, so that the forest does not depend on their layout.
    return forest.fit(rows.coalesce(1).sortWithinPartitions("label", F.xxhash64("vector")))


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = THRESHOLD, path_column: str | None = "source") -> DataFrame:
    """``(doc_id, start, length, value_sha256, score)`` of what the forest takes for secrets.

    ``labelled``: findings ``(features, label)``; by default candidates with their weak labels.
    """
    found = settle(candidates(docs, path_column), "candidates")
    if labelled is None:
        labelled = found.select("features", F.col("weak_label").alias("label"))
    forest = train_forest(labelled)
    if forest is None:
        return found.select("doc_id", "start", "length", "value_sha256", F.lit(1.0).alias("score"))
    scored = forest.transform(found.withColumn("vector", array_to_vector("features")))
    score = F.round(vector_to_array("probability")[1], 6)
    return scored.select("doc_id", "start", "length", "value_sha256", score.alias("score")).where(F.col("score") >= threshold)

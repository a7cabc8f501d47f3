"""The tree by blocks and subtrees against a recursion over its nodes."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from llm_helpers import AWKWARD, documents, words
from vigil.llm import ctw


class PlainTree:
    """Counts by (context, bits so far), weighted from the leaves up."""

    def __init__(self, texts: list[bytes], depth: int):
        self.depth, self.counts, self.children = depth, defaultdict(lambda: [0, 0]), defaultdict(set)
        for text in texts:
            for context, bits in self.bits(text):
                for d in range(depth + 1):
                    for i, bit in enumerate(bits):
                        self.counts[context[len(context) - d :], bits[:i]][bit] += 1
                        if d:
                            self.children[context[len(context) - d + 1 :], bits[:i]].add(context[len(context) - d :])

    def bits(self, text: bytes):
        data = b"\xff" * self.depth + text + b"\xff"
        for i in range(self.depth, len(data)):
            yield data[i - self.depth : i], tuple(data[i] >> 7 - b & 1 for b in range(8))

    def alone(self, node) -> float:
        a, b = self.counts[node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    def whole(self, node) -> float:
        if len(node[0]) == self.depth:
            return self.alone(node)
        below = sum(self.whole((c, node[1])) for c in self.children.get(node, ()))
        return np.logaddexp(self.alone(node), below) + math.log(0.5)

    def score(self, text: bytes) -> float:
        total = 0.0
        for context, bits in self.bits(text):
            for i, bit in enumerate(bits):
                p = None
                for d in range(self.depth, -1, -1):
                    node = context[len(context) - d :], bits[:i]
                    a, b = self.counts.get(node, (0, 0))
                    mine = ((b if bit else a) + 0.5) / (a + b + 1)
                    w = 1.0 if d == self.depth else math.exp(math.log(0.5) + self.alone(node) - self.whole(node))
                    p = mine if p is None else w * mine + (1 - w) * p
                total += math.log10(p)
        return total


@pytest.mark.parametrize("block_bytes", [60, 1 << 20])
def test_tree_is_that_of_the_recursion(spark, block_bytes, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(ctw, "PACK_BYTES", 40)
    monkeypatch.setattr(ctw, "GROUP_GRAMS", 50)
    rows = [(i, " ".join(rng.choice(["ab", "abc", "É", "c"]) for _ in range(rng.randint(0, 8))).upper()) for i in range(24)]
    found = ctw.score_documents(documents(spark, *rows), block_bytes=block_bytes).collect()
    plain = {i: " ".join(words(t)).encode() for i, t in rows}
    held = {r.doc_id for r in found if r.held_out}
    assert 0 < len(held) < len(rows)
    tree = PlainTree([t for i, t in plain.items() if i not in held], ctw.DEPTH)
    for r in found:
        assert r.score == pytest.approx(tree.score(plain[r.doc_id]), rel=1e-9)
        assert r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / (len(plain[r.doc_id]) + 1))


def test_estimates_of_large_counts():
    for a, b in [(0, 0), (3, 0), (20_000, 7), (1_000_000, 999)]:
        exact = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)
        assert ctw.log_estimate(np.array([a]), np.array([b]))[0] == pytest.approx(exact, rel=1e-9, abs=1e-9)


def test_probabilities_of_the_next_byte_add_up():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.choice(list(b"abc "), 60).tolist()) for _ in range(5)]
    keys, _ = ctw.gram_keys(texts)
    context = int(keys[17]) >> 8 << 8
    grams, counts = np.unique(np.concatenate([keys, np.arange(context, context + 256, dtype=np.uint64)]), return_counts=True)
    counts = counts - ((grams >= context) & (grams < context + 256))
    tree = ctw.Tree(grams, counts, ctw.DEPTH, 0)
    p = np.prod([tree.mix(bit, None, np.arange(len(grams))) for bit in range(8)], axis=0)
    assert p[(grams >= context) & (grams < context + 256)].sum() == pytest.approx(1)


def test_awkward_rows(spark):
    found = ctw.score_documents(documents(spark, *AWKWARD, more="1 AS score")).collect()
    assert len(found) == len(AWKWARD)
    assert {(r.n_tokens, r.n_known) for r in found if r.doc_id in (1, 2, 3)} == {(1, 1)}
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if __import__("zlib").crc32(str(i).encode()) % 7 == 2)
    [row] = ctw.score_documents(documents(spark, (held, "a b"))).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0)
    assert row.base_score == pytest.approx(0) and row.score == pytest.approx(32 * math.log10(0.5))


def test_no_rows(spark):
    assert ctw.score_documents(documents(spark)).collect() == []

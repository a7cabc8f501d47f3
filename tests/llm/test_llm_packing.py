from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from conftest import SF
from llm_helpers import AWKWARD, documents
from vigil.llm import packing

FILE = public_tokenizers.path("byte_bpe_50k.json")


def _check(rows, texts: dict, capacity: int = 1024):
    """Every id of every document is in one place, sequences are gapless and full at most."""
    tokenizer = Tokenizer.from_file(FILE)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for doc, parts in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[doc], add_special_tokens=False).ids, 2], "<u4")
        parts.sort(key=lambda r: r.piece)
        assert [p.start for p in parts] == np.cumsum([0, *[p.length for p in parts]])[:-1].tolist()
        assert sum(p.length for p in parts) == len(ids) and [p.piece for p in parts] == list(range(len(parts)))
        assert all(p.length == capacity for p in parts[1:]) and (len(parts) == 1 or len(ids) > capacity)
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in parts)
    for places in by_sequence.values():
        places.sort()
        assert [at for at, _ in places] == np.cumsum([0, *[n for _, n in places]])[:-1].tolist()
        assert sum(n for _, n in places) <= capacity
    return len(by_sequence), -(-sum(r.length for r in rows) // capacity)


def test_all_documents_have_their_place(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    used, least = _check(packing.pack_documents(docs).collect(), texts)
    assert used <= 1.05 * least


def test_ids_are_the_tokenizers():
    rng = random.Random(1)
    tokenizer, ids = Tokenizer.from_file(FILE), packing.TokenIds(FILE)
    parts = ["a", "don't", "É", " ", "  ", "\n", " ", "12", "!?", "日本", "\x1c", "​", "<|endoftext|>", "Straße", "\r\n", "'s", "_"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) + rng.choice(["", "", " "]) for _ in range(rng.randint(0, 9)))
        assert ids(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_few_sequences():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 1024, 20_000)
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    limit = int(1024 * packing.LARGE)
    plan = packing.LargePlan({k: n for k, n in histogram.items() if k > limit}, 1024, packing.GROUPS)
    big = np.sort(lengths[lengths > limit])
    rank = np.concatenate([np.arange(n) for n in np.unique(big, return_counts=True)[1]])
    load = np.bincount(plan.sequence_of(big, rank), big, plan.sequences).astype(int)
    assert load.max() <= 1024
    rooms = dict(zip(*(x.tolist() for x in np.unique(1024 - load, return_counts=True))))
    moves, opened = packing.best_fit({k: n for k, n in rooms.items() if k}, {k: n for k, n in histogram.items() if k <= limit}, 1024)
    assert sum(m[2] for m in moves) == (lengths <= limit).sum()
    assert plan.sequences + opened <= 1.005 * -(-lengths.sum() // 1024)


def test_configurations_meet_the_demand():
    sizes, demand = np.array([600, 400, 350, 330, 300]), np.array([7, 20, 3, 11, 40])
    plan = packing.configurations(sizes, demand, 1024)
    assert (sum(column * times for column, times in plan) == demand).all()
    assert all(column @ sizes <= 1024 for column, _ in plan)
    # 81 pieces of 30,480 ids need 30 sequences at least.
    assert sum(times for _, times in plan) <= 33


def test_one_length_for_a_third_of_all(spark):
    lengths = [500] * 300 + [1024] * 300 + list(range(1, 301))
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long")
    found = packing.pack(rows).collect()
    places = defaultdict(int)
    for r in found:
        places[r.sequence_id] += r.length
    assert len(found) == 900 and max(places.values()) <= 1024
    assert len(places) <= 1.02 * sum(lengths) / 1024 + 1


def test_awkward_rows(spark):
    rows = [r for r in AWKWARD if r[0] is not None]
    texts = {i: t or "" for i, t in rows}
    found = packing.pack_documents(documents(spark, *rows, more="1 AS length")).collect()
    twice = [r for r in found if r.doc_id == 7]
    assert len(twice) == 2 and len({(r.sequence_id, r.offset) for r in twice}) == 2
    _check([r for r in packing.pack_documents(documents(spark, *rows[:-1])).collect()], texts)
    assert [(r.doc_id, r.length) for r in packing.pack_documents(documents(spark, (None, None))).collect()] == [(None, 1)]


def test_no_rows(spark):
    assert packing.pack_documents(documents(spark)).collect() == []

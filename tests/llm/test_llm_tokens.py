"""Token id files: exact round trips, damage, and the tokenizer's own ids."""

from __future__ import annotations

import random
import struct
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from conftest import SF  # noqa: E402
from llm_helpers import AWKWARD, documents  # noqa: E402
from vigil.llm import tokens  # noqa: E402


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(tokens.default_tokenizer_file())
    made.encode_special_tokens = True
    return made


def plain_ids(tokenizer, text: str | None) -> list[int]:
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, tokens.END_ID]


def plain_table(tokenizer, rows: list[tuple]) -> list[tuple]:
    """(doc_id, start, n_tokens, ids_crc32) of rows whose ids differ."""
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = plain_ids(tokenizer, text)
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_coder_gives_ids_back():
    rng = np.random.default_rng(3)
    blocks = [
        rng.integers(0, 65536, 700), np.full(700, 65535), np.arange(700) % 3, rng.zipf(1.4, 700).clip(0, 49407), np.zeros(650, int),
        np.repeat(rng.integers(0, 65536, 60), 10), np.array([0xFFFF, 0, 0xFFFF, 1]), np.array([5]),
    ]
    blocks = [np.asarray(b, "<u2") for b in blocks]
    payloads = tokens.encode_blocks(blocks)
    for block, back in zip(blocks, tokens.decode_blocks(payloads, [len(b) for b in blocks])):
        assert np.array_equal(block, back)
    # Each block stands for itself: coded alone it gives the same words.
    for block, payload in zip(blocks, payloads):
        assert np.array_equal(tokens.encode_blocks([block])[0], payload)
    assert len(payloads[1]) < 60 and len(payloads[2]) < 60 and payloads[0].nbytes < 1.3 * 1400
    assert tokens.encode_blocks([]) == tokens.decode_blocks([], []) == []


def test_repeating_text_is_small(tokenizer):
    ids = np.array(plain_ids(tokenizer, "the quick brown fox jumps over the lazy dog. " * 150)[: tokens.BLOCK], "<u2")
    assert tokens.encode_blocks([ids])[0].nbytes < ids.nbytes / 8


def test_damage_is_found():
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(0, 3000, 50).astype("<u2").tobytes()) for i in range(20)]
    content = b"\n".join([*tokens._coded(iter(rows), 128, 4), b""])
    whole = [r for part in tokens._documents(content, 3) for r in part]
    assert [(d, np.frombuffer(ids, "<u4").astype("<u2").tobytes()) for d, _, ids in whole] == rows
    assert [at for _, at, _ in whole] == [50 * i for i in range(20)]
    for place in random.Random(1).sample(range(len(content)), 120):
        hurt = bytearray(content)
        hurt[place] ^= 0x10
        with pytest.raises(ValueError):
            list(tokens._documents(bytes(hurt), 3))
    with pytest.raises(ValueError):
        list(tokens._documents(content[:-30], 3))


def test_word_ids_are_the_tokenizers(tokenizer):
    rng = random.Random(2)
    pieces = [
        "the", "It's", "WE'LL", "'S", "''s", "!'s", "don't", "a1b22", "<|endoftext|>", "<|startoftext|>x", "é", "é", "́a", "Ñandú",
        "ΑΣ", "ς", "İ", "ß", "\xa0", "\x85", "\x1c", "\t", "\r\n", " ", "日本語", "🎉🎉", "²½", "\xad", "___", "...", "x" * 100, "ﬁ", "Ĳ", "\x00", "µ", "$5.99",
    ]
    ids_of = tokens.WordIds(tokens.default_tokenizer_file())
    for _ in range(400):
        text = "".join(rng.choice(pieces) + rng.choice(["", " ", "\n", "  "]) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(ids_of(text), "<u2").tolist() == plain_ids(tokenizer, text)[:-1], repr(text)


def test_whole_table(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = sorted(tuple(r) for r in tokens.round_trip(docs).collect())
    assert found == plain_table(tokenizer, [(r.doc_id, r.text) for r in docs.collect()])


def test_many_small_files(spark, tokenizer, tmp_path):
    """Documents run over blocks, files follow each other, and ids come back as written."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["ant", "bee", "Cat", "dog7", "x-ray"]) for _ in range(rng.choice([0, 3, 400])))) for i in range(200)]
    rng.shuffle(rows)
    path = str(tmp_path / "ids")
    tokens.write_files(documents(spark, *rows), path, tokens.default_tokenizer_file(), block=64, file_bytes=8000, together=7)
    assert len(list(Path(path).glob("part-*"))) > 3
    assert sorted(tuple(r) for r in tokens.token_table(spark, path, together=5).collect()) == plain_table(tokenizer, rows)
    ids = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in tokens.read_documents(spark, path, together=5).collect()}
    assert ids == {doc: plain_ids(tokenizer, text) for doc, text in rows}


def test_awkward_rows(spark, tokenizer):
    docs = documents(spark, *AWKWARD, more="1 as start").selectExpr("*", "2 as n_tokens", "'x' as tie", "3 as part")
    found = sorted(tokens.round_trip(docs).collect(), key=lambda r: r.start)
    expected = plain_table(tokenizer, AWKWARD)
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in found if r.doc_id) == sorted((d, n, c) for d, _, n, c in expected if d)
    assert [r.doc_id for r in found] == [d for d, _, _, _ in expected]
    at = 0
    for row in found:
        assert row.start == at
        at += row.n_tokens


def test_empty_table(spark):
    assert tokens.round_trip(documents(spark, (1, "x")).limit(0)).collect() == []


def test_word_forms_are_remembered_once():
    ids = tokens.WordIds(tokens.default_tokenizer_file())
    text = "plain words, plain Words and don't"
    assert ids(text) == struct.pack("<%dH" % len(found := ids.tokenizer.encode(text, add_special_tokens=False).ids), *found)
    assert {"plain", "words,", "and"} <= set(ids.known) and not {"plain", "and"} & set(ids.merged)

"""Token ids in binary files: an adaptive context-mixing range coder in independent blocks.

Documents are ranged by id, tokenised, and their ids run on through blocks of BLOCK ids.
A block starts from an untrained model, so any block can be read by itself.

Model, for each id after its two predecessors:

* order 2 and order 1 each remember the id that followed their context last and how often
  it came true; order 0 keeps adaptive frequencies of ids.
* First a symbol of three says whether order 2's guess, order 1's, or neither comes true.
  Three distributions give its probabilities: by order 2's trust, by order 1's, and by
  the last outcomes; they are mixed by weights that move to whichever was right.
* Where neither is right, order 0 codes the id as four hexadecimal digits, each under an
  adaptive distribution chosen by the digits before it.

Probabilities have 15 bits, and all arithmetic is on integers, so a file reads the same
on every machine.  The coder narrows a range of up to 48 bits and puts out 16 bits at a
time; carries are settled when a block ends.  Blocks are coded side by side: numpy works
on the next id of all of them at once.

File: blocks one after another, each a header, a directory of the documents that begin in
it, the payload and a line feed.  Header (little-endian): magic ``TIDB``, version, number
of ids, of directory entries, of payload words, then CRC-32 of the ids and of the block as
it is stored.  An entry is a flag (1: the id is null), the document id and the place of its
first id in the block.  A document goes on into the next blocks until another one begins.

Defined cases: a null text is an empty one, which has the end id only; null ids come first
and are told apart by place; rows with the same id are all kept, in order of their text's
hash; an empty table gives one file without blocks and no rows; other columns are ignored.
Ids of 65,536 and more are refused.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.llm.common import text_of
from vigil.operators.sizing import small
from vigil.session import scratch_path

END_ID = 1
BLOCK = 2048
# Blocks coded at once, and bytes of text a file is made for.
TOGETHER = 2048
FILE_BYTES = 32 << 20
# Word forms whose ids a task remembers, and texts it holds beside their batch.
REMEMBERED = 400_000
TEXTS = 256

_TOTAL_BITS = 15
_TOTAL = 1 << _TOTAL_BITS
_SLOT_BITS = 11
_AHEAD = 256
_MAGIC, _VERSION = b"TIDB", 1
_HEADER, _ENTRY = struct.Struct("<4sBIIIII"), struct.Struct("<BqI")

class WordIds:
    """Token ids of texts as little-endian 16-bit bytes, from a BPE file that drops white space.

    Such a vocabulary never merges over white space, nor over the cuts it makes inside of
    words, so a text's ids are those of its parts between blanks and line feeds, which
    repeat.  Parts of plain Latin letters and signs are cut and mapped to the vocabulary's
    letters here and only merged by the tokenizer; all others go to it as they are.
    """

    def __init__(self, file: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.cut = regex.compile(_PATTERN).findall
        self.plain = regex.compile("[!-~\u00a1-\u00ff]+").fullmatch
        self.known: dict[str, bytes] = {}
        self.merged: dict[str, bytes] = {}

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        if ids and max(ids) > 0xFFFF:
            raise ValueError("ids of 65,536 and more do not fit the format")
        return struct.pack(f"<{len(ids)}H", *ids)

    def _piece(self, piece: str, part: str) -> bytes:
        ids = self.merged.get(piece)
        if ids is None:
            letters = piece.encode().decode("latin-1").translate(_LETTERS)
            ids = self._packed([token.id for token in self.tokenizer.model.tokenize(letters)])
            # A piece that is the whole part is remembered as that.
            if len(piece) <= 64 and len(piece) < len(part):
                self.merged[piece] = ids
        return ids

    def _part(self, part: str) -> bytes:
        if self.plain(part):
            return b"".join([self._piece(piece, part) for piece in self.cut(part.lower())])
        return self._packed(self.tokenizer.encode(part, add_special_tokens=False).ids)

    def __call__(self, text: str) -> bytes:
        parts = text.replace("\n", " ").split(" ")
        known = self.known
        found = list(map(known.get, parts))
        for i, ids in enumerate(found):
            if ids is None:
                part = parts[i]
                ids = known.get(part)
                if ids is None:
                    ids = self._part(part)
                    if len(part) <= 64:
                        known[part] = ids
                found[i] = ids
        for kept in (known, self.merged):
            if len(kept) > REMEMBERED:
                kept.clear()
        return b"".join(found)


# How the vocabulary cuts words, and the letters it has for bytes that do not print.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_UNPRINTED = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_LETTERS = {b: 256 + i for i, b in enumerate(_UNPRINTED)}


def default_tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# --- the coder -------------------------------------------------------------------

def _targets() -> np.ndarray:
    """For each digit, the starts a distribution moves to: one share for every other digit."""
    places = np.arange(16)
    return np.where(places[None, :] <= places[:, None], places[None, :], _TOTAL - 16 + places[None, :]).astype(np.int16)


_TARGETS = _targets()
_EVEN = (np.arange(16) * (_TOTAL // 16)).astype(np.int16)
# Rows of digit distributions: by 0, 1 and 2 digits before; three of them share 512 rows.
_ROWS = (0, 1, 17, 273)
_SHARED = 512
_ROW_COUNT = 273 + _SHARED


class _Coder:
    """Blocks side by side; encoding when ``ids`` are given, else decoding ``words``.

    Row ``i`` is block ``i``; blocks are in order of length, the longest first, so those
    that still have ids are always the first ``live`` ones.
    """

    def __init__(self, blocks: int):
        self.blocks = blocks
        self.range = np.full(blocks, (1 << 48) - 1, np.uint64)
        self.guess = [np.zeros(blocks << _SLOT_BITS, np.int32) for _ in range(2)]
        self.digits = np.tile(_EVEN, (blocks * _ROW_COUNT, 1))
        third = _TOTAL // 3
        # Starts of the second and third outcome, by (trust of order 2 | 1, whether both agree) and by history.
        self.outcomes = [np.tile(np.array([third, 2 * third], np.int32), (blocks * n, 1)) for n in (8, 8, 27)]
        self.weights = np.tile(np.array([26214, 19661, 19661], np.int32), (blocks, 1))
        self.history = np.zeros(blocks, np.int64)
        self.before = np.zeros((2, blocks), np.int64)

    def begin_encoding(self, steps: int) -> None:
        self.encoding = True
        self.low = np.zeros(self.blocks, np.uint64)
        self.out = np.zeros((self.blocks, steps + 4 * _AHEAD), np.uint32)
        self.at = np.zeros(self.blocks, np.int64)

    def make_room(self) -> None:
        """Room for the words of the next _AHEAD ids, at most five each, and the last three."""
        need = int(self.at.max()) + 5 * _AHEAD + 3
        if need > self.out.shape[1]:
            self.out = np.pad(self.out, ((0, 0), (0, need + self.out.shape[1] // 4 - self.out.shape[1])))

    def begin_decoding(self, words: np.ndarray, starts: np.ndarray) -> None:
        self.encoding = False
        self.words, self.next = words, starts + 3
        first = [words[starts + i].astype(np.uint64) for i in range(3)]
        self.code = first[0] << np.uint64(32) | first[1] << np.uint64(16) | first[2]

    def _narrow(self, rows, share: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Narrow the range of the rows (a slice or places) to [start, end) of its shares."""
        moved = share * start.astype(np.uint64)
        width = share * (end - start).astype(np.uint64)
        if self.encoding:
            low = self.low[rows] + moved
            self.low[rows] = low
        else:
            low = self.code[rows] - moved
            self.code[rows] = low
        self.range[rows] = width
        short = np.flatnonzero(width < np.uint64(1 << 32))
        if len(short):
            places = short if isinstance(rows, slice) else rows[short]
            self.range[places] = width[short] << np.uint64(16)
            if self.encoding:
                some = low[short]
                self.out[places, self.at[places]] = some >> np.uint64(32)
                self.at[places] += 1
                self.low[places] = (some & np.uint64(0xFFFFFFFF)) << np.uint64(16)
            else:
                self.code[places] = low[short] << np.uint64(16) | self.words.take(self.next[places], mode="clip")
                self.next[places] += 1

    def _outcome(self, live: int, order2, order1, agree, came: np.ndarray | None) -> np.ndarray:
        """Code which guess comes true; ``came`` when encoding."""
        rows = slice(0, live)
        numbers = np.arange(live)
        contexts = [numbers * 8 + order2 * 2 + agree, numbers * 8 + order1 * 2 + agree, numbers * 27 + self.history[rows]]
        told = [table.take(context, axis=0) for table, context in zip(self.outcomes, contexts)]
        weights = self.weights[rows]
        mixed = (told[0] * weights[:, 0:1] + told[1] * weights[:, 1:2] + told[2] * weights[:, 2:3]) >> 16
        first = np.clip(mixed[:, 0], 1, _TOTAL - 2)
        second = np.clip(mixed[:, 1], first + 1, _TOTAL - 1)
        share = self.range[rows] >> np.uint64(_TOTAL_BITS)
        if came is None:
            value = np.minimum(self.code[rows] // share, np.uint64(_TOTAL - 1)).astype(np.int32)
            came = (value >= first).astype(np.int64) + (value >= second)
        start = np.where(came == 0, 0, np.where(came == 1, first, second))
        end = np.where(came == 0, first, np.where(came == 1, second, _TOTAL))
        self._narrow(rows, share, start, end)
        # Weights follow how much more a model gave to what came than the mixture did.
        chance = end - start
        gain = [
            (np.where(came == 0, t[:, 0], np.where(came == 1, t[:, 1] - t[:, 0], _TOTAL - t[:, 1])) - chance) >> 5 for t in told[:2]
        ]
        new = [np.clip(weights[:, i] + gain[i], 2048, 30720) for i in range(2)]
        self.weights[rows] = np.stack([*new, 65536 - new[0] - new[1]], axis=1)
        target = np.stack([np.where(came == 0, _TOTAL - 2, 1), np.where(came == 2, 2, _TOTAL - 1)], axis=1).astype(np.int32)
        for table, context, t in zip(self.outcomes, contexts, told):
            table[context] = t + ((target - t) >> 5)
        self.history[rows] = (self.history[rows] * 3 + came) % 27
        return came

    def _digits(self, rows: np.ndarray, ids: np.ndarray | None) -> np.ndarray:
        """Code the ids of some rows digit by digit; ``ids`` when encoding."""
        told, base = np.zeros(len(rows), np.int64), rows * _ROW_COUNT
        places = np.arange(len(rows)) * 16
        for i in range(4):
            at = base + (_ROWS[i] + (told if i < 3 else (told * 40503 >> 3) % _SHARED))
            starts = self.digits.take(at, axis=0)
            share = self.range[rows] >> np.uint64(_TOTAL_BITS)
            if ids is None:
                value = np.minimum(self.code[rows] // share, np.uint64(_TOTAL - 1)).astype(np.int16)
                under = np.bitwise_count((starts <= value[:, None]).view(np.uint64))
                digit = (under[:, 0] + under[:, 1]).astype(np.int64) - 1
            else:
                digit = ids >> (12 - 4 * i) & 15
            flat = starts.ravel()
            start = flat.take(places + digit).astype(np.int32)
            end = flat.take(places + digit + 1, mode="clip").astype(np.int32)
            end[digit == 15] = _TOTAL
            self._narrow(rows, share, start, end)
            self.digits[at] = starts + ((_TARGETS.take(digit, axis=0) - starts) >> 4)
            told = told * 16 + digit
        return told

    def step(self, live: int, ids: np.ndarray | None) -> np.ndarray:
        """Code the next id of the first ``live`` blocks."""
        rows = slice(0, live)
        last, older = self.before[0, rows], self.before[1, rows]
        slots = np.arange(live) << _SLOT_BITS
        mask = (1 << _SLOT_BITS) - 1
        at2 = slots + (((last * 40503 + older * 24989) >> 4) & mask)
        at1 = slots + ((last * 40503 >> 4) & mask)
        held2, held1 = self.guess[0].take(at2), self.guess[1].take(at1)
        id2, id1 = held2 & 0xFFFF, held1 & 0xFFFF
        agree = (id2 == id1).astype(np.int64)
        came = None
        if ids is not None:
            came = np.where(ids == id2, 0, np.where(ids == id1, 1, 2))
        came = self._outcome(live, held2 >> 16, held1 >> 16, agree, came)
        found = np.where(came == 0, id2, id1).astype(np.int64)
        missed = np.flatnonzero(came == 2)
        if len(missed):
            found[missed] = self._digits(missed, None if ids is None else ids[missed])
        for table, at, held, guessed in ((self.guess[0], at2, held2, id2), (self.guess[1], at1, held1, id1)):
            trust = held >> 16
            right = guessed == found
            keep = right | (trust > 1)
            table[at] = np.where(keep, guessed | np.where(right, np.minimum(trust + 1, 3), trust - 1) << 16, found | 1 << 16)
        self.before[1, rows] = last
        self.before[0, rows] = found
        return found


def encode_blocks(blocks: list[np.ndarray]) -> list[np.ndarray]:
    """The payload words of each block of ids; blocks in order of length, longest first."""
    if not blocks:
        return []
    lengths = np.array([len(b) for b in blocks])
    ids = np.zeros((lengths[0], len(blocks)), np.uint16)
    for i, block in enumerate(blocks):
        ids[: len(block), i] = block
    coder = _Coder(len(blocks))
    coder.begin_encoding(int(lengths[0]))
    for t in range(lengths[0]):
        if t % _AHEAD == 0:
            coder.make_room()
        live = int(np.searchsorted(-lengths, -t, side="left"))
        coder.step(live, ids[t, :live].astype(np.int64))
    out, at = coder.out, coder.at
    every = np.arange(len(blocks))
    for shift in (32, 16, 0):
        word = coder.low >> np.uint64(shift)
        out[every, at] = word if shift == 32 else word & np.uint64(0xFFFF)
        at += 1
    # Room that was not needed takes no part in the carries.
    out = out[:, : int(at.max())]
    while True:
        over = out >> 16
        if not over.any():
            break
        out &= 0xFFFF
        out[:, :-1] += over[:, 1:]
    return [out[i, : at[i]].astype("<u2") for i in range(len(blocks))]


def decode_blocks(payloads: list[np.ndarray], lengths: list[int]) -> list[np.ndarray]:
    """The inverse of ``encode_blocks``."""
    if not payloads:
        return []
    sizes = np.array([len(p) for p in payloads])
    coder = _Coder(len(payloads))
    # Damaged words may lead the coder past a payload's end; the checksum tells.
    coder.begin_decoding(np.concatenate(payloads), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    counts = np.array(lengths)
    out = np.zeros((len(payloads), counts[0]), np.uint16)
    for t in range(counts[0]):
        live = int(np.searchsorted(-counts, -t, side="left"))
        out[:live, t] = coder.step(live, None)
    return [out[i, :n] for i, n in enumerate(lengths)]


# --- blocks and files -------------------------------------------------------------

Entry = tuple[int | None, int]


def pack_block(ids: np.ndarray, entries: list[Entry], payload: np.ndarray) -> bytes:
    directory = b"".join(_ENTRY.pack(doc is None, doc or 0, at) for doc, at in entries)
    body = payload.tobytes()
    numbers = (_MAGIC, _VERSION, len(ids), len(entries), len(payload), zlib.crc32(ids.astype("<u2").tobytes()))
    head = _HEADER.pack(*numbers, 0)[:-4]
    return head + struct.pack("<I", zlib.crc32(directory + body, zlib.crc32(head))) + directory + body


def read_blocks(content: bytes) -> Iterator[tuple[int, list[Entry], np.ndarray, int]]:
    """``(ids, directory, payload, checksum)`` of the blocks of a file; what is stored is checked here."""
    at = 0
    while at < len(content):
        if len(content) - at < _HEADER.size:
            raise ValueError("a block is cut off")
        magic, version, n, entries, words, ids_sum, stored_sum = _HEADER.unpack_from(content, at)
        if (magic, version) != (_MAGIC, _VERSION):
            raise ValueError("not a block of token ids")
        start = at + _HEADER.size
        end = start + entries * _ENTRY.size + 2 * words
        if content[end : end + 1] != b"\n":
            raise ValueError("a block is cut off")
        directory = content[start : start + entries * _ENTRY.size]
        if zlib.crc32(content[start:end], zlib.crc32(content[at : start - 4])) != stored_sum:
            raise ValueError("a block is damaged")
        listed = [(None if null else doc, place) for null, doc, place in _ENTRY.iter_unpack(directory)]
        yield n, listed, np.frombuffer(content, "<u2", words, start + len(directory)), ids_sum
        at = end + 1


def decoded(content: bytes, together: int = TOGETHER) -> Iterator[tuple[list[Entry], np.ndarray]]:
    """Directory and ids of every block of a file, in order; checksums are compared."""
    some: list = []

    def decode() -> Iterator[tuple[list[Entry], np.ndarray]]:
        order = sorted(range(len(some)), key=lambda i: -some[i][0])
        found = decode_blocks([some[i][2] for i in order], [some[i][0] for i in order])
        back = dict(zip(order, found))
        for i, (_, listed, _, ids_sum) in enumerate(some):
            if zlib.crc32(back[i].astype("<u2").tobytes()) != ids_sum:
                raise ValueError("a block's ids are damaged")
            yield listed, back[i]
        some.clear()

    for block in read_blocks(content):
        some.append(block)
        if len(some) == together:
            yield from decode()
    yield from decode()


def _coded(rows: Iterator[tuple[int | None, bytes]], block: int, together: int) -> Iterator[bytes]:
    """Blocks of the ids of documents, which come as ``(doc_id, 16-bit ids)``."""
    open_: list[bytes] = []
    entries: list[Entry] = []
    held = 0
    ready: list[tuple[np.ndarray, list[Entry]]] = []

    def close() -> None:
        nonlocal held, open_, entries
        ready.append((np.frombuffer(b"".join(open_), "<u2"), entries))
        open_, entries, held = [], [], 0

    def flush() -> Iterator[bytes]:
        # Only the last block of a file may be shorter, so blocks are in order of length.
        for (ids, listed), payload in zip(ready, encode_blocks([ids for ids, _ in ready])):
            yield pack_block(ids, listed, payload)
        ready.clear()

    for doc, data in rows:
        entries.append((doc, held))
        at = 0
        while at < len(data):
            take = min(len(data) - at, 2 * (block - held))
            open_.append(data[at : at + take])
            at, held = at + take, held + take // 2
            if held == block:
                close()
                if len(ready) == together:
                    yield from flush()
    if held:
        close()
    yield from flush()


def write_files(
    docs: DataFrame, path: str, tokenizer_file: str, end_id: int = END_ID, block: int = BLOCK, file_bytes: int = FILE_BYTES,
    together: int = TOGETHER,
) -> None:
    """Tokenise ``(doc_id, text)`` and write all ids in ascending order of doc_id, files in that order too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = WordIds(tokenizer_file), struct.pack("<H", end_id)

        def rows() -> Iterator[tuple[int | None, bytes]]:
            for batch in batches:
                # A batch may be megabytes of texts; they become Python's a few at a time.
                for at in range(0, len(batch), TEXTS):
                    some = batch.slice(at, TEXTS)
                    for doc, text in zip(some["doc_id"].to_pylist(), some["text"].to_pylist()):
                        yield doc, ids_of(text) + end

        for made in _coded(rows(), block, together):
            yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], ["block"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    size = plain.agg(F.sum(F.octet_length("text").cast("long") + 1)).first()[0] or 0
    ordered = (
        plain.withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(max(1, -(-size // file_bytes)), "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie", "text")
        .select("doc_id", "text")
    )
    # Bytes pass through a text file as they are; the line feed ends a block.
    ordered.mapInArrow(run, "block binary").select(F.col("block").cast("string").alias("value")).write.text(path)


def _parts(spark: SparkSession, path: str) -> DataFrame:
    """Files with their place in the order they were written in."""
    return spark.read.format("binaryFile").load(path).select(
        F.regexp_extract("path", r"part-(\d+)-[^/]*$", 1).cast("long").alias("part"), "content"
    )


def read_documents(spark: SparkSession, path: str, together: int = TOGETHER) -> DataFrame:
    """``(part, doc_id, at, ids)`` of every document in the files, ids as 32-bit bytes, ``at`` within its file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, content in zip(batch["part"].to_pylist(), batch["content"]):
                for rows in _documents(content.as_py(), together):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * len(rows), pa.int64()), *(pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary())))],
                        ["part", "doc_id", "at", "ids"],
                    )

    return _parts(spark, path).mapInArrow(run, "part long, doc_id long, at long, ids binary")


def _documents(content: bytes, together: int) -> Iterator[list[tuple[int | None, int, bytes]]]:
    """Documents of a file in lists of some megabytes."""
    doc, begun, parts, at, done, held = None, None, [], 0, [], 0
    for entries, ids in decoded(content, together):
        wide = ids.astype("<u4").tobytes()
        cuts = [place for _, place in entries] + [len(ids)]
        if begun is not None:
            parts.append(wide[: 4 * cuts[0]])
        elif cuts[0]:
            raise ValueError("a file begins inside a document")
        for (name, place), end in zip(entries, cuts[1:]):
            if begun is not None:
                done.append((doc, begun, b"".join(parts)))
                held += len(done[-1][2])
            doc, begun, parts = name, at + place, [wide[4 * place : 4 * end]]
        at += len(ids)
        if held > 1 << 24:
            yield done
            done, held = [], 0
    if begun is not None:
        done.append((doc, begun, b"".join(parts)))
    if done:
        yield done


def token_table(spark: SparkSession, path: str, together: int = TOGETHER) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, all from the files.

    A document's start is its place in its file and the ids of all files before it, whose
    sums are taken in two steps, so that no task sees the sizes of all files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, content in zip(batch["part"].to_pylist(), batch["content"]):
                for rows in _documents(content.as_py(), together):
                    told = [(part, doc, at, len(ids) // 4, zlib.crc32(ids)) for doc, at, ids in rows]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*told)], names)

    names = ["part", "doc_id", "at", "n_tokens", "ids_crc32"]
    found = _parts(spark, path).mapInArrow(run, ", ".join(f"{n} long" for n in names))
    heads = _parts(spark, path).mapInArrow(_sizes, "part long, n long")
    heads = heads.withColumn("group", F.floor(F.col("part") / 1024))
    before = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = heads.groupBy("group").agg(F.sum("n").alias("n")).select("group", F.sum("n").over(before).alias("above"))
    inside = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = heads.withColumn("inside", F.sum("n").over(inside)).join(groups, "group").select(
        "part", (F.coalesce("above", F.lit(0)) + F.coalesce("inside", F.lit(0))).alias("before")
    )
    return found.join(small(starts), "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of each file, from its blocks' headers."""
    for batch in batches:
        sizes = [sum(n for n, _, _, _ in read_blocks(content.as_py())) for content in batch["content"]]
        yield pa.RecordBatch.from_arrays([batch["part"], pa.array(sizes, pa.int64())], ["part", "n"])


def round_trip(docs: DataFrame, tokenizer_file: str | None = None) -> DataFrame:
    """Write the ids of all documents and tell what the files say of them."""
    path = scratch_path(docs.sparkSession, "token_ids")
    write_files(docs, path, tokenizer_file or default_tokenizer_file())
    return token_table(docs.sparkSession, path)

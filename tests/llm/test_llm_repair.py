"""Conversation repair against plain enumeration of all edits."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import sys
import zlib
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from vigil.llm import repair  # noqa: E402

TURN = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def plain_fault(seen: set, role: str, text: str) -> str:
    if not re.search(r"[^\x20\x09-\x0d]", text):
        fault = "blank"
    elif (role, text) in seen:
        fault = "duplicate"
    else:
        fault = "" if re.search(r"[.!?][\x20\x09-\x0d]*\Z", text) else "truncated"
    seen.add((role, text))
    return fault


def plain_repair(rows: list[tuple[str, str]]) -> tuple[int, str, str]:
    """(cost, audit, digest) by trying every edit of every turn with up to two inserts between them."""
    seen: set = set()
    faults = [plain_fault(seen, *row) for row in rows]
    best = None
    gaps = [()] + [p for n in (1, 2) for p in itertools.product("ua", repeat=n)]
    ways = []
    for (role, text), fault in zip(rows, faults):
        more = 3 if fault == "truncated" else 0
        way = [("D", 4, None)]
        if fault not in ("blank", "duplicate"):
            way += [("K", more, (role, text)), ("R", 3 + more, ("user", text)), ("R", 3 + more, ("assistant", text))]
        ways.append(way)
    for chosen in itertools.product(*ways):
        for inserted in itertools.product(gaps, repeat=len(rows) + 1):
            cost = sum(c for _, c, _ in chosen) + 3 * sum(map(len, inserted))
            if best is not None and cost > best[0]:
                continue
            turns, audit = [], ""
            for i, between in enumerate(inserted):
                turns += [("user" if r == "u" else "assistant", "") for r in between]
                audit += "I" * len(between)
                if i < len(rows):
                    audit += chosen[i][0]
                    turns += [chosen[i][2]] if chosen[i][2] else []
            if not LEGAL.fullmatch("".join(r[:1] or "?" for r, _ in turns)):
                continue
            found = (cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest())
            if best is None or found[:2] < best[:2]:
                best = found
    return best


def _reports(spark, conversations: dict) -> dict:
    turns = [(conv, i, role, text) for conv, rows in conversations.items() for i, (role, text) in enumerate(rows)]
    frame = spark.createDataFrame(turns, TURN)
    return {r.conv_id: r for r in repair.report(frame, repair.plain_turns(frame)).collect()}


def test_equals_enumeration(spark):
    rng = random.Random(4)
    roles, texts = ["system", "user", "assistant", "tool", "", "under"], ["Yes.", "no", " \n", "ok!  ", "", "a.b", "Why?"]
    conversations = {
        i: [(rng.choice(roles[: 3 + 3 * (i % 2)]), rng.choice(texts)) for _ in range(rng.randint(1, 4))] for i in range(60)
    }
    conversations[60] = [("user", "Hi."), ("user", "Hi."), ("assistant", "Yes.")]
    found = _reports(spark, conversations)
    for conv, rows in conversations.items():
        cost, audit, digest = plain_repair(rows)
        assert (found[conv].cost, found[conv].audit, found[conv].repaired_sha256) == (cost, audit, digest), rows
        seen: set = set()
        faults = [plain_fault(seen, *row) for row in rows]
        assert [found[conv][f] for f in ("blank", "duplicate", "truncated")] == [
            faults.count(f) for f in ("blank", "duplicate", "truncated")
        ]
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows, rows[1:])]
        assert found[conv].illegal == sum(p not in ("su", "ua", "au") for p in pairs)


def test_grammar_changes_no_result():
    rng = random.Random(5)
    texts = ["".join(chr(97 + rng.randrange(16)) for _ in range(rng.randint(0, 60))) for _ in range(20)]
    for rules in ([], [("a", "a"), (repair.Grammar.name(0), "e"), ("c", "k")], [("i", "e"), ("e", "i")]):
        grammar = repair.Grammar(rules)
        for text in texts:
            plain = repair.identity()
            for letter in text:
                plain = repair.times(plain, repair.turn_matrix(letter))
            flat = [[c and (c[0], repair.flatten(c[1])) for c in row] for row in grammar.matrix(text)]
            assert flat == [[c and (c[0], repair.flatten(c[1])) for c in row] for row in plain]


def test_rules_come_from_repeats(spark):
    frame = spark.createDataFrame([("aeia" * 8,), ("aeiaaeia",), ("k",)], "symbols string")
    grammar = repair.learn_grammar(frame)
    assert len(grammar.rules) >= 3 and len(grammar.compress("aeia" * 8)) < 8
    assert not repair.learn_grammar(frame.limit(0)).rules
    assert repair.learn_grammar(frame, rules=2).rules == grammar.rules[:2]


def test_pairs_never_overlap():
    assert repair.count_pairs("aaaaa") == {"aa": 2}
    chosen = repair.choose_pairs({"ab": 5, "bc": 4, "ca": 3, "dd": 2, "de": 2, "xy": 1}, 10)
    assert chosen == ["ab", "dd"]


def test_long_conversation_in_segments(spark, monkeypatch):
    """One conversation over several tasks and segments is repaired like one in one piece."""
    rng = random.Random(6)
    rows = [(rng.choice(["user", "assistant", "system"]), f"{rng.choice('abc')}{i % 900}{rng.choice(['.', '', '!'])}") for i in range(3000)]
    monkeypatch.setattr(repair, "SEGMENT", 64)
    found = _reports(spark, {1: rows, 2: rows[:1], 3: rows})[1]
    seen: set = set()
    shapes = "".join(repair.symbol(role[:1], plain_fault(seen, role, text)) for role, text in rows)
    whole = repair.times(repair.Grammar().matrix(shapes), repair.inserts())[0]
    cells = [(whole[s][0], repair.flatten(whole[s][1])) for s in (0, 3) if whole[s]]
    assert (found.cost, found.audit) == min(cells)


def test_damage_follows_the_checksum(spark):
    rows = [(c, t, "assistant", f"One! Two? {t}.") for c in range(20) for t in range(10)]
    left = {}
    for r in repair.damage(spark.createDataFrame(rows, TURN)).collect():
        left.setdefault((r.conv_id, r.turn), []).append((r.role, r.text))
    for c, t, role, text in rows:
        plain = {
            0: None, 1: [(role, "")], 2: [(role, re.sub("[.!?]", "", text))], 3: [(role, text)] * 2, 4: [("user", text)],
        }.get(zlib.crc32(f"{c}:{t}".encode()) % 20, [(role, text)])
        assert left.get((c, t)) == plain


def test_repaired_turns(spark):
    frame = spark.createDataFrame([(1, 0, "assistant", "Hello."), (1, 1, "user", ""), (1, 2, "user", "Go."), (2, 0, "user", " ")], TURN)
    plain = repair.plain_turns(frame)
    made = repair.repaired_turns(plain, repair.audits(plain)).collect()
    assert sorted(tuple(r) for r in made) == [
        (1, 0, "user", "", "insert"), (1, 1, "assistant", "Hello.", "keep"), (1, 2, "user", "Go.", "keep"), (1, 3, "assistant", "", "insert"),
    ]


def test_awkward_rows(spark):
    rows = [
        (1, None, None, None), (1, 5, "user", "x" * 200_000 + "."), (1, 5, "user", "x" * 200_000 + "."), (None, 1, "user", "Hm."),
        (None, 2, "assistant", None), (3, 2**62, "ünt", "Ü."), (3, 0, "user", "Ü."), (4, None, "user", "a\nb: c."),
    ]
    frame = spark.createDataFrame(rows, TURN).selectExpr("*", "1 as cost", "'x' as audit", "2 as digest", "3 as kind")
    found = {r.conv_id: r for r in repair.report(frame, repair.plain_turns(frame)).collect()}
    assert set(found) == {1, None, 3, 4}
    assert (found[1].gaps, found[1].duplicate, found[1].blank) == (0, 1, 1)
    assert found[3].gaps == 2**62 - 1
    assert found[4].gaps == 0 and found[4].audit == "KI"
    digest = hashlib.sha256(b"user:a\nb: c.\nassistant:").hexdigest()
    assert found[4].repaired_sha256 == digest


@pytest.mark.parametrize("keep", [0, 1])
def test_conversations_without_turns(spark, keep):
    turns = spark.createDataFrame([(1, 0, "user", "Hi."), (2, 0, "user", "Hi.")], TURN).limit(2 * keep)
    none = repair.plain_turns(turns).limit(0)
    found = sorted(tuple(r) for r in repair.report(turns, none).collect())
    empty = hashlib.sha256(b"").hexdigest()
    assert found == [(c, 0, 0, 0, 0, 0, 0, "", empty) for c in (1, 2)][: 2 * keep]

"""Conversation repair against a plain search, block by block and whole."""

import hashlib
import random
import re
from zlib import crc32

from topicflow.llm import dialogue

COLUMNS = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, lines) by relaxing all states until nothing changes, over (cost, edits, lines) of every prefix."""
    role_of = {"u": "user", "a": "assistant"}
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    layers = [dict() for _ in range(len(rows) + 1)]
    layers[0][""] = (0, "", ())
    for i, layer in enumerate(layers):
        grown = True
        while grown:
            grown = False
            for s, (c, e, lines) in list(layer.items()):
                t = after[s]
                new = (c + 2, e + "I", lines + (f"{role_of[t]}:",))
                if t not in layer or new[:2] < layer[t][:2]:
                    layer[t], grown = new, True
        if i == len(rows):
            break
        role, text, gone, cut = rows[i]
        for s, (c, e, lines) in layer.items():
            ways = [(s, (c + 3, e + "D", lines))]
            if not gone:
                t = after[s]
                ways.append((t, (c + 2 + cut, e + "R", lines + (f"{role_of[t]}:{text}",))))
                if role[:1] == after[s] or (role[:1] == "s" and s == ""):
                    ways.append((role[:1], (c + cut, e + "K", lines + (f"{role}:{text}",))))
            for t, new in ways:
                if t not in layers[i + 1] or new[:2] < layers[i + 1][t][:2]:
                    layers[i + 1][t] = new
    return min((layers[-1][s] for s in ("", "a") if s in layers[-1]), key=lambda x: x[:2])


def plain(rows, conv_ids):
    out = {}
    for conv in conv_ids:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:32], hashlib.sha256(r[2].encode()).digest()))
        turns = [t for t, _, _ in own if t is not None]
        seen, coded, faults = set(), [], [0, 0, 0]
        for _, role, text in own:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            fault = 0 if not last else 1 if (role, text) in seen else 2 if last[0] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            coded.append((role, text, fault in (0, 1), int(fault == 2)))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(coded, coded[1:]))
        cost, audit, lines = cheapest(coded)
        assert LEGAL.fullmatch("".join(x[:1] for x in lines))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def result(df):
    rows = df.collect()
    got = {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in rows}
    assert len(got) == len(rows)
    return got


def talk(seed, convs, turns):
    rng = random.Random(seed)
    roles, texts = ["system", "user", "assistant", "agent", "tool", "", None], ["Yes.", "No!", "why", "", "  \n", None, "ünd so?", "fin.\t", "x" * 40 + "1.", "x" * 40 + "2."]
    return [(None if c == 0 else c, rng.choice([t, t, t, None, t // 2]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.4 else f"turn {t} {rng.random()}{rng.choice('.!?,')}") for c in range(convs) for t in range(rng.randint(1, turns))]


def test_audits_equal_a_plain_search(spark):
    rows = talk(1, 60, 14)
    frame = spark.createDataFrame(rows, COLUMNS)
    want = plain(plain_damage(rows), {r[0] for r in rows})
    assert result(dialogue.report(frame, dialogue.damage(frame))) == want
    assert len({len(w[6]) for w in want.values()}) > 5 and {c for w in want.values() for c in w[6]} == set("DIKR")


def test_blocks_of_one_conversation_meet_without_a_trace(spark):
    """Four places a block: a conversation of 700 rows is chained from 175 blocks or more, with columns of clashing names beside."""
    rows = [(7, *r[1:]) for r in talk(2, 100, 14)][:700] + talk(3, 5, 30)
    frame = spark.createDataFrame([(*r, 1, "c", 9, "p") for r in rows], COLUMNS + ", at int, code string, block int, piece string")
    want = plain(plain_damage(rows), {r[0] for r in rows})
    assert result(dialogue.report(frame, dialogue.damage(frame), block_bits=2)) == want


def test_repeated_rows_dropped_conversations_and_empty_tables(spark):
    dropped = next(k for k in range(1000) if crc32(f"{k}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "all of it goes."), *[(-5, None, "user", "the same.")] * 300, (-6, -(2**63), "user", "a."), (-6, 2**63 - 1, "assistant", "b.")]
    frame = spark.createDataFrame(rows, COLUMNS)
    got = result(dialogue.report(frame, frame, block_bits=3))
    empty = hashlib.sha256(b"").hexdigest()
    assert got[-5] == (0, 0, 299, 0, 299, 3 * 299 + 2, "K" + "D" * 299 + "I", hashlib.sha256(b"user:the same.\nassistant:").hexdigest())
    assert got[-6][0] is None and got[-6][6] == "KK"
    assert result(dialogue.report(frame, dialogue.damage(frame)))[dropped] == (0, 0, 0, 0, 0, 0, "", empty)
    none = spark.createDataFrame([], COLUMNS)
    assert result(dialogue.report(none, none)) == {}


def test_repaired_rows_are_the_operator_s_own_output(spark):
    rows = [(1, 0, "assistant", "Hello there."), (1, 1, "user", "What now?"), (2, 0, "system", "Be brief."), (2, 1, "user", "So?"), (2, 2, "user", "So?"), (2, 3, "assistant", "Yes.")]
    got = [(r["conv_id"], r["edit"], r["role"], r["text"]) for r in dialogue.repair(spark.createDataFrame(rows, COLUMNS)).rows.collect()]
    assert [x[1:] for x in got if x[0] == 2] == [("K", "system", "Be brief."), ("K", "user", "So?"), ("K", "assistant", "Yes.")]
    assert [x[1:] for x in got if x[0] == 1] == [("I", "user", ""), ("K", "assistant", "Hello there."), ("K", "user", "What now?"), ("I", "assistant", "")]

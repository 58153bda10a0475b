"""Structure repair against all edits of short conversations and a plain table of least costs."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tidemark.llm import structure_repair as repair


def cheapest(rows):
    """(cost, audit) over all edits with up to two insertions a gap; rows are (initial, truncated, doomed)."""
    best = None
    options = [[("D", 3)] if doomed else [("D", 3), ("K", truncated), ("R", 2 + truncated)] for _, truncated, doomed in rows]
    fits = lambda body: len(body) % 2 == 0 and all(c in ("?", "ua"[i % 2]) for i, c in enumerate(body))
    for inserts in itertools.product(range(3), repeat=len(rows) + 1):
        for choice in itertools.product(*options):
            cost = 2 * sum(inserts) + sum(c for _, c in choice)
            audit = "I" * inserts[0] + "".join(letter + "I" * k for (letter, _), k in zip(choice, inserts[1:], strict=True))
            each = iter(rows)
            roles = "".join("?" if x == "I" else {"D": "", "R": "?", "K": row[0] or "#"}[x] for x in audit for row in ([None] if x == "I" else [next(each)]))
            if (fits(roles) or (roles[:1] == "s" and len(roles) > 1 and fits(roles[1:]))) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def test_parser_finds_the_cheapest_edits():
    rng = random.Random(1)
    for _ in range(400):
        rows = [(rng.choice(["s", "u", "a", "u", "a", ""]), rng.random() < 0.3, rng.random() < 0.2) for _ in range(rng.randint(0, 4))]
        tokens = tuple((i, t, False, 1) if not doomed else ("", False, True, 1) for i, t, doomed in rows)
        ends = repair.parse(tokens)
        assert min(ends[s] for s in repair.ACCEPTED if s in ends) == ends["Conversation"] == cheapest(rows)


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        visible = re.findall("[^\x20\x09-\x0d]", text)
        out.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def reference(raw):
    """By conversation the whole report, over states start, system, opened, closed."""
    conversations = {r[0]: [] for r in raw}
    for conv, turn, role, text in raw:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        conversations[conv] += [(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    out = {}
    for conv, rows in conversations.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [r[0] for r in rows if r[0] is not None]
        found = faults_of(rows)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))

        def inserted(states):
            for _ in range(4):
                for s, (cost, audit, left) in list(states.items()):
                    to, role = (3, "assistant") if s == 2 else (2, "user")
                    new = cost + 2, audit + "I", (*left, (role, ""))
                    if to not in states or new < states[to]:
                        states[to] = new
            return states

        states = inserted({0: (0, "", ())})
        for (_, role, text), fault in zip(rows, found, strict=True):
            options = []
            for s, (cost, audit, left) in states.items():
                options.append((s, (cost + 3, audit + "D", left)))
                if fault in ("blank", "duplicate"):
                    continue
                more = fault == "truncated"
                to, full = (3, "assistant") if s == 2 else (2, "user")
                options.append((to, (cost + 2 + more, audit + "R", (*left, (full, text)))))
                if role[:1] == full[0]:
                    options.append((to, (cost + more, audit + "K", (*left, (role, text)))))
                if s == 0 and role[:1] == "s":
                    options.append((1, (cost + more, audit + "K", (*left, (role, text)))))
            states = inserted({s: min(w for t, w in options if t == s) for s, _ in options})
        cost, audit, left = min(states[s] for s in (0, 3) if s in states)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        out[conv] = gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, digest
    return out


@pytest.mark.parametrize("piece_rows", [3, 512])
def test_reports_equal_reference(spark, piece_rows):
    rng = random.Random(7)
    texts = [None, "", " ", "a.", "b", "c?", "d.", "é!", "x\n", "e.", "z.\x0b"] + [f"t{k}." for k in range(30)]
    rows = [(conv, rng.choice([None, *range(90)]), rng.choice([None, "user", "assistant", "system", "tool", "", "u"]), rng.choice(texts)) for conv in (None, 1, 2, 3, 4) for _ in range(rng.choice([1, 40, 150]))]
    rows += [(9, 3, "user", "hi.")] * 100 + [(11, t, "user" if t % 2 else "assistant", "x" * 3000 + ".") for t in range(6)] + [(12, t, "user", "same.") for t in range(40)]
    gone = next(c for c in range(20, 99) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "gone"))
    frame = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "conv_id long, turn long, role string, text string, n int, part string, whole int").repartition(5)
    got = repair.repair_report(repair.repair_conversations(repair.damage(frame), piece_rows, count="n")).collect()
    assert len(got) == len({r.conv_id for r in got})
    assert {r.conv_id: tuple(r)[1:] for r in got} == reference(rows)


def test_repaired_messages_and_empty_table(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "assistant", "Yes."), (2, 0, "system", "Be kind."), (2, 1, "user", "Why?"), (2, 2, "assistant", "So.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: [(m.role, m.text) for m in r.messages] for r in repair.repair_conversations(frame).collect()}
    assert got == {1: [("user", "Hello."), ("assistant", "Yes.")], 2: [("system", "Be kind."), ("user", "Why?"), ("assistant", "So.")]}
    assert repair.repair_report(repair.repair_conversations(frame.limit(0))).collect() == []

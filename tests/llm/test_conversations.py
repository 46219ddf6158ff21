"""Conversation repair against a search over all edits, on small conversations in few and many segments."""

import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import pytest

from quillet.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, conv string, digest int, n string, kind int"
INNER = " \t\n\x0b\x0c\r"


def made(seed=3):
    r = random.Random(seed)
    rows = [(None, 1, "user", "Null conversation."), (None, None, None, None), (1, 5, "user", "alone."), (2, 0, "system", ""), (2, 1, "", "empty role.")]
    rows += [(3, 0, "user", "same."), (3, 0, "user", "same."), (3, 1, "tool", "x! \n"), (3, 2, "Assistant", "y.")]
    rows += [(4, None, "assistant", " \t\x0b"), (4, None, "user", "a b"), (4, 9, "assistant", "end?")]
    for conv in range(10, 60):
        for turn in range(r.randint(0, 6)):
            text = r.choice(["Yes.", "No", "Why?", "", " ", "so it goes ", "End!\n\n", "é", "日本。", "x" * 3000 + "."])
            rows.append((conv, turn if r.random() < 0.9 else r.choice([None, 2]), r.choice(["system", "user", "assistant", "user", "assistant", "other"]), text))
    rows += [(70, t // 2, "ua"[t % 2] + "x", f"m{t}.") for t in range(300)]
    return rows


def wounded(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if draw == 0:
            continue
        if draw == 1:
            text = ""
        if draw == 2:
            text = text.replace(".", "").replace("!", "").replace("?", "")
        if draw == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * (2 if draw == 3 else 1)
    digest = lambda t: hashlib.sha256(t.encode()).digest()[:16]
    return {c: sorted(x, key=lambda y: (y[0] is not None, y[0] or 0, y[1].encode(), digest(y[2]))) for c, x in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(INNER)
        out.append(3 if not bare else 2 if (role, text) in seen else 1 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def legal(initials):
    return "".join(initials) in ("", "s") or all(p in ("su", "ua", "au") for p in map("".join, zip(initials, initials[1:]))) and initials[0] in ("s", "u")


def cheapest(rows, fault):
    """Least cost and, of such, least letters: cheapest first over all edits of all rows."""
    heap = [(0, "", 0, ())]
    while True:
        cost, audit, at, kept = heapq.heappop(heap)
        initials = [k[0][:1] for k in kept]
        if at == len(rows) and (not kept or initials[-1] == "a" and "u" in initials):
            return cost, audit, "\n".join(f"{a}:{b}" for a, b in kept)
        options = [("I", 2, at, (x, "")) for x in ("user", "assistant")]
        if at < len(rows):
            _, role, text = rows[at]
            options.append(("D", 3, at + 1, None))
            if fault[at] < 2:
                options.append(("K", fault[at], at + 1, (role, text)))
                options += [("R", 2 + fault[at], at + 1, (x, text)) for x in ("user", "assistant")]
        for letter, more, to, row in options:
            new = kept + (row,) if row else kept
            if row is None or row[0] and legal([k[0][:1] for k in new]):
                heapq.heappush(heap, (cost + more, audit + letter, to, new))


def forwards(rows, fault):
    """The same by costs and letters from the end, row by row, for long conversations."""
    follow = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    ask = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
    best = {0: (0, "", ()), 1: (4, "II", (("user", ""), ("assistant", ""))), 2: (2, "I", (("assistant", ""),)), 3: (0, "", ())}
    for (_, role, text), f in zip(reversed(rows), reversed(fault)):
        new = {}
        for s in range(4):
            c, l, t = best[s]
            options = [(c + 3, "D" + l, t)]
            if f < 2:
                if (s, role[:1]) in follow:
                    c, l, t = best[follow[s, role[:1]]]
                    options.append((c + f, "K" + l, ((role, text), *t)))
                name, to = ask[s]
                c, l, t = best[to]
                options.append((c + 2 + f, "R" + l, ((name, text), *t)))
            new[s] = min(options)
        for _ in range(2):
            new = {s: min(new[s], (new[ask[s][1]][0] + 2, "I" + new[ask[s][1]][1], ((ask[s][0], ""), *new[ask[s][1]][2]))) for s in new}
        best = new
    return best[0][0], best[0][1], "\n".join(f"{a}:{b}" for a, b in best[0][2])


def expected(rows):
    hurt, out = wounded(rows), {}
    for conv in {r[0] for r in rows}:
        mine = hurt.get(conv, [])
        fault = faults(mine)
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _ in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, text = cheapest(mine, fault) if len(mine) <= 5 else forwards(mine, fault)
        if len(mine) <= 5:
            assert forwards(mine, fault) == (cost, audit, text)
        out[conv] = (gaps, fault.count(3), fault.count(2), fault.count(1), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


@pytest.mark.parametrize("size", [conversations.SEGMENT, 3])
def test_report(spark, size):
    rows = made()
    df = spark.createDataFrame([(*r, "clash", 1, "clash", 2) for r in rows], SCHEMA).repartition(3)
    got = conversations.report(conversations.rows_of(conversations.damaged(df)), df.select("conv_id"), size).collect()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert len(got) == len({r[0] for r in rows})
    assert {r["conv_id"]: tuple(r[n] for n in names) for r in got} == expected(rows)


def test_repaired_rows_and_segments(spark):
    rows = [(5, t // 3, "user", "same words.") for t in range(200)] + [(6, 0, "user", "Hi."), (6, 1, "user", "Hi there")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = conversations.rows_of(df)
    edits = conversations.plan(whole, 16)
    assert edits.where("conv = 5").count() > 10  # a large conversation, copies side by side or not, is cut
    found = conversations.repaired(whole, edits).orderBy("conv", "position").collect()
    assert [(r["conv"], r["position"], r["edit"], r["turn"], r["role"], r["text"]) for r in found] == [
        (5, 0, "K", 0, "user", "same words."), (5, 1, "I", None, "assistant", ""), (6, 0, "K", 0, "user", "Hi."), (6, 1, "R", 1, "assistant", "Hi there"),
    ]


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.report(conversations.rows_of(conversations.damaged(df)), df.select("conv_id")).collect() == []

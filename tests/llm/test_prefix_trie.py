"""The conversation trie against one built in memory."""

import hashlib
import random
import zlib

import pytest

from sitebrief.llm import prefix_trie as T

DDL = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append(((turn is not None, turn or 0), digest, (role, text)))
    own = {c: [x[2] for x in sorted(t)] for c, t in own.items()}
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        seqs[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    children, totals = {}, {}
    for s in members:
        if s:
            children.setdefault(s[:-1], []).append(s)
    for s in sorted(members, key=len, reverse=True):
        below = [totals[x] for x in children.get(s, [])]
        own_saved = (len(members[s]) - 1) * len(s[-1][1].encode()) if s else 0
        totals[s] = (sum(b[0] for b in below) or 1, own_saved + sum(b[1] for b in below))
    out = []
    for s, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(seqs[c]) == len(s)))
        out.append((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(children.get(s, [])), *totals[s],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, limit):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], DDL + ", n long, head string")
    return sorted((tuple(r) for r in T.prefix_trie(df, limit).collect()), key=str)


@pytest.mark.parametrize("limit", [1, 12, 1 << 16])
def test_random_conversations(spark, limit):
    rnd, rows = random.Random(limit), []
    for c in rnd.sample(range(200), 60):
        shared = rnd.random() < 0.4
        for turn in range(rnd.randrange(1, 14)):
            text = f"same {turn}" if shared and turn < 9 else rnd.choice(["a", "é", "", None, "long text " * 3])
            rows.append((c, rnd.choice([turn, turn, turn // 2, None]), rnd.choice(["user", "assistant", None, ""]) if not shared else "user", text))
    rows += rows[:7] + [(None, 1, "user", "lost")]
    rnd.shuffle(rows)
    assert got(spark, rows, limit) == brute(rows)


def test_copies_and_chains(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 200, 5) for t in range(40)]  # copies of one long conversation
    rows += [(c, t, "user", f"turn {t}") for c in range(200, 300, 5) for t in range(c % 37 + 1)]  # prefixes of it
    want = brute(rows)
    assert got(spark, rows, 30) == want and got(spark, rows, 1 << 16) == want


def test_no_conversations_and_no_turns(spark):
    assert got(spark, [], 10) == []
    # 7 takes nothing of its own and its family's first one is absent: it ends at the root.
    c = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    assert got(spark, [(c, 0, "user", "x")], 10) == brute([(c, 0, "user", "x")])


def test_chunks_of_members(spark, monkeypatch):
    monkeypatch.setattr(T, "CHUNK", 16)
    rows = [(c, 0, "user", "x") for c in range(0, 500, 5)]
    assert got(spark, rows, 10) == brute(rows)

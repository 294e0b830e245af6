"""Operator 12 against a trie built in memory."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from quarryflow.llm import prefix_trie
from quarryflow.llm.queries import ORACLE_SQL

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """rows: conv_id, turn, role, text."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        path = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved, out = {}, {}, []
    for path in sorted(members, key=len, reverse=True):
        below = children[path]
        leaves[path] = sum(leaves[b] for b in below) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        saved[path] = (len(members[path]) - 1) * words + sum(saved[b] for b in below)
        digest = hashlib.sha256(",".join(map(str, ends.get(path, []))).encode()).hexdigest()
        out.append((members[path][0], len(path), members[path[:-1]][0] if path else None, len(members[path]), len(below), leaves[path], saved[path], digest))
    return sorted(out, key=repr)


def talk(seed, n=120):
    """Conversations that share beginnings, some of them whole; every id of a multiple of 20 is one, but for one."""
    r = random.Random(seed)
    say = [f"w{i} " * (i % 5) + "end" for i in range(6)]
    rows = []
    for c in range(n):
        if c != 40:
            shared = r.choice([0, 0, 1, 5])
            rows += [(c, t, r.choice("ab") if t >= shared else "a", say[t % 6] if t < shared else r.choice(say)) for t in range(r.randint(1, 9))]
    r.shuffle(rows)
    return rows


def result(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn int, role string, text string, box string, depth int")
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(df, **options).select(*COLUMNS).collect()), key=repr)


@pytest.mark.parametrize(("sequences", "turns"), [(4096, 1 << 16), (3, 1 << 16), (4096, 12), (1, 1)])
def test_equals_brute_force(spark, sequences, turns):
    rows = talk(sequences + turns)
    assert result(spark, rows, sequences=sequences, turns=turns) == brute(rows)


def test_nulls_ties_repeated_rows_and_odd_ids(spark):
    rows = [
        (1, None, "a", "first"), (1, 0, None, "second"), (1, 1, "a", None), (1, 1, "b", "tie"), (1, 1, "b", "tie"), (None, 0, "a", "nobody"), (0, 0, "a", "base"),
        (-3, 0, "a", "below"), (-20, 0, "a", "x"), (-21, 5, "a", "x"), (7, 0, "", ""), (27, 0, "ab", "c"), (47, 0, "a", "bc"), (2**62, 0, "u", "large"), (5, 0, "a", "one turn"),
    ]
    assert result(spark, rows) == brute(rows)
    assert result(spark, rows, sequences=1) == brute(rows)
    assert result(spark, []) == []
    assert result(spark, [(None, 0, "a", "b")]) == []


def test_one_sequence_of_many_conversations_and_a_long_one(spark, monkeypatch):
    """Copies collapse; their ids are joined in portions; a conversation of thousands of turns is one suffix."""
    monkeypatch.setattr(prefix_trie, "JOINED", 7)
    rows = [(c * 100, t, "a", f"same {t}") for c in range(60) for t in range(3)] + [(7, t, "u", f"turn {t % 50}") for t in range(3000)]
    assert result(spark, rows) == brute(rows)


def test_shared_chains_burst_at_once(spark):
    """Two hundred common turns are one chain, not two hundred rounds."""
    rows = [(c * 100, t, "a", f"common {t}" if t < 200 else f"own {c} {t}") for c in range(12) for t in range(203)]
    assert result(spark, rows, sequences=4) == brute(rows)


def test_sql_equals_brute_force():
    rows = [*talk(3, 60), (None, 0, "a", "x"), (81, None, None, None), (-3, 0, "a", "b")]
    c = duckdb.connect()
    c.sql("CREATE TABLE conversations (conv_id BIGINT, turn INT, role VARCHAR, text VARCHAR)")
    c.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    q = c.sql(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE_SQL['op12_prefix_trie']})").fetchall()
    assert sorted(q, key=repr) == brute(rows)

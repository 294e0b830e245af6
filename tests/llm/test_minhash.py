"""Operator 13 against exact similarities of all pairs."""

import random
import re

import duckdb
import numpy as np

from quarryflow.llm import minhash
from quarryflow.llm.queries import ORACLE_SQL

from .helpers import documents, edge_rows, prose


def sets_of(rows, shingle=3):
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())
    return out


def brute(rows):
    sets = sets_of(rows)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None] if sets[i] else [doc]
        least = min(ids, default=None)
        out.append((doc, len(sets[i]), least, doc == least))
    return sorted(out, key=repr)


def families(seed, n=60, members=8):
    """Texts with copies of which a few words are changed, so that similarities lie on both sides of the threshold."""
    r = random.Random(seed)
    rows = []
    for f in range(n):
        words = prose(seed * 1000 + f, r.randint(3, 160)).split()
        for _ in range(r.randint(1, members)):
            copy = list(words)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
                copy[r.randrange(len(copy))] = prose(r.randrange(10**6), 1)
            rows.append((len(rows), " ".join(copy)))
    return rows


def result(spark, rows, **options):
    got = minhash.minhash_groups(documents(spark, rows), **options).select("doc_id", "n_shingles", "component_id", "kept").collect()
    return sorted(map(tuple, got), key=repr)


def test_equals_exact_similarities(spark):
    rows = families(1)
    want = brute(rows)
    assert 50 < sum(w[0] != w[2] for w in want) < len(rows) - 80
    assert result(spark, rows) == want


def test_edge_rows(spark):
    """Nulls, empty and very long texts, repeated rows, short texts, clashing columns, an empty table."""
    rows = [*edge_rows(), (9, "one two"), (10, "ONE  two"), (11, "two one"), (None, "one two"), (12, "one")]
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == []


def test_exactly_85_percent_is_linked(spark):
    """17 common shingles of 20 are linked, 16 of 19 are not."""
    words = [f"w{i}" for i in range(20)]
    a, b = words[:20], words[:19] + ["x", "y"]  # 18 and 19 shingles, 17 common
    assert [len(s) for s in sets_of([(1, " ".join(a)), (2, " ".join(b))])] == [18, 19]
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(f"v{i}" for i in range(19))), (4, " ".join([*(f"v{i}" for i in range(18)), "x", "y"]))]
    want = brute(rows)
    assert [w[2] for w in want] == [1, 1, 3, 3][: len(want)] or [w[2] for w in want] == [1, 1, 3, 4]
    assert result(spark, rows) == want


def test_large_families_in_small_chunks(spark, monkeypatch):
    """Hot lists and centres are split; unlike members of a family whose centres differ are still found."""
    for name, value in (("MEET", 16), ("CHUNK", 8)):
        monkeypatch.setattr(minhash, name, value)
    r = random.Random(9)
    words = prose(77, 90).split()
    rows = []
    for i in range(150):
        copy = list(words)
        for _ in range(i % 4):
            copy[r.randrange(len(copy))] = prose(r.randrange(10**6), 1)
        rows.append((i, " ".join(copy)))
    assert result(spark, rows) == brute(rows)


def test_a_third_of_all_rows_are_copies(spark):
    rows = [(i, prose(5, 50) if i % 3 == 0 else prose(100 + i, 50)) for i in range(300)]
    assert result(spark, rows) == brute(rows)


def test_signatures_agree_as_often_as_sets_are_similar():
    r = np.random.default_rng(2)
    for n, both in ((20, 17), (200, 170), (2000, 1700)):
        agree = []
        for _ in range(60):
            h = r.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64)
            a, b = h[: both + (n - both) // 2], np.concatenate((h[:both], h[both + (n - both) // 2 :]))
            agree.append((minhash.signature(a) == minhash.signature(b)).mean())
        assert abs(np.mean(agree) - both / n) < 0.02
        assert min(agree) * minhash.COORDINATES >= minhash.THRESHOLD


def test_sql_equals_exact_similarities():
    rows = [*families(3, 20), (None, None), (900, ""), (901, "a"), (None, "a")]
    c = duckdb.connect()
    c.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    q = c.sql(f"SELECT doc_id, n_shingles, component_id, kept FROM ({ORACLE_SQL['op13_minhash']})").fetchall()
    assert sorted(q, key=repr) == brute(rows)

"""Operator 11 against brute force: every edit of every word."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from quarryflow.llm import spelling
from quarryflow.llm.queries import ORACLE_SQL

from .helpers import documents, edge_rows

LETTERS = [chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)]]


def brute(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[a-zÀ-ÿ]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    form, near = {}, {}
    for w in n:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in LETTERS}
        edits |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in LETTERS}
        found = sorted(((-n[x], x) for x in edits - {w} if x in n))
        near[w] = len(found)
        if found and -found[0][0] >= 2 * n[w]:
            form[w] = found[0][1]
    out = set()
    for w, k in n.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, k, near[w], n.get(form.get(w))))
    return out


def near_rows(seed, words=60, n=400):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(4, 8))) for _ in range(words)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(30):
            w = r.choice(vocabulary[: r.randint(1, words)])
            at = r.randrange(len(w))
            text.append(r.choice([w, w, w.upper(), w[:at] + w[at + 1 :], w[:at] + r.choice("abcÿ") + w[at:], w[:at] + "d" + w[at + 1 :]]))
        rows.append((i, r.choice([" ", ", ", "1"]).join(text)))
    return rows


def result(spark, rows):
    got = [tuple(r) for r in spelling.spelling_variants(documents(spark, rows)).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len({g[0] for g in got})
    return set(got)


def test_equals_brute_force(spark):
    rows = near_rows(1)
    want = brute(rows)
    assert len(want) > 500 and sum(w[1] is not None for w in want) > 200
    assert result(spark, rows) == want


def test_chains_of_forms_lead_to_the_last(spark):
    chain = ["aaaaaaaa", "aaaaaaab", "aaaaaabb", "aaaaabbb", "aaaabbbb", "aaabbbbb", "aabbbbbb"]
    rows = [(1, " ".join(w for i, w in enumerate(chain) for _ in range(3 * 2**i)))]
    got = {g[0]: g for g in result(spark, rows)}
    assert {got[w][2] for w in chain if w in got} <= {chain[-1]}
    assert result(spark, rows) == brute(rows)


def test_edge_rows_and_ties(spark):
    """Nulls, empty, long texts, repeated rows, clashing columns; two equally frequent forms: the smaller one."""
    rows = [*edge_rows(), *[(20, "abcdef " * 3)] * 2, *[(21, "abcdxf abcdyf " * 13)] * 2, (None, "Straße STRASSE ÀÉÎÕÜ àéîõü " * 4)]
    want = brute(rows)
    assert result(spark, rows) == want
    assert [w[1] for w in want if w[0] == "abcdef"] == ["abcdxf"]
    assert result(spark, []) == set()


def test_pivots_are_the_lightest_disjoint_grams():
    r = random.Random(4)
    for _ in range(300):
        places = sorted(r.sample(range(9), r.randint(3, 7)))
        grams = [(p, r.randrange(5)) for p in places]
        got = spelling.pivots(grams)
        pairs = [a[1] + b[1] for a in grams for b in grams if a[0] + 2 <= b[0]]
        assert got[0][0] + 2 <= got[1][0] and got[0][1] + got[1][1] == min(pairs)
    with pytest.raises(ValueError):
        spelling.pivots([(0, 1), (1, 1)])


def test_words_of_one_bigram_only(spark):
    """All bigrams alike: ties are kept whole."""
    rows = [(1, " ".join("a" * n for n in range(5, 12) for _ in range(4)))]
    assert result(spark, rows) == brute(rows)


def test_sql_equals_brute_force(tmp_path):
    rows = near_rows(7, 25, 60)
    c = duckdb.connect()
    c.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", [*rows, (None, None)])
    q = c.sql(ORACLE_SQL["op11_spelling_variants"]).fetchall()
    assert set(q) == brute(rows)

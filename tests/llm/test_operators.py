"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on edge cases."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarryflow.llm import decontaminate, html_extract, license_scan, near_dedup, packing, pii, quality, queries, rolling, sharding, simhash, substring_dedup, topk
from quarryflow.llm.components import connected_components
from quarryflow.llm.common import store, with_positions

from .helpers import documents, edge_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


# Shared parts


def test_stretches_hash_alike_wherever_they_are():
    w = rolling.Words(["a b c", "x a b c y", "", "b"])
    h, ok = w.windows(3)
    assert h[0] == h[4]
    assert ok.tolist() == [True, False, False, True, True, True, False]
    assert len(set(w.hash.tolist())) == 5


def test_winnowing_picks_the_least_of_every_window():
    r = np.random.default_rng(3)
    h = r.integers(0, 40, 300).astype(np.uint64)
    chosen, least = rolling.winnowed(h, np.ones(300, bool), np.ones(300, bool), 7)
    want = {i for s in range(294) for i in range(s, s + 7) if h[i] == h[s : s + 7].min()}
    assert set(np.flatnonzero(chosen)) == want
    assert least.tolist() == [h[s : s + 7].min() for s in range(294)]


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(64)] + [(5, 5), (None, 2)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {v.node: v.root for v in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent if find(n) != n}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1: quality


def test_quality_learns_and_holds_out(spark):
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        text = prose(i, 60) if good else " ".join(f"{w}!!" for w in prose(i, 60).upper().split())
        rows.append((i, text))
        labels.append((i, int(good), 0))
    lab = spark.createDataFrame([*labels, (0, None, 0), (None, 1, 0), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.classify(documents(spark, [*rows, *edge_rows()]), lab, quality.Settings(buckets=1 << 12)).collect()
    held = [r for r in got[:400] if r.held_out]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert len(held) > 50
    assert np.mean([r.predicted == (r.doc_id % 3 > 0) for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    assert len(got) == 411


def test_quality_training_is_bounded_by_rows_and_bytes(spark):
    """Repeated ids, very long documents and unlike texts of one id teach one bounded row each."""
    s = quality.Settings(sample_per_class=30, sample_chars=200_000, buckets=1 << 12)
    rows = [(i, prose(i, 40)) for i in range(60) for _ in range(20)] + [(1, prose(999, 20_000)), (2, None)]
    lab = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    chosen = quality._balanced(documents(spark, rows), lab, F.lit(True), s).collect()
    assert sorted(r.doc_id for r in chosen) == list(range(60))
    least = {}
    for i, t in rows:
        least[i] = min(t or "", least.get(i, t or ""))
    assert {r.doc_id: r.text for r in chosen} == least
    assert quality.fit(documents(spark, rows), lab, None, s).weights.shape == (1 << 12,)


def test_quality_takes_documents_whole(spark):
    """A long document counts in full: its rarest feature teaches; beyond the bound later documents are left out, never a part of one."""
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(0, long + " rareword"), (1, long + " otherword"), *[(i, prose(i, 20)) for i in range(2, 40)]]
    lab = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    sizes = {}

    def spy(documents, classes, s):
        sizes[s.sample_chars] = [(len(ids), float(part.sum())) for ids, part in documents]
        return quality.Model(np.zeros(s.buckets), 0.0, s)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(quality, "train", spy)
        for most in (10**6, 2000, 1):
            quality.fit(documents(spark, rows), lab, None, quality.Settings(sample_chars=most))
    assert len(sizes[10**6]) == 40 and max(sizes[10**6])[0] > 8000
    assert len(sizes[1]) == 2 and 2 < len(sizes[2000]) < 40
    assert all(s[1] == pytest.approx(1) for x in sizes.values() for s in x)


def test_quality_scores_equal_plain_loops():
    """Every feature by itself, without arrays over all texts."""
    s = quality.Settings(buckets=1 << 10)
    r = np.random.default_rng(1)
    model = quality.Model(r.normal(size=s.buckets), 0.3, s)
    texts = ["", "a", "Ab cd  ab", prose(4, 50), "é ß\n漢字 la la la", " " * 5]
    for t, got in zip(texts, model.scores(texts), strict=True):
        found = []
        hashes = [int(rolling.Words([w]).hash[0]) for w in words(t)]
        found += [h % s.buckets for h in hashes]
        found += [int(rolling.mix(np.array([(b * quality._PAIR + a) % 2**64], np.uint64))[0]) % s.buckets for a, b in zip(hashes, hashes[1:], strict=False)]
        for back in (1, 2):
            mark = int(rolling.mix(np.array([quality._AGAIN + back], np.uint64))[0]) % s.buckets
            found += [mark for a, b in zip(hashes, hashes[back:], strict=False) if a == b]
        for n in s.ngrams:
            for p in range(len(t) - n + 1):
                h = n
                for c in t[p : p + n]:
                    h = (h * quality._GRAM + ord(c)) % 2**64
                found.append(int(rolling.mix(np.array([h], np.uint64))[0]) % s.buckets)
        want = 1 / (1 + np.exp(-(sum(model.weights[i] for i in found) / max(1, len(found)) + 0.3)))
        assert got == pytest.approx(want, abs=1e-9)


def test_quality_without_labels_scores_a_half(spark):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.classify(documents(spark, edge_rows()), lab).collect()} == {0.5}
    assert quality.classify(documents(spark, []), lab).count() == 0


def test_quality_on_the_given_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op1_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.93


# 2: substrings


def brute_repeats(rows, window):
    seen = Counter(tuple(w[i : i + window]) for _, t in rows for w in [words(t)] for i in range(len(w) - window + 1))
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if seen[tuple(w[s : s + window])] > 1:
                gone[s : s + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("window", [2, 5, 12, 35])
def test_substrings_equal_brute_force(spark, window):
    r = random.Random(window)
    passages = [prose(100 + i, r.randint(3, 90)) for i in range(12)]
    rows = edge_rows() + [(20 + i, " ".join(x for _ in range(r.randint(1, 4)) for x in (prose(1000 + r.randrange(10**6), r.randint(0, 30)), r.choice(passages)))) for i in range(40)]
    rows += [(70, "la " * 200), (71, "la " * 36), (72, "a b " * 60), (73, passages[0] + " " + passages[0])]
    got = substring_dedup.remove_repeats(documents(spark, rows), window).drop("kept")
    assert as_rows(got) == sorted(brute_repeats(rows, window), key=repr)


def test_substrings_of_hard_words_and_hot_rows(spark):
    """Words that defeat polynomial hashes modulo 2^64, one row many times, long paths, colliding null ids."""
    tm = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    mirror = tm.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{tm} " + prose(1, 34)), (2, f"{mirror} " + prose(1, 34)), (3, f"{tm} " + prose(1, 34))]
    rows += [(7, prose(7, 60))] * 300 + [(None, prose(8, 3000)), (None, prose(9, 10) + " " + prose(8, 3000))]
    rows += [(None, prose(100 + i, 40)) for i in range(50)]
    got = substring_dedup.remove_repeats(documents(spark, rows)).drop("kept")
    assert as_rows(got) == sorted(brute_repeats(rows, 35), key=repr)


def test_paths_end_at_their_heads(spark):
    """A text that occurs twice is one path; its length comes by doubling, whatever the number of anchors."""
    rows = substring_dedup.numbered_rows(documents(spark, [(1, prose(5, 500)), (2, prose(5, 500))]))
    anchors = store(rows.select("row", "text").mapInArrow(substring_dedup._anchor_rows(35), "anchor long, row long, pos int, gap int, next long"), "test-anchors")
    found = [r.length for r in substring_dedup._paths(anchors, 35).collect()]
    spread = anchors.groupBy("row").agg((F.max("pos") - F.min("pos") + 18).alias("n")).collect()
    assert [x for x in found if x is not None] == [spread[0].n]
    assert len(found) > 20


def test_substrings_of_nothing(spark):
    assert substring_dedup.remove_repeats(documents(spark, [])).count() == 0


# 3: licenses


def test_licenses(spark):
    mit = next(t for n, f, t in license_scan.TEMPLATES if (n, f) == ("MIT", "notice"))
    edited = mit.replace("free of charge, ", "").replace("Software", "Library")
    rows = [(1, prose(1, 50) + "\nReleased under the MIT License.\n" + prose(2, 50)), (2, "x " + edited + " y"), (3, "LICENSED UNDER\n the apache license -- version 2.0"), (4, "license of nothing"), (5, mit + " between " + mit), *edge_rows()]
    got = license_scan.scan_licenses(documents(spark, rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {1, 2, 3, 5}
    assert rows[0][1][by[1][0].start : by[1][0].end] == "Released under the MIT License"
    assert [(r.license, r.form) for r in by[2]] == [("MIT", "notice")]
    assert 0.8 <= by[2][0].coverage < 1
    assert rows[1][1][by[2][0].start : by[2][0].end].startswith("Permission is")
    assert [(r.license, r.coverage) for r in by[3]] == [("Apache-2.0", 1.0)]
    assert len(by[5]) == 2
    assert license_scan.scan_licenses(documents(spark, [])).count() == 0


def test_adjacent_license_copies_are_each_found(spark):
    line = "Released under the MIT License"
    rows = [(1, " ".join([line] * 4)), (2, f"{line} (c) 2020 {line}"), (3, "\n".join([line] * 30)), (4, line + " Licensed under CC BY-NC 4.0" * 3)]
    got = license_scan.scan_licenses(documents(spark, rows)).collect()
    spans = {i: sorted((r.start, r.end) for r in got if r.doc_id == i and r.license == "MIT") for i, _ in rows}
    assert spans == {i: [m.span() for m in re.finditer(line, t)] for i, t in rows}
    assert sum(r.doc_id == 4 and r.license == "CC-BY-NC-4.0" for r in got) == 3


def plain_words(t):
    return [m.group() for m in re.finditer(r"[a-z0-9]+", t.lower())]


def common_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = list(row)
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(row[j], old[j + 1])
    return row[-1]


def test_licenses_equal_brute_force(spark):
    """Every template against every place of every text by whole alignment: the same texts match the same licenses."""
    r = random.Random(3)
    templates = [t for t in license_scan.TEMPLATES if len(plain_words(t[2])) < 75]
    rows = []
    for i in range(60):
        _, _, text = templates[i % len(templates)]
        w = text.split()
        for _ in range(r.choice((0, 1, 2, len(w) // 12, len(w) // 4))):
            p = r.randrange(len(w))
            w[p : p + 1] = r.choice(([], ["other"], [w[p], "more"]))
        rows.append((i, f"{prose(i, r.randint(0, 25))} {' '.join(w)} {prose(i + 80, r.randint(0, 25))}"))
    got = license_scan.scan_licenses(documents(spark, rows), templates).collect()
    text_of = dict(rows)
    for row in got:
        template = plain_words(next(t for n, f, t in templates if (n, f) == (row.license, row.form)))
        assert row.matched_words == common_length(template, plain_words(text_of[row.doc_id][row.start : row.end]))
        assert row.coverage == pytest.approx(row.matched_words / len(template), abs=1e-6) and row.coverage >= 0.8
    found = {(x.doc_id, x.license, x.form) for x in got}
    want, sure = {}, set()
    for i, t in rows:
        w = plain_words(t)
        for name, form, text in templates:
            template = plain_words(text)
            size = len(template) + 8
            best = max(common_length(template, w[p : p + size]) for p in range(max(1, len(w) - size + 1)))
            if best >= 0.8 * len(template):
                want.setdefault(i, {})[name, form] = (best / len(template), best)
    for i, matches in want.items():  # of sister templates on one passage the better one stands
        for k, (share, n) in matches.items():
            if not any(s > share and m >= n for s, m in matches.values()):
                sure.add((i, *k))
    assert len(sure) > 30
    assert sure - found == set()
    assert {(i, n, f) for i, n, f in found if (n, f) not in want.get(i, {})} == set()


def test_license_copies_parted_by_inserted_words_are_found(spark):
    """Up to 64 words in the middle, or 20 at two places; not where parts of the template come in another order."""
    apache = next(t for n, f, t in license_scan.TEMPLATES if (n, f) == ("Apache-2.0", "notice")).split()
    third, half = len(apache) // 3, len(apache) // 2

    def text(*parts):
        return prose(91, 30) + " " + " ".join(" ".join(p) if isinstance(p, list) else prose(p, p) for p in parts) + " " + prose(92, 30)

    rows = [(n, text(apache[:half], n, apache[half:])) for n in (8, 9, 12, 30, 64)]
    rows += [(100, text(apache[:third], 20, apache[third : 2 * third], 20, apache[2 * third :])), (101, text(apache[half:], 12, apache[:half])), (102, text(apache[:half], 12, prose(7, 9).split())), (103, text(apache[:half], 400, apache[half:]))]
    rows += [(104, text(apache[:half], 12, apache[half:], 50, apache, 50, apache[:half], 12, apache[half:]))]
    got = [r for r in license_scan.scan_licenses(documents(spark, rows)).collect() if (r.license, r.form) == ("Apache-2.0", "notice")]
    assert sorted(r.doc_id for r in got) == [8, 9, 12, 30, 64, 100, 104, 104, 104]
    whole = dict(rows)
    for r in got:
        words = (whole[r.doc_id][r.start : r.end] + ".").split()
        assert (words[:5], words[-5:]) == (apache[:5], apache[-5:]) and r.coverage >= 0.95


def test_many_license_copies_take_linear_time(spark):
    line = "Released under the MIT License. Licensed under CC BY-SA 4.0\n"
    rows = [(1, line * 2000)]
    got = license_scan.scan_licenses(documents(spark, rows)).groupBy("license").count().collect()
    assert {r.license: r["count"] for r in got} == {"MIT": 2000, "CC-BY-SA-4.0": 2000}


def test_license_alignment_is_the_longest_common_subsequence_in_its_band():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.randrange(4) for _ in range(r.randint(1, 9))] for _ in range(2))
        want = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                want[i + 1][j + 1] = max(want[i][j] + (a[i] == b[j]), want[i][j + 1], want[i + 1][j])
        n, first, last = license_scan.aligned(np.array(a, np.uint64), np.array(b, np.uint64), 0, 12)
        assert n == want[-1][-1]
        assert n == 0 or 0 <= first < last <= len(b)


# 4: html


def page(body, extra=""):
    menu = "".join(f"<li><a href='/{i}'>Item {i}</a></li>" for i in range(4))
    return f"<!DOCTYPE html><html><head><title>T</title><script>var a='</p>';</script></head><body><header>Site</header><nav><ul>{menu}</ul></nav>{body}<div class='cookie-notice'>We use cookies</div>{extra}<footer>&copy; x</footer></body></html>"


def test_html(spark):
    art = "<article><h1>A &amp; B</h1><p>One\n two<br>three</p><p><b>Open<p>Next &lt;tag&gt;</p><form><p>mail</p></form><aside>see</aside><!-- <p>no</p> --><section class='comments'><p>first!</p></section></article>"
    rows = [
        (1, "http://a.example/1", page(art)),
        (2, "http://a.example/2", page("<article><p>Other</p></article>")),
        (3, "http://b.example/1", page("<div id=content><p>alpha</p><p>beta</p></div><div id=promo2>Same words</div>")),
        (4, "http://b.example/2", page("<div id=content><p>gamma</p><p>delta</p><p>eps</p></div><div id=promo2>Same words</div>")),
        (5, "http://b.example/3", page("<div id=content><p>zeta</p></div><div id=promo2>Same words</div>")),
        (6, None, None), (7, "http://c.example/", ""), (8, "http://c.example/", "plain text"), (9, "http://c.example/x", "<p>cut off <b"),
        (1, "http://a.example/1", page(art)),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, rule string")
    got = {r.page_id: r for r in html_extract.extract_pages(df).collect()}
    assert got[1].text == "A & B\nOne two three\nOpen\nNext <tag>"
    assert got[2].text == "Other"
    assert [got[i].text for i in (3, 4, 5)] == ["alpha\nbeta", "gamma\ndelta\neps", "zeta"]
    assert [got[i].text for i in (6, 7, 8)] == ["", "", "plain text"]
    assert got[9].text.startswith("cut off")
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def test_wrappers_generalise():
    a, b = "<ul><li>1</li><li>2</li></ul><p>x</p>", "<ul><li>3</li></ul><h2>n</h2><p>y</p>"
    assert html_extract.expression(html_extract.infer([a, b])) == "<ul>(<li>#PCDATA</li>)+</ul>(<h2>n</h2>)?<p>#PCDATA</p>"


def test_every_page_of_a_host_takes_part_by_its_kind(spark):
    rules = "<p>Read our house rules first</p>"
    rows = [(i, "http://h.example/", page(f"<article><h1>t{i}</h1><p>{prose(i, 9)}</p><p>{prose(i + 100, 9)}</p>{rules}</article>")) for i in range(40)]
    # another kind without article; a line that only some of its pages have is no boilerplate
    rows += [(i, "http://h.example/", page(f"<div id=text><p>{prose(i, 9)}</p><p>{prose(i + 100, 9)}</p>{'<p>Now and then</p>' if i % 20 else ''}</div><div id=tail><p>Printed by us</p></div>")) for i in range(40, 80)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text.split("\n") for r in html_extract.extract_pages(df).collect()}
    for i in range(40):
        assert got[i] == [f"t{i}", prose(i, 9), prose(i + 100, 9), "Read our house rules first"]  # in the article, hence kept
    for i in range(40, 80):
        assert got[i] == [prose(i, 9), prose(i + 100, 9), *(["Now and then"] if i % 20 else [])]


def test_names_have_no_power_over_what_holds_an_article_or_says_more():
    cases = {
        '<body class="right-sidebar"><article><p>Hello': ["Hello"],
        '<main id="comments"><p class="share-price">12</p><div id="search-theory">Finding</div></main>': ["12", "Finding"],
        "<article><p title=it's>one</p><p data-x='a>b'>two</p><p>x <math><mi>y</mi><mo>+</mo></math> z</p></article>": ["one", "two", "x y+ z"],
        '<article><p>in</p><div class="share-box">s</div><ul class="socialLinks"><li>t</li></ul><section id="reader-comments">kept</section><section class="comment-list">c</section></article>': ["in", "kept"],
        '<article><header class="entry-header"><h1>Title</h1></header><p>a</p></article><div class="page-header">site</div>': ["Title", "a"],
    }
    for page, want in cases.items():
        assert html_extract.blocks(html_extract.parse(page))[2] == want


def test_the_wrapper_decides_what_is_kept(spark):
    """Without the wrapper's main element the same pages keep what is no article; what it holds stays, common or not."""
    rows = [(i, "http://w.example/", page(f"<div id=text><p>{prose(i, 9)}</p><p>{prose(i + 99, 9)}</p><p>Printed by us</p></div><div id=x><p>Weather</p><p>{i % 2}</p></div>")) for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract_pages(df).collect()}
    assert got == {i: prose(i, 9) + "\n" + prose(i + 99, 9) + "\nPrinted by us" for i in range(12)}
    assert all("\n".join(html_extract.blocks(html_extract.parse(h))[2]) != got[i] for i, _, h in rows)


def test_headings_that_all_articles_share_stay(spark):
    """However many pages of a kind there are, and whatever a further one says."""
    for n, last in ((2, None), (4, None), (4, "Background")):
        heads = ["Introduction"] * n + ([last] if last else [])
        rows = [(i, "http://s.example/", page(f"<article><h1>t{i}</h1><h2>{h}</h2><p>{prose(i, 9)}</p><h2>Conclusion</h2><p>{prose(i + 50, 9)}</p></article>")) for i, h in enumerate(heads)]
        got = {r.page_id: r.text.split("\n") for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert got == {i: [f"t{i}", h, prose(i, 9), "Conclusion", prose(i + 50, 9)] for i, h in enumerate(heads)}


def test_common_texts_go_where_no_element_is_the_main_one(spark):
    """Three columns of like size: none is the main element, and the line that all pages have at one path goes."""
    rows = [(i, "http://n.example/", page("".join(f"<div id={c}><p>{prose(9 * i + k, 9)}</p><p>{prose(9 * i + k + 500, 9)}</p></div>" for k, c in enumerate("xyz")) + "<p>Printed by us</p>")) for i in range(6)]
    got = [r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert all("Printed by us" not in t and len(t.split("\n")) == 6 for t in got)


def test_adverts_in_a_line_and_lists_of_comments_go():
    cases = {
        '<article><p>before <span class="advertisement">Buy <span>now</span></span> after</p></article>': ["before after"],
        '<article><p>a <span class="ad-label">x</span>b <b class="added">c</b> <a class="comment">d</a> <i class="ads">e</p><p>f</p></article>': ["a b c d e", "f"],
        '<article><p>in</p><ol class="commentlist"><li>first!</li></ol><div id="sidebarwidget">w</div><div class="commentary">kept</div><p class="shadow">too</p></article>': ["in", "kept", "too"],
    }
    for text, want in cases.items():
        assert html_extract.blocks(html_extract.parse(text))[2] == want


def test_deep_and_long_pages(spark):
    deep = "<div>" * 100_000 + "<p>one</p><nav><div>no</div></nav>two" + "</div>" * 50_000 + "<p>three</p>"
    mixed = "<article>" + "".join(f"<h2>h{i}</h2><p>p{i}</p>" for i in range(10_000)) + "</article>"
    rows = [(1, "http://d.example/", deep), (2, "http://d.example/", mixed), (3, "http://d.example/", mixed.replace("<h2>h5</h2>", "")), (4, "http://d.example/", "<p>" + "word " * 400_000)]
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].split("\n") == ["one", "two", "three"]
    assert got[2].split("\n") == [x for i in range(10_000) for x in (f"h{i}", f"p{i}")]
    assert got[3].split("\n") == [x for i in range(10_000) for x in (f"h{i}", f"p{i}") if x != "h5"]
    assert len(got[4]) == 5 * 400_000 - 1


def test_copies_of_one_page_fix_nothing(spark):
    df = spark.createDataFrame([(i, "http://h.example/", page("<article><p>alone</p></article>")) for i in range(5)], "page_id long, url string, html string")
    assert {r.text for r in html_extract.extract_pages(df).collect()} == {"alone"}


def test_html_on_the_given_pages(spark, sf_dir):
    got = {r.page_id: r.text for r in queries.op4_html_extraction(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", inner)]
        assert got[r.page_id] == "\n".join(p for p in parts if p)


# 5: top-k


@pytest.mark.parametrize(("dim", "scale"), [(8, 1.0), (3, 0.01), (5, 1e6)])
def test_top_k_equals_brute_force(spark, dim, scale):
    r = np.random.default_rng(dim)
    rows = [(i, (r.normal(size=dim) * scale).tolist(), 0) for i in range(230)]
    rows += [(50, rows[50][1], 0), (231, rows[3][1], 0), (232, None, 0), (233, [1.0, None] + [0.0] * (dim - 2), 0), (100, [float("nan")] * dim, 0), (234, [float("inf")] * dim, 0), (None, rows[0][1], 0), (300, [], 0), (301, [1.0], 0)]
    got = topk.exact_top_k(spark.createDataFrame([(*x, "q") for x in rows], "vec_id long, embedding array<float>, label int, uid string"), row_block=60, pivots=6)
    clean = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for a, (i, v) in enumerate(clean):
        if i % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), j) for b, (j, w) in enumerate(clean) if b != a)[:5]
            want += [(i, n, j, -s) for n, (s, j) in enumerate(scored, 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize(("least", "most"), [(4, 8), (4, 10**6), (10**6, 10**6)])
def test_top_k_does_not_depend_on_the_blocks(spark, monkeypatch, least, most):
    """However many rows a block has, by the number of rows or at its bounds."""
    for name, value in (("BLOCKS", 9), ("LEAST_ROWS", least), ("MOST_ROWS", most)):
        monkeypatch.setattr(topk, name, value)
    r = np.random.default_rng(8)
    v = r.normal(size=(300, 6)).astype(np.float32)
    whole = np.floor(v.astype(np.float64) * 256).astype(np.int64)
    got = topk.exact_top_k(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>"))
    want = []
    for i in range(0, 300, 50):
        scored = sorted((-int(s), j) for j, s in enumerate(whole @ whole[i]) if j != i)[:5]
        want += [(i, n, j, -s) for n, (s, j) in enumerate(scored, 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_top_k_of_few(spark):
    df = spark.createDataFrame([(0, [1.0], 0), (1, [2.0], 0)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in topk.exact_top_k(df).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.exact_top_k(df.limit(0)).count() == 0


# 6: SimHash


def plain_fingerprint(t):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(spark):
    base = prose(9, 300).split()
    rows = edge_rows()
    for i in range(40):
        copy = list(base)
        copy[i * 7] = "changed"
        rows.append((100 + i, " ".join(copy)))
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    want = sorted(((i, f"{fps[a]:016x}", least.get(find(a))) for a, (i, _) in enumerate(rows)), key=repr)
    assert as_rows(simhash.near_duplicates(documents(spark, rows))) == want
    kept = near_dedup.keep_one(documents(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 2, 5, 6, 7, 100]
    assert sum(r.doc_id is None for r in kept) == 1  # the null text of a null id is alike to row 2
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def shingle_similarity(a, b):
    return (a & b).total() / max(1, (a | b).total())


def test_similar_texts_meet_and_others_do_not(spark):
    r = random.Random(12)
    rows, parts = [], []
    for g in range(100):
        w = prose(3000 + g, r.randint(60, 300)).split()
        copy = list(w)
        for _ in range(max(1, round(len(w) * r.choice((0.005, 0.01, 0.02, 0.05, 0.2))))):
            copy[r.randrange(len(copy))] = "changed"
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(copy))]
    for _, t in rows:
        w = t.split()
        parts.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)))
    component = {x.doc_id: x.component_id for x in near_dedup.similar_groups(documents(spark, rows)).collect()}
    close = [g for g in range(100) if shingle_similarity(parts[2 * g], parts[2 * g + 1]) >= 0.8]
    far = [g for g in range(100) if shingle_similarity(parts[2 * g], parts[2 * g + 1]) < 0.6]
    assert len(close) > 15 < len(far)
    assert sum(component[2 * g] == component[2 * g + 1] for g in close) >= 0.95 * len(close)
    assert all(component[2 * g] != component[2 * g + 1] for g in far)
    assert all(c in (i, i - 1) for i, c in component.items())


def test_only_pairs_at_the_threshold_are_linked_and_all_of_them(spark):
    r = random.Random(5)
    rows = [(1, "one line that repeats itself here\n" * 200 + prose(1, 20)), (2, "one line that repeats itself here\n" * 1000 + prose(1, 20))]
    for g in range(10, 130):  # copies around the threshold
        w = prose(7000 + g, 200).split()
        copy = list(w)
        for at in r.sample(range(len(w)), r.randint(2, 9)):
            copy[at] = "changed"
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(copy))]
    # a group around a hub, whose members reach it only through each other
    hub = prose(9000, 200).split()
    rows += [(1000 + i, " ".join([*hub[10 * i :], *prose(9100, 100).split()[: 10 * i]])) for i in range(6)]
    parts = {i: Counter(tuple(t.split()[p : p + 5]) for p in range(len(t.split()) - 4)) for i, t in rows}
    found = {x.doc_id: x.component_id for x in near_dedup.similar_groups(documents(spark, rows)).collect()}
    linked = {i: i for i, _ in rows}
    for _ in range(8):
        for a in parts:
            for b in parts:
                if linked[a] != linked[b] and (a // 2 == b // 2 or min(a, b) >= 1000) and shingle_similarity(parts[a], parts[b]) >= 0.8:
                    linked[a] = linked[b] = min(linked[a], linked[b])
    alike = [shingle_similarity(parts[2 * g], parts[2 * g + 1]) for g in range(10, 130)]
    assert sum(0.8 <= x < 0.9 for x in alike) > 10 < sum(0.65 < x < 0.8 for x in alike)
    assert found == linked


def test_groups_larger_than_a_chunk_lose_no_link(spark, monkeypatch):
    """A large group of copies, pairs around the threshold and unlike texts that only a chain joins, in chunks of 16."""
    monkeypatch.setattr(near_dedup, "CHUNK", 16)
    r = random.Random(3)
    rows = []
    for g, (n, most) in enumerate([(120, 4), (40, 9), (9, 6)]):
        w = prose(100 + g, 160).split()
        for i in range(n):
            copy = list(w)
            for at in r.sample(range(len(w)), r.randint(0, most)):
                copy[at] = f"new{i}"
            rows.append((1000 * g + i, " ".join(copy)))
    rows += [(5000 + i, prose(5000 + i, 60)) for i in range(20)]
    parts = {i: Counter(tuple(t.split()[p : p + 5]) for p in range(len(t.split()) - 4)) for i, t in rows}
    linked = {i: i for i in parts}
    pairs = [(a, b) for a in parts for b in parts if a < b and a // 1000 == b // 1000 and shingle_similarity(parts[a], parts[b]) >= 0.8]
    for _ in range(30):
        for a, b in pairs:
            linked[a] = linked[b] = min(linked[a], linked[b])
    got = {x.doc_id: x.component_id for x in near_dedup.similar_groups(documents(spark, rows)).collect()}
    assert got == linked
    assert len(pairs) < 0.9 * (120 * 119 + 40 * 39 + 9 * 8) / 2
    assert len({c for c in linked.values() if c < 5000}) > 5


def test_one_row_of_each_group_stays(spark):
    a, b = prose(1, 50), prose(2, 50)
    rows = [(1, a), (1, a), (1, b), (None, a), (None, prose(3, 50)), (None, prose(3, 50)), (2, b), (None, "")]
    kept = near_dedup.keep_one(documents(spark, rows))
    assert sorted(((x.doc_id, x.text) for x in kept.collect()), key=repr) == sorted([(1, a), (1, b), (None, prose(3, 50)), (None, "")], key=repr)
    assert kept.columns == documents(spark, []).columns
    assert near_dedup.keep_one(documents(spark, [])).count() == 0


def test_wide_fingerprints_are_majorities():
    t = "Some Words in a ROW that make several shingles é"
    w = rolling.Words([t], near_dedup.ascii_lower)
    h = w.windows(5)[0]
    many = rolling.mix(h[:, None] + near_dedup._SALTS[None, :])
    want = 0
    for b in range(256):
        if 2 * sum(int(x) >> (b % 64) & 1 for x in many[:, b // 64]) > len(h):
            want |= 1 << b
    assert near_dedup.wide_fingerprints([t, "", t.lower()]) == [want.to_bytes(32, "little"), bytes(32), want.to_bytes(32, "little")]


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_bit_slices_find_all_pairs(radius):
    r = np.random.default_rng(radius)
    fps = r.integers(0, 2**63, 150).astype(np.uint64)
    fps = np.concatenate((fps, fps[:80] ^ (np.uint64(1) << r.integers(0, 64, 80).astype(np.uint64)) ^ (np.uint64(3) << r.integers(0, 62, 80).astype(np.uint64))))
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= radius}
    assert set(zip(*simhash.bit_sliced_pairs(fps[:, None], radius), strict=True)) == want
    wide = np.concatenate((fps[:, None], np.roll(fps, 0)[:, None]), axis=1)
    assert set(zip(*simhash.bit_sliced_pairs(wide, 2 * radius, (70, 64)), strict=True)) == want


@pytest.mark.parametrize("blocks", [5, 6, 8])
def test_large_sets_are_split_and_lose_no_link(spark, blocks, monkeypatch):
    monkeypatch.setattr(simhash, "MEET", 64)
    r = random.Random(blocks)
    fps = {r.getrandbits(64) & ~0xFFFF | r.getrandbits(16) for _ in range(50)} | {r.getrandbits(9) for _ in range(400)}
    df = store(spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long"), "test-fps")
    got = {v.node: v.root for v in connected_components(simhash.near_links(df)).collect()}
    small = sorted(f for f in fps if f < 512)
    assert len({got.get(f, f) for f in small}) == 1


# 7: personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_base(t):
    out = []
    for k, p in PATTERNS.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0, "phone": 9 <= len(d) <= 15}[k]:
                out.append((k, m.start(), m.end()))
    return out


def test_base_spans_equal_the_patterns():
    r = random.Random(4)
    pieces = ["a@b.co", "@", "x.y%z@h-1.d.e@q.r", "1.2.3.4", "256.1.1.1", "01.002.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+12", "é", " ", "+", "-", ".", "0", "99", "漢", "\n", "a@b", "4111111111111111 1.1.1.1"]
    for _ in range(3000):
        t = "".join(r.choice(pieces) for _ in range(r.randint(0, 8)))
        assert [(pii.KINDS[k], s, e) for k, s, e in pii.base_spans(t)] == plain_base(t), t


def test_pii(spark):
    hidden = "Call phone (415) 555-2671 now. write to jane.doe [at] example [dot] com please. "
    rows = [(10 + i, prose(i, 20) + " mail me at joe@mail.example.com or +1 (212) 555-0123 " + prose(i + 50, 20)) for i in range(30)] + [(90, hidden), (91, "order 1234 5678 9012 3456"), *edge_rows()]
    got = {(r.doc_id, i): r for i, r in enumerate(pii.find_pii(documents(spark, rows)).collect())}
    for (i, t), r in zip(rows, got.values(), strict=True):
        base = plain_base(t or "")
        assert (r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone) == (i, *[sum(k == x for k, _, _ in base) for x in PATTERNS])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(r.spans.split(","))
    assert got[90, 30].spans == f"email:{hidden.index('jane')}:{hidden.index(' please')},phone:{hidden.index('(415')}:{hidden.index(' now')}"
    assert got[91, 31].spans == ""
    masked = {r.doc_id: r.text for r in pii.mask_pii(documents(spark, rows)).collect()}
    assert masked[90] == "Call phone [PHONE] now. write to [EMAIL] please. "
    assert masked[2] is None
    assert pii.find_pii(documents(spark, [])).count() == 0


def test_loose_candidates_do_not_depend_on_case_or_other_text(spark):
    for t in ("john.doe [at] example [dot] com", "john.doe(at)example.com", "john.doe {at} example {dot} com", "host fe:ab:cd:ef:aa:bb:cc:dd"):
        want = pii.loose_spans(t, [])
        assert want and want == pii.loose_spans(t.upper(), []) == pii.loose_spans(t + " @ 1", [])
    t = "mail john.doe [at] example [dot] com"
    got = {r.doc_id: r.spans for r in pii.find_pii(documents(spark, [*((i, t) for i in range(20)), *((i, t.upper()) for i in range(20, 40))])).collect()}
    assert set(got.values()) == {got[0]} and got[0]


def test_added_spans_are_found_and_others_left(spark):
    """Planted variants that the base patterns miss, and numbers that are none."""
    r = random.Random(9)
    rows, planted = [], {}
    for i in range(300):
        kind = i % 4
        if kind == 0:
            span = f"{r.choice('abcdef')}{prose(i, 1)}.{prose(i + 1, 1)} {r.choice(('[at]', '(at)', '{at}'))} {prose(i + 2, 1)} {r.choice(('[dot]', '(dot)'))} {r.choice(('com', 'org', 'de', 'fr'))}"
            text = f"{prose(i, 12)} contact me by email: {span} {prose(i + 500, 12)}"
        elif kind == 1:
            span = f"({r.randint(200, 989)}) {r.randint(200, 989)}-{r.randint(1000, 9999)}"
            text = f"{prose(i, 12)} call my phone {span} {prose(i + 500, 12)}"
        elif kind == 2:
            span = ":".join(f"{r.randint(4096, 65535):x}" for _ in range(8))
            text = f"{prose(i, 12)} from host {span} {prose(i + 500, 12)}"
        else:
            span, text = "", f"{prose(i, 12)} order {r.randint(1000, 9999)} {r.randint(1000, 9999)} {r.randint(1000, 9999)} 1 {prose(i + 500, 12)}"
        rows.append((i, text))
        planted[i] = text.index(span), text.index(span) + len(span), bool(span)
    got = {x.doc_id: x.spans for x in pii.find_pii(documents(spark, rows)).collect()}
    hit = [any(int(s.split(":")[1]) <= planted[i][0] + 1 and int(s.split(":")[2]) >= planted[i][1] for s in got[i].split(",") if s) for i in planted if planted[i][2]]
    assert sum(hit) >= 0.95 * len(hit)
    # numbers that pass the base pattern's own test stay base spans, nothing is added to them
    assert all(got[i] == pii.joined(sorted(pii.base_spans(t))) for i, t in rows if not planted[i][2])


def variants(r: random.Random) -> list[tuple[str, str]]:
    """Personal data as people write it, which no base pattern finds."""
    name, host, end = (f"{r.choice('abcdefg')}{prose(r.randint(0, 10**6), 1).lower()}" for _ in range(2)), prose(r.randint(0, 10**6), 1).lower(), r.choice(("com", "org", "de", "fr", "net"))
    a, b = name
    part = [str(r.randint(0, 255)) for _ in range(4)]
    two = [f"{r.randint(10, 99)}" for _ in range(8)]
    return [
        ("email", f"{a}.{b} [at] {host} [dot] {end}"),
        ("email", f"{a} dot {b} at {host} dot {end}"),
        ("email", f"{a}{two[0]} at {host} dot {end}"),
        ("email", f"{a}_{b} (at) {host}.{end}"),
        ("ip", "[.]".join(part)),
        ("ip", " dot ".join(part)),
        ("ip", ":".join(f"{r.randint(4096, 65535):x}" for _ in range(8))),
        ("phone", f"({r.randint(200, 989)}) {r.randint(200, 989)}-{r.randint(1000, 9999)}"),
        ("phone", f"0{r.randint(1, 9)} {' '.join(two[:4])}"),
        ("phone", f"00{r.choice((33, 49, 34))} {two[0]} {two[1]}{two[2]} {two[3]}{two[4]}"),
        ("phone", f"({'0' + two[0]}) {r.randint(1234567, 9876543)}"),
    ]


def decoys(r: random.Random) -> list[str]:
    n = [r.randint(1000, 9999) for _ in range(4)]
    return [f"order {n[0]} {n[1]} {n[2]} {n[3]}1", f"look at {prose(n[0], 1).lower()} dot com", f"version {n[0] % 9}.{n[1] % 9}.{n[2] % 20}", f"{n[0]} {n[1]} {n[2]} {n[3]}", f"isbn 978-3-16-{n[0]}{n[1] % 90 + 10}-0", f"from {n[0] % 100} to {n[1]} at noon dot", f"16:{n[0] % 50 + 10}:22", "0000 0000 0000 0001", f"sell at {prose(n[1], 1).lower()} dot com", f"{n[0] % 90 + 10} {n[1] % 90 + 10} {n[2] % 90 + 10} {n[3] % 90 + 10}"]


def test_recall_of_written_out_data(spark):
    """Of variants among prose, a third with a word of their kind before them, most are found; of decoys almost none are taken."""
    r = random.Random(21)
    hint = {"email": "contact", "ip": "server", "phone": "call"}
    rows, planted, clean = [], {}, set()
    for i in range(1500):
        found = r.choice(variants(r)) if i % 2 else ("", r.choice(decoys(r)))
        text = f"{prose(i, 12)} {hint[found[0]] + ' ' if found[0] and i % 3 == 0 else ''}{found[1]} {prose(i + 5000, 12)}"
        rows.append((i, text))
        at = text.index(found[1])
        if found[0]:
            planted[i] = found[0], at, at + len(found[1])
        else:
            clean.add(i)
    got = {x.doc_id: [s.split(":") for s in x.spans.split(",") if s] for x in pii.find_pii(documents(spark, rows)).collect()}
    hit = Counter(k for i, (k, s, e) in planted.items() if any(x == k and int(a) <= s and int(b) >= e for x, a, b in got[i]))
    every = Counter(k for k, _, _ in planted.values())
    recall = {k: hit[k] / every[k] for k in every}
    wrong = sum(len(got[i]) > len(pii.base_spans(rows[i][1])) for i in clean)
    print(recall, wrong, len(clean), {i: rows[i][1][s:e] for i, (k, s, e) in planted.items() if not any(x == k and int(a) <= s and int(b) >= e for x, a, b in got[i])})
    assert min(recall.values()) >= 0.9 and wrong <= 0.01 * len(clean)


def test_spans_of_long_texts_take_linear_time():
    text = "mail a.b@c.org or +1 (212) 555-0123 or xx [at] yy [dot] de, " * 20_000
    base = pii.base_spans(text)
    assert len(base) == 40_000
    assert len(pii.loose_spans(text, base)) == 20_000
    starts, ends = pii.merged([(5, 7), (0, 2), (1, 4), (7, 9)])
    assert (starts, ends) == ([0, 5], [4, 9])


def test_masking_joins_overlaps():
    assert pii.masked("abcdefgh", [(0, 1, 4), (3, 3, 6)]) == "a[EMAIL]gh"


# 8: decontamination


def brute_leaks(rows, items, threshold=0.8):
    out = []
    for i, t in set(rows):
        w = words((t or "").lower())
        d = [tuple(w[p : p + 5]) for p in range(max(len(w) - 4, min(len(w), 1)))]
        for j, u in items:
            v = words((u or "").lower())
            s = Counter(tuple(v[p : p + 5]) for p in range(max(len(v) - 4, min(len(v), 1))))
            n, best, most = s.total(), None, 0
            if not n or not d:
                continue
            last = max(0, len(d) - n)
            for p in range(last + 1):
                m = Counter(d[p : p + n])
                both = (m & s).total()
                x = both / (m.total() + n - both)
                most = max(most, x)
                if x >= threshold and (best is None or x > best[0]) and (d[p] in s or p == last):
                    best = (x, p, min(m.total() + 4, len(w)))
            # the windows that the operator looks at hold a best one of all windows
            assert (best[0] if best else 0) == (most if most >= threshold else 0)
            if best:
                out.append((i, j, best[1], best[2], round(best[0], 6)))
    return sorted(out, key=repr)


def test_leaks_equal_brute_force(spark):
    r = random.Random(8)
    items = [(i, prose(500 + i, r.randint(5, 50))) for i in range(25)] + [(30, None), (31, ""), (32, "too few words"), (33, "again and again " * 12), (3, prose(999, 20))]
    rows = edge_rows()
    for i in range(100):
        w = items[r.randrange(25)][1].split()
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(w))
            w[k : k + r.randint(0, 1)] = ["new"] * r.randint(0, 2)
        rows.append((100 + i, " ".join([prose(i, r.randint(0, 40)), " ".join(w).upper() if i % 2 else " ".join(w), prose(i + 70, r.randint(0, 40))])))
    rows += [(310, "too FEW words"), (311, "too few"), (312, "too few words here"), (313, "too few words of many more words that follow here")]
    boiler = prose(4242, 30)  # a passage of many documents and of many items
    items += [(40 + i, boiler + " " + prose(600 + i, 12)) for i in range(15)]
    rows += [(400 + i, prose(700 + i, 20) + " " + boiler + " " + prose(800 + i, 20)) for i in range(40)] + [(450, items[-3][1]), (None, items[-2][1]), (None, prose(1, 40))]
    rows += [(300, "again and again " * 40), (301, items[4][1]), (302, " ".join(items[5][1].split()[:-1]))]
    bench = spark.createDataFrame([(*x, "t") for x in items], "item_id long, text string, tag string")
    got = as_rows(decontaminate.contaminated(documents(spark, rows), bench).drop("hamming"))
    want = brute_leaks(rows, items)
    assert len(want) > 30
    assert got == want
    bad = {i for i, *_ in want}
    kept = decontaminate.decontaminate(documents(spark, rows), bench)
    leaked = {(i, t) for i, t in rows if i is None and t == items[-2][1]}
    assert sorted((x.doc_id for x in kept.collect()), key=repr) == sorted((i for i, t in rows if (i not in bad if i is not None else (i, t) not in leaked)), key=repr)
    assert kept.columns == documents(spark, []).columns
    assert decontaminate.contaminated(documents(spark, []), bench).count() == 0
    assert decontaminate.contaminated(documents(spark, rows), bench.limit(0)).count() == 0


def test_long_items_are_found(spark):
    long = prose(77, 33_000)
    bench = spark.createDataFrame([(1, long), (2, prose(78, 30))], "item_id long, text string")
    rows = [(1, "before it " + long + " after it"), (2, prose(78, 30)), (3, prose(79, 33_000))]
    got = {(r.doc_id, r.item_id): (r.start, r.similarity) for r in decontaminate.contaminated(documents(spark, rows), bench).collect()}
    assert got == {(1, 1): (2, 1.0), (2, 2): (0, 1.0)}


def test_native_fingerprints_are_majorities(spark):
    r = random.Random(2)
    rows = [(g, r.getrandbits(64) - 2**63, r.randint(1, 3)) for g in range(5) for _ in range(40)]
    got = {x.g: x.fp for x in decontaminate.simhash(spark.createDataFrame(rows, "g int, h long, weight long"), ["g"], "h", "weight").collect()}
    for g in range(5):
        mine = [(h % 2**64, w) for x, h, w in rows if x == g]
        want = sum(1 << b for b in range(64) if 2 * sum(w for h, w in mine if h >> b & 1) > sum(w for _, w in mine))
        assert got[g] % 2**64 == want


# 9: packing


def test_boundaries_are_optimal():
    from itertools import combinations

    r = random.Random(6)
    for _ in range(60):
        histogram = {r.randint(1, 40): r.randint(1, 9) for _ in range(r.randint(1, 8))}
        k = r.randint(1, 4)

        def cost(bounds, h=histogram):
            return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in h.items())

        top = max(histogram)
        best = min(cost((*c, top)) for m in range(min(k, len(histogram))) for c in combinations(sorted(histogram), m))
        bounds = packing.best_boundaries(histogram, k)
        assert len(bounds) <= k
        assert cost(bounds) == best
    assert packing.best_boundaries({0: 5}, 3) == []


def test_packing_covers_every_word_once(spark):
    rows = [*edge_rows(), *[(100 + i, prose(i, i)) for i in range(150)]]
    got = packing.pack(documents(spark, rows), max_tokens=100, buckets=4, budget=250).collect()
    spans = Counter()
    for r in got:
        spans[r.doc_id] += r.n_tokens
        assert r.n_tokens == 0 or r.padding == r.bucket_len - r.n_tokens >= 0
    total = Counter()
    for i, t in rows:
        total[i] += len(words(t))
    assert {k: v for k, v in spans.items()} == {k: v for k, v in total.items()}
    batches = {}
    for r in got:
        if r.batch is not None:
            batches.setdefault(r.batch, []).append(r)
    assert sorted(batches) == list(range(len(batches)))
    for b in batches.values():
        assert len({r.bucket_len for r in b}) == 1
        assert sorted(r.slot for r in b) == list(range(len(b)))
        assert len(b) * b[0].bucket_len <= max(250, b[0].bucket_len)
    assert len({r.bucket_len for r in got if r.bucket_len}) <= 4
    assert packing.pack(documents(spark, [])).count() == 0


def test_piece_texts_rebuild_documents(spark):
    docs = documents(spark, [(1, prose(1, 250)), (2, prose(2, 30))])
    rows = packing.piece_texts(docs, packing.pack(docs, max_tokens=100)).orderBy("doc_id", "piece").collect()
    assert " ".join(r.piece_text for r in rows if r.doc_id == 1) == prose(1, 250)


# 10: sharding


def test_shards(spark):
    rows = [*edge_rows(), *[(100 + i, prose(i % 170, i % 60)) for i in range(600)]]
    got = sharding.byte_shards(documents(spark, rows)).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert (r.law, r.grown_shard) == ("bytes", None)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(8))
    assert sharding.byte_shards(documents(spark, [])).count() == 0


def test_shards_are_near_equal_and_keep_small_groups_whole(spark):
    rows = [(i, prose(i // 2, 40)) for i in range(4000)]
    got = sharding.byte_shards(documents(spark, rows)).collect()
    sizes = Counter()
    where = {}
    for r in got:
        sizes[r.shard] += r.size
        where.setdefault(r.text_crc32, set()).add(r.shard)
    assert len(sizes) == 8
    assert max(sizes.values()) < 1.03 * min(sizes.values())
    assert all(len(s) == 1 for s in where.values())


def test_positions_part_rows_that_are_all_alike(spark):
    df = spark.createDataFrame([("a", 3)] * 400, "k string, n int")
    got = with_positions(df, ["k"], "n").withColumn("part", F.spark_partition_id()).collect()
    assert sorted(r.row_pos for r in got) == list(range(400))
    assert sorted(r.offset for r in got) == list(range(0, 1200, 3))
    spread = store(df, "test-alike")
    dealt = with_positions(spread, ["k"], name="test-dealt")
    assert dealt.columns == ["k", "n", "row_pos"]


def test_one_text_alone_still_gives_equal_shards(spark):
    sizes = Counter(r.shard for r in sharding.byte_shards(documents(spark, [(i, "same") for i in range(800)])).collect())
    assert set(sizes.values()) == {100}


# All of them


def test_every_operator_has_its_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = [tuple(r[k] for k in sorted(r)) for r in (x.asDict() for x in queries.QUERIES[name](spark, sf_dir).collect())]
    names = sorted(c.sql(queries.ORACLE_SQL[name]).columns)
    want = c.sql(f"SELECT {', '.join(names)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert Counter(got) == Counter(want)


def test_large_ints_survive_null_ids(spark):
    big = 2**60 + 1
    docs = documents(spark, [(big, "a"), (None, "b")]).coalesce(1)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([(big, "http://a/", "<p>x</p>"), (None, None, None)], "page_id long, url string, html string").coalesce(1)
    for got in (substring_dedup.remove_repeats(docs), pii.find_pii(docs), simhash.near_duplicates(docs), near_dedup.similar_groups(docs), quality.classify(docs, none), packing.pack(docs), license_scan.scan_licenses(documents(spark, [(big, "Released under the MIT License"), (None, "Released under the MIT License")]).coalesce(1))):
        assert {r.doc_id for r in got.select(F.col("doc_id")).collect()} == {big, None}
    assert {r.page_id for r in html_extract.extract_pages(pages).collect()} == {big, None}

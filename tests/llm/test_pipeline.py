"""The corpus pipeline, stage by stage, against what each stage promises."""

import re
from collections import Counter

import corpus_pipeline
from quarryflow.llm import decontaminate, near_dedup, pii, quality
from quarryflow.llm.common import store, table

from .helpers import prose

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    labels, bench = table(spark, SF, "labels"), table(spark, SF, "benchmark")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, store(stage(spark, docs, SF), f"test-{name}")
        after[name] = docs
        if name != "packing":
            assert docs.schema.names == before.schema.names
            assert {r.doc_id for r in docs.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in after.items()}

    scored = quality.classify(table(spark, SF, "documents"), labels).collect()
    assert ids["quality"] == {r.doc_id for r in scored if r.predicted == 1}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    clean = [i for i, q in truth.items() if q == 1]
    assert sum(i in ids["quality"] for i in clean) > 0.97 * len(clean)

    found = {r.doc_id: r.component_id for r in near_dedup.similar_groups(after["quality"]).collect()}
    assert ids["near_dedup"] == set(found.values())
    shingles = {}
    for r in after["quality"].collect():
        w = re.sub("[A-Z]", lambda m: m[0].lower(), r.text).split()
        shingles[r.doc_id] = Counter(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    by_shingle = {}
    for i, s in shingles.items():
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    pairs = {(a, b) for group in by_shingle.values() for a in group for b in group if a < b}
    similar = {p: (shingles[p[0]] & shingles[p[1]]).total() / (shingles[p[0]] | shingles[p[1]]).total() for p in pairs}
    close = [p for p, x in similar.items() if x >= 0.8]
    assert len(close) > 50
    root = {i: i for i in shingles}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in close:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert found == {i: find(i) for i in root}

    leaked = {r.doc_id for r in decontaminate.contaminated(after["near_dedup"], bench).collect()}
    assert leaked
    assert ids["decontamination"] == ids["near_dedup"] - leaked

    assert ids["pii"] == ids["decontamination"]
    texts = {r.doc_id: r for r in after["pii"].collect()}
    assert not any(pii.base_spans(r.text) for r in texts.values())
    assert all(r.n_chars == len(r.text) for r in texts.values())

    tokens = Counter()
    for r in after["packing"].collect():
        tokens[r.doc_id] += r.n_tokens
    assert tokens == Counter({i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for i, r in texts.items()})


def test_run_is_the_stages_in_turn(spark):
    first = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert first == sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "pii", "packing"]


def test_stages_stand_edge_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, one id for unlike texts, clashing columns, empty tables: each stage by itself."""
    sf = str(tmp_path)
    teach = [(1000 + i, prose(i, 60) if i % 2 else " ".join([prose(i, 1)] * 60)) for i in range(300)]
    item, long = prose(777, 40), prose(1, 30_000)
    rows = [(1, prose(2, 80)), (1, prose(2, 80)), (1, prose(3, 80)), (2, None), (3, ""), (None, prose(4, 80)), (None, prose(4, 80)), (5, long), (6, prose(2, 80)), (7, f"{prose(8, 9)} {item} {prose(9, 9)}"), (8, "mail joe@mail.example.com " + prose(10, 30))]
    names = "doc_id long, text string, lang string, source string, n_chars long, row string, score double, key string"
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "r", 0.5, "k") for i, t in rows], names)
    spark.createDataFrame([(i, i % 2, 0) for i, _ in teach] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    taught = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", len(t), "r", 0.5, "k") for i, t in teach], names))
    stages = dict(corpus_pipeline.STAGES)
    left = store(stages["quality"](spark, taught, sf), "edge-quality")
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} >= {1, 5, 7}
    assert not {r.doc_id for r in left.collect()} & {i for i, _ in teach if i % 2 == 0}
    assert stages["quality"](spark, docs, sf).count() == 0  # no labelled row of it: nothing tells good from bad

    def kept(name, df=docs):
        out = stages[name](spark, df, sf)
        assert out.columns == docs.columns
        assert stages[name](spark, docs.limit(0), sf).count() == 0
        return sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)

    want = [(1, prose(2, 80)), (1, prose(3, 80)), (2, None), (None, prose(4, 80)), (5, long), rows[9], rows[10]]
    assert kept("near_dedup") == sorted(want, key=repr)
    assert kept("decontamination") == sorted((r for r in rows if r[0] != 7), key=repr)
    assert kept("pii") == sorted((r if r[0] != 8 else (8, "mail [EMAIL] " + prose(10, 30)) for r in rows), key=repr)
    packed = stages["packing"](spark, docs, sf).collect()
    assert sum(r.n_tokens for r in packed) == sum(len((t or "").split()) for _, t in rows)
    assert stages["packing"](spark, docs.limit(0), sf).count() == 0

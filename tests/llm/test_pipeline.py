"""The pipeline's stages, each against what it must keep."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tandem.llm import quality

from .conftest import CLASH, make
from .test_mixing_and_benchmark import brute, water
from .test_near import WORD, Sets, grams, similar

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_run_over_the_test_tables(spark, sf):
    import os

    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = set(os.listdir(shared))
    out = cp.run(spark, sf)
    left = {x.split("-")[0] for x in set(os.listdir(shared)) - before}
    assert left == {"mixing"}  # only the result stays
    assert out.columns[0] == "doc_id" and 0 < out.count() <= 200
    assert out.where("taken <= 0 or taken > 2 * size").count() == 0


def test_run_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text or "", r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    model = quality.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    docs = sorted((d for d, p in zip(docs, model.scores([t for _, t, _ in docs])) if p >= 0.7), key=lambda d: d[0])
    # lines: the first of each component of 5-character sets with 0.8 or more in common stays
    lines = list(dict.fromkeys(x for _, t, _ in docs for x in t.split("\n") if re.search(WORD, x)))
    sets = [frozenset(x[j : j + 5] for j in range(max(1, len(x) - 4))) for x in lines]
    group = grouped(sets)
    seen, left = set(), []
    for i, t, s in docs:
        keep = []
        for x in t.split("\n"):
            g = group[lines.index(x)] if re.search(WORD, x) else None
            if g is None or g not in seen:
                keep.append(x)
            seen.add(g) if g is not None else None
        new = "\n".join(keep)
        if new == t or re.search(WORD, new):
            left.append((i, new, s))
    # near duplicates: the least id of each component of word 5-grams
    sets = [grams(re.findall(WORD, t)) for _, t, _ in left]
    group, first = grouped(sets), {}
    for k, (i, _, _) in enumerate(left):
        first.setdefault(group[k], i)
    left = [d for k, d in enumerate(left) if not sets[k] or first[group[k]] == d[0]]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {r[0] for r in brute([d[:2] for d in left], items) if r[2] == 0}
    left = [d for d in left if d[0] in clean]
    size = {i: len(re.findall(WORD, t)) for i, t, _ in left}
    sources = {s: sum(size[i] for i, _, x in left if x == s) for s in {d[2] for d in left}}
    order = sorted((s for s in sources if s is not None), key=lambda s: s.encode()) + [None] * (None in sources)
    target = water(sources, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sources.values()))
    got = {r.doc_id: r for r in cp.run(spark, sf).collect()}
    assert got.keys() <= size.keys() and all(r["size"] == size[i] and r.target == pytest.approx(target[r.source]) for i, r in got.items())
    for s in sources:
        assert 0 <= target[s] - sum(r.taken for r in got.values() if r.source == s) < 1 + 1e-6
    whole = {i for i, _, s in left if target[s] >= sources[s] and size[i]}
    assert whole <= got.keys()


def grouped(sets):
    groups = Sets(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] and sets[b] and similar(sets[a], sets[b]):
            groups.join(a, b)
    return [groups.top(k) for k in range(len(sets))]


@pytest.mark.parametrize("name, stage", cp.STAGES)
def test_stages_take_clashing_columns_and_odd_rows(spark, sf, odd, name, stage):
    more = odd.withColumns({c: F.lit("mine") for c in CLASH})
    got, plain = stage(spark, more, sf), stage(spark, odd, sf)
    assert got.columns == plain.columns and sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


def test_mixing_stage(spark, sf):
    rows = [(1, "a b c d", "x"), (1, "a b c d", "x"), (2, None, "x"), (3, "", "y"), (4, "e f", "y"), (5, "g", None)]
    got = cp.mixing_stage(spark, make(spark, rows), sf).collect()
    assert {r.doc_id for r in got} == {1, 4, 5} and all(0 < r.taken <= 2 * r["size"] for r in got) and sum(r.doc_id == 1 for r in got) == 2


def test_stage_names_and_order():
    assert [n for n, _ in cp.STAGES] == ["quality", "lines", "near_duplicates", "decontamination", "mixing"]


def test_line_stage(spark, sf):
    rows = [(1, "first line of text here\nshared line that many hold", "a"), (2, "shared line that many hold", "a"), (3, "own words only\nshared line that many hold", "b"), (4, "", "b"), (5, None, "b")]
    got = {r.doc_id: (r.text, r.n_chars) for r in cp.line_stage(spark, make(spark, rows), sf).collect()}
    assert got == {1: (rows[0][1], len(rows[0][1])), 3: ("own words only", 14), 4: ("", 0), 5: (None, 0)}


def test_near_duplicate_stage(spark, sf):
    base = [f"w{i}" for i in range(100)]
    other = list(base)
    other[50] = "x"
    rows = [(3, " ".join(base), "a"), (1, " ".join(other), "a"), (2, " ".join(base), "b"), (9, "something else", "b"), (None, None, None)]
    out = cp.near_duplicate_stage(spark, make(spark, rows), sf)
    assert out.columns == COLUMNS and {r.doc_id for r in out.collect()} == {1, 9, None}


def test_near_duplicate_stage_keeps_one_row_a_group(spark, sf, odd):
    # one text of id 5 is a near copy of all others with words
    got = [(r.doc_id, bool(r.text)) for r in cp.near_duplicate_stage(spark, odd, sf).collect()]
    assert sorted(got, key=str) == [(5, True), (7, False), (None, False)]
    base, other = " ".join(f"w{i}" for i in range(90)), " ".join(f"v{i}" for i in range(90))
    rows = [(4, base, "b"), (4, base, "a"), (4, base, "a"), (4, other, "a"), (3, other + " x", "a"), (None, base, "a")]
    rows += [(None, "only null ids hold this text", "a")] * 2 + [(None, "", "a")] * 2
    out = cp.near_duplicate_stage(spark, make(spark, rows), sf).collect()
    assert sorted(((r.doc_id, r.text, r.source) for r in out), key=str) == sorted([rows[1], rows[4], rows[6], rows[8], rows[9]], key=str)


def test_decontamination_stage(spark, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    rows = [(1, f"before {item} after", "a"), (2, "clean text", "a"), (3, None, "b")]
    assert {r.doc_id for r in cp.decontamination_stage(spark, make(spark, rows), sf).collect()} == {2, 3}


@pytest.mark.parametrize("name, stage", cp.STAGES)
def test_stages_take_empty_tables(spark, sf, empty, name, stage):
    out = stage(spark, empty, sf)
    assert out.count() == 0
    if name != "mixing":
        assert out.columns == COLUMNS


def test_quality_stage_keeps_good_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = cp.quality_stage(spark, docs.withColumn("extra", F.lit(1)), sf).select("doc_id")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1")
    lost = labels.join(kept, "doc_id", "left_anti").count()
    assert lost <= 0.05 * labels.count()


@pytest.mark.parametrize("limit", [0, 10**6])
def test_broadcasts_beyond_their_bounds_change_nothing(spark, docs, sf, monkeypatch, limit):
    from tandem.llm import decontaminate

    want = {s.__name__: sorted(map(str, s(spark, docs, sf).collect())) for s in (cp.near_duplicate_stage, cp.decontamination_stage)}
    monkeypatch.setattr(cp.near, "BROADCAST_NODES", limit)
    monkeypatch.setattr(decontaminate, "BROADCAST_DOCS", limit)
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    assert want == {s.__name__: sorted(map(str, s(spark, docs, sf).collect())) for s in (cp.near_duplicate_stage, cp.decontamination_stage)}

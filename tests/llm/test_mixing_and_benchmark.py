import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tandem.llm import decontaminate, mixing

from .conftest import make

WORD = r"[^\x20\x09-\x0D]+"


def water(sizes, weights, total, cap=2.0):
    """Clamp and share out again until none is above."""
    target, open_ = {}, dict(sizes)
    while open_:
        w = sum(weights[s] for s in open_)
        level = (total - sum(target.values())) / w
        over = [s for s in open_ if level * weights[s] > cap * sizes[s]]
        if not over:
            return target | {s: level * weights[s] for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
            del open_[s]
    return target


def test_targets_and_draw(docs, rows):
    got = mixing.mix(docs).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(WORD, t or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = water(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert len(got) == len(rows)
    for s in sizes:
        assert 0 <= want[s] - taken[s] < 1 + 1e-6
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))


def test_mix_odd_and_empty(odd, empty, spark):
    assert mixing.mix(empty).count() == 0 and mixing.mix(odd).count() == 6
    blank = mixing.mix(make(spark, [(1, "", "a"), (2, None, None)])).collect()
    assert [(r.target, r.taken) for r in blank] == [(0.0, 0), (0.0, 0)]


def test_native_plans(spark, sf):
    for q in (mixing.query, decontaminate.query):
        plan = q(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)


def split(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    wins = {}
    for k, t in items:
        w = split(t)
        for i in range(len(w) - 9) if len(w) >= 10 else range(1 if w else 0):
            wins.setdefault(tuple(w[i : i + 10]), set()).add(str(k))
    out = []
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for x, names in wins.items():
            for s in range(len(w) - len(x) + 1):
                if tuple(w[s : s + len(x)]) == x:
                    hit |= set(range(s, s + len(x)))
                    found |= names
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return sorted(out)


def test_hits_equal_brute_force(spark):
    long = " ".join(f"Ab{i}" for i in range(30))
    items = [(1, long), (2, "Short one"), (3, "x"), (4, ""), (5, None), (6, " ".join(f"ab{i}" for i in range(5, 17))), (7, "Ünï Ab1"), (8, long), (9, "ab3 ab4 ab5 ab6 ab7 ab8 ab9 ab10 ab11 ab12")]
    docs = [(1, long.upper()), (2, "a " + " ".join(f"ab{i}" for i in range(3, 13)) + " b SHORT, one! short one"), (3, " ".join(f"ab{i}" for i in range(3, 12))), (4, None), (5, ""), (6, "Ünï-ab1 ünï ab1 X"), (7, long + " " + long), (8, "x" * 40)]
    b = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, key string")
    got = decontaminate.decontaminate(make(spark, [(i, t, "s") for i, t in docs], clash=True), b)
    got = got.select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256))
    assert sorted(map(tuple, got.collect())) == brute(docs, items)


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_broadcast_and_shuffle_agree(spark, sf, duck, limit, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(decontaminate, "BROADCAST_DOCS", limit)
    got = sorted(map(tuple, decontaminate.query(spark, sf).where("contaminated").select("doc_id", "n_hit", "items_sha256").collect()))
    want = duck.execute(f"SELECT doc_id, n_hit, items_sha256 FROM ({decontaminate.ORACLE}) WHERE contaminated").fetchall()
    assert got == sorted(want) and len(got) > 0


def test_benchmark_odd_and_empty(spark, odd, empty):
    b = spark.createDataFrame([(None, "a1 a2 a3"), (1, None), (1, "a1 a2 a3"), (1, "a5")], "item_id long, text string")
    assert decontaminate.decontaminate(empty, b).count() == 0
    got = decontaminate.decontaminate(odd, b).collect()
    assert len(got) == 6 and {tuple(r["items"]) for r in got if r.n_words} == {("1", "null")}
    assert {r.n_hit for r in decontaminate.decontaminate(odd, b.limit(0)).collect()} == {0}


def test_long_texts_and_repeated_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, long, "s"), (1, long, "s"), (1, "w5", "s"), (None, long, "s"), (None, None, "s"), (None, None, "s")]
    b = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20_000, 20_012))), (2, "w7 w8")], "item_id long, text string")
    got = decontaminate.decontaminate(make(spark, rows, clash=True), b).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit) for r in got) == sorted([("1", 30_000, 14), ("1", 30_000, 14), ("1", 1, 0), ("None", 30_000, 14), ("None", 0, 0), ("None", 0, 0)])

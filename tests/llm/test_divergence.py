import random
import re
from collections import Counter

import pytest

from tandem.llm import divergence

from .conftest import make

SCALE = 10**9


def split(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(divergence.TERM, low)


def brute(rows, top=10, least=10):
    """rows: (text, lang, source)."""
    counts, df, total = {}, Counter(), {}
    for t, lang, source in rows:
        lang, source, c = lang or "", source or "", Counter(split(t))
        counts.setdefault((lang, source), Counter()).update(c)
        total.setdefault(lang, Counter()).update(c)
        df.update((lang, w) for w in c)
    out = []
    for lang in {k for k, _ in counts}:
        kept = [w for w in total[lang] if df[lang, w] >= least]
        share = lambda c, n: 1 + SCALE * (c + 2) // (n + 2 * len(kept))
        own = {s: c for (k, s), c in counts.items() if k == lang}
        n = {s: sum(c[w] for w in kept) for s, c in own.items()}
        p = {s: [share(c[w], n[s]) for w in kept] for s, c in own.items()}
        q = [share(total[lang][w], sum(n.values())) for w in kept]
        apart = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            found = {"pair": [(-sum(map(apart, p[s], p[h])), h.encode(), h) for h in own if h != s], "term": [(-apart(a, b), w.encode(), w) for w, a, b in zip(kept, p[s], q) if own[s][w] and a > b]}
            for part, x in found.items():
                out += [(lang, s, part, w, -v, i + 1) for i, (v, _, w) in enumerate(sorted(x)) if part == "pair" or i < top]
    return sorted(out)


def corpus(spark, seed, n=400, sources=9):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(70)] + ["É", "數"]
    rows = []
    for i in range(n):
        s = 0 if rng.random() < 0.3 else rng.randrange(sources)
        own = words[s * 3 : s * 3 + 40] + words[-2:]
        rows.append((" ".join(rng.choice(own) * rng.choice([1, 1, 1, 2]) for _ in range(rng.randint(0, 30))).upper() if i % 3 else " ".join(rng.choice(own) for _ in range(9)), rng.choice(["en", "de", None]), f"s{s}" if s else None))
    rows += [("only123 here45", "xx", "a"), (None, "xx", "b"), ("", "en", "bare"), (None, None, "bare"), ("lonely " * 30, "yy", "z")]
    return rows


def run(spark, rows, **kw):
    df = spark.createDataFrame([(t, lang, s, "x", 1) for t, lang, s in rows], "text string, lang string, source string, term string, g int")
    return sorted(map(tuple, divergence.audit(df, **kw).select("lang", "source", "part", "item", "value", "rank").collect()))


@pytest.mark.parametrize("seed", range(3))
def test_audit_equals_brute_force(spark, seed):
    rows = corpus(spark, seed)
    assert run(spark, rows) == brute(rows)


def test_blocks_and_tiles_add_up(spark, monkeypatch):
    rows = corpus(spark, 5, 300, 23)
    want = run(spark, rows, min_docs=3)
    monkeypatch.setattr(divergence, "BLOCK", 40)
    assert run(spark, rows, min_docs=3) == want == brute(rows, least=3)


def test_tile_of_two_sides_equals_brute_force(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(divergence, "TILE", 4)
    rng = np.random.default_rng(2)
    p = np.where(rng.random((8, 30)) < 0.5, rng.integers(2, 10**9, (8, 30)), 0)
    zero = rng.integers(1, 1000, 8)
    g, t = np.nonzero(p)
    rows = pa.table({"term": pa.array([b"%d" % x for x in t] + [None] * 8, pa.binary()), "g": pa.array([*g, *range(8)], pa.int64()), "p": pa.array([*p[g, t], *zero], pa.int64())})
    got = divergence._tile(tuple(map(pa.scalar, ("en", 0, 1, 0))), rows).to_pylist()
    full = np.where(p > 0, p, zero[:, None]).astype(object)
    for r in got:
        a, b, f00 = full[r["g"]], full[r["h"]], (int(zero[r["g"]]) - int(zero[r["h"]])) ** 2 // int(zero[r["g"]] + zero[r["h"]])
        assert r["value"] + 30 * f00 == sum((x - y) ** 2 // (x + y) for x, y in zip(a, b))
    assert sorted((r["g"], r["h"]) for r in got) == [(i, j) for i in range(4) for j in range(4, 8)]


def test_shares_are_exact(spark):
    from pyspark.sql import functions as F

    c, n, v = 3 * 10**13 + 7, 9 * 10**14 + 1, 10**9
    col = lambda x: F.lit(x).cast("long")
    assert spark.range(1).select(divergence.share(col(c), col(n), col(v)), divergence.apart(col(10**9 + 1), col(2))).first()[:] == (1 + SCALE * (c + 2) // (n + 2 * v), (10**9 - 1) ** 2 // (10**9 + 3))


def test_long_text_and_repeated_rows(spark):
    rows = [("ab " * 300_000 + "cd", "en", "a")] + [("ab cd ef", "en", "b")] * 30 + [("ef gh " * 9, "en", "c")] * 12
    assert run(spark, rows) == brute(rows)


def test_odd_and_empty(spark, odd, empty):
    assert divergence.audit(empty).count() == 0
    got = divergence.audit(make(spark, [(1, "a b", None), (None, None, "s")])).collect()
    assert sorted((r.source, r.part, r.item, r.value) for r in got) == [("", "pair", "s", 0), ("s", "pair", "", 0)]
    assert divergence.audit(odd).count() == 2

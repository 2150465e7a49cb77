import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tandem.llm import lexical

from .conftest import make


def split(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(lexical.TERM, low)


def brute(docs, items, k=10):
    words = [(i, Counter(split(t))) for i, t in docs]
    words = [(i, c) for i, c in words if c]
    n, total = len(words), sum(sum(c.values()) for _, c in words)
    df = Counter(t for _, c in words for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(split(t))
    out = []
    for item, terms in asked.items():
        found = []
        for i, c in words:
            m = 10 + 90 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                found.append((-score, i is None, i, score))
        found.sort()
        out += [(item, r + 1, i, s) for r, (_, _, i, s) in enumerate(found[:k])]
    return sorted(map(str, out))


def run(spark, docs, items, k=10, **build):
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, term string")
    return sorted(str((r.item_id, r["rank"], r.doc_id, r.score)) for r in lexical.search(lexical.build(docs, **build), b, k).collect())


ITEMS = [(1, "word3 WORD5 w7é word5"), (2, "one"), (3, None), (4, "..."), (None, "word8 word9 word10"), (5, "absent"), (6, " ".join(f"word{i}" for i in range(400))), (1, "word11"), (7, "w7é w14é w21é w28é")]


@pytest.mark.parametrize("docs_a_chunk, terms_a_chunk, block, rows_a_batch", [(4096, 100_000, 200_000, 32), (3, 100_000, 3, 2), (4096, 5, 200_000, 7)])
def test_search_equals_brute_force(spark, docs, rows, monkeypatch, docs_a_chunk, terms_a_chunk, block, rows_a_batch):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
    monkeypatch.setattr(lexical, "INDEX_ROWS", rows_a_batch)
    assert run(spark, docs, ITEMS, chunk_docs=docs_a_chunk, chunk_terms=terms_a_chunk) == brute([(i, t) for i, t, _ in rows], ITEMS)


def test_ties_repeated_rows_and_null_ids(spark):
    rows = [(i % 7 if i % 5 else None, "same text here", "s") for i in range(60)] + [(9, "same", "s"), (8, "Same text", "s")]
    items = [(1, "same text"), (2, "HERE")]
    assert run(spark, make(spark, rows), items, 12) == brute([(i, t) for i, t, _ in rows], items, 12)


@pytest.mark.parametrize("seed", range(3))
def test_many_lengths_and_counts(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 2) for _ in range(rng.choice([1, 2, 5, 30, 200]))), "s") for i in range(400)]
    items = [(i, " ".join(rng.sample("abcdefghijklmnop", 4))) for i in range(12)]
    assert run(spark, make(spark, rows).repartition(5), items) == brute([(i, t) for i, t, _ in rows], items)


def test_long_text(spark):
    rows = [(1, "a " * 300_000 + "z", "s"), (2, "a b", "s"), (3, "z " * 5, "s")]
    assert run(spark, make(spark, rows), [(1, "z"), (2, "a b z")]) == brute([(i, t) for i, t, _ in rows], [(1, "z"), (2, "a b z")])


def test_odd_and_empty(spark, odd, empty):
    items = [(1, "a1 a2 more"), (2, "")]
    assert run(spark, empty, items) == []
    assert run(spark, odd, [(1, None)]) == []
    assert run(spark, odd, items) == brute([(r.doc_id, r.text) for r in odd.collect()], items)


def test_strata_below_the_tenth_score_are_not_visited():
    chunks = [lexical._chunk(i, 100 + i, [(j, Counter({b"a": 2, b"b": 1}))]) for i, j in enumerate((5, 6, 7))]
    batch = pa.Table.from_batches(chunks).combine_chunks().to_batches()[0]
    block = lexical.Block(1, pa.array([b"a"], pa.binary()), np.array([0, 1]), np.array([0]), np.array([7]), np.zeros(1, np.int64))
    score = lambda m: 7 * (2 * 10**9 // (2000 + 8 * m))
    for least, want in ((0, [(5, score(100))]), (score(100), [(5, score(100))]), (score(100) + 1, [])):
        top = {}
        lexical._visit(block, batch, 1, top, np.array([least]))
        assert [(int(d), int(s)) for sc, doc in top.values() for s, d in zip(sc, doc)] == want


def test_index_holds_every_document_by_stratum(spark, sf):
    index = lexical.build(spark.read.parquet(f"{sf}/documents.parquet"))
    chunks = index.chunks().select("m", "docs").collect()
    assert len({r.m for r in chunks}) > 10 and sum(len(r.docs) for r in chunks) == index.n_docs == len({d for r in chunks for d in r.docs})


def test_normaliser_does_not_overflow(spark):
    from pyspark.sql import functions as F

    n, docs, terms = 10**7, 5 * 10**10, 3 * 10**13
    assert spark.range(1).select(lexical.normaliser(F.lit(n).cast("long"), docs, terms)).first()[0] == 10 + 90 * n * docs // terms

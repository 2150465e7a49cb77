import zlib

import numpy as np
import pytest

from tandem.llm import labelled, quality, toxicity

SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("op, label, modulus, held, hit, clean", [(quality, "quality", 4, 2, 0.8, 0.95), (toxicity, "toxic", 5, 0, 0.5, 0.95)])
def test_held_out_accuracy(spark, op, label, modulus, held, hit, clean):
    got = op.query(spark, SMALL).toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % modulus == held)).all()
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").toPandas()
    test = got[got.held_out].merge(labels, on="doc_id")
    marked, plain = (0, 1) if label == "quality" else (1, 0)
    assert (test[test[label] == marked].predicted == marked).mean() >= hit
    assert (test[test[label] == plain].predicted == plain).mean() >= clean


@pytest.mark.parametrize("op", [quality, toxicity])
def test_labels_of_held_out_rows_are_not_used(spark, sf, op):
    from pyspark.sql import functions as F

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = labelled.remainder(4) == 2 if op is quality else labelled.remainder(5) == 0
    col = "quality" if op is quality else "toxic"
    flipped = labels.withColumn(col, F.when(out, 1 - F.col(col)).otherwise(F.col(col)))
    texts = ["some text", "THIS!! IS!! LOUD!!", "idiot | scum"]
    assert np.array_equal(op.train(docs, labels).scores(texts), op.train(docs, flipped).scores(texts))


@pytest.mark.parametrize("op", [quality, toxicity])
def test_degenerate_training(spark, odd, empty, op):
    labels = spark.createDataFrame([(5, 1, 1), (6, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    for docs, known in ((odd, labels), (odd, labels.limit(0)), (empty, labels)):
        got = op.score(odd, op.train(docs, known)).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert op.score(empty, op.train(empty, labels)).count() == 0


def test_texts_without_features(spark):
    rows = [("good words in a sentence " * 5 + str(i), 1) for i in range(40)] + [("$$$ %%% ### " * 9 + str(i), 0) for i in range(40)]
    for op in (quality, toxicity):
        s = op.fit(rows).scores(["", "a", "x" * 200_000])
        assert ((0 <= s) & (s <= 1)).all()


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, y int")
    from pyspark.sql import functions as F

    assert len(labelled.sample(docs, labels, "y", F.lit(True), 10, 10**6)) == 20
    assert len(labelled.sample(docs, labels, "y", F.lit(True), 10, 1000)) == 10


def test_a_long_text_does_not_end_the_sample(spark):
    from pyspark.sql import functions as F

    first = spark.range(50).orderBy(F.xxhash64("id")).first().id
    text = lambda i: "x" * (600 if i == first else 100)
    docs = spark.createDataFrame([(i, text(i)) for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, y int")
    got = labelled.sample(docs, labels, "y", F.lit(True), 10, 1000)
    assert sorted(y for _, y in got) == [0] * 5 + [1] * 5 and {len(t) for t, _ in got} == {100}
    # a label whose only text is too long still has it
    alone = labels.select("doc_id", (F.col("doc_id") == first).cast("int").alias("y"))
    assert [len(t) for t, y in labelled.sample(docs, alone, "y", F.lit(True), 10, 1000) if y == 1] == [600]


@pytest.mark.parametrize("op", [quality, toxicity])
def test_repeated_rows_and_clashing_names(spark, op):
    rows = [("good words in a sentence " * 5 + str(i), 1) for i in range(40)] + [("$$$ %%% ### " * 9 + str(i), 0) for i in range(40)]
    docs = spark.createDataFrame([(1, "good words", "x"), (1, "good words", "x"), (2, None, "x")], "doc_id long, text string, mine string")
    got = op.score(docs, op.fit(rows)).collect()
    assert len(got) == 3 and got[0].score == got[1].score and {r.mine for r in got} == {"x"}
    with pytest.raises(ValueError, match="already has score"):
        op.score(docs.withColumn("score", docs.mine), op.fit(rows))


def test_repeated_rows_enter_the_sample_once(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "x" * 90)], "doc_id long, text string").crossJoin(spark.range(20_000).select()).unionByName(
        spark.createDataFrame([(2, "y" * 90), (3, "z"), (3, "z and other words"), (3, None)], "doc_id long, text string")
    )
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, y int")
    assert labelled.sample(docs, labels, "y", F.lit(True), 10, 1000) == [("x" * 90, 1), ("y" * 90, 0), ("", 0), ("z", 0), ("z and other words", 0)]
    assert len(labelled.sample(docs, labels, "y", F.lit(True), 2, 1000)) == 3


ROWS = [(f"good words in a sentence number {i} that say {i * i} things\n" * (1 + i % 4), 1) for i in range(60)] + [(f"$$$ %%% buy {i} ### now {i * 7}!!! " * (1 + i % 5), 0) for i in range(60)]
SOME = [t for t, _ in ROWS[::9]] + ["", "a", "é" * 300, "good words %%% buy", "x" * 256, "x" * 257]


def test_quality_scores_equal_a_plain_reckoning():
    import math

    import zstandard

    m = quality.fit(ROWS)
    assert m.good and m.bad
    size = lambda d, part: len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False).compress(part))
    for t, got in zip(SOME, m.scores(SOME)):
        raw = t.encode()
        diff = sum(size(m.bad, raw[k : k + 256]) - size(m.good, raw[k : k + 256]) for k in range(0, len(raw), 256)) / len(raw) if raw else 0.0
        short = 1 / (1 + len(raw) / 100)
        z = m.slope[0] * diff + m.slope[1] * short + m.slope[2] * diff * short + m.intercept
        assert got == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-9)


def test_toxicity_scores_equal_a_plain_reckoning():
    import math

    rows = [(t, 1 - y) for t, y in ROWS]
    m, mask = toxicity.fit(rows), 2**64 - 1

    def grams(t):
        found = set()
        low = t.lower()
        for n in (4, 5, 6):
            for s in range(len(low) - n + 1):
                h = 0
                for c in low[s : s + n]:
                    h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) & mask
                found.add((((h ^ (h >> 29)) * (0xBF58476D1CE4E5B9 + 2 * n)) & mask) >> (64 - toxicity.BITS))
        return found

    for t, got in zip(SOME, m.scores(SOME)):
        g = grams(t)
        z = m.intercept + (sum(float(m.weights[k]) for k in g) / math.sqrt(max(sum(float(m.scale[k]) for k in g), 1e-9)) if g else 0.0)
        assert got == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-4)
    # the ratios are those of the definition: documents that hold a feature, smoothed
    held = [grams(t) for t, _ in rows]
    for k in list(held[0])[:20] + list(held[-1])[:20]:
        count = [sum(k in h for h, (_, y) in zip(held, rows) if y == label) + 1 for label in (0, 1)]
        assert float(m.scale[k]) == pytest.approx(math.log((count[1] / 62) / (count[0] / 62)) ** 2, rel=1e-4, abs=1e-9)

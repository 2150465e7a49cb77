import re
from collections import Counter

from tandem.llm import rules

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    w = re.findall(WORD, text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(grams)
    cover = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)


def test_measures_equal_brute_force(docs, rows):
    got = rules.measures(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    want = {i: brute(t) for i, t, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:] == want[r.doc_id]


def test_small_texts(spark):
    texts = ["a b", "a b c", "a b c a b c", "a b c\nd\n\na b c\na b c", "x # * x", "é é é é é", "\x0b\x0c   "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in rules.measures(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text)


def test_plan_has_no_functions_of_ours_and_no_shuffle(spark, sf):
    plan = rules.query(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_verdict_keeps_good_and_drops_bad(spark, sf):
    """Over the labelled rows: what passes the base rules and is good stays, most of what is bad goes."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = rules.query(spark, sf).join(labels, "doc_id").where("not base_failed").toPandas()
    assert got[got.quality == 1].kept.mean() == 1.0 and got[got.quality == 0].kept.mean() < 0.5


def test_clashing_names_and_long_texts(spark):
    import pytest

    text = " ".join(f"w{i % 5000}" for i in range(200_000))
    df = spark.createDataFrame([(1, text, "x"), (1, text, "x")], "doc_id long, text string, words string")
    assert [(r.n_words, r.n_repeat_words, r.words) for r in rules.measures(df).collect()] == 2 * [(200_000, 200_000, "x")]
    with pytest.raises(ValueError, match="already has n_lines"):
        rules.measures(df.withColumn("n_lines", df.words))


def test_odd_rows(odd, empty):
    assert rules.measures(empty).count() == 0
    assert rules.measures(odd).where("n_words is null").count() == 0

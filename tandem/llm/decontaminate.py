"""Benchmark decontamination by winnowed fingerprints, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, row_key, table, text_of

#: What separates words, after A-Z have become a-z.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Benchmark fingerprints up to this many (8 bytes each) are broadcast; more are shuffled.
BROADCAST_ROWS = 1_000_000
#: Documents with a fingerprint of the benchmark (a key and a few fingerprints each) up to which these are broadcast.
BROADCAST_DOCS = 100_000


def words(text: str) -> Column:
    """Lower-cased words; ASCII texts take the faster way to the same result."""
    t = text_of(text)
    low = F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    return F.array_remove(F.split(low, BREAK), "")


def grams(tokens: Column, n: int) -> Column:
    """All runs of n words, as strings; none if there are fewer words."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def gram_hashes(w: Column, n: int) -> Column:
    """Hashes of the runs of n words; none if there are fewer."""
    at = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(n)]))
    return F.when(F.size(w) >= n, at).otherwise(F.array().cast("array<bigint>"))


def minima(hashes: Column, width: int) -> Column:
    """The smallest of each ``width`` neighbouring hashes."""
    mins = F.transform(F.sequence(F.lit(1), F.size(hashes) - (width - 1)), lambda i: F.array_min(F.slice(hashes, i, width)))
    return F.when(F.size(hashes) >= width, mins).otherwise(F.array().cast("array<bigint>"))


def fingerprints(df: DataFrame, lengths: list[int], span: int, k: int) -> DataFrame:
    """Add f<n> for each length: a fingerprint of each run of n words of the column w.

    Of a run of ``span`` words it is the smallest hash of its runs of ``k`` words (winnowing), of a
    shorter one the hash of all its words.  Equal runs have equal fingerprints, so no shared run is missed.
    """
    df = df.withColumn("_hashes", gram_hashes(F.col("w"), k)) if span in lengths else df
    return df.withColumns({f"f{n}": minima(F.col("_hashes"), span - k + 1) if n == span else gram_hashes(F.col("w"), n) for n in lengths}).drop("_hashes")


def benchmark_windows(benchmark: DataFrame, span: int = 10) -> DataFrame:
    """Each different window: its words joined (window), their number (n) and the items that hold it."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words("text").alias("w")).where(F.size("w") > 0)
    cut = F.when(F.size("w") >= span, grams(F.col("w"), span)).otherwise(F.array(F.array_join("w", " ")))
    return (
        items.select("item", F.least(F.size("w"), F.lit(span)).alias("n"), F.explode(F.array_distinct(cut)).alias("window"))
        .groupBy("window", "n").agg(F.sort_array(F.collect_set("item")).alias("items"))
    )


def few(df: DataFrame, most: int) -> DataFrame:
    """The frame, broadcast if it has at most ``most`` rows."""
    return F.broadcast(df) if df.count() <= most else df


def screen(docs: DataFrame, wins: DataFrame, lengths: list[int], span: int, k: int) -> DataFrame:
    """doc_id, key, n_words, n_rows and near (fingerprints that benchmark windows have too), a row for each different doc_id and key.

    One pass takes the words of each text, and all its fingerprints, whatever windows' lengths there are.
    """
    tokens = docs.select("doc_id", "key", words("text").alias("w"))
    own = fingerprints(wins.withColumn("w", F.split("window", " ")), lengths, span, k)
    target = cut(own.select(F.explode(F.array_distinct(F.concat(*[F.when(F.col("n") == n, F.col(f"f{n}")).otherwise(F.array().cast("array<bigint>")) for n in lengths]))).alias("f")).distinct())
    here = fingerprints(tokens, lengths, span, k).select("doc_id", "key", F.size("w").cast("long").alias("n_words"), F.array_distinct(F.concat(*[f"f{n}" for n in lengths])).alias("all"))
    every = here.select("doc_id", "key", "n_words", F.posexplode_outer("all").alias("pos", "f"))
    found = every.join(few(target.select("f", F.lit(True).alias("known")), BROADCAST_ROWS), "f", "left")
    return found.groupBy("doc_id", "key", "n_words").agg(F.count_if(F.coalesce("pos", F.lit(0)) == 0).alias("n_rows"), F.collect_set(F.when(F.col("known"), F.col("f"))).alias("near"))


def occurrences(docs: DataFrame, screened: DataFrame, wins: DataFrame, lengths: list[int], span: int, k: int) -> DataFrame:
    """(key, start, n, items): around each fingerprint that is near, whole windows are compared word by word."""
    near = screened.where(F.size("near") > 0).select("key", "near").dropDuplicates(["key"])
    again = docs.select("key", "text").join(few(near, BROADCAST_DOCS), "key").dropDuplicates(["key"]).select("key", "near", words("text").alias("w"))
    again = fingerprints(again, lengths, span, k)
    spot = lambda n: lambda i: F.struct(i.alias("start"), F.lit(n).alias("n"), F.array_join(F.slice("w", i + 1, n), " ").alias("window"))
    at = lambda n: F.when(F.size(f"f{n}") > 0, F.filter(F.sequence(F.lit(0), F.size(f"f{n}") - 1), lambda i: F.array_contains("near", F.get(f"f{n}", i)))).otherwise(F.array().cast("array<int>"))
    spots = again.select("key", F.explode(F.concat(*[F.transform(at(n), spot(n)) for n in lengths])).alias("s")).select("key", "s.*")
    return spots.join(few(wins, BROADCAST_ROWS // 10), ["window", "n"]).select("key", "start", "n", "items")


def matched(docs: DataFrame, benchmark: DataFrame, span: int, k: int) -> tuple[DataFrame, DataFrame] | None:
    """What screen() and occurrences() give; None if no item has a window."""
    wins = cut(benchmark_windows(benchmark, span))
    lengths = sorted(r["n"] for r in wins.select("n").distinct().collect())  # at most span rows
    if not lengths:
        return None
    screened = cut(screen(docs, wins, lengths, span, k))
    return screened, occurrences(docs, screened, wins, lengths, span, k)


def hits(docs: DataFrame, benchmark: DataFrame, span: int = 10, k: int = 5) -> DataFrame:
    """Occurrences of benchmark windows: (key, start, n, items), start from 0 in words.

    ``docs`` has key and text, equal texts where keys are equal.  Both sides keep the minimum k-gram hash of each window
    and join on these fingerprints; texts with a hit are read again and whole windows compared.
    Items shorter than ``span`` are one window each and are found by the hash of all their words.
    Of the texts with a hit only keys and fingerprints move, by a broadcast up to BROADCAST_DOCS of
    them; beyond it the texts are shuffled once.
    """
    found = matched(docs.select(F.lit(None).cast("long").alias("doc_id"), "key", "text"), benchmark, span, k)
    return found[1] if found else docs.select("key").limit(0).select("key", F.lit(0).alias("start"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = 10, k: int = 5) -> DataFrame:
    """Per row of ``docs``: doc_id, key, n_words, n_hit, items (sorted strings), spans.

    A document word is hit if an occurrence of a window of a benchmark item covers it.
    ``spans`` holds the (start, n) of each occurrence.  Null and empty texts have no
    words; items without words have no window; without benchmark rows nothing is hit.
    A null item_id is named ``null``; repeated item ids count once; repeated rows each give a row.
    """
    rows = docs.select("doc_id", "text").withColumn("key", row_key("doc_id", "text"))
    found = matched(rows, benchmark, span, k)
    no_items, no_spans, zero = F.array().cast("array<string>"), F.array().cast("array<struct<start:int,n:int>>"), F.lit(0).cast("long")
    if found is None:
        return rows.select("doc_id", "key", F.size(words("text")).cast("long").alias("n_words"), zero.alias("n_hit"), no_items.alias("items"), no_spans.alias("spans"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["start"] + x["n"] - F.greatest(x["start"], a["end"]))).alias("n"), F.greatest(a["end"], x["start"] + x["n"]).alias("end"))
    per = (
        found[1].groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("spans"), F.collect_set("items").alias("items"))
        .select("key", "spans", F.sort_array(F.array_distinct(F.flatten("items"))).alias("items"), F.aggregate("spans", start, step)["n"].cast("long").alias("n_hit"))
    )
    return found[0].join(per, "key", "left").select(
        "doc_id", "key", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("items", no_items).alias("items"), F.coalesce("spans", no_spans).alias("spans"),
        F.explode(F.sequence(F.lit(1), F.col("n_rows"))).alias("copy"),
    ).drop("copy")


def query(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), h AS (
  SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n
), c AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

"""Quality rules: a table of thresholds compiled into one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, table, text_of

#: The symbols that count, and frequent words of the four languages.
SYMBOLS = "#*$%&|<>"
STOP_WORDS = tuple(
    "the of and to in is that it for as with was on be by this are from at or an a not have "
    "der die das und von zu mit den dem nicht ein eine ist im auf für des als auch sich "
    "le la les de des et un une du que qui dans pour par sur au avec pas en ne "
    "el los las y del al se con su una por lo como más para".split()
)


@dataclass(frozen=True)
class Rule:
    """A ratio of two of the measures must lie between least and most."""

    name: str
    over: str
    under: str
    least: float = float("-inf")
    most: float = float("inf")


#: The thresholds; ``one`` is the constant 1, ``all_words`` and ``all_lines`` are at least 1.
RULES = (
    Rule("length", "n_words", "one", least=50, most=1_000_000),
    Rule("word_length", "word_chars", "all_words", least=2, most=14),
    Rule("symbols", "n_symbols", "all_words", most=0.4),
    Rule("stop_words", "n_stop_words", "all_words", least=0.05),
    Rule("line_copies", "n_dup_lines", "all_lines", most=0.5),
    Rule("bullet_lines", "n_bullet_lines", "all_lines", most=0.9),
    Rule("upper_case", "n_upper", "all_words", most=2.5),
    Rule("repeats", "n_repeat_words", "all_words", most=0.5),
)


#: What measures() adds.
MEASURES = ("n_words", "n_repeat_words", "n_stop_words", "n_lines", "n_dup_lines", "n_bullet_lines", "word_chars", "n_symbols", "n_upper")


def let(value: Column, body) -> Column:
    """body(value), with the value computed once wherever the optimiser moves the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(w: Column) -> Column:
    """Words that three-word windows occurring twice or more cover.

    Windows' 64-bit hashes are sorted together with their places, so equal ones are neighbours.
    """
    hashed = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
    near = lambda g, i, j: F.coalesce(F.get(g, i)["h"] == F.get(g, j)["h"], F.lit(False))
    places = lambda g: F.transform(F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: near(g, i, i - 1) | near(g, i, i + 1)), lambda k: F.get(g, k)["i"])
    covered = lambda d: F.size(F.array_distinct(F.flatten(F.transform(d, lambda i: F.array(i, i + 1, i + 2)))))
    return F.when(F.size(w) >= 4, let(let(F.sort_array(hashed), places), covered)).otherwise(0)


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Add what the rules weigh, all as long; a null or empty text has none of it.

    Everything is computed inside the row, so no row is exploded and nothing is shuffled; a
    very long text costs its own row's memory, n log n in its words.  Repeated rows are measured alike.  Columns of
    ``df`` that are called as one of the measures raise ValueError, so nothing is overwritten.
    """
    if clash := sorted(set(MEASURES) & set(df.columns)):
        raise ValueError(f"the table already has {', '.join(clash)}")
    t = text_of(text)
    plain = F.translate(t, SPACES, "")
    words = F.array_remove(F.split(F.translate(t, SPACES, " " * len(SPACES)), " "), "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    of_words = let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), repeat_words(w).cast("long").alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
    ))
    of_lines = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(x, lambda y: F.ltrim(y).rlike(r"^[*•\-|]"))).cast("long").alias("n_bullet_lines"),
    ))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    inner = df.select(F.struct("*").alias("row"), of_words.alias("words"), of_lines.alias("lines"), plain.alias("plain"), t.alias("t"))
    found = {
        "word_chars": F.length("plain"), "n_symbols": F.length("t") - F.length(F.translate("t", SYMBOLS, "")), "n_upper": F.length("plain") - F.length(F.translate("plain", upper, "")),
    }
    return inner.select("row.*", "words.*", "lines.*", *[c.cast("long").alias(name) for name, c in found.items()])


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The rules as one boolean expression over the columns of measures()."""
    of = lambda name: F.lit(1.0) if name == "one" else F.greatest(F.col("n_words" if name == "all_words" else "n_lines"), F.lit(1)) if name in ("all_words", "all_lines") else F.col(name)
    out = F.lit(True)
    for r in rules:
        ratio = of(r.over) / of(r.under)
        if r.least > float("-inf"):
            out = out & (ratio >= r.least)
        if r.most < float("inf"):
            out = out & (ratio <= r.most)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    m = measures(table(spark, sf_dir, "documents").select("doc_id", "text"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return m.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict()).alias("kept"))


def _oracle() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM tri) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
         len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS stops, len(l) AS lines, len(list_filter(l, lambda x: regexp_matches(ltrim(x), '^[*•\-|]'))) AS bullets,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS upper, greatest(len(w), 1)::DOUBLE AS aw, greatest(len(l), 1)::DOUBLE AS al
  FROM w LEFT JOIN cov USING (doc_id)
),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words BETWEEN 50 AND 1000000 AND word_chars / aw BETWEEN 2 AND 14 AND n_symbols / aw <= 0.4 AND stops / aw >= 0.05
       AND n_dup_lines / al <= 0.5 AND bullets / al <= 0.9 AND upper / aw <= 2.5 AND n_repeat_words / aw <= 0.5 AS kept
FROM b
"""


ORACLE = _oracle()

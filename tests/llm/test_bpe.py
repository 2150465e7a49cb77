import hashlib
import random

import public_tokenizers as P
import pytest
import regex

from tandem.llm import bpe

from .conftest import make

RANKS = P.path("byte_bpe_50k.tiktoken")


def plain(ranks, piece):
    """Merge the neighbours with the least rank, leftmost first, until none has one."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 30))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


@pytest.fixture(scope="module")
def ranks():
    import base64

    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in bpe.read_ranks(RANKS).splitlines())}


@pytest.fixture(scope="module")
def enc():
    return bpe.encoding(bpe.read_ranks(RANKS), P.PATTERN)


TEXTS = ["", "a", "I'll don't  x's5\n\n y", "<|endoftext|> is text", "naïve 数学、物理。 ٣٤ ½ 😀😀", " " * 70, "tab\t\tend  　 x\x1c y", "\x00\x01", "abc123def,.!?456"]


def test_ids_equal_plain_merging(spark, ranks):
    got = {r.doc_id: list(r.ids) for r in bpe.encode(make(spark, [(i, t, "s") for i, t in enumerate(TEXTS)], clash=True), RANKS, P.PATTERN).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == [x for m in regex.findall(P.PATTERN, t) for x in plain(ranks, m.encode())]


def test_pieces_change_no_id(enc):
    rng = random.Random(4)
    parts = ["word", " and", "'s", "'", "  ", "\n", "\t\n ", "42", "!?", "数学", "。", "é", " ", " ", "\x1c", "٣", "😀", "ٱ", " '", "x'll"]
    for _ in range(300):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 120)))
        for size in (1, 3, 10):
            cut = list(bpe.pieces(t, size))
            assert "".join(cut) == t
            assert bpe.ids_of(enc, t, size).tolist() == enc.encode_ordinary(t)


@pytest.mark.parametrize("text", ["a" * 300_000, " " * 300_000 + "x", "word " * 60_000, "数" * 100_000, "数学。" * 60_000, "!" * 200_000, "x1" * 100_000])
def test_very_long_texts(enc, text):
    assert bpe.ids_of(enc, text).tolist() == enc.encode_ordinary(text)


def test_long_runs_stay_whole():
    assert list(bpe.pieces("a" * 500, 10)) == ["a" * 500] and len(list(bpe.pieces("ab " * 500, 10))) > 100


def test_query_round_trip(docs, rows):
    out = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert sorted((r.doc_id, bytes(r.decoded)) for r in out) == sorted((i, (t or "").encode()) for i, t, _ in rows)
    assert all(len(r.ids) > 0 for r in out if r.decoded)


def test_digests(spark, sf, duck, enc):
    got = {r.doc_id: r for r in bpe.query(spark, sf).collect()}
    want = duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()
    assert len(got) == len(want)
    for i, t in want:
        ids = enc.encode_ordinary(t)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_odd_and_empty(spark, odd, empty):
    assert bpe.encode(empty, RANKS, P.PATTERN).count() == 0
    got = bpe.decode(bpe.encode(odd, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert len(got) == 6 and sum(r.ids == [] and r.decoded == b"" for r in got) == 2
    part = spark.createDataFrame([(1, None), (2, []), (3, [171])], "doc_id long, ids array<int>")
    assert [bytes(r.decoded) for r in bpe.decode(part, RANKS, P.PATTERN).orderBy("doc_id").collect()][:2] == [b"", b""]

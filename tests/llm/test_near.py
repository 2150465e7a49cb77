import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.llm import fuzzy_lines, near, ngram_join, tokens

from .conftest import make

WORD = r"[^\x20\x09-\x0D]+"


class Sets:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def top(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)


def grams(w, k=5):
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def similar(a, b, t=0.8):
    return len(a & b) >= t * len(a | b) - 1e-12


def test_join_equals_brute_force(docs, rows):
    sets = {i: grams(re.findall(WORD, t or "")) for i, t, _ in rows}
    least, copies = {}, Counter(sets[i] for i, _, _ in rows)
    for i in sorted(sets):
        if sets[i]:
            least.setdefault(sets[i], i)
    groups, links = Sets(sets), Counter()
    for a, b in itertools.combinations(least.values(), 2):
        if similar(sets[a], sets[b]):
            links[a] += 1
            links[b] += 1
            groups.join(a, b)
    got = ngram_join.similar(docs).collect()
    assert len(got) == len(rows) and sum(r.n_links for r in got) > 0
    for r in got:
        s = sets[r.doc_id]
        rep = least[s] if s else r.doc_id
        assert (r.copy_of, r.class_id, r.n_links, r.n_copies) == (rep, groups.top(rep), links[rep], copies[s] if s else 1)


def test_lines_equal_brute_force(docs, rows):
    places = defaultdict(list)
    for i, t, _ in rows:
        for n, x in enumerate((t or "").split("\n")):
            if re.search(WORD, x):
                places[x].append((i, n))
    lines = sorted(places, key=lambda x: min(places[x]))
    sets = [frozenset(x[j : j + 5] for j in range(max(1, len(x) - 4))) for x in lines]
    groups = Sets(range(len(lines)))
    for a, b in itertools.combinations(range(len(lines)), 2):
        if similar(sets[a], sets[b]):
            groups.join(a, b)
    first = {}
    for k, x in enumerate(lines):
        first[groups.top(k)] = min(first.get(groups.top(k), (10**9, 0)), min(places[x]))
    gone = defaultdict(set)
    for k, x in enumerate(lines):
        for i, n in places[x]:
            if (i, n) != first[groups.top(k)]:
                gone[i].add(n)
    texts = {i: t or "" for i, t, _ in rows}
    with pytest.raises(ValueError, match="already has kept"):
        fuzzy_lines.dedup(docs)
    got = fuzzy_lines.dedup(docs.drop("kept")).collect()
    assert len(got) == len(rows) and {r["copies_of"] for r in got} == {"x"}
    for r in got:
        assert set(r.removed) == gone[r.doc_id] and r.n_removed == len(gone[r.doc_id]) and r.n_lines == len(texts[r.doc_id].split("\n"))
        assert r["kept"] == "\n".join(x for n, x in enumerate(texts[r.doc_id].split("\n")) if n not in gone[r.doc_id])


def test_lines_with_one_edit_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    word = lambda k: "".join(rng.choice(letters, k))
    texts = []
    for size in range(40, 124, 4):
        base = ""
        while len(base) < size:
            base += word(6) + " "
        base = base[:size].strip()
        mid = len(base) // 2
        words = base.split(" ")
        words[len(words) // 2] = word(6)
        texts += [base, base[:mid] + "é" + base[mid + 1 :], " ".join(words)]
    sets = [frozenset(x[j : j + 5] for j in range(len(x) - 4)) for x in texts]
    groups = Sets(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if similar(sets[a], sets[b]):
            groups.join(a, b)
    got = {r.doc_id for r in fuzzy_lines.dedup(make(spark, [(i, x, "s") for i, x in enumerate(texts)])).collect() if r.n_removed}
    assert got == {i for i in range(len(texts)) if groups.top(i) != i}
    assert {i for i, x in enumerate(texts) if i % 3 == 1 and len(x) >= 50} <= got


def test_odd_and_empty(odd, empty):
    assert ngram_join.similar(empty).count() == 0 and fuzzy_lines.dedup(empty).count() == 0
    got = ngram_join.similar(odd).collect()
    assert len(got) == 6
    # the extended text has 57 shingles, 56 of them the other's
    assert {r.n_links for r in got if r.doc_id == 5} == {1}
    assert fuzzy_lines.dedup(odd).count() == 6


def test_links_of_texts_with_null_ids(spark):
    base = [f"a{i}" for i in range(100)]
    change = lambda *at: " ".join("x" if i in at else w for i, w in enumerate(base))
    # the null ids' text alone bridges the others: one changed word parts 5 of 96 shingles
    rows = [(1, change(20, 40), "s"), (None, change(40), "s"), (2, change(40, 60, 80), "s"), (None, " ".join(f"b{i}" for i in range(50)), "s")]
    sets = [grams(t.split()) for _, t, _ in rows]
    assert similar(sets[0], sets[1]) and similar(sets[1], sets[2]) and not similar(sets[0], sets[2])
    got = ngram_join.similar(make(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in got) == [(0, 0, 0), (0, 1, 2), (1, 1, 1), (2, 1, 1)]


def test_large_group_is_cut_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(near, "TILE", 8)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(70):
        w = list(base)
        w[i] = f"new{i}"
        rows.append((i, " ".join(w), "s"))
    got = ngram_join.similar(make(spark, rows)).collect()
    sets = [grams(t.split()) for _, t, _ in rows]
    assert {r.doc_id: r.n_links for r in got} == {i: sum(similar(sets[i], s) for j, s in enumerate(sets) if j != i) for i in range(70)}
    assert {r.class_id for r in got} == {0}


def test_chained_group_is_compared_by_buckets(spark, monkeypatch):
    """Texts that each share a band or so with a few others, in one component: the same links as all pairs give."""
    monkeypatch.setattr(near, "TILE", 2)
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = base[1 + i // 2 :] + [f"n{x}" for x in rng.integers(0, 1000, 1 + i // 2)]
        rows.append((i, " ".join(w), "s"))
    sets = [grams(t.split()) for _, t, _ in rows]
    links = {i: sum(similar(sets[i], s) for j, s in enumerate(sets) if j != i) for i in range(60)}
    assert 0 < sum(links.values()) < 60 * 59
    assert {r.doc_id: r.n_links for r in ngram_join.similar(make(spark, rows)).collect()} == links


def test_structured_words_are_no_copies(spark):
    ones = [bin(i).count("1") % 2 for i in range(1024)]
    rows = [(1, "".join("ab"[x] for x in ones), "s"), (2, "".join("ba"[x] for x in ones), "s")]
    assert {(r.copy_of, r.n_copies) for r in ngram_join.similar(make(spark, rows)).collect()} == {(1, 1), (2, 1)}
    both = "".join(t for _, t, _ in rows).encode()
    names = fuzzy_lines.line_nodes(np.frombuffer(both, np.uint8), np.array([0, 1024]), np.array([1024, 2048]))
    assert names[0] != names[1]


@pytest.mark.parametrize("limit", [0, 10**6])
def test_broadcast_and_shuffle_find_the_same(docs, monkeypatch, limit):
    monkeypatch.setattr(near, "BROADCAST_NODES", limit)
    monkeypatch.setattr(fuzzy_lines, "BROADCAST_BYTES", limit)
    joined = sorted(map(str, ngram_join.similar(docs).collect()))
    lines = sorted(map(str, fuzzy_lines.dedup(docs.select("doc_id", "text")).collect()))
    monkeypatch.undo()
    assert joined == sorted(map(str, ngram_join.similar(docs).collect()))
    assert lines == sorted(map(str, fuzzy_lines.dedup(docs.select("doc_id", "text")).collect()))


def test_components_never_end_early(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    with pytest.raises(RuntimeError, match="not complete after 2 rounds"):
        near.components(path, rounds=2)
    assert {r.root for r in near.components(path).collect()} == {0}


@pytest.mark.parametrize("kind", ["words", "lines"])
def test_recall_near_the_threshold(kind):
    """Of pairs whose exact similarity is just over 0.8, the share that the real hashes and bands bring together."""
    from tandem.llm.common import pack
    import pyarrow as pa

    rng = np.random.default_rng(4)
    if kind == "words":
        rows, recall, edit, near_by = ngram_join.BAND_ROWS, ngram_join.RECALL, 4, 180
        vocab = [f"v{i}" for i in range(5000)]
        join, shingle = " ".join, lambda t: tokens.shingles(*tokens.words(*pack(pa.array(t))), 5)
    else:
        rows, recall, edit, near_by = fuzzy_lines.BAND_ROWS, fuzzy_lines.RECALL, 2, 100
        vocab = list("abcdefghijklmnopqrstuvwxyz ")
        join, shingle = "".join, lambda t: fuzzy_lines.shingle(5)(pa.array([x.encode() for x in t]))
    a, b = [], []
    for _ in range(1500):
        w = list(rng.choice(vocab, near_by))
        other = list(w)
        for i in rng.choice(near_by, edit, replace=False):
            other[i] = vocab[int(rng.integers(len(vocab)))]
        a.append(join(w))
        b.append(join(other))
    bands = tokens.bands_for(0.8, recall, rows)
    (g, go), (h, ho) = shingle(a), shingle(b)
    keys = [tokens.band_keys(tokens.min_hashes(x, o, bands * rows), rows) for x, o in ((g, go), (h, ho))]
    just = []
    for i in range(len(a)):
        x, y = set(g[go[i] : go[i + 1]].tolist()), set(h[ho[i] : ho[i + 1]].tolist())
        if 0.8 <= len(x & y) / len(x | y) <= 0.83:
            just.append(bool((keys[0][i] == keys[1][i]).any()))
    assert len(just) > 200 and np.mean(just) >= 0.99


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(i, i + 1) for i in range(40)] + [(int(a), int(b)) for a, b in rng.integers(100, 200, (60, 2))] + [(7, 7), (300, 299), (300, 299)]
    groups = Sets({x for p in pairs for x in p})
    for a, b in pairs:
        groups.join(a, b)
    got = {r.node: r.root for r in near.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: groups.top(x) for p in pairs if p[0] != p[1] for x in p}
    assert near.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("op", [ngram_join, fuzzy_lines])
def test_bands_reach_the_recall(op):
    n, miss = tokens.bands_for(0.8, op.RECALL, op.BAND_ROWS), 1 - 0.8**op.BAND_ROWS
    assert 1 - miss**n >= op.RECALL > 1 - miss ** (n - 1)


def test_token_hashes_follow_content():
    from tandem.llm.common import pack
    import pyarrow as pa

    buf, off = pack(pa.array(["a b  a\tb", None, "", "é a", "b"]))
    w, woff = tokens.words(buf, off)
    assert list(np.diff(woff)) == [4, 0, 0, 2, 1]
    assert w[0] == w[2] == w[5] and w[1] == w[3] == w[6] and len(set(w)) == 3
    c, coff = tokens.chars(buf, off)
    assert list(np.diff(coff)) == [8, 0, 0, 3, 1]
    g, goff = tokens.shingles(w, woff, 2)
    assert list(np.diff(goff)) == [3, 0, 0, 1, 1] and g[0] == g[2] != g[1]
    assert F is not None


@pytest.mark.parametrize("repeats", [1, 300])
def test_one_text_of_each_node_is_fetched(spark, monkeypatch, repeats):
    """Rows that stand many times lend one text, whatever their id."""
    t = " ".join(f"w{i}" for i in range(60))
    near = t.replace("w30", "x30")
    rows = [(None, t, "s")] * repeats + [(7, near, "s")] * repeats + [(8, "something else entirely here now", "s")]
    seen = []
    for module in (ngram_join, fuzzy_lines):
        real = module.verified
        monkeypatch.setattr(module, "verified", lambda edges, fetch, *a, real=real, **k: real(edges, lambda nodes: seen.append(out := fetch(nodes)) or out, *a, **k))
    got = ngram_join.classes(make(spark, rows)).collect()
    assert [x.count() for x in seen] == [2] and {(r.n_copies, r.n_links) for r in got if r.doc_id != 8} == {(repeats, 1)}
    seen.clear()
    out = fuzzy_lines.dedup(make(spark, rows)).collect()
    assert [x.count() for x in seen] == [2] and sum(r.n_removed for r in out) == repeats


def test_alike_lines_are_compared_with_one_of_them(spark, monkeypatch):
    """A group of n lines sends some n lines, not n * n / TILE, and those beyond its head are found too."""
    sent, real = [], near._units
    monkeypatch.setattr(near, "TILE", 8)
    monkeypatch.setattr(near, "_units", lambda *a: sent.append(out := real(*a)) or out)
    base = "the same long footer line stands below each and every page of this site, with one number in it: "
    texts = [base + f"{i:03}" for i in range(200)]
    out = fuzzy_lines.dedup(make(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()
    assert sum(r.n_removed for r in out) == 199 and sum(x.count() for x in sent) <= 200
    # a chain: each line is close to the next alone, so most are far from the head
    sent.clear()
    words = [f"{chr(97 + i % 26)}{i:02}" for i in range(60)]
    chain = [" ".join(words[: 60 - k] + [w.upper() for w in words[60 - k :]]) for k in range(0, 60, 2)]
    for limit in (10**9, 0):
        monkeypatch.setattr(near, "BROADCAST_BYTES", limit)
        out = fuzzy_lines.dedup(make(spark, [(i, t, "s") for i, t in enumerate(chain)])).collect()
        sets = [{t[j : j + 5] for j in range(len(t) - 4)} for t in chain]
        groups = Sets(range(len(chain)))
        for i, j in itertools.combinations(range(len(chain)), 2):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                groups.join(i, j)
        assert {r.doc_id for r in out if not r.n_removed} == {groups.top(i) for i in range(len(chain))}


def test_texts_of_small_and_large_groups_are_fetched_once(spark, monkeypatch):
    """One scan gives the texts of all groups, whether they are compared in one unit or cut into tiles."""
    monkeypatch.setattr(near, "TILE", 8)
    seen, real = [], fuzzy_lines.verified
    monkeypatch.setattr(fuzzy_lines, "verified", lambda edges, fetch, *a, **k: real(edges, lambda nodes: seen.append(out := fetch(nodes)) or out, *a, **k))
    many = [f"the same long footer line stands below each and every page of this site, with one number in it: {i:03}" for i in range(40)]
    two = ["a heading that another document has with one letter changed at its very end, and nothing else: " + x for x in "ab"]
    out = fuzzy_lines.dedup(make(spark, [(i, t, "s") for i, t in enumerate(many + two)])).collect()
    assert [x.count() for x in seen] == [42] and {r.doc_id for r in out if not r.n_removed} == {0, 40}


def test_few_removed_lines_shuffle_no_texts(spark, monkeypatch):
    rows = make(spark, [(i, f"one line that stands twice\nand number {i % 3}, which has its own words {i}", "s") for i in range(30)])
    plan = lambda: fuzzy_lines.dedup(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan() and "BroadcastHashJoin" in plan()
    monkeypatch.setattr(fuzzy_lines, "BROADCAST_BYTES", 0)
    assert sum(r.n_removed for r in fuzzy_lines.dedup(rows).collect()) >= 29


@pytest.mark.parametrize("block", [1, 40, 65_536])
def test_shingles_do_not_depend_on_blocks(monkeypatch, block):
    import pyarrow as pa

    monkeypatch.setattr(fuzzy_lines, "BLOCK", block)
    lines = ["abcdefgh", "é" * 7, "a\U0001f600b€cd", "abc", "", "x" * 90, "\U0001f600" * 6, "12345"]
    g, off = fuzzy_lines.shingle(5)(pa.array([x.encode() for x in lines]))
    assert off.tolist() == np.cumsum([0] + [max(len(x) - 4, min(1, len(x))) for x in lines]).tolist()
    for i, x in enumerate(lines):
        for j, h in enumerate(g[off[i] : off[i + 1]]):
            raw = np.frombuffer(x[j : j + 5].encode(), np.uint8)
            assert h == tokens.span_hashes(raw, np.array([0]), np.array([len(raw)]))[0]


def test_names_of_lines_follow_content():
    lines = [b"a" * n for n in range(1, 40)] + [b"a" * 8 + b"b" * 8, b"b" * 8 + b"a" * 8, b"a\0", b"a\0\0", b"b" * 5000, b"b" * 4999 + b"c"]
    off = np.cumsum([0] + [len(x) for x in lines])
    names = fuzzy_lines.line_nodes(np.frombuffer(b"".join(lines), np.uint8), off[:-1], off[1:])
    assert len(set(names.tolist())) == len(lines)
    for i, x in enumerate(lines):
        assert fuzzy_lines.line_nodes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0] == names[i]


@pytest.mark.parametrize("across", [False, True])
def test_groups_of_a_unit_equal_brute_force(across, monkeypatch):
    """Groups below, at and above FEW members: links counted and forests that connect what they connect."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    texts, group = [], []
    for i, size in enumerate([1, 2, 2, 3, 7, 8, 9, 20] * 4):
        base = rng.choice(list("abcdefghij "), int(rng.integers(3, 150)))
        for _ in range(size):
            w = base.copy()
            w[rng.integers(len(w), size=rng.integers(0, len(w) // 18 + 2))] = "z"
            texts.append("".join(w).encode())
            group.append(i)
    group, tile = np.array(group), rng.integers(2, size=len(texts))
    node = np.arange(len(texts))
    sets = [grams(t.decode()) for t in texts]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if group[i] == group[j] and similar(sets[i], sets[j])]
    new = [(i, j) for i, j in pairs if not across or tile[i] != tile[j]]
    got = near.linked(pa.array(texts, pa.binary()), node, group, tile, across, None, -1, near.Shape(fuzzy_lines.shingle(5), 21, 6), 0.8, True).to_pylist()
    assert {r["node"]: r["links"] for r in got if r["other"] is None} == Counter(x for p in new for x in p)
    want, have = Sets(node.tolist()), Sets(node.tolist())
    for i, j in pairs:
        want.join(i, j)
        if across and tile[i] == tile[j]:
            have.join(i, j)
    tree = [(r["node"], r["other"]) for r in got if r["other"] is not None]
    assert set(tree) <= set(new)
    for i, j in tree:
        have.join(i, j)
    assert [want.top(i) for i in node.tolist()] == [have.top(i) for i in node.tolist()] and 0 < len(tree) < len(new)

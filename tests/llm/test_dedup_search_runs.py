"""Circulant MinHash, ranked search and periodic runs against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortline.llm import circulant_minhash, periodic_runs, queries, ranked_search

WORDS = [f"w{i}" for i in range(300)]
SCHEMA = "doc_id long, text string, lang string, size long, node string, unit string, part string, n long, rank long"


def corpus(seed=3):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(20, 60))) for _ in range(25)]
    rows = list(enumerate(base))
    for i in range(25, 85):  # near copies of a few, some of them of each other
        w = rows[rng.choice([0, 1, 2, i - 1])][1].split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((i, " ".join(w)))
    rows += [(i, base[7]) for i in range(85, 105)]
    rows += [(105, None), (106, ""), (107, " \t\n"), (108, "one"), (109, "One"), (110, "one two"), (111, "!!!"), (112, base[3]), (112, base[3]), (112, base[4]), (113, " ".join(base) * 9),
             (114, "Straße ünïcödé ÄÖ 日本語 x"), (115, "straße ünïcödé äÖ 日本語 x"), (None, base[5]), (None, "no id"), (116, "a b " * 40), (117, "go " * 30 + "stop")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, "x", "y", "z", 2, 3) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute_sets(rows):
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
        out.append({tuple(w[i:i + 2]) for i in range(max(1, len(w) - 1))} if w else set())
    return out


def brute_components(rows, sets):
    least = [-math.inf if d is None else d for d, _ in rows]
    changed = True
    near = [[j for j in range(len(rows)) if s and 100 * len(s & sets[j]) >= 80 * len(s | sets[j])] for s in sets]
    while changed:
        changed = False
        for i in range(len(rows)):
            m = min([least[i], *(least[j] for j in near[i])])
            changed |= m < least[i]
            least[i] = m
    return [None if x == -math.inf else x for x in least]


def none_first(r):
    return tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("block", [512, 3])
def test_near_dedup(docs, rows, block):
    sets = brute_sets(rows)
    want = [(d, len(s), c, d == c) for (d, _), s, c in zip(rows, sets, brute_components(rows, sets))]
    got = [tuple(r) for r in circulant_minhash.near_dedup(docs, block=block).collect()]
    assert sorted(got, key=none_first) == sorted(want, key=none_first)


def test_near_dedup_compares_what_the_first_of_a_bucket_leaves(spark):
    """Buckets whose first class is linked with none of the others: links among these are found in blocks."""
    rng = random.Random(9)
    center = [rng.choice(WORDS) for _ in range(60)]
    rows = [(i, " ".join(center)) for i in range(3)]  # has most copies, so it is first wherever it is
    for i in range(3, 33):  # pairs of documents that are near each other and under the threshold to the center
        if i % 2:
            other = list(center)
            for _ in range(8):
                other[rng.randrange(60)] = rng.choice(WORDS)
        one = list(other)
        one[rng.randrange(60)] = rng.choice(WORDS)
        rows.append((i, " ".join(one)))
    sets = brute_sets(rows)
    want = {d: c for (d, _), c in zip(rows, brute_components(rows, sets))}
    assert len(set(want.values())) < len(want) - 8  # some pairs are linked
    for block in (512, 2):
        assert {r["doc_id"]: r["component_id"] for r in circulant_minhash.near_dedup(frame(spark, rows), block=block, bands=60, rows=2).collect()} == want


def test_near_dedup_survivors_and_empty(docs, rows, empty):
    left = circulant_minhash.survivors(docs)
    sets = brute_sets(rows)
    want = sorted((d, t) for (d, t), c in zip(rows, brute_components(rows, sets)) if d == c and d is not None and d != 112)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in left.collect() if r["doc_id"] not in (None, 112)) == want
    assert circulant_minhash.near_dedup(empty).count() == 0 and circulant_minhash.survivors(empty).count() == 0


def test_near_dedup_on_a_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = sorted(con.sql(circulant_minhash.SQL).project("doc_id, n_shingles, component_id, kept").fetchall())
    assert sorted(map(tuple, queries.op11_near_dedup(spark, d).collect())) == want and len({r[2] for r in want}) < len(rows)


def test_circulant_signatures():
    """Coordinates agree as often as sets overlap; each is the minimum of one permutation shifted; the first permutation is one."""
    c = circulant_minhash
    assert len(set(c.placed(np.arange(1 << 12, dtype=np.uint64), 1 << 12).tolist())) == 1 << 12
    rng, u = np.random.default_rng(5), 1 << 12
    s = np.unique(rng.integers(0, 2**63, 50, dtype=np.uint64))
    whole = np.concatenate([c.shifted(7, u)[:, 0]] * 2)
    assert c.signature(s, 7, u).tolist() == [int(whole[c.placed(s, u).astype(int) + k].min()) for k in range(7)]
    agree = []
    for _ in range(40):
        x = rng.integers(0, 2**63, 500, dtype=np.uint64)
        agree.append((c.signature(x[:450], 160) == c.signature(x[50:], 160)).mean())
    assert abs(np.mean(agree) - 0.8) < 0.02


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def brute_search(rows, items, top=50):
    every = [(d, Counter(re.findall(TERM, lowered(t)))) for d, t in rows]
    every = [(d, c) for d, c in every if c]
    n_docs, total = len(every), sum(sum(c.values()) for _, c in every)
    df = Counter(t for _, c in every for t in c)
    out = []
    for item, text in items:
        words = set(re.findall(TERM, lowered(text)))
        scored = []
        for d, c in every:
            n = sum(c.values())
            m = 100 - 50 + (50 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in words if t in c)
            if s > 0:
                scored.append((-s, -math.inf if d is None else d))
        out += [(item, k, None if d == -math.inf else d, -s) for k, (s, d) in enumerate(sorted(scored)[:top], 1)]
    return out


@pytest.mark.parametrize("how", [{}, {"top": 5, "block_items": 3}, {"top": 7, "shard_docs": 4}, {"top": 1, "shard_postings": 40}])
def test_ranked_search(spark, docs, rows, how):
    items = [(1, rows[0][1]), (2, "w1 w2 w2 W3"), (3, None), (4, "!?"), (5, "absent words"), (6, "Straße straße ÄÖ one x"), (7, " ".join(WORDS)), (8, "go"), (None, "a b"), (9, rows[7][1] + " go")]
    asked = spark.createDataFrame([(i, t, "clash", 1) for i, t in [*items, items[0]]], "item_id long, text string, doc_id string, score long")
    got = [tuple(r) for r in ranked_search.search(docs, asked, **how).collect()]
    assert sorted(got, key=none_first) == sorted(brute_search(rows, items, how.get("top", 50)), key=none_first)


def test_ranked_search_on_a_table(spark, docs, empty):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got = [tuple(r) for r in queries.op12_ranked_search(spark, d).collect()]
    assert sorted(got) == sorted(con.sql(ranked_search.SQL).fetchall()) and len(got) == 40 * 50
    items = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert ranked_search.search(empty, items).count() == 0 and ranked_search.search(docs, items.limit(0)).count() == 0


def test_wand_skips():
    """Documents that can't enter the heap are not scored: one strong word in a few documents, one weak word in all of them."""
    rng = np.random.default_rng(8)
    n = 4000
    strong = np.sort(rng.choice(n, 80, replace=False))
    word = np.concatenate([np.zeros(80, int), np.ones(n, int)])
    doc = np.concatenate([strong, np.arange(n)])
    gives = np.concatenate([np.full(80, 1000), rng.integers(1, 10, n)])
    heaps = ranked_search.Heaps(10, [[]])
    scored = ranked_search.wand([np.array([0, 1])], word, doc, gives, n, np.arange(n), heaps)
    both = gives[80:].copy()
    both[strong] += 1000
    want = sorted(((int(s), -i) for i, s in enumerate(both)), reverse=True)[:10]
    assert sorted(heaps.rows[0], reverse=True) == want
    assert scored < n // 4  # after ten strong documents have been met, the weak word's postings between the strong ones are skipped


def brute_runs(w):
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in out.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=70), max_size=4))
def test_runs(texts):
    s = np.array([x for t in texts for x in t], int)
    bounds = np.cumsum([0, *map(len, texts)])
    assert periodic_runs.runs_of(s, bounds) == [brute_runs(t) for t in texts]


def test_runs_long():
    rng = random.Random(4)
    for _ in range(60):  # long periods, nested ones, and the linear algorithm
        t = [rng.randrange(50) for _ in range(rng.randint(100, 900))]
        for _ in range(rng.randint(1, 5)):
            p, a = rng.randint(1, 90), rng.randrange(len(t))
            for i in range(a + p, min(len(t), a + p * rng.randint(3, 9) + rng.randint(0, p))):
                t[i] = t[i - p]
        t = t * rng.choice([1, 1, 4, 5])
        assert periodic_runs.runs_of(np.array(t), np.array([0, len(t)])) == [brute_runs(t)]
    assert periodic_runs.runs_of(np.zeros(50_000, int), np.array([0, 50_000])) == [[(0, 50_000, 1)]]
    assert periodic_runs.z_function([1, 1, 2, 1, 1, 2, 1]) == [7, 1, 0, 4, 1, 0, 1]


def brute_document(d, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(d).encode()) if d is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for a, n_, q in runs for i in range(a + q, a + n_)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (d, len(runs), *four, sha("".join(f"{a},{b},{q}\n" for a, b, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_periodic_runs(docs, rows, empty):
    got = periodic_runs.digests(periodic_runs.find(docs, edit=periodic_runs.planted)).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=none_first) == sorted((brute_document(d, t) for d, t in rows), key=none_first)
    plain = {r["doc_id"]: r for r in periodic_runs.find(docs).collect()}
    assert plain[117]["collapsed"] == "go stop" and plain[116]["collapsed"] == "a b" and [tuple(r) for r in plain[117]["runs"]] == [(0, 30, 1)] and plain[105]["collapsed"] == "" and plain[105]["best"] is None
    assert periodic_runs.find(empty).count() == 0


def test_periodic_runs_on_a_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, queries.op13_periodic_runs(spark, d).select(COLUMNS).collect()))
    assert got == sorted(brute_document(i, t) for i, t in rows) and sum(r[1] > 0 for r in got) > 5

"""Operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortline.llm import bpe, exact_dedup, jaccard_forest, langid, order_minhash, packing, pii, quality, sharding, toxicity

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, class_id string, shard string"


def corpus(seed=1):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(30, 90))) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(30, 60):  # near copies
        w = base[i % 5].split()
        w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((i, " ".join(w)))
    rows += [(i, base[7]) for i in range(60, 90)]  # a group of copies
    rows += [(90, None), (91, ""), (92, ""), (93, "one two"), (94, "one two"), (95, "!!!"), (96, base[3]), (96, base[3]), (97, " ".join(base) * 12), (98, "Straße ünïcödé 日本語 😀 x"), (None, "no id")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", "z") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, []) if False else spark.createDataFrame([], SCHEMA)


def test_dedup(docs, rows, empty):
    got = exact_dedup.exact_dedup(docs).collect()
    size = Counter(t or "" for _, t in rows)
    best = {}
    for i, t in rows:
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
    digest = {hashlib.sha256(t.encode()).hexdigest(): t for t in size}
    assert len(got) == len(rows)
    for r in got:
        t = digest[r["text_sha256"]]
        assert r["group_size"] == size[t] and r["keep_id"] == (None if best[t] < 0 else best[t])
    assert sorted(r["text_sha256"] for r in got if r["kept"]) == sorted(digest)
    left = exact_dedup.survivors(docs)
    assert left.columns == docs.columns and sorted((r["text"] or "") for r in left.collect()) == sorted(size)
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.survivors(empty).count() == 0


def test_dedup_equals_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    cols = ["doc_id", "group_size", "keep_id", "kept", "text_sha256"]
    want = sorted(con.sql(exact_dedup.SQL).project(", ".join(cols)).fetchall())
    assert sorted(tuple(r) for r in exact_dedup.exact_dedup(spark.read.parquet(f"{d}/documents.parquet")).select(*cols).collect()) == want


def brute_links(rows, threshold=0.8):
    sets = [set(jaccard_forest.shingles(t or "").tolist()) for _, t in rows]
    near = [[j for j in range(len(rows)) if j != i and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])] for i in range(len(rows))]
    comp = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in near[i]:
                comp[i] = comp[j] = min(comp[i], comp[j])
    best = {}
    for i, (d, _) in enumerate(rows):
        best[comp[i]] = max(best.get(comp[i], -1), -1 if d is None else d)
    return sorted((d if d is not None else -1, best[comp[i]], len(near[i])) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("block", [512, 8])
def test_jaccard(docs, rows, block):
    got = jaccard_forest.join(docs, block=block).collect()
    key = lambda v: -1 if v is None else v
    assert sorted((key(r["doc_id"]), key(r["class_id"]), r["n_links"]) for r in got) == brute_links(rows)


def test_jaccard_survivors(docs, rows, empty):
    left = jaccard_forest.survivors(docs)
    assert left.columns == docs.columns
    want = {c for _, c, _ in brute_links(rows)}
    assert {-1 if r["doc_id"] is None else r["doc_id"] for r in left.collect()} == want
    assert jaccard_forest.join(empty).count() == 0


def test_forest_is_shortened_until_the_target():
    j = jaccard_forest
    assert j.shallowest() == 4 and j.shallowest(recall=0.5) > j.shallowest(recall=0.999999)
    assert j.found_at(0.8, j.shallowest()) >= j.RECALL > j.found_at(0.8, j.shallowest() + 1)


def test_forest_loses_no_link_beside_a_large_group(spark):
    """A group of 2,000 near copies and twenty pairs just over the threshold: the group does not decide how far the others' prefixes are shortened."""
    rng = random.Random(12)
    center = [rng.choice(WORDS) for _ in range(120)]
    rows = []
    for i in range(2000):
        w = list(center)
        w[i % 115] = f"x{i}"
        rows.append((i, " ".join(w)))
    for i in range(20):  # 100 words, 96 shingles; two changes far from each other leave 86 in common of 106: 0.811
        w = [rng.choice(WORDS) for _ in range(100)]
        rows.append((3000 + 2 * i, " ".join(w)))
        w[30], w[60] = "changed", "twice"
        rows.append((3001 + 2 * i, " ".join(w)))
    got = {r["doc_id"]: r for r in jaccard_forest.join(frame(spark, rows)).collect()}
    assert all(got[i]["n_links"] == 1 and got[i]["class_id"] == 3001 + 2 * ((i - 3000) // 2) for i in got if i >= 3000)
    sets = [set(jaccard_forest.shingles(t).tolist()) for _, t in rows[:2000]]
    for i in range(0, 2000, 250):
        assert got[i]["n_links"] == sum(len(sets[i] & s) >= 0.8 * len(sets[i] | s) for j, s in enumerate(sets) if j != i)


def test_forest_pairs_meet_once():
    """A pair belongs to the first tree in which it shares a node; prefixes and shares of pairs are those of plain loops."""
    rng = np.random.default_rng(2)
    lab = rng.integers(0, 2, (40, 4, 5)).astype(np.uint64)
    seen = np.zeros((40, 40), int)
    at = jaccard_forest.nodes(lab, 2)
    for t in range(4):
        for v in np.unique(at[:, t]):
            i = np.flatnonzero(at[:, t] == v)
            seen[np.ix_(i, i)] += jaccard_forest.first_met(lab[i], t, 2)
    shares = (lab[:, None, :, :2] == lab[None, :, :, :2]).all(-1).any(-1)
    off = ~np.eye(40, dtype=bool)
    assert (seen[off] == shares[off]).all()


def test_jaccard_recall_on_a_table(spark):
    """Against all pairs of sf0.01: every link, and so every class."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    sets, holders = [set(jaccard_forest.shingles(t or "").tolist()) for _, t in rows], {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {(i, j) for v in holders.values() for n, i in enumerate(v) for j in v[n + 1:]}
    n = Counter()
    for i, j in pairs:
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            n[rows[i][0]] += 1
            n[rows[j][0]] += 1
    got = {r["doc_id"]: r["n_links"] for r in jaccard_forest.join(docs).collect()}
    assert sum(n.values()) > 100 and got == {i: n[i] for i, _ in rows}


def test_jaccard_survivors_keep_columns_of_any_name(spark, rows):
    named = spark.createDataFrame([(i, t, f"keep{n}", n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, at string, th long")
    left = jaccard_forest.survivors(named)
    assert left.columns == named.columns
    by = {(i, t, f"keep{n}", n) for n, (i, t) in enumerate(rows)}
    assert {tuple(r) for r in left.collect()} <= by


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(t):
    out = []
    for k, p in BASE.items():
        for m in re.finditer(p, t):
            g, d = m.group(), re.sub(r"\D", "", m.group())
            if {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in g.split(".")), "card": lambda: 14 <= len(d) <= 19 and pii.luhn(d), "phone": lambda: 10 <= len(d) <= 15}[k]():
                out.append((k, *m.span()))
    return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0])))


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="0123456789.@a-+_% ()b1", max_size=80))
def test_pii_base(t):
    assert pii.base_spans(t) == brute_pii(t)


@pytest.mark.parametrize("text,kind,span", [
    ("write john [at] example [dot] com now", "email", "john [at] example [dot] com"), ("jane dot doe at mail dot example dot org", "email", "jane dot doe at mail dot example dot org"),
    ("call plus one five five five two three four five six seven eight ok", "phone", "plus one five five five two three four five six seven eight"),
    ("４１１１ １１１１ １１１１ １１１１ x", "card", "４１１１ １１１１ １１１１ １１１１"), ("mail jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
    ("from one nine two dot one six eight dot one dot two five", "ip", "one nine two dot one six eight dot one dot two five"), ("j​ohn@exa‌mple.com", "email", "j​ohn@exa‌mple.com")])
def test_pii_disguises(text, kind, span):
    assert (kind, span) in [(k, text[a:b]) for k, a, b in pii.spans(text)[1]]
    assert span not in pii.redact(text)


def test_pii_clean_and_table(docs, rows, empty):
    for t in ("meet me at noon dot", "one two three go", "version 1.2.3", "(at) home"):
        assert pii.spans(t) == ([], [])
    got = pii.find(docs).collect()
    assert len(got) == len(rows) and {r["base_sha256"] for r in got} == {hashlib.sha256(b"").hexdigest()}
    assert pii.redacted(docs).columns == docs.columns and pii.find(empty).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab 1\n\t'.é日😀s", max_size=300), st.integers(5, 40))
def test_bpe_chunks(t, chunk):
    whole = bpe.encoding(RANKS).encode_ordinary(t)
    assert bpe.encode(t, RANKS, chunk, 4) == whole and bpe.decode(whole, RANKS) == t.encode()


def by_chunks(t, chunk, overlap):
    (row,) = pa.Table.from_pylist([{"doc_id": 1, "key": "", "text": t}]).to_batches()
    rows = [r for b in bpe.split([row], chunk, overlap) for r in b.to_pylist()]
    return bpe.stitch([bpe.encode_chunk(r["text"], r["k"], r["last"], RANKS, chunk, overlap) for r in rows], RANKS, chunk, overlap), rows


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(alphabet="ab 1\n\t'.é日😀s", min_size=1, max_size=400), st.text(alphabet="日本語、。1", min_size=1, max_size=400), st.text(alphabet="'rels \x1c\u00a0\u3000", min_size=1, max_size=300), st.text(min_size=1, max_size=200)),
       st.integers(12, 60), st.integers(5, 12))
def test_bpe_stitch(t, chunk, overlap):
    assert by_chunks(t, chunk, overlap)[0] == bpe.encoding(RANKS).encode_ordinary(t)


def test_bpe_without_spaces():
    """A text without a space is encoded chunk by chunk, a word of over an overlap only where it stands, and time is linear in the length."""
    rng = np.random.default_rng(5)
    t = "".join(chr(0x4E00 + i) if i < 3000 else "、" for i in rng.integers(0, 3300, 60_000)) + "字" * 900 + "。" + "".join(chr(0x4E00 + i) if i < 3000 else "、" for i in rng.integers(0, 3300, 20_000))
    ids, rows = by_chunks(t, 1_000, 200)
    assert ids == bpe.encoding(RANKS).encode_ordinary(t) and len(rows) == 81 and max(len(r["text"]) for r in rows) == 1_200
    met = [set(np.frombuffer(bpe.encode_chunk(a["text"], a["k"], False, RANKS, 1_000, 200)[3], "<i8")[::2]) & set(np.frombuffer(bpe.encode_chunk(b["text"], b["k"], b["last"], RANKS, 1_000, 200)[2], "<i8")[::2]) for a, b in zip(rows, rows[1:])]
    assert sum(map(bool, met)) >= 78
    took = []
    for times in (100, 400):
        (row,) = pa.Table.from_pylist([{"doc_id": 1, "key": "", "text": t * times}]).to_batches()
        begin = time.process_time()
        assert sum(b.num_rows for b in bpe.split([row], 32_768, 1_024)) == -(-len(t) * times // 32_768)
        took.append(time.process_time() - begin)
    assert took[1] < 12 * took[0] + 0.2  # 16 if it were the square


def test_bpe_table(docs, rows, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    want = sorted((-1 if i is None else i, len(e := tok.encode(t or "", add_special_tokens=False).ids), hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    for kw in ({}, {"chunk": 64, "overlap": 4}, {"chunk": 64, "overlap": 32}):
        got = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in bpe.round_trip(docs, RANKS, **kw).collect())
        assert got == want
    assert bpe.round_trip(empty, RANKS).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plan_packs_all(counts):
    got = packing.plan(counts, 64)
    placed = Counter()
    for times, lengths in got:
        assert times > 0 and sum(lengths) <= 64
        for k in lengths:
            placed[k] += times
    assert placed == Counter(counts)
    total = sum(k * n for k, n in counts.items())
    assert sum(t for t, _ in got) <= 2 * -(-total // 64) + 1


def test_best_two():
    assert packing.best_two([1, 2, 5, 9], 10, 3) == (1, 9) and packing.best_two([5], 12, 3) == (5, 5) and packing.best_two([8, 9], 10, 3) is None


def test_packing(docs, rows, empty):
    got = packing.pack(docs, RANKS).collect()
    enc, bins, want = bpe.encoding(RANKS), {}, []
    for i, t in rows:
        ids = np.array([*enc.encode_ordinary(t or ""), 2], "<u4")
        cut = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want += [(-1 if i is None else i, p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(cut, cut[1:]))]
    assert sorted((-1 if r[0] is None else r[0], *r[1:5]) for r in got) == sorted(want)
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 1024
    assert packing.pack(empty, RANKS).count() == 0


def test_order_minhash(docs, rows, empty):
    got = order_minhash.fingerprints(docs, rows_a_range=7).collect()
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -2**63), r[1] or ""))
    want = []
    for n, (i, t) in enumerate(order):
        t, nxt = t or "", order[(n + 1) % len(order)][1] or ""
        m = len(t) // 3
        e = t[:len(t) - m] + nxt[:m]
        a, b, c = map(order_minhash.fingerprint, (t, e, nxt))
        want.append((-1 if i is None else i, len(t), hashlib.sha256(e.encode()).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), order_minhash.likeness(a, b), order_minhash.likeness(a, c)))
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == sorted(want)
    assert order_minhash.fingerprints(empty).count() == 0


def test_order_minhash_minds_order():
    rng = random.Random(3)
    a = [rng.choice(WORDS) for _ in range(300)]
    close = a[:150] + ["new"] + a[150:]
    moved = a[150:] + a[:150]
    shuffled = rng.sample(a, len(a))
    f = [order_minhash.fingerprint(" ".join(x)) for x in (a, close, moved, shuffled)]
    assert order_minhash.likeness(f[0], f[1]) > 0.8 and order_minhash.likeness(f[0], f[1]) > order_minhash.likeness(f[0], f[2]) > order_minhash.likeness(f[0], f[3])


def test_sharding(spark, docs, rows, empty):
    got = sharding.shard(docs, shards=4).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((-1 if i is None else i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    many = frame(spark, [(i, " ".join(WORDS[(i * 7 + j) % 400] for j in range(20 + i % 50))) for i in range(3000)] + [(3000 + i, "a copy that fills a third") for i in range(1500)])
    out = sharding.shard(many, shards=8).toPandas()
    size = out.groupby("shard")["size"].sum()
    assert (out.groupby("text_crc32").shard.nunique() == 1).all()  # the copies have half a shard's bytes, so they stay together too, however many rows they are
    n = out[out.doc_id < 3000].groupby("shard")["size"].count()
    others = n.drop(out[out.doc_id >= 3000].shard.iloc[0])
    assert size.max() / size.min() < 1.01 and others.max() / others.min() < 1.15  # bytes are the law; rows are balanced as far as it lets them
    assert sharding.shard(empty).count() == 0


def labelled(path="/root/testdata/sf0.01"):
    import pandas as pd

    d = pd.read_parquet(f"{path}/documents.parquet").merge(pd.read_parquet(f"{path}/labels.parquet"), on="doc_id", how="left")
    d["held"] = [zlib.crc32(str(i).encode()) % 5 == 0 for i in d.doc_id]
    return d


def test_language(spark, docs, empty):
    d = labelled()
    model = langid.train(d[~d.held].text.tolist()[:400], d[~d.held].lang.tolist()[:400])
    assert np.mean([model.predict(t)[0] == v for t, v in zip(d[d.held].text, d[d.held].lang)]) > 0.98
    assert model.predict("")[0] == model.predict("12 !!")[0] == "und" and not model.predict("12")[2]
    got = langid.identify(docs, model).collect()
    assert all((r["held_out"] is True) == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert langid.accepted(docs, model).columns == docs.columns and langid.identify(empty, model).count() == 0
    assert langid.train([], []).predict("text")[0] == "und"
    assert langid.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).langs == ["de", "en", "es", "fr"]


def test_quality(docs, empty):
    d = labelled().dropna(subset=["quality"])
    model = quality.train(d[~d.held].text.tolist(), d[~d.held].quality.astype(int).tolist())
    s = model.scores(d[d.held].text.tolist())
    y = d[d.held].quality.to_numpy()
    assert ((s >= 0.3) == y).mean() > 0.9 and s[y == 1].mean() > s[y == 0].mean() + 0.4
    got = quality.score(docs, model).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got) and quality.score(empty, model).count() == 0
    assert quality.train([], []).scores(["a"])[0] == 0.5


def test_toxicity(docs, empty):
    rng = random.Random(5)
    clean = [" ".join(rng.choice(WORDS).replace("w", "wor") for _ in range(40)) for _ in range(300)]
    bad = [c.replace(c.split()[9], rng.choice(["idiot", "scumbag", "moronic"]), 1) for c in clean[:60]]
    model = toxicity.train(clean[60:] + bad, [0] * 240 + [1] * 60)
    say = lambda t: model.scores([t])[0]
    for t in ("you idiot", "i.d.i.o.t", "an i d i o t here", "idiiot", "id1ot", "scummbag", "an id iot here", "i diot", "i . d . i . o . t"):
        assert say(t) >= 0.5, t
    for t in ("", "a plain sentence about gardens", clean[100]):
        assert say(t) < 0.5, t
    got = toxicity.score(docs, model, threshold=0.5).collect()
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in got) and toxicity.score(empty, model).count() == 0
    assert toxicity.train(clean, [0] * 300).scores(["idiot"])[0] < 0.5


def test_kernel_counts_subsequences():
    def brute(s, t):
        from itertools import combinations

        total = 0.0
        for i in combinations(range(len(s)), toxicity.N):
            for j in combinations(range(len(t)), toxicity.N):
                if [s[x] for x in i] == [t[x] for x in j]:
                    total += toxicity.LAMBDA ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
        return total

    for s, t in (("cat", "cart"), ("abcab", "bacab"), ("idiot", "idxiot")):
        got = toxicity.subsequence_kernel(toxicity._codes([s], len(s)), toxicity._codes([t], len(t)))[0]
        assert abs(got - brute(s, t)) < 1e-5


def test_kernel_is_whole():
    words, marks = ["idioten", "idiot", "tidings", "ab", "gärten"], ["idiotisch", "scumbag", "garten"]
    got = toxicity.Landmarks(marks).kernel(words)
    raw = lambda s, t: float(toxicity.subsequence_kernel(toxicity._codes([s], len(s)), toxicity._codes([t], len(t)))[0])
    for i, s in enumerate(words):
        for j, t in enumerate(marks):
            want = (raw(s, t) / (raw(s, s) * raw(t, t)) ** 0.5) ** toxicity.POWER if len(s) > 2 else 0
            assert abs(got[i, j] - want) < 1e-5
    assert got[0, 0] > 0  # it covers little of the landmark


def test_toxicity_learns_every_clue():
    rng = random.Random(8)
    plain = [" ".join(rng.choice(WORDS).replace("w", "wor") for _ in range(40)) for _ in range(600)]
    insults = ["".join(rng.sample("abcdefghijklmnopqstuvxyz", 8)) for _ in range(70)]
    bad = [" ".join([*c.split()[1:], insults[i // 5]]) for i, c in enumerate(plain[:350])]
    model = toxicity.train(plain[350:] + bad, [0] * 250 + [1] * 350)
    assert (model.scores(["you " + w for w in insults]) >= 0.5).all() and (model.scores(plain[:350]) < 0.5).mean() > 0.99


@pytest.mark.parametrize("text,kind,span", [
    ("host 192 dot 168 dot 1 dot 25 up", "ip", "192 dot 168 dot 1 dot 25"), ("at one dot two dot three dot four", "ip", "one dot two dot three dot four"),
    ("127 dot zero dot zero dot one", "ip", "127 dot zero dot zero dot one"), ("plus 49 30 1 2 3 4 5 6 7", "phone", "plus 49 30 1 2 3 4 5 6 7"),
    ("x 4 one 1 one 1 one 1 one 1 one 1 one 1 one 1 one", "card", "4 one 1 one 1 one 1 one 1 one 1 one 1 one 1 one"),
    ("so anna at firma dot pl says", "email", "anna at firma dot pl"), ("anna at firma dot ai", "email", "anna at firma dot ai"), ("mail to anna at firma.museum", "email", "anna at firma.museum"),
    ("john [at] example dot com", "email", "john [at] example dot com"), ("or john@mail dot example dot studio", "email", "john@mail dot example dot studio")])
def test_pii_disguises_on_their_own(text, kind, span):
    assert (kind, span) in [(k, text[a:b]) for k, a, b in pii.spans(text)[1]]
    assert span not in pii.redact(text)


def test_pii_prose_stays():
    for t in ("look at the dot in the middle", "look at the dot product", "he is at home.now go", "stand at point dot to the left", "192 dot 168 dot 1", "one dot two"):
        assert pii.spans(t) == ([], []), t


def test_packing_reads_added_tokens(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["hi <|endoftext|> x", "<|endoftext|><|endoftext|>", "a  <|endoftext|>\n b<|endoftext|", "plain", "", "<|endoftext|>" * 1500 + " é"]
    want = []
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
        cut = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want += [(i, p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(cut, cut[1:]))]
    assert sorted(tuple(r)[:5] for r in packing.pack(frame(spark, list(enumerate(texts))), RANKS).collect()) == sorted(want)


def test_dedup_takes_columns_of_any_kind_and_name(spark, rows):
    from pyspark.sql import functions as F

    named = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, win long")
    named = named.select("*", F.create_map(F.lit("a"), F.col("win")).alias("rest"), F.array(F.create_map(F.lit("b"), F.lit(1))).alias("digest"), F.col("win").alias("by"), F.lit("x").alias("a.b"))
    left = exact_dedup.survivors(named)
    assert left.columns == named.columns and left.dtypes == named.dtypes
    assert sorted(r["text"] or "" for r in left.collect()) == sorted({t or "" for _, t in rows})
    assert all(r["rest"] == {"a": r["win"]} and r["by"] == r["win"] for r in left.collect())


def test_redaction_keeps_other_kinds_of_lengths(spark):
    for kind, want in (("string", "12"), ("double", 12.0), ("int", 12)):
        df = spark.createDataFrame([(1, "mail a@b.de x")], "doc_id long, text string").withColumn("n_chars", __import__("pyspark").sql.functions.lit("13").cast(kind))
        assert [(r["text"], r["n_chars"]) for r in pii.redacted(df).collect()] == [("mail [EMAIL] x", type(want)(14))]
    df = spark.createDataFrame([(1, "mail a@b.de x", [1])], "doc_id long, text string, n_chars array<int>")
    assert pii.redacted(df).first()["n_chars"] == [1]


def disguised(rng, kind, value):
    """A value as people hide it, one way at random."""
    spell = "zero one two three four five six seven eight nine".split()
    wide = lambda s: "".join(chr(ord(c) + 0xFEE0) if c.isdigit() else c for c in s)
    if kind == "email":
        local, domain = value.split("@")
        look = value.translate(str.maketrans("aeopc", "аеорс"))
        return rng.choice([f"{local} [at] {domain.replace('.', ' [dot] ')}", f"{local} (at) {domain}", f"{local} at {domain.replace('.', ' dot ')}", f"{local}@{domain.replace('.', ' dot ')}",
                           look, value.replace("@", "＠"), value[:2] + "\u200b" + value[2:], f"{local}{{at}}{domain.replace('.', '{dot}')}"])
    words = lambda s: " ".join(spell[int(c)] if c.isdigit() else {"+": "plus", ".": "dot"}.get(c, "") for c in s if c not in " -").strip()
    return rng.choice([words(value), wide(value), value.replace("-", "‑") if "-" in value else wide(value), value[:3] + "\u200b" + value[3:]])


def test_pii_recall_on_disguises_and_prose():
    """Made-up identifiers in disguises that the tests choose, in prose of sf0.01: nearly all found whole, and nothing found in the prose itself."""
    import pandas as pd

    rng = random.Random(12)
    prose = [t[:300] for t in pd.read_parquet("/root/testdata/sf0.01/documents.parquet").text if t and len(t) > 100]
    prose = [t for t in prose if not pii.base_spans(t)]
    assert len(prose) > 300 and not any(pii.spans(t)[1] for t in prose)
    found = Counter()
    for n in range(600):
        kind = pii.KINDS[n % 4]
        if kind == "email":
            value = "".join(rng.choice("abcdeopqrst") for _ in range(6)) + rng.choice(["", ".x1"]) + "@" + rng.choice(["mail.com", "firma.de", "news.example.org"])
        elif kind == "ip":
            value = ".".join(str(rng.randrange(256)) for _ in range(4))
        elif kind == "phone":
            value = "+" + "".join(rng.choice("123456789") for _ in range(11))
        else:
            d = "4" + "".join(rng.choice("0123456789") for _ in range(14))
            value = next(d + c for c in "0123456789" if pii.luhn(d + c))
            value = "-".join(value[i:i + 4] for i in range(0, 16, 4))
        shown = disguised(rng, kind, value)
        before, after = rng.choice(prose)[:60].rsplit(" ", 1)[0], rng.choice(prose)[:60]
        text = f"{before} {shown} {after}"
        a = len(before) + 1
        found[kind, any(k == kind and (x, y) == (a, a + len(shown)) for k, x, y in pii.spans(text)[1])] += 1
    for kind in pii.KINDS:
        assert found[kind, True] >= 0.9 * (found[kind, True] + found[kind, False]), (kind, found)


def test_shards_are_chosen_by_the_dot_product():
    rng = np.random.default_rng(6)
    demand, residual = rng.random((200, 3)) / 60, np.ones((5, 3)) - rng.random((5, 3)) / 2
    left, want = residual.tolist(), []
    for d in demand.tolist():
        dots = [sum(x * y for x, y in zip(d, r)) if r[0] >= d[0] else None for r in left]
        s = max((i for i in range(5) if dots[i] is not None), key=lambda i: (dots[i], -i), default=max(range(5), key=lambda i: (left[i][0], -i)))
        want.append(s)
        left[s] = [x - y for x, y in zip(left[s], d)]
    assert sharding.place(demand, residual.copy()).tolist() == want
    assert sharding.place(np.full((6, 3), 0.1), np.ones((3, 3))).tolist() == [0, 1, 2, 0, 1, 2]  # equal demands, equal products


def by_hand(d, at, residual, low, high, m, limit):
    """The most rows that an exchange of m groups of `low`, neighbours by size, for one of `high` can move: every window, every group."""
    half = (residual[high, 2] - residual[low, 2]) / 2
    ys = sorted((i for i in range(len(d)) if at[i] == low), key=lambda i: (d[i, 0], i))
    found = [gain for a in range(len(ys) - m + 1) for x in range(len(d)) if at[x] == high
             if abs(d[ys[a:a + m], 0].sum() - d[x, 0]) <= limit and 1e-15 < (gain := d[ys[a:a + m], 2].sum() - d[x, 2]) <= half * (1 + 1e-9)]
    return max(found, default=0)


@pytest.mark.parametrize("seed", range(8))
def test_exchanges_even_rows(seed):
    """From shards of equal bytes and rows as uneven as can be (the largest groups in one, the smallest in another) rows come to be even, bytes hardly move, sums are right; with groups of one row the first exchange moves what the best of all windows moves."""
    rng = np.random.default_rng(seed)
    size = rng.lognormal(0, 1.2, 400).round(2) + 0.05
    d = np.column_stack([size / size.sum(), size / size.sum(), np.full(400, 1 / 400)]) * 4
    order, at = np.argsort(size), np.empty(400, np.int32)
    at[order] = np.minimum(np.cumsum(size[order]) / size.sum() * 4, 3).astype(np.int32)
    residual = np.ones((4, 3)) - np.array([d[at == s].sum(0) for s in range(4)])
    low, high = int(residual[:, 2].argmin()), int(residual[:, 2].argmax())
    limit, one, left, before = sharding.DRIFT, at.copy(), residual.copy(), np.ptp(residual[:, 2])
    did = sharding.exchange(d, one, left, low, high, np.zeros(4), limit)
    m = int(((one == high) & (at == low)).sum())
    assert did and abs((left[low, 2] - residual[low, 2]) - by_hand(d, at, residual, low, high, m, limit)) < 1e-9
    bytes_before = residual[:, 0].copy()
    sharding.even_rows(d, at, residual)
    assert np.ptp(residual[:, 2]) < before / 20 and np.abs(residual[:, 0] - bytes_before).max() <= limit + 1e-12
    assert np.allclose(residual, 1 - np.array([d[at == s].sum(0) for s in range(4)]))


def test_exchanges_of_nothing():
    for d in (np.zeros((0, 3)), np.array([[0.5, 0.5, 1.0]]), np.tile([0.25, 0.25, 0.25], (4, 1))):
        at, left = np.arange(len(d), dtype=np.int32) % 2, np.ones((2, 3))
        for i, s in enumerate(at):
            left[s] -= d[i]
        want = at.copy()
        sharding.even_rows(d, at, left)
        assert (at == want).all()


def test_rows_are_even_beside_bytes(spark):
    out = sharding.shard(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), shards=8).groupBy("shard").agg({"*": "count", "size": "sum"}).toPandas()
    assert out["count(1)"].max() / out["count(1)"].min() < 1.03 and out["sum(size)"].max() / out["sum(size)"].min() < 1.01


def test_only_groups_that_fit_no_shard_are_cut(spark):
    one = lambda b, t, r: np.array([b, t, r])
    got = sharding.place_whole([(b"big", 1000, one(0.0025, 0.001, 0.001)), (b"rows", 770, one(0.0004, 0.0001, 0.001)), (b"fits", 10, one(0.05, 0.01, 0.001))], np.ones((8, 3)))
    assert len(got[b"rows"]) == len(got[b"fits"]) == 1 and len(got[b"big"]) == 20
    docs = frame(spark, [(i, " ".join(WORDS[(i * 7 + j) % 400] for j in range(60))) for i in range(400)] + [(1000 + i, "x") for i in range(300)])
    out = sharding.shard(docs, shards=4).toPandas()
    assert (out.groupby("text_crc32")["shard"].nunique() == 1).all()  # 43 % of the rows, but few bytes: one shard holds them
    size = out.groupby("shard")["size"].sum()
    assert size.max() / size.min() < 1.02


def test_ranges_of_ids_past_one_block(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "FAN", 4)
    rng = random.Random(9)
    rows = [(rng.randrange(10**12), f"text {i}") for i in range(300)] + [(7, "a"), (7, "b"), (None, "c")]
    got = {(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in order_minhash.fingerprints(frame(spark, rows), rows_a_range=5).collect()}
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -2**63), r[1]))
    want = {(i, len(t), hashlib.sha256(order_minhash.edited(t, order[(n + 1) % len(order)][1]).encode()).hexdigest()) for n, (i, t) in enumerate(order)}
    assert got == want


def test_order_minhash_agrees_with_independent_samples():
    """One hash in 64 ranges tells edited texts apart as 64 independent order samples do."""
    rng = random.Random(4)

    def independent(text):
        k, out, seen = order_minhash.K, [], Counter()
        grams = []
        for i in range(len(text) - k + 1):
            seen[text[i:i + k]] += 1
            grams.append((text[i:i + k], seen[text[i:i + k]], i))
        for j in range(order_minhash.SIZE):
            least = sorted(grams, key=lambda g: zlib.crc32(f"{j}:{g[0]}:{g[1]}".encode()) * 2654435761 % 2**32)[:order_minhash.ELL]
            out.append(tuple(g[0] for g in sorted(least, key=lambda g: g[2])))
        return out

    ours, theirs = [], []
    for edits in (0, 1, 2, 4, 8, 16, 32) * 3:
        words = [rng.choice(WORDS) for _ in range(60)]
        other = list(words)
        for _ in range(edits):
            i = rng.randrange(len(other))
            kind = rng.randrange(3)
            if kind == 0:
                other[i] = rng.choice(WORDS)
            elif kind == 1:
                other.insert(i, rng.choice(WORDS))
            else:
                other.insert(rng.randrange(len(other)), other.pop(i))
        a, b = " ".join(words), " ".join(other)
        ours.append(order_minhash.likeness(order_minhash.fingerprint(a), order_minhash.fingerprint(b)))
        theirs.append(np.mean([x == y for x, y in zip(independent(a), independent(b))]))
    assert np.corrcoef(ours, theirs)[0, 1] > 0.97 and np.abs(np.array(ours) - theirs).mean() < 0.06


def test_language_rejects_what_it_never_learned():
    """A language left out of training, letters in random order and other alphabets go; languages that were learned stay."""
    d = labelled()
    rng = np.random.default_rng(3)
    for left_out in ("de", "fr"):
        some = d[~d.held & (d.lang != left_out)]
        model = langid.train(some.text.tolist(), some.lang.tolist())
        stay, go = d[d.held & (d.lang != left_out)].text, d[(d.lang == left_out) & (d.text.str.len() > 100)].text
        assert np.mean([model.predict(t)[2] for t in stay]) >= 0.98 and np.mean([model.predict(t)[2] for t in go]) <= 0.1, left_out
    made = langid.noise(stay.tolist()[:100], rng)
    assert len(made) > 100 and np.mean([model.predict(t)[2] for t in made if len(t) > 60]) <= 0.1
    assert not model.predict("Все люди рождаются свободными и равными в своем достоинстве и правах")[2]


def test_language_takes_codes_for_no_words():
    plain, coded = langid.normal("a word and more"), langid.normal("a word 2abc3ff2ca8f and AKIA75PJ4 zq.wvx@mail3.example.com more x9")
    assert plain.tolist() == coded.tolist() and len(langid.normal("abc123")) == 5  # unless there is nothing else
    assert len(langid.normal("y" * 200_000 + "@" + "z." * 100_000)) > 200_000  # in time that grows with the text
    assert len(langid.normal("x" * 200_000 + " " + "a1" * 100_000)) == 200_002


def test_language_of_equal_texts_is_equal(spark):
    docs = spark.createDataFrame([(i, t, v) for i in range(60) for t, v in [(f"the and of {i % 7} to", "en"), ("le la et de", "fr"), (None, "fr")]] + [(None, "the and of", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    got = {}
    for r in langid.identify(docs, model).orderBy("doc_id").collect():
        got.setdefault((r["lang_pred"], r["score"]), []).append(r["doc_id"])
    assert sum(map(len, got.values())) == docs.count() and got["und", 0.0] == [i for i in range(60)]


def test_toxicity_learns_insults_of_several_words():
    """Two ordinary words that are an insult only together, and clean texts that have each of them."""
    rng = random.Random(11)
    plain = [" ".join(rng.choice(WORDS).replace("w", "wor") for _ in range(40)) for _ in range(600)]
    put = lambda c, *ws: " ".join([*c.split()[:10], *ws, *c.split()[10:]])
    bad = [put(c, "oxygen", "thief") for c in plain[:60]]
    near = [put(put(c, "oxygen"), "thief") if i % 2 else c + " oxygen and a thief" for i, c in enumerate(plain[60:160])]
    near = [t.replace("thief oxygen", "thief of oxygen") for t in near]
    model = toxicity.train(plain[160:500] + near + bad, [0] * 440 + [1] * 60)
    assert model.scores(["that oxygen thief again", plain[550] + " oxygen thief"]).min() >= 0.5
    assert model.scores(["oxygen is a gas", "a thief came", "oxygen. Thief!", plain[560], ""]).max() < 0.5


def test_windows_are_those_that_run_on():
    b = toxicity.Border(["idiot", "oxygen thief"])
    words = "the id iot oxygen thief. idi otters i diot ox idiotically id iotation".split()
    assert b.windows(words, np.array([b.sides(w, toxicity.units(w)) for w in words])) == ["id iot", "oxygen thief", "i diot"]  # the others are too long for an idiot


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abé0137@$.,!-_*'ß ", min_size=1, max_size=30))
def test_units_of_one_word(t):
    for w in t.lower().split():
        assert toxicity.units_of(w) == toxicity.units(w)


def test_margins_are_those_of_all_units():
    """Remembered words and windows give what judging every unit of every text afresh gives."""
    d = labelled().dropna(subset=["toxic"])
    model = toxicity.train(d[~d.held].text.tolist(), d[~d.held].toxic.astype(int).tolist())
    texts = d[d.held].text.tolist()[:40] + ["an id iot, a MORON. i d i o t", "", "!!! ..", "a"]
    want = []
    for t in texts:
        words = t.lower().split()
        us = [u for w in words for u in toxicity.units(w)] + toxicity.units(" ".join(words)) + model.border.windows(words, np.array([model.border.sides(w, toxicity.units(w)) for w in words], int))
        want.append(max([model.bias, *model.judge(us).tolist()]) if us else model.bias)
    assert np.allclose(model.margins(texts), want, atol=1e-5)

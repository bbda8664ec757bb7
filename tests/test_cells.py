"""Cells of the successor join and likeness in arrays, against plain Python."""

import random
from difflib import SequenceMatcher

import pyarrow as pa
import pytest

from cohortline.functions import similarity
from cohortline.operators import linkage


@pytest.mark.parametrize("threshold", [0.85, 0.5])
def test_likeness_in_arrays_is_difflibs(threshold, monkeypatch):
    """Every pair at the threshold and no other; names of one kind, which share most letters, are not given to Python one pair after the other."""
    rng = random.Random(3)
    names = ["".join(rng.choice("abcdé日😀-1 ") for _ in range(rng.randint(1, 14))) for _ in range(60)] + ["x" * 230, "x" * 210 + "y", "ab" * 40, "ab" * 39 + "cb", "", "aaaaab", "baaaaa"]
    names = sorted({*names, *(n[:2] + "z" + n[3:] for n in names)})
    want = {(x, y) for x in names for y in names if SequenceMatcher(None, x, y).ratio() >= threshold}
    assert {(names[p], names[q]) for i, j in similarity.alike(names, names, threshold) for p, q in zip(i, j)} == want
    monkeypatch.setattr(similarity, "reaches", None)
    numbered = [f"compound {rng.randint(10000, 99999)}" for _ in range(200)]
    got = sum(len(i) for i, _ in similarity.alike(numbered, numbered, threshold))
    assert got == sum(SequenceMatcher(None, x, y).ratio() >= threshold for x in numbered for y in numbered)


@pytest.mark.parametrize("threshold", [None, 0.85])
@pytest.mark.parametrize("kept", [2, 4096])
def test_a_cell_by_rows_of_bits_is_that_of_pairs(threshold, kept, monkeypatch):
    """Ids on both sides and repeated ones, missing postings, names without tokens, and more kinds than are kept."""
    monkeypatch.setattr(linkage, "KEPT", kept)
    rng = random.Random(5)
    tokens, near = ["hot bolt", "old nut", "cold nut", "compound 1234", "compound 1235", "rod"], lambda x, y: x == y or threshold is not None and SequenceMatcher(None, x, y).ratio() >= threshold

    def side(n):
        rows = []
        for _ in range(n):
            own = sorted(rng.sample(tokens, rng.randint(1, 2)))
            odd = rng.random() < 0.1
            rows.append({"id": f"N{rng.randint(0, 150)}", "day": rng.randint(0, 40), "rank": rng.randint(2, 5), "posted": None if rng.random() < 0.1 else rng.randint(0, 40),
                         "conditions": ";".join(sorted(rng.sample("uvwxyz", rng.randint(1, 3)))), "keys": " :" if odd else ";".join(own), "names": " ;" if odd else "; ".join(own).title()})
        return rows

    a, s = side(300), side(131)
    want = {}
    for i, x in enumerate(a):
        for j, y in enumerate(s):
            both = len(set(x["conditions"].split(";")) & set(y["conditions"].split(";")))
            names = bool(set(x["keys"].split(";")) & set(y["keys"].split(";"))) or any(near(p, q) for p in x["keys"].split(";") for q in y["keys"].split(";") if ":" not in p + q) or threshold is not None and near(x["names"].lower(), y["names"].lower())
            if x["id"] != y["id"] and x["day"] <= y["day"] <= x["day"] + 12 and y["rank"] > x["rank"] and (None in (x["posted"], y["posted"]) or y["posted"] >= x["posted"]) and both and names:
                want[i, j] = both
    batch = lambda rows: pa.RecordBatch.from_pylist(rows, pa.schema([(n, pa.string() if n in ("id", "conditions", "keys", "names") else pa.int32()) for n in rows[0]]))
    found = lambda first: [tuple(map(int, r)) for b in linkage._meet(batch(a), batch(s), 12, True, threshold, first) for r in zip(*b)]
    pairs = found(False)
    assert {(i, j): both for i, j, _, both in pairs} == want and len(pairs) == len(want) > 300
    firsts = {}
    for i, j in sorted(want):
        firsts.setdefault(i, [j, 0])[1] += 1
    assert {i: (j, n, both) for i, j, n, both in found(True)} == {i: (j, n, want[i, j]) for i, (j, n) in firsts.items()}

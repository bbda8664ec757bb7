"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pytest

from cohortline.plans import oracles
from cohortline.plans import queries as engine

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(rows):
    return sorted(tuple(repr(round(x, 8)) if isinstance(x, float) else repr(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_equals_sql(spark, con, name):
    df = engine.QUERIES[name](spark, DATA)
    rel = con.sql(oracles.SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    want = rel.project(", ".join(f'"{c}"' for c in cols)).fetchall()
    assert plain(tuple(r) for r in df.select(*cols).collect()) == plain(want)


def test_entry_has_every_query():
    import __spark_entry__ as e

    assert set(oracles.SQL) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def brute_fuzzy(rows):
    """Successors by the rules in plain Python, names compared by difflib."""
    from difflib import SequenceMatcher

    generic = {"placebo", "saline", "normal saline", "standard of care", "soc", "active comparator", "comparator"}
    split = lambda s: [x.strip().lower() for x in (s or "").split(";") if x.strip()]
    near = lambda x, y: SequenceMatcher(None, x, y).ratio() >= 0.85

    def alike(a, b):
        if not a or not b:
            return False
        if near(a.lower(), b.lower()):
            return True
        x, y = ([p for p in split(s) if p not in generic] or split(s) for s in (a, b))
        return any(near(p, q) for p in x for q in y)

    by_sponsor = {}
    for r in rows:
        by_sponsor.setdefault(r["lead_sponsor"], []).append(r)
    out = {}
    for a in rows:
        if not a["anchor"] or a["rank"] is None or a["end"] is None or a["lead_sponsor"] is None:
            continue
        for s in sorted(by_sponsor[a["lead_sponsor"]], key=lambda r: r["ordinal"]):
            if s["nct_id"] == a["nct_id"] or s["rank"] is None or s["rank"] <= a["rank"] or s["start"] is None or not 0 <= (s["start"] - a["end"]).days <= 36 * 30.44:
                continue
            if a["posted"] and s["posted"] and s["posted"] < a["posted"] or not set(split(a["conditions"])) & set(split(s["conditions"])) or not alike(a["intervention_names"], s["intervention_names"]):
                continue
            sim = round(SequenceMatcher(None, a["intervention_names"].lower(), s["intervention_names"].lower()).ratio(), 3)
            n, first, likeness = out.get(a["nct_id"], (0, s["nct_id"], sim))
            out[a["nct_id"]] = (n + 1, first, likeness)
    return out


def test_fuzzy_successors_by_brute_force(spark):
    from pyspark.sql import functions as F

    from cohortline.functions.scalars import phase_rank, strict_date
    from cohortline.operators import linkage
    from cohortline.plans.trial_adapter import trials

    c = F.col
    # names that are alike but not equal: some letters of the names are changed by the id
    t = trials(spark, DATA).withColumn("intervention_names", F.when(c("ordinal") % 3 == 0, F.regexp_replace("intervention_names", "a", "ax")).when(c("ordinal") % 11 == 0, F.lit("placebo")).otherwise(c("intervention_names")))
    t = t.withColumn("lead_sponsor", F.when(c("lead_sponsor").isNotNull(), F.concat(F.lit("s"), (F.crc32("lead_sponsor") % 6).cast("string")))).cache()
    a = engine.anchors(t)
    mark = a.select("nct_id", F.lit(True).alias("anchor"))
    rows = t.join(mark, "nct_id", "left").select("nct_id", "ordinal", "lead_sponsor", "conditions", "intervention_names", "anchor", phase_rank(c("phases")).alias("rank"), strict_date(c("start_date")).alias("start"),
                                                 strict_date(c("first_post_date")).alias("posted"), F.coalesce(strict_date(c("primary_completion_date")), strict_date(c("completion_date"))).alias("end")).collect()
    want = brute_fuzzy(rows)
    got = {r["nct_id"]: (r["n_successors"], r["successor_id"], r["intervention_similarity"]) for r in linkage.with_similarity(linkage.first_successor(linkage.successor_pairs(a, t))).collect()}
    assert got == want and len(want) > 50
    exact = linkage.first_successor(linkage.successor_pairs(a, t, fuzzy=False)).agg(F.sum("n_successors")).first()[0]
    assert exact < sum(n for n, _, _ in want.values())
    # the labels behind them: advanced with the first successor's id where there is one, and otherwise what they are by equal names (which SQL holds), or would be without a successor
    from cohortline.operators import labels

    fuzzy = {r["nct_id"]: r for r in labels.development(t, t).collect()}
    equal = {r["nct_id"]: r for r in labels.development(t, t, fuzzy=False).collect()}
    assert fuzzy.keys() == equal.keys()
    more = 0
    for i, r in fuzzy.items():
        assert (r["label_value"] == "advanced") == (i in want)
        if i in want:
            assert want[i][1] in r["evidence_source"] and r["label_confidence"] == "high" and r["intervention_similarity"] == want[i][2]
            more += equal[i]["label_value"] != "advanced"
        else:
            assert {k: v for k, v in r.asDict().items()} == equal[i].asDict()
    assert more > 5
    events = {r["nct_id"]: r for r in labels.with_events(labels.censor(labels.development(t, t), t, engine.reference())).collect()}
    for i, (_, first, _) in want.items():
        assert (events[i]["event_label"], events[i]["event_observed"], events[i]["evidence_nct_id"]) == ("next_phase_successor_observed", True, first)
    t.unpersist()


def test_alike_tokens_and_bounds(spark):
    """Prefixes, lengths and letters refuse no pair that reaches the threshold; letters outside ASCII and long names too."""
    import random

    from pyspark.sql import functions as F

    from cohortline.functions import similarity

    rng = random.Random(6)
    base = ["".join(rng.choice("abcdeé日😀-1 ") for _ in range(rng.randint(1, 14))).strip() or "a" for _ in range(60)] + ["aaaaaaaaaa", "placebo", "metformin hydrochloride", "x" * 230]
    names = set(base)
    for b in base:
        for _ in range(3):
            x = list(b)
            x.insert(rng.randrange(len(x) + 1), rng.choice("abé日"))
            if len(x) > 3:
                del x[rng.randrange(len(x))]
            names.add("".join(x).strip() or "b")
    names = sorted(names)
    left, right = names[::2] + names[:9], names[1::2] + names[:20]
    frame = lambda v: spark.createDataFrame([(x,) for x in v], "token string")
    for threshold in (0.85, 0.6):
        want = {(x, y) for x in left for y in right if x != y and similarity.ratio(x, y) >= threshold}
        assert {tuple(r) for r in similarity.alike_tokens(frame(left), frame(right), threshold).collect()} == want and want
    pairs = frame(left).withColumnRenamed("token", "a").crossJoin(frame(right).withColumnRenamed("token", "b"))
    may = similarity.may_reach(F.length("a"), similarity.letter_counts(F.col("a")), F.length("b"), similarity.letter_counts(F.col("b")), 0.85)
    rows = pairs.select("a", "b", may.alias("may")).collect()
    assert all(r["may"] for r in rows if similarity.ratio(r["a"], r["b"]) >= 0.85) and sum(r["may"] for r in rows) < len(rows) / 3


def test_hot_keys_are_cut(spark, monkeypatch):
    """A third of all studies share a sponsor and a condition: pairs are those of plain loops, and no cell takes more than its share."""
    import datetime
    import random

    from pyspark.sql import functions as F

    from cohortline.operators import linkage

    monkeypatch.setattr(linkage, "SMALL", 8)
    monkeypatch.setattr(linkage, "SHARES", 64)
    rng, rows = random.Random(2), []
    for i in range(900):
        start = datetime.date(2010, 1, 1) + datetime.timedelta(days=rng.randrange(1500))
        conditions = ["hot", "also"] if i % 3 == 0 else rng.sample([f"c{j}" for j in range(30)], 2)
        rows.append((f"N{i}", "big" if i % 3 == 0 else f"s{i % 7}", rng.choice(["PHASE1", "PHASE2", "PHASE3", "PHASE4"]), "; ".join(conditions), str(start), str(start + datetime.timedelta(days=200)), str(start)))
    t = spark.createDataFrame(rows, "nct_id string, lead_sponsor string, phases string, conditions string, start_date string, primary_completion_date string, first_post_date string").withColumn("completion_date", F.lit(None).cast("string"))
    day = datetime.date.fromisoformat
    want = set()
    for a in rows:
        for s in rows:
            both, gap = set(a[3].split("; ")) & set(s[3].split("; ")), (day(s[4]) - day(a[5])).days
            if a[1] == s[1] and a[2] < s[2] and both and 0 <= gap <= 1095 and s[6] >= a[6]:
                want.add((a[0], s[0], gap, len(both), 4 - len(both)))
    got = [tuple(r) for r in linkage.candidates(t, t).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 5000
    s = linkage._narrow(t, "s", F.col("start_date").cast("date")).withColumnRenamed("s_rank", "rank").withColumn("bucket", F.lit(1))
    hot = linkage._hot(s, "s").withColumn("a_parts", F.lit(1))
    cells = [r["count"] for r in linkage.dealt(s, hot, "s", "a").groupBy(*linkage.KEY, "s_part").count().collect()]
    whole = [r["count"] for r in s.groupBy(*linkage.KEY).count().collect()]
    assert hot.count() <= 64 and max(whole) > 60 and max(cells) <= 2 * s.count() / 64


def test_queries_without_sql(spark):
    ci = {r["metric"]: (r["low"], r["high"]) for r in engine.QUERIES["bootstrap_ci"](spark, DATA).collect()}
    rows = engine.scored(spark, DATA).toPandas().sort_values("score", ascending=False, kind="stable")
    score, y = rows["score"].to_numpy(), rows["y"].to_numpy()
    want = {"average_precision": [], "auroc": [], "precision_at_10pct": []}
    rng = np.random.default_rng(4)
    for _ in range(400):  # whole rows resampled, class by class
        i = np.concatenate([rng.choice(np.flatnonzero(y == v), (y == v).sum()) for v in (1, 0)])
        i = i[np.argsort(-score[i], kind="stable")]
        s, v = score[i], y[i]
        last = np.flatnonzero(np.append(s[1:] != s[:-1], True))
        tp, n = v.cumsum()[last], last + 1
        want["average_precision"].append((np.diff(tp, prepend=0) * tp / n).sum() / v.sum())
        fp = n - tp
        want["auroc"].append((np.diff(tp, prepend=0) * (fp[-1] - fp + np.diff(fp, prepend=0) / 2)).sum() / (tp[-1] * fp[-1]))
        want["precision_at_10pct"].append(v[:max(1, len(v) // 10)].mean())
    for m, est in want.items():
        low, high = np.percentile(est, [2.5, 97.5])
        assert abs(ci[m][0] - low) <= 0.25 * (high - low) and abs(ci[m][1] - high) <= 0.25 * (high - low), m
    labels = engine.QUERIES["label_table"](spark, DATA)
    assert labels.count() == 2 * engine.trials(spark, DATA).count() and labels.where("label_value = 'advanced' and notes not like '%interv_sim=%'").count() == 0
    fuzzy = {r["nct_id"]: r["n_successors"] for r in engine.QUERIES["successor_fuzzy"](spark, DATA).collect()}
    sure = {r["nct_id"]: r["n_successors"] for r in engine.QUERIES["successor_first"](spark, DATA).collect()}
    assert all(fuzzy[k] >= n for k, n in sure.items())


def test_flag_filter_tells_soft_negatives_apart():
    """The tables hold soft negatives that the filtered benchmark drops and others that it keeps, rarely used names and missing ones among them."""
    folder = DATA.replace("sf0.001", "sf0.01")
    c = duckdb.connect()
    for n in ("orders", "lineitem", "part"):
        c.sql(f"CREATE VIEW {n} AS SELECT * FROM '{folder}/{n}.parquet'")
    kept, all_of_it = (c.sql(f"SELECT count(*) FROM ({oracles.SQL[q]}) WHERE label_value = 'soft_negative'").fetchall()[0][0] for q in ("bench_broad_filtered", "bench_broad_full"))
    assert 10 < kept < all_of_it - 100

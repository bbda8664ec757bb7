import corpus_pipeline
import numpy as np

from cohortline.llm import bpe, jaccard_forest, pii
from cohortline.llm.queries import QUERIES, ranks_path

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    got, now = [], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, DATA)
        assert now.columns == docs.columns
        now = spark.createDataFrame(now.collect(), docs.schema)
        got.append({r["doc_id"]: r["text"] for r in now.collect()})
    assert got[0] == rows  # all of them are in a known language; test_language_stage_rejects has others
    last = {}
    for i, t in rows.items():
        last[t] = max(i, last.get(t, -1))
    assert set(got[1]) == set(last.values())
    sets = {i: set(jaccard_forest.shingles(t).tolist()) for i, t in got[1].items()}
    comp = {i: i for i in sets}
    for _ in range(6):
        for a in sets:
            for b in sets:
                if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = max(comp[a], comp[b])
    assert set(got[2]) == set(comp.values())
    assert got[3] == {i: pii.redact(t) for i, t in got[2].items()}
    pieces = corpus_pipeline.run(spark, DATA).toPandas()
    n = {i: len(bpe.encode(t, ranks_path())) + 1 for i, t in got[3].items()}
    assert pieces.groupby("doc_id").length.sum().to_dict() == n
    assert (pieces.groupby("sequence_id").length.sum() <= 1024).all()
    assert pieces.sequence_id.nunique() <= int(np.ceil(sum(n.values()) / 1024) * 1.05) + 1


def test_every_operator_has_a_query(spark):
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


FOREIGN = ["Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki",
           "xq zvk wpt bdgh kkzz jjq vvw hrrt pllk mmnb ccvx zzqw rtpl kjhg fdsq wqz bvvc xxzk pqrt lkjj hgff", "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である"]


def test_language_stage_rejects(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    more = spark.createDataFrame([(10_000 + i, t, None, "x", len(t)) for i, t in enumerate([*FOREIGN, "", "12 34 !!"])], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs.unionByName(more), DATA).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()}


def test_stages_take_odd_tables(spark):
    """Nulls in every column, empty texts, repeated rows and ids, names that clash with the operators' own, and a table without rows."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    base = docs.collect()[:60]
    rows = [tuple(r) for r in base] + [tuple(base[0])] * 3 + [(base[1][0], "another text of the same id " * 9, "en", None, None), (None, base[2][1], None, None, None), (None, None, None, None, None),
                                                             (9_001, "", "de", "s", 0), (9_002, base[3][1] + " tail", "en", "s", 1), (9_003, "mail jane@mail.com", None, None, None)]
    odd = spark.createDataFrame([(*r, "a", 1, {"k": 1}) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, key string, th long, win map<string,int>")
    for table in (odd, odd.limit(0)):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before = now.count()
            now = spark.createDataFrame(stage(spark, now, DATA).collect(), now.schema)
            assert now.columns == table.columns and now.count() <= before, name
        out = corpus_pipeline.sequences(spark, now, DATA)
        assert out.select("doc_id").distinct().count() == now.select("doc_id").distinct().count()
    assert all("jane@mail.com" not in (r["text"] or "") for r in now.collect())


def test_run_leaves_no_tables_of_stages_it_is_done_with(spark):
    from cohortline.llm import common

    before = len(common._stages)
    out = corpus_pipeline.run(spark, DATA)
    left = len(common._stages) - before
    assert out.count() > 0 and left <= 4  # what stage four kept, and the last one's own

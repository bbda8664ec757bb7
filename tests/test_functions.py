import pytest
from pyspark.sql import functions as F

from cohortline.functions import scalars, similarity, text_rules


def values(spark, rows, make):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[1] for r in df.select("i", make(F.col("x"))).orderBy("i").collect()]


def test_dates(spark):
    got = values(spark, ["2020-01-15", "2020-06", "March 5, 2019", "March 2019", "soon", "", None, " 2020-1-5 "], lambda c: scalars.strict_date(c).cast("string"))
    assert got == ["2020-01-15", "2020-06-01", "2019-03-05", "2019-03-01", None, None, None, "2020-01-05"]
    assert values(spark, ["2020-01-15", "2020-06"], lambda c: scalars.column_date(c, "2020-01-15").cast("string")) == ["2020-01-15", None]
    assert values(spark, ["2020-06", "2020-01-15"], lambda c: scalars.column_date(c, "2020-06").cast("string")) == ["2020-06-01", None]


def test_phase_rank(spark):
    assert values(spark, ["PHASE2", "Phase 1/Phase 2", "PHASE2; PHASE3", "EARLY_PHASE1", "NA", None, "Phase 4"], scalars.phase_rank) == [3, 3, 5, 0, None, None, 6]


def test_status(spark):
    got = values(spark, ["Completed", "COMPLETED", "Active, not recruiting", "weird", None, "Temporarily_not_available"], scalars.operational_label)
    assert got == ["completed", "completed", "active_not_recruiting", "unknown", "unknown", "suspended"]


def test_ages(spark):
    got = values(spark, ["18 Years", "6 Months", "N/A", None, "2 weeks"], scalars.age_years)
    assert got[0] == 18 and abs(got[1] - 0.5) < 1e-9 and got[2] is None and got[3] is None and abs(got[4] - 2 / 52) < 1e-9


def test_clean_text(spark):
    assert values(spark, ["<p>Hello <b>world</b></p>", "a bb ccc", None, "x yy zz"], scalars.clean_text) == ["hello world", "bb ccc", "", "yy zz"]


def test_counts_and_flags(spark):
    assert values(spark, ["a; b", "", None, "a"], scalars.count_delimited) == [2, 0, 0, 1]
    assert values(spark, ["1", "0", None, "x"], scalars.boolean_flag) == [1, 0, 0, 0]
    assert values(spark, ["successor=NCT12345678, x", "none", None], scalars.registry_id) == ["NCT12345678", None, None]


@pytest.mark.parametrize("text,want", [
    ("Primary endpoint met", True), ("Clinically meaningful benefit seen", True), ("Study objective achieved early", True), ("superiority demonstrated at interim", True),
    ("No clinically meaningful benefit", False), ("Primary endpoint not met", False), ("futility; efficacy observed", False), ("Lack of efficacy", False), (None, False),
    ("failed to show efficacy observed", False), ("Not clinically meaningful benefit", False), ("results were not efficacy confirmed", False), ("futilities; efficacy observed", True),
    ("  Study objective\treached ", True)])
def test_positive_stop(spark, text, want):
    assert values(spark, [text], text_rules.positive_terminal) == [want]


def test_terminal_negative(spark):
    rows = [("TERMINATED", "Lack of efficacy"), ("WITHDRAWN", " enrollment "), ("TERMINATED", "Sponsor decision"), ("TERMINATED", None), ("WITHDRAWN", " ")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, w string")
    got = [tuple(r["x"]) for r in df.select("i", text_rules.terminal_negative(F.col("s"), F.col("w")).alias("x")).orderBy("i").collect()]
    assert [g[0] for g in got] == ["hard_negative", "hard_negative", "ambiguous_negative", "ambiguous_negative", "ambiguous_negative"]
    assert got[3][2] == "terminated_no_reason" and got[4][2] == "withdrawn_no_reason"


def test_titles(spark):
    got = values(spark, ["PK/PD of X", "Bioavailability of X", "Long-Term Safety Extension", "A new Formulation", "Efficacy of X", None], text_rules.title_exclusion)
    assert got == [f"nonprogression_design_{x}" for x in ("pk_pd", "bioavailability", "extension", "formulation")] + [None, None]


def test_titles_nearly(spark):
    hit = ["Openlabel extension", "Longterm safety", "Absorption,distribution", "Proof of concept, Phase 1", "PK / PD", "Biomarkerexpression"]
    miss = ["nonbioavailability", "proof of concept in phase 10", "rollovers", "Plaque tests", "SPK", "formulations"]
    got = values(spark, hit + miss, text_rules.title_exclusion)
    assert all(got[:len(hit)]) and not any(got[len(hit):])


@pytest.mark.parametrize("flag,hit,miss", [
    ("lifecycle_flag", ["add on therapy", "addon to insulin", "Neonates", "children", "switching from"], ["Schoolchildren", "Pediatrics", "overdose adjustment", "additional doses"]),
    ("broad_basket_flag", ["refractory tumours", "basket trial", "cancers that are"], ["neoplastic", "platforms study"]),
    ("supportive_flag", ["peri operative", "anti nausea", "antinausea", "post-dental extraction", "hemostatis", "Haemostatic"], ["hemostatics", "antiemetics", "prophylaxis in"])])
def test_flags_nearly(spark, flag, hit, miss):
    got = values(spark, hit + miss, lambda c: text_rules.diagnostic_flags(c, F.lit(""))[flag])
    assert got == [True] * len(hit) + [False] * len(miss)


def test_flags(spark):
    assert values(spark, ["Pediatric study", "Maintenance therapy", "adults"], lambda c: text_rules.diagnostic_flags(c, F.lit(""))["lifecycle_flag"]) == [True, True, False]
    assert values(spark, ["Solid Tumors", "Neoplasms"], lambda c: text_rules.diagnostic_flags(F.lit(""), c)["broad_basket_flag"]) == [True, True]


def test_similarity():
    assert similarity.ratio("tide", "diet") == 0.25 and similarity.ratio("diet", "tide") == 0.5
    assert similarity.matches("Drug A; placebo", "placebo; drug a", 0.85)
    assert not similarity.matches("placebo; DrugAlpha", "placebo; Compound", 0.85)
    assert similarity.matches("placebo", "placebo", 0.85) and not similarity.matches("", "x", 0.85)

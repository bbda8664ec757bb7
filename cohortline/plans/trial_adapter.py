"""Studies made from the star-schema tables, the same way in Spark and in SQL: every rule of the engine is met, nulls and partial dates too."""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.sources.storage import size_of, staged

#: The date at which follow-up ends; fixed, so that results are.
REFERENCE = "2004-01-01"
TRAIN_END, VAL_END = "1998-12-31", "2000-04-30"

#: Reasons and titles that meet each pattern of the rules, and others that nearly do.
REASONS = [
    'Clinically  meaningful response seen', 'Study objective reached', 'efficacy confirmed', 'Benefit demonstrated in both arms', 'Primary objective achieved', 'positive interim analysis', 'Superiority shown', 'It met its primary endpoint',
    'No clinically meaningful benefit', 'Not clinically meaningful benefit', 'Results were not efficacy confirmed', 'Lack of benefit demonstrated', 'insufficient efficacy observed', 'Failed to show efficacy established', 'Did not achieve study goal met', 'stopped without efficacy achieved', 'Absence of superiority demonstrated', 'Low probability to show efficacy observed', 'Unlikely to demonstrate efficacy confirmed',
    'Futility; efficacy observed', 'futile, benefit demonstrated', 'Primary objective met but did not meet others', 'primary endpoint was not met', 'Study goal not reached; superiority shown', 'futilities and efficacy observed', 'It is not a matter of quality and of the many reasons given elsewhere; efficacy observed',
    'Lack of efficacy', 'Safety concerns', 'hepatic toxicity', 'Adverse events', 'DLT in two patients', 'dose-limiting findings', 'dose limiting findings', 'no clinical benefit', 'no benefit', 'failed to meet its aim', 'negative outcome', 'Recruitment failure', 'Low accrual', 'low recruitment', 'no enrollment', 'unable to enroll', ' Enrollment ', 'slow enrollment', 'enrollments', 'Program discontinued', 'Funding lost', 'funding was lost', 'Sponsor dissolved', 'the company closed',
    'Sponsor decision', 'Business reasons', '  Sponsor decision  ', 'primary endpoints met', 'study goals achieved', 'clinically meaningful change', 'efficacious', 'benefit was demonstrated', 'positive results', 'superior', 'Notable study goal met', 'Unlikely', 'unclear benefit', 'negatively affected', 'programme terminated', 'low numbers',
    None,
]
TITLES = [
    'Pharmacokinetics of a compound', 'Nonpharmacokinetic study', 'PK of a drug', 'SPK of a drug', 'PK/PD of a drug', 'PK / PD of a drug', 'Pharmacodynamics in adults', 'Absorption, distribution and more', 'Absorption,distribution and more', 'Absorption and distribution', 'Drug-drug interaction', 'drug drug interactions', 'DDI study', 'DDIs', 'Mass balance', 'Mass balances',
    'Bioavailability of a tablet', 'nonbioavailability', 'Bioequivalence in volunteers', 'Food effect', 'food effects', 'Relative bioavail', 'A new formulation', 'Formulations', 'Tablet vs. capsule', 'Tablet vs capsule', 'tablet vs', 'Oral solution vs tablet', 'Oral suspension vs', 'Therapeutic equivalence',
    'Extension study', 'extension studies', 'Open-label extension of a trial', 'Openlabel extension', 'Open label extension', 'Long-term safety', 'Longterm follow up', 'Long term benefit', 'Rollover', 'rollovers', 'Continuation study', 'Extended-access', 'extendedaccess', 'Compassionate use', 'Expanded access',
    'Plaque test', 'Plaque tests', 'Acute haemodynamic effects', 'Acute hemodynamic effects', 'acute hemodynamics', 'Biomarker expression', 'biomarkerexpression', 'Proof of concept in phase 1', 'Proofofconcept, then Phase1', 'proof of concept in phase 10', 'Proof of concept', 'Challenge study',
    'Pediatric asthma', 'Pediatrics', 'Adolescent health', 'Children with asthma', 'Schoolchildren', 'Neonates', 'Preneonatal', 'Age expansion', 'Dose comparison', 'Dose adjustment', 'overdose adjustment', 'Additional dose', 'additional doses', 'Dose sequencing', 'Maintenance therapy', 'maintenance', 'Substitution trial', 'Add-on to insulin', 'add on therapy', 'addon to therapy', 'Adjunct to care', 'Adjunctive therapy', 'adjuncts to', 'Virologically suppressed', 'Switching from a drug', 'Switch study', 'switched to',
    'Advanced solid tumors', 'Advanced tumours', 'Solid tumor', 'Multiple tumour types', 'Basket trial', 'Platform study', 'platforms study', 'Cancers that have spread', 'Cancer that is', 'Various cancers', 'Neoplasm of the skin', 'neoplastic', 'Refractory tumors', 'refractory disease',
    'Post-dental extraction', 'post tooth extraction', 'posttooth extraction', 'Perioperative care', 'peri operative care', 'Intra-operative care', 'During surgery', 'during the surgery', 'Haemostatic', 'haemostatis', 'hemostatis', 'hemostatics', 'Symptomatic relief', 'Pain after surgery', 'Pain following procedure', 'pain before surgery', 'Antiemetic', 'antiemetics', 'anti nausea', 'antinausea', 'Anti-nausea', 'Prophylaxis of stroke', 'prophylaxis in stroke',
    'Efficacy of a compound', 'Safety of a compound', 'A study in adults', 'Response to treatment',
    None,
]
PICKED = {"REASONS": REASONS, "TITLES": TITLES}

#: One expression a column, over orders (o_*) and the order's lines (conditions, names, ship); both engines read them.
COLUMNS = {
    "nct_id": "concat('NCT', lpad(cast(k AS {s}), 8, '0'))",
    "ordinal": "k",
    "lead_sponsor": "CASE WHEN k % 41 = 0 THEN NULL ELSE concat('sponsor_', cast(o_custkey % 40 AS {s})) END",
    "lead_sponsor_class": "CASE WHEN k % 43 = 0 THEN NULL WHEN k % 5 = 0 THEN 'OTHER' ELSE 'INDUSTRY' END",
    "phases": "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'PHASE3' WHEN '2' THEN 'PHASE2' WHEN '3' THEN 'PHASE2' WHEN '4' THEN 'PHASE1; PHASE2' ELSE 'PHASE1' END",
    "overall_status": "CASE WHEN o_orderstatus = 'F' THEN 'COMPLETED' WHEN o_orderstatus = 'P' THEN 'TERMINATED' WHEN k % 5 = 0 THEN 'ACTIVE_NOT_RECRUITING' WHEN k % 19 = 0 THEN 'SUSPENDED' ELSE 'WITHDRAWN' END",
    "why_stopped": "CASE WHEN o_orderstatus = 'F' AND k % 7 > 0 THEN NULL ELSE {pick:REASONS} END",
    "study_type": "CASE WHEN k % 29 = 0 THEN NULL WHEN k % 11 = 0 THEN 'OBSERVATIONAL' ELSE 'INTERVENTIONAL' END",
    "intervention_types": "CASE WHEN k % 31 = 0 THEN NULL WHEN k % 4 = 0 THEN 'DRUG' WHEN k % 4 = 1 THEN 'BIOLOGICAL; DRUG' WHEN k % 4 = 2 THEN 'DEVICE' ELSE 'DIETARY_SUPPLEMENT; DEVICE' END",
    "brief_title": "CASE WHEN k % 5 < 2 THEN concat('Efficacy of compound ', cast(k % 100 AS {s})) ELSE {pick:TITLES} END",
    "primary_purpose": "CASE WHEN k % 7 = 0 THEN 'PREVENTION' WHEN k % 7 = 1 THEN '' WHEN k % 7 = 2 THEN NULL ELSE 'TREATMENT' END",
    "conditions": "conditions",
    "intervention_names": "CASE WHEN k % 35 = 3 THEN NULL WHEN k % 7 = 3 THEN concat('compound ', cast(cast(floor(k / 100.0) AS bigint) AS {s})) ELSE names END",
    "enrollment": "CASE WHEN k % 13 = 0 THEN NULL ELSE k % 500 END",
    "has_results": "k % 3 = 0",
    "start_date": "CASE WHEN k % 53 = 0 THEN NULL WHEN k % 37 = 0 THEN substr({d:o_orderdate}, 1, 7) ELSE {d:o_orderdate} END",
    "first_post_date": "CASE WHEN k % 47 = 0 THEN NULL ELSE {d:o_orderdate:-30} END",
    "primary_completion_date": "CASE WHEN k % 59 = 0 THEN NULL ELSE {d:ship} END",
    "completion_date": "{d:ship:10}",
    "last_update_post_date": "CASE WHEN k % 17 = 0 THEN '' ELSE {d:ship:20} END",
    "status_verified_date": "CASE WHEN k % 3 = 0 THEN NULL WHEN k % 3 = 1 THEN '' ELSE substr({d:ship}, 1, 7) END",
    "minimum_age": "CASE k % 4 WHEN 0 THEN '18 Years' WHEN 1 THEN '6 Months' WHEN 2 THEN 'N/A' ELSE NULL END",
    "maximum_age": "CASE k % 3 WHEN 0 THEN '65 Years' WHEN 1 THEN NULL ELSE '90 Days' END",
    "sex": "CASE k % 4 WHEN 0 THEN 'ALL' WHEN 1 THEN 'FEMALE' WHEN 2 THEN 'MALE' ELSE NULL END",
    "has_dmc": "CASE WHEN k % 4 = 3 THEN NULL ELSE k % 2 = 0 END",
    "n_arms": "k % 5",
    "n_locations": "k % 23",
    "n_collaborators": "k % 3",
    "countries": "CASE k % 4 WHEN 0 THEN 'France; Germany; Spain' WHEN 1 THEN 'Germany' WHEN 2 THEN '' ELSE NULL END",
    "eligibility_criteria": "CASE WHEN k % 9 = 0 THEN NULL ELSE concat('<p>Adults  with</p> ', conditions) END",
}


def _text(e: str, spark: bool) -> str:
    def day(m):
        col, shift = m[1], int(m[2] or 0)
        if spark:
            return f"date_format(date_add(cast({col} AS date), {shift}), 'yyyy-MM-dd')"
        return f"strftime(cast({col} AS date) + {shift}, '%Y-%m-%d')"

    def pick(m):
        values = PICKED[m[1]]
        row = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
        at = f"cast(k % {len(values)} AS int) + 1"
        return f"element_at(array({row}), {at})" if spark else f"list_extract([{row}], {at})"

    e = re.sub(r"\{d:(\w+)(?::(-?\d+))?\}", day, e).replace("{s}", "string" if spark else "varchar")
    return re.sub(r"\{pick:(\w+)\}", pick, e)


#: Bytes of a table's files that a stage takes at once, and in how many slices at most: a slice of the studies reads the key, part and day of all lines, and shuffles only its own.
SLICE_BYTES, SLICES = 64 << 20, 6


def slices(rows: DataFrame) -> int:
    return min(SLICES, 1 + size_of(rows) // SLICE_BYTES)


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The studies as a staged table, as they come from the flattening of records: every query scans what it needs of it."""
    tables = [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("orders", "lineitem", "part")]
    return staged(spark, ("trials", sf_dir), lambda: [view(spark, sf_dir, i, n) for n in [slices(tables[1])] for i in range(n)], *tables)


def view(spark: SparkSession, sf_dir: str, i: int = 0, n: int = 1) -> DataFrame:
    """The studies of one of n slices of the orders, by a hash of their keys."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    own = lambda rows, key: rows.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) if n > 1 else rows
    words = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "; ")
    # an order has few lines: shuffled as they are they are smaller than sets begun beside their parts
    lines = own(read("lineitem"), "l_orderkey").join(read("part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_type", "p_name", "l_shipdate").repartition("l_orderkey").groupBy("l_orderkey").agg(
        words("p_type").alias("conditions"), words("p_name").alias("names"), F.max("l_shipdate").alias("ship"))
    orders = own(read("orders"), "o_orderkey").withColumn("k", F.col("o_orderkey"))
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(*[F.expr(_text(e, True)).alias(n) for n, e in COLUMNS.items()])


SQL = ("l AS (SELECT l_orderkey, string_agg(DISTINCT p_type, '; ' ORDER BY p_type) AS conditions, string_agg(DISTINCT p_name, '; ' ORDER BY p_name) AS names, max(l_shipdate) AS ship"
       " FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),\ntrials AS (SELECT "
       + ", ".join(f"{_text(e, False)} AS {n}" for n, e in COLUMNS.items()) + " FROM (SELECT *, o_orderkey AS k FROM orders) JOIN l ON o_orderkey = l_orderkey)")

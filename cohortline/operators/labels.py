"""Outcome labels: operational status, eligibility, the decision list, censoring, events and their audit."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.functions import text_rules
from cohortline.functions.scalars import followup_months, lower_tokens, operational_confidence, operational_label, registry_id, shown, stripped, text
from cohortline.operators import linkage

TASK_OF_TYPE = {"development": "phase2_to_phase3_v1", "operational": "operational_status_v1"}
EVENT_VERSION = "event_labels_v1"
EVENT_COLUMNS = ["event_label", "event_category", "event_detail", "event_observed", "event_date", "evidence_nct_id", "event_rule_version"]
LEGACY_COLUMNS = ["nct_id", "label_type", "label_task", "label_value", "label_date", "label_confidence", "evidence_source", "notes"]
#: Event label, category and whether the event was observed, by label value (fixed values).
EVENTS = {
    "advanced": ("next_phase_successor_observed", "positive_event", True),
    "hard_negative": ("terminal_negative_event_observed", "negative_event", True),
    "ambiguous_negative": ("terminal_event_unclear_reason", "ambiguous_terminal_event", True),
    "soft_negative": ("no_successor_observed_after_horizon", "no_event_after_horizon", False),
    "censored_recent": ("insufficient_followup_for_horizon", "censored", None),
    "censored_in_progress": ("still_in_progress_at_censor_date", "censored", None),
    "censored_early_negative": ("terminal_negative_below_horizon", "censored_negative_signal", True),
    "excluded_positive_terminal": ("terminal_positive_signal_without_successor", "excluded_special_case", True),
}
FLAGS = ["lifecycle_flag", "broad_basket_flag", "supportive_flag", "common_asset_flag"]


def operational(cohort: DataFrame, today: Column | None = None) -> DataFrame:
    """One row per study; the date falls through empty values to today's."""
    c = F.col
    label = operational_label(c("overall_status"))
    today = F.current_date().cast("string") if today is None else today
    blank = lambda name: F.nullif(c(name), F.lit("")) if name in cohort.columns else F.lit(None).cast("string")
    return cohort.select(
        "nct_id", F.lit("operational").alias("label_type"), F.lit(TASK_OF_TYPE["operational"]).alias("label_task"), label.alias("label_value"),
        F.coalesce(blank("status_verified_date"), blank("last_update_post_date"), today).alias("label_date"),
        operational_confidence(label).alias("label_confidence"),
        F.concat(F.lit("overall_status='"), shown(c("overall_status")), F.lit("'")).alias("evidence_source"),
        F.concat(F.lit("why_stopped: "), c("why_stopped")).alias("notes"))


def eligibility(cohort: DataFrame) -> DataFrame:
    """nct_id, eligible, exclusion_reason, status_category."""
    return cohort.select("nct_id", *[v.alias(k) for k, v in eligible().items()])


def eligible() -> dict[str, Column]:
    """Whether a study is eligible, why not, and the category of its status: from its own row."""
    up = lambda name: F.upper(F.trim(text(F.col(name))))
    phases, purpose, status = up("phases"), up("primary_purpose"), up("overall_status")
    rest = F.regexp_replace(phases, "^(.*?)PHASE2", "$1")
    title = text_rules.title_exclusion(F.col("brief_title"))
    reason = (F.when((phases != "PHASE2") & phases.contains("PHASE2") & rest.contains("PHASE"), "excluded_mixed_phase").when(phases != "PHASE2", "excluded_wrong_phase")
              .when(purpose.isin(text_rules.NON_TREATMENT), "excluded_non_treatment_purpose").when(title.isNotNull(), F.concat(F.lit("excluded_"), title)))
    category = (F.when(status.isin("COMPLETED", "TERMINATED", "WITHDRAWN"), "terminal")
                .when(status.isin("ACTIVE_NOT_RECRUITING", "RECRUITING", "NOT_YET_RECRUITING", "ENROLLING_BY_INVITATION"), "in_progress")
                .when(status == "SUSPENDED", "conditional").otherwise("other"))
    return {"eligible": reason.isNull(), "exclusion_reason": reason, "status_category": category}


def intervention_counts(studies: DataFrame) -> DataFrame:
    """How many studies each intervention name is in."""
    return studies.select(F.explode(F.array_distinct(lower_tokens(F.col("intervention_names")))).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


#: A name in over one of so many (study, name) rows is frequent: there are at most as many such names, whatever the size of the data.
SHARES = 1024


def with_common_asset(cohort: DataFrame, studies: DataFrame, least: int = text_rules.COMMON_ASSET, counts: DataFrame | None = None) -> DataFrame:
    """The rows with `common_asset_flag`: whether an intervention of theirs is in at least `least` studies. `counts`: `intervention_counts` of these, if a stage before has made them.

    The frequent ones of these names (at most SHARES) go to every row, which settles most rows where they lie. Only what is left is shuffled by its names, and of those none is in many rows."""
    c, flag = F.col, "common_asset_flag"
    counts = intervention_counts(studies) if counts is None else counts
    bound = counts.agg((F.sum("n") / F.lit(SHARES)).alias("bound"))
    frequent = counts.join(F.broadcast(bound), c("n") > c("bound")).where(c("n") >= least).agg(F.collect_list("name").alias("frequent"))
    rows = cohort.crossJoin(F.broadcast(frequent)).withColumn(flag, F.arrays_overlap(F.array_distinct(lower_tokens(c("intervention_names"))), c("frequent"))).drop("frequent")
    left = rows.where(~c(flag)).drop(flag)
    names = left.select("nct_id", F.explode(F.array_distinct(lower_tokens(c("intervention_names")))).alias("name"))
    found = names.join(counts.where(c("n") >= least), "name", "left_semi").select("nct_id").distinct().withColumn(flag, F.lit(True))
    return rows.where(flag).unionByName(left.join(found, "nct_id", "left").withColumn(flag, F.coalesce(c(flag), F.lit(False))))


#: The columns of anchors that development labels read, besides those of the linkage.
ANCHOR_COLUMNS = ["overall_status", "why_stopped", "brief_title"]


def development(cohort: DataFrame, studies: DataFrame, window_months: int = linkage.WINDOW_MONTHS, threshold: float = linkage.THRESHOLD, fuzzy: bool = True, anchors: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """The decision list: ineligible, in progress, positive stop, successor, stopped, otherwise soft negative with flags. `anchors`: the rows of the cohort that may have successors
    (READ of the linkage and ANCHOR_COLUMNS), `counts`: how many studies each name is in, if stages before have made them. All other rows are settled by themselves and meet no join."""
    c = F.col
    state = cohort.withColumns(eligible())
    may_follow = c("eligible") & (c("status_category") != "in_progress") & ~text_rules.positive_terminal(c("why_stopped"))
    if anchors is None:
        anchors = state.where(may_follow).select(*linkage.READ, *ANCHOR_COLUMNS)
    stopped = F.upper(text(c("overall_status"))).isin("TERMINATED", "WITHDRAWN")
    # what is asked of titles and conditions is asked before the join of successors, which then shuffles neither
    own = ["nct_id", "overall_status", "why_stopped"]
    flags = [v.alias(k) for k, v in text_rules.diagnostic_flags(c("brief_title"), c("conditions")).items()]
    soft = with_common_asset(anchors.where(~stopped).select(*own, "intervention_names", "brief_title", "conditions"), studies, counts=counts).select(*own, "common_asset_flag", *flags)
    following = soft.unionByName(anchors.where(stopped).select(*own), allowMissingColumns=True)
    first = linkage.with_similarity(linkage.first_of(anchors, studies, window_months, threshold, fuzzy))
    value = F.when(c("successor_id").isNotNull(), "advanced").when(stopped, "stopped").otherwise("soft")
    following = following.join(first, "nct_id", "left").withColumn("branch", value)
    settled = F.when(~c("eligible"), "ineligible").when(c("status_category") == "in_progress", "in_progress").otherwise("positive")
    rows = following.unionByName(state.where(~may_follow).select(*own, "exclusion_reason", settled.alias("branch")), allowMissingColumns=True)
    rows = rows.withColumn("neg", text_rules.terminal_negative(c("overall_status"), c("why_stopped")))
    rows = rows.withColumns({k: F.when(c("branch") == "soft", c(k)) for k in FLAGS})
    b = c("branch")
    shown_flags = F.array_join(F.filter(F.array(*[F.when(c(k), k) for k in FLAGS]), lambda x: x.isNotNull()), ", ")
    return rows.select(
        "nct_id", F.lit("development").alias("label_type"), F.lit(TASK_OF_TYPE["development"]).alias("label_task"),
        F.when(b == "ineligible", c("exclusion_reason")).when(b == "in_progress", "censored_in_progress").when(b == "positive", "excluded_positive_terminal")
        .when(b == "advanced", "advanced").when(b == "stopped", c("neg.value")).otherwise("soft_negative").alias("label_value"),
        F.when(b == "advanced", c("s_start_text")).alias("label_date"),
        F.when(b == "ineligible", "n/a").when(b == "in_progress", "low").when(b == "positive", "medium").when(b == "advanced", "high")
        .when(b == "stopped", c("neg.confidence")).otherwise("medium").alias("label_confidence"),
        F.when(b == "ineligible", "dev_eligibility_filter").when(b == "in_progress", F.concat(F.lit("status="), shown(c("overall_status"))))
        .when(b == "positive", F.concat(F.lit("positive_stop: "), F.substring(stripped(c("why_stopped")), 1, 100)))
        .when(b == "advanced", F.concat(F.lit("successor="), c("successor_id"), F.lit(", phase="), c("successor_phase"), F.lit(", sponsor="), c("successor_sponsor")))
        .when(b == "stopped", c("neg.evidence")).otherwise("no successor trial found").alias("evidence_source"),
        F.when(b == "ineligible", F.lit(None)).when(b == "in_progress", "Ongoing trial, not yet terminal").when(b == "positive", "Terminated with positive outcome — neither positive nor negative for modeling")
        .when(b == "advanced", F.concat(c("n_successors").cast("string"), F.lit(" successor(s) found; gap="), c("temporal_gap_months").cast("string"), F.lit("mo, cond_overlap="), c("condition_overlap").cast("string"), F.lit(", interv_sim="), c("intervention_similarity").cast("string")))
        .when(b == "stopped", F.concat(F.lit("why_stopped: "), shown(c("why_stopped")))).otherwise(F.concat(F.lit("diagnostic_flags: "), F.when(shown_flags == "", "none").otherwise(shown_flags))).alias("notes"),
        *[F.when(b == "advanced", c(k)).alias(k) for k in ("successor_phase", "temporal_gap_months", "condition_overlap", "intervention_similarity")], *FLAGS)


def development_slices(cohort: DataFrame, studies: DataFrame, n: int, anchors: DataFrame, counts: DataFrame, **how) -> list[DataFrame]:
    """`development` of n slices of the sponsors: no pair goes from one to another, so a slice shuffles only its own rows. Names are counted over all studies."""
    own = lambda rows, i: rows.where(F.pmod(F.xxhash64("lead_sponsor"), F.lit(n)) == i) if n > 1 else rows
    return [development(own(cohort, i), own(studies, i), anchors=own(anchors, i), counts=counts, **how) for i in range(n)]


def censor(labels: DataFrame, cohort: DataFrame, reference: Column, least: int = 36) -> DataFrame:
    """Short follow-up: soft and ambiguous negatives become censored_recent, hard ones censored_early_negative."""
    c = F.col
    months = followup_months(c("primary_completion_date"), c("completion_date"), c("last_update_post_date"), reference)
    rows = labels.join(cohort.select("nct_id", months.alias("followup_months")), "nct_id", "left")
    short = c("followup_months").isNull() | (c("followup_months") < least)
    soft = c("label_value").isin("soft_negative", "ambiguous_negative") & short
    hard = (c("label_value") == "hard_negative") & short
    m = shown(c("followup_months"), "nan")
    return rows.withColumns({
        "label_value": F.when(soft, "censored_recent").when(hard, "censored_early_negative").otherwise(c("label_value")),
        "label_confidence": F.when(soft, "low").when(hard, "medium").otherwise(c("label_confidence")),
        "notes": F.when(soft, F.concat(F.lit("censored_recent: followup="), m, F.lit(f"mo < {least}mo")))
        .when(hard, F.concat(F.lit("early_negative_signal: followup="), m, F.lit(f"mo < {least}mo but negative evidence present"))).otherwise(c("notes")),
    })


def censor_legacy(labels: DataFrame, cohort: DataFrame, reference: Column, least: int = 36) -> DataFrame:
    """The older rule: did_not_advance with short follow-up becomes censored."""
    c = F.col
    months = followup_months(c("primary_completion_date"), c("completion_date"), c("last_update_post_date"), reference)
    rows = labels.join(cohort.select("nct_id", months.alias("followup_months")), "nct_id", "left")
    hit = (c("label_value") == "did_not_advance") & (c("followup_months").isNull() | (c("followup_months") < least))
    note = F.concat(F.lit("Censored: followup="), shown(c("followup_months"), "nan"), F.lit(f"mo < required {least}mo"))
    return rows.withColumns({"label_value": F.when(hit, "censored").otherwise(c("label_value")), "label_confidence": F.when(hit, "low").otherwise(c("label_confidence")), "notes": F.when(hit, note).otherwise(c("notes"))})


def with_task(labels: DataFrame) -> DataFrame:
    """The task of each row, filled from its type where it is missing; filling twice changes nothing."""
    table = F.create_map(*[F.lit(x) for kv in TASK_OF_TYPE.items() for x in kv])
    by_type = F.try_element_at(table, F.col("label_type"))
    return labels.withColumn("label_task", F.coalesce(F.col("label_task"), by_type) if "label_task" in labels.columns else by_type)


def with_events(labels: DataFrame) -> DataFrame:
    """Event columns of development rows that have none yet; rows of other types stay without."""
    c = F.col
    for name in EVENT_COLUMNS:
        if name not in labels.columns:
            labels = labels.withColumn(name, F.lit(None).cast("boolean" if name == "event_observed" else "string"))
    fill = (c("label_type") == "development") & c("event_label").isNull()
    row = lambda e: F.struct(*[F.lit(v).cast(t).alias(n) for n, v, t in zip(("l", "c", "o"), e, ("string", "string", "boolean"))])
    table = F.create_map(*[x for k, e in EVENTS.items() for x in (F.lit(k), row(e))])
    other = c("label_value").startswith("excluded_")
    event = F.coalesce(F.try_element_at(table, c("label_value")), F.when(other, row(("excluded_from_task", "excluded", None))))
    generic = fill & other & F.try_element_at(table, c("label_value")).isNull()
    put = lambda name, v: F.when(fill, v).otherwise(c(name))
    return labels.withColumn("__e", event).withColumns({
        "event_detail": F.when(generic, c("label_value")).otherwise(c("event_detail")), "event_category": put("event_category", c("__e.c")), "event_observed": put("event_observed", c("__e.o")),
        "event_date": put("event_date", c("label_date")), "evidence_nct_id": put("evidence_nct_id", registry_id(c("evidence_source"))),
        "event_rule_version": put("event_rule_version", F.lit(EVENT_VERSION)), "event_label": put("event_label", c("__e.l")),
    }).drop("__e")


def build(cohort: DataFrame, studies: DataFrame, reference: Column, least_months: int = 36, fuzzy: bool = True, dev: DataFrame | None = None, **how) -> DataFrame:
    """All labels of a cohort, long: legacy columns, event columns, then the rest. `dev`: uncensored development labels, if a stage before has made them."""
    dev = censor(development(cohort, studies, fuzzy=fuzzy, **how) if dev is None else dev, cohort, reference, least_months)
    both = with_events(with_task(operational(cohort, reference.cast("string")).unionByName(dev, allowMissingColumns=True)))
    first = [*LEGACY_COLUMNS, *EVENT_COLUMNS]
    return both.select(*first, *[x for x in both.columns if x not in first])


def audit_counts(labels: DataFrame) -> DataFrame:
    """Counts by type of values, confidences, events and categories, in one long table."""
    parts = [labels.groupBy("label_type", F.lit(name).alias("field"), F.col(name).alias("value")).agg(F.count(F.lit(1)).alias("n")) for name in ("label_value", "label_confidence", "event_label", "event_category")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def duplicates(labels: DataFrame) -> DataFrame:
    """Rows by type beyond one per study."""
    return labels.groupBy("label_type").agg((F.count(F.lit(1)) - F.countDistinct("nct_id")).alias("n_duplicates"))


def wide(labels: DataFrame) -> DataFrame:
    """One row per study with the first value and confidence of each type."""
    return labels.groupBy("nct_id").pivot("label_type", ["development", "operational"]).agg(F.first("label_value", ignorenulls=True).alias("value"), F.first("label_confidence", ignorenulls=True).alias("confidence"))


#: Negative label values of the nested benchmarks (fixed values).
NESTED = {"strict": ["hard_negative"], "intermediate": ["hard_negative", "ambiguous_negative"], "broad": ["hard_negative", "ambiguous_negative", "soft_negative"]}


def benchmark_sizes(labels: DataFrame) -> DataFrame:
    """Positives, negatives, their total and the rate of positives (4 digits; 0 of none) of the nested benchmarks among development rows: one pass."""
    v = F.col("label_value")
    one = labels.where("label_type = 'development'").agg(F.count_if(v == "advanced").alias("positives"), *[F.count_if(v.isin(neg)).alias(n) for n, neg in NESTED.items()])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("benchmark"), "positives", F.col(n).alias("negatives")) for n in NESTED])).alias("b")).select("b.*")
    total = F.col("positives") + F.col("negatives")
    return rows.withColumn("total", total).withColumn("positive_rate", F.when(total > 0, F.bround(F.col("positives") / total, 4)).otherwise(0.0))


def soft_flag_counts(labels: DataFrame) -> DataFrame:
    """How many soft negatives bear each diagnostic flag."""
    soft = labels.where("label_type = 'development' and label_value = 'soft_negative'")
    one = soft.agg(*[F.count_if(F.coalesce(F.col(f), F.lit(False))).alias(f) for f in FLAGS])
    return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("n")) for f in FLAGS])).alias("x")).select("x.*")


def audit(labels: DataFrame, cohort_size: int | None = None) -> dict:
    """What the label run holds, by type: counts of values, confidences, events and rule versions, benchmark sizes, flags, exclusions, duplicates.

    All but the duplicates come from one table of counts, whose rows are combinations of the vocabularies."""
    c, n = F.col, F.count(F.lit(1)).alias("n")
    by = [x for x in ("label_type", "label_task", "label_value", "label_confidence", "event_label", "event_category", "event_rule_version") if x in labels.columns]
    flags = [F.count_if(F.coalesce(c(f), F.lit(False))).alias(f) for f in FLAGS if f in labels.columns]
    cells = [r.asDict() for r in labels.groupBy(*by).agg(n, *flags).collect()]

    def spread(rows: list[dict], name: str) -> dict:
        out: dict = {}
        for r in rows:
            out[r[name]] = out.get(r[name], 0) + r["n"]
        return dict(sorted(out.items(), key=lambda kv: (-kv[1], str(kv[0]))))

    out: dict = {"cohort_size": cohort_size, "total_label_records": sum(r["n"] for r in cells)}
    if "label_task" in by:
        out["label_tasks"] = spread(cells, "label_task")
    out["label_types"] = {}
    for kind in sorted({r["label_type"] for r in cells}):
        rows = [r for r in cells if r["label_type"] == kind]
        own = {"count": sum(r["n"] for r in rows), "distribution": spread(rows, "label_value"), "confidence_distribution": spread(rows, "label_confidence")}
        if any(r.get("event_label") for r in rows):
            own |= {"event_label_distribution": spread(rows, "event_label"), "event_category_distribution": spread(rows, "event_category"),
                    "event_rule_version": sorted({r["event_rule_version"] for r in rows if r["event_rule_version"]})}
        if kind == "development":
            values = own["distribution"]
            positives = values.get("advanced", 0)
            ready = {}
            for name, neg in NESTED.items():
                negatives = sum(values.get(x, 0) for x in neg)
                total = positives + negatives
                ready[name] = {"total": total, "positives": positives, "negatives": negatives, "positive_rate": round(positives / total, 4) if total else 0}
            own["modeling_ready"] = ready
            own["soft_negative_flags"] = {f: sum(r[f] for r in rows if r["label_value"] == "soft_negative") for f in FLAGS if f in labels.columns}
            excluded = {k: v for k, v in values.items() if str(k).startswith("excluded_")}
            own["excluded_count"] = sum(excluded.values())
            if excluded:
                own["exclusion_reasons"] = excluded
        out["label_types"][kind] = own
    again = [f"{r['label_type']}: {r['n_duplicates']} duplicate nct_ids" for r in duplicates(labels).collect() if r["n_duplicates"]]
    return out | ({"warnings": sorted(again)} if again else {})

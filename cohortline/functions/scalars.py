"""Scalar functions as Column expressions: no function here needs Python on the executors."""

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS_PER_MONTH = 30.44


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


#: What counts as white space at the ends of a text (fixed values).
SPACES = "".join(map(chr, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]))


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(SPACES))


def tokens(c: Column, sep: str = ";") -> Column:
    """Trimmed tokens of a delimited string, empty ones dropped; null stays null."""
    return F.filter(F.transform(F.split(c, sep), lambda t: F.trim(t)), lambda t: t != "")


def lower_tokens(c: Column) -> Column:
    """Trimmed, lower-cased tokens; a null column has none."""
    return tokens(F.lower(text(c)))


def norm_status(c: Column) -> Column:
    """Lower case, underscores as spaces, commas dropped."""
    return F.trim(F.translate(F.lower(c), "_,", " "))


def norm_phase(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(F.trim(c)), "_", " "), r"phase(\d)", "phase $1")


#: Ordinals of phases (fixed values); a study of several phases has the largest.
PHASE_RANK = {"early phase 1": 0, "phase 1": 1, "phase 1/phase 2": 2, "phase 2": 3, "phase 2/phase 3": 4, "phase 3": 5, "phase 4": 6}


def phase_rank(c: Column) -> Column:
    """The largest ordinal among the value itself and its tokens; null if there is none. `;` and `/` both separate tokens."""
    whole = norm_phase(c)
    parts = F.concat(F.array(whole), F.transform(F.split(F.regexp_replace(c, "/", ";"), ";"), norm_phase))
    rank = F.create_map(*[F.lit(x) for kv in PHASE_RANK.items() for x in kv])
    return F.array_max(F.filter(F.transform(parts, lambda p: F.try_element_at(rank, p)), lambda r: r.isNotNull()))


def strict_date(c: Column) -> Column:
    """A full or partial date in one of four formats (a partial one is the first day); anything else is null."""
    t = F.trim(c)
    return F.coalesce(*[F.try_to_date(t, f) for f in ("yyyy-M-d", "yyyy-M", "MMMM d, yyyy", "MMMM yyyy")])


def column_date(c: Column, first: str | None) -> Column:
    """Dates of a column that is read in the one format of its first value (full or year and month); others are null."""
    fmt = {10: "yyyy-MM-dd", 7: "yyyy-MM"}.get(len((first or "").strip()), "yyyy-MM-dd")
    return F.try_to_date(F.when(F.length(F.trim(c)) == len(fmt), F.trim(c)), fmt)


def months_between_days(days: Column) -> Column:
    return F.round(days / F.lit(DAYS_PER_MONTH), 1)


def followup_months(primary: Column, completion: Column, updated: Column, reference: Column) -> Column:
    end = F.coalesce(strict_date(primary), strict_date(completion), strict_date(updated))
    return months_between_days(F.datediff(reference, end))


def months_before(d: Column, months: int) -> Column:
    """Calendar months earlier, clipped to the end of the month."""
    return F.add_months(d, -months)


#: Registry statuses and the operational label of each (fixed values); anything else is unknown.
STATUS_LABEL = {
    "completed": "completed",
    "terminated": "terminated",
    "withdrawn": "withdrawn",
    "suspended": "suspended",
    "active not recruiting": "active_not_recruiting",
    "enrolling by invitation": "enrolling_by_invitation",
    "recruiting": "recruiting",
    "not yet recruiting": "not_yet_recruiting",
    "available": "unknown",
    "no longer available": "unknown",
    "temporarily not available": "suspended",
    "approved for marketing": "completed",
    "withheld": "unknown",
    "unknown": "unknown",
}


def operational_label(status: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in STATUS_LABEL.items() for x in kv])
    return F.coalesce(F.try_element_at(table, norm_status(status)), F.lit("unknown"))


def operational_confidence(label: Column) -> Column:
    return F.when(label.isin("completed", "terminated", "withdrawn"), "high").when(label.isin("suspended", "active_not_recruiting"), "medium").otherwise("low")


def registry_id(c: Column) -> Column:
    """The first registry id in a text, or null."""
    return F.nullif(F.regexp_extract(c, r"\bNCT\d{8}\b", 0), F.lit(""))


#: Years in each unit of an age (fixed values).
AGE_UNITS = {"year": 1.0, "month": 1.0 / 12, "week": 1.0 / 52, "day": 1.0 / 365.25, "hour": 1.0 / 8766}


def age_years(c: Column) -> Column:
    """`18 Years` -> 18.0; null where no whole number is followed by a unit."""
    age = r"(?i)(\d+)\s*(year|month|week|day|hour)"
    value = F.nullif(F.regexp_extract(c, age, 1), F.lit("")).cast("double")
    factor = F.create_map(*[F.lit(x) for kv in AGE_UNITS.items() for x in kv])
    return value * F.try_element_at(factor, F.lower(F.regexp_extract(c, age, 2)))


def count_delimited(c: Column, delimiter: str = "; ") -> Column:
    return F.when(c.isNull() | (F.trim(c) == ""), 0).otherwise(F.size(F.split(c, "\\Q" + delimiter + "\\E")))


def text_length(c: Column) -> Column:
    return F.length(text(c))


def number(c: Column) -> Column:
    return c.try_cast("double")


def boolean_flag(c: Column) -> Column:
    return (F.coalesce(number(c), F.lit(0.0)) > 0).cast("int")


def log1p_clipped(c: Column) -> Column:
    return F.log1p(F.greatest(c, F.lit(0.0)))


def clean_text(c: Column, remove_html: bool = True, least: int = 2) -> Column:
    """Lower case, tags as spaces, tokens of at least `least` characters joined by one space; null is empty."""
    t = F.lower(text(c))
    if remove_html:
        t = F.regexp_replace(t, "<[^>]+>", " ")
    return F.array_join(F.filter(F.split(t, r"(?U)\s+"), lambda w: F.length(w) >= least), " ")


def document(*cols: Column) -> Column:
    """Fields joined by spaces, then cleaned."""
    return clean_text(F.concat_ws(" ", *[text(c) for c in cols]))


def document_by_field(*cols: Column) -> Column:
    """Each field cleaned, empty ones skipped, joined by a space."""
    return F.array_join(F.filter(F.array(*[clean_text(c) for c in cols]), lambda x: x != ""), " ")


def shown(c: Column, missing: str = "None") -> Column:
    """A value as it is printed: a missing one as a word."""
    return F.coalesce(c.cast("string"), F.lit(missing))

"""Nested registry records: scan, flatten to 60 columns, last occurrence of each id."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DATE = "struct<date:string,type:string>"
#: The part of a record that is read (fixed values: paths of the registry's format).
RECORD_DDL = f"""
    protocolSection struct<
      identificationModule: struct<nctId:string, orgStudyIdInfo:struct<id:string>, organization:struct<fullName:string,class:string>, briefTitle:string, officialTitle:string, acronym:string>,
      statusModule: struct<overallStatus:string, statusVerifiedDate:string, startDateStruct:{_DATE}, primaryCompletionDateStruct:{_DATE}, completionDateStruct:{_DATE}, studyFirstSubmitDate:string, studyFirstPostDateStruct:{_DATE}, lastUpdateSubmitDate:string, lastUpdatePostDateStruct:{_DATE}, whyStopped:string>,
      sponsorCollaboratorsModule: struct<leadSponsor:struct<name:string,class:string>, collaborators:array<struct<name:string>>, responsibleParty:struct<type:string>>,
      designModule: struct<studyType:string, phases:array<string>, designInfo:struct<allocation:string, interventionModel:string, interventionModelDescription:string, primaryPurpose:string, maskingInfo:struct<masking:string, maskingDescription:string, whoMasked:array<string>>>, enrollmentInfo:struct<count:bigint,type:string>>,
      conditionsModule: struct<conditions:array<string>, keywords:array<string>>,
      armsInterventionsModule: struct<armGroups:array<struct<type:string,label:string>>, interventions:array<struct<type:string,name:string>>>,
      outcomesModule: struct<primaryOutcomes:array<struct<measure:string,timeFrame:string>>, secondaryOutcomes:array<struct<measure:string>>>,
      eligibilityModule: struct<eligibilityCriteria:string, healthyVolunteers:boolean, sex:string, minimumAge:string, maximumAge:string, stdAges:array<string>>,
      descriptionModule: struct<briefSummary:string, detailedDescription:string>,
      contactsLocationsModule: struct<locations:array<struct<country:string>>>,
      oversightModule: struct<oversightHasDmc:boolean>>,
    hasResults boolean"""


def record() -> T.StructType:
    """The record's type; parsing it takes a session."""
    return T.StructType.fromDDL(RECORD_DDL)


def joined(c: Column, sep: str = "; ") -> Column:
    """An array as one string; null and empty arrays are null, null elements are printed."""
    return F.when(F.size(c) > 0, F.array_join(c, sep, "None"))


def joined_sorted(c: Column, missing: str | None = None) -> Column:
    """Sorted distinct elements; missing ones become `missing`, or are dropped with empty ones."""
    own = F.transform(c, lambda x: F.coalesce(x, F.lit(missing))) if missing is not None else F.filter(c, lambda x: x.isNotNull() & (x != ""))
    return joined(F.array_sort(F.array_distinct(own)))


def counted(c: Column) -> Column:
    return F.coalesce(F.when(c.isNotNull(), F.size(c)), F.lit(0))


def columns(root: str = "") -> dict[str, Column]:
    """The 60 flat columns of a record."""
    r = f"{root}." if root else ""
    c = lambda path: F.col(f"{r}protocolSection.{path}")
    ident, status, sponsor, design, info = "identificationModule", "statusModule", "sponsorCollaboratorsModule", "designModule", "designModule.designInfo"
    arms, out, elig = "armsInterventionsModule", "outcomesModule", "eligibilityModule"
    plain = {
        "nct_id": f"{ident}.nctId", "org_study_id": f"{ident}.orgStudyIdInfo.id", "org_name": f"{ident}.organization.fullName", "org_class": f"{ident}.organization.class",
        "brief_title": f"{ident}.briefTitle", "official_title": f"{ident}.officialTitle", "acronym": f"{ident}.acronym",
        "overall_status": f"{status}.overallStatus", "status_verified_date": f"{status}.statusVerifiedDate", "why_stopped": f"{status}.whyStopped",
        "start_date": f"{status}.startDateStruct.date", "start_date_type": f"{status}.startDateStruct.type",
        "primary_completion_date": f"{status}.primaryCompletionDateStruct.date", "primary_completion_type": f"{status}.primaryCompletionDateStruct.type",
        "completion_date": f"{status}.completionDateStruct.date", "completion_date_type": f"{status}.completionDateStruct.type",
        "first_submit_date": f"{status}.studyFirstSubmitDate", "first_post_date": f"{status}.studyFirstPostDateStruct.date",
        "last_update_submit_date": f"{status}.lastUpdateSubmitDate", "last_update_post_date": f"{status}.lastUpdatePostDateStruct.date",
        "lead_sponsor": f"{sponsor}.leadSponsor.name", "lead_sponsor_class": f"{sponsor}.leadSponsor.class",
    }
    cols = {k: c(v) for k, v in plain.items()}
    cols |= {"collaborator_names": joined(c(f"{sponsor}.collaborators.name")), "n_collaborators": counted(c(f"{sponsor}.collaborators")), "responsible_party_type": c(f"{sponsor}.responsibleParty.type")}
    cols |= {"study_type": c(f"{design}.studyType"), "phases": joined(c(f"{design}.phases")), "allocation": c(f"{info}.allocation"), "intervention_model": c(f"{info}.interventionModel"),
             "intervention_model_description": c(f"{info}.interventionModelDescription"), "primary_purpose": c(f"{info}.primaryPurpose"), "masking": c(f"{info}.maskingInfo.masking"),
             "masking_description": c(f"{info}.maskingInfo.maskingDescription"), "who_masked": joined(c(f"{info}.maskingInfo.whoMasked")),
             "enrollment": c(f"{design}.enrollmentInfo.count"), "enrollment_type": c(f"{design}.enrollmentInfo.type")}
    cols |= {"conditions": joined(c("conditionsModule.conditions")), "keywords": joined(c("conditionsModule.keywords"))}
    cols |= {"n_arms": counted(c(f"{arms}.armGroups")), "arm_types": joined(c(f"{arms}.armGroups.type")), "arm_labels": joined(c(f"{arms}.armGroups.label")),
             "n_interventions": counted(c(f"{arms}.interventions")), "intervention_types": joined_sorted(c(f"{arms}.interventions.type"), ""), "intervention_names": joined(c(f"{arms}.interventions.name"))}
    cols |= {"n_primary_outcomes": counted(c(f"{out}.primaryOutcomes")), "primary_outcome_measures": joined(c(f"{out}.primaryOutcomes.measure")),
             "primary_outcome_timeframes": joined(c(f"{out}.primaryOutcomes.timeFrame")), "n_secondary_outcomes": counted(c(f"{out}.secondaryOutcomes"))}
    cols |= {"eligibility_criteria": c(f"{elig}.eligibilityCriteria"), "healthy_volunteers": c(f"{elig}.healthyVolunteers"), "sex": c(f"{elig}.sex"),
             "minimum_age": c(f"{elig}.minimumAge"), "maximum_age": c(f"{elig}.maximumAge"), "std_ages": joined(c(f"{elig}.stdAges"))}
    cols |= {"brief_summary": c("descriptionModule.briefSummary"), "detailed_description": c("descriptionModule.detailedDescription"),
             "n_locations": counted(c("contactsLocationsModule.locations")), "countries": joined_sorted(c("contactsLocationsModule.locations.country")),
             "has_dmc": c("oversightModule.oversightHasDmc"), "has_results": F.coalesce(F.col(f"{r}hasResults"), F.lit(False))}
    return cols


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """(file, ordinal, study) of pull files: an envelope with `studies`, a bare list of records, or (.jsonl) a record a line."""
    one = record()
    wrapped = spark.read.schema(T.StructType([T.StructField("studies", T.ArrayType(one)), *one.fields])).option("multiLine", not path.rstrip("/").endswith(".jsonl")).json(path)
    file = F.col("_metadata.file_path")
    inside = wrapped.where("studies is not null").select(file.alias("file"), F.posexplode("studies").alias("ordinal", "study"))
    # of a bare list every record is a row already, in file order
    bare = wrapped.where("studies is null and protocolSection is not null").select(file.alias("file"), F.monotonically_increasing_id().alias("ordinal"), F.struct(*one.names).alias("study"))
    return inside.withColumn("ordinal", F.col("ordinal").cast("long")).unionByName(bare)


#: Where a record's text has its id.
ID_PATH = "$.protocolSection.identificationModule.nctId"


def flatten(raw: DataFrame) -> DataFrame:
    """60 columns and the ordinal; of an id that repeats, the last occurrence: an aggregate, not a window. Records are kept or dropped whole, as `study` or as `record`, its text:
    only those that are kept are parsed and flattened."""
    flat, texts = columns("study"), "record" in raw.columns
    key = F.get_json_object("record", ID_PATH) if texts else flat["nct_id"]
    last = keep_last(raw.select("file", "ordinal", key.alias("nct_id"), "record" if texts else "study"), "nct_id", ["file", "ordinal"])
    if texts:
        last = last.withColumn("study", F.from_json("record", record()))
    return last.select("ordinal", *[c.alias(n) for n, c in flat.items()])


def keep_last(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row of each key that is last in order."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), F.struct(*order)).alias("__row")).select(*[F.col(key) if c == key else F.col(f"__row.{c}") for c in df.columns])

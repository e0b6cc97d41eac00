"""Schemas of the recruitment marketplace, enum domains and column checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 9

_LONG, _STR, _INT, _TS, _BOOL = T.LongType(), T.StringType(), T.IntegerType(), T.TimestampNTZType(), T.BooleanType()
_LIST, _SCORE = T.ArrayType(T.StringType()), T.DecimalType(5, 2)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SCHEMAS: dict[str, T.StructType] = {
    "users": _struct(id=_LONG, username=_STR, email=_STR, password=_STR, date_of_birth=T.DateType(), role=_STR),
    "candidate_profiles": _struct(id=_LONG, user_id=_LONG, headline=_STR, bio=_STR, phone=_STR, location=_STR, experience_years=T.DecimalType(3, 1), education=_STR, skills=_LIST, linkedin_url=_STR, github_url=_STR, portfolio_url=_STR, created_at=_TS, updated_at=_TS),
    "companies": _struct(id=_LONG, name=_STR, description=_STR, location=_STR, website=_STR, owner_id=_LONG),
    "jobs": _struct(id=_LONG, title=_STR, description=_STR, salary=T.DecimalType(10, 2), location=_STR, skills=_LIST, employment_type=_STR, experience_level=_STR, work_mode=_STR, posted_at=_TS, company_id=_LONG),
    "saved_jobs": _struct(id=_LONG, user_id=_LONG, job_id=_LONG, saved_at=_TS),
    "applications": _struct(id=_LONG, user_id=_LONG, job_id=_LONG, resume_id=_LONG, status=_STR, applied_at=_TS, updated_at=_TS),
    "application_status_history": _struct(id=_LONG, application_id=_LONG, old_status=_STR, new_status=_STR, changed_by=_LONG, changed_at=_TS),
    "resumes": _struct(id=_LONG, user_id=_LONG, original_filename=_STR, stored_filename=_STR, file_type=_STR, file_size=_INT, file_path=_STR, is_primary=_BOOL, uploaded_at=_TS, updated_at=_TS),
    "resume_parsing_results": _struct(id=_LONG, resume_id=_LONG, status=_STR, extracted_text=_STR, parsed_data=_STR, parser_version=_STR, error_message=_STR, created_at=_TS, updated_at=_TS),
    "ats_analyses": _struct(id=_LONG, resume_id=_LONG, job_id=_LONG, overall_score=_SCORE, skill_score=_SCORE, experience_score=_SCORE, education_score=_SCORE, keyword_score=_SCORE, matched_skills=_LIST, missing_skills=_LIST, matched_keywords=_LIST, missing_keywords=_LIST, recommendations=_LIST, created_at=_TS, updated_at=_TS),
}

# The domains of the string-valued enums.
ENUMS: dict[str, tuple[str, ...]] = {
    "employment_type": ("Full-time", "Part-time", "Contract", "Internship"),
    "experience_level": ("Entry", "Junior", "Mid", "Senior"),
    "work_mode": ("Onsite", "Remote", "Hybrid"),
    "status": ("Applied", "Shortlisted", "Rejected", "Selected"),
    "parse_status": ("Pending", "Processing", "Completed", "Failed"),
    "role": ("Candidate", "Employer", "Admin"),
}
DEFAULTS: dict[str, str] = {"role": "Candidate", "status": "Applied", "employment_type": "Full-time", "experience_level": "Entry", "work_mode": "Onsite"}
#: Columns that never leave the engine.
PRIVATE = ("password", "file_path", "stored_filename")


def public(df: DataFrame) -> DataFrame:
    """The columns that a reader may see."""
    return df.select([c for c in df.columns if c not in PRIVATE])


def with_defaults(df: DataFrame) -> DataFrame:
    """Missing enum values as on insertion."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS.items() if c in df.columns})


def _between(c: str, low: int, high: int) -> Column:
    return F.length(c).between(low, high)


def checks(table: str) -> dict[str, Column]:
    """Rules by name; a row that breaks one has false (or null) there."""
    return {
        "users": {"username": _between("username", 3, 30), "role": F.col("role").isin(*ENUMS["role"])},
        "companies": {"name": _between("name", 2, 50), "location": _between("location", 2, 100)},
        "jobs": {"title": _between("title", 3, 100), "description": _between("description", 10, 2000), "salary": F.col("salary") > 0, "skills": F.size("skills") >= 1} | {c: F.col(c).isin(*ENUMS[c]) for c in ("employment_type", "experience_level", "work_mode")},
        "candidate_profiles": {"experience_years": F.col("experience_years").isNull() | (F.col("experience_years") >= 0)},
        "ats_analyses": {c: F.col(c).between(0, 100) for c in ("overall_score", "skill_score", "experience_score", "education_score", "keyword_score")},
    }[table]


def violations(df: DataFrame, table: str) -> DataFrame:
    """The rows that break a rule of their table, with the names of those they break."""
    return broken_rules(df, checks(table))


def broken_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items())))
    return df.withColumn("broken", broken).filter(F.size("broken") > 0)

"""Schemas of announcements, the taxonomy and matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"specialties": T.ArrayType(T.StringType()), "positions": T.IntegerType()}
JOB = T.StructType(
    [
        T.StructField(c, _KINDS.get(c, T.StringType()))
        for c in (
            "uuid", "url", "scope", "listing_title", "administration", "publication_date", "deadline", "contest_date", "job_name", "grade", "specialties", "positions",
            "recruitment_type", "application_type", "application_site", "contest_code",
        )
    ]
)
PROFESSION = "ord long, id string, label string, sector string, family string, hcp_codes array<string>, aliases array<string>, diplomas array<string>, source string"
EVIDENCE = "struct<field:string,value:string,matched_term:string,raw_score:double>"
MATCH = f"struct<profession_id:string,label:string,sector:string,family:string,hcp_codes:array<string>,source:string,score:double,confidence:string,searchable:boolean,evidence:{EVIDENCE}>"


def as_jobs(df: DataFrame) -> DataFrame:
    """df with the columns of JOB; missing ones are null, others stay."""
    return df.withColumns({f.name: (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType) for f in JOB.fields})

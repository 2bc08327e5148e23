"""Stream names out of ARNs, as columns: null where a name or ARN is not valid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEGMENT = "^[A-Za-z0-9_.-]{1,128}$"


def valid_segment(c: Column) -> Column:
    return F.coalesce(c.rlike(SEGMENT), F.lit(False))


def stream_name(arn: Column) -> Column:
    p = F.split(arn, ":", 6)
    part = lambda i: F.coalesce(F.try_element_at(p, F.lit(i)), F.lit(""))
    name = F.regexp_replace(part(6), "^stream/", "")
    good = (part(1) == "arn") & (part(2) != "") & (part(3) == "kinesis") & (part(4) != "") & part(5).rlike("^[0-9]{12}$") & part(6).startswith("stream/") & valid_segment(name)
    return F.when(good, name)

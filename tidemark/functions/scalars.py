"""Scalar functions: clocks, listing paths, identifiers, header dates, canonical names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLOCK = r"^(\d+):([0-5]\d):([0-5]\d)(?:\.(\d{1,6}))?$"


def clock_us(c: Column) -> Column:
    """``h:mm:ss[.f]`` as exact microseconds; null for anything else."""
    part = lambda k: F.regexp_extract(c, CLOCK, k)
    fraction = F.rpad(F.coalesce(part(4), F.lit("")), 6, "0").cast("long")
    whole = (part(1).cast("long") * 60 + part(2).cast("long")) * 60 + part(3).cast("long")
    return F.when(c.rlike(CLOCK), whole * 1_000_000 + fraction)


def snake(c: Column) -> Column:
    """Camel case and separators to snake case."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1_$2"), r"[^A-Za-z0-9]+", "_"))


def safe_id(c: Column) -> Column:
    """Whether text is a plain identifier of at most 128 signs."""
    return F.coalesce(c.rlike(r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$"), F.lit(False))


def without_query(url: Column) -> Column:
    """URL with its query and fragment taken off."""
    return F.regexp_replace(url, r"[?#].*$", "")


def path_parts(c: Column) -> dict[str, Column]:
    """Folder, stem and lower-case extension of a member path with either slash."""
    p = F.replace(c, F.lit("\\"), F.lit("/"))
    name = F.regexp_extract(p, r"([^/]*)$", 1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return {"folder": F.regexp_replace(p, r"/?[^/]*$", ""), "stem": F.regexp_replace(name, r"\.[^.]+$", ""), "extension": ext}


def member_problems(c: Column, allowed: list[str]) -> Column:
    """Reasons why an archive member is unsafe, in a fixed order; empty if it is sound."""
    p = F.replace(c, F.lit("\\"), F.lit("/"))
    rules = [
        ("traversal", p.rlike(r"(^|/)\.\.(/|$)")),
        ("absolute", p.rlike(r"^/")),
        ("drive_letter", p.rlike(r"^[A-Za-z]:")),
        ("empty_part", p.rlike(r"//")),
        ("extension", ~path_parts(c)["extension"].isin(allowed)),
    ]
    return F.filter(F.array(*[F.when(cond, F.lit(n)) for n, cond in rules]), lambda x: x.isNotNull())


def header_time(c: Column) -> Column:
    """``m/d/yyyy h:mm:ss`` as a timestamp without zone, null if it is none."""
    return F.try_to_timestamp(c, F.lit("M/d/yyyy H:mm:ss")).cast("timestamp_ntz")


def stream_kind(name: Column) -> Column:
    """Label of an OLE stream by its name; the first rule that fits counts."""
    n = F.lower(name)
    return (
        F.when(n.isin("workbook", "book"), "workbook").when(n.rlike(r"summaryinformation$"), "summary").when(n.rlike(r"^\x05"), "property").when(n.rlike("macro|vba"), "macro")
        .when(n.rlike("compobj"), "class").when(n.rlike("^ole|objinfo"), "embedding").otherwise("other")
    )


def first_eight_bytes(c: Column) -> Column:
    """Seed from text: the first eight bytes of its SHA-256 as an unsigned number."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 16), 16, 10).cast("decimal(20,0)")

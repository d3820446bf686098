"""Columns about catalog links: their kind, ids and previews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# How links of each kind look, and the addresses of their previews.
DRIVE_IDS = (r"/file/d/([\w-]+)", r"[?&]id=([\w-]+)")
ARCHIVE_ID = r"archive\.org/(?:details|embed|download)/([^/?#]+)"
DRIVE_HOST, ARCHIVE_HOST, PDF_END = "drive.google.com", "archive.org", ".pdf"
DRIVE_PREVIEW = ("https://drive.google.com/file/d/", "/preview")
ARCHIVE_PREVIEW = "https://archive.org/embed/"


def _found(link: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(link, pattern, 1), F.lit(""))


def drive_id(link: Column) -> Column:
    return F.coalesce(*[_found(link, p) for p in DRIVE_IDS])


def archive_id(link: Column) -> Column:
    return _found(link, ARCHIVE_ID)


def host(link: Column) -> Column:
    return F.lower(F.regexp_extract(link, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path(link: Column) -> Column:
    return F.regexp_extract(link, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def kind(link: Column) -> Column:
    web = F.coalesce(F.startswith(link, F.lit("http")), F.lit(False))
    return (
        F.when(~web, "unsupported")
        .when(F.contains(host(link), F.lit(DRIVE_HOST)) & drive_id(link).isNotNull(), "drive")
        .when(F.endswith(host(link), F.lit(ARCHIVE_HOST)) & archive_id(link).isNotNull(), "archive")
        .when(F.endswith(F.lower(path(link)), F.lit(PDF_END)), "direct_pdf")
        .otherwise("unsupported")
    )


def preview(link: Column) -> Column:
    k = kind(link)
    return (
        F.when(k == "drive", F.concat(F.lit(DRIVE_PREVIEW[0]), drive_id(link), F.lit(DRIVE_PREVIEW[1])))
        .when(k == "archive", F.concat(F.lit(ARCHIVE_PREVIEW), archive_id(link)))
        .when(k == "direct_pdf", link)
    )


def is_url(link: Column) -> Column:
    """Case-sensitive, as the payload has it."""
    return F.coalesce(F.startswith(link, F.lit("http")), F.lit(False))


def target_label(url: Column, storage: Column) -> Column:
    """Where something was published: the address's host and port as written (the whole address if it names none) and the storage."""
    place = _found(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)")
    return F.concat(F.coalesce(place, url), F.lit(" + "), storage, F.lit(" storage"))

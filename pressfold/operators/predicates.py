"""Soft deletion and the other conditions of the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def active(deleted_at: str = "deleted_at") -> Column:
    return F.col(deleted_at).isNull()


def crawlable() -> Column:
    """Active, with a blog link that is not empty; a blank one passes here and fails at the second gate."""
    return active() & F.col("blog_link").isNotNull() & (F.col("blog_link") != "")


def blank_link() -> Column:
    """The second gate: no link, or nothing but white space."""
    return F.col("blog_link").isNull() | (F.regexp_replace("blog_link", r"^[\x00-\x20]+|[\x00-\x20]+$", "") == "")


def name_match(text: str, *, ignore_case: bool = False) -> Column:
    """``LIKE %text%``: % and _ in the text are wildcards, a backslash is itself."""
    pattern = "%" + text.replace("\\", "\\\\") + "%"
    return F.col("name").ilike(pattern) if ignore_case else F.col("name").like(pattern)


def search_text(text: str | None) -> str | None:
    """A blank search is none; others stay as they are, spaces included."""
    return text if text and text.strip() else None


def by_ids(rows: DataFrame, ids: list[int]) -> DataFrame:
    """Rows with these ids; ids without a row are ignored."""
    return rows.where(F.col("id").isin(ids)) if ids else rows.where(F.lit(False))


def too_long(limits: dict[str, int]) -> Column:
    """Whether any column exceeds its limit of characters."""
    out = F.lit(False)
    for column, limit in limits.items():
        out = out | F.coalesce(F.length(column) > limit, F.lit(False))
    return out

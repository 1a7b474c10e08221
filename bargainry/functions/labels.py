"""Column functions for what a reader sees: times, endings, names.  All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import col, half_up, hours_between

#: Labels by category, department and family.
CATEGORY_LABELS = {
    "electronics": "Electronics", "computers": "Computers", "gaming": "Gaming", "clothing": "Clothing", "shoes-accessories": "Shoes & Accessories",
    "toys-games": "Toys & Games", "baby-kids": "Baby & Kids", "home": "Home", "kitchen": "Kitchen", "appliances": "Appliances", "grocery": "Grocery",
    "beauty-health": "Beauty & Health", "sports-outdoors": "Sports & Outdoors", "tools-auto": "Tools & Auto", "travel": "Travel", "other": "Other",
}
DEPARTMENT_LABELS = {"women": "Women", "men": "Men", "girls": "Girls", "boys": "Boys", "baby": "Baby", "unisex": "Unisex", "na": ""}
FAMILY_LABELS = {"canadian-tire": "Canadian Tire family", "gap-inc": "Gap Inc. Canada", "reitmans": "Reitmans Group"}


def label(value: Column | str, labels: dict[str, str], missing: Column | None = None) -> Column:
    """The label of a value; values without one are shown as they are, or as ``missing``."""
    known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(known, col(value)), col(value) if missing is None else missing)


def _counted(n: Column, one: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" " + one), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))


def relative_time(at: Column | str, now: Column) -> Column:
    """How long ago, in the largest unit that fits; each unit is rounded from the one below."""
    seconds = half_up(hours_between(col(at), now) * 3600)
    minutes = half_up(seconds / 60)
    hours = half_up(minutes / 60)
    days = half_up(hours / 24)
    ago = lambda text: F.concat(text, F.lit(" ago"))
    return (
        F.when(col(at).isNull(), F.lit(""))
        .when(seconds < 60, F.lit("just now"))
        .when(minutes < 60, ago(F.concat(minutes.cast("string"), F.lit(" min"))))
        .when(hours < 24, ago(_counted(hours, "hour")))
        .when(days < 30, ago(_counted(days, "day")))
        .otherwise(ago(_counted(half_up(days / 30), "month")))
    )


def expiry_label(at: Column | str, now: Column) -> Column:
    """When an offer ends; null if it has no end."""
    left = hours_between(now, col(at))
    hours = half_up(left)
    days = half_up(hours / 24)
    ends = lambda text: F.concat(F.lit("Ends in "), text)
    return (
        F.when(left <= 0, F.lit("Expired"))
        .when(hours < 1, F.lit("Ends within the hour"))
        .when(hours < 24, ends(_counted(hours, "hour")))
        .when(days == 1, F.lit("Ends tomorrow"))
        .when(days > 1, ends(_counted(days, "day")))
    )


def expiring_soon(at: Column | str, now: Column) -> Column:
    left = hours_between(now, col(at))
    return F.coalesce((left > 0) & (left < 24), F.lit(False))


def initials(name: Column | str) -> Column:
    """First letters of the first two words, in capitals; a question mark without a name."""
    words = F.filter(F.split(col(name), r"\s+"), lambda w: w != "")
    letters = F.array_join(F.transform(F.slice(words, 1, 2), lambda w: F.upper(F.substring(w, 1, 1))), "")
    return F.when(col(name).isNull() | (col(name) == ""), F.lit("?")).otherwise(letters)


def distance(km: Column | str) -> Column:
    return F.when(col(km).isNotNull(), F.format_string("%.1f km", col(km)))

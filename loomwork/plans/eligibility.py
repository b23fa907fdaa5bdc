"""Area eligibility of an order, and a filter from optional arguments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Network notes that allow a delay, by kind of area.
SCALE_NOTES = ("UG congested duct", "UG Potential Wayleave Issues", "UG partial Direct In Ground", "UG Feed Not Evaluated")
OTHER_NOTES = ("UG congested duct", "UG Potential Wayleave Issues", "UG partial Direct In Ground", "UG Part proven",
               "UG navigable with camera", "UG Linked duct", "OH Potential Wayleave issues")


def area_valid(df: DataFrame, address_scale: str, exchange_scale: str, notes: str, stages: str, name: str) -> DataFrame:
    """'Y'/'N': the exchange's switch goes before the address's, which goes before 'N'."""
    scale = F.coalesce(F.col(exchange_scale), F.col(address_scale), F.lit("N"))
    fits = (((scale == "Y") & F.col(notes).isin(*SCALE_NOTES)) | ((scale == "N") & F.col(notes).isin(*OTHER_NOTES)))
    valid = F.coalesce(fits & (F.col(stages) == "2"), F.lit(False))
    return df.withColumn(name, F.when(valid, "Y").otherwise("N"))


def filtered(df: DataFrame, order: list[str] | None = None, **wanted) -> DataFrame:
    """Rows that meet every argument that is given; None means no condition.

    ``column=value`` compares, ``column=[...]`` is membership, ``column_from``
    and ``column_to`` are bounds. Conditions reach the scan as plain filters.
    """
    for name, value in wanted.items():
        if value is None:
            continue
        if name.endswith("_from"):
            df = df.where(F.col(name[:-5]) >= F.lit(value))
        elif name.endswith("_to"):
            df = df.where(F.col(name[:-3]) <= F.lit(value))
        elif isinstance(value, (list, tuple, set)):
            df = df.where(F.col(name).isin(list(value)))
        else:
            df = df.where(F.col(name) == F.lit(value))
    return df.orderBy(*order) if order else df

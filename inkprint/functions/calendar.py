"""Calendar parts of epoch seconds, always in UTC.

Integer arithmetic on the epoch keeps the result independent of the session time zone.
"""

from pyspark.sql import Column, functions as F


def hour_of(epoch: Column) -> Column:
    return F.floor(F.pmod(epoch, F.lit(86400)) / 3600).cast("int")


def minute_of(epoch: Column) -> Column:
    return F.floor(F.pmod(epoch, F.lit(3600)) / 60).cast("int")


def weekday_of(epoch: Column) -> Column:
    """Monday is 0; the epoch itself was a Thursday."""
    return F.pmod(F.floor(epoch / 86400) + 3, F.lit(7)).cast("int")

"""Questions about VPN sessions (``ciscovpn``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.dates import vpn_duration_seconds
from vigil.operators import trailing
from vigil.operators.enrich import with_country
from vigil.operators.ranking import count_by
from vigil.operators.sizing import small
from vigil.session import settle


def logins(vpn: DataFrame, user: str) -> DataFrame:
    """Different (date, time, remoteip, reason) of one user."""
    return (
        vpn.filter(F.col("username") == user)
        .select("date", "time", "remoteip", "reason")
        .distinct()
    )


def ips_by_user(vpn: DataFrame, user: str, unusual_below: int = 10) -> DataFrame:
    """Hits per remote address of one user, few hits labelled ``Unusual``."""
    hits = count_by(vpn.filter(F.col("username") == user), "remoteip")
    return hits.withColumn(
        "activity", F.when(F.col("hits") < unusual_below, "Unusual").otherwise("Normal")
    )


def foreign_logins(
    vpn: DataFrame,
    directory: DataFrame,
    ranges: DataFrame,
    by: tuple[str, ...] = ("username", "remoteip", "remoteipcc", "c"),
) -> DataFrame:
    """Sessions from outside the user's country, counted by ``by``.

    Sessions are counted per (user, address) before the country lookup and the
    directory join, so a busy user reaches the joins as a few rows.
    """
    pairs = count_by(vpn, "username", "remoteip", name="n")
    located = with_country(pairs, "remoteip", ranges, "remoteipcc")
    people = small(directory.select("emailaddress", "c"))
    abroad = located.join(people, located["username"] == people["emailaddress"]).filter(
        F.col("remoteipcc") != F.col("c")
    )
    return abroad.groupBy(*by).agg(F.sum("n").alias("hits"))


def identify_user(vpn: DataFrame, ip: str, day: str) -> DataFrame:
    """Users of an address on a day, a row per session."""
    return vpn.filter(
        (F.col("date") == F.lit(day).cast("date")) & (F.col("remoteip") == ip)
    ).select("username")


def session_deviation(vpn: DataFrame, times: float = 3.0, days: int = 30, least: int = 5) -> DataFrame:
    """Sessions whose length is over ``times`` median deviations from their user's trailing median.

    ``(date, time, username, seconds, trailing_n, median, deviation)``.  Only ended
    sessions have a length; users with fewer than ``least`` sessions in the window are not
    judged.  A window without any spread makes every other length stand out.
    """
    ended = vpn.select("date", "time", "username", vpn_duration_seconds(F.col("duration")).alias("seconds")).where(
        "seconds is not null and username is not null and date is not null"
    )
    usual = trailing.trailing_medians(trailing.daily_histogram(ended, "username", "seconds"), "username", "seconds", days)
    # One row a user and day; a busy day's sessions are split by AQE where this shuffles.
    judged = ended.join(small(settle(usual.where(F.col("trailing_n") >= least), "usual")), ["username", "date"])
    far = F.abs(F.col("seconds") - F.col("median")) > times * F.col("deviation")
    return judged.where(far).select("date", "time", "username", "seconds", "trailing_n", "median", "deviation")

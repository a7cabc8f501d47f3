"""Queries of streams with memory, of versioned feeds, and of one large wide-character file."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from bindings.queries import query
from vigil.functions import dates
from vigil.operators import ranking
from vigil.session import scratch_path
from vigil.sinks import versions
from vigil.sources import inventory
from vigil.streaming import ingest as streaming
from vigil.streaming import stateful
from vigil.streaming.listener import BatchTable

# Parts in which the packets arrive: by year, a fifth of each one part late.
_PART = "least(3, greatest(0, (year(date) - 1993) div 2) + if(pmod(xxhash64(srcip, srcport, time), 5) = 0, 1, 0))"


@query(
    "stream_deny_counts",
    """select concat(cast(date as varchar), ' ', substr(time, 1, 2), ':00:00') as window_start, proto, count(*) as n
       from {v_fw} where action = 'DENY' group by date, substr(time, 1, 2), proto""",
)
def _(t):
    path = scratch_path(t.spark, "packets")
    packets = t["v_fw"].select(
        "date", "time", "action", "proto", dates.clock_time(F.col("date"), F.col("time")).alias("event_ts"), F.expr(_PART).alias("part")
    )
    for start in (0, 2):
        # Two parts land, the stream takes what is there and ends; the second start goes on.
        for part in (start, start + 1):
            packets.where(F.col("part") == part).drop("part").write.mode("append").parquet(f"{path}/landed")
        landed = t.spark.readStream.schema(packets.drop("part").schema).parquet(f"{path}/landed")
        counts = stateful.deny_counts(landed, watermark="2200 days")
        stateful.start_counts(counts, f"{path}/counts", f"{path}/checkpoint").awaitTermination()
    found = stateful.current_counts(t.spark, f"{path}/counts")
    return found.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "proto", "n")


_SESSION = "concat(cast(date as string), ' ', time, ' ', username, ' ', remoteip, ' ', reason)"


@query(
    "stream_dedup",
    f"""select source as host, count(distinct {_SESSION}) as lines from {{v_vpn}} group by source""",
)
def _(t):
    path = scratch_path(t.spark, "repeats")
    lines = t["v_vpn"].select(F.concat_ws("\t", "source", F.expr(_SESSION)).alias("value"))
    for _ in range(2):
        # The same lines land twice, with a restart in between.
        lines.write.mode("append").text(f"{path}/landed")
        arrived = streaming.stream_hosted_lines(t.spark, f"{path}/landed")
        kept = stateful.without_repeats(arrived).withColumn("date", F.to_date("arrived_at"))
        streaming.start_file_sink(kept, f"{path}/kept", f"{path}/checkpoint", None).awaitTermination()
    return ranking.count_by(t.spark.read.parquet(f"{path}/kept"), "host", name="lines")


_CHANGE = "2024-01-15"


@query(
    "stream_ioc_hits",
    f"""select feed_version, host, count(*) as hits from (
          select 1::bigint as feed_version, host from {{v_proxy}} where date < date '{_CHANGE}' and host in (select ip from {{v_otx}})
          union all
          select 2::bigint, host from {{v_proxy}} where date >= date '{_CHANGE}' and host in (select host from {{v_c2}})) h
        group by feed_version, host""",
)
def _(t):
    path = scratch_path(t.spark, "watched")
    events = t["v_proxy"].select("date", "time", "clientip", "host")
    feeds = [t["v_otx"].select(F.col("ip").alias("host")), t["v_c2"].select("host")]
    for feed, part in zip(feeds, (F.col("date") < _CHANGE, F.col("date") >= _CHANGE)):
        # The feed is replaced, then more requests land.
        versions.publish(feed, f"{path}/feed")
        events.where(part).write.mode("append").parquet(f"{path}/landed")
        landed = t.spark.readStream.schema(events.schema).parquet(f"{path}/landed")
        stateful.start_ioc_hits(landed, "host", f"{path}/feed", "host", f"{path}/hits", f"{path}/checkpoint").awaitTermination()
    return ranking.count_by(t.spark.read.parquet(f"{path}/hits"), "feed_version", "host")


@query("stream_progress", "select count(*) as rows from {v_vpn} group by reason")
def _(t):
    path = scratch_path(t.spark, "progress")
    heard = BatchTable(keep=10_000)
    t.spark.streams.addListener(heard)
    try:
        for reason in ("", "User Requested", "Idle Timeout"):
            lines = t["v_vpn"].where(F.col("reason") == reason).select("date", F.col("username").alias("value"))
            lines.coalesce(1).write.mode("append").parquet(f"{path}/landed")
        # One file a batch, so the table of batches tells the rows of each file.
        landed = t.spark.readStream.option("maxFilesPerTrigger", 1).schema("date date, value string").parquet(f"{path}/landed")
        streaming.start_file_sink(landed, f"{path}/kept", f"{path}/checkpoint", None).awaitTermination()
        heard.flush(t.spark, f"{path}/batches")
    finally:
        t.spark.streams.removeListener(heard)
    return t.spark.read.parquet(f"{path}/batches").select("rows")


# Letters whose code units, next to one another, hold the bytes of a line feed.
_TORN = "ਊĀਊ|਀"


@query(
    "src_csv_utf16_large",
    f"""select name0, concat(displayname0, ' {_TORN}') as displayname0, count(*) as n from {{v_sccm}} group by 1, 2""",
)
def _(t):
    path = scratch_path(t.spark, "wide")
    rows = t["v_sccm"].select("name0", F.concat("displayname0", F.lit(f" {_TORN}")).alias("displayname0"), F.lit(1).cast("bigint").alias("n"))
    rows.coalesce(1).write.options(header=True, sep="|", encoding="UTF-16").csv(path)
    schema = StructType([StructField("name0", StringType()), StructField("displayname0", StringType()), StructField("n", LongType())])
    return ranking.count_by(inventory.read_wide_csv(t.spark, path, schema), "name0", "displayname0", name="n")

"""Queries over spans of days, users, versions and nested address ranges."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Window
from pyspark.sql import functions as F

from bindings.queries import _ip_number, query
from vigil.functions.versions import version_key
from vigil.operators import enrich
from vigil.plans import firewall, patch, risk, vpn
from vigil.session import scratch_path

_PACKETS = """
    select srcip, date, count(*) as n, sum(cast(len as hugeint)) as total, sum(cast(len as hugeint) * len) as squares
    from {v_fw} where len is not null and date is not null group by srcip, date"""


@query(
    "fw_pkt_deviation",
    f"""select srcip, cast(date as varchar) as date, n, round(mean, 6) as mean, cast(trailing_n as bigint) as trailing_n,
          round(trailing_mean, 6) as trailing_mean, round(trailing_sd, 6) as trailing_sd,
          round(case when trailing_sd > 0 then (mean - trailing_mean) / trailing_sd end, 6) as deviation
        from (select *, total / n as mean, tt / trailing_n as trailing_mean,
            case when trailing_n > 1 then sqrt(cast(trailing_n * ts - tt * tt as double) / (cast(trailing_n as double) * (trailing_n - 1))) end as trailing_sd
          from (select *, coalesce(sum(n) over w, 0) as trailing_n, sum(total) over w as tt, sum(squares) over w as ts from ({_PACKETS}) p
            window w as (partition by srcip order by date range between interval 7 days preceding and interval 1 day preceding)) q) r""",
)
def _(t):
    found = firewall.packet_deviation(t["v_fw"])
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "trailing_mean", "trailing_sd", "deviation")})


@query(
    "fw_pkt_deviation_by_gateway",
    f"""select srcip as source, cast(date as varchar) as date, n, round(mean, 6) as mean, cast(trailing_n as bigint) as trailing_n,
          round(trailing_mean, 6) as trailing_mean, round(trailing_sd, 6) as trailing_sd,
          round(case when trailing_sd > 0 then (mean - trailing_mean) / trailing_sd end, 6) as deviation
        from (select *, total / n as mean, tt / trailing_n as trailing_mean,
            case when trailing_n > 1 then sqrt(cast(trailing_n * ts - tt * tt as double) / (cast(trailing_n as double) * (trailing_n - 1))) end as trailing_sd
          from (select *, coalesce(sum(n) over w, 0) as trailing_n, sum(total) over w as tt, sum(squares) over w as ts
            from ({_PACKETS.replace('srcip', 'source').replace('select source', 'select source as srcip')}) p
            window w as (partition by srcip order by date range between interval 30 days preceding and interval 1 day preceding)) q) r""",
)
def _(t):
    found = firewall.packet_deviation(t["v_fw"], "source", 30)
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "trailing_mean", "trailing_sd", "deviation")})


_SECONDS = r"""cast(coalesce(try_cast(regexp_extract(duration, '(\d+)d', 1) as bigint), 0) * 86400
    + cast(regexp_extract(duration, '(\d+)h', 1) as bigint) * 3600
    + cast(regexp_extract(duration, '(\d+)m', 1) as bigint) * 60
    + cast(regexp_extract(duration, '(\d+)s', 1) as bigint) as bigint)"""


@query(
    "vpn_session_deviation",
    f"""select cast(s.date as varchar) as date, time, s.username, seconds, trailing_n, median, deviation
        from (select date, time, username, {_SECONDS} as seconds from {{v_vpn}} where duration <> '') s
        join (select d.username, d.date, count(*) as trailing_n, median(o.seconds) as median, mad(cast(o.seconds as double)) as deviation
          from (select distinct username, date from {{v_vpn}} where duration <> '') d
          join (select date, username, {_SECONDS} as seconds from {{v_vpn}} where duration <> '') o
            on o.username = d.username and o.date between d.date - 30 and d.date - 1
          group by d.username, d.date having count(*) >= 5) u on u.username = s.username and u.date = s.date
        where abs(seconds - median) > 3 * deviation""",
)
def _(t):
    return vpn.session_deviation(t["v_vpn"])


# --- users ------------------------------------------------------------------------

_USER = "split_part({}, '@', 1)"
_FEATURES = f"""
    select coalesce(p.usr, v.usr, b.usr, f.usr) as "user", coalesce(requests, 0) as requests, coalesce(denied_requests, 0) as denied_requests,
      coalesce(malware_requests, 0) as malware_requests, coalesce(sites, 0) as sites, coalesce(logins, 0) as logins,
      coalesce(addresses, 0) as addresses, coalesce(foreign_logins, 0) as foreign_logins, coalesce(commands, 0) as commands,
      coalesce(shell_hosts, 0) as shell_hosts, coalesce(cast(denied_packets as bigint), 0) as denied_packets
    from (select {_USER.format('username')} as usr, count(*) as requests, count(*) filter (action = 'DENIED') as denied_requests,
        count(*) filter (categories like '%Mal%') as malware_requests, count(distinct host) as sites from {{v_proxy}} group by 1) p
    full outer join (select {_USER.format('username')} as usr, count(*) as logins, count(distinct remoteip) as addresses,
        count(*) filter (g.cc <> a.c) as foreign_logins
      from {{v_vpn}} v left join {{v_ad}} a on a.emailaddress = v.username
      left join {{v_geo}} g on {_ip_number('v.remoteip')} between g.lo and g.hi group by 1) v on v.usr is not distinct from p.usr
    full outer join (select {_USER.format('username')} as usr, count(*) as commands, count(distinct source) as shell_hosts
      from {{v_bash}} group by 1) b on b.usr is not distinct from coalesce(p.usr, v.usr)
    full outer join (select usr, sum(n) as denied_packets from
        (select distinct clientip, {_USER.format('username')} as usr from {{v_proxy}}) o
        join (select srcip, count(*) as n from {{v_fw}} where action = 'DENY' group by srcip) d on d.srcip = o.clientip group by usr) f
      on f.usr is not distinct from coalesce(p.usr, v.usr, b.usr)"""


def _features(t):
    return risk.user_features(t["v_proxy"], t["v_vpn"], t["v_bash"], t["v_fw"], t["v_ad"], t["v_geo"])


@query("user_risk_features", _FEATURES)
def _(t):
    return _features(t)


# Users taken for risky here: many refused requests for the sessions they have.
_RISKY = "denied_requests * 4 > logins"
_CRC_HELD_OUT = 30


@query(
    "user_risk_model",
    f"""select count(*) as users, count(*) filter ({_RISKY}) as risky, true as accurate from ({_FEATURES}) u""",
)
def _(t):
    features = _features(t).withColumn("risky", F.expr(f"int({_RISKY})"))
    train, held_out = risk.split(features, _CRC_HELD_OUT)
    path = scratch_path(t.spark, "risk_model")
    risk.fit(train).write().save(path)
    scored = risk.score(PipelineModel.load(path), held_out)
    told = held_out.join(scored, held_out["user"].eqNullSafe(scored["user"])).select("risky", "risk")
    right = told.agg(F.avg(F.expr("double(risky = int(risk >= 0.5))")).alias("right"))
    whole = features.agg(F.count("*").alias("users"), F.sum("risky").alias("risky"))
    # One row each, put side by side without a join.
    both = whole.unionByName(right, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in ("users", "risky", "right")])
    return both.select("users", "risky", (F.col("right") >= 0.8).alias("accurate"))


# --- versions ---------------------------------------------------------------------


@query(
    "sccm_outdated_apps",
    """select host, application, version, newest from (
         select host, application, version, rn, max(rn) over (partition by application) as best,
           min(case when rn = top then version end) over (partition by application) as newest
         from (select host, application, max(struct_pack(rn := rn, version := version)).version as version, max(rn) as rn, any_value(top) as top
           from (select name0 as host, displayname0 as application, version0 as version,
               cast(split_part(version0, '#', 2) as bigint) as rn, max(cast(split_part(version0, '#', 2) as bigint)) over (partition by displayname0) as top
             from {v_sccm}) a group by host, application) b) c
       where rn < best""",
)
def _(t):
    return patch.outdated(t["v_sccm"])


@query(
    "sccm_apps_per_user",
    """select displayname0, count(distinct name0) as hosts, count(distinct version0) as versions
       from {v_sccm} group by displayname0""",
)
def _(t):
    return patch.applications(t["v_sccm"])


@query(
    "version_order",
    """select version, row_number() over (order by a, b, kind, c) as place from (
         select distinct concat(cast(l_linenumber as varchar), '.', cast(l_suppkey % 30 as varchar),
             case l_partkey % 3 when 0 then '' when 1 then concat('rc', cast(l_partkey % 12 as varchar)) else concat('.', cast(l_partkey % 12 as varchar)) end) as version,
           l_linenumber as a, l_suppkey % 30 as b, case l_partkey % 3 when 0 then 1 when 1 then 0 else 2 end as kind,
           case l_partkey % 3 when 0 then 0 else l_partkey % 12 end as c from {lineitem}) v""",
)
def _(t):
    last = F.expr(
        "case l_partkey % 3 when 0 then '' when 1 then concat('rc', l_partkey % 12) else concat('.', l_partkey % 12) end"
    )
    texts = t["lineitem"].select(F.concat(F.col("l_linenumber"), F.lit("."), F.expr("l_suppkey % 30"), last).alias("version")).distinct()
    # At most 7 x 30 x 25 different versions, whatever the table.
    place = F.row_number().over(Window.orderBy(version_key(F.col("version"))))
    return texts.select("version", place.cast("bigint").alias("place"))


# --- nested ranges ----------------------------------------------------------------


@query(
    "geo_enrich_nested",
    f"""select v.date, v.time, v.username, v.remoteip, n.cc as remoteipcc from (
          select cast(date as varchar) as date, time, username, remoteip from {{v_vpn}}) v
        left join (select a.remoteip, min(struct_pack(width := g.hi - g.lo + 1, lo := g.lo, cc := g.cc)).cc as cc
          from (select distinct remoteip from {{v_vpn}}) a
          join {{v_geo_nested}} g on {_ip_number('a.remoteip')} between g.lo and g.hi group by a.remoteip) n on n.remoteip = v.remoteip""",
)
def _(t):
    sessions = t["v_vpn"].select("date", "time", "username", "remoteip")
    return enrich.with_narrowest_country(sessions, "remoteip", t["v_geo_nested"], "remoteipcc")

"""Every query with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from bindings.views import Tables, oracle
from vigil import schemas
from vigil.functions import dates, network
from vigil.functions.text import entropy
from vigil.operators import enrich, forensics, groups, indicators, ngrams, parse, ranking
from vigil.plans import commands, dga, firewall, patch, proxy, search, shell, timeline, vpn
from vigil.session import scratch_path, settle
from vigil.sinks import catalog, export, ingest, tables
from vigil.sources import feeds, inventory, lines
from vigil.sources import tables as source_tables
from vigil.streaming import ingest as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``, with its SQL if it has one."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return _plain_types(fn(Tables(spark, folder)))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn

    return register


def _plain_types(df: DataFrame) -> DataFrame:
    """Dates as text, so both engines return the same Python types."""
    days = {f.name: F.col(f.name).cast("string") for f in df.schema if isinstance(f.dataType, DateType)}
    return df.withColumns(days) if days else df


# --- firewall -------------------------------------------------------------------

_LABEL = "concat(cast(dstport as varchar), '/', proto)"


@query(
    "fw_denied_ports",
    f"""select dstport, proto, count(*) as hits, {_LABEL} as port from {{v_fw}} where action = 'DENY'
        group by dstport, proto order by hits desc, dstport, proto limit 10""",
)
def _(t):
    return firewall.denied_ports(t["v_fw"])


def _denied_by(side: str) -> str:
    return f"""select {side}, dstport, proto, count(*) as hits, concat({side}, ' ', {_LABEL}) as label
        from {{v_fw}} where action = 'DENY' group by {side}, dstport, proto
        order by hits desc, {side}, dstport, proto limit 10"""


@query("fw_denied_dst", _denied_by("dstip"))
def _(t):
    return firewall.denied_by(t["v_fw"], "dstip")


@query("fw_denied_src", _denied_by("srcip"))
def _(t):
    return firewall.denied_by(t["v_fw"], "srcip")


@query(
    "fw_dashboard",
    f"""select 'port' as panel, port as label, hits from (
          select {_LABEL} as port, count(*) as hits from {{v_fw}} where action = 'DENY'
          group by dstport, proto order by hits desc, dstport, proto limit 10) a
        union all select 'dstip', label, hits from ({_denied_by('dstip')}) b
        union all select 'srcip', label, hits from ({_denied_by('srcip')}) c""",
)
def _(t):
    return firewall.dashboard_rows(t["v_fw"])


@query(
    "fw_top_talkers",
    """select srcip, dstip, count(*) as hits from {v_fw} where action = 'DENY'
       group by srcip, dstip order by hits desc, srcip, dstip limit 25""",
)
def _(t):
    return firewall.top_talkers(t["v_fw"])


@query("fw_tcp_only", "select cast(date as varchar) as date, * exclude (date) from {v_fw} where proto = 'TCP'")
def _(t):
    return firewall.tcp_only(t["v_fw"])


_WEIGHTS = """(select indicator, cast(sum(n) as bigint) as copies, count(*) as distinct_feeds from (
    select indicator, feed, count(*) as n from (
      select ip as indicator, 'otx' as feed from {v_otx}
      union all select host as indicator, 'c2' as feed from {v_c2}) f
    group by indicator, feed) g group by indicator) w"""


@query(
    "fw_ioc_hits",
    f"""select dstip, count(*) as hits, max(d.distinct_feeds) as distinct_feeds from (
          select fw.dstip from {{v_fw}} fw join {{v_otx}} o on o.ip = fw.dstip
          union all select fw.dstip from {{v_fw}} fw join {{v_c2}} c on c.host = fw.dstip) m
        join {_WEIGHTS.replace(') w', ') d')} on d.indicator = m.dstip group by dstip""",
)
def _(t):
    return firewall.malware_connections(t["v_fw"], t["v_otx"], t["v_c2"])


def _ip_number(column: str) -> str:
    parts = [f"cast(split_part({column}, '.', {i}) as bigint)" for i in range(1, 5)]
    return f"({parts[0]} * 16777216 + {parts[1]} * 65536 + {parts[2]} * 256 + {parts[3]})"


_CIDR = f"""(select lo - lo % size as lo, lo - lo % size + size - 1 as hi, prefix, count(*) as copies from (
    select {_ip_number("split_part(host, '/', 1)")} as lo,
      cast(case when contains(host, '/') then split_part(host, '/', 2) else '32' end as bigint) as prefix,
      cast(pow(2, 32 - cast(case when contains(host, '/') then split_part(host, '/', 2) else '32' end as bigint))
        as bigint) as size
    from {{v_cidr}}) c group by 1, 2, 3) r"""


@query(
    "ioc_cidr_hits",
    f"""select dstip, cast(sum(n * copies) as bigint) as hits, count(*) as matched_ranges from (
          select dstip, {_ip_number('dstip')} as ip, count(*) as n from {{v_fw}} group by dstip) f
        join {_CIDR} on f.ip between r.lo and r.hi group by dstip""",
)
def _(t):
    return indicators.ioc_cidr_hits(t["v_fw"], "dstip", t["v_cidr"], "host")


@query(
    "ip_to_long",
    f"select dstip, {_ip_number('dstip')} as number from (select distinct dstip from {{v_fw}}) f",
)
def _(t):
    ips = t["v_fw"].select("dstip").distinct()
    return ips.withColumn("number", network.ip_to_long(F.col("dstip")))


# --- proxy ----------------------------------------------------------------------


@query(
    "proxy_user_malware",
    """select clientip, username, host, port, path, query, count(*) as hits from {v_proxy}
       where username like 'u1%' and categories like '%Mal%'
       group by clientip, username, host, port, path, query""",
)
def _(t):
    return proxy.user_malware(t["v_proxy"], "u1%")


@query(
    "top_transfers",
    """select distinct clientip, host, cast(csbytes as double) as bytes from {v_proxy}
       order by bytes desc, clientip, host limit 10""",
)
def _(t):
    return proxy.top_transfers(t["v_proxy"])


@query(
    "top_transfer_totals",
    """select clientip, host, cast(sum(csbytes) as bigint) as bytes from {v_proxy}
       group by clientip, host order by bytes desc, clientip, host limit 10""",
)
def _(t):
    return proxy.top_transfer_totals(t["v_proxy"])


@query(
    "rare_user_agents",
    "select agent, count(*) as hits from {v_proxy} group by agent order by hits, agent limit 500",
)
def _(t):
    return proxy.rare_agents(t["v_proxy"])


@query(
    "top_hosts",
    "select host, count(*) as hits from {v_proxy} group by host order by hits desc, host limit 15",
)
def _(t):
    return proxy.top_hosts(t["v_proxy"])


@query(
    "top_malware_hosts",
    """select host, count(*) as hits from {v_proxy} where categories like '%Mal%'
       group by host order by hits desc, host limit 15""",
)
def _(t):
    return proxy.top_hosts(t["v_proxy"], category_like=proxy.MALWARE)


@query(
    "outdated_clients",
    "select distinct clientip, agent from {v_proxy} where agent like '%NT 5.1%'",
)
def _(t):
    return proxy.outdated_clients(t["v_proxy"])


@query(
    "proxy_ioc_hits",
    f"""select host, count(*) as hits, max(d.distinct_feeds) as distinct_feeds from (
          select px.host from {{v_proxy}} px join {{v_otx}} o on o.ip = px.host
          union all select px.host from {{v_proxy}} px join {{v_c2}} c on c.host = px.host) m
        join {_WEIGHTS.replace(') w', ') d')} on d.indicator = m.host
        group by host order by hits desc, host limit 20""",
)
def _(t):
    return proxy.intel_hits(t["v_proxy"], t["v_otx"], t["v_c2"])


@query(
    "proxy_ioc_users",
    """select clientip, username, host, categories, count(*) as hits
       from {v_proxy} px, {v_otx} o where px.host = o.ip
       group by clientip, username, host, categories""",
)
def _(t):
    return proxy.intel_users(t["v_proxy"], t["v_otx"])


@query("distinct_hosts", "select distinct host from {v_proxy}")
def _(t):
    return t["v_proxy"].select("host").distinct()


# --- VPN ------------------------------------------------------------------------


@query(
    "vpn_logins_by_user",
    """select distinct cast(date as varchar) as date, time, remoteip, reason from {v_vpn}
       where username = 'u7@corp.example'""",
)
def _(t):
    return vpn.logins(t["v_vpn"], "u7@corp.example")


@query(
    "vpn_ips_by_user",
    """select remoteip, count(*) as hits, case when count(*) < 10 then 'Unusual' else 'Normal' end as activity
       from {v_vpn} where username = 'u7@corp.example' group by remoteip""",
)
def _(t):
    return vpn.ips_by_user(t["v_vpn"], "u7@corp.example")


def _foreign(by: str) -> str:
    return f"""select {by}, count(*) as hits from (
        select v.username, v.remoteip, g.cc as remoteipcc, a.c
        from {{v_vpn}} v join {{v_ad}} a on a.emailaddress = v.username
        left join {{v_geo}} g on {_ip_number('v.remoteip')} between g.lo and g.hi) l
      where remoteipcc <> c group by {by}"""


@query("vpn_foreign_logins", _foreign("username, remoteip, remoteipcc, c"))
def _(t):
    return vpn.foreign_logins(t["v_vpn"], t["v_ad"], t["v_geo"])


@query("vpn_foreign_by_country", _foreign("remoteipcc"))
def _(t):
    return vpn.foreign_logins(t["v_vpn"], t["v_ad"], t["v_geo"], ("remoteipcc",))


@query("vpn_foreign_by_user_country", _foreign("username, remoteipcc"))
def _(t):
    return vpn.foreign_logins(t["v_vpn"], t["v_ad"], t["v_geo"], ("username", "remoteipcc"))


@query(
    "vpn_identify_user",
    """select username from {v_vpn} where date = date '2024-01-10' and remoteip = '203.0.113.9'""",
)
def _(t):
    return vpn.identify_user(t["v_vpn"], "203.0.113.9", "2024-01-10")


@query(
    "geo_enrich",
    f"""select cast(v.date as varchar) as date, v.time, v.username, v.remoteip, g.cc as remoteipcc
        from {{v_vpn}} v left join {{v_geo}} g on {_ip_number('v.remoteip')} between g.lo and g.hi""",
)
def _(t):
    sessions = t["v_vpn"].select("date", "time", "username", "remoteip")
    return enrich.with_country(sessions, "remoteip", t["v_geo"], "remoteipcc")


@query(
    "vpn_duration_seconds",
    r"""select duration, cast(
          coalesce(try_cast(regexp_extract(duration, '(\d+)d', 1) as bigint), 0) * 86400
          + cast(regexp_extract(duration, '(\d+)h', 1) as bigint) * 3600
          + cast(regexp_extract(duration, '(\d+)m', 1) as bigint) * 60
          + cast(regexp_extract(duration, '(\d+)s', 1) as bigint) as bigint) as seconds
        from (select distinct duration from {v_vpn} where duration <> '') d""",
)
def _(t):
    texts = t["v_vpn"].select("duration").filter("duration <> ''").distinct()
    return texts.withColumn("seconds", dates.vpn_duration_seconds(F.col("duration")))


# --- shell commands -------------------------------------------------------------


@query(
    "bash_keyword",
    "select source, username, exec_as, srcip, command from {v_bash} where command like '%en%'",
)
def _(t):
    return shell.search(t["v_bash"], "command", "%en%")


@query(
    "bash_user",
    "select source, username, exec_as, srcip, command from {v_bash} where username like 'u1%'",
)
def _(t):
    return shell.search(t["v_bash"], "username", "u1%")


# --- software inventory and timeline ---------------------------------------------


def _software(where: str) -> str:
    return f"""select software, hits from (
        select displayname0, version0, concat(displayname0, ' ', version0) as software, count(*) as hits
        from {{v_sccm}} where crit_x_cat = 'High' {where} group by displayname0, version0
        order by hits desc, displayname0, version0 limit 10) s"""


_PANELS = {
    "all": "",
    "ncsa": "and region_x = 'NCSA' and zone_x = 'Corp'",
    "emea": "and region_x = 'EMEA' and zone_x = 'Corp'",
    "apac": "and region_x = 'APAC' and zone_x = 'Corp'",
    "onbe": "and zone_x = 'ONBE'",
    "corp": "and zone_x = 'Corp'",
}


def _patch_panel(name: str, region: str | None, zone: str | None):
    @query(f"patch_top_{name}", _software(_PANELS[name]))
    def _(t):
        return patch.top_software(t["v_sccm"], "High", region, zone)


for _panel, (_region, _zone) in patch.PANELS.items():
    _patch_panel(_panel, _region, _zone)


@query(
    "patch_dashboard",
    " union all ".join(
        f"select '{name}' as panel, software, hits from ({_software(where)}) p_{name}"
        for name, where in _PANELS.items()
    ),
)
def _(t):
    return patch.dashboard_rows(t["v_sccm"])


@query(
    "patch_top_function",
    """select hostfn_x, count(*) as hits from {v_sccm} where crit_x_cat = 'High'
       group by hostfn_x order by hits desc, hostfn_x limit 10""",
)
def _(t):
    return patch.top_functions(t["v_sccm"])


@query(
    "patch_hosts",
    """select name0 as host from {v_sccm} where region_x = 'EMEA' and exclude_x is null
       and displayname0 like '%widget%'""",
)
def _(t):
    # Inventory names are lower-case here, while the question capitalises its term.
    named = t["v_sccm"].withColumn("displayname0", F.initcap("displayname0"))
    return patch.hosts_with(named, "emea", "widget")


@query(
    "patch_region_matrix",
    "select region_x as region, "
    + ", ".join(
        f"count(*) filter (product = '{p}') as {p.replace('-', '_')}" for p in schemas.SITE_PRODUCTS
    )
    + " from {v_sccm} group by region_x",
)
def _(t):
    counted = ranking.count_by(t["v_sccm"], "region_x", "product")
    nested = counted.agg(
        *[
            F.struct(
                *[
                    F.coalesce(
                        F.sum(F.when((F.col("region_x") == r) & (F.col("product") == p), F.col("hits"))),
                        F.lit(0),
                    ).alias(r)
                    for r in schemas.SITE_REGIONS
                ]
            ).alias(p)
            for p in schemas.SITE_PRODUCTS
        ]
    )
    path = scratch_path(t.spark, "sites")
    nested.write.json(path)
    return patch.region_matrix(inventory.read_site_matrix(t.spark, path))


@query(
    "timeline_deleted",
    """select date, count(*) as hits from {v_timeline} where short like '%DELETED%'
       group by date order by hits desc, date limit 15""",
)
def _(t):
    return timeline.deleted_per_day(t["v_timeline"])


@query(
    "timeline_filetypes",
    " union all ".join(
        f"select '{e}' as filetype, count(*) as hits from {{v_timeline}} where short like '%{e}'"
        for e in ("zip", "pdf", "exe")
    ),
)
def _(t):
    return timeline.file_types(t["v_timeline"])


# --- ad-hoc SQL -----------------------------------------------------------------

_ADHOC = """select host, categories, count(*) as hits from {v_proxy}
    where categories like 'Mal%' and date between date '2024-01-05' and date '2024-01-20'
    group by host, categories order by hits desc, host limit 100"""


@query("adhoc_search", _ADHOC)
def _(t):
    return search.search(
        t.spark,
        {"proxysg": t["v_proxy"]},
        "2024-01-05",
        "2024-01-20",
        "select host, categories, count(*) as hits from proxysg where categories like :category "
        "group by host, categories order by hits desc, host",
        {"category": "Mal%"},
        100,
    )


@query(
    "adhoc_sql",
    """select f.proto, v.reason, count(*) as days from
         (select distinct date, proto from {v_fw}) f, (select distinct date, reason from {v_vpn}) v
       where extract(day from f.date) = extract(day from v.date) group by f.proto, v.reason""",
)
def _(t):
    return search.sql_over(
        t.spark,
        {"fw": t["v_fw"], "ciscovpn": t["v_vpn"]},
        "select f.proto, v.reason, count(*) as days from (select distinct date, proto from fw) f "
        "join (select distinct date, reason from ciscovpn) v on day(f.date) = day(v.date) "
        "group by f.proto, v.reason",
    )


# --- parsing --------------------------------------------------------------------

# Every column of the parsed tables; the time of the event as text.
_EVENT_TS = "strftime(cast(concat(cast(date as varchar), ' ', time) as timestamp), '%Y-%m-%d %H:%M:%S') as event_ts"
_TLS_COLUMNS = ("tlsver", "tlscipher", "ciphersize")
_PROXY_SQL = (
    "select cast(date as varchar) as date, " + _EVENT_TS + ", {tls}, "
    + ", ".join(n for n in schemas.PROXYSG.names if n not in ("date", "event_ts", *_TLS_COLUMNS))
    + " from {{v_proxy}}"
)


def _as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("event_ts", F.col("event_ts").cast("string"))


@query("parse_proxy_plain", _PROXY_SQL.format(tls="'' as tlsver, '' as tlscipher, '' as ciphersize"))
def _(t):
    return _as_text(parse.parse_proxy(t["l_proxy_plain"]))


@query("parse_proxy_tls", _PROXY_SQL.format(tls="'TLSv1.2' as tlsver, tlscipher, ciphersize"))
def _(t):
    return _as_text(parse.parse_proxy(t["l_proxy_tls"]))


@query("parse_fw", f"select cast(date as varchar) as date, {_EVENT_TS}, * exclude (date) from {{v_fw}}")
def _(t):
    return _as_text(parse.parse_fw(t["l_fw"], asof=F.col("arrived_at")))


_VPN_COLUMNS = "time, source, username, remoteip, localip, duration, bytesxmt, bytesrcv, reason"
_SECONDS = """coalesce(try_cast(regexp_extract(duration, '([0-9]+)d', 1) as bigint), 0) * 86400
    + cast(regexp_extract(duration, '([0-9]+)h', 1) as bigint) * 3600
    + cast(regexp_extract(duration, '([0-9]+)m', 1) as bigint) * 60
    + cast(regexp_extract(duration, '([0-9]+)s', 1) as bigint)"""


@query(
    "parse_vpn_login",
    f"""select cast(date as varchar) as date, {_EVENT_TS}, {_VPN_COLUMNS}, cast(null as bigint) as duration_sec
        from {{v_vpn}} where duration = ''""",
)
def _(t):
    return _as_text(parse.parse_vpn(t["l_vpn"], asof=F.col("arrived_at")).filter("duration = ''"))


@query(
    "parse_vpn_logout",
    f"""select cast(date as varchar) as date, {_EVENT_TS}, {_VPN_COLUMNS}, {_SECONDS} as duration_sec
        from {{v_vpn}} where duration <> ''""",
)
def _(t):
    return _as_text(parse.parse_vpn(t["l_vpn"], asof=F.col("arrived_at")).filter("duration <> ''"))


@query(
    "parse_bash",
    """select cast(date as varchar) as date, source, username, exec_as, srcip,
       replace(command, chr(10), ' ') as command from {v_bash}""",
)
def _(t):
    return parse.parse_bash(t["l_bash"], asof=F.col("arrived_at"))


@query(
    "parse_bash_warn",
    """select cast(date as varchar) as date, source, username, 'no tty' as exec_as, '' as srcip,
       replace(command, chr(10), ' ') as command from {v_bash}""",
)
def _(t):
    return parse.parse_bash(t["l_bash_warn"], asof=F.col("arrived_at"))


@query(
    "parse_apache",
    """select cast(date as varchar) as date, ip_address, '-' as client_identd, user_id, method, endpoint,
       'HTTP/1.1' as protocol, response_code, content_size,
       strftime(cast(concat(cast(date as varchar), ' ', time) as timestamp), '%Y-%m-%d %H:%M:%S') as event_ts,
       strftime(cast(concat(cast(date as varchar), ' ', time) as timestamp), '%d/%b/%Y:%H:%M:%S +0000') as date_time
       from {v_apache}""",
)
def _(t):
    return _as_text(parse.parse_apache(t["l_apache"]))


def _mixed(t: Tables) -> DataFrame:
    """Lines of four kinds, plus text lines of no kind."""
    kinds = [t[n].select("value") for n in ("l_fw", "l_proxy_plain", "l_vpn", "l_bash")]
    noise = t["v_doc_lines"].select("value")
    return kinds[0].unionAll(kinds[1]).unionAll(kinds[2]).unionAll(kinds[3]).unionAll(noise)


@query(
    "route_lines",
    """select 'fw' as kind, count(*) as n from {v_fw} union all select 'proxysg', count(*) from {v_proxy}
       union all select 'ciscovpn', count(*) from {v_vpn} union all select 'bash', 2 * count(*) from {v_bash}
       union all select 'unknown', count(*) from {v_doc_lines}""",
)
def _(t):
    # Shell lines of hosts that are named like firewalls carry two marks.
    two_marks = t["l_bash"].select(F.replace("value", F.lit(" host"), F.lit(" dc1-fw")).alias("value"))
    return ranking.count_by(parse.route(_mixed(t).unionAll(two_marks)), "kind", name="n")


@query("ingest_rejects", "select 'unknown' as kind, value from {v_doc_lines}")
def _(t):
    path = scratch_path(t.spark, "rejects")
    tables.store_rejects(parse.rejects(parse.split_routed(_mixed(t), year=2024)), path, "only")
    return t.spark.read.schema("value string, kind string").text(path).select("kind", "value")


@query(
    "syslog_date",
    """select stamp, cast(case when cast(concat(y, '-', m, '-', d) as date) <= arrived + 1
           then cast(concat(y, '-', m, '-', d) as date)
           else cast(concat(cast(y as bigint) - 1, '-', m, '-', d) as date) end as varchar) as day,
         cast(arrived as varchar) as arrived
       from (select strftime(o_orderdate, '%b %d') as stamp, strftime(o_orderdate, '%m') as m,
           strftime(o_orderdate, '%d') as d, arrived, strftime(arrived, '%Y') as y
         from (select distinct o_orderdate, cast(o_orderdate as date) + cast(o_custkey % 20 as integer) as arrived
           from {orders}) o) s""",
)
def _(t):
    stamps = t["orders"].select(
        F.date_format("o_orderdate", "MMM dd").alias("stamp"),
        F.col("o_orderdate"),
        F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_custkey") % 20).cast("int")).alias("arrived"),
    ).distinct()
    return stamps.select("stamp", "arrived", dates.syslog_date(F.col("stamp"), F.col("arrived")).alias("day"))


@query("parse_pslist", "select image, process from {v_process}")
def _(t):
    rows = forensics.parse_pslist(t["l_pslist"])
    # The name column keeps everything up to the six numbers.
    return rows.withColumn("process", F.regexp_extract("process", r"^(\S+)", 1))


@query(
    "parse_imageinfo",
    """select distinct image, concat('Win7SP1x86_', image) as profile, concat('0x82', image, 'L') as kdbg
       from {v_process}""",
)
def _(t):
    return forensics.parse_imageinfo(t["l_imageinfo"])


# --- feeds ----------------------------------------------------------------------


def _as_lines(df: DataFrame, text: str) -> DataFrame:
    return df.selectExpr(f"{text} as value")


@query("parse_otx", "select ip, reason from {v_otx_feed}")
def _(t):
    landed = _as_lines(t["v_otx_feed"], "concat(ip, '#4#2#', reason, '#US#City#1.0,2.0#11')")
    return feeds.parse_otx(landed.unionAll(_as_lines(t["v_otx_feed"], "''")))


@query(
    "parse_c2",
    """select host, 'C2' as reason from {v_c2_feed} union all select '' as host, '' as reason from {part}""",
)
def _(t):
    return feeds.parse_c2(_as_lines(t["v_c2_feed"], "host").unionAll(_as_lines(t["part"], "p_name")))


@query("parse_openphish", "select url, 'OpenPhish' as reason from {pages}")
def _(t):
    return feeds.parse_openphish(_as_lines(t["pages"], "concat('  ', url, '\t ')"))


@query("feed_rules", "select host as value from {v_cidr_feed}")
def _(t):
    rules = _as_lines(t["v_cidr_feed"], "concat('-A FEED -p ip -s ', host, ' -j DROP')")
    return feeds.feed_rules(rules.unionAll(_as_lines(t["part"], "concat('# rule for ', p_name)")))


@query("feed_hostsfile", "select host as value from {v_c2_feed}")
def _(t):
    entries = _as_lines(t["v_c2_feed"], "concat('127.0.0.1\t', host, '\tlisted')")
    return feeds.feed_hostsfile(entries.unionAll(_as_lines(t["part"], "concat('#\t', p_name)")))


@query("feed_domains", "select domain as value from {v_domains}")
def _(t):
    entries = _as_lines(t["v_domains"], "concat('\t\t', domain, '\tmalware\tlist\t20240101')")
    return feeds.feed_domains(entries.unionAll(_as_lines(t["part"], "concat('#\t', p_name)")))


@query("feed_csvlist", "select domain as value from {v_domains}")
def _(t):
    return feeds.feed_csvlist(_as_lines(t["v_domains"], "concat(' ', domain, ' ,', category, ',2024')"))


@query("feed_urllist", "select domain as value from {v_domains}")
def _(t):
    return feeds.feed_urllist(_as_lines(t["v_domains"], "concat(domain, '/a/b?c=', category)"))


@query(
    "feed_c2_union",
    """select distinct value as host, 'C2' as reason from (
         select host as value from {v_cidr_feed} union all select host from {v_c2_feed}
         union all select domain from {v_domains}) u""",
)
def _(t):
    every = feeds.union_indicators(
        feeds.feed_rules(_as_lines(t["v_cidr_feed"], "concat('-A FEED -p ip -s ', host, ' -j DROP')")),
        feeds.feed_hostsfile(_as_lines(t["v_c2_feed"], "concat('127.0.0.1\t', host)")),
        feeds.feed_domains(_as_lines(t["v_domains"], "concat('\t\t', domain, '\ta\tb\tc')")),
        feeds.feed_csvlist(_as_lines(t["v_domains"], "concat(domain, ',x')")),
        feeds.feed_urllist(_as_lines(t["v_domains"], "concat(domain, '/x ', domain, '/y')")),
    )
    return feeds.parse_c2(every)


@query("feed_snapshot", "select ip, reason from {v_otx_feed}")
def _(t):
    path = scratch_path(t.spark, "feed")
    landed = _as_lines(t["v_otx_feed"], "concat(ip, '#4#2#', reason, '#US')")
    landed.write.text(f"{path}/raw")
    for _run in range(2):
        ingest.ingest_feed(t.spark, "alienvault_otx", f"{path}/raw", path)
    return source_tables.read_table(t.spark, f"{path}/otx", schemas.OTX)


# --- sources --------------------------------------------------------------------

_LENGTHS = "select length(value) as size, count(*) as n from {v_doc_lines} %s group by length(value)"


def _text_folders(t: Tables) -> str:
    path = scratch_path(t.spark, "text")
    t["v_doc_lines"].write.partitionBy("lang").text(path)
    return path


def _lengths(df: DataFrame) -> DataFrame:
    return df.groupBy(F.length("value").cast("bigint").alias("size")).agg(F.count(F.lit(1)).alias("n"))


@query("src_text_recursive", _LENGTHS % "")
def _(t):
    return _lengths(lines.read_lines(t.spark, _text_folders(t)))


@query("src_text_glob", _LENGTHS % "where lang like 'e%'")
def _(t):
    return _lengths(lines.read_lines(t.spark, f"{_text_folders(t)}/lang=e*", recursive=False))


@query(
    "src_parquet",
    """select l_returnflag, count(*) as n, cast(sum(cast(l_quantity as bigint)) as bigint) as quantity
       from {lineitem} group by l_returnflag""",
)
def _(t):
    items = source_tables.read_table(t.spark, f"{t.folder}/lineitem.parquet")
    return items.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity")
    )


def _dated_proxy(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "proxysg")
    tables.append_path(t["v_proxy"], path)
    return source_tables.read_table(t.spark, path)


@query(
    "scan_date_range",
    """select cast(date as varchar) as date, host, cast(sum(csbytes) as bigint) as bytes from {v_proxy}
       where date between date '2024-01-10' and date '2024-01-19' group by date, host""",
)
def _(t):
    part = source_tables.date_slice(_dated_proxy(t), "2024-01-10", "2024-01-19")
    return part.groupBy("date", "host").agg(F.sum("csbytes").alias("bytes"))


@query(
    "scan_date_prefix",
    """select cast(date as varchar) as date, count(*) as n from {v_proxy}
       where strftime(date, '%Y-%m-%d') like '2024-01-2%' group by date""",
)
def _(t):
    return ranking.count_by(source_tables.date_prefix(_dated_proxy(t), "2024-01-2"), "date", name="n")


@query(
    "date_spine",
    """select cast(d.day as varchar) as date, count(e.event_id) as n
       from (select cast(unnest(generate_series(timestamp '2023-12-25', timestamp '2024-02-05', interval 1 day))
         as date) as day) d left join {events} e on cast(e.ts as date) = d.day group by d.day""",
)
def _(t):
    days = dates.date_spine(t.spark, "2023-12-25", "2024-02-05")
    counted = t["events"].groupBy(F.col("ts").cast("date").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return days.join(counted, "date", "left").select("date", F.coalesce("n", F.lit(0)).alias("n"))


@query("src_csv", "select emailaddress, c from {v_ad}")
def _(t):
    path = scratch_path(t.spark, "directory")
    t["v_ad"].write.option("header", True).csv(path)
    return inventory.read_directory(t.spark, path, drop_blank=True)


@query("src_csv_utf16", "select name0, displayname0, count(*) as n from {v_sccm} group by name0, displayname0")
def _(t):
    path = scratch_path(t.spark, "system")
    systems = t["v_sccm"].select("name0", "displayname0")
    systems.write.options(header=True, sep="|", encoding="UTF-16").csv(path)
    return ranking.count_by(
        inventory.read_inventory_csv(t.spark, path, systems.schema), "name0", "displayname0", name="n"
    )


@query(
    "src_json",
    """select name0, displayname0, version0, region_x, zone_x, crit_x_cat, exclude_x from {v_sccm}""",
)
def _(t):
    path = scratch_path(t.spark, "inventory")
    wanted = ["Name0", "DisplayName0", "Version0", "Region_X", "Zone_X", "crit_X_cat", "Exclude_X"]
    t["v_sccm"].select(*[F.col(c.lower()).alias(c) for c in wanted]).write.json(path)
    read = inventory.read_inventory_json(t.spark, path)
    return read.select(*[F.col(c).alias(c.lower()) for c in wanted])


@query("src_timeline_csv", "select date, short from {v_timeline}")
def _(t):
    path = scratch_path(t.spark, "timeline")
    t["v_timeline"].write.option("header", True).csv(path)
    return inventory.read_timeline_csv(t.spark, path)


@query("src_rank_list", "select page_id as rank, url as domain from {pages}")
def _(t):
    path = scratch_path(t.spark, "ranks")
    t["pages"].select("page_id", "url").write.csv(path)
    return inventory.read_rank_list(t.spark, path)


_DAY = "cast(concat('2024-01-', lpad(cast(1 + srcport % 28 as {text}), 2, '0')) as date)"


def _stored_days(t: Tables, rows: DataFrame, start: str, end: str) -> DataFrame:
    """Days of a table that was stored, read through its date partitions."""
    path = scratch_path(t.spark, "days")
    tables.store(rows, path, "one")
    return source_tables.date_slice(source_tables.read_table(t.spark, path).drop("batch"), start, end)


@query(
    "top_hosts_dated",
    """select host, count(*) as hits from {v_proxy} where date between date '2024-01-05' and date '2024-01-12'
       group by host order by hits desc, host limit 15""",
)
def _(t):
    return proxy.top_hosts(_stored_days(t, t["v_proxy"], "2024-01-05", "2024-01-12"))


@query(
    "fw_denied_ports_dated",
    f"""select dstport, proto, count(*) as hits, {_LABEL} as port from {{v_fw}} where action = 'DENY'
        and {_DAY.format(text='varchar')} between date '2024-01-10' and date '2024-01-19'
        group by dstport, proto order by hits desc, dstport, proto limit 10""",
)
def _(t):
    days = t["v_fw"].withColumn("date", F.expr(_DAY.format(text="string")))
    return firewall.denied_ports(_stored_days(t, days, "2024-01-10", "2024-01-19"))


@query(
    "bash_keyword_dated",
    """select source, username, exec_as, srcip, command from {v_bash}
       where command like '%the%' and date between date '2024-01-02' and date '2024-01-04'""",
)
def _(t):
    return shell.search(_stored_days(t, t["v_bash"], "2024-01-02", "2024-01-04"), "command", "%the%")


# --- sinks ----------------------------------------------------------------------

_VPN_SQL = f"select cast(date as varchar) as date, {_VPN_COLUMNS} from {{v_vpn}}"


@query("ingest_append", _VPN_SQL)
def _(t):
    path = scratch_path(t.spark, "batch")
    t["l_vpn"].select("value").write.text(f"{path}/raw")
    ingest.ingest_logs(t.spark, "ciscovpn", f"{path}/raw", path, year=2024)
    read = source_tables.read_events(t.spark, path, "ciscovpn")
    return read.select("date", *_VPN_COLUMNS.split(", "))


@query("ingest_replace_dates", _VPN_SQL)
def _(t):
    path = scratch_path(t.spark, "replace")
    sessions = t["v_vpn"].select("date", *_VPN_COLUMNS.split(", "))
    # The second run replaces each day by itself.
    for _run in range(2):
        tables.replace_dates(sessions, path)
    return source_tables.read_table(t.spark, path)


@query(
    "catalog_load",
    """select cast(extract(year from date) as smallint) as year, cast(extract(month from date) as smallint) as month,
       cast(extract(day from date) as smallint) as day, username, count(*) as n from {v_bash}
       group by 1, 2, 3, 4""",
)
def _(t):
    path = scratch_path(t.spark, "catalog")
    t["v_bash"].drop("date").write.parquet(f"{path}/like")
    table = "shell_" + path.rsplit("-", 1)[1]
    catalog.create_like(t.spark, f"{path}/like", table, f"{path}/table")
    catalog.load_days(t["v_bash"], table)
    return ranking.count_by(t.spark.table(table), "year", "month", "day", "username", name="n")


@query(
    "catalog_partitions",
    """select cast(extract(year from date) as smallint) as year, cast(extract(month from date) as smallint) as month,
       cast(extract(day from date) as smallint) as day, username, count(*) as n from {v_bash}
       group by 1, 2, 3, 4""",
)
def _(t):
    path = scratch_path(t.spark, "partitions")
    shell_rows = t["v_bash"]
    shell_rows.drop("date").write.parquet(f"{path}/like")
    table = "parts_" + path.rsplit("-", 1)[1]
    catalog.create_like(t.spark, f"{path}/like", table, f"{path}/table")
    # One day is loaded by itself, one is registered after another job has written it.
    day = F.dayofmonth("date")
    catalog.load_partition(shell_rows.where(day == 1).drop("date"), table, 2024, 1, 1)
    shell_rows.where(day == 2).drop("date").write.parquet(f"{path}/table/year=2024/month=1/day=2")
    catalog.add_partition(t.spark, table, 2024, 1, 2)
    catalog.load_days(shell_rows.where(day > 2), table)
    return ranking.count_by(t.spark.table(table), "year", "month", "day", "username", name="n")


@query("append_by_name", _VPN_SQL)
def _(t):
    path = scratch_path(t.spark, "named")
    table = "vpn_" + path.rsplit("-", 1)[1]
    sessions = t["v_vpn"].select("date", *_VPN_COLUMNS.split(", "))
    logins = F.col("duration") == ""
    for part in (sessions.where(logins), sessions.where(~logins)):
        tables.append(part, table, path)
    return t.spark.table(table)


@query("export_json", "select source, username, exec_as, srcip, command from {v_bash}")
def _(t):
    documents = export.to_json_rows(t["v_bash"].drop("date"))
    schema = t["v_bash"].drop("date").schema
    return documents.select(F.from_json("value", schema).alias("row")).select("row.*")


@query("export_gzip", "select source, username, exec_as, srcip, command from {v_bash}")
def _(t):
    path = scratch_path(t.spark, "export")
    export.write_gzip_json(t["v_bash"].drop("date"), path)
    return t.spark.read.schema(t["v_bash"].drop("date").schema).json(path)


# --- groups by size -------------------------------------------------------------


@query(
    "rare_groups",
    "select username, host, count(*) as hits from {v_proxy} group by username, host having count(*) < 3",
)
def _(t):
    return groups.rare_groups(t["v_proxy"], "username", "host", below=3)


@query("big_groups", "select host, count(*) as hits from {v_proxy} group by host having count(*) > 100")
def _(t):
    return groups.big_groups(t["v_proxy"], "host", above=100)


@query(
    "rare_group_rows",
    """select cast(date as varchar) as date, time, username, host, path from {v_proxy} p
       where (username, host) in (select username, host from {v_proxy} group by username, host
         having count(*) < 3)""",
)
def _(t):
    rows = t["v_proxy"].select("date", "time", "username", "host", "path")
    rare = groups.rare_groups(rows, "username", "host", below=3)
    return groups.rows_in(rows, rare, "username", "host")


@query(
    "big_group_commands",
    """select distinct command from {v_bash} where source in (
         select source from {v_bash} group by source order by count(*) desc, source limit 10)""",
)
def _(t):
    return commands.largest(t["v_bash"], 10, "source")


@query(
    "cmd_outlier_lines",
    """select concat(command, ' -> Seen on: ', cast(date as varchar)) as line from (
         select distinct * from {v_bash} where username in (
           select username from {v_bash} group by username having count(*) < 11)) b""",
)
def _(t):
    return commands.outlier_lines(commands.outliers(t["v_bash"], 11, "username"))


@query(
    "cluster_members",
    "select source as cluster, command, count(*) as hits from {v_bash} group by source, command",
)
def _(t):
    return commands.members(t["v_bash"], "source")


# --- domains --------------------------------------------------------------------

_ENTROPY = """select domain, round(0 - sum(p * log2(p)), 6) as entropy from (
    select domain, c, cast(count(*) as double) / length(domain) as p from (
      select domain, unnest(string_split(domain, '')) as c from (%s) s) u group by domain, c) f
    group by domain"""
_DISTINCT_DOMAINS = "select distinct domain from {v_domains}"


@query("domain_entropy", _ENTROPY % _DISTINCT_DOMAINS)
def _(t):
    names = t["v_domains"].select("domain").distinct()
    return names.select("domain", F.round(entropy(F.col("domain")), 6).alias("entropy"))


@query(
    "domain_stats",
    """select category, length(domain) as length, count(*) as n from {v_domains}
       group by category, length(domain)""",
)
def _(t):
    return t["v_domains"].groupBy("category", F.length("domain").cast("bigint").alias("length")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _lists(t: Tables) -> dict:
    return {
        name: (t["v_domains"].filter(F.col("category") == name), "domain") for name in ("dga", "legit")
    }


@query(
    "dga_corpus",
    f"""select d.domain, d.category, cast(length(d.domain) as double) as length, e.entropy
        from (select domain, category from {{v_domains}} union all select word, 'dict' from {{v_words}}) d
        join ({_ENTROPY % (_DISTINCT_DOMAINS + " union select word as domain from {v_words}")}) e
        on d.domain = e.domain""",
)
def _(t):
    rows = dga.corpus({**_lists(t), "dict": (t["v_words"], "word")})
    return rows.withColumn("entropy", F.round("entropy", 6))


def _grams(source: str, column: str) -> str:
    """(doc, gram) of every occurrence."""
    return f"""select doc, substr(doc, i, n) as gram from (
        select doc, n, unnest(range(1, length(doc) - n + 2)) as i from (
          select {column} as doc, unnest([3, 4, 5]) as n from {source}) a) b"""


def _vocab(source: str, column: str, min_df: float) -> str:
    return f"""select gram, count(distinct doc) as docs, count(*) as total, log10(count(*)) as weight
        from ({_grams(source, column)}) g group by gram
        having count(distinct doc) >= {min_df} * (select count(*) from {source})"""


_LEGIT = "(select domain from {v_domains} where category = 'legit')"
_WORDS = "(select word from {v_words})"


@query("ngram_vocab", f"select gram, docs, total, round(weight, 6) as weight from ({_vocab(_WORDS, 'word', 0.002)}) v")
def _(t):
    return ngrams.ngram_vocab(t["v_words"], "word", 0.002).withColumn("weight", F.round("weight", 6))


def _score(name: str, vocab: str, source: str = "(select distinct domain from {v_domains})") -> str:
    return f"""select doc, round(sum(v.weight), 6) as {name} from ({_grams(source, 'domain')}) s
        join ({vocab}) v on v.gram = s.gram group by doc"""


_SCORES = f"""left join ({_score('legit_grams', _vocab(_LEGIT, 'domain', 0.0001))}) l on l.doc = d.domain
    left join ({_score('word_grams', _vocab(_WORDS, 'word', 0.00001))}) w on w.doc = d.domain"""


def _vocabularies(t: Tables) -> tuple[DataFrame, DataFrame]:
    legit = t["v_domains"].filter("category = 'legit'")
    return (
        ngrams.ngram_vocab(legit, "domain", dga.MIN_DF_LEGIT),
        ngrams.ngram_vocab(t["v_words"], "word", dga.MIN_DF_WORDS),
    )


@query(
    "ngram_score",
    f"""select d.domain, coalesce(l.legit_grams, 0) as legit_grams, coalesce(w.word_grams, 0) as word_grams
        from (select distinct domain from {{v_domains}}) d {_SCORES}""",
)
def _(t):
    legit, words = _vocabularies(t)
    scored = ngrams.ngram_score(t["v_domains"].select("domain"), "domain", {"legit": legit, "word": words})
    return scored.withColumns({c: F.round(c, 6) for c in ("legit_grams", "word_grams")})


@query(
    "dga_features",
    f"""select d.domain, d.category, cast(length(d.domain) as double) as length, e.entropy,
          case when e.entropy > 3.5 then 1.0::double else 0.0::double end as high_entropy,
          case when length(d.domain) > 30 then 1.0::double else 0.0::double end as high_length,
          coalesce(l.legit_grams, 0) as legit_grams, coalesce(w.word_grams, 0) as word_grams
        from {{v_domains}} d join ({_ENTROPY % _DISTINCT_DOMAINS}) e on e.domain = d.domain {_SCORES}""",
)
def _(t):
    rows = dga.features(dga.corpus(_lists(t)), *_vocabularies(t))
    return rows.withColumns({c: F.round(c, 6) for c in ("entropy", "legit_grams", "word_grams")})


_OCTET = "(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
_ADDRESS = "^" + r"\.".join([_OCTET] * 4) + "$"
_CANDIDATES = f"""select distinct host as domain from {{v_proxy}} where host is not null
    and host not like 'www.%' and host like '%.%' and length(host) > 6
    and not regexp_matches(host, '{_ADDRESS}')"""


@query("dga_host_candidates", _ENTROPY % _CANDIDATES)
def _(t):
    return dga.host_candidates(t["v_proxy"]).select("domain", F.round("entropy", 6).alias("entropy"))


@query(
    "dga_host_clients",
    f"""select distinct p.host, p.clientip, p.proxyip, p.username from {{v_proxy}} p
        join ({_ENTROPY % _CANDIDATES}) e on e.domain = p.host
        where e.entropy > 3.5""",
)
def _(t):
    suspects = dga.host_candidates(t["v_proxy"]).filter(F.round("entropy", 6) > dga.HIGH_ENTROPY)
    return dga.clients_of(suspects, t["v_proxy"])


# --- models: what any right model has to meet -------------------------------------

_SMALL_GRID = {"layers": [[6, 10, 2]], "maxIter": [10, 50]}
_NO_DIFFERENCE = "select 0::bigint as missing, 0::bigint as extra"


def _difference(found: DataFrame, expected: DataFrame) -> DataFrame:
    """How many rows of ``expected`` are missing, and how many of ``found`` are extra."""
    names = found.columns
    counts = (
        expected.select(*names).withColumn("side", F.lit(1))
        .unionByName(found.withColumn("side", F.lit(-1)))
        .groupBy(*names).agg(F.sum("side").alias("more"))
    )
    return counts.agg(
        F.coalesce(F.sum(F.greatest("more", F.lit(0))), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(F.greatest(-F.col("more"), F.lit(0))), F.lit(0)).alias("extra"),
    )


def _trained(t: Tables, kind: str = "mlp", grid: dict | None = None):
    legit, words = _vocabularies(t)
    train, held_out = dga.split(dga.features(dga.corpus(_lists(t)), legit, words))
    return dga.fit(train, kind, grid or _SMALL_GRID, folds=3), held_out, (legit, words)


_HELD_OUT = """select category, count(*) as held_out, true as accurate from {v_domains}
    where ('0x' || substr(md5(domain || ':42'), 1, 8))::bigint % 1000 >= 700 group by category"""


def _accuracy(t: Tables, *model) -> DataFrame:
    """Held-out names by category, and whether nine of ten are told apart."""
    fitted, held_out, _ = _trained(t, *model)
    right = F.sum(F.when(F.col("category") == F.col("predicted"), F.col("hits")).otherwise(0))
    return dga.evaluate(fitted, held_out).groupBy("category").agg(
        F.sum("hits").alias("held_out"), (right >= 0.9 * F.sum("hits")).alias("accurate")
    )


@query("dga_model_eval", _HELD_OUT)
def _(t):
    return _accuracy(t)


@query("dga_forest_eval", _HELD_OUT)
def _(t):
    return _accuracy(t, "forest", {"numTrees": [15], "maxDepth": [5]})


@query("dga_logistic_eval", _HELD_OUT)
def _(t):
    return _accuracy(t, "logistic", {"regParam": [0.05], "elasticNetParam": [0.0]})


@query("dga_flagged_clients", _NO_DIFFERENCE)
def _(t):
    model, _, vocabularies = _trained(t)
    flagged = settle(dga.flag_hosts(model, dga.features(dga.host_candidates(t["v_proxy"]), *vocabularies)), "flagged")
    # The plain route: all requests of the hosts first, made distinct afterwards.
    plain = t["v_proxy"].join(flagged.withColumnRenamed("domain", "host"), "host").select("host", "clientip", "proxyip", "username").distinct()
    return _difference(dga.clients_of(flagged, t["v_proxy"]), plain)


_CLUSTERS = 25


@query(
    "cmd_vectors",
    """select source, username, len(string_split(command, ' ')) as words, 100::bigint as size from {v_bash}
       where command is not null""",
)
def _(t):
    model = commands.train(t["v_bash"], k=_CLUSTERS)
    return commands.vectors(model, t["v_bash"]).select(
        "source", "username", F.size("tokens").cast("bigint").alias("words"),
        F.size(vector_to_array("features")).cast("bigint").alias("size"),
    )


@query(
    "cmd_clusters",
    """select count(*) as clustered, 0::bigint as without_cluster, 0::bigint as beyond_k from {v_bash}
       where command is not null""",
)
def _(t):
    model, rows = commands.cluster(t["v_bash"], k=_CLUSTERS)
    path = scratch_path(t.spark, "clusters")
    commands.save(model, rows, path)
    found = F.col("prediction")
    return commands.load(t.spark, path)[1].agg(
        F.count(F.lit(1)).alias("clustered"),
        F.count(F.when(found.isNull(), 1)).alias("without_cluster"),
        F.count(F.when((found < 0) | (found >= _CLUSTERS), 1)).alias("beyond_k"),
    )


def _clustered(t: Tables) -> DataFrame:
    # As many clusters as the analysts have: rare ones only show among many.
    rows = commands.cluster(t["v_bash"])[1].drop("features", "tokens")
    return settle(rows.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("prediction"))), "clustered")


@query("cmd_outliers", _NO_DIFFERENCE)
def _(t):
    rows = _clustered(t)
    found = commands.outlier_lines(commands.outliers(rows.drop("size"), commands.RARE_SERVING))
    plain = rows.where(F.col("size") < commands.RARE_SERVING).drop("size").distinct()
    return _difference(found, commands.outlier_lines(plain))


@query("cmd_score_new", "select concat('wget ', url) as command, true as has_cluster from {pages}")
def _(t):
    path = scratch_path(t.spark, "model")
    commands.save(*commands.cluster(t["v_bash"], k=_CLUSTERS), path)
    model, known = commands.load(t.spark, path)
    fresh = t["pages"].selectExpr("concat('wget ', url) as command")
    scored = commands.score_new(model, known, fresh)
    return scored.select("command", (F.col("prediction").isNotNull() & (F.col("cluster_size") >= 0)).alias("has_cluster"))


@query("cmd_largest", _NO_DIFFERENCE)
def _(t):
    rows = _clustered(t)
    order = Window.orderBy(F.desc("size"), "prediction")
    largest = rows.select("prediction", "size").distinct().withColumn("place", F.row_number().over(order)).where("place <= 10")
    plain = rows.join(largest.select("prediction"), "prediction", "left_semi").select("command").distinct()
    return _difference(commands.largest(rows.drop("size")), plain)


@query(
    "cmd_clusters_small",
    """select command, count(*) as hits, 1::bigint as clusters from (
         select unnest(string_split(command, chr(10))) as command from {v_bash} where command is not null) l
       group by command""",
)
def _(t):
    _, rows = commands.cluster_lines(t["v_bash"])
    # The same line is always in the same cluster, and no line is lost.
    return commands.members(rows).groupBy("command").agg(F.sum("hits").alias("hits"), F.count(F.lit(1)).alias("clusters"))


# --- streaming ------------------------------------------------------------------

# Landed files of a micro-batch, so that what a batch keeps while it is stored does not grow
# with a backlog.
_BATCH_FILES = 128


def _landed_logs(t: Tables) -> str:
    """Mixed lines as files below day folders."""
    path = scratch_path(t.spark, "landed")
    january = t["v_fw"].withColumn("date", F.expr(_DAY.format(text="string")))
    fw = t.spark.sql(
        """select concat('<4>Jan ', lpad(cast(day(date) as string), 2, ' '), ' ', time, ' ', source,
          ' kernel:  RULE 12 -- ', action, '    IN=eth0 OUT= MAC=aa SRC=', srcip, ' DST=', dstip, ' LEN=', len,
          ' TOS=00 PREC=0x00 TTL=', ttl, ' ID=7 DF PROTO=', proto, ' SPT=', srcport, ' DPT=', dstport) as value
        from {january}""",
        january=january,
    )
    others = [t[n].select("value") for n in ("l_proxy_plain", "l_vpn", "l_bash")]
    for day, lines_of in (("20240101", fw), ("20240102", reduce(DataFrame.unionAll, others))):
        # Landed lines are packed; a packed file is one task's, so files stay small.
        lines_of.write.option("compression", "gzip").option("maxRecordsPerFile", 250_000).text(f"{path}/dt={day}")
    return path


_STREAMED = f"""select kind, cast(date as varchar) as date, count(*) as n from (
    select 'fw' as kind, {_DAY.format(text='varchar')} as date from {{v_fw}}
    union all select 'proxysg', date from {{v_proxy}} union all select 'ciscovpn', date from {{v_vpn}}
    union all select 'bash', date from {{v_bash}}) s group by kind, date"""


@query("stream_ingest", _STREAMED)
def _(t):
    path = _landed_logs(t)
    out = scratch_path(t.spark, "streamed")
    landed = streaming.stream_lines(t.spark, f"{path}/dt=*", _BATCH_FILES)
    streaming.start_ingest(landed, out, f"{out}/checkpoint", None, year=2024).awaitTermination()
    return _stored_counts(t, out)


def _stored_counts(t: Tables, root: str) -> DataFrame:
    """Rows by kind and day of all routed tables below ``root``."""
    return reduce(
        DataFrame.unionByName,
        [
            ranking.count_by(source_tables.read_events(t.spark, root, table).withColumn("kind", F.lit(table)), "kind", "date", name="n")
            for table in streaming.ROUTED
        ],
    )


@query("stream_two_sources", _STREAMED)
def _(t):
    path, out = _landed_logs(t), scratch_path(t.spark, "streamed")
    # Two streams with checkpoints of their own fill the same tables.
    for day in ("20240101", "20240102"):
        landed = streaming.stream_lines(t.spark, f"{path}/dt={day}", _BATCH_FILES)
        streaming.start_ingest(landed, out, f"{out}/checkpoint-{day}", None, year=2024).awaitTermination()
    return _stored_counts(t, out)


@query("ingest_batch_and_stream", _STREAMED)
def _(t):
    path, out = _landed_logs(t), scratch_path(t.spark, "mixed")
    landed = streaming.stream_lines(t.spark, f"{path}/dt=20240101", _BATCH_FILES)
    streaming.start_ingest(landed, out, f"{out}/checkpoint", None, year=2024).awaitTermination()
    # The batch run is done twice and counts once.
    for _run in range(2):
        ingest.ingest_logs(t.spark, ingest.ALL, f"{path}/dt=20240102", out, year=2024, run="second")
    return _stored_counts(t, out)


def _file_sink(t: Tables, events_of, path: str) -> None:
    streaming.start_file_sink(events_of, path, f"{path}-checkpoint", None).awaitTermination()


@query("stream_file_sink", _VPN_SQL)
def _(t):
    path = scratch_path(t.spark, "sink")
    t["l_vpn"].select("value").write.text(f"{path}/raw")
    events = parse.parse_vpn(streaming.stream_lines(t.spark, f"{path}/raw"), year=2024)
    _file_sink(t, events, f"{path}/out")
    read = source_tables.read_table(t.spark, f"{path}/out", schemas.CISCOVPN).drop("batch")
    return read.select("date", *_VPN_COLUMNS.split(", "))


@query(
    "keyed_lines",
    """select cast(date as varchar) as date, source, username, exec_as, srcip,
       replace(command, chr(10), ' ') as command from {v_bash}""",
)
def _(t):
    # Records as a broker delivers them.
    records = t["l_bash"].select(
        F.lit("gw").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"),
        F.col("arrived_at").cast("timestamp").alias("timestamp"),
    )
    return parse.parse_bash(streaming.keyed_lines(records), asof=F.col("arrived_at").cast("date"))


@query("stream_text", _LENGTHS % "")
def _(t):
    landed = streaming.stream_lines(t.spark, f"{_text_folders(t)}/lang=*")
    path = scratch_path(t.spark, "lines")
    writer = landed.writeStream.format("parquet").option("path", f"{path}/out")
    writer.option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start().awaitTermination()
    return _lengths(t.spark.read.parquet(f"{path}/out"))


@query(
    "stream_route_parse",
    "select cast(date as varchar) as date, source, username, exec_as, srcip, "
    "replace(command, chr(10), ' ') as command from {v_bash}",
)
def _(t):
    path = scratch_path(t.spark, "routed")
    # Landed lines are packed; a packed file is one task's, so files stay small.
    _mixed(t).write.option("compression", "lz4").option("maxRecordsPerFile", 1_000_000).text(f"{path}/raw")
    split = parse.split_routed(streaming.stream_lines(t.spark, f"{path}/raw"), year=2024)
    _file_sink(t, parse.events_of(split, "bash"), f"{path}/out")
    return source_tables.read_table(t.spark, f"{path}/out", schemas.BASH).drop("batch")


@query(
    "stream_hosted_lines",
    "select source as host, cast(date as varchar) as date, count(*) as n from {v_proxy} group by source, date",
)
def _(t):
    path = scratch_path(t.spark, "hosted")
    # Two feeds of pushed lines, read as one stream.
    pushed = t["l_proxy_tls"].select(F.concat_ws("\t", F.lit("dc1-net-bc"), "value").alias("value"))
    halves = F.pmod(F.xxhash64("value"), F.lit(2)) == 0
    pushed.filter(halves).write.text(f"{path}/a")
    pushed.filter(~halves).write.text(f"{path}/b")
    first = streaming.stream_hosted_lines(t.spark, f"{path}/a")
    second = streaming.stream_hosted_lines(t.spark, f"{path}/b")
    whole = streaming.with_prefix(first.unionByName(second))
    _file_sink(t, parse.parse_proxy(whole), f"{path}/out")
    rows = source_tables.read_table(t.spark, f"{path}/out", schemas.PROXYSG).drop("batch")
    return ranking.count_by(rows.withColumn("host", F.col("source")), "host", "date", name="n")


# Further queries register themselves.
from bindings import streams, users, wordspace  # noqa: E402, F401

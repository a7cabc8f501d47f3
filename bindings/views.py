"""Security tables derived from the given tables.

Each view is one SQL text for Spark and DuckDB, or a (Spark, DuckDB) pair where the
two need different functions.  ``{name}`` stands for a given table or another view.
All rows of a given table take part, so views grow with the data.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from vigil.session import settle

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_HOST = "regexp_extract(url, 'https?://([^/]+)', 1)"
_PART_IP = (
    "concat('172.', cast(16 + (({k} >> 16) & 15) as string), '.', cast(({k} >> 8) & 255 as string),"
    " '.', cast({k} & 255 as string))"
)
_CLOCK = "substring(cast(ts as string), 12, 8)"


def _part_ip(key: str) -> str:
    return _PART_IP.replace("{k}", key)


VIEWS: dict[str, str | tuple[str, str]] = {
    "v_fw": f"""
        select cast(l_shipdate as date) as date,
          concat(lpad(cast(l_orderkey % 24 as string), 2, '0'), ':',
                 lpad(cast(l_partkey % 60 as string), 2, '0'), ':',
                 lpad(cast(l_suppkey % 60 as string), 2, '0')) as time,
          concat('dc', cast(l_linenumber as string), '-fw1') as source,
          case l_returnflag when 'A' then 'DENY' when 'R' then 'ACCEPT' else 'DROP' end as action,
          concat('10.', cast(l_orderkey % 8 as string), '.', cast((l_suppkey >> 8) & 255 as string),
                 '.', cast(l_suppkey & 255 as string)) as srcip,
          {_part_ip('l_partkey')} as dstip,
          cast(floor(l_quantity) as bigint) as len, cast(64 as bigint) as ttl,
          case l_linestatus when 'O' then 'TCP' else 'UDP' end as proto,
          cast(1024 + l_orderkey % 5000 as bigint) as srcport,
          cast(l_partkey % 100 as bigint) as dstport
        from {{lineitem}}""",
    "v_proxy": f"""
        select cast(e.ts as date) as date, {_CLOCK.replace('ts', 'e.ts')} as time,
          'dc1-net-bc' as source,
          concat('10.1.', cast((e.user_id >> 8) & 255 as string), '.', cast(e.user_id & 255 as string)) as clientip,
          case e.event_type when 'error' then '403' else '200' end as scstatus,
          cast(floor(e.value * 10) as bigint) as scbytes,
          cast(floor(e.value * 100) as bigint) as csbytes,
          case when e.event_type = 'error' and e.user_id % 3 = 0
            then concat(substring(md5(p.url), 1, 18), '.example.net')
            else {_HOST.replace('url', 'p.url')} end as host, cast(443 as bigint) as port, p.url as path,
          replace(replace(e.props, ' ', ''), '"', '') as query,
          concat('u', cast(e.user_id as string)) as username,
          concat('TCP_', upper(e.event_type)) as saction,
          case when e.event_id % 3 = 0 then 'POST' else 'GET' end as method,
          case when p.url like 'https%' then 'https' else 'http' end as urischeme,
          concat('g', cast(e.user_id % 7 as string)) as user_group,
          concat('s', cast(e.event_id % 5 as string)) as sname,
          concat('text/t', cast(e.event_id % 4 as string)) as contenttype,
          concat('http://r', cast(e.user_id % 11 as string), '/') as referer,
          case when e.event_type = 'error' then 'DENIED' else 'OBSERVED' end as action,
          concat('AES', cast(e.event_id % 6 as string), '-SHA') as tlscipher,
          cast(128 * (1 + e.event_id % 2) as string) as ciphersize,
          concat('m', cast(e.user_id % 4 as string)) as malware,
          concat('10.0.0.', cast(e.event_id % 9 as string)) as proxyip,
          case e.user_id % 5 when 0 then 'Mozilla/4.0 (Windows NT 5.1)'
            when 1 then concat('rare/', cast(e.user_id as string))
            else 'Mozilla/5.0 (Windows NT 10.0)' end as agent,
          case e.event_type when 'error' then 'Malicious Sources/Malnets'
            when 'click' then 'News/Media' else 'Business' end as categories
        from (select *, event_id % (select count(*) from {{pages}}) as page_no from {{events}}) e
        join {{pages}} p on p.page_id = e.page_no""",
    "v_vpn": f"""
        select cast(ts as date) as date, {_CLOCK} as time, 'vpn1' as source,
          concat('u', cast(user_id as string), '@corp.example') as username,
          case when event_id % 97 = 0 then '203.0.113.9' else
            concat(cast((user_id % 24) + case when event_id % 10 = 0 then 1 else 0 end as string),
              '.', cast(user_id % 250 as string), '.2.', cast(event_id % 3 as string)) end as remoteip,
          case when event_type in ('purchase', 'error') then '' else '10.9.0.4' end as localip,
          case when event_type in ('purchase', 'error') then
            concat(case when value > 100 then '1d ' else '' end,
              cast(cast(floor(value) as bigint) % 24 as string), 'h:',
              lpad(cast(cast(floor(value * 7) as bigint) % 60 as string), 2, '0'), 'm:',
              lpad(cast(cast(floor(value * 100) as bigint) % 60 as string), 2, '0'), 's') else '' end as duration,
          case when event_type in ('purchase', 'error') then cast(floor(value * 100) as bigint) end as bytesxmt,
          case when event_type in ('purchase', 'error') then cast(floor(value * 10) as bigint) end as bytesrcv,
          case event_type when 'purchase' then 'User Requested' when 'error' then 'Idle Timeout' else '' end as reason
        from {{events}}""",
    "v_ad": """
        select distinct concat('u', cast(user_id as string), '@corp.example') as emailaddress,
          concat('C', cast(user_id % 24 as string)) as c
        from {events}""",
    "v_geo": """
        select cast(n_nationkey as bigint) * 16777216 as lo,
          cast(n_nationkey as bigint) * 16777216 + 16777215 as hi,
          concat('C', cast(n_nationkey as string)) as cc
        from {nation}""",
    # Ranges inside of ranges, some of them overlapping one another.
    "v_geo_nested": """
        select lo, hi, cc from {v_geo}
        union all
        select cast(s_nationkey as bigint) * 16777216 + (s_suppkey % 250) * 65536 + (s_suppkey % 3) * 200 as lo,
          cast(s_nationkey as bigint) * 16777216 + (s_suppkey % 250) * 65536 + (s_suppkey % 3) * 200
            + 100 + (s_suppkey * 911) % 200000 as hi,
          concat('S', cast(s_suppkey % 50 as string)) as cc
        from {supplier}
        union all
        select cast(c_custkey % 24 as bigint) * 16777216 + (c_custkey % 250) * 65536 + 512 + c_custkey % 3 as lo,
          cast(c_custkey % 24 as bigint) * 16777216 + (c_custkey % 250) * 65536 + 512 + c_custkey % 3 + c_custkey % 2 as hi,
          concat('X', cast(c_custkey % 90 as string)) as cc
        from {customer} where c_custkey % 5 = 0""",
    "v_otx": f"""
        select {_part_ip('p_partkey')} as ip, 'Scanning Host' as reason from {{part}} where p_type = 'PROMO'
        union all
        select {_HOST} as ip, 'Malicious Host' as reason from {{pages}} where url like 'http://%'""",
    "v_c2": f"""
        select {_part_ip('p_partkey')} as host, 'C2' as reason from {{part}} where p_size > 35
        union all
        select distinct {_HOST} as host, 'C2' as reason from {{pages}} where url like '%/fr/%'""",
    "v_cidr": f"""
        select distinct concat({_part_ip('(p_partkey & 16777200)')}, '/28') as host from {{part}} where p_size = 50
        union all
        select distinct concat({_part_ip('(p_partkey & 16776960)')}, '/24') as host
        from {{part}} where p_size = 50 and p_type = 'PROMO'
        union all
        select {_part_ip('p_partkey')} as host from {{part}} where p_size = 7""",
    # Feed files list everything; the indicators above are a part of it.
    "v_otx_feed": f"""
        select {_part_ip('p_partkey')} as ip, concat('Reason ', cast(p_size % 9 as string)) as reason from {{part}}
        union all
        select {_HOST} as ip, 'Malicious Host' as reason from {{pages}}""",
    "v_c2_feed": f"""
        select {_part_ip('p_partkey')} as host, 'C2' as reason from {{part}}
        union all
        select {_HOST} as host, 'C2' as reason from {{pages}}""",
    "v_cidr_feed": f"""
        select concat({_part_ip('(p_partkey & 16777200)')}, case p_partkey % 3 when 0 then '/28' when 1 then '/24' else '' end)
          as host from {{part}}""",
    "v_bash": """
        select cast(concat('2024-01-', lpad(cast(turn % 28 + 1 as string), 2, '0')) as date) as date,
          concat('host', cast(conv_id % 20 as string)) as source,
          concat('u', cast(conv_id % 50 as string)) as username, role as exec_as,
          concat('10.2.0.', cast(conv_id % 250 as string)) as srcip, text as command
        from {conversations}""",
    "v_apache": f"""
        select cast(e.ts as date) as date, concat('10.3.0.', cast(e.user_id % 250 as string)) as ip_address,
          concat('u', cast(e.user_id as string)) as user_id, {_CLOCK.replace('ts', 'e.ts')} as time,
          case e.event_type when 'purchase' then 'POST' else 'GET' end as method, p.url as endpoint,
          cast(case e.event_type when 'error' then 500 else 200 end as bigint) as response_code,
          cast(floor(e.value * 100) as bigint) as content_size
        from (select *, event_id % (select count(*) from {{pages}}) as page_no from {{events}}) e
        join {{pages}} p on p.page_id = e.page_no""",
    "v_sccm": """
        select concat('host', cast(l_orderkey as string)) as name0, p_name as displayname0,
          p_brand as version0, p_type as hostfn_x,
          case n_regionkey % 3 when 0 then 'NCSA' when 1 then 'EMEA' else 'APAC' end as region_x,
          case l_linestatus when 'O' then 'Corp' else 'ONBE' end as zone_x,
          case when l_quantity >= 25 then 'High' else 'Low' end as crit_x_cat,
          case when l_linenumber = 1 then 'excluded' end as exclude_x,
          case p_size % 5 when 0 then 'adobe-flash' when 1 then 'adobe-rdr' when 2 then 'chrome'
            when 3 then 'firefox' else 'java' end as product
        from {lineitem} join {part} on l_partkey = p_partkey
        join {supplier} on l_suppkey = s_suppkey join {nation} on s_nationkey = n_nationkey""",
    "v_timeline": """
        select cast(concat('2024-01-', lpad(cast(page_id % 28 + 1 as string), 2, '0')) as string) as date,
          concat(url, case page_id % 5 when 0 then ' DELETED' when 1 then '.zip' when 2 then '.pdf'
            when 3 then '.exe' else '' end) as short
        from {pages}""",
    "v_domains": f"""
        select distinct {_HOST} as domain, 'legit' as category from {{pages}}
        union
        select concat(substring(md5(url), 1, 18), '.example.net') as domain, 'dga' as category
        from {{pages}}""",
    "v_words": (
        """select distinct word from (
             select explode(split(lower(text), '[^\\\\pL]+')) as word from {documents}) w where word <> ''""",
        """select distinct word from (
             select unnest(regexp_split_to_array(lower(text), '[^\\pL]+')) as word from {documents}) w
           where word <> ''""",
    ),
    "v_process": f"""
        select concat('img', cast(user_id as string)) as image,
          concat(event_type, '.exe') as process, cast(event_id as string) as pid,
          concat(cast(cast(ts as date) as string), ' ', {_CLOCK}) as started
        from {{events}}""",
    # One line per text line, used as raw input.
    "v_doc_lines": (
        "select lang, explode(split(text, chr(10))) as value from {documents}",
        "select lang, unnest(string_split(text, chr(10))) as value from {documents}",
    ),
}

# Lists that a real deployment holds as tables; made once, since they are read often.
SETTLED = ("v_words", "v_domains")

_STAMP = "concat(date_format(date, 'MMM'), ' ', lpad(cast(day(date) as string), 2, ' '))"

# Raw log lines of a view, with the day they arrived; Spark only, the view itself
# is what parsing them must give.
LINES: dict[str, str] = {
    "l_fw": f"""
        select date as arrived_at, concat('<4>', {_STAMP}, ' ', time, ' ', source, ' kernel:  RULE 12 -- ',
          action, '    IN=eth0 OUT= MAC=aa SRC=', srcip, ' DST=', dstip, ' LEN=', len,
          ' TOS=00 PREC=0x00 TTL=', ttl, ' ID=7 DF PROTO=', proto, ' SPT=', srcport, ' DPT=', dstport) as value
        from {{v_fw}}""",
    "l_proxy_plain": f"""
        select date as arrived_at, concat('<9>', {_STAMP}, ' ', time, ' gw ', source, ' "', date, '" "', time,
          '" "12" "', clientip, '" "', scstatus, '" "', saction, '" "', scbytes, '" "', csbytes,
          '" "', method, '" "', urischeme, '" "', host, '" "', port, '" "', path, '" "', query, '" "', username,
          '" "', user_group, '" "', sname, '" "', contenttype, '" "', referer, '" "', agent, '" "', action,
          '" "', categories, '" "', malware, '" "', proxyip, '"') as value
        from {{v_proxy}}""",
    "l_proxy_tls": f"""
        select date as arrived_at, concat('<9>', {_STAMP}, ' ', time, ' gw ', source, ' ', date, ' ', time,
          ' 12 ', clientip, ' ', scstatus, ' ', saction, ' ', scbytes, ' ', csbytes,
          ' ', method, ' ', urischeme, ' ', host, ' ', port, ' ', path, ' ', query, ' ', username,
          ' ', user_group, ' ', sname, ' ', contenttype, ' ', referer, ' "', agent, '" ', action, ' "', categories,
          '" TLSv1.2 ', tlscipher, ' ', ciphersize, ' ', malware, ' ', proxyip) as value
        from {{v_proxy}}""",
    "l_vpn": f"""
        select date as arrived_at, case when duration = '' then
          concat('<166>', {_STAMP}, ' ', time, ' ', source, ' %ASA-6-722051: Group <G> User <', username,
            '> IP <', remoteip, '> IPv4 Address <', localip, '>')
          else concat('<166>', {_STAMP}, ' ', time, ' ', source, ' : %ASA-4-113019: Group = G, Username = ',
            username, ', IP = ', remoteip, ', Session disconnected. Session Type: SSL, Duration: ', duration,
            ', Bytes xmt: ', bytesxmt, ', Bytes rcv: ', bytesrcv, ', Reason: ', reason) end as value
        from {{v_vpn}}""",
    "l_bash": f"""
        select date as arrived_at, concat('<86>', {_STAMP}, ' 10:00:00 ', source, ' bash: user: ', username,
          ' as ', exec_as, ' from ip: ', srcip, ':pts/0 execs: ''', replace(command, chr(10), ' '), '''') as value
        from {{v_bash}}""",
    "l_bash_warn": f"""
        select date as arrived_at, concat('<86>', {_STAMP}, ' 10:00:00 ', source,
          ' bash: WARNING no tty user: ', username, ' execs ''', replace(command, chr(10), ' '), '''') as value
        from {{v_bash}}""",
    "l_apache": """
        select date as arrived_at, concat(ip_address, ' - ', user_id, ' [', date_format(date, 'dd/MMM/yyyy'), ':',
          time, ' +0000] "', method, ' ', endpoint, ' HTTP/1.1" ', response_code, ' ', content_size) as value
        from {v_apache}""",
    "l_pslist": """
        select image, concat('0x8a', pid, ' ', process, '   ', pid, ' 4 8 120 0 0 ', started) as value
        from {v_process}""",
    "l_imageinfo": """
        select distinct image, explode(array(
          concat('          Suggested Profile(s) : Win7SP1x86_', image, ', Win7SP0x86'),
          concat('                     KDBG : 0x82', image, 'L'))) as value
        from {v_process}""",
}


def _names(text: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", text)))


class Tables:
    """The given tables of one folder, the views over them and their log lines."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                text = LINES.get(name) or VIEWS[name]
                text = text if isinstance(text, str) else text[0]
                made = self.spark.sql(text, **{n: self[n] for n in _names(text)})
                self._made[name] = settle(made, name) if name in SETTLED else made
        return self._made[name]


def oracle(sql: str) -> str:
    """A DuckDB query over ``{view}``s, with those views as common table expressions."""
    parts: dict[str, str] = {}

    def plain(text: str) -> str:
        for name in _names(text):
            if name in VIEWS and name not in parts:
                view = VIEWS[name]
                body = plain(view if isinstance(view, str) else view[1])
                parts[name] = body
        return re.sub(r"\{(\w+)\}", r"\1", text)

    body = plain(sql)
    if not parts:
        return body.strip()
    views = ",\n".join(f"{name} as ({text.strip()})" for name, text in parts.items())
    return f"with {views}\n{body.strip()}"

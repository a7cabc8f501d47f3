from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from vigil.functions import dates
from vigil.operators import parse

FW = (
    "<4>Jan  5 01:02:03 gw1 kernel:  RULE 12 -- DENY    IN=eth0 OUT= MAC=aa SRC=10.0.0.1 "
    "DST=10.0.0.2 LEN=60 TOS=00 PREC=0x00 TTL=64 ID=7 DF PROTO=TCP SPT=40000 DPT=443"
)
ICMP = FW.replace("PROTO=TCP SPT=40000 DPT=443", "PROTO=ICMP TYPE=8 CODE=0")
SHELL = "<86>Feb  9 10:00:00 h1 bash: user: alice as root from ip: 10.0.0.9:pts/3 execs: 'ls -l /tmp'"
WARN = "<86>Feb 10 10:00:00 h1 bash: WARNING no tty user: bob execs 'id'"
LOGIN = (
    "<166>Mar 11 08:00:00 asa1 %ASA-6-722051: Group <G> User <a@corp.example> IP <198.51.100.7> "
    "IPv4 Address <10.9.0.4>"
)
LOGOUT = (
    "<166>Mar 11 09:00:00 asa1 : %ASA-4-113019: Group = G, Username = a@corp.example, "
    "IP = 198.51.100.7, Session disconnected. Session Type: SSL, Duration: 1d 2h:03m:04s, "
    "Bytes xmt: 10, Bytes rcv: 20, Reason: User Requested"
)
PLAIN = (
    '<9>Jan 05 10:00:00 gw dc1-net-bc "2024-01-05" "10:00:01" "12" "10.1.0.7" "200" "TCP_HIT" "15" "25" '
    '"GET" "http" "www.example.com" "80" "/a" "?q=1" "bob" "staff" "sg" "text/html" "-" '
    '"Mozilla/5.0 (X11)" "OBSERVED" "News/Media; Blogs" "-" "10.0.0.8"'
)
TLS = (
    "<9>Jan 05 10:00:00 gw dc1-net-bc 2024-01-05 10:00:01 12 10.1.0.7 200 TCP_HIT 15 25 "
    'GET https www.example.com 443 /a - bob staff sg text/html - "Mozilla/5.0 (X11)" OBSERVED '
    '"News/Media; Blogs" TLSv1.2 AES256-SHA 256 - 10.0.0.8'
)
WEB = '192.0.2.1 - - [01/Jan/2024:00:00:00 +0000] "GET /a HTTP/1.1" 200 12'


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_firewall(lines):
    row = one(parse.parse_fw(lines(FW, ICMP, "noise"), year=2024))
    assert row == {
        "source": "gw1", "time": "01:02:03", "event_ts": dt.datetime(2024, 1, 5, 1, 2, 3),
        "action": "DENY", "srcip": "10.0.0.1", "dstip": "10.0.0.2", "len": 60, "ttl": 64,
        "proto": "TCP", "srcport": 40000, "dstport": 443, "date": dt.date(2024, 1, 5),
    }


def test_firewall_rejects(lines):
    left = parse.rejects_of(lines(FW, ICMP, "noise"), "fw", year=2024)
    assert rows_of(left) == sorted([(ICMP,), ("noise",)], key=repr)


def test_shell(lines):
    row = one(parse.parse_bash(lines(SHELL), year=2024))
    assert row == {
        "source": "h1", "username": "alice", "exec_as": "root", "srcip": "10.0.0.9",
        "command": "ls -l /tmp", "date": dt.date(2024, 2, 9),
    }


def test_shell_warning(lines):
    row = one(parse.parse_bash(lines(WARN), year=2024))
    assert (row["exec_as"], row["username"], row["srcip"], row["command"]) == ("no tty", "bob", "", "id")


@pytest.mark.parametrize("mark", [" ", " : "])
def test_vpn_login(lines, mark):
    row = one(parse.parse_vpn(lines(LOGIN.replace(" %ASA", f"{mark}%ASA")), year=2024))
    assert row["username"] == "a@corp.example"
    assert (row["remoteip"], row["localip"]) == ("198.51.100.7", "10.9.0.4")
    assert (row["duration"], row["duration_sec"], row["bytesxmt"], row["reason"]) == ("", None, None, "")


def test_vpn_logout(lines):
    row = one(parse.parse_vpn(lines(LOGOUT), year=2024))
    # The comma after the user belongs to the format.
    assert row["username"] == "a@corp.example"
    assert row["duration"] == "1d 2h:03m:04s"
    assert row["duration_sec"] == 86400 + 2 * 3600 + 3 * 60 + 4
    assert (row["bytesxmt"], row["bytesrcv"], row["reason"]) == (10, 20, "User Requested")


def test_vpn_logout_without_days(lines):
    row = one(parse.parse_vpn(lines(LOGOUT.replace("1d 2h", "2h")), year=2024))
    assert row["duration_sec"] == 2 * 3600 + 3 * 60 + 4


def test_proxy_plain(lines):
    row = one(parse.parse_proxy(lines(PLAIN, PLAIN.replace('"25"', '"x"'))))
    assert row["date"] == dt.date(2024, 1, 5) and row["event_ts"] == dt.datetime(2024, 1, 5, 10, 0, 1)
    assert (row["source"], row["clientip"], row["host"], row["port"]) == (
        "dc1-net-bc", "10.1.0.7", "www.example.com", 80,
    )
    assert (row["scbytes"], row["csbytes"], row["user_group"]) == (15, 25, "staff")
    assert (row["agent"], row["categories"]) == ("Mozilla/5.0 (X11)", "News/Media; Blogs")
    assert (row["tlsver"], row["tlscipher"], row["ciphersize"]) == ("", "", "")
    assert (row["malware"], row["proxyip"]) == ("-", "10.0.0.8")


def test_proxy_tls(lines):
    row = one(parse.parse_proxy(lines(TLS)))
    assert (row["agent"], row["categories"]) == ("Mozilla/5.0 (X11)", "News/Media; Blogs")
    assert (row["tlsver"], row["tlscipher"], row["ciphersize"]) == ("TLSv1.2", "AES256-SHA", "256")


def test_web_server(lines):
    row = one(parse.parse_apache(lines(WEB, "x " + WEB.replace("200", "2x0"))))
    assert row["date_time"] == "01/Jan/2024:00:00:00 +0000"
    assert row["event_ts"] == dt.datetime(2024, 1, 1)
    assert (row["response_code"], row["content_size"], row["date"]) == (200, 12, dt.date(2024, 1, 1))


def test_number_too_long_is_null(lines):
    row = one(parse.parse_fw(lines(FW.replace("LEN=60", "LEN=" + "9" * 30)), year=2024))
    assert row["len"] is None


def test_separator_in_line(lines):
    odd = SHELL.replace("ls -l", "ls \u0001 -l")
    assert one(parse.parse_bash(lines(odd), year=2024))["command"] == "ls \u0001 -l /tmp"
    assert parse.parse_bash(lines("noise \u0001 x"), year=2024).count() == 0


def test_carriage_return_stays_in_command(lines):
    odd = SHELL.replace("ls -l", "ls -l")
    assert one(parse.parse_bash(lines(odd), year=2024))["command"] == "ls -l /tmp"


def test_routing_by_program_first(lines):
    conflict = SHELL.replace(" h1 ", " dc1-fw1 ")
    routed = parse.route(lines(FW.replace("gw1", "dc1-fw1"), conflict, LOGIN, PLAIN, "noise"))
    assert [r["kind"] for r in routed.collect()] == ["fw", "bash", "ciscovpn", "proxysg", "unknown"]
    assert one(parse.events_of(parse.split_routed(lines(conflict), year=2024), "bash"))["source"] == "dc1-fw1"


def test_split_keeps_every_line(lines):
    mixed = lines(FW.replace("gw1", "dc1-fw1"), SHELL, LOGIN, PLAIN, "noise", "bash: nonsense")
    split = parse.split_routed(mixed, year=2024)
    read = sum(parse.events_of(split, k).count() for k in ("fw", "bash", "ciscovpn", "proxysg"))
    assert read == 4
    assert rows_of(parse.rejects(split)) == [("bash", "bash: nonsense"), ("unknown", "noise")]


@pytest.mark.parametrize(
    "stamp, asof, day",
    [
        ("Jan  5", "2024-01-06", "2024-01-05"),
        ("Dec 31", "2024-01-01", "2023-12-31"),
        ("Jan  2", "2024-01-01", "2024-01-02"),
        ("Jan  3", "2024-01-01", "2023-01-03"),
        ("Feb 29", "2025-01-05", "2024-02-29"),
        ("Feb 29", "2027-01-05", None),
        ("Foo 10", "2024-01-01", None),
        ("anF 10", "2024-01-01", None),
        ("June 5", "2024-06-06", None),
        ("Jan 42", "2024-01-01", None),
        ("Mar\t7", "2024-05-01", "2024-03-07"),
    ],
)
def test_syslog_date(spark, stamp, asof, day):
    df = spark.createDataFrame([(stamp, asof)], "s string, a string")
    got = df.select(dates.syslog_date(F.col("s"), F.col("a").cast("date")).cast("string")).first()[0]
    assert got == day


def test_line_of_impossible_day_is_rejected(lines):
    bad = SHELL.replace("Feb  9", "Foo  9")
    split = parse.split_routed(lines(bad), year=2024)
    assert parse.events_of(split, "bash").count() == 0
    assert rows_of(parse.rejects(split)) == [("bash", bad)]


def test_no_field_depends_on_default_year(spark, lines):
    today = dt.date.today()
    stamp = today.strftime("%b ") + f"{today.day:2d}"
    row = one(parse.parse_bash(lines(SHELL.replace("Feb  9", stamp))))
    assert row["date"] in (today, today.replace(year=today.year - 1) if stamp != "Feb 29" else today)

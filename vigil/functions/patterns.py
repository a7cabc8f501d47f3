"""Log formats: the accepted line shapes and which capture feeds which column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The line formats, feed formats and routing markers to accept.
PROXY_PLAIN = r'<\d{1,3}>(\S+\W+\d+) (\d+:\d+:\d+) \S+ (\w+-\w+-\w+|"\w+-\w+-\w+") "(\d+-\d+-\d+)" "(\d+:\d+:\d+)" "(\d+)" "(\d+.\d+.\d+.\d+)" "(\d+)" "(\S+)" "(\d+)" "(\d+)" "(\w+)" "(\w+)" "(\d+.\d+.\d+.\d+|\S+)" "(\d+)" "(\S+)" "(\S+)" "(\S+)" "(\S+)" "(\d+.\d+.\d+.\d+|\S+)" "(\S+)" "(\S+)" "([^"].*?)" "(\S+)" "([\s\S]*?)" "(\S+)" "(\d+.\d+.\d+.\d+)"'
PROXY_TLS = r'<\d{1,3}>(\S+\W+\d+) (\d+:\d+:\d+) \S+ (\w+-\w+-\w+|"\w+-\w+-\w+") (\d+-\d+-\d+) (\d+:\d+:\d+) (\d+) (\d+.\d+.\d+.\d+) (\d+) (\S+) (\d+) (\d+) (\w+) (\w+) (\d+.\d+.\d+.\d+|\S+) (\d+) (\S+) (\S+) (\S+) (\S+) (\d+.\d+.\d+.\d+|\S+) (\S+) (\S+) "?([^"].*?)"? (\S+) "([\s+\S+]*?)" (\S+) (\S+) (\d{3}|\S+) (\S+) (\d+.\d+.\d+.\d+)'
IPTABLES = r'(<\d{1,3}>)(\S+\s+\d{1,2}) (\d{2}:\d{2}:\d{2}) (\S+) (\S+)  (RULE \S+ \d+|RULE \d+|DROP \S+) (\S+) (\S+)(\s{1,2})(\s+)IN=(\S+) OUT=((\S+)?) MAC=(\S+|)(\s+)SRC=(\d+.\d+.\d+.\d+) DST=(\d+.\d+.\d+.\d+) LEN=(\d+) TOS=(\d+) PREC=(\S+) TTL=(\d+) ID=(\d+).*PROTO=(\S+) SPT=(\d+) DPT=(\d+)'
SHELL = r"<\d{1,3}>(\S+\s+\d{1,2}) (\d{2}:\d{2}:\d{2}) (\S+) bash: user: (\S+) as (\S+) from ip: (\d+.\d+.\d+.\d+|\S+):pts\/\d{1,2} execs: '(.*)'"
SHELL_WARNING = r"<\d{1,3}>(\S+\s+\d{1,2}) (\d{2}:\d{2}:\d{2}) (\S+) bash: WARNING (.*) user: (\S+) execs '(.*)'"
VPN_LOGIN = r'<\d{1,3}>(\S+\s+\d{1,2}) (\d\d:\d\d:\d\d) (\S+)(\s|\s\S\s)%ASA-\d-722051: \S+ \S+ User <(\S+)> IP <(\d{1,3}.\d{1,3}.\d{1,3}.\d{1,3})> IPv4 Address <(\d{1,3}.\d{1,3}.\d{1,3}.\d{1,3})>'
VPN_LOGOUT = r'<\d{1,3}>(\S+\s+\d{1,2}) (\d\d:\d\d:\d\d) (\S+)(\s|\s\S\s)%ASA-\d-113019: Group = \S+ Username = (\S+), IP = (\d{1,3}.\d{1,3}.\d{1,3}.\d{1,3}), Session disconnected. Session Type: \S+, Duration: (\d{1,3}d \d{1,3}h:\d{1,2}m:\d{1,2}s|\d{1,3}h:\d{1,2}m:\d{1,2}s), Bytes xmt: (\d+), Bytes rcv: (\d+), Reason: (.*)'
WEB_SERVER = r'^(\S+) (\S+) (\S+) \[([\w:/]+\s[+\-]\d{4})\] "(\S+) (\S+) (\S+)" (\d{3}) (\d+)'
C2_HOST = r'(\d+.\d+.\d+.\d+|(\S+\.\S+)|(\S+\.\S+\.\S+))'
RULE_ADDRESS = r'(\d+.\d+.\d+.\d+)|(\d+.\d+.\d+.\d+\/\d+)'
IMAGE_PROFILE = r'(\w+)(\s)(\w+)(\S+)(\s)(\:)(\s)(\S+)'
IMAGE_KDBG = r'(KDBG)(\s:\s)(\w+)'
PROCESS_ROW = r'(\w+)(\s+)(\w+.+)(\s+)(\d+)(\s+)(\d+)(\s+)(\d+)(\s+)(\d+)(\s+)(\d+)(\s+)(\d+)(\s+)(\d{4}-\d\d-\d\d\s\d\d:\d\d:\d\d)'
MARK_SHELL = "bash:"
MARK_VPN = "ASA-"
MARK_FW = "-fw"
MARK_PROXY = "-net-bc"
REASON_C2 = "C2"
REASON_OPENPHISH = "OpenPhish"

SEPARATOR = "\u0001"


@dataclass(frozen=True)
class LineFormat:
    """A pattern plus, per output field, the capture it comes from (0: empty)."""

    pattern: str
    captures: tuple[int, ...]
    # A cheap pattern that every accepted line fits too.
    needs: str | None = None

    def split(self, line: Column) -> Column:
        """The fields of ``line`` as ``array<string>``, or null when it does not fit.

        One regex pass rewrites the line to its joined captures, which ``split``
        then cuts: a ``regexp_extract`` per column would match up to 27 times.
        A line that itself holds the separator takes that slower way instead.
        """
        # (?d) lets "." stop at the newline only.
        whole = f"(?d)^.*?{self.pattern}.*$"
        joined = F.regexp_replace(
            line, F.lit(whole), F.lit(SEPARATOR.join(f"${c}" if c else "" for c in self.captures))
        )
        size = len(self.captures)
        fast = F.get(
            F.filter(F.array(F.split(joined, SEPARATOR, -1)), lambda parts: F.size(parts) == size),
            F.lit(0),
        )
        slow = F.when(
            line.rlike(whole),
            F.array(
                *[
                    F.regexp_extract(line, whole, c) if c else F.lit("")
                    for c in self.captures
                ]
            ),
        )
        fields = F.when(line.contains(SEPARATOR), slow).otherwise(fast)
        return F.when(line.rlike(f"(?d){self.needs}"), fields) if self.needs else fields


# Raw fields per event table; a format lists its captures in the same order.
RAW_FIELDS = {
    "proxysg": (
        "date", "source", "time", "clientip", "scstatus", "saction", "scbytes", "csbytes",
        "method", "urischeme", "host", "port", "path", "query", "username", "user_group",
        "sname", "contenttype", "referer", "agent", "action", "categories", "tlsver",
        "tlscipher", "ciphersize", "malware", "proxyip",
    ),
    "fw": (
        "stamp", "time", "source", "action", "srcip", "dstip", "len", "ttl", "proto",
        "srcport", "dstport",
    ),
    "ciscovpn": (
        "stamp", "time", "source", "username", "remoteip", "localip", "duration", "bytesxmt",
        "bytesrcv", "reason",
    ),
    "bash": ("stamp", "source", "username", "exec_as", "srcip", "command"),
    "apache": (
        "ip_address", "client_identd", "user_id", "date_time", "method", "endpoint",
        "protocol", "response_code", "content_size",
    ),
}

# The proxy formats hold two free texts, agent and categories, so a line that nearly fits
# would be tried at every pair of their ends.  Whatever end of the agent fits, the first
# possible one has the line's tail behind it as well: with that end held (an atomic
# group), looking for the tail once tells whether the pattern is worth trying.
_PLAIN_NEEDS = (
    PROXY_PLAIN[: PROXY_PLAIN.index(' "([^"].*?)"')]
    + r'(?> "[^"].*?" "\S+" ")[\s\S]*" "\S+" "\d+.\d+.\d+.\d+"'
)
_TLS_NEEDS = (
    PROXY_TLS[: PROXY_TLS.index(' "?([^"].*?)"?')]
    + r'(?> "?[^"].*?"? \S+ ")[\s\S]*" \S+ \S+ \S+ \S+ \d+.\d+.\d+.\d+'
)

# Formats per event table; the first that fits a line wins.
FORMATS = {
    "proxysg": (
        LineFormat(PROXY_PLAIN, (4, 3, 5, *range(7, 26), 0, 0, 0, 26, 27), _PLAIN_NEEDS),
        LineFormat(PROXY_TLS, (4, 3, 5, *range(7, 31)), _TLS_NEEDS),
    ),
    "fw": (LineFormat(IPTABLES, (2, 3, 4, 8, 16, 17, 18, 21, 23, 24, 25)),),
    "ciscovpn": (
        LineFormat(VPN_LOGIN, (1, 2, 3, 5, 6, 7, 0, 0, 0, 0)),
        LineFormat(VPN_LOGOUT, (1, 2, 3, 5, 6, 0, 7, 8, 9, 10)),
    ),
    "bash": (
        LineFormat(SHELL, (1, 3, 4, 5, 6, 7)),
        LineFormat(SHELL_WARNING, (1, 3, 5, 4, 0, 6)),
    ),
    "apache": (LineFormat(WEB_SERVER, tuple(range(1, 10))),),
}


def line_fields(line: Column, table: str) -> Column:
    """Raw fields of ``line`` read as ``table``; null when no format fits."""
    return F.coalesce(*[form.split(line) for form in FORMATS[table]])

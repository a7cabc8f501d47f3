"""Column types of every table the library reads or writes."""

from __future__ import annotations

from pyspark.sql.types import (
    DataType,
    DateType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

_TYPES: dict[str, DataType] = {
    "string": StringType(),
    "bigint": LongType(),
    "date": DateType(),
    "timestamp": TimestampType(),
}


def _schema(columns: str) -> StructType:
    """``name type, ...`` as a schema, without needing a session."""
    pairs = (column.split() for column in columns.split(","))
    return StructType([StructField(name, _TYPES[kind]) for name, kind in pairs])


PROXYSG = _schema(
    "source string, time string, event_ts timestamp, clientip string, scstatus string, "
    "saction string, scbytes bigint, csbytes bigint, method string, urischeme string, "
    "host string, port bigint, path string, query string, username string, user_group string, "
    "sname string, contenttype string, referer string, agent string, action string, "
    "categories string, tlsver string, tlscipher string, ciphersize string, malware string, "
    "proxyip string, date date"
)

FW = _schema(
    "source string, time string, event_ts timestamp, action string, srcip string, "
    "dstip string, len bigint, ttl bigint, proto string, srcport bigint, dstport bigint, "
    "date date"
)

CISCOVPN = _schema(
    "source string, time string, event_ts timestamp, username string, remoteip string, "
    "localip string, duration string, duration_sec bigint, bytesxmt bigint, bytesrcv bigint, "
    "reason string, date date"
)

BASH = _schema(
    "source string, username string, exec_as string, srcip string, command string, date date"
)

APACHE = _schema(
    "ip_address string, client_identd string, user_id string, date_time string, "
    "event_ts timestamp, method string, endpoint string, protocol string, "
    "response_code bigint, content_size bigint, date date"
)

OTX = _schema("ip string, reason string")
C2 = _schema("host string, reason string")
OPENPHISH = _schema("url string, reason string")

DIRECTORY = _schema("emailaddress string, c string")
IP_RANGES = _schema("lo bigint, hi bigint, cc string")
TIMELINE = _schema("date string, short string")
RANK_LIST = _schema("rank bigint, domain string")

# Software inventory; all text, as delivered.
SCCM_VULN = _schema(
    ", ".join(
        f"{name} string"
        for name in (
            "ResourceID", "Distinguished_Name0", "Full_Domain_Name0", "Is_Virtual_Machine0",
            "Name0", "Operating_System_Name_and0", "Resource_Domain_OR_Workgr0", "Site_X",
            "Region_X", "Zone_X", "HostFn_X", "ONBE_Gp_X", "Corp_App_X", "Exclude_X",
            "DisplayName0", "InstallDate0", "Publisher0", "Version0", "arch_X", "vendor_X",
            "t_cve_name", "cvss_score", "cvss_acc_cmpl_cat", "cvss_acc_vect_cat", "crit_X_cat",
        )
    )
)

SITE_PRODUCTS = ("adobe-flash", "adobe-rdr", "chrome", "firefox", "java")
SITE_REGIONS = ("APAC", "EMEA", "NCSA")
SITE_MATRIX = StructType(
    [
        StructField(product, StructType([StructField(r, LongType()) for r in SITE_REGIONS]))
        for product in SITE_PRODUCTS
    ]
)

# Tables the log parsers fill.
EVENT_TABLES = {
    "proxysg": PROXYSG,
    "fw": FW,
    "ciscovpn": CISCOVPN,
    "bash": BASH,
    "apache": APACHE,
}

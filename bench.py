"""Times the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from vigil.session import build_session  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
RUNS = int(os.environ.get("BENCH_RUNS", "2"))

HEADLINE = (
    "fw_denied_ports", "fw_denied_dst", "fw_dashboard", "fw_top_talkers", "fw_ioc_hits", "ioc_cidr_hits",
    "proxy_user_malware", "top_transfers", "top_transfer_totals", "rare_user_agents", "top_hosts",
    "outdated_clients", "proxy_ioc_hits", "proxy_ioc_users", "vpn_logins_by_user", "vpn_ips_by_user",
    "vpn_foreign_logins", "geo_enrich", "bash_keyword", "patch_top_all", "patch_dashboard", "patch_hosts",
    "timeline_deleted", "timeline_filetypes", "adhoc_search", "parse_fw", "parse_proxy_plain",
    "parse_proxy_tls", "parse_vpn_logout", "parse_bash", "route_lines", "feed_c2_union", "rare_group_rows",
    "domain_entropy", "ngram_vocab", "ngram_score", "dga_features", "dga_host_clients", "ingest_append",
    "scan_date_range", "stream_file_sink", "cmd_clusters", "ingest_rejects", "src_csv_utf16", "stream_ingest",
    "ingest_batch_and_stream", "dga_model_eval",
)


def main() -> None:
    spark = build_session(
        "vigil bench",
        master=f"local[{CPUS}]",
        spark__sql__shuffle__partitions=CPUS,
        spark__ui__enabled="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "12g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    from bindings.queries import QUERIES

    # Starts the JVM's code paths before anything is timed.
    QUERIES["fw_denied_ports"](spark, FOLDER).write.format("noop").mode("overwrite").save()
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        runs = []
        for _ in range(RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        # The first run pays for compiling the query.
        seconds[name] = round(statistics.median(runs[1:] or runs), 3)
    print(
        json.dumps(
            {
                "metric": "total warm time of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(FOLDER).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

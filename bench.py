"""Times the headline queries; prints one JSON line.

``derive_inputs`` is the time to write the record and reference tables that all queries read.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from listprep.plans import catalog, derived
from listprep.session import local_session

HEADLINE = (
    "email_verdict",
    "geo_verdict",
    "business_verdict",
    "vin_verdict",
    "purchase_date_parts",
    "address_dedup_kept",
    "address_dedup_rejected",
    "vin_dedup",
    "vin_rule_lookup",
    "vin_rule_lookup_large",
    "brand_relookup",
    "ucc_enrich",
    "desc_enrich",
    "sequence_numbers",
    "panel_chunks",
    "vin_batches",
    "cellcode_pivot",
    "reject_report",
    "step_audit",
    "unify_sources",
    "source_conflicts",
    "csv_mixed_encoding",
    "full_job",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}

    def timed(name, action) -> None:
        start = time.perf_counter()
        action()
        seconds[name] = round(time.perf_counter() - start, 3)

    timed("derive_inputs", lambda: (derived.vehicle_sales(spark, sf_dir), derived.references(spark, sf_dir)))
    for name in HEADLINE:
        build = catalog.REGISTERED[name]
        timed(name, lambda build=build: build(spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

import json
import os
import time

from ratewright import plans  # noqa: F401  registers the queries
from ratewright.registry import QUERIES
from ratewright.session import session

HEADLINE = ["A05_day_summary", "W01_W02_M12_entry_rates", "W07_M15_trend", "M01_J10_J11_dedup", "M02_first_pass", "M06_A18_score", "M19_W08_projection", "A13_median", "J18_A04_balances", "M11_U03_dirty", "M02_entries_as_table"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    settings = {"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    spark = session("bench", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    QUERIES["W04_A17_gaps"].build(spark, sf).write.format("noop").mode("overwrite").save()  # so that no headline query pays for the first scan and compilation
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name].build(spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()

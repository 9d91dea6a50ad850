"""Times discovery and exact checks in a warm session and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gainsay import discover  # noqa: E402
from gainsay.operators import verify  # noqa: E402
from gainsay.plans import workloads  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
             .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.checkpoint.dir", os.environ.get("BENCH_CHECKPOINT_DIR", "/tmp/gainsay-bench")).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    t = {n: spark.read.parquet(f"{SF_DIR}/{n}.parquet") for n in ("customer", "nation", "orders", "lineitem", "part", "events")}

    def join(name: str) -> DataFrame:
        return workloads.star_join(t, name)

    inputs = {"customer_nation": lambda: join("join_customer_nation"), "orders": lambda: t["orders"],
              "lineitem": lambda: t["lineitem"], "lineitem_part": lambda: join("join_lineitem_part")}
    queries = {f"discover_{n}_{th:.0e}".replace("e-0", "e-"): (lambda f=f, th=th: discover(f(), th).count())
               for n, f in inputs.items() for th in (1e-2, 1e-4)}
    queries["discover_customer_nation_1e-6"] = lambda: discover(inputs["customer_nation"](), 1e-6).count()
    queries["marginals_lineitem"] = lambda: verify.marginals(t["lineitem"]).collect()
    queries["violation_count_events"] = lambda: verify.violation_count(
        t["events"], [("user_id", "=="), ("event_type", "!=")]).collect()
    queries["violating_rows_two_orders_orders"] = lambda: verify.violating_rows(
        t["orders"], [("o_custkey", "=="), ("o_orderkey", "<="), ("o_totalprice", ">=")]).agg(F.count("*")).collect()
    queries["violating_rows_three_orders_lineitem_part"] = lambda: verify.violating_rows(
        join("join_lineitem_part"), [("l_suppkey", "=="), ("l_quantity", "<"), ("l_extendedprice", ">"), ("p_retailprice", "<=")]).agg(F.count("*")).collect()
    queries["violation_count_two_orders_lineitem"] = lambda: verify.violation_count(
        t["lineitem"], [("l_suppkey", "=="), ("l_quantity", "<"), ("l_extendedprice", ">")]).collect()
    discover(join("join_customer_nation"), 1e-4).count()        # warm-up, not timed
    seconds: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name, run in queries.items():
        began = time.perf_counter()
        got = run()
        seconds[name] = round(time.perf_counter() - began, 3)
        if isinstance(got, int):
            rows[name] = got
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "found": rows}))


if __name__ == "__main__":
    main()

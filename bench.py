"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line with seconds for each and in all."""

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = HERE + os.pathsep + os.environ.get("PYTHONPATH", "")

#: What a user runs most: dispatch and prices, accounts, network joins, and the assembly of the large row families.
HEADLINE = ("merit_dispatch", "nodal_price", "net_trade", "production_by_country", "by_carrier", "marginal_unit", "duration_curve", "dispatch_stack", "lp_cols_dispatch", "lp_rows_balance", "lp_rows_dcflow", "lp_rows_storage", "lp_rows_commitment", "ring_assembly", "ring_year")


def main() -> None:
    from pyspark.sql import SparkSession

    from feederflow.plans.lp import Assembly, triplets
    from feederflow.queries import QUERIES
    from feederflow.sources.synthetic import ring

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    def assembly(hours):
        """The numbered coefficients of a ring of 256 buses: 559,104 nonzeros over 168 hours, 29,153,280 over a year."""
        return lambda spark, _: triplets(Assembly(ring(spark, 256, hours)).model(("dc_flow", "storage_balance")))[2]

    rings = {"ring_assembly": assembly(168), "ring_year": assembly(8760)}
    took = {}
    QUERIES["nodal_price"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # the first run compiles
    for name in HEADLINE:
        f = rings.get(name) or QUERIES[name]
        began = time.time()
        f(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()

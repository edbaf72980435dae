"""Times the headline queries and prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from plume import jobs

HEADLINE = (
    "conc_grid", "layer_time_mean", "density_surface_submerged_stranded", "species_depth_density", "lifespan_matrix", "budget_timeseries",
    "film_thickness", "trajectory_length", "skill_liu_weisberg", "asof_nearest", "air_sea_flux", "knn_redistribute", "nearest_site",
    "bilinear_sample", "diffusion_grid_step", "node_gradient", "okubo_weiss", "rk4_step", "mass_feedback_fold", "session_tracks",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    jobs.QUERIES["conc_grid"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the executors
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        jobs.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()

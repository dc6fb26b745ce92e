"""Times the headline queries over all rows of the tables in $BENCH_SF_DIR and prints one line of JSON.

Images are made of the tables and stored first, untimed: what is timed is the work on images that are there. The first
query runs once untimed, and a query's time is the median of RUNS. Tables of few images are stored several times over, so that it is
images that are timed and not the start of jobs.
"""

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from photonlake.plans.queries import FIXTURES, QUERIES

HEADLINE = {
    "camera_records": "part_images", "images_by_make": "part_images", "tags_by_directory": "part_images", "xmp_records": "customer_images", "gps_places": "event_images",
    "caption_priority": "priority_images", "captured_by_month": "order_images", "stamped": "priority_images", "tiff_edited": "tiff_images", "makernote_tags": "canon_images",
}

#: Timed runs of a query, and the images that its table has at least.
RUNS, IMAGES = 3, 40_000


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "4m").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    with tempfile.TemporaryDirectory(prefix="spark-bench-") as folder:
        images = {}
        for name in sorted(set(HEADLINE.values())):
            FIXTURES[name](spark, sf_dir).write.parquet(f"{folder}/{name}-once")
            once = spark.read.parquet(f"{folder}/{name}-once")
            copies = max(1, -(-IMAGES // max(1, once.count())))
            once.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("copy").repartition(4 * int(cpus)).write.parquet(f"{folder}/{name}")
            images[name] = spark.read.parquet(f"{folder}/{name}").count()
        spark.conf.set("photonlake.fixtures", folder)
        seconds = {}
        for name in HEADLINE:
            times = []
            for _ in range(RUNS + (not seconds)):
                start = time.perf_counter()
                QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                times.append(time.perf_counter() - start)
            seconds[name] = round(statistics.median(times[-RUNS:]), 3)
        micros = {n: round(1e6 * s / images[HEADLINE[n]], 1) for n, s in seconds.items()}
        spark.stop()
    print(json.dumps({"metric": "headline queries over stored images", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "us_an_image": micros, "images": {n: images[t] for n, t in HEADLINE.items()}, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()

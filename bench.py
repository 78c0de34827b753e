"""Time the headline queries and print one JSON line.

BENCH_SF_DIR   folder of tables   (default /root/testdata/sf0.1)
BENCH_CPUS     local threads      (default 8)
"""

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

from lumirank import build_session  # noqa: E402
from lumirank.registry.queries import queries  # noqa: E402

HEADLINES = [
    "topk_cosine",
    "topk_cell_join",
    "topk_many_queries",
    "topk_grid",
    "topk_approx",
    "text_embed",
    "text_search_top10",
    "normalize_pixels_sql",
    "preprocess_rgb",
    "preprocess_rows",
    "embed_images",
    "image_ingest",
    "upsert_latest",
    "read_namespace",
    "micro_batches",
    "micro_batches_unkeyed",
    "session_windows",
    "throughput_windows",
    "moving_average_by_type",
    "run_summary_by_user",
    "log_throughput",
    "encode_rows_indexed",
    "decode_roundtrip",
    "row_index",
    "row_index_sliced",
    "resolve_existing_path",
    "stream_sessions",
    "stream_micro_batches",
    "stream_micro_batches_files",
    "stream_ingest",
    "stream_search",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    # Start the JVM's and the workers' code paths before the clock runs.
    registered["text_search_top10"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in sys.argv[1:] or HEADLINES:
        start = time.perf_counter()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    out = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(folder).name.removeprefix("sf"),
    }
    print(json.dumps(out), flush=True)


if __name__ == "__main__":
    main()

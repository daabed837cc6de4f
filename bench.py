"""Time every registered query: prints one JSON line. BENCH_SF_DIR, BENCH_CPUS and BENCH_ONLY
(comma-separated query names) may be set."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from persona_checks.queries import QUERIES  # noqa: E402
from persona_spark.session import build_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n] or list(QUERIES)
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "6g"),
            "spark.sql.shuffle.partitions": str(2 * int(cpus)),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("to_conversation" if "to_conversation" in only else only[0])  # start-up of the JVM is not timed
    seconds = {name: run(name) for name in only}
    print(
        json.dumps(
            {
                "metric": "all_queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

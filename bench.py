"""Times the headline queries on one machine and prints one JSON line.

``BENCH_SF_DIR`` names the input folder, ``BENCH_CPUS`` the number of cores. Reports are
timed twice where it makes a difference: over the events (``raw_*``, and views computed in
the query) and over the stored views that ``store_build`` writes (``stored_*``). The time of a
query is the better of two runs, planning included; what writes tables runs once.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from retally.catalog import scenario  # noqa: E402
from retally.catalog.queries import END, QUERIES, START  # noqa: E402
from retally.fixtures import keyed_events, line_events  # noqa: E402
from retally.operators import changelog, keyed  # noqa: E402
from retally.plans import reports, views  # noqa: E402
from retally.session import local_session, shared_folder  # noqa: E402
from retally.sources import changes  # noqa: E402
from retally.streaming.maintain import maintain  # noqa: E402
from retally.streaming.store import ViewStore  # noqa: E402

HEADLINE = [
    "view_quad",
    "view_dyad",
    "view_actor",
    "view_cameo",
    "recompute_quad",
    "recompute_dyad",
    "recompute_actor",
    "recompute_cameo",
    "raw_daily",
    "raw_actors",
    "raw_dyads",
    "raw_cameo",
    "kpis",
    "trend",
    "top_actors_iso",
    "top_dyads",
    "top_cameo",
    "quad_dist",
    "quad_time",
    "dyad_heatmap",
    "update_by_key",
    "upsert_by_key",
    "changelog_delta_dyad",
    "load_text",
]

STORED = {
    "daily": (reports.rollup_daily, "quad"),
    "actors": (reports.rollup_actors, "actor"),
    "dyads": (reports.rollup_dyads, "dyad"),
    "cameo": (reports.rollup_cameo, "cameo"),
    "kpis": (reports.kpis, "quad"),
    "trend": (reports.trend, "quad"),
    "quad_time": (reports.quad_time, "quad"),
}


def timed(action, runs: int = 1) -> float:
    """Seconds of the fastest run."""
    seconds = []
    for _ in range(runs):
        start = time.perf_counter()
        action()
        seconds.append(time.perf_counter() - start)
    return round(min(seconds), 3)


def run(df) -> None:
    """Compute every row and column without moving them to the driver."""
    df.write.format("noop").mode("overwrite").save()


def stream_seconds(spark, folder: str) -> dict[str, float]:
    """Seconds from sending records into a feed until all four views show them, with the
    maintaining stream running: first the whole event log, then a round of changes of it."""
    place = f"{shared_folder(spark)}/bench-{uuid.uuid4().hex}"
    feed, events = f"{place}/feed", keyed_events(spark, folder)
    changes.write_changes(changelog.snapshot_records(events.limit(0)), feed)
    stream = changes.stream_changes(spark, feed)
    query = maintain(stream, f"{place}/views", f"{place}/checkpoint")

    def send(records) -> None:
        changes.write_changes(records, feed)
        query.processAllAvailable()

    seconds = {
        "stream_snapshot": timed(lambda: send(changelog.snapshot_records(events))),
        "stream_changes": timed(lambda: send(scenario.all_changes(events))),
    }
    # Batches of new rows on the store that has the rest already, the trigger as by default.
    low, high = keyed.id_range(events)
    for k, n in enumerate((1_000, 5_000, 10_000), start=2):
        new = keyed.shift_ids(keyed.sample_keys(events, n, str(n)), k * (high - low + 1))
        seconds[f"stream_append_{n}"] = timed(lambda new=new: send(changelog.insert_records(new)))
    query.stop()
    return seconds


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    run(QUERIES["view_quad"](spark, folder))  # start executors and compile once

    def query(name: str):
        return lambda: run(QUERIES[name](spark, folder))

    seconds = {name: timed(query(name), runs=2) for name in HEADLINE}

    events = line_events(spark, folder, *views.ALL_KEYS, *views.MEASURED)
    stores = []

    def build() -> None:
        stores.append(ViewStore(spark, f"{shared_folder(spark)}/bench-{uuid.uuid4().hex}"))
        stores[-1].add(views.entering(events), 0)

    seconds["store_build"] = timed(build, runs=2)
    store = stores[-1]
    for name, (report, view) in STORED.items():

        def stored(report=report, view=view):
            run(report(store.view(view), START, END))

        seconds[f"stored_{name}"] = timed(stored, runs=2)
    seconds |= stream_seconds(spark, folder)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": cores,
            }
        )
    )


if __name__ == "__main__":
    main()

"""Stage and task times from a Spark event log (no UI, no server).

Usage: python tools/stage_times.py <event-log file or eventlog_v2_* folder> [top_n]

Prints the slowest stages with their task count and the max / median task
time. A max far above the median is a straggler -- the sign of a hot key
that was not split.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
from collections import defaultdict


def _lines(path: str):
    """Events of a plain log file or of a rolling ``eventlog_v2_*`` folder."""
    files = [path]
    if os.path.isdir(path):
        files = sorted(
            (os.path.join(path, f) for f in os.listdir(path) if f.startswith("events_")),
            key=lambda f: int(os.path.basename(f).split("_")[1]),
        )
    for f in files:
        if f.endswith(".zstd"):  # Spark compresses event logs with zstd by default
            import io

            import zstandard

            with open(f, "rb") as raw:
                reader = zstandard.ZstdDecompressor().stream_reader(raw)
                yield from io.TextIOWrapper(reader, encoding="utf-8")
        else:
            with open(f) as fh:
                yield from fh


def main() -> None:
    path = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 15
    names: dict[tuple, str] = {}
    spans: dict[tuple, list[int]] = {}
    tasks: dict[tuple, list[int]] = defaultdict(list)
    for line in _lines(path):
        ev = json.loads(line)
        kind = ev.get("Event")
        if kind == "SparkListenerStageCompleted":
            info = ev["Stage Info"]
            key = (info["Stage ID"], info["Stage Attempt ID"])
            names[key] = info["Stage Name"]
            spans[key] = [info.get("Submission Time", 0), info.get("Completion Time", 0)]
        elif kind == "SparkListenerTaskEnd":
            key = (ev["Stage ID"], ev["Stage Attempt ID"])
            t = ev["Task Info"]
            tasks[key].append(t["Finish Time"] - t["Launch Time"])
    rows = []
    for key, (start, end) in spans.items():
        times = tasks.get(key, [0])
        rows.append((end - start, key, len(times), max(times), statistics.median(times)))
    rows.sort(reverse=True)
    print(f"{'stage':>8} {'ms':>8} {'tasks':>6} {'max ms':>8} {'median ms':>10}  name")
    for dur, key, n, mx, med in rows[:top]:
        print(f"{key[0]:>8} {dur:>8} {n:>6} {mx:>8} {med:>10.0f}  {names[key][:60]}")


if __name__ == "__main__":
    main()

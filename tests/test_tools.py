"""The event-log reader used to look for stragglers."""

import json
import os
import subprocess
import sys

import zstandard

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_stage_times_reads_rolling_zstd_log(tmp_path):
    events = [
        {"Event": "SparkListenerTaskEnd", "Stage ID": 3, "Stage Attempt ID": 0,
         "Task Info": {"Launch Time": 0, "Finish Time": t}} for t in (10, 12, 900)
    ] + [
        {"Event": "SparkListenerStageCompleted",
         "Stage Info": {"Stage ID": 3, "Stage Attempt ID": 0, "Stage Name": "join",
                        "Submission Time": 0, "Completion Time": 905}},
    ]
    folder = tmp_path / "eventlog_v2_local-1"
    folder.mkdir()
    data = "\n".join(json.dumps(e) for e in events).encode() + b"\n"
    (folder / "events_1_local-1.zstd").write_bytes(zstandard.ZstdCompressor().compress(data))
    out = subprocess.run([sys.executable, os.path.join(ROOT, "tools", "stage_times.py"),
                          str(folder)], capture_output=True, text=True, check=True).stdout
    row = out.splitlines()[1].split()
    assert row[:5] == ["3", "905", "3", "900", "12"]  # max far above median: a straggler

"""bench.py prints exactly one JSON line with the driver's fields."""

import json
import os
import subprocess
import sys

from .conftest import SF_SMALL


def test_bench_prints_one_json_line():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = dict(os.environ, BENCH_SF_DIR=SF_SMALL, BENCH_CPUS="2", BENCH_WARM="1",
               BENCH_QUERIES="nation_stats,standings")
    out = subprocess.run([sys.executable, os.path.join(root, "bench.py")], capture_output=True,
                         text=True, timeout=600, env=env)
    assert out.returncode == 0, out.stderr[-2000:]
    lines = [x for x in out.stdout.splitlines() if x.strip()]
    assert len(lines) == 1
    d = json.loads(lines[0])
    assert d["unit"] == "sec" and d["sf"] == "0.001" and set(d["queries"]) == {"nation_stats", "standings"}
    assert d["value"] == round(sum(d["queries"].values()), 3)

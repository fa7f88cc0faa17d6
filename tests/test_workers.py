import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as e
from flowhorizon.session import build_session
spark = build_session(master="local[2]", **{{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false"}})
for name in ("chain_heads", "packet_flows_tcp"):
    assert e.queries()[name](spark, {sf!r}).count() > 0
"""


def test_workers_do_not_need_the_package(sf, tmp_path):
    """The driver may run from any folder; workers get their functions by value."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = CODE.format(root=str(ROOT), sf=sf)
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]

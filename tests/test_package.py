import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
JOB = """
from scoreloom.functions.canonical import canonical_sha256
from scoreloom.session import get_spark
spark = get_spark("elsewhere", "local[1]", **{"spark.ui.enabled": "false", "spark.log.level": "ERROR"})
print("digest", canonical_sha256(spark.createDataFrame([(1, "x")], "a long, b string"), ["a", "b"]).first().digest)
"""


def test_runs_from_another_folder(tmp_path):
    """Python workers find the package when only the session was made in another folder."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = f"import sys; sys.path.insert(0, {ROOT!r})\n{JOB}"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "digest " in out.stdout, out.stderr[-2000:]

import subprocess
import sys
from pathlib import Path

HERE = Path(__file__).resolve().parent


def test_every_file_is_collected():
    got = subprocess.run([sys.executable, "-B", "-m", "pytest", str(HERE), "--collect-only", "-q", "-p", "no:cacheprovider"], cwd=HERE.parent, capture_output=True, text=True)
    assert got.returncode == 0, got.stdout[-1500:]
    assert not {str(p.relative_to(HERE.parent)) for p in HERE.rglob("test_*.py")} - {line.partition("::")[0] for line in got.stdout.splitlines()}

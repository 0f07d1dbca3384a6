import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') and n[2].isdigit() for n in e.queries()))"


def entry(folder):
    return subprocess.run([sys.executable, "-B", "-c", COUNT], cwd=folder, capture_output=True, text=True)


def test_only_the_absent_subpackage_is_forgiven(tmp_path):
    shutil.copy(f"{HERE}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{HERE}/tideframe", tmp_path / "tideframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    without = entry(tmp_path)
    assert without.returncode == 0 and without.stdout.split()[1] == "False"
    broken = tmp_path / "tideframe" / "llm"
    broken.mkdir()
    (broken / "__init__.py").write_text("")
    (broken / "queries.py").write_text("import a_library_that_is_not_there\n")
    assert "a_library_that_is_not_there" in entry(tmp_path).stderr
    (broken / "queries.py").unlink()
    (broken / "__init__.py").unlink()
    assert entry(tmp_path).returncode == 0

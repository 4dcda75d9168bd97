"""What the driver imports stands without the subpackage on texts, or the libraries it needs."""

import os
import shutil
import subprocess
import sys

from conftest import ROOT

COUNT = "import __spark_entry__ as e; print(len(e.queries()), sorted(set(e.oracle_sql()) - set(e.queries())))"
WITHOUT = "import sys\nsys.modules['{0}'] = None\n"


def names(folder, before=""):
    env = {**os.environ, "PYTHONPATH": str(folder)}
    run = subprocess.run([sys.executable, "-c", before + COUNT], cwd=folder, env=env, capture_output=True, text=True)
    return run.stdout.split(maxsplit=1) if run.returncode == 0 else run.stderr


def test_entry_without_texts(tmp_path):
    shutil.copytree(f"{ROOT}/framesift", tmp_path / "framesift", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    core = names(tmp_path)
    assert int(core[0]) >= 82 and core[1].strip() == "[]"
    # Libraries that the texts' operators need aren't there: the others' queries are.
    for library in ("regex", "ahocorasick", "public_tokenizers"):
        assert int(names(ROOT, WITHOUT.format(library))[0]) >= int(core[0])


def test_core_modules_must_be_whole(tmp_path):
    shutil.copytree(f"{ROOT}/framesift", tmp_path / "framesift", ignore=shutil.ignore_patterns("llm", "ranking.py", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    assert "ranking" in names(tmp_path)

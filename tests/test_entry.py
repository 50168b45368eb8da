"""What the driver imports, with and without the folder of training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; print(sorted(set(e.queries()) | set(e.oracle_sql())))"


def names(folder: str) -> set[str]:
    run = subprocess.run([sys.executable, "-c", SAY], cwd=folder, capture_output=True, text=True, check=True,
                         env={**os.environ, "PYTHONPATH": folder})
    return set(eval(run.stdout.strip().splitlines()[-1]))


def copy_without(tmp_path, *left_out: str) -> str:
    target = str(tmp_path / "copy")
    os.makedirs(target)
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in left_out and os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", target)
    skip = shutil.ignore_patterns("__pycache__", *left_out)
    shutil.copytree(f"{ROOT}/findling", f"{target}/findling", ignore=skip)
    return target


def test_without_the_optional_folder(tmp_path):
    left = names(copy_without(tmp_path, "llm", "corpus_pipeline.py"))
    assert "hybrid_search" in left and not any(n.startswith("op") or n == "pipeline" for n in left)


def test_no_module_of_the_library_imports_it():
    for folder, _, files in os.walk(f"{ROOT}/findling"):
        if os.path.basename(folder) == "llm":
            continue
        for name in files:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    assert "findling.llm" not in f.read(), name

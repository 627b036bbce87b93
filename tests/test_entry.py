import os
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

WITHOUT = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("rivulet.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = set(e.queries())
assert "latest_documents" in names and not any(n.startswith("op") and n[2:3].isdigit() or n == "pipeline" for n in names), names
assert set(e.oracle_sql()) <= names
"""


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["document_id", "event_type", "k"] and df.count() > 0


def test_entry_without_the_optional_subpackage():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_the_subpackage():
    for folder, _, names in os.walk(os.path.join(ROOT, "rivulet")):
        if f"{os.sep}llm" in folder:
            continue
        for n in (n for n in names if n.endswith(".py")):
            with open(os.path.join(folder, n)) as f:
                assert "rivulet.llm" not in (text := f.read()) and ".llm" not in text

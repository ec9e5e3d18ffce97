"""The driver's contract, with and without the text subpackage."""

import subprocess
import sys

import __spark_entry__ as entry


def test_entry(spark, sf_dir):
    df = entry.entry(spark)
    assert df.columns == ["nation", "cnt", "total"]
    assert df.count() > 0


def test_sql_belongs_to_queries():
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert len(entry.queries()) >= 90


def test_without_text_operators():
    """With the subpackage gone, the graph queries are still there."""
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("sparkloom.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = set(e.queries())
assert "triangle_count" in names and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
assert set(e.oracle_sql()) <= names
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=entry.__file__.rpartition("/")[0])
    assert done.returncode == 0, done.stderr


def test_library_does_not_import_text_operators():
    code = "import sys, sparkloom.queries; assert not [m for m in sys.modules if m.startswith('sparkloom.llm')]"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=entry.__file__.rpartition("/")[0])
    assert done.returncode == 0, done.stderr

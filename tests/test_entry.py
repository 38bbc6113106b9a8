import subprocess
import sys


def test_entry_without_the_training_data_subpackage(tmp_path):
    """The entry module and the engine's queries stand without it."""
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("palaver.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert len(e.queries()) > 50 and not [q for q in e.queries() if q.startswith("op")] and "pipeline" not in e.queries()
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())

import os
import subprocess
import sys

import __spark_entry__ as entry
from agora.plans import registry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "avg_toxicity" in df.columns


def test_oracles_are_registered_queries():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 50
    assert registry.load_errors == {}


def run(code: str) -> str:
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    return out.stdout


def test_queries_load_without_the_training_data_folders():
    """With those modules out of reach the other queries are all there."""
    assert "True" in run("""
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("agora.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
from agora.plans.registry import load_all
print(set(e.queries()) == set(load_all()) and set(e.oracle_sql()) <= set(load_all()))""")


def test_queries_load_without_reading_files_of_the_installation():
    """No jar, no folder of pyspark's and no JVM is looked at while the catalogue is imported."""
    assert "seen: []" in run("""
import sys, pyspark, duckdb
from pyspark import ml, sql
from pyspark.sql import functions, streaming, types
seen = []
def hook(event, args):
    path = str(args[0]) if args else ""
    if event in ("open", "os.listdir", "subprocess.Popen") and (path.endswith(".jar") or path.endswith("/jars") or event == "subprocess.Popen"):
        seen.append((event, path))
sys.addaudithook(hook)
import __spark_entry__ as e
e.queries(), e.oracle_sql()
print("seen:", seen)""")


def test_one_broken_module_hides_only_its_own_queries():
    assert "True" in run("""
import sys, warnings
warnings.simplefilter("ignore")
class Broken:
    def find_spec(self, name, path=None, target=None):
        if name == "agora.plans.clustering":
            raise RuntimeError("broken")
sys.meta_path.insert(0, Broken())
from agora.plans import registry
q = registry.load_all()
print(len(q) > 40 and list(registry.load_errors) == ["clustering"])""")

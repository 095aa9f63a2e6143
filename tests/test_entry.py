"""The entry module with the optional subpackage whole, broken and absent."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
BREAK = """
import sys
sys.path.insert(0, {root!r})
class Finder:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r}:
            raise ImportError(name)
sys.meta_path.insert(0, Finder())
import __spark_entry__ as e
from loomwork.plans import registry
own = set(registry.queries())
got = set(e.queries())
assert own <= got and set(e.oracle_sql()) <= got
print(len(got - own))
"""


def beyond(name):
    out = subprocess.run([sys.executable, "-c", BREAK.format(root=str(ROOT), name=name)], capture_output=True, text=True, check=True)
    return int(out.stdout.split()[-1])


def test_library_queries_stay_when_the_subpackage_does_not_import():
    assert beyond("loomwork.llm") == beyond("loomwork.llm.queries") == beyond("loomwork.llm._common") == 0

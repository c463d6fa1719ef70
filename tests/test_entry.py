"""The driver's entry without the training-data part."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_without_the_libraries_of_a_part():
    code = """
import sys
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name.split('.')[0] in ('tiktoken', 'tokenizers', 'xxhash', 'public_tokenizers'):
            raise ModuleNotFoundError(f'No module named {name}', name=name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as driver
names = driver.queries()
assert len(names) > 90 and 'pipeline' not in names and not any(n.startswith('op') for n in names)
assert set(driver.oracle_sql()) <= set(names)
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)

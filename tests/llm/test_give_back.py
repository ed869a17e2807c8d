"""Freed memory of a worker goes back to the system."""

import subprocess
import sys

CODE = """
import numpy as np
from vecprune.llm import lm

def held():
    with open("/proc/self/smaps_rollup") as f:
        return next(int(line.split()[1]) for line in f if line.startswith("Pss_Anon")) // 1024

lm.give_back()
before = held()
# Small arrays, each second one kept a while, as between the chunks of a text.
arrays = [np.ones(8192) for _ in range(3000)]
last = np.ones(8192)
del arrays
lm.give_back()
assert held() < before + 60, (before, held())
"""


def test_memory_is_returned():
    done = subprocess.run([sys.executable, "-c", CODE], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr

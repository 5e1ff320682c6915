"""Memory that workers hold on to between and within tasks."""

import subprocess
import sys
from pathlib import Path

import pytest

PROBE = """
import ctypes, numpy as np
from graphloom.llm.common import releasing
class Info(ctypes.Structure):
    _fields_ = [(x, ctypes.c_size_t) for x in "arena ordblks smblks hblks hblkhd usmblks fsmblks uordblks fordblks keepcost".split()]
mallinfo = ctypes.CDLL("libc.so.6").mallinfo2
mallinfo.restype = Info
@releasing
def run(batches):
    np.ones(24 << 20, np.uint8)  # freed at once: the bound of mapped blocks would rise to 24 MB
    before = mallinfo().hblkhd
    kept = np.ones(8 << 20, np.uint8)
    yield mallinfo().hblkhd - before >= len(kept)
print(*run(()))
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="asks the GNU C library")
def test_large_arrays_are_mapped_whatever_was_freed_before():
    root = Path(__file__).resolve().parents[2]
    assert subprocess.run([sys.executable, "-c", PROBE], cwd=root, capture_output=True, text=True, check=True).stdout.split() == ["True"]

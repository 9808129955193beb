"""The shape of the test suite itself."""

from __future__ import annotations

from collections import Counter
from pathlib import Path


def test_every_test_file_has_a_name_of_its_own():
    names = Counter(p.name for p in Path(__file__).parent.rglob("test_*.py"))
    assert not [name for name, n in names.items() if n > 1]

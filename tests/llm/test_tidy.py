"""The driver clears its heap between steps before it has grown to its bound."""

from types import SimpleNamespace

import pytest

from driftmesh.llm import common


@pytest.mark.parametrize(("used", "cleared"), [(100, 0), (400, 0), (401, 1), (900, 1)])
def test_heap_is_cleared_from_two_fifths_on(used, cleared):
    calls = []
    heap = SimpleNamespace(totalMemory=lambda: 950, freeMemory=lambda: 950 - used, maxMemory=lambda: 1000)
    jvm = SimpleNamespace(java=SimpleNamespace(lang=SimpleNamespace(Runtime=SimpleNamespace(getRuntime=lambda: heap))), System=SimpleNamespace(gc=lambda: calls.append(1)))
    common.tidy(SimpleNamespace(sparkContext=SimpleNamespace(_jvm=jvm)))
    assert len(calls) == cleared

import numpy as np
import pyarrow as pa
import pytest

from stratalith.llm.common import sorted_groups


@pytest.mark.parametrize("most", [1, 2, 5, 1000])
@pytest.mark.parametrize("size", [1, 3, 7, 100])
def test_groups_are_whole_or_parted(most, size):
    rng = np.random.default_rng(most * 100 + size)
    keys = np.sort(rng.choice([1, 2, 3, 4, 9, 11, 12, 13, 40], 90, p=[0.05, 0.4, 0.02, 0.03, 0.2, 0.1, 0.1, 0.05, 0.05]))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[a : a + size]), pa.array(np.arange(90)[a : a + size])], names=["k", "n"]) for a in range(0, 90, size)]
    batches.insert(1, batches[0].slice(0, 0))
    tables = [t for t in sorted_groups(iter(batches), "k", most)]
    assert sum((t.column("n").to_pylist() for t in tables), []) == list(range(90))
    assert all(len(t) for t in tables)
    ends = {}
    for n, t in enumerate(tables):
        for k in set(t.column("k").to_pylist()):
            ends.setdefault(k, []).append(n)
    for k, where in ends.items():
        if len(where) > 1:  # parts of a group hold nothing else, and enough
            assert all(set(tables[n].column("k").to_pylist()) == {k} for n in where)
            assert all(len(tables[n]) >= most for n in where[:-1])

"""What a Python worker holds at a time and keeps between tasks."""

import sys
import tracemalloc
import weakref

import numpy as np
import pyarrow as pa
import pytest

from additiva.llm import bpe, common, toxicity


def test_another_operator_gets_no_tables_of_the_one_before():
    """Workers are used again: without this one that encoded a moment ago held the tokenizer while the model is fitted."""
    ref = weakref.ref(t := bpe.transducer(bpe.tokenizer_spec()))
    assert bpe.transducer(bpe.tokenizer_spec()) is t
    list(t.encode("Two words, 𝒳 and more."))
    del t
    assert list(toxicity._fitting(iter([]))) == []
    assert ref() is None


def test_words_are_remembered_in_few_bytes():
    places = toxicity.Places()
    held = lambda x: sys.getsizeof(x) + (sum(map(sys.getsizeof, x)) if isinstance(x, list) else 0)
    assert held(places["abcdefgh"]) < 100


def test_fitting_copies_no_features():
    rng, n, m = np.random.default_rng(1), 1500, 3000
    ids = pa.array([str(i) for i in rng.permutation(n)])
    ends = pa.array(np.arange(0, n * m + 1, m, dtype=np.int32))
    k = np.sort(rng.integers(0, toxicity.SPACE, (n, m)), axis=1).astype(np.int32).ravel()
    lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (k, np.ones(n * m, np.float32))]
    data = pa.table({"id": ids, "y": pa.array(rng.integers(0, 2, n).astype(np.int32)), "fold": pa.array(rng.integers(0, 5, n)), "k": lists[0], "v": lists[1]})
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    try:
        assert toxicity.fitted_model(data) is not None
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 5 * n * m and pa.total_allocated_bytes() - before < 1e6


@pytest.mark.parametrize("most", [1, 100, 1 << 20])
def test_parts_are_bounded_and_whole(most):
    texts = ["x" * 30, None, "", "y" * 5000, "z"] * 40
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": pa.array(texts)})
    found = list(common.text_parts([batch, batch.slice(0, 0), batch.slice(3, 2)], 1, most))
    assert pa.Table.from_batches(found).equals(pa.Table.from_batches([batch, batch.slice(3, 2)]))
    assert all(b.num_rows <= max(1, most // 64 + 1) for b in found)

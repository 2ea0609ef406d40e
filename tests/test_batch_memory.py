"""Memory of tasks that turn vectors into doubles."""

import tracemalloc

import numpy as np
import pyarrow as pa

from newslens.operators import transition as tn


def test_a_batch_is_factored_in_slices():
    x = np.random.default_rng(1).normal(size=(16_384, 64))
    lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays([lists], names=["_0"])
    tracemalloc.start()
    try:
        (out,) = tn._factor_rows(iter([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    r = np.array(out.column(1)[0].as_py()).reshape(64, 64)
    assert np.allclose(r.T @ r, x.T @ x)
    assert peak < 5_000_000

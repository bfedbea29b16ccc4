"""What Python workers hold while they train and count: no copies of a task's rows, no second set of workers."""
import tracemalloc

import numpy as np
import pyarrow as pa

from tests.llm.fixtures import documents, prose
from tidewheel.llm import jaccard_join, toxicity


def _peak(call):
    tracemalloc.start()
    try:
        out = call()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_counting_shingles_holds_each_once():
    sh = np.random.default_rng(2).integers(0, 1 << 40, 1 << 20).astype(np.uint64)
    sh[:5000] = sh[5000:10000]
    value, times = np.unique(sh, return_counts=True)
    (got, n), peak = _peak(lambda: jaccard_join.repeats(sh))
    assert got.tolist() == value[times > 1].tolist() and n.tolist() == times[times > 1].tolist()
    assert peak < sh.nbytes / 2  # np.unique takes some four times its input
    for few in ([], [3], [3, 3], [1, 2, 2, 2, 3], [5, 4, 5, 4, 1]):
        value, times = np.unique(np.array(few, np.uint64), return_counts=True)
        got, n = jaccard_join.repeats(np.array(few, np.uint64))
        assert got.tolist() == value[times > 1].tolist() and n.tolist() == times[times > 1].tolist()


def test_a_shard_is_read_in_place():
    one = np.arange(6000, dtype=np.uint16).tobytes()
    batches = [pa.RecordBatch.from_arrays([pa.array([i % 2] * 200, pa.int32()), pa.array([True] * 200), pa.array([one] * 200, pa.binary())], names=["toxic", "aside", "x"]).slice(10) for i in range(3)]
    (x, y, aside), peak = _peak(lambda: toxicity.opened(iter(batches)))
    assert len(x) == len(y) == len(aside) == 570 and all(d.tobytes() == one for d in x)
    assert y.tolist() == [0] * 190 + [1] * 190 + [0] * 190 and aside.all()
    assert peak < 570 * len(one) / 4
    assert len(toxicity.opened(iter([]))[0]) == 0


def test_training_starts_no_workers_of_its_own(spark, monkeypatch):
    """Functions of RDDs run in other workers than those of frames, and both sets keep their memory."""
    frame, refused = type(spark.range(1)), []
    monkeypatch.setattr(frame, "rdd", property(lambda self: refused.append(1)))
    rows = [(i, prose(1000 + i, 20) + (" idiot" if i % 4 == 0 else ""), "en", "s", 0) for i in range(160)]
    lab = [(i, int(i % 4 == 0)) for i in range(160)]
    monkeypatch.setattr(toxicity, "SHARD", 32)
    monkeypatch.setattr(toxicity, "SLICE", 1000, raising=False)  # the last slice of an array is shorter
    m = toxicity.fit(documents(spark, rows), spark.createDataFrame(lab, "doc_id long, toxic int"), epochs=2)
    assert m.trained and not refused and np.isfinite(m.top).all() and np.isfinite(m.tables[0]).all()

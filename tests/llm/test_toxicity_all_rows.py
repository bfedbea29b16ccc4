"""Every labelled row is learnt from, in shards."""
import random
import zlib

import numpy as np

from tests.llm.fixtures import documents, prose
from tidewheel.llm import toxicity


def test_no_labelled_row_is_left_out(spark, monkeypatch):
    seen, real = [], toxicity._initial

    def initial(told, neg, pos, *args):
        seen.append((neg, pos))
        return real(told, neg, pos, *args)

    monkeypatch.setattr(toxicity, "_initial", initial)
    n = 12_600
    rows = [(i, f"w{i % 97} v{i % 31} " + ("idiot" if i % 2 == 0 else "fine"), None, None, 0) for i in range(n)]
    toxicity.fit(documents(spark, rows), spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(n)], "doc_id long, toxic int"), epochs=1)
    own = [i for i in range(n) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert len(own) > 8000 and seen[0] == (sum(i % 2 for i in own), sum(i % 2 == 0 for i in own))


def test_shards_learn_what_one_learns(spark, monkeypatch):
    r = random.Random(5)
    rows = [(i, prose(1000 + i, 40) + (" " + r.choice(["idiot", "loser"]) if i % 5 == 0 else ""), "en", "s", 0) for i in range(400)]
    d, lab = documents(spark, rows), spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "SHARD", 64)
    m = toxicity.fit(d, lab, least=5)
    held = toxicity.score(d, m).filter("held_out").collect()
    assert np.mean([x.predicted == (x.doc_id % 5 == 0) for x in held]) > 0.95
    assert set(m.thresholds) == {"en", None}

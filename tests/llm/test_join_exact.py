"""The Jaccard join is exact whatever its forest finds, and components end in few, shrinking rounds."""
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from tests.llm.fixtures import documents, jaccard_classes, prose
from tidewheel.llm import jaccard_join, shared, text as tx
from tidewheel.llm.components import components


def _texts():
    r, texts = random.Random(8), ["", "one", "two words", "Two  WORDS."]
    for i in range(60):  # pairs around the bound, and rows of one frame
        own = prose(3000 + i, 90).split()
        for changed in (1, 2, 3):
            other = list(own)
            for k in r.sample(range(90), changed):
                other[k] = f"q{i}x{k}"
            texts.append(" ".join(other))
        texts.append(" ".join(own))
    frame = prose(5000, 60).split()
    texts += [" ".join(frame + prose(6000 + i, 4 + i % 9).split()) for i in range(60)]
    return texts


def _want(texts):
    classes, copies = jaccard_classes(texts), Counter(texts)
    least = {}
    for i, t in enumerate(texts):
        least.setdefault(classes[t][0], i)
    return {i: (least[classes[t][0]], classes[t][1], copies[t]) for i, t in enumerate(texts)}


def test_no_link_is_lost_when_the_forest_finds_nothing(spark, monkeypatch):
    nothing = lambda node, *_: shared.materialise(spark.createDataFrame([], "a long, b long"), "meetings")
    monkeypatch.setattr(jaccard_join, "meetings", nothing)
    monkeypatch.setattr(jaccard_join, "RUN", 16)
    texts = _texts()
    frame = documents(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)]).repartition(3)
    want = _want(texts)
    assert {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in jaccard_join.join(frame).collect()} == want
    monkeypatch.setattr(jaccard_join, "COMMON", 2)
    assert {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in jaccard_join.join(frame).collect()} == want


def test_pairs_of_a_run_do_not_depend_on_batches(monkeypatch):
    monkeypatch.setattr(jaccard_join, "RUN", 7)
    r = random.Random(3)
    rows = sorted((r.choice([1, 1, 1, 2, 3, 4]), r.randint(50, 90), n, r.choice([0, 0, n]), r.randint(0, 12)) for n in range(300))
    want = set()
    for i, (t, n, a, c, p) in enumerate(rows):
        for u, m, b, d, q in rows[:i]:
            if t == u and c != d and 10 * m >= 8 * n and 18 * min(n - p, m - q) >= 8 * (n + m):
                want.add((min(a, b), max(a, b)))
    assert want
    for size in (1, 5, 64, 300):
        runs, got = jaccard_join._Runs(0.8), []
        for s in range(0, 300, size):
            got += [tuple(p) for x in runs.step(np.array(rows[s : s + size], np.int64)) for p in x.tolist()]
        got += [tuple(p) for x in runs.step(np.zeros((0, 5), np.int64)) for p in x.tolist()]
        assert set(got) == want and len(got) == len(want)


def test_bitmaps_never_exceed_the_difference():
    for n, changed in ((20, 1), (90, 3), (700, 40), (90, 90)):
        own = [f"w{i}" for i in range(n)]
        other = [f"v{i}" if i < changed else w for i, w in enumerate(own)] + ["more"] * (n // 3)
        sh, at = jaccard_join.shingles(*tx.buffers(pa.array([" ".join(own), " ".join(other)])), 5)
        _, _, bits = jaccard_join.prefixes(sh, at, np.zeros(0, np.uint64), 0.8)
        assert jaccard_join.differing(*bits) <= len(np.setxor1d(sh[: at[1]], sh[at[1] :]))


def test_components_of_chains_stars_and_cliques(spark, monkeypatch):
    r = random.Random(4)
    chain, names = [(i, i + 1) for i in range(300)], list(range(1000, 1400))
    r.shuffle(names)
    mixed = list(zip(names[:150], names[1:151])) + [(names[200], x) for x in names[201:320]] + [(a, b) for a in names[330:350] for b in names[330:350]]
    edges, rows = chain + mixed, []
    real = shared.materialise

    def seen(df, name):
        out = real(df, name)
        if name == "edges":
            rows.append(out.count())
        return out

    monkeypatch.setattr(shared, "materialise", seen)
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parts = [range(301), names[:151], names[200:320], names[330:350]]
    assert got == {v: min(p) for p in parts for v in p}
    assert sum(rows) < 3 * rows[0]  # each round has fewer edges
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

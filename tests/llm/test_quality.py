"""Quality: statistics against plain Python, densities against their formula, held-out accuracy, edges."""
import random
import zlib

import numpy as np
import pyarrow as pa

from tests.llm.fixtures import LOWER, document_rows, documents, prose, words
from tidewheel.llm import quality as ql, text as tx

BASE = sorted({w for t in (prose(9, 3000),) for w in words(t)})


def describe(text):
    """Every statistic by itself, from the string."""
    text = text or ""
    w, log = words(text), np.log1p
    share = lambda a, b: np.log((a / b + ql.EPS) / (1 - min(a / b, 1) + ql.EPS)) if b else np.log(ql.EPS / (1 + ql.EPS))
    spans, at, low = [], 0, text.translate(LOWER)
    for x in w:
        at = low.index(x, at)
        spans.append((at, at + len(x)))
        at += len(x)
    stops = set(".,;:?'\"()-")
    marks = {chr(i) for i in range(33, 127) if not chr(i).isalnum()} - stops
    lines = [x for x in low.split("\n") if x]
    sizes = [len(x) for x in w]
    upper, alpha = sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" or "A" <= c <= "Z" or ord(c) > 127 for c in text)
    n, pairs = len(w), list(zip(w, w[1:]))
    return {
        "chars": log(len(text)), "words": log(n), "word_length": log(np.mean(sizes) if n else 0), "word_spread": log(np.std(sizes) if n else 0),
        "line_words": log(n / max(1, len(lines))), "sentence_words": log(n / (1 + sum(c in ".!?" for c in text))),
        "upper": share(upper, max(alpha, 1)), "capitalised": share(sum("A" <= text[a] <= "Z" for a, _ in spans), n), "digits": share(sum("0" <= c <= "9" for c in text), len(text)),
        "spaces": share(sum(c in "\t\n\r " for c in text), len(text)), "stops": share(sum(c in stops for c in text), len(text)), "marks": share(sum(c in marks for c in text), len(text)),
        "beyond_ascii": share(sum(ord(c) > 127 for c in text), len(text)), "long_words": share(sum(s > 12 for s in sizes), n),
        "distinct_words": log(len(set(w))) / log(max(1, n)), "distinct_pairs": log(len(set(pairs))) / log(max(1, n - 1)),
        "repeats": share(sum(a == b for a, b in pairs), max(1, n - 1)), "commonest": share(max((w.count(x) for x in set(w)), default=1) - 1, n),
        "copied_lines": share(len(lines) - len(set(lines)), len(lines)) if lines else share(1, 1), "marked_words": share(sum(b < len(text) and text[b] in marks for _, b in spans), n),
    }


def test_statistics_match_plain_python():
    texts = [t or "" for _, t, *_ in document_rows() if len(t or "") < 8000] + ["A\nA\n\nb\nA", "\n\n", "x|y| z!!", "Ü", "same same same", "a" * 40 + " b"]
    raw, offs = tx.buffers(pa.array(texts))
    got = ql.describe(raw, offs)
    for t, row in zip(texts, got):
        want = describe(t)
        for (name, v), g in zip(want.items(), row):
            assert abs(v - g) < 1e-9, (name, t[:80], v, g)
    alone = [ql.describe(*tx.buffers(pa.array([t])))[0] for t in texts]
    assert np.allclose(got, alone)  # neighbours do not matter


def corpus(n, seed=1):
    rows, labels, r = [], [], random.Random(seed)
    for i in range(n):
        t, bad = prose(1000 * seed + i, 5 + r.randrange(120)), i % 4 == 0
        if bad:
            t = [lambda: " ".join(x + "$%&" for x in t.split()), lambda: " ".join([t.split()[0]] * 60), lambda: " | ".join(t.split()), lambda: t.upper() + "!!"][i // 4 % 4]()
        rows.append((i, t, "en", "s", len(t)))
        labels.append((i, int(not bad), "x"))
    return rows, labels


def test_quality(spark):
    rows, labels = corpus(600)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, x string")
    stats = ql.statistics(documents(spark, rows))
    m = ql.fit(stats, lab)
    got = ql.score(stats, m).collect()
    assert {r.doc_id for r in got if r.held_out} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 4 != 0) for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    # a held-out label cannot change a score
    other = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, x) for i, q, x in labels], lab.schema)
    assert sorted(ql.score(stats, ql.fit(stats, other)).collect()) == sorted(got)
    # nor can lang, source or id
    moved = documents(spark, [(i + 10_000, t, "fr", "zz", 0) for i, t, *_ in rows])
    assert {r.doc_id - 10_000: r.score for r in ql.score(ql.statistics(moved), m).collect()} == {r.doc_id: r.score for r in got}
    assert ql.fit(stats, lab, most_rows=80).trained


def test_quality_edges(spark):
    rows, labels = corpus(200)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, x string")
    m = ql.fit(ql.statistics(documents(spark, rows + rows[:40])), lab.unionByName(lab.limit(20)))
    odd = document_rows() + [(800, "word " * 400_000, None, None, 0), (801, "É" * 1_500_000, None, None, 0), (802, "\n" * 1_200_000, None, None, 0)]
    got = ql.score(ql.statistics(documents(spark, odd)), m).collect()
    assert len(got) == len(odd) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (0, 1)}) == 1 and len({r.score for r in got if r.doc_id in (6, 7)}) == 1
    assert next(r.predicted for r in got if r.doc_id == 800) == 0
    assert ql.score(ql.statistics(documents(spark, [])), m).collect() == []
    stats = ql.statistics(documents(spark, rows))
    assert {r.score for r in ql.score(stats, ql.fit(stats, lab.limit(0))).collect()} == {0.0}
    assert {r.score for r in ql.score(stats, ql.fit(stats, lab.filter("quality = 1"))).collect()} == {1.0}


def test_densities_match_their_formula():
    r = np.random.default_rng(6)
    z = np.concatenate([r.normal(0, 1, (80, 4)), r.normal(1, 2, (50, 4))])
    y = np.array([0] * 80 + [1] * 50)
    m = ql.Model(trained=True)
    m.means, m.factors, m.logdets = ql._gaussians(z, y, 0.2, 0.03)
    own = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    pooled = (80 * own[0] + 50 * own[1]) / 130
    logs = []
    for c in (0, 1):
        s = 0.8 * own[c] + 0.2 * pooled
        s = 0.97 * s + 0.03 * np.trace(s) / 4 * np.eye(4)
        far = z - z[y == c].mean(axis=0)
        logs.append(-0.5 * np.einsum("ni,ij,nj->n", far, np.linalg.inv(s), far) - 0.5 * np.log(np.linalg.det(s)))
    assert np.allclose(m.difference(z), logs[1] - logs[0])

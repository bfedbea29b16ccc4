"""Source divergence: every part against plain counting, tournaments, edges."""
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.fixtures import documents, prose
from tidewheel.llm import divergence as dv

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=30, top=50):
    groups, docs, lang_docs = defaultdict(Counter), set(), defaultdict(Counter)
    for _, text, lang, source, _ in rows:
        g = (lang or "", source or "")
        words = TERM.findall((text or "").translate(LOWER))
        docs.add(g)
        groups[g].update(words)
        lang_docs[g[0]].update(set(words))
    out = set()
    for lang in {g[0] for g in docs}:
        kept = sorted((t for t, n in lang_docs[lang].items() if n >= least), key=str.encode)
        sources = sorted(s for v, s in docs if v == lang)
        n = {s: [groups[lang, s][t] for t in kept] for s in sources}
        share = lambda c: [1 + (10**9 * (x + 5)) // (sum(c) + 5 * len(kept)) for x in c]
        p, q = {s: share(c) for s, c in n.items()}, share([sum(c) for c in zip(*n.values())])
        for s in sources:
            pairs = sorted(((-sum(abs(a - b) for a, b in zip(p[s], p[o])), o.encode(), o) for o in sources if o != s))
            out |= {(lang, s, "pair", o, -f, i) for i, (f, _, o) in enumerate(pairs, 1)}
            terms = sorted((b - a, t.encode(), t) for t, a, b, c in zip(kept, p[s], q, n[s]) if c and a > b)[:top]
            out |= {(lang, s, "term", t, -f, i) for i, (f, _, t) in enumerate(terms, 1)}
    return out


def rows_of(n=260):
    rows = [(i, prose(i, 5 + i % 40) + " ÉCOLE école x1y_z " * (i % 3 == 0), ["en", "de", None][i % 3], f"s{i * i % 13}" if i % 7 else None, 0) for i in range(n)]
    return rows + [(900, None, "en", "s1", 0), (901, "", "xx", "alone", 0), (902, "rare words", "xx", "other", 0), (903, "rare", "yy", "single", 0), (904, "1234 !!", "en", "wordless", 0), rows[5], rows[5]]


@pytest.mark.parametrize("least,segment,width", [(30, 1024, None), (3, 16, 2), (30, 5, 3), (1, 4096, 1)])
def test_divergence(spark, least, segment, width):
    rows = rows_of()
    got = dv.divergence(documents(spark, rows), least=least, segment=segment, width=width)
    assert dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, least)


def test_divergence_of_nothing(spark):
    assert dv.divergence(documents(spark, [])).collect() == []
    got = dv.divergence(documents(spark, [(1, "a b", "en", "x", 0), (2, None, "en", "y", 0), (3, "c", "de", "z", 0)])).collect()
    assert {tuple(r) for r in got} == {("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)}


def test_divergence_counts_very_long_texts(spark, monkeypatch):
    long = "Alpha betaé " * 150_000 + "gamma"
    rows = [(1, long, "en", "x", 0), (2, "alpha delta", "en", "y", 0)]
    monkeypatch.setattr(dv, "HELD", 2)  # counters are passed on again and again
    assert {tuple(r) for r in dv.divergence(documents(spark, rows), least=1).collect()} == brute(rows, 1)


@pytest.mark.parametrize("blocks", [2, 4, 6, 10, 24])
def test_tournament_meets_every_pair_once(blocks):
    rounds = defaultdict(list)
    for a in range(blocks):
        for b in range(a):
            rounds[dv.round_of(a, b, blocks)].append((a, b))
            assert dv.round_of(a, b, blocks) == dv.round_of(b, a, blocks) and dv.host(a, b) == dv.host(b, a) in (a, b)
    assert len(rounds) == blocks - 1
    assert all(sorted(x for m in meetings for x in m) == list(range(blocks)) for meetings in rounds.values())
    home = Counter(dv.host(a, b) for a in range(blocks) for b in range(a))
    assert max(home.values()) - min(home.get(b, 0) for b in range(blocks)) <= 1


def test_share_is_exact():
    r = np.random.default_rng(4)
    for total in (0, 3, 10**6, 7 * 10**14, 9 * 10**18):
        n = [0, total, *(int(v) for v in r.integers(0, total + 1, 50))]
        assert dv.share(np.array(n, np.int64), total, 17, 5).tolist() == [1 + 10**9 * (c + 5) // (total + 85) for c in n]


def test_squeezed_vectors_come_back():
    at, n = np.array([0, 3, 4, 4095]), np.array([1, 1 << 40, 7, 2])
    back = dv.spread(dv.squeeze(at, n), 4096)
    assert back[at].tolist() == n.tolist() and np.count_nonzero(back) == 4
    assert dv.spread(None, 3).tolist() == [0, 0, 0]

"""Secret scans: base patterns, and a guess-cost dynamic programme over credential-context values.

Base kinds are found leftmost and without overlap, each kind by itself; a match that fails its
length is dropped and still uses up its characters.  A span is the whole match.

    assign   a credential word, ``:`` or ``=``, a value of 12 or more characters
    access   AKIA and more, 18 or more characters in all
    hex      16 or more hexadecimal characters

The method adds ``guess`` spans: the value of a name that has a credential word among its parts
(``DB_PWD=``, ``clientSecret:``, ``pass =>``, ``Authorization: Bearer``, ``<password>``), or the password of a URL's user, is cut into segments so that the guesses an attacker needs are fewest (words, dates, repeats, keyboard
walks, sequences, or brute force; a repeat or a walk goes as far as it can from where it starts), and is reported if even the cheapest cut needs
``10 ** LEAST_GUESSES`` guesses, which 8 random characters do.  The whole value is added, also if a
base span holds part of it; values inside one base span are that span's, names inside a value are that value's (so a text is read a
bounded number of times, whatever it holds).

Words are ranked by what they cost to guess: first ``WORDS``, then the commonest words of the texts
themselves (:func:`dictionary`: counted over all texts, standing alone in prose, so what follows a colon or
an equals sign, or has digits, is none).

Null and empty texts have no spans; spans count code points, ends exclusive; repeated rows get
equal results (texts are whole, however long); an empty table gives no rows.  Only doc_id and text are read (``redact`` keeps all
columns).
"""
from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from math import log10

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, functions as F

from tidewheel.llm import shared

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
NAME = r"""(?<![A-Za-z0-9_-])([A-Za-z0-9_-]++)["']?\s{0,3}(?:=>|[:=])"""
ELEMENT = r"<([A-Za-z0-9_-]++)>\s{0,3}([^\s<>]{8,})\s{0,3}</"
USER_INFO = r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{0,30}://[^\s:/?#@]{1,64}:([^\s/?#@]{8,})@"
CREDENTIAL = r"(?:password|passwd|passphrase|passcode|pwd|secret|token|bearer|authorization|credential|(?:api|access|private|client|secret)_?key)s?(?![a-z])|(?<![a-z])(?:pass|auth)(?![a-z])"
WORD_BEFORE_KEY = r"(?i:\b|_)(?i:api|access|private|client|secret)\x20\Z"
VALUE = r"""\s{0,3}(?i:(?:bearer|basic|token|digest|apikey)\s{1,3})?["']?([^\s"'<>,;]{8,})"""
PARTS = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|-")
LEAST_GUESSES = 8.0
PROSE = r"(?<!\S)(?<![:=]\s{1,3})(\p{L}{3,24})(?=[.,;!?)]{0,3}(?:\s|\z))"
# Rows of a keyboard, and words that passwords are made of, commonest first.
KEYBOARD = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "qazwsxedcrfvtgbyhnujmikolp", "abcdefghijklmnopqrstuvwxyz")
WORDS = (
    "password pass admin root user test guest login welcome letmein master secret default changeme monkey dragon "
    "shadow sunshine princess football baseball qwerty iloveyou trustno1 superman batman hello freedom whatever "
    "example sample demo token key api dev prod staging local public private temp database server client my your "
    "the none null true false placeholder redacted dummy value string here insert replace enter code pin"
).split()
_LEET = str.maketrans("013457@$!", "oleastasi")
_DATE = re.compile(r"(?:19|20)\d{2}(?:[-/._]?\d{1,2}[-/._]?\d{1,2})?|\d{1,2}[-/.]\d{1,2}[-/.](?:\d{4}|\d{2})")


class _Periods:
    """Repeats of a text by where they start; each run of a period is measured once."""

    def __init__(self, value: str):
        self.value, self.ends = value, [-1] * 9  # by unit: the first place from which the unit does not go on

    def _end(self, i: int, unit: int) -> int:
        """The first place from ``i`` on whose character differs from the one a unit further."""
        if self.ends[unit] < i:
            v, k, size, last = self.value, i, 16, len(self.value) - unit
            while k < last:
                size = min(size, last - k)
                if v[k : k + size] == v[k + unit : k + unit + size]:
                    k, size = k + size, size * 2
                elif size == 1:
                    break
                else:
                    size = max(1, size // 2)
            self.ends[unit] = min(k, max(last, i))
        return self.ends[unit]

    def at(self, i: int) -> tuple[int, int]:
        """(length, times) of the shortest unit of up to 8 characters that stands at ``i`` twice or more, else (0, 0)."""
        v = self.value
        for unit in range(1, 9):
            if v[i : i + unit] == v[i + unit : i + 2 * unit] and i + 2 * unit <= len(v):
                return unit, 1 + (self._end(i, unit) - i) // unit
        return 0, 0


class Ranks:
    """Words by rank: ``WORDS``, then ``words``, commonest first."""

    def __init__(self, words=()):
        self.rank = {w: i + 1 for i, w in enumerate(dict.fromkeys([*WORDS, *words]))}
        self.longest = max(map(len, self.rank))


PLAIN = Ranks()


def dictionary(docs: DataFrame, most_words: int = 20_000, least: int = 20, share: float = 4e-5) -> list[str]:
    """The ``most_words`` commonest words of all texts that are ``share`` of all their words, and stand there ``least`` times or more, commonest first.

    The share makes a larger table of like texts give the same words; ``least`` only keeps chance out of small ones (below half a million words).
    The driver and each worker hold these words, at most 24 characters each.
    """
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col("text").cast("string")), F.lit(PROSE), F.lit(1))).alias("word"))
    seen = Observation()
    counts = words.groupBy("word").agg(F.count("*").alias("n")).observe(seen, F.sum("n").alias("all"))
    found = counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most_words).collect()
    every = (seen.get["all"] or 0) * share
    return [r.word for r in found if r.n >= every]


def guess_cost(value: str, ranks: Ranks = PLAIN, enough: float = float("inf")) -> float:
    """log10 of the guesses for the cheapest segmentation of ``value``, in one pass from left to right.

    With ``enough`` the pass ends as soon as no cut can stay below it, and some cost of at least that is returned: costs only
    grow, so once no place ahead is reached for less, nothing is.
    """
    n, low = len(value), value.lower() if value.isascii() else "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(_LEET)
    rank_of, longest, repeats, ahead = ranks.rank.get, ranks.longest, _Periods(value), 0
    best = [0.0] + [float("inf")] * n
    brute = float("inf")  # the least best[i] - i so far: ten guesses a character, as attackers find by structure
    for i in range(n):
        if i:
            best[i] = min(best[i], brute + i + 0.3)
        brute = min(brute, best[i] - i)
        if i >= ahead and best[i] >= enough and brute + i + 1.3 >= enough:
            return best[i]
        edges = []  # (end, cost)
        for j in range(i + 2, min(n, i + longest) + 1):
            rank = rank_of(low[i:j]) or (rank_of(plain[i:j], 0) * 4)
            if rank:
                cased = 1 if value[i:j] == low[i:j] else 2
                edges.append((j, log10(rank * cased + 1)))
        if m := _DATE.match(low, i):
            edges.append((m.end(), log10(365 * 120 * 4) if m.end() - i > 4 else log10(120)))
        unit, times = repeats.at(i)
        if unit * times >= 3:
            edges.append((i + unit * times, unit * 1.0 + log10(times)))
        for row in KEYBOARD:
            at = row.find(low[i])
            for step in (1, -1) if at >= 0 else ():
                j, k = i + 1, at + step
                while j < n and 0 <= k < len(row) and row[k] == low[j]:
                    j, k = j + 1, k + step
                if j - i >= 3:
                    edges.append((j, log10(len(row) * len(KEYBOARD) * 2 * (j - i))))
        for j, cost in edges:
            best[j] = min(best[j], best[i] + cost + 0.3)
            if j > ahead and best[j] < enough:
                ahead = j
    return min(best[n], brute + n + 0.3) if n else 0.0


def _patterns():
    return re.compile(ASSIGN), re.compile(ACCESS), re.compile(r"[0-9a-f]{16,}"), re.compile(NAME), re.compile(CREDENTIAL), re.compile(WORD_BEFORE_KEY), re.compile(VALUE), re.compile(ELEMENT), re.compile(USER_INFO)


def _values(text: str, patterns) -> list[tuple[int, int]]:
    """(start, end) of values in a credential's place, in order; each character is looked at a bounded number of times."""
    names, credential, before_key, values, elements, users = patterns[3:]
    named = lambda name, at: credential.search(p := PARTS.sub("_", name).lower()) or (p == "key" and before_key.search(text[max(0, at - 10) : at]))
    out, until = [m.span(1) for m in users.finditer(text)], 0
    out += [m.span(2) for m in elements.finditer(text) if named(m[1], m.start())]
    for name in names.finditer(text):
        # a name inside the last value is that value's
        if name.start() >= until and named(name[1], name.start()) and (m := values.match(text, name.end())):
            out.append(m.span(1))
            until = m.end()
    return sorted(out)


def find(text: str, ranks: Ranks = PLAIN, patterns=None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) as (start, kind number, end), in order."""
    patterns = patterns or _patterns()
    assign, access, hexes = patterns[:3]
    base = [(m.start(), 0, m.end()) for m in assign.finditer(text) if m.end(2) - m.start(2) >= 12]
    base += [(m.start(), 1, m.end()) for m in access.finditer(text) if m.end() - m.start() >= 18]
    # a maximal run matches from its first character, so the bound in the pattern drops the same runs
    base += [(m.start(), 2, m.end()) for m in hexes.finditer(text)]
    base.sort()
    starts, ends, furthest = [a for a, _, _ in base], [], 0  # of the base spans up to each, the furthest end
    for _, _, e in base:
        furthest = max(furthest, e)
        ends.append(furthest)
    added, until = [], 0
    for s, e in _values(text, patterns):
        if s < until:
            continue  # it stands in a value that was judged as a whole
        until = e
        value = text[s:e].rstrip(".)]}")
        e = s + len(value)
        k = bisect_right(starts, s)
        if len(value) >= 8 and not (k and ends[k - 1] >= e) and guess_cost(value, ranks, LEAST_GUESSES) >= LEAST_GUESSES:
            added.append((s, 3, e))
    return base, sorted(base + added)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, words: list[str] | None = None) -> DataFrame:
    """Counts, digest and spans per row; ``words`` are by default the dictionary of ``docs``."""
    shared.prepare(docs.sparkSession)
    words = dictionary(docs) if words is None else words

    def run(batches):
        patterns, ranks = _patterns(), Ranks(words)
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                base, spans = find(t or "", ranks, patterns)
                kinds = [k for _, k, _ in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            cols = list(zip(*rows)) or [()] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[SECRET]", words: list[str] | None = None) -> DataFrame:
    """``docs`` with every span replaced by ``mark`` (touching spans by one) and n_chars counted anew."""
    shared.prepare(docs.sparkSession)
    words = dictionary(docs) if words is None else words
    at = docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def clean(text, ranks, patterns):
        if text is None:
            return None
        out, end = [], 0
        for s, _, e in find(text, ranks, patterns)[1]:
            if s >= end:
                out += [text[end:s], mark]
            end = max(end, e)
        return "".join([*out, text[end:]]) if out else text

    def run(batches):
        patterns, ranks = _patterns(), Ranks(words)
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [clean(t, ranks, patterns) for t in old]
            cols = list(batch.columns)
            cols[at] = pa.array(new, batch.schema.field(at).type)
            if count is not None:
                n = [c if a is b or b is None else len(b) for a, b, c in zip(old, new, batch.column(count).to_pylist())]
                cols[count] = pa.array(n, batch.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)

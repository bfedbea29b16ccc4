"""HTML extraction: wrappers by union-free regular-expression inference.

Pages of a host are read as token streams (tags with their class, text slots with the path of
containers they stand in).  A block of text that stands in the same path on ``SHARE`` of the host's different
pages, and on ``LEAST_PAGES`` at least, is fixed: it becomes a token of its own, as tags are.
Tandem repeats of a stream become repeated groups, ``(...)+``; the wrapper starts as its first page's
stream and each further stream is aligned with it: what only one side has becomes optional,
``(...)?``.  Every text of a page is then read at one position of the wrapper: an item, and the
place inside its group.  Pages that mark an article or main part and pages that do not have wrappers,
and fixed texts, of their own.

By position, a text is the template's if the position holds a fixed text on ``LEAST_PAGES`` pages, or,
without a main mark, if the blocks there are mostly links.  By container, it is boilerplate if
one is a menu, page header, footer, sidebar, notice, advert, form, script, style or reader comments, by
tag, role, class or id, or if its page marks a main part and it stands outside.  Class words do
not count for article and main elements, nor against an article inside the element that has them.
Content becomes text block by block: character references decoded, white space one space, trimmed,
joined in page order by one line feed.

Hosts of more than ``GROUP`` pages or ``SIZE`` characters are dealt to several wrappers by a hash of page id
and url, so no host must fit one task; fixed texts are counted over the whole host before.  Null html
or url counts as empty; a page without content has an empty text; repeated rows each get theirs; an
empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

import html
import re
from hashlib import blake2b
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewheel.llm import shared

GROUP, SIZE = 256, 1 << 25
SHARE, LEAST_PAGES = 0.8, 4
PERIOD = 6  # longest repeated block, in tokens or groups
FEW_HOSTS = 50_000
# Element names by role, and words of classes, ids and roles that mark boilerplate.
DROP = frozenset("nav footer aside form script style noscript template iframe svg select button textarea input object dialog menu head".split())
RAW = "script|style|noscript|template|iframe|svg|textarea|select"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
MAIN = frozenset(["article", "main"])
HINT = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation sidebar aside "
    "footer cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup social share sharing "
    "related recommended breadcrumb breadcrumbs pagination pager comment comments commentlist disqus replies reply respond widget toolbar login search "
    "copyright legal disclaimer skip complementary contentinfo dialog".split())
HEAD_HINT = frozenset("header masthead topbar".split())
CONTENT_HINT = frozenset("article main story".split())
REPLIES = frozenset("comment comments commentlist disqus replies reply respond related recommended".split())
WHOLE = frozenset("article main story content post entry hentry".split())  # with one of these, parts of other class names do not count
WITHOUT = frozenset("has no with without".split())  # what follows is about other elements
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?!svg\b[^>]*/>)(?P<raw>" + RAW + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S | re.I)
ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORD = re.compile(r"[a-z]+")


def _attributes(attrs: str) -> tuple[str, frozenset, bool]:
    """(what tells this element from others of its name, hint words, hidden or not)."""
    if not attrs or "=" not in attrs and "hidden" not in attrs.lower():
        return "", frozenset(), False
    mark, words, whole, hidden = "", set(), set(), False
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden |= value == "true"
        elif name == "style":
            hidden |= "display:none" in value.replace(" ", "")
        else:
            if name == "class":
                mark = "." + value
            for name in value.split():
                parts = WORD.findall(name)
                whole.add(name)
                if len(parts) < 2 or parts[0] not in WITHOUT:
                    words.update(parts)
    if whole & WHOLE:
        words = {w for w in words if w in whole or w not in HINT and w not in HEAD_HINT}
    return mark, frozenset(words), hidden


def _digest(s: str) -> bytes:
    return blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest()


def _number(s: str) -> int:
    return int.from_bytes(_digest(s), "big", signed=True)


class Page:
    """A page's tokens, and its texts with slot symbol, link flag and block number."""

    def __init__(self, source: str):
        self.symbols: list[str] = []
        self.texts: list[tuple[int, str, bool, int]] = []  # (token number, raw text, in a link, block)
        self.identity = _number(source)
        # (name, path so far, state: '' plain, 'm' main, boilerplate 'x' by tag, 's' by class word, 'c' as comments)
        stack: list[tuple[str, str, str]] = []
        links, block, last = 0, 0, 0
        for m in TOKEN.finditer(source):
            if m.start() > last:
                self._text(source[last : m.start()], stack, links, block)
            last = m.end()
            name = m["name"]
            if name is None:  # a comment or an element without texts: inside a block it parts nothing
                continue
            name = name.lower()
            if name not in INLINE and name != "svg":  # one that closes itself: an icon
                block += 1
            if m["end"]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        links -= sum(s[0] == "a" for s in stack[k:])
                        del stack[k:]
                        self.symbols.append("/" + name)
                        break
                    if stack[k][0] in ("td", "th", "table") and name not in ("table", "tr", "tbody"):
                        break
                continue
            mark, words, hidden = _attributes(m["attrs"])
            if name in CLOSES_P:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        links -= sum(s[0] == "a" for s in stack[k:])
                        del stack[k:]
                        break
                    if stack[k][0] not in INLINE:
                        break
            elif name in ("li", "td", "th", "tr", "dt", "dd", "option"):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
                    if stack[k][0] in ("ul", "ol", "table", "dl") or stack[k][0] not in INLINE and stack[k][0] not in ("p", "td", "th", "dt", "dd"):
                        break
            self.symbols.append(name + mark)
            if name == "br" and self.texts:  # a line break is white space inside its block
                self.texts.append((-1, " ", links > 0, block))
            if name in VOID or m["attrs"].endswith("/") and name not in ("p", "div", "a"):
                continue
            _, path, state = stack[-1] if stack else ("", "", "")
            if state != "x":
                if name in DROP or hidden:
                    state = "x"
                elif name in MAIN:
                    if state in ("", "m") or state == "s" and all(e[0] != "article" for e in stack):
                        state = "m"
                elif state in ("", "m") and name not in ("body", "html") and words & HINT:
                    state = "c" if words & REPLIES else "s"
                elif state == "" and name not in ("body", "html") and (name == "header" or words & HEAD_HINT):
                    state = "x" if name == "header" else "s"
                elif state == "" and (words & CONTENT_HINT and name in ("div", "section", "td") or "main" in words):
                    state = "m"
            if name not in INLINE:
                path = _digest(f"{path}>{name}{mark}").hex()
            stack.append((name, path, state))
            links += name == "a"
        if last < len(source):
            self._text(source[last:], stack, links, block)
        self.marked = any(s.startswith("#m") for s in self.symbols)

    def keys(self) -> dict[int, int]:
        """Token number to a number for path and text of the whole block, of texts that may be content."""
        start = "#m" if self.marked else "#"
        blocks: dict[int, list] = defaultdict(list)
        for _, raw, _, block in self.texts:
            blocks[block].append(raw)
        whole = {k: SPACE.sub(" ", "".join(b)).strip() for k, b in blocks.items()}
        return {at: _number(f"{self.symbols[at]} {whole[block]}") for at, _, _, block in self.texts
                if at >= 0 and self.symbols[at].startswith(start) and not self.symbols[at].startswith("#x")}

    def fix(self, fixed: set[int]) -> None:
        for at, key in self.keys().items() if fixed else ():
            if key in fixed:
                self.symbols[at] = f"={key}"

    def _text(self, raw: str, stack, links: int, block: int) -> None:
        if raw.isspace():
            if self.texts:  # white space between inline elements still parts words
                self.texts.append((-1, " ", links > 0, block))
            return
        _, path, state = stack[-1] if stack else ("", "", "")
        self.texts.append((len(self.symbols), raw, links > 0, block))
        self.symbols.append(f"#{state and ('m' if state == 'm' else 'x')}{'' if state else '.'}{path}")


def collapse(symbols: list[str]) -> tuple[tuple, list[list]]:
    """The stream with tandem repeats as groups, and the texts of each item.

    Items are symbols or ``("+", item, ...)``; a text is (place inside the item, token number).
    """
    seq: list = list(symbols)
    own: list[list] = [[((), k)] if s[0] in "#=" else [] for k, s in enumerate(symbols)]
    for _ in range(4):
        before = len(seq)
        for period in range(1, PERIOD + 1):
            out, held, i, n = [], [], 0, len(seq)
            while i < n:
                j = i + period
                while j + period <= n and seq[i] == seq[j] and seq[i : i + period] == seq[j : j + period]:
                    j += period
                if j > i + period or (out and j <= n and out[-1] == ("+", *seq[i:j])):
                    group = ("+", *seq[i : i + period])
                    if not out or out[-1] != group:
                        out.append(group)
                        held.append([])
                    held[-1] += [(((r - i) % period, *place), k) for r in range(i, j) for place, k in own[r]]
                    i = j
                else:
                    out.append(seq[i])
                    held.append(own[i])
                    i += 1
            seq, own = out, held
        if len(seq) == before:
            break
    return tuple(seq), own


class Wrapper:
    """A union-free expression: items in order, each needed or optional."""

    def __init__(self, first: tuple):
        self.items = list(first)
        self.optional = [False] * len(first)
        self.ids = list(range(len(first)))  # an item keeps its number when others are put before it
        self.known = {first: tuple(self.ids)}
        self.size = len(first)
        self.reads: list[dict] = []  # by page: token number of a text to (item number, place in the item)

    def align(self, stream: tuple) -> tuple:
        """Generalise so that ``stream`` matches: longest common subsequence, the rest optional; its items' numbers."""
        if stream in self.known:
            return self.known[stream]
        a, b = self.items, stream
        lo = 0
        while lo < min(len(a), len(b)) and a[lo] == b[lo]:
            lo += 1
        hi = 0
        while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
            hi += 1
        x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            row, below = best[i], best[i + 1]
            for j in range(len(y) - 1, -1, -1):
                row[j] = below[j + 1] + 1 if x[i] == y[j] else max(below[j], row[j + 1])
        items, optional, ids, i, j = a[:lo], self.optional[:lo], self.ids[:lo], 0, 0
        mine = self.ids[:lo]
        while i < len(x) or j < len(y):
            if i < len(x) and j < len(y) and x[i] == y[j]:
                items.append(x[i])
                optional.append(self.optional[lo + i])
                ids.append(self.ids[lo + i])
                mine.append(self.ids[lo + i])
                i, j = i + 1, j + 1
            elif j >= len(y) or i < len(x) and best[i + 1][j] >= best[i][j + 1]:
                items.append(x[i])
                optional.append(True)
                ids.append(self.ids[lo + i])
                i += 1
            else:
                items.append(y[j])
                optional.append(True)
                ids.append(self.size)
                mine.append(self.size)
                self.size += 1
                j += 1
        tail = len(a) - hi
        self.known[stream] = (*mine, *self.ids[tail:])
        self.items, self.optional, self.ids = items + a[tail:], optional + self.optional[tail:], ids + self.ids[tail:]
        return self.known[stream]

    def expression(self) -> str:
        def show(x):
            return f"({' '.join(map(show, x[1:]))})+" if isinstance(x, tuple) else x

        return " ".join(f"({show(x)})?" if o else show(x) for x, o in zip(self.items, self.optional))


def infer(pages: list[Page]) -> Wrapper | None:
    wrapper = None
    for p in pages:
        stream, own = collapse(p.symbols)
        if wrapper is None:
            wrapper = Wrapper(stream)
        ids = wrapper.align(stream)
        wrapper.reads.append({k: (item, place) for item, texts in zip(ids, own) for place, k in texts})
    return wrapper


def fixed_texts(pages: list[Page]) -> dict[bool, set[int]]:
    """By whether pages mark a main part: keys of texts on ``SHARE`` of the different pages."""
    seen, found = set(), {False: Counter(), True: Counter()}
    n: Counter = Counter()
    for p in pages:
        if p.identity not in seen:
            seen.add(p.identity)
            n[p.marked] += 1
            found[p.marked].update(set(p.keys().values()))
    return {m: {k for k, c in f.items() if c >= max(LEAST_PAGES, SHARE * n[m])} for m, f in found.items()}


def content(pages: list[Page], fixed: set[int]) -> list[set[int]]:
    """The token numbers of each page's content; the pages all mark a main part, or none does."""
    for p in pages:
        p.fix(fixed)
    wrapper = infer(pages)
    on: dict[tuple, set] = defaultdict(set)  # by position: the different pages that have it
    size: Counter = Counter()  # by position, and by path: characters of its blocks, and those in links
    linked: Counter = Counter()
    for p, read in zip(pages, wrapper.reads if wrapper else ()):
        block_size, block_linked = Counter(), Counter()
        for at, raw, link, block in p.texts:
            block_size[block] += len(raw.strip())
            block_linked[block] += len(raw.strip()) * link
        for at, _, _, block in p.texts:
            if at >= 0:
                on[read[at]].add(p.identity)
                for k in (read[at], p.symbols[at]):
                    size[k] += block_size[block]
                    linked[k] += block_linked[block]

    def keep(p, read, at) -> bool:
        symbol, position = p.symbols[at], read[at]
        if symbol[0] == "=":
            return len(on[position]) < LEAST_PAGES
        if symbol.startswith("#x") or p.marked:
            return symbol.startswith("#m")
        return not (linked[position] > 0.5 * size[position] and (len(on[position]) >= LEAST_PAGES or linked[symbol] > 0.5 * size[symbol]))

    return [{at for at, *_ in p.texts if at >= 0 and keep(p, read, at)} for p, read in zip(pages, wrapper.reads if wrapper else ())]


SPACE = re.compile(r"\s+")


def text_of(page: Page, kept: set[int]) -> str:
    """The page's content blocks in order."""
    blocks, now, at_block = [], [], -1
    for at, raw, _, block in page.texts:
        if block != at_block:
            blocks.append(now)
            now, at_block = [], block
        if at < 0 or at in kept:
            now.append(raw)
    blocks.append(now)
    out = (SPACE.sub(" ", html.unescape("".join(b))).strip() for b in blocks)
    return "\n".join(b for b in out if b)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    spark = pages.sparkSession
    shared.prepare(spark)
    url = F.col("url").cast("string")
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host.alias("host"))
    hot = rows.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.length("html")).alias("size")).filter((F.col("n") > GROUP) | (F.col("size") > SIZE))
    hot = shared.materialise(hot.select("host", F.greatest(F.ceil(F.col("n") / GROUP), F.ceil(F.col("size") / SIZE)).cast("int").alias("parts")), "hosts")
    few = hot.count() <= FEW_HOSTS
    hot = F.broadcast(hot) if few else hot

    def texts(batches):
        for batch in batches:
            host, marked, key, page = [], [], [], []
            for h, source in zip(*(c.to_pylist() for c in batch.columns)):
                p = Page(source)
                keys = [None, *set(p.keys().values())]
                host += [h] * len(keys)
                marked += [p.marked] * len(keys)
                key += keys
                page += [p.identity] * len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(marked, pa.bool_()), pa.array(key, pa.int64()), pa.array(page, pa.int64())], names=["host", "marked", "key", "page"])

    found = rows.join(hot, "host").select("host", "html").mapInArrow(texts, "host string, marked boolean, key long, page long")
    found = shared.materialise(found.groupBy("host", "marked", "key").agg(F.countDistinct("page").alias("n")).filter(F.col("key").isNull() | (F.col("n") >= LEAST_PAGES)), "texts")
    whole = found.filter("key IS NULL").select("host", "marked", F.col("n").alias("pages"))
    fixed = found.filter("key IS NOT NULL").join(whole, ["host", "marked"]).filter(F.col("n") >= SHARE * F.col("pages"))
    fixed = fixed.groupBy("host").agg(F.collect_list(F.when(F.col("marked"), F.col("key"))).alias("in_marked"), F.collect_list(F.when(~F.col("marked"), F.col("key"))).alias("in_others"))
    # the fixed texts of a large host come before the pages of each of its parts
    heads = hot.join(fixed, "host", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.join(hot, "host", "left")
    rows = rows.withColumn("part", F.coalesce(F.pmod(F.xxhash64("page_id", "url"), F.col("parts")), F.lit(0)).cast("int"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("host", "part", F.lit(True).alias("is_page"), "page_id", "url", "html").unionByName(heads.select("host", "part", F.lit(False).alias("is_page"), "in_marked", "in_others"), allowMissingColumns=True)
    rows = rows.repartition(n, "host", "part").sortWithinPartitions("host", "part", "is_page", "page_id")

    def run(batches):
        def close(held, fixed):
            read = [Page(h) for _, _, h in held]
            fixed = fixed or fixed_texts(read)
            texts = [""] * len(held)
            for marked in (False, True):
                at = [k for k, p in enumerate(read) if p.marked == marked]
                for k, kept in zip(at, content([read[k] for k in at], fixed[marked])):
                    texts[k] = text_of(read[k], kept)
            cols = [pa.array([p for p, _, _ in held], pa.int64()), pa.array([u for _, u, _ in held], pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            return pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])

        key, fixed, held, size = None, None, [], 0
        for batch in batches:
            for h, part, is_page, p, u, source, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if held and ((h, part) != key or len(held) >= 2 * GROUP or size > SIZE):
                    yield close(held, fixed)
                    held, size = [], 0
                if (h, part) != key:
                    key, fixed = (h, part), None
                if is_page:
                    held.append((p, u, source))
                    size += len(source)
                else:
                    fixed = {True: set(a or ()), False: set(b or ())}
        if held:
            yield close(held, fixed)

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")

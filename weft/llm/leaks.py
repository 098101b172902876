"""Held-out passages that stand in a corpus.

Both sides are read as a reader sees them: markup and entities resolved, lookalike
and compatibility characters folded, invisible characters dropped, words cut by a
hyphen at a line's end joined, case and punctuation ignored. All six-word windows of
all items form one Aho-Corasick automaton; each text is scanned once. Windows that
continue each other are stretches; an item leaks where stretches, in the item's
order, hold a third of its words. Positions are mapped back to the original text.
"""

from __future__ import annotations

import html
import re
import unicodedata
import uuid
from bisect import bisect_left, bisect_right
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a window, and the share of an item's words that stretches must hold.
WINDOW, SHARE = 6, 1 / 3
#: Characters of items in one automaton (about 100 bytes of memory each); more items are split into blocks.
BLOCK_CHARS = 4_000_000
#: Automata that a worker process holds at a time, and blocks of items that go out in one broadcast.
HELD, BLOCKS = 2, 16
#: Characters of texts that wait for one another where the blocks of items are more than a worker holds.
WAITING_CHARS = 64_000_000

# Letters of other scripts that a reader takes for Latin ones; a choice of this module.
_LOOKS_LIKE = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "г": "r", "п": "n",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "γ": "y", "μ": "u", "ζ": "z",
    "ı": "i", "ȷ": "j", "ø": "o", "đ": "d", "ł": "l", "ħ": "h", "ſ": "s", "æ": "ae", "œ": "oe", "ß": "ss",
}

_INLINE = frozenset("a abbr b big bdi bdo cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup tt u var wbr".split())
_TAG = re.compile(r"<!--|</?([A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*)?/?>|&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});", re.S)
#: Elements whose content no reader sees.
_HIDDEN = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style")}
_INVISIBLE = "\\u00ad\\u034f\\u061c\\u180e\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u2064\\u206a-\\u206f\\ufe00-\\ufe0f\\ufeff"
#: A word: letters and digits with marks; invisible characters, apostrophes and hyphens within don't end it, nor does a hyphen at a line's end.
_WORD = re.compile(
    rf"[^\W_](?:[^\W_]|[̀-ͯ{_INVISIBLE}]|(?:['’‐‑\-]|­)[{_INVISIBLE}]*(?=[^\W_])|[\-‐­][ \t]*\r?\n[ \t>|#*]*(?=[^\W_]))*"
)
_NOT_KEPT = re.compile(rf"[\s{_INVISIBLE}'’‐‑\-­>|#*_]|[̀-ͯ]")
_PLAIN = re.compile(r"[a-z0-9]+\Z")


def fold(word: str) -> str:
    """A word's form for comparison."""
    low = word.lower()
    if _PLAIN.match(low):
        return low
    low = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", word).casefold())
    low = _NOT_KEPT.sub("", low)
    return "".join(_LOOKS_LIKE.get(c, c) for c in low if unicodedata.category(c) not in ("Mn", "Cf", "Cc"))


def _end_of(text: str, m: re.Match, endless: set[str]) -> int:
    """Where what begins with a comment's mark or a hidden element's tag ends; -1 if it never does. Each kind of end is looked for in vain only once."""
    kind = "<!--" if m[0] == "<!--" else m[1].lower()
    if kind in endless:
        return -1
    if kind == "<!--":
        at = text.find("-->", m.end())
        end = at + 3 if at >= 0 else -1
    else:
        close = _HIDDEN[kind].search(text, m.end())
        end = close.end() if close else -1
    if end < 0:
        endless.add(kind)
    return end


def without_markup(text: str) -> tuple[str, list[int], list[int]]:
    """Text with tags, comments of any length, scripts, styles and entities resolved; starts of its pieces, and their places in the original.

    A comment, script or style without an end hides nothing: its mark alone is text or a tag.
    """
    if "<" not in text and "&" not in text:
        return text, [0], [0]
    out, places, origin, at, length = [], [0], [0], 0, 0
    endless: set[str] = set()
    m = _TAG.search(text)
    while m:
        end, put = m.end(), " "
        if m[0][0] == "&":
            put = html.unescape(m[0])
        elif m[0] == "<!--":
            end = _end_of(text, m, endless)
            if end < 0:
                m = _TAG.search(text, m.end())
                continue
        elif m[1].lower() in _HIDDEN and m[0][1] != "/" and m[0][-2] != "/":
            end = max(end, _end_of(text, m, endless))
        elif m[1].lower() in _INLINE:
            put = ""
        out.append(text[at : m.start()])
        length += m.start() - at
        out.append(put)
        places.append(length), origin.append(m.start())
        length += len(put)
        at = end
        places.append(length), origin.append(at)
        m = _TAG.search(text, at)
    out.append(text[at:])
    return "".join(out), places, origin


class Reader:
    """Words of a text with their places in it; folded forms are kept in a bounded cache."""

    def __init__(self, bound: int = 200_000):
        self.forms: dict[str, str] = {}
        self.bound = bound

    def words(self, text: str) -> tuple[list[str], list[tuple[int, int]], tuple]:
        plain, places, origin = without_markup(text)
        forms, words, spans = self.forms, [], []
        for m in _WORD.finditer(plain):
            raw = m[0]
            form = forms.get(raw)
            if form is None:
                if len(forms) >= self.bound:
                    forms.clear()
                form = fold(raw)
                if len(raw) <= 64:
                    forms[raw] = form
            if form:
                words.append(form)
                spans.append(m.span())
        return words, spans, (places, origin)


def original(place: int, pieces: tuple) -> int:
    """Place in the original text of a place in the text without markup."""
    places, origin = pieces
    k = bisect_right(places, place) - 1
    return origin[k] + place - places[k] if k + 1 >= len(places) else min(origin[k] + place - places[k], origin[k + 1])


def best_chain(stretches: list[tuple[int, int, int]]) -> tuple[int, list[tuple[int, int, int]]]:
    """Most item words in stretches (document start, item start, words) that go forward in both.

    Where two stretches overlap, the overlap counts once. For each place in the item only the
    best chain that ends there is kept, so that work grows with the stretches, however often a
    document repeats an item.
    """
    ends: dict[int, tuple[int, int, tuple]] = {}  # item end: words, document end, chain
    top: tuple[int, tuple] = (0, ())
    for d, i, n in sorted(stretches):
        words, before = n, ()
        for end, (held, stop, chain) in ends.items():
            gain = n - max(0, stop - d, end - i)
            if end < i + n and 0 < gain and held + gain > words:
                words, before = held + gain, chain
        known = ends.get(i + n)
        if known is None or words > known[0]:
            ends[i + n] = (words, d + n, ((d, i, n), before))
            if words > top[0]:
                top = (words, ends[i + n][2])
    chain, link = [], top[1]
    while link:
        chain.append(link[0])
        link = link[1]
    return top[0], chain[::-1]


class Automaton:
    """All windows of a block of items."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW, share: float = SHARE):
        import ahocorasick

        self.window, self.share = window, share
        self.reader, self.lengths = Reader(), {}
        where: dict[str, list[tuple[int, int]]] = {}
        for item, text in items:
            words = self.reader.words(text or "")[0]
            self.lengths[item] = len(words)
            for k in range(len(words) - window + 1):
                where.setdefault(" " + " ".join(words[k : k + window]) + " ", []).append((item, k))
        self.machine = ahocorasick.Automaton()
        for pattern, places in where.items():
            self.machine.add_word(pattern, places)
        self.empty = not where
        self.machine.make_automaton()

    def hits(self, line: str) -> dict[int, dict[int, list[int]]]:
        """Of each item, by its shift against the text, the places of its windows in a line of words (see line_of)."""
        hits: dict[int, dict[int, list[int]]] = {}
        if self.empty:
            return hits
        starts: list[int] = []
        for end, places in self.machine.iter(line):
            if not starts:
                at = 1
                for w in line.split():
                    starts.append(at)
                    at += len(w) + 1
            d = bisect_left(starts, end) - self.window
            for item, i in places:
                hits.setdefault(item, {}).setdefault(d - i, []).append(d)
        return hits

    def leaks(self, hits: dict, spans: list[tuple[int, int]], pieces: tuple) -> list[tuple[int, int, int, int]]:
        """item, words held, first and last place in the original, of every item that leaks by its hits."""
        found = []
        for item, diagonals in hits.items():
            stretches = []
            for shift, at in diagonals.items():
                first = last = at[0]
                for d in at[1:]:
                    if d > last + 1:
                        stretches.append((first, first - shift, last - first + self.window))
                        first = d
                    last = d
                stretches.append((first, first - shift, last - first + self.window))
            held, chain = best_chain(stretches)
            if held >= self.share * self.lengths[item] - 1e-9:
                a, b = chain[0][0], chain[-1][0] + chain[-1][2] - 1
                found.append((item, held, original(spans[a][0], pieces), original(spans[b][1] - 1, pieces) + 1))
        return found

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        if self.empty or not text:
            return []
        words, spans, pieces = self.reader.words(text)
        return self.leaks(self.hits(line_of(words)), spans, pieces)


def line_of(words: list[str]) -> str:
    """Words as the automaton reads them."""
    return f" {' '.join(words)} "


#: Automata of this worker process, the last used at the end. Tasks that follow in the same process find them built.
_BUILT: dict[tuple, Automaton] = {}


def _automaton(key: tuple, items: list[tuple[int, str]], window: int, share: float, held: int) -> Automaton:
    machine = _BUILT.pop(key, None) or Automaton(items, window, share)
    while len(_BUILT) >= held:
        _BUILT.pop(next(iter(_BUILT)))
    _BUILT[key] = machine
    return machine


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, words, start, end of each document that holds enough of an item.

    The corpus is scanned in place, without a shuffle. Items are a held-out set: they are
    read on the driver in blocks of at most BLOCK_CHARS characters, of which up to BLOCKS are one
    broadcast and one scan of the corpus. A worker process builds a block's automaton once and
    holds HELD of them; where there are more blocks, texts wait as lines of words and
    meet one automaton after the other. Defined cases: null, empty and short
    texts hold nothing; items of fewer than six words or null never leak; copies of an item
    under several ids leak under each; repeated documents count each; other columns aren't read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text is not null")
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null and i is not null").distinct().orderBy("i", "t")
    schema = "doc_id long, item_id long, words int, start int, end int"

    def scan(blocks: list[list[tuple[int, str]]]) -> DataFrame:
        shared, name = spark.sparkContext.broadcast(blocks), uuid.uuid4().hex

        def run(batches):
            import pyarrow as pa

            reader, kinds = Reader(), [("doc_id", pa.int64()), ("item_id", pa.int64()), ("words", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]
            most = WAITING_CHARS if len(blocks_here := shared.value) > HELD else 0
            waiting: list[tuple] = []
            size = 0

            def found():
                lines = [line_of(reader.words(t)[0]) for _, t in waiting]
                out = []
                for n, items_here in enumerate(blocks_here):
                    machine = _automaton((name, n), items_here, window, share, HELD)
                    for (doc, t), line in zip(waiting, lines):
                        if hits := machine.hits(line):
                            _, spans, pieces = reader.words(t)
                            out += [(doc, *leak) for leak in machine.leaks(hits, spans, pieces)]
                columns = list(zip(*out)) or [()] * len(kinds)
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], names=[n for n, _ in kinds])

            for batch in batches:
                for doc, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                    waiting.append((doc, t.as_py()))
                    size += len(waiting[-1][1])
                if size >= most:
                    yield found()
                    waiting, size = [], 0
            yield found()

        return source.mapInArrow(run, schema)

    blocks, size, scans = [[]], 0, []
    for r in rows.toLocalIterator():
        if size and size + len(r.t) > BLOCK_CHARS:
            if len(blocks) == BLOCKS:
                scans.append(scan(blocks))
                blocks = []
            blocks.append([])
            size = 0
        blocks[-1].append((r.i, r.t))
        size += len(r.t)
    scans.append(scan(blocks))
    return reduce(DataFrame.unionByName, scans)

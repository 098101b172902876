"""Byte-pair encoding as a streaming transducer.

The tokens of each prefix of a piece form a tree: the tokens of a prefix are those of
an earlier prefix and one last token, the only one that the merges leave standing
beside the token before it. A token of later text can reach back at most as far as
the longest token of the merge list, so the tokens that all of the last so many
prefixes have in common are stable: they are emitted at once, and memory stays as
small as the window of prefixes that are still open. Text is fed in slices; of a slice,
pieces are final once no later character can change them.

The vocabulary is a parameter: a file of base64 tokens and their ranks (a rank is a
token's id and its place in the merge order). It is read on the driver and broadcast,
about a megabyte whatever the corpus.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Splits text into pieces before the merges. Fixed value: the pattern that the vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of later text that can change a match's end: a contraction has three characters.
_AHEAD = 3
#: Pieces up to this length and this many are remembered; slices of text are fed in this size.
_SHORT, _REMEMBERED, _SLICE = 48, 200_000, 1 << 18


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merges:
    """The merge list, and what follows from it: the longest token, token ends, and which tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.lookahead = max(map(len, ranks))
        self.lengths: dict[int, tuple[int, ...]] = {}
        by_last: dict[int, set[int]] = {}
        for token in ranks:
            by_last.setdefault(token[-1], set()).add(len(token))
        for last, sizes in by_last.items():
            self.lengths[last] = tuple(sorted(sizes, reverse=True))
        self.fits: dict[tuple[bytes, bytes], bool] = {}

    def merge(self, piece: bytes) -> list[bytes]:
        """Applies the merges, lowest rank first, to a short run of bytes."""
        ranks, parts = self.ranks, [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            at, low = -1, 1 << 60
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and rank < low:
                    at, low = i, rank
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def side_by_side(self, left: bytes, right: bytes) -> bool:
        """Whether the merges leave the border between two tokens alone."""
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= _REMEMBERED:
                self.fits.clear()
            known = self.fits[key] = self.merge(left + right) == [left, right]
        return known


class PieceTransducer:
    """Tokens of one piece, fed in slices of bytes and emitted once stable."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.window = b""  # bytes since the last emitted token
        self.last: list[bytes | None] = [None]  # last token of each prefix of the window
        self.before: bytes | None = None  # the last emitted token

    def feed(self, data: bytes) -> Iterator[int]:
        """Ids that became stable."""
        merges = self.merges
        ranks, fits = merges.ranks, merges.side_by_side
        step = 4 * merges.lookahead
        for start in range(0, len(data), step):
            part = data[start : start + step]
            base = len(self.window)
            self.window += part
            window, last = self.window, self.last
            for end in range(base + 1, len(window) + 1):
                found = None
                for size in merges.lengths[window[end - 1]]:
                    at = end - size
                    if at < 0:
                        continue
                    token = window[at:end]
                    if token in ranks and (at == 0 or last[at] is not None):
                        left = last[at] if at else self.before
                        if left is None or fits(left, token):
                            found = token
                            break
                last.append(found)
            yield from self._stable()

    def _stable(self) -> Iterator[int]:
        """Tokens that every prefix that later text can continue from has in common."""
        n, reach = len(self.window), self.merges.lookahead
        if n <= reach:
            return
        open_ends = {i for i in range(max(0, n - reach), n + 1) if i == 0 or self.last[i] is not None}
        while len(open_ends) > 1:  # walk the furthest back until all meet
            far = max(open_ends)
            open_ends.discard(far)
            open_ends.add(far - len(self.last[far]))
        yield from self._emit(open_ends.pop())

    def _emit(self, end: int) -> list[int]:
        tokens, at = [], end
        while at > 0:
            tokens.append(self.last[at])
            at -= len(self.last[at])
        if tokens:
            self.before = tokens[0]
            self.window = self.window[end:]
            self.last = [None, *self.last[end + 1 :]]
        return [self.merges.ranks[t] for t in reversed(tokens)]

    def finish(self) -> list[int]:
        """Ids of what is left."""
        return self._emit(len(self.window))


class Encoder:
    """Ids of texts. feed() takes slices of one text, finish() ends it, encode() does a whole text."""

    def __init__(self, merges: Merges, pattern: str = PATTERN):
        import regex

        self.merges, self.known = merges, {}
        self.pieces = regex.compile(pattern)
        self.classes = [(regex.compile(p), regex.compile(p + "+")) for p in (r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]", r"\s")]
        self.rest, self.run, self.open = "", None, None

    def _piece(self, piece: str) -> list[int]:
        ids = self.known.get(piece)
        if ids is None:
            t = PieceTransducer(self.merges)
            ids = [*t.feed(piece.encode("utf-8", "replace")), *t.finish()]
            if len(piece) <= _SHORT:
                if len(self.known) >= _REMEMBERED:
                    self.known.clear()
                self.known[piece] = ids
        return ids

    def feed(self, text: str) -> list[int]:
        """Ids of the pieces that no later character can change. A run that fills the slice is fed on as it comes."""
        out: list[int] = []
        text, self.rest = self.rest + text, ""
        if self.open is not None:
            m = self.run.match(text)
            end = m.end() if m else 0
            if end == len(text):
                out += self.open.feed(text[:-_AHEAD].encode("utf-8", "replace"))
                self.rest = text[-_AHEAD:]
                return out
            # The last of a run of white space goes with what follows it, as in the pattern.
            end -= end > 0 and self.run is self.classes[3][1]
            out += self.open.feed(text[:end].encode("utf-8", "replace")) if end else ()
            out += self.open.finish()
            self.open, text = None, text[end:]
        pieces = self.pieces.findall(text)
        held = 0
        while pieces and held < _AHEAD + 1:  # keep what may still change, with the piece that it may join
            held += len(pieces.pop())
        while pieces and pieces[-1].isspace():
            held += len(pieces.pop())
        for p in pieces:
            out += self.known.get(p) or self._piece(p)
        tail = text[len(text) - held :] if held else ""
        if len(tail) > _SLICE // 2:
            first = self.pieces.match(tail)[0]
            kind = next(run for one, run in self.classes if one.match(first[-1]))
            if len(first) + 1 >= len(tail) and len(first) > 2 * _AHEAD and not any(c.isspace() for c in tail[len(first) :] if kind is not self.classes[3][1]) and kind.match(tail[1:]) and kind.match(tail[1:]).end() == len(tail) - 1:
                self.run, self.open = kind, PieceTransducer(self.merges)
                out += self.open.feed(tail[:-_AHEAD].encode("utf-8", "replace"))
                tail = tail[-_AHEAD:]
        self.rest = tail
        return out

    def finish(self) -> list[int]:
        out: list[int] = []
        text, self.rest = self.rest, ""
        if self.open is not None:
            m = self.run.match(text)
            end = m.end() if m else 0
            if end < len(text) and self.run is self.classes[3][1]:
                end -= end > 0
            out += self.open.feed(text[:end].encode("utf-8", "replace"))
            out += self.open.finish()
            self.open, text = None, text[end:]
        for p in self.pieces.findall(text):
            out += self._piece(p)
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for a null or empty one."""
        if not text:
            return []
        if len(text) <= _SLICE:
            self.rest = text
            return self.finish()
        out: list[int] = []
        for i in range(0, len(text), _SLICE):
            out += self.feed(text[i : i + _SLICE])
        return out + self.finish()


class Decoder:
    """Incremental ids to text: bytes that don't yet make up a character wait for the next ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {v: k for k, v in ranks.items()}
        self.state = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(self.tokens[i] for i in ids))

    def finish(self) -> str:
        """What is left; the decoder is then ready for another text."""
        text = self.state.decode(b"", final=True)
        self.state.reset()
        return text


def _shared(df: DataFrame, path: str):
    ranks = read_ranks(path)
    if sum(map(len, ranks)) > 64 << 20:
        raise ValueError("a vocabulary of more than 64 MB isn't broadcast")
    return df.sparkSession.sparkContext.broadcast(ranks)


def encode_corpus(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids of every document; one row per row of the input.

    The corpus is encoded in place, in Arrow batches, without a shuffle. Defined cases: null and
    empty texts have no ids; white space only is text; strings that look like special tokens
    are ordinary text; repeated rows stay; an empty table gives none; other columns aren't read.
    """
    shared = _shared(docs, vocabulary)

    def run(batches):
        import pyarrow as pa

        encoder = Encoder(Merges(shared.value))
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.slice(a, 500)
                ids = [encoder.encode(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_corpus(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, text of encoded documents; a null list gives null, an empty one an empty text."""
    shared = _shared(encoded, vocabulary)

    def run(batches):
        import pyarrow as pa

        decoder = Decoder(shared.value)
        for batch in batches:
            lists = batch.column(1).to_pylist()
            texts = [None if ids is None else decoder.feed(ids) + decoder.finish() for ids in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")

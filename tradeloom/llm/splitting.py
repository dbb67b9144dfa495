"""Splitting texts larger than a token limit at natural boundaries, by agglomerative merging.

A text is cut into atomic segments at its line and sentence ends; segments too large for a piece are cut on at clauses, white
space, marks and, if nothing else is there, between characters. Adjacent segments stand in a heap by the strength of
the boundary between them, and the weakest are merged first while the merged size plus the overlap fits.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import VOCABULARY, encode, spread, token_bytes

PIECES = "doc_id long, piece_no int, n_tokens int, shared_tokens int, cut string, first_char int, n_chars int, text string"
ARROW = pa.schema([("doc_id", pa.int64()), ("piece_no", pa.int32()), ("n_tokens", pa.int32()), ("shared_tokens", pa.int32()), ("cut", pa.string()), ("first_char", pa.int32()), ("n_chars", pa.int32()), ("text", pa.string())])

#: Boundaries from strong to weak; a boundary lies at the end of a match.
PARAGRAPH, LINE, SENTENCE, CLAUSE, BLANK, MARK, FORCED = 6, 5, 4, 3, 2, 1, 0
_STRONG = (
    (PARAGRAPH, regex.compile(r"(?:\r\n|\n|\r)[^\S\r\n]*(?:\r\n|\n|\r)\s*")),
    (LINE, regex.compile(r"(?:\r\n|[\n\r\u2028\u2029\f])")),
    (SENTENCE, regex.compile(r"""[.!?…]+["'”’»)\]]*\s+|[。！？；]+["”’」』）]*\s*""")),
)
_WEAK = (
    (CLAUSE, regex.compile(r"[,;:|]\s+|[，、：]|\s[–—-]\s")),
    (BLANK, regex.compile(r"\s+")),
    (MARK, regex.compile(r"[^\p{L}\p{N}\p{M}\s]+")),
)


#: A stretch of letters and digits, and a blank at which the tokenizer starts anew whatever stands around it.
_RUN, _SEAM = regex.compile(r"[\p{L}\p{N}\p{M}]+"), regex.compile(r"(?<=[\p{L}\p{N}\p{P}]) (?=\p{L})")


class _Sized:
    """A text with its tokens. Positions are characters; `at` gives the byte of each."""

    def __init__(self, text: str, ids: list[int], path: str) -> None:
        self.text, self.path = text, path
        self.ends = list(accumulate(map(token_bytes(path).__getitem__, ids)))  # byte at which each token ends
        if text.isascii():
            self.at: Sequence[int] = range(len(text) + 1)
        else:
            codes = np.frombuffer(text.encode("utf-32-le"), dtype="uint32")
            widths = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
            self.at = [0, *np.cumsum(widths).tolist()]

    def low(self, a: int) -> int:
        """The first token that holds something from character a on."""
        return bisect.bisect_right(self.ends, self.at[a])

    def high(self, b: int) -> int:
        """The last token that holds something before character b."""
        return bisect.bisect_left(self.ends, self.at[b])

    def back(self, b: int, tokens: int) -> int:
        """The character from which `tokens` tokens lead to b; a few more where a character would be cut."""
        k = self.high(b) - tokens
        return bisect.bisect_right(self.at, self.ends[k]) - 1 if k >= 0 and b else 0

    def alone(self, a: int, b: int) -> int:
        """Tokens of the characters a to b as a text by itself. Only what lies before the first and after the last seam can differ from the whole text's tokens."""
        if a == 0 and b == len(self.text):
            return len(self.ends)
        first, last = _SEAM.search(self.text, a + 1, b), None
        for m in _SEAM.finditer(self.text, max(a + 1, b - 120), b):
            last = m
        if first is None or last is None or last.start() <= first.start():
            return len(encode(self.text[a:b], self.path))
        p, q = first.start(), last.start()
        return len(encode(self.text[a:p], self.path)) + self.low(q) - self.low(p) + len(encode(self.text[q:b], self.path))


def _cuts(text: str, patterns: tuple) -> dict[int, int]:
    """Strength by character position; the strongest wins."""
    found: dict[int, int] = {}
    for strength, pattern in patterns:
        for m in pattern.finditer(text):
            found.setdefault(m.end(), strength)
    found.pop(len(text), None)
    found.pop(0, None)
    return found


def _atoms(sized: _Sized, capacity: int) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int]]]:
    """(atoms, forced): atoms (first character, end, strength of the boundary at its start, first and last token), each of at most capacity tokens; the
    segments that had to be cut between characters."""
    out: list[tuple[int, int, int, int, int]] = []
    forced: list[tuple[int, int]] = []

    def add(a: int, b: int, strength: int, level: int) -> None:
        low, high = sized.low(a), sized.high(b)
        if high - low < capacity:
            out.append((a, b, strength, low, high))
        elif level < len(_WEAK):
            refine(a, b, strength, _cuts(sized.text[a:b], (_WEAK[level],)), level + 1)
        else:
            forced.append((a, b))
            while high - low >= capacity:
                cut = max(a + 1, bisect.bisect_right(sized.at, sized.ends[low + capacity - 2]) - 1)
                out.append((a, cut, strength, low, sized.high(cut)))
                a, strength = cut, FORCED
                low = sized.low(a)
            if a < b:
                out.append((a, b, strength, low, high))

    def refine(a: int, b: int, strength: int, cuts: dict[int, int], level: int) -> None:
        begin = a
        for cut, following in [*sorted(cuts.items()), (b - a, 0)]:
            add(begin, a + cut, strength, level)
            begin, strength = a + cut, following

    refine(0, len(sized.text), PARAGRAPH, _cuts(sized.text, _STRONG), 0)
    return out, forced


def merge(strength: list[int], low: list[int], high: list[int], capacity: int, first_capacity: int) -> list[tuple[int, int]]:
    """Runs of merged atoms (first, last), in order. Atom k holds the tokens low[k] to high[k], and strength[k] is that of the boundary before it.
    The weakest boundaries go first, of equal ones those with the smallest merged size. The first run has no overlap before it."""
    n = len(strength)
    last, after, before = list(range(n)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n

    def push(left: int, right: int) -> None:
        total = high[last[right]] - low[left] + 1
        if total <= (capacity if left else first_capacity):
            heapq.heappush(heap, (strength[right], total, left, right, last[right]))

    heap: list[tuple[int, int, int, int, int]] = []
    for k in range(1, n):
        push(k - 1, k)
    while heap:
        _, _, left, right, until = heapq.heappop(heap)
        # a pair is stale if either side has merged since
        if not alive[left] or not alive[right] or after[left] != right or last[right] != until:
            continue
        last[left], alive[right], after[left] = last[right], False, after[right]
        if after[left] < n:
            before[after[left]] = left
            push(left, after[left])
        if before[left] >= 0:
            push(before[left], left)
    return [(k, last[k]) for k in range(n) if alive[k]]


def _pieces(text: str, limit: int, overlap: int, path: str) -> tuple[list[tuple[int, int, int, int]], str]:
    """(pieces, cut): pieces (first character, end, tokens, tokens shared with the one before) and how the text was cut."""
    ids = encode(text, path)
    if len(ids) <= limit:
        return [(0, len(text), len(ids), 0)], "whole"
    sized = _Sized(text, ids, path)
    slack = 4  # for characters that span tokens
    capacity = limit - overlap - slack
    atoms, forced = _atoms(sized, capacity)
    first, end, strength, low, high = (list(c) for c in zip(*atoms, strict=True))
    todo = [(first[a], end[b]) for a, b in reversed(merge(strength, low, high, capacity, limit - slack))]
    out: list[tuple[int, int, int, int]] = []
    while todo:
        a, b = todo.pop()
        begin = sized.back(a, overlap) if a else a
        n = sized.alone(begin, b)
        if n > limit and b - a > 1:
            # by itself the piece has more tokens than in the text: it is cut once more, at an atom's end near its middle or else between characters
            k = bisect.bisect_left(first, (a + b) // 2)
            middle = first[k] if k < len(first) and a < first[k] < b else (a + b) // 2
            if first[min(k, len(first) - 1)] != middle:
                forced.append((a, b))
            todo += [(middle, b), (a, middle)]
            continue
        out.append((begin, b, n, sized.high(a) - sized.low(begin) + 1 if a else 0))
    # a stretch between the room beside the overlap and the limit is cut too, but isn't larger than the limit
    large = any(len(encode(m.group(), path)) > limit for a, b in forced for m in _RUN.finditer(text, a, b) if 4 * (m.end() - m.start()) > limit)
    return out, "forced" if large else "boundary"


def split(text: str, limit: int = 512, overlap: int = 64, path: str = VOCABULARY) -> list[tuple[str, int, int]]:
    """(piece, tokens, tokens shared with the piece before). A text within the limit is one piece.

    Each piece holds at most `limit` of the text's tokens, and as text by itself at most `limit` too; every character is
    in a piece. Consecutive pieces share `overlap` tokens, up to three more where the cut would fall inside a character. A single character
    of more tokens than fit beside the overlap is kept whole.
    """
    return [(text[a:b], n, shared) for a, b, n, shared in _pieces(text, limit, overlap, path)[0]]


def split_documents(docs: DataFrame, limit: int = 512, overlap: int = 64, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, with_text: bool = True) -> DataFrame:
    """The pieces of all documents: doc_id, piece_no, n_tokens, shared_tokens, cut, first_char, n_chars, text; no shuffle of the pieces.

    cut is `whole` for a document within the limit, `forced` if the splitter had to cut inside a stretch of letters and digits that is by itself larger than
    the limit, else `boundary`. Null texts have no piece, empty ones an empty piece. A repeated row repeats its pieces. Without with_text the text is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if t is None:
                    continue
                pieces, cut = _pieces(t, limit, overlap, path)
                rows += [(doc, k, n, shared, cut, a, b - a, t[a:b] if with_text else None) for k, (a, b, n, shared) in enumerate(pieces)]
                held += len(t)
                if held > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)

    own = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    return spread(own).mapInArrow(run, PIECES)

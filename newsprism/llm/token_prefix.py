"""Exact token counts at every prefix by dynamic programming (operator 8).

A byte-level BPE first cuts a text into pieces, then merges bytes inside each piece.  For one
piece, ``last[i]`` is the last token of the encoding of its first i bytes and ``count[i]`` the
number of tokens: token t = piece[j:i] is the last one exactly if t and ``last[j]`` are a pair
that the merges leave apart (two neighbours are all that can disturb each other), so
``count[i] = count[j] + 1``.  A text's table is the running sum over its pieces; a count at any
prefix, a cut at a budget or a test against a limit is then a look-up, not a new encoding.

Edge cases: a null or empty text has 0 bytes and 0 tokens; special strings of the vocabulary
inside a text are one token each, as the library's default; a very long piece has one table of its
own, a cut in it costs one pass; other columns are never read; a null doc_id is carried through.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsprism.llm.scratch import bound_batches

#: The published cutting pattern of this family of vocabularies (a fixed value).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A piece whose prefixes are pieces too (after a leading blank): letters, numbers, other marks, white space.
RUN = regex.compile(r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+")
#: Pieces and pairs that one Python worker remembers at most; the oldest half goes beyond that.
MEMO_PIECES, MEMO_PAIRS = 250_000, 300_000


def byte_letters() -> dict[str, int]:
    """The vocabulary's letter of each byte: printable ones stand for themselves, the others, in
    order, for the code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Prefix tables for one vocabulary file (the JSON of the ``tokenizers`` library)."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        # Numbers in order of birth: the bytes first, then one per merge.
        born: dict[bytes, int] = {bytes([i]): i for i in range(256)}
        merges: dict[tuple[int, int], int] = {}
        halves: list[tuple[int, int] | None] = [None] * 256
        for m in spec["model"]["merges"]:
            x, y = map(as_bytes, m.split(" ") if isinstance(m, str) else m)
            if x + y not in born:
                born[x + y] = len(halves)
                halves.append((born[x], born[y]))
                merges[born[x], born[y]] = born[x + y]
        self.merges = {a << 20 | b: m for (a, b), m in merges.items()}
        #: Per token: its outermost parts on the right and on the left, each with the token that takes it up.
        self.right, self.left = ([_edge(t, halves, side) for t in range(len(halves))] for side in (1, 0))
        self.pairs: dict[int, bool] = {}
        # A token that the merges never build (its halves don't stay apart until it is born) can't occur.
        self.vocab = {w: t for w, t in born.items() if t < 256 or self._built(*halves[t], t)}
        self.longest = max(map(len, self.vocab))
        self.memo: dict[str, int] = {}
        self.pattern = regex.compile(PIECES)
        specials = [t["content"] for t in spec["added_tokens"]]
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None

    def _disturbed(self, a: int, b: int, until: int) -> bool:
        """Whether, before token number ``until``, a part at the end of a merges with one at the
        start of b: both must still be whole, and of equal merges the left one goes first."""
        find = self.merges.get
        for x, x_end in self.right[a]:
            x <<= 20
            for y, y_end in self.left[b]:
                m = find(x | y)
                if m is not None and m < x_end and m <= y_end and m < until:
                    return True
        return False

    def _built(self, a: int, b: int, t: int) -> bool:
        return not self._disturbed(a, b, t)

    def _apart(self, a: int, b: int) -> bool:
        """Whether a, b is the encoding of their joined bytes."""
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MEMO_PAIRS:
                _halve(self.pairs)
            known = self.pairs[key] = not self._disturbed(a, b, _NEVER)
        return known

    def tables(self, pieces: list[bytes]) -> Iterator[list[int]]:
        """For each piece, the token count of every byte prefix, from the empty one on (the list
        is reused).  In sorted order, neighbours share the part of the table they have in common."""
        vocab, longest, pairs = self.vocab.get, self.longest, self.pairs.get
        counts, last, before = [0], [-1], b""
        for piece in pieces:
            same, n = 0, len(piece)
            for x, y in zip(piece, before):  # noqa: B905
                if x != y:
                    break
                same += 1
            del counts[same + 1:], last[same + 1:]
            for i in range(same + 1, n + 1):
                for j in range(i - 1, max(0, i - longest) - 1, -1):
                    t = vocab(piece[j:i])
                    if t is not None:
                        if j:
                            known = pairs(last[j] << 20 | t)
                            if known is None:
                                known = self._apart(last[j], t)
                            if not known:
                                continue
                        last.append(t)
                        counts.append(counts[j] + 1)
                        break
            before = piece
            yield counts

    def learn(self, pieces: set[str]) -> dict[str, int]:
        """Counts of pieces that aren't remembered; short ones are from now on."""
        order = sorted((p.encode(), p) for p in pieces)
        new = {p: t[-1] for (_, p), t in zip(order, self.tables([b for b, _ in order]), strict=True)}
        if len(self.memo) + len(new) > MEMO_PIECES:
            _halve(self.memo)
        if len(new) <= MEMO_PIECES // 2:
            self.memo.update((p, n) for p, n in new.items() if len(p) <= 64)
        return new

    def pieces(self, text: str) -> list[str | None]:
        """The pieces in order; a special string is None."""
        if not self.specials:
            return self.pattern.findall(text)
        out: list[str | None] = []
        for i, part in enumerate(self.specials.split(text)):
            out.extend([None] if i % 2 else self.pattern.findall(part))
        return out

    def counts(self, texts: list[str]) -> list[list[int]]:
        """Tokens of each piece of each text."""
        return [counts for _, counts in self.counted(texts)]

    def counted(self, texts: list[str]) -> list[tuple[list[str | None], list[int]]]:
        """The pieces of each text and the tokens of each."""
        known = self.memo.get
        found = [self.pieces(t) for t in texts]
        out = [[known(p) for p in f] for f in found]
        new = {p for f, c in zip(found, out, strict=True) if None in c for p, n in zip(f, c, strict=True) if n is None}
        if new:
            special = {None: 1} if None in new else {}
            new = self.learn(new - {None}) | special
            out = [[new[p] if n is None else n for p, n in zip(f, c, strict=True)] if None in c else c
                   for f, c in zip(found, out, strict=True)]
        return list(zip(found, out, strict=True))

    def count(self, text: str) -> int:
        return sum(self.counts([text])[0])

    def prefixes(self, text: str) -> Prefixes:
        return Prefixes(self, text, *self.counted([text])[0])


_NEVER = 1 << 40


def _edge(token: int, halves: list, side: int) -> list[tuple[int, int]]:
    """The parts of a token along one edge, the token itself first, with the token that ends each."""
    out, end = [], _NEVER
    while True:
        out.append((token, end))
        if halves[token] is None:
            return out
        end, token = token, halves[token][side]


def _halve(memo: dict) -> None:
    for k in list(memo)[:len(memo) // 2]:
        del memo[k]


class Prefixes:
    """The stored table of one text: token counts at its piece ends; in-piece counts on demand.

    A prefix that ends inside a piece cuts its tail anew from two pieces before (white space and
    special strings look ahead, but not further), so any answer costs a few pieces.
    """

    def __init__(self, counter: PrefixCounter, text: str, found: list[str | None], counts: list[int]):
        self.counter, self.text = counter, text
        specials = [m.span() for m in counter.specials.finditer(text)] if counter.specials else []
        sizes, k = [], 0
        for p in found:
            if p is None:
                sizes.append(specials[k][1] - specials[k][0])
                k += 1
            else:
                sizes.append(len(p))
        self.ends = [0, *accumulate(sizes)]
        self.tokens = [0, *accumulate(counts)]

    def at(self, chars: int) -> int:
        """Exact token count of ``text[:chars]``."""
        chars = min(max(0, chars), len(self.text))
        k = bisect_right(self.ends, chars) - 1
        back = max(0, k - 2)
        return self.tokens[back] + self.counter.count(self.text[self.ends[back]:chars])

    def cut(self, budget: int) -> int:
        """Characters of the longest prefix that ends where a piece ends, or inside the piece
        that crosses the budget, and whose own count is at most the budget."""
        k = bisect_right(self.tokens, budget) - 1
        best, stop = self.ends[k], self.ends[min(k + 1, len(self.ends) - 1)]
        piece = self.text[best:stop]
        # Cut inside a run of one kind, earlier pieces stay as they are: the piece's own table answers.
        alone = 0 if k == 0 or not self.text[best - 1:best].isspace() else 1
        lead = len(piece) if not RUN.fullmatch(piece) or alone and piece.isspace() else 1 + (piece[0] == " " and not piece.isspace())
        for chars in range(best + 1, min(best + lead, stop + 1)):
            if self.at(chars) <= budget:
                best = chars
        if lead < len(piece):
            start, counts, at = self.ends[k], next(self.counter.tables([piece.encode()])), 0
            for i, c in enumerate(piece, 1):
                at += len(c.encode())
                if i >= lead and self.tokens[k] + counts[at] <= budget:
                    best = start + i
        elif stop > best and self.at(stop) <= budget:
            best = stop
        return best


def _groups(texts: list[str], chars: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of texts of about so many characters (a longer text is in a run of its own)."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > chars:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


_COUNTERS: dict[str, PrefixCounter] = {}


def counter_of(vocabulary: str) -> PrefixCounter:
    """One counter per worker and vocabulary; its memory is bounded."""
    key = f"{len(vocabulary)}:{hash(vocabulary)}"
    if key not in _COUNTERS:
        _COUNTERS[key] = PrefixCounter(vocabulary)
    return _COUNTERS[key]


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and cut_chars (characters that fit the limit).

    The vocabulary (a few MB, a fixed file) is read on the driver and broadcast.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    with open(vocabulary_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches):
        counter = counter_of(shared.value)
        for b in batches:
            sizes, tokens, cuts = [], [], []
            for texts in _groups([x.as_py() or "" for x in b.column(1)]):
                for text, (found, counts) in zip(texts, counter.counted(texts), strict=True):
                    n = sum(counts)
                    sizes.append(len(text.encode()))
                    tokens.append(n)
                    cuts.append(len(text) if n <= limit else Prefixes(counter, text, found, counts).cut(limit))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()),
                 pa.array([n > limit for n in tokens], pa.bool_()), pa.array(cuts, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_chars"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut_chars long")

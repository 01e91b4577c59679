"""Token ids of whole texts, by distinct pieces.

Byte-level BPE never merges across the word pieces that its own pattern cuts, so a text may be
encoded piece by piece. The pieces of a batch of texts are made distinct first; a worker encodes
each new one once and keeps its ids in one array, from which the texts are put together. What is
kept is emptied when full, which costs time only.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import regex

_CUT = re.compile(r"(?<=\S)(?= \S)")
REMEMBERED = 1_500_000
#: Words encoded in one call's text, and marks that the pattern takes together behind a word.
JOINED, MARKS = 256, "!\"#$%&()*+,-./:;<=>?@[]^`{|}~"
#: The sign that stands for a blank in the vocabulary.
BLANK = "\u0120"


def lines(text: str) -> list[list[str]]:
    """A text cut at line ends, and its lines at blanks: both stand between the parts."""
    return [x.split(" ") for x in text.split("\n")]


def words_apart(text: str) -> list[str]:
    """Parts that begin at a blank between words, without that blank: joined by it they are the
    text. Longer runs of white space stay inside a part, since the pattern looks at them as a
    whole."""
    first, *rest = _CUT.split(text)
    return [first, *[p[1:] for p in rest]]


class _Pool:
    """Ids of pieces, one after the other in one array."""

    def __init__(self):
        self.ids = np.empty(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 12, np.int64)  # of piece k; one more ends the last
        self.n = 0

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Numbers of new pieces, given their ids in a row."""
        first, end = self.n, int(self.starts[self.n])
        while end + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.empty_like(self.ids)))
        while first + len(lengths) + 1 > len(self.starts):
            self.starts = np.concatenate((self.starts, np.zeros_like(self.starts)))
        self.ids[end:end + len(ids)] = ids
        self.starts[first + 1:first + 1 + len(lengths)] = end + np.cumsum(lengths)
        self.n += len(lengths)
        return np.arange(first, self.n)

    def lengths(self, pieces: np.ndarray) -> np.ndarray:
        return self.starts[pieces + 1] - self.starts[pieces]

    def of(self, pieces: np.ndarray) -> np.ndarray:
        """The ids of all the pieces in a row."""
        n = self.lengths(pieces)
        shift = self.starts[pieces] - np.cumsum(n) + n
        return self.ids[np.arange(int(n.sum())) + np.repeat(shift, n)]


class Encoder:
    """Encodes with what it remembers; equal to encoding each whole text by the library."""

    def __init__(self, path: str, pattern: str, ordinary: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary
        self.pattern = regex.compile(pattern)
        self.special = () if ordinary else tuple(
            t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.size = self.tokenizer.get_vocab_size()
        #: Whether an id's text begins with the blank that goes ahead of a word.
        self.blank = np.zeros(self.size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.blank[i] = token.startswith(BLANK)
        self._forget()

    def _forget(self) -> None:
        """Empty what is kept: the numbers of pieces behind a blank, of pieces that begin a line,
        of strings that are encoded by themselves, and all their ids."""
        self.pool = _Pool()
        self.behind: dict[str, int] = {}
        self.ahead: dict[str, int] = {}
        self.whole: dict[str, int] = {}
        #: Pieces with white space at an end, or nothing: what stands beside them matters.
        self.edges: list[int] = []

    def _words(self, words: list[str]) -> np.ndarray:
        """Numbers of new pieces of letters behind a blank: many are encoded in one text, which
        the pattern cuts where they meet."""
        texts = [" " + " ".join(words[i:i + JOINED]) for i in range(0, len(words), JOINED)]
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.array([i for e in coded for i in e.ids], np.uint32)
        first = np.flatnonzero(self.blank[ids])
        if len(first) != len(words):  # a letter of one side only: Unicode versions differ
            return self._strings([" " + w for w in words])
        return self.pool.add(ids, np.diff(first, append=len(ids)))

    def _strings(self, strings: list[str]) -> np.ndarray:
        """Numbers of strings that are encoded one by one."""
        whole = self.whole
        new = [s for s in dict.fromkeys(strings) if s not in whole]
        if new:
            coded = [e.ids for e in
                     self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            at = self.pool.add(np.array(list(chain.from_iterable(coded)), np.uint32),
                               np.fromiter(map(len, coded), np.int64, len(coded)))
            whole.update(zip(new, at.tolist(), strict=True))
        return np.fromiter(map(whole.__getitem__, strings), np.int64, len(strings))

    def _joined(self, parts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Numbers of pieces that are made of others, so many of ``parts`` each."""
        n = self.pool.lengths(parts)
        first = np.cumsum(counts) - counts
        return self.pool.add(self.pool.of(parts), np.add.reduceat(n, first))

    def _cut(self, strings: list[str]) -> np.ndarray:
        """Numbers of strings by the parts that the pattern cuts; the library itself cuts those
        with the name of a special token."""
        everything = "\n".join(strings)
        if any(x in everything for x in self.special):
            parts = [[s] if any(x in s for x in self.special) else self.pattern.findall(s)
                     for s in strings]
        else:
            parts = list(map(self.pattern.findall, strings))
        return self._joined(self._strings(list(chain.from_iterable(parts))),
                            np.fromiter(map(len, parts), np.int64, len(parts)))

    def _learn(self, new: list[str], known: dict[str, int], blank: bool) -> None:
        """Encode new pieces, behind a blank or not: letters; letters and marks; anything else."""
        words, marked, rest = [], [], []
        everything = "\n".join(new)
        special = [x for x in self.special if x in everything]
        for w in new:
            if w.isalpha():
                words.append(w)
            elif (base := w.rstrip(MARKS)).isalpha() and not (
                    special and any(x in w for x in special)):
                marked.append((w, base))
            else:
                rest.append(w)
        here = set(words)
        words += dict.fromkeys(b for _, b in marked if b not in known and b not in here)
        if words:
            at = self._words(words) if blank else self._strings(words)
            known.update(zip(words, at.tolist(), strict=True))
        if marked:
            pairs = np.empty((len(marked), 2), np.int64)
            pairs[:, 0] = [known[b] for _, b in marked]
            pairs[:, 1] = self._strings([w[len(b):] for w, b in marked])
            at = self._joined(pairs.ravel(), np.full(len(marked), 2))
            known.update(zip([w for w, _ in marked], at.tolist(), strict=True))
        if rest:
            at = self._cut([" " + w for w in rest] if blank else rest).tolist()
            known.update(zip(rest, at, strict=True))
            self.edges += [n for w, n in zip(rest, at, strict=True)
                           if not w or w[0].isspace() or w[-1].isspace()]

    def _numbers(self, words: list[str], known: dict[str, int], blank: bool) -> np.ndarray:
        """Numbers of pieces, -1 for an empty one at the begin of a line."""
        at = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            new = [w for w in dict.fromkeys([words[i] for i in missing]) if w or blank]
            if new:
                self._learn(new, known, blank)
            at[missing] = [known.get(words[i], -1) for i in missing]
        return at

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.behind) + len(self.ahead) + len(self.whole) > REMEMBERED:
            self._forget()
        heads, tails, sizes, offsets = [], [], [], [0]
        for t in texts:
            for head, *rest in lines(t or ""):
                heads.append(head)
                tails += rest
                sizes.append(len(rest))
            offsets.append(len(heads))
        # Per line its head and what follows behind blanks; between lines of a text a line end.
        (line_end,) = self._strings(["\n"])
        n, first = np.array(sizes, np.int64), np.array(offsets[:-1], np.int64)
        head_at, tail_at = (self._numbers(heads, self.ahead, False),
                            self._numbers(tails, self.behind, True))
        before = np.ones(len(n), np.int64)  # the line end ahead of a line
        before[first] = 0
        at = np.empty(int(len(n) + n.sum() + before.sum()), np.int64)
        start = np.cumsum(n + 1 + before) - n - 1
        at[(start - before)[before > 0]] = line_end
        at[start] = head_at
        inside = np.ones(len(at), bool)
        inside[start] = False
        inside[(start - before)[before > 0]] = False
        at[inside] = tail_at
        ends = np.append(start[first], len(at)) if len(texts) else np.zeros(1, np.int64)
        out = self._texts(at, ends)
        # Where white space meets white space the pattern must see it in one part.
        odd = np.isin(at, np.array(self.edges, np.int64))
        odd[start[(head_at < 0) & (before > 0)]] = True
        for i in np.unique(np.searchsorted(ends, np.flatnonzero(odd), "right") - 1).tolist():
            head, *rest = words_apart(texts[i])
            own = np.concatenate((self._numbers([head], self.ahead, False),
                                  self._numbers(rest, self.behind, True)))
            (out[i],) = self._texts(own, np.array([0, len(own)]))
        return out

    def _texts(self, at: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Ids of texts given as numbers of pieces, -1 for an empty first piece."""
        real = at >= 0
        counts = np.zeros(len(at) + 1, np.int64)
        counts[1:][real] = self.pool.lengths(at[real])
        ends = (np.cumsum(counts) * 4)[offsets].tolist()
        raw = self.pool.of(at[real]).astype("<u4").tobytes()
        return [raw[i:j] for i, j in zip(ends, ends[1:], strict=False)]


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str, ordinary: bool = False) -> Encoder:
    """One per worker process; tasks share what it remembers.

    ``ordinary``: the names of special tokens are plain text where a document holds them.
    """
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path, pattern, ordinary)


def batches_of(texts: list[str | None], chars: int = 2 << 20) -> list[tuple[int, int]]:
    """Ranges of rows that hold about so many characters."""
    out, first, total = [], 0, 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= chars:
            out.append((first, i + 1))
            first, total = i + 1, 0
    if first < len(texts):
        out.append((first, len(texts)))
    return out

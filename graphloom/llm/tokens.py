"""Byte-level BPE encoding with the tokenizers library, many texts at a time.

A byte-level BPE of this family splits text before it merges, and a space always
starts a new split unless it has white space on both sides.  So a text may be cut
before its spaces, and each distinct piece need be encoded only once: pieces recur
far more often than texts do.  Texts where a space has white space (or the end)
after and white space before it are encoded whole.
"""

from __future__ import annotations

import gc
import os
import re
from collections import defaultdict
from functools import lru_cache
from itertools import chain, count
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2

#: Distinct pieces a worker remembers before it starts afresh (about 150 bytes each).
MEMO = 600_000
#: Pieces that are encoded in one string.
JOIN = 1000
#: Characters of one text encoded at a time.
SLICE = 1 << 22
#: Characters whose ids a caller holds at a time.
RUN = 1 << 21

#: Marks a text's first piece; no piece holds a space itself.
_FIRST = " first "
_UNSAFE = re.compile(r"\s (?:\s|$)")
#: Letters that every version of Unicode in use calls so, and marks that none does: a run of either is one split.
#: An apostrophe is no such mark, since it may begin a split with letters.
_L = "[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+"
_LETTERS = re.compile(_L).fullmatch
_MARKED = re.compile(f"({_L})([!-&(-/:-@\\[-`{{-~]*)").fullmatch
#: Bytes as byte-level vocabularies write them.
_KEPT = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = np.arange(0x100, dtype="<u4")
_BYTES[[b for b in range(0x100) if b not in set(_KEPT)]] = 0x100 + np.arange(0x100 - len(_KEPT))


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where an installed public vocabulary file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def runs(texts: list) -> list[slice]:
    """Consecutive texts of about RUN characters together."""
    out, at, size = [], 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= RUN:
            out.append(slice(at, i + 1))
            at, size = i + 1, 0
    return out + [slice(at, len(texts))] * (at < len(texts))


def _memo(known: list = ()) -> defaultdict:
    """piece -> running number; missing pieces are collected for one batched encoding."""
    return defaultdict(count(len(known)).__next__, zip(known, range(len(known)), strict=True))


class Encoder:
    """encode(texts) gives all ids in a row and where each text's ids begin and end."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().items()
        #: Added tokens and their ids; a text is split at them before all else.
        self.added = {t.content: i for i, t in added}
        #: Added tokens that take white space beside them or look at their neighbours: texts with them are encoded whole.
        self.greedy = [t.content for _, t in added if t.lstrip or t.rstrip or t.single_word or t.normalized]
        longest = sorted(self.added, key=len, reverse=True)
        self.split_added = re.compile(f"({'|'.join(map(re.escape, longest))})").split
        self.vocabulary = self.tokenizer.get_vocab_size()
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if len(feed) == 1 else -1
        split = self.tokenizer.pre_tokenizer
        plain = self.tokenizer.normalizer is None and type(split).__name__ == "ByteLevel" and split.use_regex and not split.add_prefix_space
        #: The model, if it may be given letters without splitting them first, and pieces may be taken apart by _MARKED.
        self.model = self.tokenizer.model if plain and type(self.tokenizer.model).__name__ == "BPE" else None
        self._reset()

    def _reset(self):
        self.memo = _memo()
        self.flat = np.zeros(1 << 16, np.int32)
        self.filled = 0
        # piece i's ids are the size[i] ones from begin[i] on in flat
        self.begin = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int32)
        self.known = 0
        # of pieces: begins, or ends, with white space (an empty piece lies between two spaces)
        self.starts = np.zeros(1 << 16, bool)
        self.ends = np.zeros(1 << 16, bool)
        self.used = np.zeros(1 << 16, np.int32)

    def _forget(self):
        """Keep the pieces met more than once, the most used ones if those are too many; older meetings count half."""
        used = self.used[: self.known]
        keep = np.flatnonzero(used > 1)
        if len(keep) > MEMO // 2:
            keep = np.sort(keep[np.argpartition(used[keep], len(keep) - MEMO // 2)[len(keep) - MEMO // 2 :]])
        used = used[keep] // 2
        ids, length = self._gather(keep)
        starts, ends = self.starts[keep], self.ends[keep]
        names = list(self.memo)
        self._reset()  # before the new memory is made: both together would be the peak
        names = list(map(names.__getitem__, keep.tolist()))
        memo = _memo(names)
        self.memo, self.known = memo, len(keep)
        self._room(len(keep))
        self._put(np.arange(len(keep)), ids, length)
        self.starts[: len(keep)], self.ends[: len(keep)], self.used[: len(keep)] = starts, ends, used

    def _room(self, n: int):
        """Make room for n pieces."""
        if n > len(self.begin):
            more = max(len(self.begin), n - len(self.begin))
            for name in ("begin", "size", "starts", "ends", "used"):
                held = getattr(self, name)
                setattr(self, name, np.concatenate([held, np.zeros(more, held.dtype)]))

    def _put(self, where: np.ndarray, ids: np.ndarray, sizes: np.ndarray):
        """Keep the ids, one piece's after the other's, of the pieces with the numbers where."""
        to = self.filled + len(ids)
        if to > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), to - len(self.flat)), np.int32)])
        self.flat[self.filled : to] = ids
        self.begin[where] = self.filled + np.cumsum(sizes) - sizes
        self.size[where] = sizes
        self.filled = to

    def _learn(self):
        """Encode the pieces that have a number but no ids yet."""
        n = len(self.memo)
        if n == self.known:
            return
        fresh = self._last(n - self.known)
        letters, other, made, parts, counts = self._take_apart(fresh)
        new = self._last(len(self.memo) - n)
        letters += [i for i, x in enumerate(new, len(fresh)) if x[-1].isalpha()]
        other += [i for i, x in enumerate(new, len(fresh)) if not x[-1].isalpha()]
        fresh += new
        n, base = len(self.memo), self.known
        self._room(n)
        joined = [
            i for i in other
            if (x := fresh[i]) and x[0] != " " and (x.isprintable() or ("\n" in x and all(y and y.isprintable() for y in x.split("\n"))))
        ]
        alone = sorted(set(other).difference(joined))
        rest = [x[len(_FIRST) :] if x.startswith(_FIRST) else " " + x for x in map(fresh.__getitem__, alone)]
        last = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
        sizes = np.fromiter(map(len, last), np.int64, len(last))
        self._put(base + np.array(alone, np.int64), np.fromiter(chain.from_iterable(last), np.int32, int(sizes.sum())), sizes)
        self._put(base + np.array(letters, np.int64), *self._encode_letters([fresh[i] for i in letters]))
        self._put(base + np.array(joined, np.int64), *self._encode_joined([fresh[i] for i in joined]))
        for i in alone:  # all others neither begin nor end with white space
            x = fresh[i]
            first = x.startswith(_FIRST)
            x = x[len(_FIRST) :] if first else x
            self.starts[base + i] = not x or x[0].isspace()
            self.ends[base + i] = x[-1].isspace() if x else not first
        self.known = n
        if made:
            where = np.array(parts, np.int64)
            ids, sizes = self._gather(where)
            self._put(base + np.array(made, np.int64), ids, np.add.reduceat(sizes, np.cumsum(counts) - counts))
            self.used[:n] += np.bincount(where, minlength=n).astype(np.int32)

    def _take_apart(self, fresh: list[str]) -> tuple[list[int], list[int], list[int], list[int], list[int]]:
        """Which pieces are letters, which neither they nor made of parts, and which are made; the numbers of parts, and how many each has.

        Made are letters with marks after them, once or by lines.  Each part is a split of its
        own, so its ids are those of letters after a space or of a text's first piece.  The
        parts get numbers too; there are far fewer of them.
        """
        letters: list[int] = []
        other: list[int] = []
        made: list[int] = []
        parts: list[int] = []
        counts: list[int] = []
        if self.model is None:
            return letters, [*range(len(fresh))], made, parts, counts
        memo, feed = self.memo, _FIRST + "\n"
        for i, x in enumerate(fresh):
            before = _FIRST if x.startswith(_FIRST) else ""
            x = x[len(_FIRST) :] if before else x
            if x.isalpha():
                (letters if x.isascii() or _LETTERS(x) else other).append(i)
            elif m := _MARKED(x):
                a, b = m.groups()
                parts += (memo[before + a], memo[_FIRST + b])
                made.append(i)
                counts.append(2)
            elif "\n" in x and all(lines := list(map(_MARKED, x.split("\n")))):
                at = len(parts)
                for m in lines:
                    a, b = m.groups()
                    parts += (memo[before + a], memo[_FIRST + b], memo[feed]) if b else (memo[before + a], memo[feed])
                    before = _FIRST
                parts.pop()  # no line feed after the last line
                made.append(i)
                counts.append(len(parts) - at)
            else:
                other.append(i)
        return letters, other, made, parts, counts

    def _gather(self, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces one after the other, and the number for each."""
        length = self.size[where].astype(np.int64)
        total = np.cumsum(length)
        at = np.repeat(self.begin[where] - (total - length), length) + np.arange(total[-1] if len(total) else 0)
        return self.flat[at], length

    def _encode_letters(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and the number for each, of pieces of letters: after a space, or as a text's first.

        The model's own merges give the same ids as the whole tokenizer, at a third of the time.
        """
        if not pieces:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        lines = "\n".join([x[len(_FIRST) :] if x.startswith(_FIRST) else " " + x for x in pieces])
        lines = _BYTES[np.frombuffer(lines.encode(), np.uint8)].tobytes().decode("utf-32-le").split(chr(_BYTES[10]))
        ids, sizes = [], []
        for i in range(0, len(lines), JOIN):
            found = list(map(self.model.tokenize, lines[i : i + JOIN]))
            sizes += map(len, found)
            ids.append(np.fromiter(map(attrgetter("id"), chain.from_iterable(found)), np.int32))
        return np.concatenate(ids), np.array(sizes, np.int64)

    def _encode_joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for each piece, after a space; pieces hold no white space but single line feeds.

        A line feed before a space is a split of its own, so many pieces go in one string,
        and come apart where the line feeds between them are.
        """
        found, sizes = [], []
        for i in range(0, len(pieces), JOIN):
            some = pieces[i : i + JOIN]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + "\n ".join(some)], add_special_tokens=False)[0].ids, np.int32)
            feeds = np.append(np.flatnonzero(ids == self.feed), len(ids))
            last = np.cumsum(np.fromiter((1 + x.count("\n") for x in some), np.int64, len(some))) - 1
            if len(feeds) != last[-1] + 1:  # the vocabulary splits in another way
                each = [e.ids for e in self.tokenizer.encode_batch_fast([" " + x for x in some], add_special_tokens=False)]
                found.append(np.fromiter(chain.from_iterable(each), np.int32))
                sizes.append(np.fromiter(map(len, each), np.int64, len(each)))
            else:
                ends = feeds[last]
                found.append(np.delete(ids, ends[:-1]))
                sizes.append(np.diff(ends, prepend=-1) - 1)
        return np.concatenate([np.zeros(0, np.int32), *found]), np.concatenate([np.zeros(0, np.int64), *sizes])

    def _last(self, n: int) -> list[str]:
        it = reversed(self.memo)
        return [next(it) for _ in range(n)][::-1]

    def _pieces(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of each text; None for a text that may not be cut before its spaces."""
        if self.known > MEMO:
            self._forget()
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        flat = lists.flatten()
        edges = lists.offsets.to_numpy().astype(np.int64)
        edges = edges - edges[0]
        coded = flat.dictionary_encode()
        kinds = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        # all pieces but a text's first had a space before them; a first one is told apart by a mark
        firsts = [_FIRST + x for x in flat.take(pa.array(edges[:-1])).to_pylist()]
        where = np.fromiter(map(self.memo.__getitem__, kinds), np.int64, len(kinds))[coded.indices.to_numpy()]
        where[edges[:-1]] = np.fromiter(map(self.memo.__getitem__, firsts), np.int64, len(firsts))
        self._learn()
        self.used[: self.known] += np.bincount(where, minlength=self.known).astype(np.int32)
        ids, length = self._gather(where)
        total = np.concatenate([[0], np.cumsum(length)])
        out: list[np.ndarray | None] = np.split(ids, total[edges[1:-1]])
        # a space with white space before it and white space, or the end, after it
        unsafe = self.ends[where[:-1]] & self.starts[where[1:]]
        unsafe[edges[1:-1] - 1] = False
        for i in np.unique(np.searchsorted(edges, np.flatnonzero(unsafe), "right") - 1):
            out[i] = None
        return out

    def encode(self, texts) -> list[np.ndarray]:
        """One int32 array of ids for each text; a null text has none."""
        collects = gc.isenabled()
        gc.disable()  # many small objects and no cycles: a collection would look through all of them and find nothing
        try:
            return self._between_added([t or "" for t in texts])
        finally:
            if collects:
                gc.enable()

    def _between_added(self, texts: list[str]) -> list[np.ndarray]:
        """encode() for texts that may hold added tokens."""
        held = [i for i, t in enumerate(texts) if any(x in t for x in self.added)]
        if not held:
            return self._encode(texts)
        # what lies between added tokens is encoded as a text of its own
        whole = {i for i in held if any(x in texts[i] for x in self.greedy)}
        cut = {i: self.split_added(texts[i]) for i in held if i not in whole}
        between = [x for parts in cut.values() for x in parts if x not in self.added]
        out = self._encode(["" if i in cut or i in whole else t for i, t in enumerate(texts)] + between)
        ids = iter(out[len(texts) :])
        for i in whole:
            out[i] = self._whole(texts[i])
        for i, parts in cut.items():
            out[i] = np.concatenate([np.array([self.added[x]], np.int32) if x in self.added else next(ids) for x in parts])
        return out[: len(texts)]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        """encode() for texts without added tokens."""
        short = list(texts)
        long = [i for i, t in enumerate(short) if len(t) > SLICE]
        cut = {i: self._slices(short[i]) for i in long}
        for i in long:
            short[i] = ""
        out = self._pieces(short) if short else []
        for i, slices in cut.items():
            out[i] = None if slices is None else np.concatenate([self._pieces([x])[0] for x in slices])
        for i, ids in enumerate(out):
            if ids is None:
                out[i] = self._whole(texts[i])
        return out

    @staticmethod
    def _slices(text: str) -> list[str] | None:
        """The text in slices that begin, after the first, with a space; None if it may not be cut before its spaces."""
        if _UNSAFE.search(text):
            return None
        out, at = [], 0
        while len(text) - at > SLICE:
            to = text.rfind(" ", at + 1, at + SLICE)
            to = text.find(" ", at + SLICE) if to < 0 else to
            if to < 0:
                break
            out.append(text[at:to])
            at = to
        return [*out, text[at:]]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker; the last vocabulary's stays."""
    return Encoder(path)


def forget() -> None:
    """Drop the worker's encoder: for operators that follow one that encoded."""
    encoder.cache_clear()

"""Token ids of whole Arrow text columns by a tokenizers file, each distinct stretch encoded once.

A tokenizer whose pre-tokenizer never joins what stands on both sides of certain breaks
gives the same ids for a text and for its stretches one by one. ``words`` breaks at ASCII
white space and drops it (tokenizers that drop white space); ``spaced`` breaks before a
single space between two characters that aren't white space (byte-level tokenizers whose
words begin with their space). Rows with white space beyond ASCII, and rows that hold the
text of an added token (which gets its id, as the library does it), are encoded whole.
Distinct stretches of a slice are found by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import os
import re

import numpy as np

from quernstone.llm import _bytes as B

_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_BLANK = B.SPACE.copy()
_BLANK[0x1C:0x20] = True

_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, breaks: str) -> Encoder:
    """One encoder for each worker process."""
    if (path, breaks) not in _encoders:
        _encoders[path, breaks] = Encoder(path, breaks)
    return _encoders[path, breaks]


class Encoder:
    """Stretches seen are held by hash: sorted hashes, and each one's place among all their ids."""

    #: Distinct stretches held at most; then the store starts anew. 36 bytes or so each.
    HELD = 1_500_000
    #: New ASCII stretches that are encoded as one text, where token boundaries show that this is the same.
    JOINED = 2000

    def __init__(self, path: str, breaks: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile(b"|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.breaks = breaks
        # Both kinds of vocabulary write one character for each byte of a token, and </w> for a word's end.
        self.token_bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.token_bytes[i] = len(token.removesuffix("</w>"))
        self.clear()

    def clear(self) -> None:
        self.hashes, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start = np.zeros(1 << 14, np.int64)

    def _lists(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each of ``texts``, one behind the other, and how many each has.

        Only ASCII texts are joined: normalisation changes no byte count there, so the tokens'
        lengths tell where each text ends. All others are encoded one by one.
        """
        joint = b" " if self.breaks == "words" else b""
        alone, groups, held = [], [], []
        for k, t in enumerate(texts):
            if self.added and self.added.search(t):
                alone.append(k)
            elif t.isascii() and (joint or (t[:1] == b" " and not _BLANK[t[-1]])):
                held.append(k)
                if len(held) == self.JOINED:
                    groups.append(held)
                    held = []
            else:
                alone.append(k)
        groups += [held] if held else []
        found: list[tuple[list[int], np.ndarray, np.ndarray]] = []
        encode = self.tokenizer.encode_batch_fast
        for group, e in zip(groups, encode([joint.join(texts[k] for k in g).decode() for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            ends = np.cumsum([len(texts[k]) for k in group])
            token_ends = np.cumsum(self.token_bytes[ids])
            cut = np.searchsorted(token_ends, ends, "right")
            if len(ids) and token_ends[-1] == ends[-1] and (cut > 0).all() and (token_ends[cut - 1] == ends).all():
                found.append((group, ids, np.diff(cut, prepend=0)))
            else:
                alone += group
        lists = [e.ids for e in encode([texts[k].decode() for k in alone], add_special_tokens=False)] if alone else []
        if alone:
            size = np.fromiter(map(len, lists), np.int64, len(lists))
            found.append((alone, np.fromiter((i for x in lists for i in x), np.uint32, size.sum()), size))
        order = np.concatenate([g for g, *_ in found])
        ids, size = np.concatenate([x[1] for x in found]), np.concatenate([x[2] for x in found])
        begin, back = np.cumsum(size) - size, np.argsort(order)
        size = size[back]
        return ids[np.arange(size.sum()) + np.repeat(begin[back] - (np.cumsum(size) - size), size)], size

    def _rows_with_added(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        places = np.array([m.start() for m in self.added.finditer(buf.tobytes())] if self.added else [], np.int64)
        return np.unique(np.searchsorted(offsets, places, "right") - 1)

    def stretches(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        whole = self._rows_with_added(buf, offsets)
        if self.breaks == "words":
            starts, ends, first = B.words(buf, offsets)
            if not len(whole):
                return starts, ends, first
            other = ~np.isin(np.searchsorted(offsets, starts, "right") - 1, whole)
            starts, ends = np.concatenate([starts[other], offsets[whole]]), np.concatenate([ends[other], offsets[whole + 1]])
            order = np.argsort(starts, kind="stable")
            return starts[order], ends[order], np.searchsorted(starts[order], offsets)
        blank = _BLANK[buf]
        cut = np.zeros(len(buf) + 1, bool)
        if len(buf) > 2:
            cut[1:-2] = (buf[1:-1] == 0x20) & ~blank[:-2] & ~blank[2:]
        for m in _WIDE_SPACE.finditer(buf.tobytes()):
            k = int(np.searchsorted(offsets, m.start(), "right")) - 1
            cut[offsets[k] : offsets[k + 1]] = False
        for k in whole.tolist():
            cut[offsets[k] : offsets[k + 1]] = False
        cut[offsets] = True
        cut[-1] = False
        # A space at a row's end or beginning stays with its row.
        starts = np.flatnonzero(cut[:-1])
        last = np.isin(starts + 1, offsets) & ~np.isin(starts, offsets)
        starts = starts[~last]
        first = np.searchsorted(starts, offsets)
        return starts, np.append(starts[1:], len(buf)), first

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, one behind the other, and the n+1 places where rows begin."""
        parts, sizes = [], []
        for i, j in B.slices(offsets, 3 << 20):
            at = offsets[i : j + 1] - offsets[i]
            ids, first = self._encode_slice(buf[offsets[i] : offsets[j]], at)
            parts.append(ids)
            sizes.append(np.diff(first))
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

    def _encode_slice(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, first = self.stretches(buf, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        hashes, one, inverse = np.unique(B.span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        if len(self.hashes) + len(hashes) > self.HELD:
            self.clear()
        place = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = place < len(self.hashes)
        known[inside] = self.hashes[place[inside]] == hashes[inside]
        slots = np.zeros(len(hashes), np.int64)
        slots[known] = self.slot[place[known]]
        new = np.flatnonzero(~known)
        if len(new):
            data = buf.tobytes()
            ids, size = self._lists([data[s:e] for s, e in zip(starts[one[new]].tolist(), ends[one[new]].tolist())])
            n = len(self.hashes)
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
            while n + len(new) + 1 > len(self.start):
                self.start = np.concatenate([self.start, np.zeros(len(self.start), np.int64)])
            self.ids[self.used : self.used + len(ids)] = ids
            self.start[n + 1 : n + 1 + len(new)] = self.used + np.cumsum(size)
            self.used += len(ids)
            slots[new] = np.arange(n, n + len(new))
            self.hashes = np.insert(self.hashes, place[new], hashes[new])
            self.slot = np.insert(self.slot, place[new], slots[new])
        slots = slots[inverse]
        size = self.start[slots + 1] - self.start[slots]
        to = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.arange(to[-1]) + np.repeat(self.start[slots] - to[:-1], size)]
        return ids, to[first]


def with_end(ids: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """``end_id`` behind each row's ids."""
    n = len(at) - 1
    after = at + np.arange(n + 1)
    out = np.full(after[-1], end_id, np.uint32)
    own = np.ones(after[-1], bool)
    own[after[1:] - 1] = False
    out[own] = ids
    return out, after

"""Token ids of whole texts, with a cache of chunks that is read and filled by array operations.

A byte-level BPE tokenizer never merges across a blank that stands between two
other characters: the blank begins the next chunk. So a text is cut before such
blanks, known chunks are looked up by a 128-bit hash, and only new chunks are
encoded. Nor does it merge a letter with a punctuation mark behind it, so a
mark begins a chunk as well. A text with other blanks (double ones, one at the
end, one before a line break) is encoded as it is.
"""

from __future__ import annotations

import os
import sys
import types
from collections.abc import Callable

import numpy as np

SLOTS = 1 << 19  # of the cache, for two chunks each
POOL = 1 << 22  # token ids that the cache holds at most
SEGMENT = 1 << 17  # bytes that are worked on at a time; every worker holds some 80 times as much besides its cache
_STEP = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
#: first bytes of white space other than the blank
_LETTER = np.isin(np.arange(256), [c for c in range(128) if chr(c).isalpha()])
#: ASCII punctuation but the apostrophe, which may begin a contraction
_MARK = np.isin(np.arange(256), [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"])
_MAYBE_SPACE = np.isin(np.arange(256), [*range(9, 14), *range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3])


def _powers(step: np.uint64, count: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(count - 1, step, np.uint64))))


def _inverse(step: np.uint64) -> np.uint64:
    return np.uint64(pow(int(step), -1, 1 << 64))


class CachedTokenizer:
    """Encodes lists of texts with the tokenizer file at ``path``; every id sequence equals the tokenizer's own."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        first = [(self.tokenizer.id_to_token(i) or "")[:1] for i in range(size)]
        self.whole = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]  # found in any text
        self.starts_chunk = np.array([c == "Ġ" for c in first])  # the sign for a blank byte
        self.up = [_powers(s, SEGMENT + 1) for s in _STEP]
        self.down = [_powers(_inverse(s), SEGMENT + 1) for s in _STEP]
        self._reset()

    def _reset(self) -> None:
        self.tags = np.zeros((2, 2, SLOTS), np.uint64)  # younger and older chunk, two hashes
        self.places = np.zeros((2, 2, SLOTS), np.int32)  # start in the pool, number of ids
        self.pool = np.zeros(POOL, np.uint32)
        self.filled = 0

    def encode(self, text: bytes) -> np.ndarray:
        """Ids of one text by the tokenizer itself."""
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32)

    def encode_all(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of every text."""
        out: list[list[np.ndarray] | None] = [[] for _ in texts]
        segments: list[tuple[int, bytes, bool]] = []  # text, its bytes, whether a blank stands before
        size = 0

        def flush() -> None:
            nonlocal size
            if segments:
                for (number, _, _), ids in zip(segments, self._encode_segments(segments)):
                    if ids is None:
                        out[number] = None
                    elif out[number] is not None:
                        out[number].append(ids)
            segments.clear()
            size = 0

        for number, text in enumerate(texts):
            start, led = 0, False
            while start < len(text):
                end = len(text)
                if end - start > SEGMENT // 2:
                    cut = text.find(b" ", start + SEGMENT // 2, start + SEGMENT - 2)
                    if cut < 0:
                        out[number] = None
                        break
                    end = cut
                if size + end - start + 1 > SEGMENT - 2:
                    flush()
                segments.append((number, text[start:end], led))
                size += end - start + 1
                if end < len(text) and end + 1 == len(text):
                    out[number] = None  # a blank at the end
                start, led = end + 1, True
        flush()
        none = np.zeros(0, np.uint32)
        return [
            self.encode(text) if ids is None else ids[0] if len(ids) == 1 else np.concatenate(ids) if ids else none
            for text, ids in zip(texts, out)
        ]

    def _encode_segments(self, segments: list[tuple[int, bytes, bool]]) -> list[np.ndarray | None]:
        joined = b" ".join(s for _, s, _ in segments)
        data = np.frombuffer(joined, np.uint8)
        blank = data == 32
        inner = np.zeros(len(data) + 1, bool)  # where a chunk begins without a blank
        inner[1:-1] = _LETTER[data[:-1]] & _MARK[data[1:]]
        for token in self.whole:
            at = joined.find(token)
            while at >= 0:
                inner[at + 1 : at + len(token)] = False
                at = joined.find(token, at + 1)
        begins = inner.copy()
        begins[0] = True
        begins[1:] |= blank
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:] - ~inner[starts[1:]], len(data))
        lengths = np.array([len(s) for _, s, _ in segments])
        first = np.searchsorted(starts, np.cumsum(lengths + 1) - lengths - 1)  # first chunk of each segment
        led = ~inner[starts]
        led[first] = [x for _, _, x in segments]

        empty = ends == starts
        doubtful = empty.copy()
        full = np.flatnonzero(~empty)
        maybe = full[_MAYBE_SPACE[data[starts[full]]] & led[full]]
        for at in maybe:
            doubtful[at] = joined[starts[at] : ends[at]].decode()[0].isspace()
        bad = np.logical_or.reduceat(doubtful, first)

        hashes = []
        wide = data.astype(np.uint64) + np.uint64(1)
        for up, down in zip(self.up, self.down):
            sums = np.add.reduceat(wide * up[: len(wide)], np.minimum(starts, len(wide) - 1)) * down[starts]
            sums = (sums ^ (sums >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + led
            hashes.append(sums ^ (sums >> np.uint64(32)))
        one, two = hashes
        slots = (one & np.uint64(SLOTS - 1)).astype(np.int64)
        younger, older = ((self.tags[way][0][slots] == one) & (self.tags[way][1][slots] == two) for way in (0, 1))
        known = younger | older
        at, count = (np.where(younger, self.places[0][i][slots], self.places[1][i][slots]).astype(np.int64) for i in (0, 1))
        new = np.flatnonzero(~known & ~doubtful)
        if len(new):
            _, index, inverse = np.unique(one[new], return_index=True, return_inverse=True)
            chosen = new[index]
            if self.filled + sum(lengths) + len(starts) > POOL:
                self._reset()
                return self._encode_segments(segments)
            at[new], count[new] = (x[inverse] for x in self._learn(joined, starts, ends, led, chosen))
            # the older one of a slot makes room; of several new ones in a slot the last stays
            some = np.unique(slots[new])
            self.tags[1][:, some], self.places[1][:, some] = self.tags[0][:, some], self.places[0][:, some]
            self.tags[0][0][slots[new]], self.tags[0][1][slots[new]] = one[new], two[new]
            self.places[0][0][slots[new]], self.places[0][1][slots[new]] = at[new], count[new]
        count[doubtful] = 0
        total = np.cumsum(count)
        ids = self.pool[np.repeat(at - total + count, count) + np.arange(total[-1])]
        bounds = np.concatenate((total[first] - count[first], [total[-1]]))
        return [None if b else ids[i:j] for b, i, j in zip(bad, bounds, bounds[1:])]

    def _learn(self, joined: bytes, starts, ends, led, chosen) -> tuple[np.ndarray, np.ndarray]:
        """Encode the chosen chunks into the pool: their places and numbers of ids."""
        at, count = np.zeros(len(chosen), np.int64), np.zeros(len(chosen), np.int64)
        mine = led[chosen]
        chunks = [joined[i:j].decode() for i, j in zip(starts[chosen], ends[chosen])]
        inner = np.flatnonzero(mine)
        for part in range(0, len(inner), 4096):
            some = inner[part : part + 4096]
            text = " " + " ".join(chunks[i] for i in some)
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            begin = np.flatnonzero(self.starts_chunk[ids])
            if len(begin) != len(some):
                raise ValueError("the tokenizer does not keep blanks at the start of a token")
            at[some] = self.filled + begin
            count[some] = np.diff(np.append(begin, len(ids)))
            self._append(ids)
        alone = np.flatnonzero(~mine)
        for i, coded in zip(alone, self.tokenizer.encode_batch([chunks[i] for i in alone], add_special_tokens=False)):
            at[i], count[i] = self.filled, len(coded.ids)
            self._append(np.array(coded.ids, np.uint32))
        return at, count

    def _append(self, ids: np.ndarray) -> None:
        self.pool[self.filled : self.filled + len(ids)] = ids
        self.filled += len(ids)


def in_worker(key: str, make: Callable):
    """One value per Python worker process, for all tasks that it runs."""
    holder = sys.modules.setdefault("_litscreen_worker", types.ModuleType("_litscreen_worker"))
    if key not in vars(holder):
        setattr(holder, key, make())
    return vars(holder)[key]

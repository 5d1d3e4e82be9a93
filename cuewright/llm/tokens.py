"""Token ids of whole texts with a memory of words, for the packing operator (runs inside tasks)."""
from __future__ import annotations

import numpy as np

from .shingles import _powers, mix

GAP = np.zeros(256, bool)
GAP[[9, 10, 11, 12, 13, 32]] = True
STOP = "\x01"  # stands alone between two words, and is then one token of its own
LONGEST = 64   # bytes of a word that is known by its hash; longer ones are known by themselves
TOGETHER = 50  # new words encoded as one text
LETTER, MARK = np.zeros(256, bool), np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
MARK[[ord(c) for c in ".,;:!?"]] = True


class WordMemory:
    """Ids by a tokenizer that drops white space and never joins two words.

    A text's ids are then its words' ids one after the other, so each word is encoded once and
    remembered: its ids lie in one long array, and a slice of texts is a gather from it. Where the
    tokenizer reads A-Z as a-z, so does the memory; where it parts a letter from the mark after it, marks
    are words of their own; both are tried out at the start. Words are told apart by a 64-bit hash of
    their bytes. Past ``limit`` words no more are remembered, and new ones are encoded for their slice alone.
    """

    def __init__(self, path: str, limit: int = 1_000_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        self.place: dict[int | bytes, int] = {}  # hash, or bytes of a long word: its number
        self.pool, self.used = np.zeros(1 << 16, "<u4"), 0
        self.start, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.stop = self._ids(STOP)
        assert len(self.stop) == 1
        same = lambda a, *b: self._ids(a).tolist() == [i for x in b for i in self._ids(x).tolist()]
        letters = "abcdefghijklmnopqrstuvwxyz"
        self.folds = all(same(w.upper(), w) for w in (letters, letters[::-1], *letters, "it's"))
        self.parts = all(same(f"{x}{m}{y}", x, m + y) for x in (*letters, "it's", "word") for m in ".,;:!?" for y in ("", "a", ".", "'s", "é"))

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _remember(self, keys: list, words: list[bytes]) -> None:
        """Number new words and lay down their ids; they are encoded in groups, with a stop after each."""
        names = [w.decode("utf-8", "surrogatepass") for w in words]
        odd = [k for k, w in enumerate(names) if STOP in w]
        for k in odd:
            self._lay([keys[k]], self._ids(names[k]), np.array([len(self._ids(names[k]))]))
        plain = [k for k in range(len(names)) if STOP not in names[k]] if odd else range(len(names))
        for at in range(0, len(plain), 20_000):
            part = plain[at:at + 20_000]
            groups = ["".join(f"{names[k]} {STOP} " for k in part[i:i + TOGETHER]) for i in range(0, len(part), TOGETHER)]
            ids = np.concatenate([np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(groups, add_special_tokens=False)])
            ends = np.flatnonzero(ids == self.stop[0])
            assert len(ends) == len(part)
            self._lay([keys[k] for k in part], ids[ids != self.stop[0]], np.diff(np.r_[-1, ends]) - 1)

    def _lay(self, keys: list, ids: np.ndarray, counts: np.ndarray) -> None:
        k, n = len(self.place), len(keys)
        self.place.update(zip(keys, range(k, k + n), strict=True))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while k + n > len(self.start):
            self.start, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count))
        self.pool[self.used:self.used + len(ids)] = ids
        self.start[k:k + n], self.count[k:k + n] = self.used + np.cumsum(counts) - counts, counts
        self.used += len(ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        body = b"\n".join(raw) + b"\n"
        data = np.frombuffer(body, np.uint8)
        gap = GAP[data]
        opens = ~gap & np.r_[True, gap[:-1]]
        if self.parts:
            opens[1:] |= LETTER[data[:-1]] & MARK[data[1:]]
        begin = np.flatnonzero(opens)
        end = np.minimum(np.flatnonzero(gap)[np.searchsorted(np.flatnonzero(gap), begin)], np.r_[begin[1:], len(data)]) if len(begin) else begin
        if self.folds:
            data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
            body = data.tobytes()
        up, down = _powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=sums[1:])
        hashes = mix((sums[end] - sums[begin]) * down[begin])
        kinds, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        keys = kinds.tolist()
        spell = lambda i: body[begin[i]:end[i]]
        before = len(self.place), self.used
        unknown = [j for j, key in enumerate(keys) if key not in self.place]
        self._remember([keys[j] for j in unknown], [spell(i) for i in first[unknown].tolist()])
        number = np.array([self.place[key] for key in keys], np.int64)[inverse]
        wide = np.flatnonzero(end - begin > LONGEST).tolist()
        new = list({w for w in map(spell, wide) if w not in self.place})
        self._remember(new, new)
        number[wide] = [self.place[spell(i)] for i in wide]
        many = self.count[number]
        ends = np.cumsum(many)
        ids = self.pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[number] - (ends - many), many)]
        while len(self.place) > max(self.limit, before[0]):
            self.place.popitem()  # the newest ones
            self.used = before[1] if len(self.place) == before[0] else int(self.start[len(self.place)])
        cuts = np.searchsorted(begin, np.cumsum([len(r) + 1 for r in raw]))  # words before each text's end
        stops = np.r_[0, ends][cuts]
        return [ids[a:b].tobytes() for a, b in zip(np.r_[0, stops[:-1]], stops, strict=True)]


_MEMORY: dict[str, WordMemory] = {}


def memory(path: str) -> WordMemory:
    """One memory per worker process and tokenizer file."""
    if path not in _MEMORY:
        _MEMORY[path] = WordMemory(path)
    return _MEMORY[path]

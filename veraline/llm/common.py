"""What several operators of this folder share."""

from __future__ import annotations

import ctypes
import re
import zlib
from array import array
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa

from veraline.plans.store import small_batches, tidy  # noqa: F401  the operators here take them from this module

WORD = re.compile(r"\w+")
_RUN_OF_SPACE = re.compile(r"\s \s")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary lies; operators take any other path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def one_blas_thread() -> None:
    """Let numpy's own BLAS use one thread in this process: the driver's matrices are small, and threads contend with the JVM's."""
    for path in Path(np.__file__).parent.parent.glob("numpy.libs/*openblas*"):
        library = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)


class Recent(dict):
    """What `make` gives for a key, remembered for the keys met of late: two generations of `room` keys each."""

    def __init__(self, make, room: int = 150_000):
        super().__init__()
        self.make, self.room, self.older = make, room, {}

    LONGEST = 64

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= self.LONGEST:
            if len(self) >= self.room:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


# How a byte-level vocabulary splits a text, over an alphabet whose characters all versions of Unicode class alike.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
PLAIN = re.compile(rf"[\t\n\r -~{LETTERS}\u00d7\u00f7\u2010-\u2027\u2030-\u205e\u20ac]*")
_SPLIT = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")


def byte_letters() -> list[str]:
    """The printable character that a byte-level vocabulary writes for each byte: itself, or the next one free from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = [], 256
    for b in range(256):
        out.append(chr(b if b in own else free))
        free += b not in own
    return out


class Encoder:
    """tokenizers.Tokenizer.encode(text, add_special_tokens=False), remembered by piece.

    A byte-level vocabulary splits a text into words, numbers, marks and white space, and
    a text's ids are those of its pieces in a row.  A text of plain characters is split
    here, and the library's model is asked for each piece that isn't remembered.  Such a
    vocabulary also splits before a space that stands alone, so of a text with other
    characters the stretches between such spaces are encoded one by one, by the whole
    tokenizer where they aren't plain.  A text that names an added token, a text with
    other characters in which a space lies inside a longer run of white space, and all
    texts of a tokenizer of another kind go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        self.added = [t.content for t in added]
        self.by_piece = _is_byte_level(self.tokenizer) and not any(t.lstrip or t.rstrip or t.normalized or t.single_word for t in added)
        self.shown, self.model = dict(enumerate(byte_letters())), self.tokenizer.model
        self.pieces, self.stretches = Recent(self._piece, 100_000), Recent(self._stretch, 50_000)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def ids_of(self, piece: bytes) -> list[int]:
        """The model's ids of one piece of UTF-8."""
        return [t.id for t in self.model.tokenize(piece.decode("latin-1").translate(self.shown))]

    def _piece(self, piece: str) -> bytes:
        return array("I", self.ids_of(piece.encode())).tobytes()

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, _SPLIT.findall(text)))

    def _stretch(self, text: str) -> bytes:
        return self._plain(text) if PLAIN.fullmatch(text) else self._whole(text)

    def encode(self, text: str | None, end: int) -> np.ndarray:
        """Ids of a text (null: none) and the end id."""
        if not text:
            found = b""
        elif not self.by_piece or any(t in text for t in self.added):
            found = self._whole(text)
        elif PLAIN.fullmatch(text):
            found = self._plain(text)
        elif _RUN_OF_SPACE.search(text):
            found = self._whole(text)
        else:
            first, *rest = text.split(" ")
            found = b"".join([self._stretch(first), *(self.stretches[" " + x] for x in rest)])
        return np.frombuffer(found + end.to_bytes(4, "little"), dtype="<u4")


#: Bytes that are split at once, the longest piece that is remembered, slots of the memory (a power of two), and its ids at most: some 25 MB of a worker.
_AT_ONCE, _LONGEST, _SLOTS, _REMEMBERED = 1 << 17, 64, 20, 2_000_000
_SPACE, _LETTER, _DIGIT, _MARK, _OTHER = range(5)


def _byte_classes() -> np.ndarray:
    """What a byte of UTF-8 is to the split; C3 and what follows it are the letters U+00C0 to U+00FF."""
    out = np.full(256, _OTHER, np.uint8)
    out[33:127] = _MARK
    out[[9, 10, 13, 32]] = _SPACE
    out[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = _LETTER
    out[48:58] = _DIGIT
    return out


class BatchEncoder:
    """Encoder for a column of texts, by whole arrays.

    Texts of ASCII and of the letters U+00C0 to U+00FF are split by comparing each byte's
    class with its neighbours'.  A piece is known by a 64-bit hash; ids of pieces met of
    late lie in a table by hash, and the library's model is asked for the others.
    """

    def __init__(self, path: str):
        self.one = Encoder(path)
        rng = np.random.default_rng(77)
        self.classes = _byte_classes()
        self.values = rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
        base = int(rng.integers(2**62, 2**63)) | 1
        self.powers, self.inverses = (self._powers(x) for x in (base, pow(base, -1, 2**64)))
        self.keys, self.met = np.zeros(1 << _SLOTS, np.uint64), np.zeros(1 << _SLOTS, bool)
        self.at, self.n = (np.zeros(1 << _SLOTS, np.int32) for _ in range(2))
        self.ids, self.used = np.zeros(_REMEMBERED + _AT_ONCE, np.uint32), 0

    @staticmethod
    def _powers(base: int) -> np.ndarray:
        out = np.full(_AT_ONCE + 1, np.uint64(base))
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in a row, ids of each text), each text's end id included; a null text is an empty one."""
        return self._all(texts, lambda data, offsets: self._group(data, offsets, end))

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Ids of each text, without an end id."""
        return self._all(texts, self._group_sizes)[1]

    def _all(self, texts: pa.Array, of) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8) if len(texts) else np.zeros(0, np.uint8)
        found, sizes, a = [], [], 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + _AT_ONCE, side="right")) - 1)
            ids, n = of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            found.append(ids)
            sizes.append(n)
            a = b
        return (np.concatenate(found), np.concatenate(sizes)) if found else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _group(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        odd = self._odd(data, offsets)
        if not odd.any():
            return self._with_end(*self._split(data, offsets), end)
        texts = [data[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        plain = [t for t, o in zip(texts, odd, strict=True) if not o]
        ids, sizes = self._with_end(*self._split(np.concatenate(plain), np.cumsum([0, *map(len, plain)])), end) if plain else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        rest, out = iter(np.split(ids, np.cumsum(sizes)[:-1])), []
        for t, o in zip(texts, odd, strict=True):
            out.append(self.one.encode(t.tobytes().decode(), end) if o else next(rest))
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)

    def _group_sizes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        odd = self._odd(data, offsets)
        if odd.any():
            ids, sizes = self._group(data, offsets, 0)
            return ids[:0], sizes - 1
        return self._split(data, offsets, wanted=False)

    def _odd(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts the split by bytes isn't for."""
        odd = np.zeros(len(offsets) - 1, bool)
        if not self.one.by_piece or len(data) > _AT_ONCE:
            return ~odd
        places = [np.flatnonzero(self.classes[data] == _OTHER)]
        signs = np.flatnonzero((data == 0x97) | (data == 0xB7))  # multiplication and division sign
        places.append(signs[data[signs - 1] == 0xC3])
        whole = data.tobytes()
        for token in self.one.added:
            k = whole.find(token.encode())
            while k >= 0:
                places.append(np.array([k]))
                k = whole.find(token.encode(), k + 1)
        odd[np.searchsorted(offsets, np.concatenate(places), side="right") - 1] = True
        return odd

    def _with_end(self, ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        sizes = sizes + 1
        out = np.empty(int(sizes.sum()), np.uint32)
        is_end = np.zeros(len(out), bool)
        is_end[np.cumsum(sizes) - 1] = True
        out[is_end], out[~is_end] = end, ids
        return out, sizes

    def _starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces begin."""
        n = len(data)
        kind = np.full(n + 4, _SPACE, np.uint8)
        kind[:n] = self.classes[data]
        first = np.ones(n + 4, bool)  # of a text
        first[:n] = False
        first[offsets[:-1]] = True
        begins = first.copy()
        begins[1:n] |= kind[1:n] != kind[: n - 1]
        # white space before something else gives its last character up: a space to the piece that follows, another one to a piece of its own
        after = np.flatnonzero(begins[:n] & ~first[:n] & (kind[:n] != _SPACE))
        after = after[kind[after - 1] == _SPACE]
        begins[after - 1] = True
        begins[after] = data[after - 1] != 32
        # endings like 's: an apostrophe where a piece begins takes them, and what follows is a new piece
        mark = np.flatnonzero((data == 39) & begins[:n])
        mark = mark[~first[mark + 1] & (kind[mark + 1] == _LETTER)]
        if len(mark):
            padded = np.concatenate([data, np.zeros(4, np.uint8)])
            one, two = padded[mark + 1], np.where(first[mark + 2], 0, padded[mark + 2])
            taken = np.where(np.isin(one, list(b"stmd")), 1, np.where(((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")), 2, 0))
            mark, taken = mark[taken > 0], taken[taken > 0]
            begins[mark + 1] = False
            rest = mark + 1 + taken
            begins[rest[~first[rest] & (kind[rest] == _LETTER)]] = True
        return np.flatnonzero(begins[:n])

    def _split(self, data: np.ndarray, offsets: np.ndarray, wanted: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, if wanted, else none; ids of each text)."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        start = self._starts(data, offsets)
        stop = np.append(start[1:], len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[: len(data)], out=sums[1:])
        key = (sums[stop] - sums[start]) * self.inverses[start] + (stop - start).astype(np.uint64)
        key = (key ^ (key >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
        slot = (key >> np.uint64(64 - _SLOTS)).astype(np.int64)
        at, n = self.at[slot], self.n[slot]
        known = self.keys[slot] == key
        self.met[slot[known]] = True
        new = np.flatnonzero(~known | (stop - start > _LONGEST))
        if len(new):
            at, n = at.astype(np.int64), n.astype(np.int64)
            own, where, which = np.unique(key[new], return_index=True, return_inverse=True)
            whole, made, ends = data.tobytes(), array("I"), []
            long = stop[new] - start[new] > _LONGEST
            if long.any():  # each for itself: the hash of a long piece could be another one's
                where, which = np.arange(len(new)), np.arange(len(new))
                own = key[new]
            for k in new[where].tolist():
                made.extend(self.one.ids_of(whole[start[k] : stop[k]]))
                ends.append(len(made))
            ends = np.array(ends, np.int64)
            begin = self._kept(np.frombuffer(made, np.uint32)) + np.concatenate([[0], ends[:-1]])
            size = np.diff(ends, prepend=0)
            at[new], n[new] = begin[which], size[which]
            # a piece that has been met again keeps its slot once
            to = (own >> np.uint64(64 - _SLOTS)).astype(np.int64)
            free = ~long[where] & ~self.met[to]
            self.met[to] = False
            to = to[free]
            self.keys[to], self.at[to], self.n[to] = own[free], begin[free], size[free]
        before = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        ids = self.ids[np.repeat(at - before[:-1], n) + np.arange(before[-1])] if wanted else self.ids[:0]
        pieces = np.searchsorted(start, offsets)
        sizes = np.diff(before[pieces])
        if self.used > _REMEMBERED:
            self._forget()
        return ids, sizes

    def _forget(self) -> None:
        """Keep the pieces that were met again, if they're less than half of what may be kept."""
        kept = np.flatnonzero(self.met & (self.keys > 0))
        n = self.n[kept].astype(np.int64)
        if n.sum() > _REMEMBERED // 2:
            kept, n = kept[:0], n[:0]
        before = np.cumsum(n) - n
        ids = self.ids[np.repeat(self.at[kept] - before, n) + np.arange(n.sum())]
        keys = self.keys[kept]
        self.keys[:] = 0
        self.met[:] = False
        self.keys[kept], self.at[kept], self.used = keys, before, len(ids)
        self.ids[: len(ids)] = ids

    def _kept(self, made: np.ndarray) -> int:
        """Where the ids begin that are put beside those kept."""
        begin, self.used = self.used, self.used + len(made)
        if self.used > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(self.used - len(self.ids), len(self.ids)), np.uint32)])
        self.ids[begin : self.used] = made
        return begin


def _is_byte_level(tokenizer) -> bool:
    """Whether a tokenizer is that of a plain byte-level vocabulary."""
    split, model = tokenizer.pre_tokenizer, tokenizer.model
    plain = type(split).__name__ == "ByteLevel" and not split.add_prefix_space and split.use_regex
    merges = type(model).__name__ == "BPE" and not any(getattr(model, k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix"))
    return bool(plain and merges) and not any((tokenizer.normalizer, tokenizer.truncation, tokenizer.padding))


@lru_cache(maxsize=1)
def encoder(path: str) -> BatchEncoder:
    """The worker's encoder: what one task has met, the next one remembers."""
    return BatchEncoder(path)


def crc_of_ids(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())

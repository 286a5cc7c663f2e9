"""Encoding and decoding whole texts with content-defined chunk reuse.

A rolling hash of the last WINDOW bytes cuts texts into chunks, so a passage that many
texts share is cut at the same places in each, wherever it stands.  A chunk is known by its
bytes; a worker encodes it once and remembers its ids.  Cuts fall anywhere, within
words too, so each join is repaired: a window around it, from white space to white space, is encoded anew, and
its ids take the place of what both sides had there once they agree with both sides' at
its margins; until they do, the window grows, in the end to all of both sides.

Chunks that hold no white space are joined to the next before they are encoded, so a window
is short unless a word is long.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veraline.llm.common import LETTERS, PLAIN, Recent, byte_letters, small_batches, tidy, tokenizer_path

#: Bytes that the hash rolls over, mean distance of its cuts (a power of two), bytes of a chunk at least, and at most unless no white space or character ends there.
WINDOW, MEAN, SHORTEST, LONGEST = 32, 512, 64, 1 << 14
#: Bytes that are hashed at once, and bytes of chunks and ids that a worker remembers.
_AT_ONCE, _REMEMBERED = 1 << 20, 24 << 20
_FACTOR = 0x9E3779B1
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


@lru_cache(maxsize=1)
def _values() -> np.ndarray:
    return np.random.default_rng(13).integers(0, 2**32, 256, dtype=np.uint32)


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """At each byte, the hash of the WINDOW bytes that end there (at the first ones: of what there is)."""
    h, reach, power = _values()[data], 1, _FACTOR
    while reach < WINDOW:  # of so many bytes, then of twice as many
        longer = h.copy()
        longer[reach:] += h[:-reach] * np.uint32(power)
        h, reach, power = longer, 2 * reach, power * power % 2**32
    return h


def cut_places(data: np.ndarray) -> np.ndarray:
    """Places before which the hash asks for a cut, ascending."""
    found, shift = [], np.uint32(32 - (MEAN.bit_length() - 1))
    for a in range(0, len(data), _AT_ONCE):
        b = max(0, a - WINDOW)
        h = rolling_hash(data[b : a + _AT_ONCE])[a - b :]
        found.append(np.flatnonzero(h >> shift == 0) + a + 1)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def cuts_of(text: bytes, places: list[int], flat: bytes) -> list[int]:
    """Where the chunks of a text begin and end: at places of the hash, at the start of a character, SHORTEST apart, with white space in each chunk."""
    out, n = [0], len(text)
    for place in [*places, n]:
        last = out[-1]
        while place - last > LONGEST:  # no place in a long stretch
            last += LONGEST
            while last < n and text[last] & 0xC0 == 0x80:
                last += 1
            if last < n and flat.find(b" ", out[-1], last) >= 0:
                out.append(last)
        while place < n and text[place] & 0xC0 == 0x80:
            place += 1
        if n > place >= out[-1] + max(SHORTEST, WINDOW) and flat.find(b" ", out[-1], place) >= 0:
            out.append(place)
    return [*out, n]


class _Chunks:
    """What `make` gives for a chunk, remembered for the chunks met of late: two generations of _REMEMBERED bytes each."""

    def __init__(self, make):
        self.make, self.young, self.old, self.held = make, {}, {}, 0
        self.asked = self.made = 0

    def __call__(self, chunk: bytes) -> bytes:
        self.asked += 1
        found = self.young.get(chunk)
        if found is None:
            found = self.old.get(chunk)
            if found is None:
                self.made += 1
                found = self.make(chunk)
            if self.held > _REMEMBERED:
                self.old, self.young, self.held = self.young, {}, 0
            self.young[chunk] = found
            self.held += len(chunk) + len(found) + 150
        return found


def falls_apart_at_space(tokenizer) -> bool:
    """Whether a text's ids are those of its words between ASCII white space.

    So where the normalizer only composes, folds white space and lowers characters, and
    pieces are found by a pattern that no white space is part of.
    """
    own = json.loads(tokenizer.to_str())
    steps = own["normalizer"] or {"type": "Sequence", "normalizers": []}
    steps = steps["normalizers"] if steps["type"] == "Sequence" else [steps]
    folds = lambda s: s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " "
    if not all(s["type"] in ("NFC", "Lowercase") or folds(s) for s in steps):
        return False
    split = own["pre_tokenizer"] or {}
    split = (split.get("pretokenizers") or [split])[0]
    if split.get("type") != "Split" or split["behavior"] != "Removed" or not split["invert"] or "Regex" not in split["pattern"]:
        return False
    rest = re.sub(r"\[\^\\s[^\]]*\]|\\p\{[LN]\}", "", split["pattern"]["Regex"])
    plain = not re.search(r"\\|\.|\s|\[\^", rest)
    return plain and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"]) for t in own["added_tokens"])


def pieces_of(tokenizer) -> re.Pattern | None:
    """The tokenizer's own pattern for texts of plain characters, if the library's model takes the bytes of what it finds."""
    own = json.loads(tokenizer.to_str())
    steps = (own["pre_tokenizer"] or {}).get("pretokenizers", [])
    if not falls_apart_at_space(tokenizer) or [s["type"] for s in steps] != ["Split", "ByteLevel"] or steps[1]["add_prefix_space"] or steps[1]["use_regex"]:
        return None
    if own["model"]["type"] != "BPE" or any(own["model"].get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix")):
        return None
    return re.compile(steps[0]["pattern"]["Regex"].replace(r"\p{L}", LETTERS).replace(r"\p{N}", "0-9"))


class ChunkEncoder:
    """encode() gives what tokenizers.Tokenizer.encode(text, add_special_tokens=False) gives, truncation and padding unused; decode() its decode(ids, skip_special_tokens=False).

    Where the tokenizer falls apart at white space, a new chunk's ids are those of its
    words: of a plain word, the ids that the library's model gives its pieces, of others
    those that the library gives the word, both remembered.  A chunk of any other
    tokenizer is encoded by the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words, self.pieces = Recent(self._library, 50_000), Recent(self._piece, 200_000)
        self.ids_of = self._by_word if falls_apart_at_space(self.tokenizer) else self._library
        self.pattern, self.model, self.letters = pieces_of(self.tokenizer), self.tokenizer.model, dict(enumerate(byte_letters()))
        self.lowers = "Lowercase" in str(self.tokenizer.normalizer)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.chunks = _Chunks(self.ids_of)
        self.shown = None
        if self.tokenizer.decoder is None:  # then tokens are joined by spaces
            self.shown = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}

    def _library(self, text: bytes) -> bytes:
        return array("I", self.tokenizer.encode(text.decode(), add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text.lower() if self.lowers else text)))

    def _is_plain(self, text: str) -> bool:
        return self.pattern is not None and PLAIN.fullmatch(text) is not None and not any(t in text for t in self.added)

    def _by_word(self, text: bytes) -> bytes:
        whole = text.decode()
        if self._is_plain(whole):
            return self._plain(whole)
        return b"".join([self._plain(w) if self._is_plain(w) else self.words[b] for b, w in ((b, b.decode()) for b in text.split())])

    def _repaired(self, text: bytes, flat: bytes, done: bytearray, at: int, end: int, right: bytes) -> None:
        """Append to done, the ids of text[:at], those of text[at:end], given the ids of that chunk alone."""
        left, stop = flat.rfind(b" ", 0, at), flat.find(b" ", at, end)
        left, stop, reach = max(left, 0), stop if stop >= 0 else end, 1
        while True:
            begin, close = left, stop
            for _ in range(reach):
                begin = max(flat.rfind(b" ", 0, begin), 0)
                more = flat.find(b" ", close + 1, end)
                close = more if more >= 0 else end
            before, after = self.ids_of(text[begin:at]), self.ids_of(text[at:close])
            window = self.ids_of(text[begin:close])
            agrees = begin == 0 or (done.endswith(before) and window.startswith(self.ids_of(text[begin:left])))
            agrees = agrees and (close == end or (right.startswith(after) and window.endswith(self.ids_of(text[stop:close]))))
            if agrees:
                del done[0 if begin == 0 else len(done) - len(before) :]
                done += window
                if close < end:
                    done += right[len(after) :]
                return
            left, stop, reach = begin, close, 2 * reach

    def encode(self, text: bytes, places: list[int]) -> bytes:
        """Ids, four bytes each, of a text of UTF-8 cut at some of the places."""
        flat = text.translate(_SPACES)
        cuts = cuts_of(text, places, flat)
        done = bytearray(self.chunks(text[: cuts[1]]))
        for at, end in zip(cuts[1:-1], cuts[2:], strict=True):
            self._repaired(text, flat, done, at, end, self.chunks(text[at:end]))
        return bytes(done)

    def decode(self, ids: np.ndarray) -> str:
        if self.shown is None:
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        return " ".join(map(self.shown.__getitem__, ids.tolist()))


@lru_cache(maxsize=1)
def chunk_encoder(path: str) -> ChunkEncoder:
    """The worker's encoder: what one task has met, the next one remembers."""
    return ChunkEncoder(path)


def _coded(path: str):
    def run(batches):
        own = chunk_encoder(path)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).fill_null(b"").to_pylist()
            ends = np.cumsum([0, *map(len, texts)])
            places = cut_places(np.frombuffer(b"".join(texts), np.uint8))
            bounds = np.searchsorted(places, ends, side="right")
            found = [own.encode(t, (places[a:b] - begin).tolist()) for t, a, b, begin in zip(texts, bounds[:-1], bounds[1:], ends[:-1], strict=True)]
            ids = [np.frombuffer(x, np.uint32) for x in found]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]).astype(np.int32)), pa.array(np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array([own.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return run


def encode_and_decode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row per row: doc_id, ids of the whole text (null: none), and the text that they decode to.

    Repeated and null doc_ids are rows like others; other columns are left out.  A worker
    holds one batch of texts at a time, and bounded memories of chunks and words.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(_coded(tokenizer or tokenizer_path("word_bpe_49k.json"))), "doc_id long, ids array<int>, decoded string")


def digests(rows: DataFrame) -> DataFrame:
    """The rows of encode_and_decode() with digests in place of ids and texts."""
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

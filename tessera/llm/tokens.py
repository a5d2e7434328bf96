"""Token ids of whole texts by a tokenizer file of the tokenizers library.

White space always ends a token of these tokenizers, and so do the borders of
most runs of letters, digits and marks, so a text's ids are those of its runs.
Runs repeat, so each is encoded once per worker and slice: new ones go to the
library together, joined by spaces, and are told apart by the tokens that end
a pre-token.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from tessera.llm.textnum import text_bytes

CACHE_WORDS = 300_000
SPACE = regex.compile(r"\s")
#: ASCII marks that the pre-tokenizers split from letters; an apostrophe may belong to those after it ('s).
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Classes of bytes: letters and the first bytes of letters, digits, marks.  Others may be parts of any character.
OTHER, BLANK, LETTER, DIGIT, MARK, APOSTROPHE, LEAD = range(7)


def _classes() -> bytes:
    out = bytearray(256)
    for kind, members in (
        (BLANK, b" \t\n\v\f\r"),
        (LETTER, bytes([*range(0x41, 0x5B), *range(0x61, 0x7B)])),
        (DIGIT, b"0123456789"),
        (MARK, MARKS.encode()),
        (APOSTROPHE, b"'"),
        (LEAD, bytes([*range(0xC3, 0xCA), 0xD0, 0xD1])),  # U+00C0 to U+027F and U+0400 to U+047F
    ):
        for x in members:
            out[x] = kind
    return bytes(out)


def _starts() -> bytes:
    """Whether a word starts at a byte, by the class before it times 8 and its own."""
    out = bytearray(256)
    for a in range(LEAD):
        for b in range(LEAD):
            parts = a == BLANK or DIGIT in (a, b) or (a == LETTER and b in (MARK, APOSTROPHE)) or (a == MARK and b == LETTER)
            out[a * 8 + b] = b != BLANK and parts
    return bytes(out)


CLASSES, STARTS = _classes(), _starts()
#: How a byte-level BPE spells bytes: printable ones stand for themselves, others for code points from 256; spaces part pre-tokens here.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
SPELT = "".join(" " if b == 0x20 else chr(b) if b in _SHOWN else chr(256 + _HIDDEN.index(b)) for b in range(256))


def parted(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all rows, cut where a pre-token must end, and the rows' offsets in them."""
    raw, at = text_bytes(column)
    kinds = np.frombuffer(bytearray(raw).translate(CLASSES), np.uint8)
    lead = np.flatnonzero(kinds == LEAD)
    two = raw[lead].astype(np.int32) << 8 | raw[lead + 1]
    # all are letters but the two signs, and the letter that a mark comes out of in lower case
    letter = np.where((two == 0xC397) | (two == 0xC3B7) | (two == 0xC4B0), OTHER, LETTER)
    kinds[lead] = kinds[lead + 1] = letter
    pairs = kinds.copy()
    pairs[1:] |= kinds[:-1] << 3
    first = at[:-1][at[:-1] < at[1:]]
    pairs[first] = kinds[first] | BLANK << 3
    start = np.frombuffer(pairs.tobytes().translate(STARTS), bool)
    shown = kinds != BLANK
    data, begin = [raw[:0]], [start[:0]]
    for i in range(0, len(raw), 1 << 18):  # by indices, which are quicker than a mask, but few at a time
        some = np.flatnonzero(shown[i : i + (1 << 18)]) + i
        data.append(raw.take(some))
        begin.append(start.take(some))
    data, begin = np.concatenate(data), np.flatnonzero(np.concatenate(begin))
    ends = np.append(begin, len(data)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(begin), pa.py_buffer(ends), pa.py_buffer(data))
    return words, np.searchsorted(np.flatnonzero(start), at)


class WordEncoder:
    """Encodes columns of text with a word-end BPE that drops white space."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        # the same model for pre-tokens that are normalised, split and spelt in the byte alphabet already
        bare = {**spec, "normalizer": None, "added_tokens": [], "pre_tokenizer": None}
        self.bare = Tokenizer.from_str(json.dumps(bare))
        suffix = spec["model"].get("end_of_word_suffix")
        splits = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        if not suffix or len(splits) != 1:
            raise ValueError(f"{path}: not a BPE with word ends")
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for word, i in vocab.items() if word.endswith(suffix)]] = True
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.pattern = regex.compile(splits[0])
        # all known words' ids in a row, and where each word's begin
        self.ids, self.at = np.zeros(0, "<u4"), np.zeros(2, np.int64)
        # the places there of words of late, and of those known before them, which go when the former are too many
        self.cache: dict[str, int] = {"": 0}
        self.old: dict[str, int] = {}
        self.cache_words = cache_words

    def _pieces(self, word: str) -> list[str] | None:
        """Pre-tokens of a word; None where the library must find them."""
        plain = word.isascii()
        if plain and word.isalpha():
            return [word.lower()]
        if (not word.isalpha() and SPACE.search(word)) or self._has_special(word):
            return None
        if not plain:
            word = unicodedata.normalize("NFC", word)
        # letter by letter where the end of a word would count
        word = word.lower() if "Σ" not in word else "".join(map(str.lower, word))
        return [word] if word.isalpha() else self.pattern.findall(word)

    def _has_special(self, word: str) -> bool:
        for s in self.special:
            if s in word:
                return True
        return False

    def _recalled(self, words: list[str]) -> tuple[list[int | None], list[int]]:
        """Places of words, None for new ones, and which are new; those known before are taken over."""
        cache, old, new = self.cache, self.old, []
        places = list(map(cache.get, words))
        for i in [i for i, p in enumerate(places) if p is None]:
            known = old.get(words[i])
            if known is None:
                new.append(i)
            else:
                cache[words[i]] = places[i] = known
        return places, new

    def _retire(self) -> None:
        """Let go of the words that were not met of late."""
        kept = np.fromiter(self.cache.values(), np.int64, len(self.cache))
        laid = self._store().take(pa.array(kept))
        self.at = np.frombuffer(laid.buffers()[1], np.int64)[: len(kept) + 1] >> 2
        self.ids = np.frombuffer(laid.buffers()[2], "<u4", int(self.at[-1]))
        self.old, self.cache = dict(zip(self.cache, range(len(kept)), strict=True)), {"": 0}

    def _store(self) -> pa.Array:
        """All known words' ids as an Arrow column without copies."""
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.at) - 1, [None, pa.py_buffer(self.at << 2), pa.py_buffer(self.ids)])

    def _learn(self, words: list[str]) -> None:
        """Add new words to the cache."""
        plain, alpha, odd = [], [], []
        for w in words:
            (odd if not w.isalpha() else plain if w.isascii() else alpha).append(w)
        learnt: list[tuple[list[str], np.ndarray, np.ndarray]] = []
        for i in range(0, len(plain), 4096):
            part = plain[i : i + 4096]
            learnt.append(self._together(part, " ".join(part).lower().split(" "), np.ones(len(part), np.int64)))
        for i in range(0, len(alpha), 4096):
            part = alpha[i : i + 4096]
            text = unicodedata.normalize("NFC", " ".join(part))
            lower = text.lower().split(" ")
            if "Σ" in text or len(lower) != len(part) or not all(map(str.isalpha, lower)):
                odd += part
            else:
                learnt.append(self._together(part, self._spelt(lower), np.ones(len(part), np.int64)))
        counts, split, cut = [], [], []
        for w in odd:
            pieces = self._pieces(w)
            if pieces is None:
                learnt.append(self._alone([w]))
            else:
                cut.append(w)
                counts.append(len(pieces))
                split.append(" ".join(pieces))
        for i in range(0, len(cut), 4096):
            learnt.append(self._together(cut[i : i + 4096], self._spelt(split[i : i + 4096]), np.array(counts[i : i + 4096])))
        place = len(self.at) - 1
        for part, _, _ in learnt:
            self.cache.update(zip(part, range(place, place + len(part)), strict=True))
            place += len(part)
        self.ids = np.concatenate([self.ids, *(ids for _, ids, _ in learnt)])
        self.at = np.append(self.at, self.at[-1] + np.cumsum(np.concatenate([n for _, _, n in learnt])))

    @staticmethod
    def _spelt(pieces: list[str]) -> list[str]:
        return " ".join(pieces).encode().decode("latin-1").translate(SPELT).split(" ")

    def _together(self, words: list[str], pieces: list[str], n: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The ids, and their number, of words of ``n`` pre-tokens each; a pre-token ends with the id of a word's end."""
        ids = np.array(self.bare.encode_batch_fast([pieces], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
        stops = np.append(0, np.flatnonzero(self.ends[ids]) + 1)
        if len(stops) - 1 != n.sum() or stops[-1] != len(ids):
            return self._alone(words)
        return words, ids, np.diff(stops[np.append(0, np.cumsum(n))])

    def _alone(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        each = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
        return words, np.array([x for ids in each for x in ids], "<u4"), np.array([len(ids) for ids in each])

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by ``end_id``, and the rows' offsets in them."""
        if pc.any(pc.match_substring(column, "<|")).as_py():  # maybe a special token, whose case counts
            lists = pc.ascii_split_whitespace(column)
            words, at = lists.flatten(), np.asarray(lists.offsets, np.int64)
            at = at - at[0]
        else:
            words, at = parted(pc.ascii_lower(column))
        coded = words.dictionary_encode()
        vocab = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        places, new = self._recalled(vocab)
        if len(self.cache) + len(new) > self.cache_words:
            self._retire()
            places, new = self._recalled(vocab)
        if new:
            self._learn([vocab[i] for i in new])
            for i in new:
                places[i] = self.cache[vocab[i]]
        end = pa.array([np.array([end_id], "<u4").tobytes()], pa.large_binary())
        got = pa.concat_arrays([self._store().take(pa.array(places, pa.int64())), end])
        # the words of all rows, each row closed by the end id as a word of its own
        index = np.full(int(at[-1]) + len(column), len(vocab), np.int32)
        inner = np.ones(len(index), bool)
        row_end = at[1:] + np.arange(len(column))
        inner[row_end] = False
        index[inner] = np.asarray(coded.indices)
        laid = got.take(pa.array(index))
        before = np.frombuffer(laid.buffers()[1], np.int64)[: len(index) + 1] >> 2
        ids = np.frombuffer(laid.buffers()[2], "<u4", int(before[-1])) if len(index) else np.zeros(0, "<u4")
        return ids, np.append(0, before[row_end + 1])


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for a worker's lifetime, so that words stay known between tasks."""
    return WordEncoder(path)

"""Fast, exact encoding with the ``tokenizers`` library, plus its two users that count tokens.

Pre-tokenisers never let a token cross certain white-space boundaries, so a
text can be cut there, every distinct word encoded once by the library, and
the ids joined. Texts with white space for which a cut is not provably
neutral go to the library whole, and so does every text of a tokenizer whose
pre-tokeniser is not one of the two known kinds.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import strings

#: White space of either regex engine other than space and line feed.
_ODD_SPACE = re.compile("[" + re.escape("".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")) + "]")
_ODD_CLASS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n") + "]"
#: Bytes of text that are split and joined at a time, and words in each of a cache's two generations; both are less for lean encoders.
_SLICE, _CACHED_WORDS = 1 << 22, 250_000
_LEAN_SLICE, _LEAN_WORDS = 1 << 21, 180_000
#: How byte-level pre-tokenisers write a space.
_SPACE_SIGN = "\u0120"
#: The longest word that is kept, so a cache is bounded in bytes too.
_LONGEST = 64
#: ASCII signs that end a run of Latin letters in every known pre-tokeniser.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class _Words(dict):
    """Word to the bytes of its ids; asks the library only for new stems.

    When a generation is full it becomes the old one, from which words still
    in use come back, so memory is bounded and frequent words stay.
    """

    def __init__(self, encode, model=None, code="H", prefix="", folds_case=False, most=_CACHED_WORDS):
        super().__init__()
        self.encode, self.model, self.code, self.prefix, self.folds_case, self.most, self.old, self.signs = encode, model, code, prefix, folds_case, most, {}, {}

    def __missing__(self, word):
        ids = self.old.get(word)
        if ids is None:
            stem = word.rstrip(_SIGNS)
            if len(stem) != len(word) and stem.isalpha() and max(stem) < "\u0130":
                ids = self[stem] + self._signs(word[len(stem) :])
            elif self.folds_case and word.isascii() and (lower := word.lower()) != word:
                ids = self[lower]
            else:
                plain = self.model is not None and word.isascii() and word.isalpha()
                ids = self._letters(word) if plain else self.encode(self.prefix + word)
        if len(word) <= _LONGEST:
            self[word] = ids
        return ids

    def _letters(self, word):
        """A word of ASCII letters is one pre-token as it stands, so the library's model takes it directly."""
        text = word.lower() if self.folds_case else _SPACE_SIGN + word if self.prefix else word
        return array(self.code, [token.id for token in self.model.tokenize(text)]).tobytes()

    def _signs(self, run):
        ids = self.signs.get(run)
        if ids is None:
            ids = self.encode(run)
            if len(self.signs) > 10_000:
                self.signs.clear()
            if len(run) <= _LONGEST:
                self.signs[run] = ids
        return ids

    def turn(self):
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


class _Sizes(_Words):
    """Word to the number of its ids: smaller than the ids, and no array is made for a new stem."""

    def _letters(self, word):
        return len(self.model.tokenize(word.lower() if self.folds_case else _SPACE_SIGN + word if self.prefix else word))


class Encoder:
    """Encodes whole texts to the little-endian bytes of their ids.

    The ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``;
    ``dtype`` is the narrowest unsigned type that holds the vocabulary. A
    ``lean`` encoder takes less memory and more time, for jobs whose workers
    also hold other operators' memory; ids are the same.
    """

    def __init__(self, path: str, lean: bool = False):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self._tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._kind = _kind(path)
        self._code = "H" if self.dtype.itemsize == 2 else "I"
        model = None if self._kind == "other" else self._tokenizer.model
        self._lean = lean
        self._slice_bytes, most = (_LEAN_SLICE, _LEAN_WORDS) if lean else (_SLICE, _CACHED_WORDS)
        folds = self._kind == "spaceless"
        self._bare, self._led = (_Words(self.whole, model, self._code, *x, most=most) for x in (("", folds), (" ",)))
        self._sizes = [_Sizes(self._length, model, self._code, *x, most=most) for x in (("", folds), (" ",))]
        self._line, self._counting = self.whole("\n"), False

    def whole(self, text: str) -> bytes:
        """Encoded by the library in one piece."""
        return array(self._code, self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _length(self, text: str) -> int:
        return len(self._tokenizer.encode(text, add_special_tokens=False).ids)

    def _turn_to(self, counting: bool) -> None:
        """Words of the other use, ids or counts, are forgotten, so a worker holds one kind of cache at a time."""
        if counting != self._counting:
            for words in (self._bare, self._led, *self._sizes):
                words.clear()
                words.old = {}
            self._counting = counting

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        self._turn_to(False)
        self._bare.turn()
        self._led.turn()
        if self._kind == "spaceless":  # spaces only separate, so words stand alone
            return b"".join(map(self._bare.__getitem__, text.replace("\n", " ").split(" ")))
        if self._kind == "space_led" and not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or _ODD_SPACE.search(text)):
            out, bare, led = [], self._bare, self._led.__getitem__
            for line in text.split("\n"):
                first, *rest = line.split(" ")
                out.append(bare[first])
                out.extend(map(led, rest))
                out.append(self._line)
            out.pop()
            return b"".join(out)
        return self.whole(text)


    def encode_column(self, column: pa.Array, end: int | None = None, counts_only: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of a column of texts and the offsets of each text in them, in slices of rows; null is empty.

        ``end`` is appended to every text. Words are split and numbered by
        Arrow, so Python only sees each distinct word of a slice. With
        ``counts_only`` the ids are left out.
        """
        self._turn_to(counts_only)
        column = column.cast(pa.large_string()).fill_null("")
        ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(column):
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + self._slice_bytes, "right")))
            yield self._slice(column.slice(at, stop - at), end, counts_only)
            at = stop
        if self._lean:  # pages given back are cleared anew when they are taken again
            pa.default_memory_pool().release_unused()

    def _slice(self, texts: pa.Array, end: int | None, counts_only: bool) -> tuple[np.ndarray, np.ndarray]:
        try:
            plain = self._plain(texts)
        except pa.ArrowInvalid:  # not UTF-8
            plain = np.zeros(len(texts), bool)
        if plain.all():
            return self._joined(texts, end, counts_only)
        fast, offsets = self._joined(texts.filter(pa.array(plain)), end, counts_only)
        if counts_only:
            sizes = np.zeros(len(texts), np.int64)
            sizes[plain] = np.diff(offsets)
            sizes[~plain] = [self._length(text) + (end is not None) for text in strings(texts.filter(pa.array(~plain)))]
            return fast, np.concatenate(([0], np.cumsum(sizes)))
        nth, parts, tail = 0, [], b"" if end is None else np.array([end], self.dtype).tobytes()
        for text, is_plain in zip(strings(texts), plain):
            parts.append(fast[offsets[nth] : offsets[nth + 1]] if is_plain else np.frombuffer(self.whole(text) + tail, self.dtype))
            nth += bool(is_plain)
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])

    def _plain(self, texts: pa.Array) -> np.ndarray:
        """Which texts may be cut at single spaces and line feeds."""
        if self._kind != "space_led":
            return np.full(len(texts), self._kind == "spaceless")
        odd = pc.match_substring_regex(texts, _ODD_CLASS)
        for pair in ("  ", "\n\n", " \n", "\n "):
            odd = pc.or_(odd, pc.match_substring(texts, pair))
        return ~odd.to_numpy(zero_copy_only=False)

    def _joined(self, texts: pa.Array, end: int | None, counts_only: bool) -> tuple[np.ndarray, np.ndarray]:
        bare, led = self._sizes if counts_only else (self._bare, self._led)
        bare.turn()
        led.turn()
        # marks that no plain text holds: of the end, and of a text's first word, which has no space before it
        if self._kind == "spaceless":
            marked, last = pc.replace_substring(texts, "\n", " "), "\n"
        else:
            marked, last = pc.binary_join_element_wise(_text("\r"), pc.replace_substring(texts, "\n", " \n"), _text("")), "\r\r"
        if end is not None:
            marked = pc.binary_join_element_wise(marked, _text(last), _text(" "))
        words = pc.split_pattern(marked, " ")
        coded = words.flatten().dictionary_encode()
        tail, line = b"" if end is None else np.array([end], self.dtype).tobytes(), self._line
        if counts_only:
            tail, line = len(tail) // self.dtype.itemsize, len(line) // self.dtype.itemsize
        known = [tail if w == last else self._word(w, bare, led, line) for w in coded.dictionary.to_pylist()]
        sizes = np.array(known, np.int64) if counts_only else np.fromiter(map(len, known), np.int64, len(known)) // self.dtype.itemsize
        index = coded.indices.to_numpy()
        ends = np.concatenate(([0], np.cumsum(sizes[index])))
        offsets = words.offsets.to_numpy()
        offsets = ends[offsets - offsets[0]]
        if counts_only:
            return np.zeros(0, self.dtype), offsets
        starts = np.cumsum(sizes) - sizes
        take = np.repeat((starts[index] - ends[:-1]).astype(np.int32), sizes[index]) + np.arange(ends[-1], dtype=np.int32)  # of one slice
        return np.frombuffer(b"".join(known), self.dtype)[take], offsets

    def _word(self, word: str, bare: _Words, led: _Words, line: bytes | int) -> bytes | int:
        if self._kind == "spaceless":
            return bare[word]
        if word[:1] == "\n":
            return line + bare[word[1:]]
        return bare[word[1:]] if word[:1] == "\r" else led[word]


def _text(value: str) -> pa.Scalar:
    return pa.scalar(value, pa.large_string())


@lru_cache(maxsize=4)
def encoder(path: str, lean: bool = False) -> Encoder:
    """The worker's own encoder for a tokenizer file."""
    return Encoder(path, lean)


def _kind(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    if any(x.get("lstrip") or x.get("rstrip") or x.get("normalized") or re.search(r"\s", x["content"]) or x["content"].isalpha() for x in parts["added_tokens"]):
        return "other"
    pre, normal = parts["pre_tokenizer"] or {}, parts["normalizer"]
    steps = pre.get("pretokenizers", [])
    if pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and normal is None:
        return "space_led"
    names = [x["type"] for x in (normal or {}).get("normalizers", [])]
    if [x["type"] for x in steps] == ["Split", "ByteLevel"] and names == ["NFC", "Replace", "Lowercase"]:
        split, level = steps
        if split["behavior"] == "Removed" and split["invert"] and r"[^\s\p{L}\p{N}]" in split["pattern"]["Regex"] and not level["use_regex"] and not level["add_prefix_space"]:
            return "spaceless"
    return "other"


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)

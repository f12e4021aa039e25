"""Byte-level BPE ids by the tokenizers library, with tables of distinct chunks so that a repeated word is encoded once.

A space that stands before a character other than white space always starts a new pre-token, so a text may be cut there
and each chunk encoded by itself. A chunk not seen before is cut into pre-tokens, and the library's model encodes each
distinct one. Texts that hold a special token's string go to the library whole.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable, Iterable
from functools import lru_cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ID = attrgetter("id")
#: A space before white space (every kind that any of the libraries knows) or at the end.
_LOOSE = r" (?:[\s\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\z)"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in shown else next(others)) for b in range(256)]


class Memory:
    """Two generations of a table: what is looked up stays, what is not goes when the newer one is full."""

    def __init__(self, limit: int):
        self.limit, self.new, self.old = limit, {}, {}

    def one(self, key: str, make: Callable[[str], bytes]) -> bytes:
        value = self.new.get(key)
        if value is None:
            value = self.new[key] = self.old.get(key) or make(key)
        return value

    def turn(self) -> None:
        if len(self.new) > self.limit:
            self.new, self.old = {}, self.new

    def all(self, keys: list[str], make: Callable[[list[str]], Iterable[bytes]]) -> list[bytes]:
        """The values of keys; `make` gives those that are in neither generation."""
        self.turn()
        values = list(map(self.new.get, keys))
        lost = [k for k, v in enumerate(values) if v is None]
        if lost:
            older = list(map(self.old.get, (keys[k] for k in lost)))
            unknown = [keys[k] for k, v in zip(lost, older, strict=True) if v is None]
            made = iter(make(unknown))
            for k, v in zip(lost, older, strict=True):
                values[k] = self.new[keys[k]] = next(made) if v is None else v
        return values


class ChunkEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids. About `limit` chunks of each kind are remembered."""

    def __init__(self, path: str, limit: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.letters = dict(enumerate(_byte_letters()))
        self.pretokens = regex.compile(public_tokenizers.PATTERN).findall
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.chunks, self.words = Memory(limit), Memory(limit)

    def forget(self) -> None:
        """Give the tables back; the next call starts new ones."""
        self.chunks, self.words = Memory(self.chunks.limit), Memory(self.words.limit)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of one pre-token."""
        shown = word.replace(" ", "Ġ") if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
        return array("I", map(_ID, self.model.tokenize(shown))).tobytes()

    def _text(self, text: str) -> bytes:
        return b"".join([self.words.one(w, self._word) for w in self.pretokens(text)])

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk with a space in front. A word of letters, with a comma or full stop or without, needs no pattern."""
        if chunk.isalpha():
            return self._word(" " + chunk)
        if chunk[-1:] in (",", ".") and chunk[:-1].isalpha():
            return self.words.one(" " + chunk[:-1], self._word) + self.words.one(chunk[-1], self._word)
        return self._text(" " + chunk)

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; no text may be null.

        The chunks of all texts together become indices into a table of the distinct ones; each of these is encoded once,
        and its ids are laid out again at every position.
        """
        texts = texts.cast(pa.large_string())
        loose = pc.match_substring_regex(texts, _LOOSE)
        for s in self.special:
            loose = pc.or_(loose, pc.match_substring(texts, s))
        loose = loose.to_numpy(zero_copy_only=False)
        out: list[np.ndarray | None] = [None] * len(texts)
        for k in np.flatnonzero(loose).tolist():
            text = texts[k].as_py()
            ids = self.whole(text) if any(s in text for s in self.special) else self._text(text)
            out[k] = np.frombuffer(ids, dtype="<u4")
        tight = np.flatnonzero(~loose)
        if len(tight) == 0:
            return out
        lists = pc.split_pattern(texts.take(pa.array(tight)), " ")
        first = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False).copy()  # 32-bit numbers, as all the places below: a call has far fewer ids
        heads = pc.list_element(lists, 0).to_pylist()
        distinct = self.chunks.all(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), lambda new: map(self._chunk, new))
        starts = list(map(self._text, heads))
        self.words.turn()
        coded_all = distinct + starts
        table = np.frombuffer(b"".join(coded_all), dtype="<u4")
        sizes = np.fromiter(map(len, coded_all), dtype=np.int32, count=len(coded_all)) // 4
        at = np.cumsum(sizes, dtype=np.int32) - sizes
        index[first] = len(distinct) + np.arange(len(starts))
        n = sizes[index]
        ends = np.cumsum(n, dtype=np.int32)
        places = np.repeat(at[index] - (ends - n), n)
        places += np.arange(len(places), dtype=np.int32)
        ids = table[places]
        bounds = np.append(ends - n, ends[-1])[np.append(first, len(index))]
        for j, k in enumerate(tight.tolist()):
            out[k] = ids[bounds[j] : bounds[j + 1]]
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)

"""Token ids of whole texts by the tokenizers library, with the ids of parts kept per worker.

A text is cut only where the tokenizer itself always cuts (white space), so that the ids of the parts in a row are those of the
text. Parts seen before are looked up; the table is bounded and parts beyond it are encoded each time."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Folder of the vocabulary files; None: where the installed package keeps them.
VOCABULARIES: str | None = None

#: What the tokenizers' patterns take for white space (str.split() has four control characters more).
_W = "\t-\r \x85\xa0  -     　"
_PARTS = re.compile(f" ?[^{_W}]+|[{_W}]+(?![^{_W}])|[{_W}]+")
_CONTROL = re.compile("[\x1c-\x1f]")
#: Letters whose lower case and bytes are the same for every library.
_LETTERS = re.compile("[a-zA-ZÀ-ÖØ-öø-ÿ]+")

#: Parts that a worker keeps, and the longest of them.
MOST_PARTS = 500_000
LONGEST_PART = 48

#: Bytes of text that are encoded together: text by text, and word by word, where more text has fewer words that are new.
SLICE, WORDS_SLICE = 4 << 20, 12 << 20

_made: dict[str, Encoder] = {}


def slices(batch: pa.RecordBatch, most: int = SLICE, column: str = "_t") -> Iterator[pa.RecordBatch]:
    """Rows of ``most`` bytes of text together, or one row with more."""
    sizes = np.cumsum(pc.binary_length(batch[column]).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        done = int(sizes[begin - 1]) if begin else 0
        stop = max(begin + 1, int(np.searchsorted(sizes, done + most, side="right")))
        yield batch.slice(begin, stop - begin)
        begin = stop


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself where it can be seen, else the next from 256 on."""
    seen = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173}
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class _Known(dict):
    """Ids of parts; those that aren't known are asked for, and kept as long as there is room."""

    def __init__(self, ask: Callable[[str], bytes]):
        super().__init__()
        self.ask = ask

    def __missing__(self, part: str) -> bytes:
        ids = self.ask(part)
        if len(self) < MOST_PARTS and len(part) <= LONGEST_PART:
            self[part] = ids
        return ids


class Encoder:
    """encode() returns the ids of each text as little-endian unsigned 32-bit integers."""

    def __init__(self, name: str, folder: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(f"{folder}/{name}" if folder else public_tokenizers.path(name))
        self.tokenizer.encode_special_tokens = True
        self.drops_spaces = name.startswith("word_")
        self.model, self.characters = self.tokenizer.model, _byte_characters()
        self.known = _Known(self._ids)
        self.tails = {t: self._plain(t) for t in ".,"}

    def _plain(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _parts(self, text: str) -> list[str]:
        if self.drops_spaces:
            return [text] if _CONTROL.search(text) else text.split()
        return _PARTS.findall(text)

    def _letters(self, core: str) -> bool:
        """Whether ``core`` is letters, perhaps after a space, that are one piece to the tokenizer."""
        word = core if self.drops_spaces else core.removeprefix(" ")
        return word.isalpha() and (word.isascii() or _LETTERS.fullmatch(word) is not None)

    def _ids(self, part: str) -> bytes:
        """Ids of a part that isn't known. The model can be asked at once for letters; a full stop or comma after a letter is a piece of
        its own for both tokenizers."""
        core, tail = (part[:-1], part[-1]) if part[-1] in ".," else (part, "")
        if not self._letters(core):
            return self._plain(part)
        if self.drops_spaces:
            core = core.lower()
        if core != part:
            return self.known[core] + self.tails[tail] if tail else self.known[core]
        piece = core.encode().decode("latin-1").translate(self.characters)
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        ids = self.known.__getitem__
        return [b"".join(map(ids, self._parts(t))) for t in texts]


    def encode_all(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by ``end``, and the place after each text's last. Words are told apart by Arrow, so that
        each is looked up once a batch."""
        if not self.drops_spaces or pc.any(pc.match_substring_regex(texts, _CONTROL.pattern)).as_py():
            found = self.encode(texts.to_pylist())
            stop = np.array([end], dtype="<u4").tobytes()
            ends = np.cumsum([len(x) // 4 + 1 for x in found], dtype=np.int64)
            return np.frombuffer(b"".join([x + stop for x in found]), dtype="<u4"), ends
        words = pc.utf8_split_whitespace(texts)
        flat = words.flatten().dictionary_encode()
        codes = flat.indices.to_numpy(zero_copy_only=False)
        ids = [self.known[w] if w else b"" for w in flat.dictionary.to_pylist()]  # white space at an end leaves an empty word
        sizes = np.array([len(x) // 4 for x in ids], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        ids = np.frombuffer(b"".join(ids), dtype="<u4")
        many = sizes[codes]
        after = np.concatenate([[0], np.cumsum(many)])  # ids before each word
        first = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        ends = after[first[1:]]
        own = np.repeat(starts[codes] - after[:-1], many) + np.arange(int(after[-1]))
        out = np.insert(ids[own], ends, end) if len(ends) else ids[own]
        return out, ends + np.arange(1, len(ends) + 1)


def encoder(name: str, folder: str | None = VOCABULARIES) -> Encoder:
    """The worker's own, made once."""
    key = f"{folder}/{name}"
    if key not in _made:
        _made[key] = Encoder(name, folder)
    return _made[key]

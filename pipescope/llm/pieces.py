"""Token ids of whole texts with the `tokenizers` library, encoding every distinct piece of text once.

Byte-level BPE cuts a text into pre-tokens before it merges anything, and no pre-token goes on from a
character that is not white space into a space. A text may therefore be cut before a space that follows such
a character and stands before another, and the pieces can be encoded on their own: their ids in a row are the
ids of the text. Words recur, so a worker keeps the ids of the pieces it has met, up to a fixed number.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pipescope.llm.common import worker_cache

RUN = re.compile(r"\s\s")
CUT = re.compile(r"(?<=\S)(?= \S)")
MAX_PIECES = 2_000_000
MAX_CHARS = 48_000_000
JOINED = 256  # pieces encoded as one text


class _Numbers(dict):
    """Numbers new pieces in the order in which they are met."""

    def __init__(self, owner: PieceEncoder, prefix: str):
        self.owner, self.prefix = owner, prefix

    def __missing__(self, piece: str) -> int:
        number = self[piece] = self.owner.add(self.prefix + piece)
        return number


class PieceEncoder:
    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        # in a byte-level vocabulary every character stands for a byte; special tokens are written as they are
        names = self.tokenizer.get_vocab()
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.id_bytes = np.zeros(max(names.values(), default=0) + 1, np.int64)
        for name, number in names.items():
            self.id_bytes[number] = len(name.encode()) if name in special else len(name)
        self.clear()

    def clear(self) -> None:
        self.spaced, self.bare = _Numbers(self, " "), _Numbers(self, "")
        self.new: list[str] = []
        self.known = self.chars = 0
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def add(self, piece: str) -> int:
        self.new.append(piece)
        self.chars += len(piece)
        return self.known + len(self.new) - 1

    def numbers(self, text: str) -> list[int]:
        """The numbers of the text's pieces in order. `settle` before using them."""
        if RUN.search(text) is None:
            rest = text.split(" ")
            head = rest.pop(0)
            found = list(map(self.spaced.__getitem__, rest))
            if head:
                found.insert(0, self.bare[head])
            return found
        return list(map(self.bare.__getitem__, CUT.split(text)))

    def settle(self) -> None:
        """Encode the pieces met since the last call."""
        for at in range(0, len(self.new), 20_000):
            part = self.new[at:at + 20_000]
            flat, sizes = self._encoded(part)
            self.pool = _room(self.pool, self.used + len(flat))
            self.pool[self.used:self.used + len(flat)] = flat
            last = self.known + len(part)
            self.starts, self.sizes = _room(self.starts, last), _room(self.sizes, last)
            self.starts[self.known:last] = self.used + np.cumsum(sizes) - sizes
            self.sizes[self.known:last] = sizes
            self.known, self.used = last, self.used + len(flat)
        self.new = []

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, and how many each has.

        Pieces that begin with a space and a word may be cut wherever they meet, so they are encoded as longer
        texts, which saves the library's work per text; the bytes of the ids tell where a piece ends. Where they
        do not add up to the pieces (a tokenizer that changes its text), each piece is encoded on its own.
        """
        joined = [i for i, p in enumerate(pieces) if len(p) > 1 and p[0] == " " and not p[1].isspace()]
        sizes = np.zeros(len(pieces), np.int64)
        ids = self._ids(["".join([pieces[i] for i in joined[at:at + JOINED]]) for at in range(0, len(joined), JOINED)])
        lengths = np.fromiter((len(pieces[i].encode("utf-8", "surrogatepass")) for i in joined), np.int64, len(joined))
        ends, upto = np.cumsum(lengths), np.cumsum(self.id_bytes[ids])
        last = np.searchsorted(upto, ends) + 1
        if len(joined) and (last[-1] > len(upto) or (upto[last - 1] != ends).any()):
            joined, ids = [], ids[:0]
        else:
            sizes[joined] = np.diff(last, prepend=0)
        alone = np.ones(len(pieces), bool)
        alone[joined] = False
        others = np.flatnonzero(alone)
        lists = [x.ids for x in self.tokenizer.encode_batch_fast([pieces[i] for i in others.tolist()], add_special_tokens=False)]
        sizes[others] = list(map(len, lists))
        flat = np.empty(int(sizes.sum()), np.uint32)
        of_joined = np.repeat(~alone, sizes)
        flat[of_joined] = ids
        flat[~of_joined] = list(chain.from_iterable(lists))
        return flat, sizes

    def _ids(self, texts: list[str]) -> np.ndarray:
        lists = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(lists), np.uint32, sum(map(len, lists)))

    def trim(self) -> None:
        """Forget everything once the cache is full; numbers given out before are then void."""
        if self.known > MAX_PIECES or self.chars > MAX_CHARS:
            self.clear()

    def ids(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and how many each text has."""
        self.trim()
        listed = [self.numbers(t) for t in texts]
        self.settle()
        counts = np.fromiter(map(len, listed), np.int64, len(listed))
        numbers = np.fromiter(chain.from_iterable(listed), np.int64, int(counts.sum()))
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        places = np.repeat(self.starts[numbers] - (ends - sizes), sizes) + np.arange(total)
        upto = np.concatenate([[0], ends])[np.cumsum(counts)] if len(counts) else np.zeros(0, np.int64)
        return self.pool[places], np.diff(upto, prepend=0)

    def token_counts(self, texts: Sequence[str]) -> list[np.ndarray]:
        """How many ids each piece of each text has."""
        self.trim()
        listed = [self.numbers(t) for t in texts]
        self.settle()
        return [self.sizes[x] if x else self.sizes[:0] for x in listed]


def _room(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    out = np.zeros(max(size, 2 * len(array)), array.dtype)
    out[:len(array)] = array
    return out


def worker_encoder(tokenizer_json: str) -> PieceEncoder:
    """The encoder of this Python worker, kept between tasks."""
    cache = worker_cache("encoders")
    key = hash(tokenizer_json)
    if key not in cache:
        cache.clear()
        cache[key] = PieceEncoder(tokenizer_json)
    return cache[key]


def tokenizer_text(path: str) -> str:
    """The tokenizer file, read once on the driver; tasks get its content (a few MB) with the job."""
    with open(path, encoding="utf-8") as stream:
        return stream.read()


def text_parts(column: pa.Array, most: int = 2_000_000) -> Iterator[tuple[slice, list[str]]]:
    """A column of texts in parts of at most about `most` bytes, at least one text each; null texts are empty."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start = held = 0
    for i, size in enumerate([*sizes, most + 1]):
        if i > start and (held + size > most or i == len(sizes)):
            yield slice(start, i), [t or "" for t in column.slice(start, i - start).to_pylist()]
            start, held = i, 0
        held += size

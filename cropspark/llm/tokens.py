"""Token ids of whole texts with a public tokenizer file, the same as one call for each text, but each distinct piece is encoded once.

A byte-level BPE first cuts a text at words; a single space between two characters that are no white space always begins a new cut.
Cutting there beforehand therefore changes nothing, and the pieces repeat so often that most of the work falls away.

The file's added tokens come before that: where a text holds one it gives the token's own id, and what stands between them is cut by
itself. Each place of one is therefore a piece.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cropspark.llm.common import AT_START

#: Pieces a worker remembers between steps; further ones are encoded again in each step that has them. Beyond so many bytes it starts anew.
REMEMBERED, REMEMBERED_BYTES = 600_000, 32 << 20
#: Bytes of text that one step encodes: a larger step looks up fewer pieces twice.
TOKEN_STEP = 8 << 20
_ENCODERS: dict[tuple, "Encoder"] = {}


#: A task that encodes nothing begins without what earlier ones have remembered.
AT_START.append(_ENCODERS.clear)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str, end_id: int | None = 2) -> "Encoder":
    """The worker's own encoder for this file, kept from task to task."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


class Encoder:
    """Encodes columns of texts; ``path`` is a tokenizers file whose pre-tokenizer is ByteLevel without a prefix space."""

    def __init__(self, path: str, end_id: int | None = 2):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        added = self.tokenizer.get_added_tokens_decoder().values()
        #: Added tokens by their bytes; False for those whose place depends on more than the leftmost longest match.
        self.added = {t.content.encode(): not (t.lstrip or t.rstrip or t.single_word or t.normalized) for t in added}
        self.any_added = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.known: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self.starts, self.lengths = np.zeros(REMEMBERED, np.int64), np.zeros(REMEMBERED, np.int64)
        self.extra: list[bytes] = []
        self.held = 0

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """Numbers of the pieces in the store, where the new ones are added."""
        if self.extra:
            for p in self.extra:
                del self.known[p]
            self.extra, self.used = [], int(self.starts[REMEMBERED - 1] + self.lengths[REMEMBERED - 1])
        if self.held > REMEMBERED_BYTES:
            self.known, self.used, self.held, self.flat = {}, 0, 0, np.zeros(1 << 20, np.uint32)
        found = list(map(self.known.get, pieces))
        missing = [i for i, number in enumerate(found) if number is None]
        new = [pieces[i] for i in missing]
        self.held += sum(map(len, new))
        if (more := len(self.known) + len(new) - len(self.starts)) > 0:
            self.starts, self.lengths = (np.concatenate([x, np.zeros(more, np.int64)]) for x in (self.starts, self.lengths))
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            got = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in part], add_special_tokens=False)]
            lengths = np.fromiter(map(len, got), np.int64, len(got))
            first, total = len(self.known), int(lengths.sum())
            while self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(got), np.uint32, total)
            self.starts[first : first + len(part)] = self.used + np.cumsum(lengths) - lengths
            self.lengths[first : first + len(part)] = lengths
            self.used += total
            self.known.update(zip(part, range(first, first + len(part)), strict=True))
        if len(self.known) > REMEMBERED:
            self.extra = new[len(new) - (len(self.known) - REMEMBERED) :]
        for i in missing:
            found[i] = self.known[pieces[i]]
        return np.array(found, np.int64)

    def _mark_added(self, marks: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
        """Cut at both ends of every added token that stands within a text, and nowhere inside. A text with a token whose place depends on
        its neighbours stays whole."""
        view, at = data.data, 0
        while self.any_added and (found := self.any_added.search(view, at)):
            row = int(np.searchsorted(offsets, found.start(), side="right")) - 1
            first, end = int(offsets[row]), int(offsets[row + 1])
            if found.end() > end and not (found := self.any_added.search(view, found.start(), end)):
                at = end
            elif self.added[found[0]]:
                at = found.end()
                marks[found.start() + 1 : at] = False
                marks[[found.start(), at]] = True
            else:
                at = end
                marks[first + 1 : end] = False

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (the end id after each), and the bounds of each text's ids."""
        rows = pc.cast(pc.fill_null(texts, ""), pa.large_binary())
        offsets = np.frombuffer(rows.buffers()[1], np.int64)[rows.offset : rows.offset + len(rows) + 1]
        base = offsets[0]
        data = np.frombuffer(rows.buffers()[2] or b"", np.uint8)[base : offsets[-1]]
        offsets = offsets - base
        marks = _cut(data)
        marks[offsets] = True
        self._mark_added(marks, data, offsets)
        cuts = np.flatnonzero(marks)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)]) if len(cuts) > 1 else pa.array([], pa.large_binary())
        coded = pieces.dictionary_encode()
        which = self._learn(coded.dictionary.to_pylist())[coded.indices.to_numpy()] if len(pieces) else np.zeros(0, np.int64)
        lengths = self.lengths[which]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        bounds = ends[np.searchsorted(cuts, offsets)] if len(cuts) else np.zeros(len(rows) + 1, np.int64)
        ids = self.flat[np.repeat(self.starts[which] - ends[:-1], lengths) + np.arange(ends[-1])]
        if self.end_id is None:
            return ids, bounds
        n = np.diff(bounds)
        out = np.full(len(ids) + len(n), self.end_id, np.uint32)
        out[np.repeat(np.arange(len(n)), n) + np.arange(len(ids))] = ids
        return out, bounds + np.arange(len(bounds))


#: Kinds of bytes: 1 ASCII letter, 2 other visible ASCII except digits; what is left is never relied upon.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 2
_KIND[0x30:0x3A] = 3
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = 1


def _cut(data: np.ndarray) -> np.ndarray:
    """True where a new cut surely begins.

    That is before a single space or line end between two visible characters (ASCII, or U+00C0 to U+00FF), after such a line end, and
    before an ASCII mark that follows a letter.
    """
    cut = np.zeros(len(data) + 1, bool)
    if len(data) < 4:
        return cut
    kind = _KIND[data]
    latin = data == 0xC3
    visible_after = (kind > 0) | latin
    letter_before = kind == 1
    letter_before[1:] |= latin[:-1] & (data[1:] != 0x97) & (data[1:] != 0xB7)
    visible_before = letter_before | (kind > 0)
    visible_before[1:] |= latin[:-1]
    gap = (data == 0x20) | (data == 0x0A)
    cut[1 : len(data) - 1] = gap[1:-1] & visible_before[:-2] & visible_after[2:]
    after = np.flatnonzero(cut[:-1] & (data == 0x0A)) + 1
    cut[1 : len(data)] |= letter_before[:-1] & (kind[1:] == 2)
    cut[after] = True
    return cut

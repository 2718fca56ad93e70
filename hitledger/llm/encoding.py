"""Documents to token ids with a public vocabulary of the tokenizers library, remembered piece by piece.

Both supported kinds of vocabulary split a text at white space before any merge, so a text's ids are the ids of its pieces
in a row. Frequent pieces are looked up instead of encoded again. Texts whose white space can't be cut that way, or that hold a
special token's string, are encoded whole.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

IDS = np.dtype("<u4")
REMEMBERED, LONGEST = 480_000, 48  # pieces kept by generation (two of them), and their length at most: some 220 MB a worker
WHOLE, FIRST = " w", " f"  # marks of pieces that are a whole text, or the first of one; no other piece has a space in it

# White space that does not fall into single characters: runs of three, or of two at the end.
_RUNS = re.compile(r"\s\s(?:\s|\Z)")
# Letters that every vocabulary takes as one word, with punctuation behind it.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (x for x in range(256) if x not in printable)
    return {x: chr(x) for x in printable} | {x: chr(256 + i) for i, x in enumerate(others)}


class Encoder:
    """Token ids of texts. ``spaces``: "attached" if a word's token takes the space before it, "dropped" if ids ignore white space
    and the case of letters."""

    def __init__(self, vocabulary: str, spaces: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.attached, self.letters = Tokenizer.from_str(vocabulary), spaces == "attached", _byte_letters()
        self.model = self.tokenizer.model
        self.bytes_of = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size() + 1)]
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.before = self.letters[ord(" ")] if self.attached else ""
        self.tails: dict[str, bytes] = {}
        self.known: dict = {}
        self.older: dict = {}

    def _pieces(self, raw: bytes) -> list:
        """Strings, or bytes where ids ignore white space, in the order of the text."""
        if any(x in raw for x in self.special):
            return [WHOLE + raw.decode("utf-8", "replace")]
        if not self.attached:
            return raw.split()
        text = raw.decode("utf-8", "replace")
        if _RUNS.search(text):
            return [WHOLE + text]
        pieces = text.replace("\n", " \n").split(" ")
        pieces[0] = FIRST + pieces[0]
        return pieces

    def _word(self, word: str) -> bytes:
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.bytes_of[t.id] for t in self.model.tokenize(self.before + letters)])

    def _tail(self, marks: str) -> bytes:
        if len(self.tails) > 1000:
            self.tails = {}
        if marks not in self.tails:
            self.tails[marks] = b"".join([self.bytes_of[t.id] for t in self.model.tokenize(marks)])
        return self.tails[marks]

    def _learn(self, pieces: set) -> None:
        """Puts the ids of ``pieces`` into ``known``: plain words straight through the model, all others through the whole tokenizer."""
        rest, known, older, attached = [], self.known, self.older, self.attached
        for piece in pieces:
            ids = older.get(piece)
            if ids is None:
                text = piece if attached or piece[:1] == " " else piece.decode("utf-8", "replace")
                if text.isascii() and text.isalpha():  # as the pattern below, which takes longer
                    word, tail = text, ""
                elif plain := _PLAIN.fullmatch(text):
                    word, tail = plain.groups()
                else:
                    rest.append((piece, text))
                    continue
                if not tail:
                    ids = self._word(text if attached else text.lower())
                else:
                    if not attached:
                        word = word.lower()
                    ids = known.get(word) or older.get(word)
                    if ids is None:
                        ids = known[word] = self._word(word)
                    ids += self._tail(tail)
            known[piece] = ids
        for start in range(0, len(rest), 4096):
            part = rest[start:start + 4096]
            texts = [t[2:] if t[:2] in (WHOLE, FIRST) else " " + t if self.attached and t[:1] != "\n" else t for _, t in part]
            for (piece, _), found in zip(part, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                known[piece] = b"".join([self.bytes_of[i] for i in found.ids])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each UTF-8 text as little-endian unsigned 32-bit integers."""
        collecting = gc.isenabled()
        gc.disable()  # millions of short-lived lists and tuples, no cycles
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        known, found, holes = self.known, [], []
        for raw in texts:
            pieces = self._pieces(raw)
            ids = list(map(known.get, pieces))
            at = -1
            for _ in range(ids.count(None)):
                at = ids.index(None, at + 1)
                holes.append((ids, at, pieces[at]))
            found.append(ids)
        new = {piece for _, _, piece in holes}
        self._learn(new)
        for ids, at, piece in holes:
            ids[at] = known[piece]
        for piece in new:
            if len(piece) > LONGEST:
                del known[piece]
        return [b"".join(ids) for ids in found]


def encoder_of(vocabulary: str, spaces: str) -> Encoder:
    """The worker's encoder of a vocabulary. It outlives the task (code shipped with a task does not): it hangs on the library."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_encoders_of_this_worker", {})
    key = (hash(vocabulary), len(vocabulary), spaces)
    if key not in kept:
        kept.clear()
        kept[key] = Encoder(vocabulary, spaces)
    return kept[key]


def read_vocabulary(path: str) -> str:
    """The vocabulary file's text, read by the driver and shipped with the tasks: a few megabytes, whatever the input."""
    return Path(path).read_text(encoding="utf-8")


def slices(values: list[pa.Array], texts: pa.Array, most: int = 1_000_000) -> Iterator[tuple[list, list[bytes]]]:
    """(values, texts) in runs of ``most`` bytes or one document. ``texts``: binary, null counts as empty; one column of ``values``
    gives its values, several give tuples. Only a run leaves Arrow's memory at a time."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < len(texts):
        begun = sizes[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(sizes, begun + most, "right")))
        columns = [v.slice(low, high - low).to_pylist() for v in values]
        yield columns[0] if len(columns) == 1 else list(zip(*columns)), [x or b"" for x in texts.slice(low, high - low).to_pylist()]
        low = high

"""Token ids by the tokenizers library, with a memory of pieces.

Corpora repeat their words, so texts are cut where both tokenizer kinds cut anyway, before runs of white space,
and each different piece is given to the library once. For a byte-level tokenizer a piece is a run of spaces and
line feeds with what follows it: none of its pre-tokens crosses the end of a word, and what it does with white
space depends on the run and the next character alone. For a tokenizer that drops white space a piece is a word.
A text with other white space than spaces and line feeds (for the first kind), and any text under a tokenizer of
another kind, goes to the library whole. Cutting texts, telling pieces apart and putting the ids together is done
by Arrow and numpy for a few megabytes of text at a time. Memory is bounded: there are two halves of about `held`
bytes, and when one is full the older one goes; pieces of more than `longest` characters (texts without spaces)
aren't remembered. What is remembered changes no result.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space, by any of the libraries' definitions, that isn't a space or a line feed; also the mark used below.
ODD = r"[\t\x0b-\r\x01\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"
#: Runs of white space that a cut at single spaces doesn't show.
RUNS = ("  ", " \n", "\n ", "\n\n")
PIECE = re.compile("[ \n]*[^ \n]+|[ \n]+")
FIRST = "\x01"
HELD = 48 << 20
LONGEST = 64
#: About what a remembered piece takes besides its characters and its value.
ENTRY = 150
CHUNK = 8 << 20
#: Pieces given to the library in one call; its results take far more memory than the ids.
AT_ONCE = 1 << 12


def kind_of(config: dict) -> str:
    """'keep': byte level, white space kept; 'drop': white space dropped; 'whole': neither is certain."""
    pre = config.get("pre_tokenizer") or {}
    if any(x.get("lstrip") or x.get("rstrip") or re.search(r"\s", x["content"]) for x in config.get("added_tokens", ())):
        return "whole"
    if not config.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "keep"
    steps = pre.get("pretokenizers") or []
    if steps and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and r"\s\p{L}\p{N}" in steps[0]["pattern"].get("Regex", ""):
        return "drop"
    return "whole"


class PieceMemory:
    """What `look_up` says of each piece, remembered."""

    def __init__(self, kind: str, look_up: Callable[[list[str]], Iterable], held: int = HELD, longest: int = LONGEST, chunk: int = CHUNK):
        self.kind, self.look_up, self.held, self.longest, self.chunk = kind, look_up, held, longest, chunk
        self.memory, self.older, self.size = {}, {}, 0

    def piece(self, key: str) -> str:
        """Under 'keep' a key stands for a space and itself, but after FIRST or with a line feed in front for
        what it says."""
        if self.kind == "drop" or key[:1] == "\n":
            return key
        return key[1:] if key[:1] == FIRST else " " + key

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Where each text's keys start, with the end, and the keys of all."""
        if self.kind == "drop":
            keys = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
            return keys.offsets.to_numpy(), keys.flatten()
        plain = np.zeros(len(texts), bool)
        if self.kind == "keep":
            other = pc.match_substring_regex(texts, ODD)
            for run in RUNS:
                other = pc.or_(other, pc.match_substring(texts, run))
            plain = ~other.to_numpy(zero_copy_only=False)
        if plain.all():
            keys = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(FIRST, texts, ""), "\n", " \n"), " ")
            return keys.offsets.to_numpy(), keys.flatten()
        lists = []
        odd = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), ODD))
        for text in texts.to_pylist():
            if self.kind == "keep" and not odd.search(text):
                lists.append([x if x[0] == "\n" else FIRST + x for x in PIECE.findall(text)])
            else:
                lists.append([FIRST + text])
        return np.concatenate([[0], np.cumsum([len(x) for x in lists])]), pa.array([x for y in lists for x in y], pa.string())

    def chunks(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
        """For some texts at a time: where each one's pieces start, with the end; each piece's place in a list
        of values; and that list. Texts with runs of white space are chunks apart from the others'."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        size = np.cumsum(pc.binary_length(texts).to_numpy())
        start = 0
        while start < len(texts):
            end = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + self.chunk, side="right")))
            offsets, keys = self._cut(texts.slice(start, end - start))
            known = keys.dictionary_encode()
            yield offsets.astype(np.int64) - offsets[0], known.indices.to_numpy(), self._values(known.dictionary.to_numpy(zero_copy_only=False).tolist())
            start = end

    def _values(self, keys: list[str]) -> list:
        if self.size > self.held:  # what is still in use comes over from the older half
            self.memory, self.older, self.size = {}, self.memory, 0
        values = list(map(self.memory.get, keys))
        missing = [i for i, v in enumerate(values) if v is None]
        found = [self.older.get(keys[i]) for i in missing]
        new = [i for i, v in zip(missing, found, strict=True) if v is None]
        for i, v in zip(missing, found, strict=True):
            values[i] = v
        for i, v in zip(new, self.look_up([self.piece(keys[i]) for i in new]), strict=True):
            values[i] = v
        for i in missing:
            if len(keys[i]) <= self.longest:
                self.memory[keys[i]] = values[i]
                self.size += ENTRY + len(keys[i])
        return values

    def sums(self, texts: pa.Array) -> np.ndarray:
        """The sum of the (integer) values of each text's pieces."""
        result = [np.zeros(0, np.int64)]
        for offsets, at, values in self.chunks(texts):
            total = np.concatenate([[0], np.cumsum(np.array(values, np.int64)[at])])
            result.append(np.diff(total[offsets]))
        return np.concatenate(result)

    def joined(self, texts: pa.Array) -> Iterator[bytes]:
        """The values (bytes, in units of 4) of each text's pieces, one after the other."""
        for offsets, at, values in self.chunks(texts):
            size = np.fromiter(map(len, values), np.int64, len(values)) // 4
            pool = np.frombuffer(b"".join(values), "<u4")
            first, n = (np.cumsum(size) - size)[at], size[at]
            ends = np.cumsum(n)
            flat = pool[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - n), n)]
            bounds = np.concatenate([[0], ends])[offsets].tolist()
            for a, b in zip(bounds, bounds[1:]):  # noqa: B905
                yield flat[a:b].tobytes()


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes
    stand for themselves, the others for the characters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


_encoders: dict[str, PieceMemory] = {}


def encoder(path: str) -> PieceMemory:
    """Pieces' ids as little-endian unsigned 32-bit integers; one encoder for each worker process."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()

        def look_up(pieces: list[str]) -> Iterator[bytes]:
            for at in range(0, len(pieces), AT_ONCE):
                for x in library.encode_batch_fast(pieces[at : at + AT_ONCE], add_special_tokens=False):
                    yield np.array(x.ids, "<u4").tobytes()

        _encoders[path] = PieceMemory(kind_of(config), look_up)
    return _encoders[path]


def encode_texts(path: str, texts: pa.Array) -> Iterator[bytes]:
    return encoder(path).joined(texts)

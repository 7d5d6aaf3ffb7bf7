"""Encoding of a whole corpus with a public byte-level BPE tokenizer, by forced boundaries.

Two bytes that stand side by side inside no token of the vocabulary can never be merged: between them a cut is certain.
Texts are split at such cuts (before white space and around digits, where the tokenizer's own pattern splits too), the
fragments are encoded independently and their ids concatenated. Fragments repeat far more than texts, so nearly all of
them come from a bounded cache. Where the pattern would look beyond a cut, none is made.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import text_of

DEFAULT_FOLDER = "/opt/tokenizers"
DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"
#: The split pattern of this family of tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of a worker's cache, and the longest fragment kept in it.
CACHE_ENTRIES, CACHE_CHARS = 300_000, 40

_WS = " \\n\\r\\t\\x0b\\x0c"
_WS_BYTES = frozenset(b" \n\r\t\x0b\x0c")
_DIGITS = frozenset(b"0123456789")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def fragment_patterns(tokens) -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """The cuts that are certain for a vocabulary: (what forbids a cut, fragments of texts without it, of any text).

    A character after which the vocabulary joins white space, or a digit, to its last byte stays with what follows; so
    do characters beyond the basic plane, controls that only some call white space, and white space other than ASCII's.
    """
    pairs = {p for t in tokens for p in zip(t, t[1:])}
    joined = {a for a, b in pairs if a not in _WS_BYTES and (b in _WS_BYTES or (b in _DIGITS and a not in _DIGITS))}
    if any(a < 0x80 for a in joined):
        raise ValueError("this vocabulary joins ASCII characters to white space or digits after them")
    held = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and (chr(c).encode()[-1] in joined or chr(c).isspace() or 0x1C <= c < 0x20 or c == 0x85) and chr(c) not in " \n\r\t\x0b\x0c"]
    hold = "".join(f"\\u{ord(c):04x}" for c in held) + "\\U00010000-\\U0010ffff"
    tail = f"(?:(?<=[{hold}])(?:[{_WS}]*(?:[0-9]+[^{_WS}0-9]*|[^{_WS}0-9]+)|[{_WS}]+$))*"
    plain = f"[{_WS}]*(?:[0-9]+[^{_WS}0-9]*|[^{_WS}0-9]+)"
    return re.compile(f"[{hold}][{_WS}0-9]"), re.compile(f"{plain}|[{_WS}]+"), re.compile(f"{plain}{tail}|[{_WS}]+")


class Encoder(dict):
    """Fragment -> packed ids; what is short is kept, up to a bound."""

    def __init__(self, path: str):
        super().__init__()
        ranks = load_ranks(path)
        self.model = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.held, self.plain, self.any = fragment_patterns(ranks)

    def __missing__(self, fragment: str) -> bytes:
        ids = np.array(self.model.encode_ordinary(fragment), np.int32).tobytes()
        if len(fragment) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[fragment] = ids
        return ids

    def fragments(self, text: str) -> list[str]:
        return (self.any if self.held.search(text) else self.plain).findall(text)

    def packed(self, text: str) -> bytes:
        """The ids of ``text``, four bytes each."""
        return b"".join(map(self.__getitem__, self.fragments(text)))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), np.int32)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _keyed(df: DataFrame, text: str, keys: list[str]) -> tuple[DataFrame, str]:
    picked = df.select(*[F.col(f"`{k}`") for k in keys], text_of(df, text).alias("_text"))
    return picked, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])


def encode(df: DataFrame, text: str, keys: list[str], folder: str = DEFAULT_FOLDER, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``keys`` and ``ids`` (array of int) of each row; an empty list for an empty and for a null text.

    Texts are encoded unchanged and whole, of any length; special tokens' strings are ordinary text. Repeated rows and
    other columns do not matter. Narrow: nothing is exchanged. ``folder`` must be readable on every executor.
    """
    picked, kinds = _keyed(df, text, keys)
    path = f"{folder}/{vocabulary}"

    def work(batches):
        e = encoder(path)
        for b in batches:
            done = [e.packed(t) if t else b"" for t in b.column(len(keys)).to_pylist()]
            offsets = np.zeros(len(done) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in done], out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(done), np.int32)))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keys))), ids], names=[*keys, "ids"])

    return picked.mapInArrow(work, f"{kinds}, ids array<int>")


def count_tokens(df: DataFrame, text: str, keys: list[str], folder: str = DEFAULT_FOLDER, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``keys`` and ``n_tokens`` of each row, 0 for empty and null texts; otherwise as :func:`encode`."""
    picked, kinds = _keyed(df, text, keys)
    path = f"{folder}/{vocabulary}"

    def work(batches):
        e = encoder(path)
        for b in batches:
            counts = [len(e.packed(t)) // 4 if t else 0 for t in b.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keys))), pa.array(counts, pa.int64())], names=[*keys, "n_tokens"])

    return picked.mapInArrow(work, f"{kinds}, n_tokens long")

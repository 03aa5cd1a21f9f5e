"""Byte-level BPE ids at the speed of a dictionary: pre-tokens are looked up, unseen ones go to the tokenizers library.

A pre-token's ids don't depend on its neighbours, so ids of a text are the joined ids of its
pre-tokens. The split is done here only for texts of characters on which this module's
pattern and the library's agree; any other text is encoded by the library as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from weftline.llm.caches import bounded, keep

_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Characters outside printable ASCII, line feed and Latin letters leave the fast path.
UNUSUAL = re.compile(rf"[^\n\x20-\x7e{_LETTERS}]")
#: The byte-level split for the characters of the fast path.
BYTE_LEVEL_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^ \n0-9{_LETTERS}]+|[ \n]+(?![^ \n])|[ \n]+")
#: Pre-tokens kept by a worker before it starts anew.
CACHE_ENTRIES = 800_000


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(printable))
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


def byte_ranks(spec: dict) -> dict[bytes, int]:
    """Bytes of each token of a byte-level vocabulary and its id."""
    back = {s: b for b, s in byte_symbols().items()}
    return {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items()}


class _Known(dict):
    """Bytes of the ids of each pre-token met, filled in as it is asked."""

    def __init__(self, tokenizer: Tokenizer, dtype: np.dtype):
        super().__init__()
        self.model, self.dtype, self.symbols = tokenizer.model, dtype, byte_symbols()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        symbols = word.encode().decode("latin-1").translate(self.symbols)
        out = self[word] = b"".join([t.id.to_bytes(self.dtype.itemsize, "little") for t in self.model.tokenize(symbols)])
        return out


class ByteLevelEncoder:
    """Ids of whole texts as little-endian bytes of ``dtype``; equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.vocab_size <= 1 << 16 else "<u4")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = _Known(self.tokenizer, self.dtype)

    def encode(self, text: str) -> bytes:
        if UNUSUAL.search(text) is None and not any(a in text for a in self.added):
            return b"".join(map(self.known.__getitem__, BYTE_LEVEL_SPLIT.findall(text)))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()


def encoder(path: str) -> ByteLevelEncoder:
    """The encoder that this worker keeps from task to task."""
    return keep(("byte-level", path), lambda: ByteLevelEncoder(path))


def tokenize(df: DataFrame, vocab_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids``: the text's ids and ``end_id``, two bytes an id (four in vocabularies over 65,536), little-endian.

    A null text is empty, so it has ``end_id`` alone. Extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab_path)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            ids = [enc.encode(t or "") + end for t in batch.column(1).to_pylist()]
            counts = pa.array([len(x) // enc.dtype.itemsize for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return bounded(df).select(df[id_col].alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary")


def id_dtype(vocab_path: str) -> np.dtype:
    return encoder(vocab_path).dtype

"""Byte-pair encoding by a deterministic automaton over token arcs, compiled merge by merge.

The automaton's arcs carry tokens; it accepts exactly the token sequences that the merges
give. It starts as one state with a loop for each base symbol. A merge ``u v -> uv`` puts in
a gadget: arcs on ``u`` are led to a copy of their target without the arc on ``v``, and
every state with an arc on ``u`` gets one on ``uv`` to where ``v`` led. As all arcs on a token
lead to one state, a state is named by the last token, and a copy is its original and the arc it lacks.
``step`` follows these records instead of whole arc tables, and keeps the transitions it
has worked out, which serve as the transition table.

A word is encoded from left to right: for each place, the one token that ends there and has
an arc from the state at its start; each prefix of a word has one accepted sequence, so one
table of last tokens gives the ids backwards. Decoding emits the labels of the arcs.

Rules: null texts are empty and have no ids; texts are whole; repeated rows are coded
separately; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from weftline.llm.caches import bounded, keep
from weftline.llm.vocab import byte_symbols

_LETTERS = "a-zß-öø-ÿĀ-įı-ſ"
#: Characters on which this module's lower case and split agree with the library's; other texts are split by the library.
UNUSUAL = re.compile("[^\n\x20-\x7eÀ-ÖØ-öø-įı-ſ]")
WORD_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^ \n0-9{_LETTERS}]+")
#: Words and transitions kept by a worker before it starts anew.
CACHE_ENTRIES, TABLE_ENTRIES = 400_000, 1_200_000
_NEVER = 1 << 60


class MergeAutomaton:
    """The automaton of a list of merges (u, v, uv) of token ids, in their order; tokens that no merge makes are base symbols."""

    def __init__(self, tokens: int, merges: list[tuple[int, int, int]]):
        self.cut: dict[int, int] = {}  # (u, v) -> when the gadget took the arc on v from the state after u
        self.parent = [-1] * tokens  # the token whose state the state after this one was
        self.left = [-1] * tokens  # the token whose arcs this token's arcs stand beside
        self.born = [_NEVER] * tokens  # when
        self.arcs = [True] * tokens  # whether any state has an arc on the token
        self.size = tokens
        self.table: dict[int, bool] = {}
        for _, _, uv in merges:
            self.arcs[uv] = False
        for when, (u, v, uv) in enumerate(merges):
            self._merge_gadget(u, v, uv, when)

    def _merge_gadget(self, u: int, v: int, uv: int, when: int) -> None:
        """Put the gadget in where the state after ``u`` has an arc on ``v``; a merge that no sequence can reach changes nothing."""
        if self.arcs[u] and self.arcs[v] and self._has_arc(u, v):
            self.cut[u * self.size + v] = when
            self.parent[uv], self.left[uv], self.born[uv], self.arcs[uv] = v, u, when, True

    def _has_arc(self, last: int, token: int) -> bool:
        """Whether the state after ``last`` has an arc on ``token``.

        The arc on ``token`` was put beside that on its left part, which must have been
        there then, and so on; the state after ``last`` was that after its right part, with
        the arcs it had then, and so on. It is missing if one of those parts was cut from
        one of those states before.
        """
        cut, size = self.cut, self.size
        state, before = last, _NEVER
        while state >= 0:
            part, until = token, _NEVER
            while part >= 0:
                when = cut.get(state * size + part)
                if when is not None and when < before and when <= until:
                    return False
                until, part = self.born[part], self.left[part]
            before, state = self.born[state], self.parent[state]
        return True

    def step(self, last: int, token: int) -> bool:
        key = last * self.size + token
        known = self.table.get(key)
        if known is None:
            if len(self.table) >= TABLE_ENTRIES:
                self.table.clear()
            known = self.table[key] = self._has_arc(last, token)
        return known


class AutomatonEncoder:
    """Ids as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them for a word-end vocabulary, and its ``decode``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        model = spec["model"]
        self.symbols = byte_symbols()
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = [""] * (max([*self.vocab.values(), *self.added.values()]) + 1)
        for label, i in [*self.vocab.items(), *self.added.items()]:
            self.labels[i] = label
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.automaton = MergeAutomaton(len(self.labels), [(self.vocab[u], self.vocab[v], self.vocab[u + v]) for u, v in pairs])
        # Arcs by their place in a word: labels without the word end, and those with it.
        arcs = {t: i for t, i in self.vocab.items() if self.automaton.arcs[i]}
        self.inner = {t: i for t, i in arcs.items() if not (self.end and t.endswith(self.end))}
        self.final = {t.removesuffix(self.end): i for t, i in arcs.items() if t.endswith(self.end)} if self.end else self.inner
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.library = Tokenizer.from_file(path)
        self.added_split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.known: dict[str, bytes] = _Words(self)

    def word_ids(self, symbols: str) -> list[int]:
        """Ids of one pre-split word given in byte symbols, by the automaton's transitions."""
        n, size, table = len(symbols), self.automaton.size, self.automaton.table
        last, start = [-1] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            arc = (self.final if end == n else self.inner).get
            for begin in range(max(0, end - self.longest), end):
                token = arc(symbols[begin:end])
                if token is None:
                    continue
                if begin:
                    known = table.get(last[begin] * size + token)
                    if not (self.automaton.step(last[begin], token) if known is None else known):
                        continue
                last[end], start[end] = token, begin
                break
        ids, at = [], n
        while at > 0:
            ids.append(last[at])
            at = start[at]
        return ids[::-1]

    def _words(self, text: str) -> list[str]:
        if UNUSUAL.search(text) is None:
            return WORD_SPLIT.findall(text.lower())
        pre, norm = self.library.pre_tokenizer, self.library.normalizer
        words = pre.pre_tokenize_str(norm.normalize_str(text))
        back = {ord(s): b for b, s in self.symbols.items()}
        return [bytes(back[ord(c)] for c in w).decode() for w, _ in words]

    def _encode_plain(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self._words(text)))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if not any(a in text for a in self.added):
            return self._encode_plain(text)
        parts = self.added_split.split(text)
        return b"".join(np.uint32(self.added[p]).tobytes() if k % 2 else self._encode_plain(p) for k, p in enumerate(parts) if p)

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Words(dict):
    """Bytes of the ids of each word met, filled in as it is asked."""

    def __init__(self, owner: AutomatonEncoder):
        super().__init__()
        self.owner = owner

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        symbols = word.encode().decode("latin-1").translate(self.owner.symbols)
        out = self[word] = np.array(self.owner.word_ids(symbols), "<u4").tobytes()
        return out


def encoder(path: str) -> AutomatonEncoder:
    """The automaton that this worker keeps from task to task."""
    return keep(("automaton", path), lambda: AutomatonEncoder(path))


def encode_documents(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab_path)
        for batch in batches:
            ids = [np.frombuffer(enc.encode(t or ""), "<u4").astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return bounded(df).select(df[id_col].alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_documents(df: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id`` and ``text`` decoded from arrays of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab_path)
        for batch in batches:
            texts = [enc.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return bounded(df).select(df[id_col].alias("doc_id"), df[ids_col].alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")


def round_trip_digests(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number of ids, SHA-256 of the ids and of the decoded text of every whole text, without moving either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab_path)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column(1):
                ids = enc.encode(text.as_py() or "")
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(enc.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    return bounded(df).select(df[id_col].alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")

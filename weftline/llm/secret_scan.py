"""Secret scans: fixed token formats, and an assignment-aware lexer of source and configuration text.

The lexer looks at each ``=``, ``:``, ``:=`` and ``=>`` of a text, reads the name before it
(bare, dotted, quoted or bracketed; before a type, as in ``name: type = value``, too) and the
value after it (string literals, triple-quoted ones as well, joined by ``+`` or standing side by
side, an indented block after ``|`` or ``>``, a bare literal, a reference to a name), and keeps
what each name last held. A literal is scored by the most sensitive name it reaches: by itself,
or through names assigned from it later. A comparison pairs a name with a literal, but the
name doesn't hold it. Elements (``<name>value</name>``) and pairs of a key and a value attribute
count as assignments, and credentials inside URLs as assigned to a password.

Rules: a null text is empty; whole texts are read; a finding is (kind, start, end) in code
points, end exclusive; repeated rows are scanned separately; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.llm.caches import bounded

# The base patterns and the least length of what they must match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "lexed")

# How sensitive a name is that has these words, most sensitive first.
NAME_WEIGHTS = (
    (1.0, {"password", "passwd", "passphrase", "pwd", "secret", "secretkey", "clientsecret", "privatekey", "apikey", "accesskey", "authtoken", "accesstoken", "refreshtoken", "bearertoken"}),
    (0.9, {"token", "credential", "credentials", "signingkey", "encryptionkey", "masterkey", "pass", "bearer", "jwt"}),
    (0.6, {"auth", "authorization", "key", "salt", "signature", "cookie", "session", "dsn", "connectionstring"}),
)
# Literals that stand for a secret without being one.
PLACEHOLDER = re.compile(r"(?i)change_?me|example|placeholder|your[_-]|dummy|redacted|todo|xxx+|\*\*\*|^<.*>$|^\$\{|^%\(|^\{\{|null|none|true|false|undefined")
#: Least name weight times literal strength of a finding, and least length of a literal.
THRESHOLD, LEAST_LITERAL = 0.5, 8

# Matched in the reversed text, from an operator back.
_BLANKS, _NAME_SIGNS = re.compile(r"\n?[ \t]*"), re.compile(r"[\w$.\-]+")
_NAME_START = re.compile(r"[A-Za-z_$]")
_QUOTED_NAME = re.compile(r"[A-Za-z_][\w .\-]*")
_TRIPLE = re.compile(r"""(?:[rbuf]{1,2}(?=["']))?(?:\"{3}((?:[^\\]|\\[\s\S])*?)\"{3}|'{3}((?:[^\\]|\\[\s\S])*?)'{3})""", re.IGNORECASE)
_ATOM = re.compile(r"""(?:[rbufRBUF]{1,2}(?=["']))?(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)')|`([^`\n]*)`|\$?\{?([A-Za-z_$][\w$.]*+)\}?(?=[ \t]*(?:[;,+)\]}\n\r#]|$))""")
_BARE = re.compile(r"[\w+/.=\-~!@%^&*]+")
#: Every place at which PLACEHOLDER finds something in a bare literal.
_PLACEHOLDER_AT = re.compile(r"(?i)(?=change_?me|example|placeholder|your[_-]|dummy|redacted|todo|xxx|\*\*\*|null|none|true|false|undefined)")
_OPERATOR = re.compile(r":=|=>|[=!]==?|=|:")
_TYPE = re.compile(r"""[ \t]*[&*]?(?:'\w+ )?(?:mut )?[\w.]+(?:\[[^\[\]\n]*(?:\[[^\[\]\n]*\][^\[\]\n]*)*\]|<[^<>\n]*>)?\??(?: ?\| ?[\w.]+)*[ \t]*""")
_BLOCK = re.compile(r"[ \t]*[|>][+\-0-9]*[ \t]*\r?\n")
_BLOCK_LINE = re.compile(r"([ \t]+)([^\s][^\n]*?)[ \t\r]*(?:\n|\Z)|[ \t]*\r?\n")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.:\-]*)(?:\s[^<>]*)?>\s*([^<>\s]+)\s*</\1\s*>")
_ATTRIBUTES = re.compile(r"""\b(?:key|name)\s*=\s*["']([^"'\n]+)["']\s+value\s*=\s*["']([^"'\n]+)["']""")
_GAP = re.compile(r"[ \t]*")
_JOIN = re.compile(r"[ \t]*(?:\+[ \t]*(?:\\?\n[ \t]*)?)?")
_URL_SECRET = re.compile(r"[a-z][a-z0-9+.\-]{1,15}://[^\s:/@\"']*+:([^\s@/\"']{6,}+)@")
_CAMEL = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@dataclass(frozen=True)
class Finding:
    kind: str
    start: int
    end: int
    name: str
    score: float


@dataclass
class _Held:
    """What a name holds: the places of its literals, whether one was quoted, and whether it is one bare literal."""

    places: list[tuple[int, int]]
    quoted: bool
    bare: bool = False


class _Run:
    """The bare literal read last. Later ones may begin within it; they end with it, so each character is counted once."""

    def __init__(self, text: str):
        self.text, self.at, self.end, self.counts, self.placeholder = text, 0, 0, None, -1

    def end_from(self, at: int) -> int:
        """Where the bare literal that begins at ``at`` ends; ``at`` if there is none."""
        if not self.at <= at < self.end:
            found = _BARE.match(self.text, at)
            if not found:
                return at
            self.at, self.end, self.counts = at, found.end(), None
        return self.end

    def strength(self, at: int) -> float:
        if self.counts is None:
            self.counts = Counter(self.text[at : self.end])
            self.placeholder = max((m.start() for m in _PLACEHOLDER_AT.finditer(self.text, at, self.end)), default=-1)
        else:
            self.counts -= Counter(self.text[self.at : at])
        self.at = at
        return 0.0 if self.end - at < LEAST_LITERAL or self.placeholder >= at else _strength(self.counts, self.end - at, False)


def name_weight(name: str) -> float:
    """How sensitive a target name is, 0 to 1, by its words and neighbouring words joined."""
    words = [w.lower() for w in _CAMEL.findall(name)]
    joined = {*words, *(a + b for a, b in zip(words, words[1:], strict=False))}
    return next((weight for weight, known in NAME_WEIGHTS if joined & known), 0.0)


def literal_strength(text: str, quoted: bool) -> float:
    """How much a literal looks like a secret, 0 to 1: by length, kinds of characters and entropy."""
    if len(text) < LEAST_LITERAL or PLACEHOLDER.search(text) or any(c.isspace() for c in text):
        return 0.0
    return _strength(Counter(text), len(text), quoted)


def _strength(counts: Counter, length: int, quoted: bool) -> float:
    classes = sum(any(test(c) for c in counts) for test in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    digits = any(c.isdigit() for c in counts)
    if not quoted and not (digits and any(c.isalpha() for c in counts)):
        return 0.0
    if classes < 2:
        return 0.0
    entropy = -sum(n / length * math.log2(n / length) for n in counts.values())
    return min(1.0, 0.3 + entropy / 8 + 0.1 * (classes - 1) + 0.1 * digits)


def _name_before(text: str, back: str, at: int) -> str | None:
    """The quoted or bare name that ends before ``at``, blanks aside; ``back`` is the text reversed."""
    n = len(text)
    end = n - _BLANKS.match(back, n - at).end()
    close = end - 2 if end > 1 and text[end - 1] == "]" else end - 1
    if close > 0 and text[close] in "\"'":
        start = text.rfind(text[close], 0, close)
        return text[start + 1 : close] if start >= 0 and _QUOTED_NAME.fullmatch(text, start + 1, close) else None
    signs = _NAME_SIGNS.match(back, n - end)
    first = signs and _NAME_START.search(text, n - signs.end(), end)
    return text[first.start() : end] if first else None


def _block_after(text: str, at: int, line: int) -> list[tuple[int, int]]:
    """Places of the lines of the block that ``|`` or ``>`` at ``at`` opens, indented deeper than the line that begins at ``line``."""
    opening, places, indent = _BLOCK.match(text, at), [], None
    outer = _GAP.match(text, line)[0]
    at = opening.end() if opening else len(text)
    while at < len(text) and (found := _BLOCK_LINE.match(text, at)):
        at = found.end()
        if found[2] is None:
            continue
        if not found[1].startswith(indent or outer) or found[1] == outer:
            break
        indent = indent or found[1]
        places.append(found.span(2))
    return places


def _value_after(text: str, at: int, held: dict[str, _Held], run: _Run) -> _Held | None:
    """The value that begins at ``at``: literals, possibly joined, or what a name holds."""
    places, quoted, bare = [], False, False
    while True:
        atom = _TRIPLE.match(text, at) or _ATOM.match(text, at)
        triple = atom is not None and atom.re is _TRIPLE
        which, end = (atom.lastindex, atom.end()) if atom else (5, run.end_from(at))
        if end == at:
            break
        if which == 4 and atom[4] in held:
            known = held[atom[4]]
            places += known.places
            quoted |= known.quoted
        elif which == 4 and places:
            return None
        else:
            bare = which == 5 and not places
            place = atom.span(which) if atom else (at, end)
            if triple:  # blanks around the text aren't the literal's
                inner = text[slice(*place)]
                place = (place[0] + len(inner) - len(inner.lstrip()), place[1] - len(inner) + len(inner.rstrip()))
            if place[0] < place[1]:
                places.append(place)
            quoted |= which <= 3
        joint = _JOIN.match(text, end)
        at = joint.end()
        if "+" not in joint[0] and not (which <= 3 and at < len(text) and text[at] in "\"'"):
            break
    return _Held(places, quoted, bare and len(places) == 1) if places else None


def lexed_findings(text: str) -> list[Finding]:
    """Literals that reach a sensitive name, each with its most sensitive one."""
    held: dict[str, _Held] = {}
    best: dict[tuple[int, int], Finding] = {}
    known: dict[tuple, float] = {}
    run, back = _Run(text), text[::-1]

    def strength(value: _Held) -> float:
        key = (value.quoted, *value.places)
        if key not in known:
            inner = value.bare and run.at <= value.places[0][0] < run.end
            known[key] = run.strength(value.places[0][0]) if inner else literal_strength("".join(text[a:b] for a, b in value.places), value.quoted)
        return known[key]

    def note(value: _Held, name: str, weight: float) -> None:
        score = weight * strength(value)
        if score >= THRESHOLD:
            for place in value.places:
                if place not in best or best[place].score < score:
                    best[place] = Finding("lexed", *place, name, round(score, 4))

    before: tuple[int, str | None, str] = (0, None, "")  # end, name and sign of the operator before
    line = 0
    for op in _OPERATOR.finditer(text):
        line = max(line, text.rfind("\n", before[0], op.start()) + 1)
        name = _name_before(text, back, op.start())
        names = [n for n in (name, before[1] if op[0] == "=" and before[2] == ":" and _TYPE.fullmatch(text, before[0], op.start()) else None) if n]
        before = (op.end(), name, op[0])
        if not names:
            continue
        after = _GAP.match(text, op.end()).end()
        if op[0] == ":" and text[after : after + 1] in ("|", ">") and (lines := _block_after(text, after, line)):
            value: _Held | None = _Held(lines, True)
        else:
            value = _value_after(text, after, held, run)
        if value is None:
            continue
        for name in names:
            if op[0][-2:] != "==" and op[0] != "!=":
                held[name] = value
            if weight := name_weight(name):
                note(value, name, weight)
    if "</" in text:
        for element in _ELEMENT.finditer(text):
            note(_Held([element.span(2)], True), element[1], name_weight(element[1]))
    if "value" in text:
        for pair in _ATTRIBUTES.finditer(text):
            note(_Held([pair.span(2)], True), pair[1], name_weight(pair[1]))
    if "://" in text:
        for url in _URL_SECRET.finditer(text):
            note(_Held([url.span(1)], True), "url password", 1.0)
    return sorted(best.values(), key=lambda f: (f.start, f.end))


def base_findings(text: str) -> list[Finding]:
    """Leftmost non-overlapping matches of each fixed pattern that are long enough, by start, then kind as listed."""
    found = []
    if ":" in text or "=" in text:
        found += [Finding("assign", *m.span(), m[1], 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [Finding("access", *m.span(), "", 1.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [Finding("hex", *m.span(), "", 1.0) for m in HEX.finditer(text)]
    return sorted(found, key=lambda f: (f.start, KINDS.index(f.kind)))


def all_findings(text: str) -> tuple[list[Finding], list[Finding]]:
    """The base findings, and these with the lexed ones that don't lie within one of them."""
    base = base_findings(text)
    if ":" not in text and "=" not in text and "</" not in text:
        return base, base
    starts, reach, furthest = [f.start for f in base], [], 0
    for f in base:
        furthest = max(furthest, f.end)
        reach.append(furthest)

    def covered(f: Finding) -> bool:
        k = bisect.bisect_right(starts, f.start)
        return k > 0 and reach[k - 1] >= f.end

    more = [f for f in lexed_findings(text) if not covered(f)]
    return base, sorted([*base, *more], key=lambda f: (f.start, KINDS.index(f.kind), f.end))


def spans_text(findings: list[Finding]) -> str:
    return ",".join(f"{f.kind}:{f.start}:{f.end}" for f in findings)


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """The text with every finding replaced; overlapping findings become one mark."""
    out, at = [], 0
    for f in all_findings(text)[1]:
        if f.end <= at:
            continue
        if f.start >= at:
            out += [text[at : f.start], mark]
        at = f.end
    return "".join([*out, text[at:]])


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per finding: doc_id, kind, start, end, name and score. The secret itself is not returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, f) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for f in all_findings(text or "")[1]]
            columns = [[i for i, _ in rows], *([getattr(f, c) for _, f in rows] for c in ("kind", "start", "end", "name", "score"))]
            types = [batch.schema.field(0).type, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "kind", "start", "end", "name", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return bounded(df).select(df[id_col].alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, kind string, start long, end long, name string, score double")


def secret_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: numbers of base findings by kind, the SHA-256 of their spans, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [all_findings(text or "") for text in batch.column(1).to_pylist()]
            counts = [Counter(f.kind for f in base) for base, _ in found]
            columns = [batch.column(0), *(pa.array([c[k] for c in counts], pa.int64()) for k in KINDS[:3])]
            columns += [pa.array([hashlib.sha256(spans_text(base).encode()).hexdigest() for base, _ in found]), pa.array([spans_text(every) for _, every in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = df.schema[id_col].dataType.simpleString()
    return bounded(df).select(df[id_col].alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_documents(df: DataFrame, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """The same rows and columns with every finding in the text replaced and the size column, if any, brought up to date."""
    names = bounded(df).columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else redacted(t) for t in batch.column(names.index(text_col)).to_pylist()]
            columns = list(batch.columns)
            columns[names.index(text_col)] = pa.array(texts, pa.string())
            if size_col in names:
                at = names.index(size_col)
                old, same = columns[at].to_pylist(), batch.column(names.index(text_col)).to_pylist()
                columns[at] = pa.array([o if a == b else len(b) for o, a, b in zip(old, same, texts, strict=True)], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return df.mapInArrow(run, df.schema)

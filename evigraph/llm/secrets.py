"""Secret scans: pattern kinds plus assignment-aware lexing.

Base kinds are leftmost non-overlapping matches: ``assign`` (a password-like word, a
separator, a value of six or more characters), ``access`` (AKIA keys of twenty or more),
``hex`` (runs of twenty-four or more lower-case hexadecimal digits).

The lexer adds the kind ``lexed``. It reads source and configuration syntax (``name =
"x"``, ``name: x``, ``"name": 'x'``, ``name := x``, ``name => x``, ``NAME=x``, an optional
type between name and sign, terms joined by +) into name-literal pairs; a bare term that
names an earlier constant stands for that constant's literals, so a harmless name whose
value flows into a sensitive one is still found. Each literal is scored by the most
sensitive name it reaches and by how much its value looks like a secret rather than a
placeholder; literals scoring ``THRESHOLD`` or more are reported. Offsets are code points,
ends exclusive. Null texts are empty.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.runtime import bound_batches

KINDS = ("assign", "access", "hex", "lexed")
THRESHOLD = 0.5
#: A sum of literals with more characters is no secret as a whole; each literal may still be one.
WHOLE = 1024

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_HEX_TABLE = bytes(49 if chr(b) in "0123456789abcdef" else 48 for b in range(256))
_HEX_RUN = b"1" * 24

_TERM = r"""(?:"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`|[^\s"'`,;(){}\[\]<>+]++)"""
_PAIR = re.compile(
    r"""(?<![\w.\-])(?P<name>[A-Za-z_][\w.\-]*+)["'`]?[ \t]*+"""
    r"""(?::[ \t]*+[A-Za-z_][\w.<>\[\]|?]*+[ \t]*+(?==))?"""
    r"""(?:=>|:=|=(?![=~>])|:(?![:/=]))[ \t]*+"""
    rf"""(?P<expr>{_TERM}(?:[ \t]*+\+[ \t]*+{_TERM})*+)"""
)
_TERMS = re.compile(_TERM)
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

_SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.95, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "auth": 0.7, "bearer": 0.9, "pass": 0.7, "pin": 0.6, "jwt": 0.9, "signature": 0.6,
}
_SENSITIVE_PAIRS = {("api", "key"): 1.0, ("access", "key"): 0.95, ("private", "key"): 1.0, ("secret", "key"): 1.0, ("encryption", "key"): 0.95, ("connection", "string"): 0.8, ("session", "key"): 0.9}
_HARMLESS = re.compile(
    r"(?i)^(?:true|false|none|null|nil|undefined|string|str|int|bool|example|changeme|placeholder|redacted|dummy|test|x+|\*+|\.+|-+|your[_-].*|\$\{.*|\$[a-z_]+|%\w+%|\{\{.*|<.*>|os\.environ.*|process\.env.*|https?)$"
)


def sensitivity(name: str) -> float:
    """How strongly a name suggests that its value is a secret, 0 to 1."""
    words = [w.lower() for w in _WORD.findall(name)]
    best = max((_SENSITIVE.get(w, 0.0) for w in words), default=0.0)
    for pair in zip(words, words[1:], strict=False):
        best = max(best, _SENSITIVE_PAIRS.get(pair, 0.0))
    return best


def plausibility(value: str) -> float:
    """How much a literal looks like a secret value, 0 to 1."""
    if len(value) < 6 or _HARMLESS.match(value) or any(c.isspace() for c in value):
        return 0.0
    counts = Counter(value)
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    if entropy < 1.5:
        return 0.0
    mixed = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return min(1.0, 0.35 + 0.1 * mixed + entropy / 10 + min(len(value), 24) / 120)


class _Value:
    """An expression: literals and references to earlier expressions, and how long its text is."""

    __slots__ = ("parts", "size", "told", "whole")

    def __init__(self, parts: list) -> None:
        self.parts = parts
        self.size = min(WHOLE + 1, sum(p.size if isinstance(p, _Value) else len(p[2]) for p in parts))
        self.told = self.whole = 0.0  # the greatest weight that its literals, and they as a whole, were scored with


def _literals(value: _Value, weight: float) -> list[tuple[int, int, str]]:
    """The literals behind an expression in order, each once, constants followed to their own.

    A constant is a reference to its expression, so chains of sums take linear space however
    often they double. In an expression of more than ``WHOLE`` characters, parts that were
    scored with the weight before are passed over.
    """
    out, seen, stack, again = [], {id(value)}, [iter(value.parts)], value.size <= WHOLE
    while stack:
        for p in stack[-1]:
            if isinstance(p, tuple):
                if p not in seen:
                    seen.add(p)
                    out.append(p)
            elif id(p) not in seen and (again or p.told < weight):
                seen.add(id(p))
                p.told = max(p.told, weight)
                stack.append(iter(p.parts))
                break
        else:
            stack.pop()
    return out


def lex(text: str) -> list[tuple[int, int, str, float]]:
    """``(start, end, name, score)`` of the literals that reach a sensitive name."""
    known: dict[str, _Value] = {}
    best: dict[tuple[int, int], tuple[float, str]] = {}
    for m in _PAIR.finditer(text):
        name, parts = m["name"], []
        for t in _TERMS.finditer(m["expr"]):
            at, raw = m.start("expr") + t.start(), t.group()
            if raw[0] in "\"'`":
                if len(raw) > 2:
                    parts.append((at + 1, at + len(raw) - 1, raw[1:-1]))
            elif raw.rstrip(".:") in known:
                parts.append(known[raw.rstrip(".:")])
            elif raw.rstrip(".:"):
                parts.append((at, at + len(raw.rstrip(".:")), raw.rstrip(".:")))
        value = parts[0] if len(parts) == 1 and isinstance(parts[0], _Value) else _Value(parts)
        known[name] = known[name.rpartition(".")[2]] = value
        weight = sensitivity(name)
        if weight > value.whole:
            literals = _literals(value, weight)
            value.told = value.whole = weight
            whole = plausibility("".join(p[2] for p in literals)) if value.size <= WHOLE else 0.0
            for a, b, literal in literals:
                score = weight * max(plausibility(literal), whole if len(literal) >= 3 else 0.0)
                if score >= THRESHOLD and score > best.get((a, b), (0.0, ""))[0]:
                    best[a, b] = (score, name)
    return [(a, b, name, round(score, 4)) for (a, b), (score, name) in best.items()]


def scan(text: str) -> list[tuple[str, int, int, str | None, float]]:
    """All spans ``(kind, start, end, name, score)`` of a text, by start, then kind."""
    found: list[tuple[str, int, int, str | None, float]] = []
    lower = text.lower()
    if "passw" in lower or "secret" in lower or "token" in lower or "key" in lower:
        found += [("assign", m.start(), m.end(), m[1], 1.0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), None, 1.0) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if _HEX_RUN in text.encode("utf-8", "surrogatepass").translate(_HEX_TABLE):
        found += [("hex", m.start(), m.end(), None, 1.0) for m in _HEX.finditer(text)]
    if "=" in text or ":" in text:
        found += [("lexed", a, b, name, score) for a, b, name, score in lex(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())]))


def find_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, found)``: every span of every row's whole text, as an array of structs.

    One row per input row, repeated rows included; other columns are ignored.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ("kind", "start", "end", "name", "score")
        for batch in batches:
            found = [[dict(zip(keys, s, strict=True)) for s in scan(t or "")] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPAN)], names=["doc_id", "found"])

    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(
        run, f"doc_id {kind}, found array<struct<kind string, `start` long, `end` long, name string, score double>>"
    )


def secret_digest(docs: DataFrame) -> DataFrame:
    """Counts and joined spans per document, derived from ``find_secrets``."""
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return find_secrets(docs).select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(F.array_join(F.transform(F.filter("found", lambda s: s["kind"] != "lexed"), shown), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("found", shown), ",").alias("spans"),
        count("lexed").alias("n_lexed"),
    )

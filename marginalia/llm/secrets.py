"""Secret scanning by assignment-aware lexing.

At each assignment sign the name before it (an identifier or a quoted key) is read backwards and the value
expression behind it is lexed: strings (over line ends if triple-quoted), bare and block literals, names, calls,
brackets and plus signs, also on the lines after. That gives name-literal pairs; names that were given a
literal before pass it on when they are assigned to other names (constant propagation, also through +).
The constants form a graph without cycles, along which the sensitivity of names is passed down to the
literals; those that are sensitive and random enough become spans of kind "literal". The base patterns'
spans are always kept. Time and memory are in proportion to the text's length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns, their least lengths and the order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # whole runs: the same spans as runs of any length with the short ones dropped
KINDS = ("assign", "access", "hex", "literal")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

# Parts of names and how strongly they point to a secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "api_key": 1.0, "access_key": 1.0, "accesskey": 1.0, "private_key": 1.0, "privatekey": 1.0, "credential": 0.9,
    "credentials": 0.9, "auth": 0.6, "bearer": 0.8, "signature": 0.5, "salt": 0.4, "key": 0.4,
}
THRESHOLD, LEAST_WEIGHT = 0.6, 0.5

SIGN = re.compile(r":=|=>|\+=|(?<![=!<>:])=(?!=)|:(?![/:])")
TOKEN = re.compile(
    r"""(?P<space>[^\S\n]++)|(?P<line>\n)|(?P<quote>\"{3}|'{3}|["'`])|(?P<comment>\#|//)|(?P<assign>:=|=>|\+=|(?<![=!<>:])=(?!=)|:(?![/:]))"""
    r"""|(?P<name>[A-Za-z_$][\w$]*+(?:[.\-][A-Za-z_$][\w$]*+)*+)|(?P<bare>[A-Za-z0-9+/_.=-]{8,}+)|(?P<other>\S)""",
    re.A,
)
BARE = re.compile(r"\x20*+([A-Za-z0-9+/_.=@$!%*-]{8,}+)")
IDENTIFIER = re.compile(r"[A-Za-z_$][\w$]*+(?:\.[A-Za-z_$][\w$]*+)*+", re.A)
INSIDE = {q: re.compile(rf"(?:[^{q}\\\n]|\\[\s\S])*+") for q in "\"'"} | {"`": re.compile(r"(?:[^`\\]|\\[\s\S])*+")}
BLOCK = re.compile(r"\x20*+[|>][-+]?+[^\S\n]*+\n")
BLOCK_LINE = re.compile(r"([^\S\n]++)([^\s][^\n]*+)\n?+")
#: The first arguments of calls that look like names of variables or settings are no values.
SETTING = re.compile(r"[A-Z][A-Z0-9]*+(?:_[A-Z0-9]++)++")
JOINS = {"or", "and", "if", "else", "await", "new"}


def sensitivity(name: str) -> float:
    """How much a name points to a secret: the best of its parts, 0 to 1."""
    plain = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower().replace("-", "_").replace(".", "_")
    parts = [p for p in plain.split("_") if p]
    ends = {"_".join(parts[i:j]) for i in range(len(parts)) for j in (i + 1, i + 2)} | {"".join(parts[i : i + 2]) for i in range(len(parts))}
    return max((SENSITIVE.get(e, 0.0) for e in ends), default=0.0)


def randomness(value: str) -> float:
    """0 to 1: entropy of the characters, in parts of that of a random token of the length, with mixed classes favoured."""
    if len(value) < 8:
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, entropy / math.log2(min(n, 32))) * min(1.0, 0.4 + 0.3 * (classes - 1) + 0.01 * max(0, n - 12))


@dataclass(slots=True)
class Constant:
    """A name at one of its assignments: the literals in its value, and the constants that its value names."""

    name: str
    literals: list[tuple[int, int]] = field(default_factory=list)
    parts: list[int] = field(default_factory=list)


def _target(text: str, sign: int, least: int) -> str:
    """The name before an assignment sign, not read back beyond ``least``."""
    end = sign
    while end > least and text[end - 1] in " \t":
        end -= 1
    if end > least and text[end - 1] in "\"'`":
        start = text.rfind(text[end - 1], least, end - 1)
        return text[start + 1 : end - 1] if start >= 0 and "\n" not in text[start:end] else ""
    start = end
    while start > least and (text[start - 1].isalnum() or text[start - 1] in "_$.-"):
        start -= 1
    return text[start:end].strip(".-")


def _value(text: str, at: int, known: dict[str, int], unclosed: dict[str, int], out: Constant) -> tuple[int, list[str]]:
    """Read a value expression from ``at`` into ``out``; (place where it ends, further names that are assigned in a chain)."""
    if m := BLOCK.match(text, at):
        at = m.end()
        while m := BLOCK_LINE.match(text, at):
            out.literals.append((m.start(2), m.start(2) + len(m[2].rstrip())))
            at = m.end()
        return at, []
    chain: list[str] = []
    depth, open_end, name = 0, True, ""  # open_end: the expression goes on behind a line end
    if (m := BARE.match(text, at)) and not IDENTIFIER.fullmatch(m[1]):
        out.literals.append(m.span(1))
        at, open_end = m.end(), False
    while m := TOKEN.match(text, at):
        kind, start = m.lastgroup, at
        if kind == "space":
            at = m.end()
            continue
        if name and kind != "assign":  # a name that was held back until it is known that it is no target
            called = text.startswith("(", start) and text[start - 1] == name[-1]
            prefix = kind == "quote" and len(name) <= 2 and text[start - 1] == name[-1]
            if name in known:
                out.parts.append(known[name])
            elif not (called or prefix or depth or name in JOINS):
                return start, chain
            open_end, name = name in JOINS, ""
        at = m.end()
        if kind == "line":
            if not (depth or open_end):
                follows = TOKEN.match(text, at)
                while follows and follows.lastgroup == "space":
                    at = follows.end()
                    follows = TOKEN.match(text, at)
                if not follows or follows.group() not in "+.":
                    return at, chain
        elif kind == "quote":
            quote = m.group()
            if start < unclosed.get(quote, -1):
                if not depth:
                    return at, chain
                continue
            if len(quote) == 3:
                end = text.find(quote, at)
            else:
                end = INSIDE[quote].match(text, at).end()
                if not text.startswith(quote, end):
                    unclosed[quote], end = end, -1
            if end < 0:
                unclosed[quote] = max(unclosed.get(quote, -1), len(text) if len(quote) == 3 else at)
                return at, chain
            if not (depth and SETTING.fullmatch(text, at, end)):
                out.literals.append((at, end))
            at, open_end = end + len(quote), False
        elif kind == "comment":
            if not depth:
                return at, chain  # what a comment says is read by itself
            end = text.find("\n", at)
            at = len(text) if end < 0 else end
        elif kind == "assign":
            if name and not (depth or out.literals or out.parts) and m.group() != ":":
                chain.append(name)
                name, open_end = "", True
                if (b := BARE.match(text, at)) and not IDENTIFIER.fullmatch(b[1]):
                    out.literals.append(b.span(1))
                    at, open_end = b.end(), False
                continue
            return start, chain
        elif kind == "name":
            name = m.group()
        elif kind == "bare":
            out.literals.append((start, at))
            open_end = False
        else:
            sign = m.group()
            if sign in "([":
                depth, open_end = depth + 1, False
            elif sign in ")]":
                if not depth:
                    return at, chain
                depth, open_end = depth - 1, False
            elif sign in "+|?\\":
                open_end = True
            elif not depth or sign in "{};":
                return start if sign == "{" else at, chain
    if name in known:
        out.parts.append(known[name])
    return at, chain


def constants(text: str) -> list[Constant]:
    """The assignments of a text in order; parts point to earlier ones."""
    found: list[Constant] = []
    known: dict[str, int] = {}
    unclosed: dict[str, int] = {}
    at = last = 0
    while m := SIGN.search(text, at):
        at = m.end()
        name = _target(text, m.start(), last)
        last = at
        if not name:
            continue
        one = Constant(name)
        if m.group() == "+=" and name in known:
            one.parts.append(known[name])
        at, chain = _value(text, at, known, unclosed, one)
        if one.literals or one.parts:
            for given in (name, *chain):
                known[given] = len(found)
                found.append(Constant(given, [], [len(found) - 1]) if given != name else one)
    return found


def literals(text: str) -> dict[tuple[int, int], float]:
    """Spans of literals with the greatest sensitivity of the names that they reach, constants propagated."""
    found = constants(text)
    weights = [sensitivity(c.name) for c in found]
    out: dict[tuple[int, int], float] = {}
    for k in range(len(found) - 1, -1, -1):  # later constants pass their weight on to those that they are made of
        for part in found[k].parts:
            weights[part] = max(weights[part], weights[k])
        if weights[k]:
            for span in found[k].literals:
                out[span] = max(out.get(span, 0.0), weights[k])
    return out


def spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of every secret; code points, end exclusive; by start, then kind as listed."""
    if not text:
        return []
    found = [("assign", *m.span(), 1.0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    found += [("access", *m.span(), 1.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS] if "AKIA" in text else []
    found += [("hex", *m.span(), 1.0) for m in HEX.finditer(text)]
    added: dict[tuple[int, int], float] = {}
    if "=" in text or ":" in text:
        for (start, end), weight in literals(text).items():
            if weight >= LEAST_WEIGHT and (score := math.sqrt(weight * randomness(text[start:end]))) >= THRESHOLD:
                added[start, end] = score
    found += [("literal", s, e, score) for (s, e), score in added.items()]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, score>>) of every whole text.

    A null or empty text has no spans. Repeated rows stay repeated, a null doc_id stays null, other
    columns (whatever their names) are not read; an empty table gives none.
    """
    shape = "doc_id long, spans array<struct<kind:string,start:int,end:int,score:double>>"
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in spans(x.as_py())] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out, kinds)], ["doc_id", "spans"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, shape)

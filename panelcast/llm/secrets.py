"""Secret scan with a guess-cost estimate for values in credential context.

Base kinds are patterns over the whole text, leftmost and without overlap for each kind; matches that
fail the length rule are consumed and dropped.  Values that stand behind credential words (those of
the base pattern, pwd, passphrase, authorization, bearer, ...) are judged by what guessing them would
cost, as a whole and whatever signs they hold; one that goes on beyond a base span is a span beside it,
one that lies inside it is not named again.  A dynamic program finds
the cheapest split of the value into words, dates, repeats, keyboard walks and brute-force stretches.
A value that costs 10**LEAST_COST guesses or more is a span of kind ``guess``; cheap ones are
placeholders or prose.  The program is linear in the length of the value.

Offsets are code points, end exclusive.  Nulls and empty texts have no spans.  Repeated rows and null
ids are rows like others; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelcast.llm import arrays

KINDS = ("assign", "access", "hex", "guess")
LEAST_COST = 8.0
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")  # runs are maximal, so shorter ones are those dropped
_HINTS = (b"password", b"passwd", b"secret", b"token", b"api")
_CONTEXT = re.compile(
    rb"""(?:
        (?:(?<![a-z0-9])(?:pwd|pass|passphrase|passcode|pin|credentials?|auth|authorization|bearer|private[_-]?key|access[_-]?key|client[_-]?secret|login)
            |password|passwd|secret|token|api[_-]?key)
        ["']?\x20*(?:[:=]|=>|\x20is\x20)\x20*["']?(?:bearer\x20+["']?)?
        |(?<![a-z0-9])bearer\x20+["']?
    )([^\s"'<>,;]{6,})""",
    re.I | re.X,
)
_CONTEXT_HINTS = (b"pwd", b"pass", b"pin", b"cred", b"auth", b"bearer", b"key", b"client", b"login", b"secret", b"token")
#: Bytes before the end of a cheap value where a context word may begin that goes on behind it.
_LAST_WORD = 64

# Common words of passwords and prose by rank, rows of the keyboard.
WORDS = (
    "password the and admin welcome love user login master hello dragon monkey letmein secret access test guest root "
    "shadow summer winter spring autumn flower sunshine princess football baseball soccer hockey change changeme "
    "example sample default token server system computer internet service account public private company manager "
    "office support qwerty abc iloveyou trustno superman batman michael jordan charlie thomas robert daniel jessica "
    "george freedom whatever nothing everything something please thanks you that for with this from have not are was "
    "but all your can one our out day get has him his how man new now old see two way who boy did its let put say she "
    "too use house mother father brother sister friend family world people school student teacher water fire earth "
    "silver gold blue green red black white yellow orange purple happy lucky money power king queen star moon sun"
).split()
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz")

_RANK = {w: i + 1 for i, w in enumerate(dict.fromkeys(WORDS)) if len(w) > 2}
_LONGEST = max(map(len, _RANK))
_LEET = str.maketrans("@4310$57!", "aaeiossti")
_DATE = re.compile(r"(?:19|20)\d\d[-/.]?\d\d[-/.]?\d\d|\d\d?[-/.]\d\d?[-/.](?:19|20)?\d\d|(?:19|20)\d\d")
_NEXT = {(r[i], r[i + 1]) for r in ROWS for i in range(len(r) - 1)}
_NEXT |= {(b, a) for a, b in _NEXT}
_SEGMENT = 0.3  # each further segment multiplies the guesses by two


def _spans(value: str):
    """(start, end, cost) of every segment but the brute-force ones; a few for each position."""
    low = value.lower()
    plain = low.translate(_LEET)
    n = len(value)
    for i in range(n):
        for j in range(i + 3, min(n, i + _LONGEST) + 1):
            for form, extra in ((low, 0.0), (plain, 0.5)):
                rank = _RANK.get(form[i:j])
                if rank:
                    yield i, j, math.log10(rank + 1) + (0.3 if value[i:j] != form[i:j] else 0.0) + extra * (plain != low)
    for m in re.finditer(r"(?=(" + _DATE.pattern + r"))", low):
        yield m.start(1), m.end(1), 2.0 if m.end(1) - m.start(1) == 4 else 4.6
    i = 0
    while i < n - 2:  # maximal walks over neighbouring keys, and all their ends
        j = i + 1
        while j < n and (low[j - 1], low[j]) in _NEXT:
            j += 1
        if j - i >= 3:
            yield i, j, math.log10(47 * 2 * (j - i))
        i = max(j - 1, i + 1)
    for unit in range(1, 9):  # maximal runs of a repeated unit
        i = 0
        while i + 2 * unit <= n:
            j = i + unit
            while j < n and low[j] == low[j - unit]:
                j += 1
            times = (j - i) // unit
            if times >= 2 and times * unit >= 3:
                yield i, i + times * unit, unit + math.log10(times)
            i = max(j - unit + 1, i + 1)


def guess_cost(value: str) -> float:
    """Decimal logarithm of the guesses that the cheapest segmentation needs."""
    ends: dict[int, list[tuple[int, float]]] = {}
    for i, j, c in _spans(value):
        ends.setdefault(j, []).append((i, c))
    best = [0.0] * (len(value) + 1)
    for j in range(1, len(value) + 1):
        best[j] = best[j - 1] + 1.0
        for i, c in ends.get(j, ()):
            best[j] = min(best[j], best[i] + c + (_SEGMENT if i else 0.0))
    return best[-1]


def byte_spans(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every span in bytes, in the order they are named."""
    out, low = [], raw.lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(raw) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(raw) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(raw)]
    if any(h in low for h in _CONTEXT_HINTS):
        base, at, done = list(out), 0, 0
        while m := _CONTEXT.search(raw, at):
            s, e = m.span(1)
            inside = e <= done or any(a <= s and e <= b for a, _, b in base)
            if not inside and guess_cost(m[1].decode(errors="replace")) >= LEAST_COST:
                out.append((s, 3, e))
                at = e
            else:  # a cheap value may itself end with a context word
                at = max(s, e - _LAST_WORD)
            done = max(done, e)
    return sorted(out)


def _named(raw: bytes, spans) -> list[str]:
    points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return [f"{KINDS[k]}:{points[s]}:{points[e]}" for s, k, e in spans]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds and of guesses, base_sha256 and spans of every row."""
    nothing = hashlib.sha256(b"").hexdigest()

    def body(batches):
        for batch in batches:
            data, at = arrays.utf8(batch.column(1))
            view = memoryview(data)
            rows = []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                raw = bytes(view[a:b])
                spans = byte_spans(raw)
                if spans:
                    names = _named(raw, spans)
                    base = ",".join(x for x, s in zip(names, spans, strict=True) if s[1] < 3)
                    count = [sum(s[1] == k for s in spans) for k in range(4)]
                    rows.append((*count, hashlib.sha256(base.encode()).hexdigest(), ",".join(names)))
                else:
                    rows.append((0, 0, 0, 0, nothing, ""))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.record_batch(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        body, "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string"
    )


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """*docs* with every span of its texts replaced by *mark*; n_chars, if there, follows the text."""

    def clean(raw: bytes) -> bytes:
        out, at = [], 0
        for s, _, e in byte_spans(raw):
            if s >= at:
                out += [raw[at:s], mark.encode()]
            at = max(at, e)
        return b"".join(out) + raw[at:] if out else raw

    def body(batches):
        for batch in batches:
            names = batch.schema.names
            t = names.index("text")
            old = batch.column(t)
            data, at = arrays.utf8(old)
            view = memoryview(data)
            new = [clean(bytes(view[a:b])) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            text = pa.array([x.decode() if ok else None for x, ok in zip(new, old.is_valid().to_pylist(), strict=True)], pa.string())
            columns = [text if i == t else batch.column(i) for i in range(len(names))]
            if "n_chars" in names:
                i = names.index("n_chars")
                same = pa.array([len(x) == b - a for x, a, b in zip(new, at[:-1].tolist(), at[1:].tolist(), strict=True)])
                columns[i] = pa.compute.if_else(same, columns[i], pa.compute.utf8_length(text).cast(columns[i].type))
            yield pa.record_batch(columns, names)

    import pyarrow.compute  # noqa: F401

    return docs.mapInArrow(body, docs.schema)

"""Operator 5 - secret scans.

One Aho-Corasick automaton finds keyword occurrences; an anchored regular
expression is tried only at those places, and what has an embedded checksum is
validated before it counts. Runs of hexadecimal digits have no keyword, so
their prefilter is a strided probe: a run of 24 or more covers at least four
neighbours of every sixth character, and only around such neighbours is the
text looked at.

Kinds, in their listed order:
  base kinds   assign, access, hex (spans as their patterns define them)
  added kinds  github - ``gh[pousr]_`` tokens whose last six base-62 digits are
               the CRC-32 of the thirty before; card - 13 to 19 digit card
               numbers behind a brand prefix near a card keyword, by Luhn's
               sum; iban - by ISO 7064 mod 97; jwt - three base64url parts
               whose header, a whole run of base64url signs, decodes to JSON with an ``alg``.
Added kinds never remove base spans. Spans are code points, end exclusive.

Defined cases: NULL text counts as empty (no spans, the hash of ''); very long texts
are scanned whole, in linear time; repeated rows are scanned independently; only
doc_id and text are read.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slim_batches, table, tidy

KINDS = ("assign", "access", "hex", "github", "card", "iban", "jwt")
BASE_KINDS = KINDS[:3]

_ASSIGN = re.compile(
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_GITHUB = re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
_CARD = re.compile(r"(?<![0-9])(?:[0-9][ -]?){12,18}[0-9](?![0-9])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
_HEX_PROBE = re.compile(r"[0-9a-f]{4,}")
_HEX = re.compile(r"[0-9a-f]+")
_DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Keywords in lower case, and the kind each opens.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "card": "card", "visa": "card", "mastercard": "card", "iban": "iban", "eyj": "jwt",
}
#: A card number or an IBAN is looked for in so many characters behind its keyword.
NEAR = 64
_automaton = None


def _keywords():
    global _automaton
    if _automaton is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            a.add_word(word, (len(word), kind))
        a.make_automaton()
        _automaton = a
    return _automaton


def _lower(text: str) -> str:
    """Lower case with the same length: code points that grow stay as they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(x := c.lower()) != 1 else x for c in text)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _github_valid(token: str) -> bool:
    body, check = token[4:34], token[34:]
    n = 0
    for c in check:
        n = n * 62 + _DIGITS62.index(c)
    return n == zlib.crc32(body.encode())


def _iban_valid(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _jwt_valid(token: str) -> bool:
    head = token.split(".", 1)[0]
    try:
        found = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, binascii.Error):
        return False
    return isinstance(found, dict) and "alg" in found


def _hex_spans(text: str) -> list[tuple[int, int]]:
    spans, done = [], 0
    for m in _HEX_PROBE.finditer(text[::6]):
        at = m.start() * 6
        if at < done:
            continue
        while at > done and text[at - 1] in "0123456789abcdef":
            at -= 1
        # the probe's stretch may hold several runs: look at each that touches it
        stop = (m.end() - 1) * 6 + 1
        while at < stop:
            run = _HEX.match(text, at)
            if run is None:
                run = _HEX.search(text, at, stop)
                if run is None:
                    break
                run = _HEX.match(text, run.start())
            if run.end() - run.start() >= 24:
                spans.append((run.start(), run.end()))
            at = done = run.end()
    return spans


def scan(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, each kind leftmost and non-overlapping."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    free = dict.fromkeys(KINDS, 0)
    hits = sorted({(end - n + 1, kind) for end, (n, kind) in _keywords().iter(_lower(text))})
    for at, kind in hits:
        if at < free[kind]:
            continue
        if kind == "assign":
            if m := _ASSIGN.match(text, at):
                free[kind] = m.end()
                if len(m[1]) >= 6:
                    out[kind].append(m.span())
        elif kind == "access":
            if m := _ACCESS.match(text, at):
                free[kind] = m.end()
                if m.end() - m.start() >= 20:
                    out[kind].append(m.span())
        elif kind == "github":
            if (m := _GITHUB.match(text, at)) and _github_valid(m[0]):
                free[kind] = m.end()
                out[kind].append(m.span())
        elif kind == "jwt":
            if (m := _JWT.match(text, at)) and _jwt_valid(m[0]):
                free[kind] = m.end()
                out[kind].append(m.span())
        else:
            pattern, valid = (_CARD, lambda s: _luhn(re.sub("[ -]", "", s))) if kind == "card" else (_IBAN, _iban_valid)
            for m in pattern.finditer(text, max(at, free[kind]), min(len(text), at + NEAR + 40)):
                if m.start() <= at + NEAR and valid(m[0]):
                    free[kind] = m.end()
                    out[kind].append(m.span())
    out["hex"] = _hex_spans(text)
    return out


def listed(spans: dict[str, list[tuple[int, int]]], kinds=KINDS) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    rows = sorted((s, i, e) for i, k in enumerate(kinds) for s, e in spans[k])
    return ",".join(f"{kinds[i]}:{s}:{e}" for s, i, e in rows)


def redact(text: str, spans: dict[str, list[tuple[int, int]]], mark: str = "[SECRET]") -> str:
    """The text with each maximal stretch of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for s, e in sorted(x for v in spans.values() for x in v):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long"


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n_by: dict[str, list] = {k: [] for k in BASE_KINDS}
        sha, all_spans, count = [], [], []
        for text in b.column("text").to_pylist():
            found = scan(text) if text else {k: [] for k in KINDS}
            for k in BASE_KINDS:
                n_by[k].append(len(found[k]))
            sha.append(hashlib.sha256(listed(found, BASE_KINDS).encode()).hexdigest())
            all_spans.append(listed(found))
            count.append(sum(map(len, found.values())))
        longs = lambda x: pa.array(x, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), *(longs(n_by[k]) for k in BASE_KINDS), pa.array(sha, pa.string()), pa.array(all_spans, pa.string()), longs(count)],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans"],
        )


def find(docs: DataFrame) -> DataFrame:
    """One row per document with its counts and spans; a narrow pass without shuffle."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(tidy(_scan_batches), SCHEMA)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every found span masked in ``text``, and ``n_chars`` brought up to date."""
    names = docs.columns

    def run(batches):
        for b in batches:
            texts = [None if t is None else redact(t, scan(t)) for t in b.column("text").to_pylist()]
            new = {"text": pa.array(texts, b.schema.field("text").type), "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64())}
            yield pa.RecordBatch.from_arrays([new.get(n, b.column(i)) for i, n in enumerate(names)], names=names)

    return docs.mapInArrow(tidy(run), docs.schema)


def query(spark, sf_dir):
    slim_batches(spark)
    return find(table(spark, sf_dir, "documents"))

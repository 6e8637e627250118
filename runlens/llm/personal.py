"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors of a text: at-signs, URL schemes, plus signs,
digits and cue words of identifiers. Deterministic parsers grow each anchor to the left and
right and validate what they found. Positions are code points, ends are exclusive.

Kinds and their order: email, ip, card, phone (the base kinds), then url and account.

* email: local part, at-sign, two or more dotted labels.
* ip: four dotted numbers of at most 255; a longer dotted run is cut into fours.
* card: digits with single spaces or hyphens between them, 16 to 19 of them, passing Luhn.
* phone: plus sign, digit, and digits with `space ( ) . -`, 8 to 15 digits.
* url: a scheme and what follows it up to white space, quotes or angle brackets, without
  closing punctuation.
* account: an IBAN with the right check digits and country length of 15 to 34, or 6 to 17
  digits (hyphens allowed) within 24 code points behind a cue word.

A candidate that fails its check is dropped and its characters stay consumed, as by a regular
expression that is tried once. Spans of one kind never overlap.

Null or empty text: no spans. Whole texts are read; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from runlens.llm import words

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
SCHEMES = ("http://", "https://", "ftp://", "HTTP://", "HTTPS://")
CUES = ("iban", "IBAN", "account", "Account", "acct", "SSN", "ssn", "passport", "Passport")
CUE_REACH = 24

_DIGITS = frozenset("0123456789")
_LABEL = _DIGITS | frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-")
_LOCAL = _LABEL | frozenset("._%+")
_PHONE = _DIGITS | frozenset(" ().-")
_STOP = frozenset(" \t\n\r\x0b\x0c\"'<>`")

Spans = list[tuple[int, int]]


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, keys in (("@", "@"), ("+", "+"), ("0", "0123456789"), ("url", SCHEMES), ("cue", CUES)):
        for key in keys:
            found.add_word(key, (kind, len(key)))
    found.make_automaton()
    return found


def _run(text: str, at: int, chars: frozenset[str]) -> int:
    """First position from `at` on whose character is not in `chars`."""
    n = len(text)
    while at < n and text[at] in chars:
        at += 1
    return at


def _emails(text: str, signs: list[int]) -> Spans:
    out, free = [], 0
    for sign in signs:
        start = sign
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        end = _run(text, sign + 1, _LABEL)
        if start == sign or end == sign + 1:
            continue
        labels = 0
        while text[end : end + 1] == "." and (after := _run(text, end + 1, _LABEL)) > end + 1:
            end, labels = after, labels + 1
        if labels:
            out.append((start, end))
            free = end
    return out


def _numbers(text: str, digits: list[int]) -> Spans:
    """Maximal runs of digits."""
    out: Spans = []
    for at in digits:
        if out and out[-1][1] == at:
            out[-1] = (out[-1][0], at + 1)
        else:
            out.append((at, at + 1))
    return out


def _chains(text: str, numbers: Spans, joints: str) -> list[Spans]:
    """Runs of digits that only one joint character keeps apart."""
    out: list[Spans] = []
    for a, b in numbers:
        if out and out[-1][-1][1] == a - 1 and text[a - 1] in joints:
            out[-1].append((a, b))
        else:
            out.append([(a, b)])
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def _addresses(text: str, numbers: Spans) -> Spans:
    return [
        (four[0][0], four[3][1])
        for chain in _chains(text, numbers, ".")
        for four in (chain[i : i + 4] for i in range(0, len(chain) - 3, 4))
        if all(_small(text[a:b]) for a, b in four)
    ]


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _cards(text: str, numbers: Spans) -> Spans:
    return [
        (chain[0][0], chain[-1][1])
        for chain in _chains(text, numbers, " -")
        if 16 <= sum(b - a for a, b in chain) <= 19 and luhn("".join(text[a:b] for a, b in chain))
    ]


def _phones(text: str, signs: list[int]) -> Spans:
    out, free = [], 0
    for sign in signs:
        if sign < free or text[sign + 1 : sign + 2] not in _DIGITS or sign + 1 >= len(text):
            continue
        end = _run(text, sign + 2, _PHONE)
        while end > sign + 3 and text[end - 1] not in _DIGITS:
            end -= 1
        if end <= sign + 3:
            continue
        free = end
        if 8 <= sum(c in _DIGITS for c in text[sign:end]) <= 15:
            out.append((sign, end))
    return out


def _urls(text: str, starts: list[tuple[int, int]]) -> Spans:
    out, free = [], 0
    for start, size in starts:
        if start < free:
            continue
        end, n = start + size, len(text)
        while end < n and text[end] not in _STOP:
            end += 1
        while end > start + size and text[end - 1] in ".,;:!?)]}|*$%&#":
            end -= 1
        if end > start + size:
            out.append((start, end))
            free = end
    return out


def _iban(text: str, at: int) -> int:
    """End of a valid IBAN that starts at `at`, or 0."""
    end, chars = at, []
    while end < len(text) and len(chars) < 34:
        c = text[end]
        if c.isascii() and c.isalnum():
            chars.append(c.upper())
        elif c != " " or not chars or text[end - 1] == " ":
            break
        end += 1
        if len(chars) >= 15 and chars[0].isalpha() and chars[1].isalpha() and chars[2].isdigit():
            moved = "".join(str(int(c, 36)) for c in chars[4:] + chars[:4])
            if int(moved) % 97 == 1 and not (end < len(text) and text[end].isalnum()):
                return end
    return 0


def _accounts(text: str, cues: list[tuple[int, int]]) -> Spans:
    out, free = [], 0
    for start, size in cues:
        at = start + size
        for begin in range(max(at, free), min(at + CUE_REACH, len(text))):
            before = text[begin - 1]
            if not (text[begin].isascii() and text[begin].isalnum()) or before.isalnum():
                continue
            end = _iban(text, begin)
            if not end and text[begin] in _DIGITS:
                end = _run(text, begin, _DIGITS | {"-"})
                while text[end - 1] == "-":
                    end -= 1
                if not 6 <= sum(c in _DIGITS for c in text[begin:end]) <= 17:
                    end = 0
            if end:
                out.append((begin, end))
                free = end
                break
    return out


def find(text: str | None) -> dict[str, Spans]:
    """Spans of every kind, by start."""
    hits: dict[str, list[tuple[int, int]]] = {"@": [], "+": [], "0": [], "url": [], "cue": []}
    if text:
        for last, (kind, size) in _automaton().iter(text):
            hits[kind].append((last - size + 1, size))
    only = {k: [a for a, _ in v] for k, v in hits.items()}
    numbers = _numbers(text or "", only["0"])
    return {
        "email": _emails(text or "", only["@"]),
        "ip": _addresses(text or "", numbers),
        "card": _cards(text or "", numbers),
        "phone": _phones(text or "", only["+"]),
        "url": _urls(text or "", hits["url"]),
        "account": _accounts(text or "", hits["cue"]),
    }


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: its id and `spans`, an array of (kind, start, end)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            for part in words.pieces(batch, "text"):
                out = [
                    [(k, a, b) for k, spans in find(t).items() for a, b in spans]
                    for t in part.column(1).to_pylist()
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(out, pa.list_(span))], names=["id", "spans"]
                )

    rows = docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text")
    out = rows.mapInArrow(scan, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")
    return out.withColumnRenamed("id", id_col)


def digest(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()

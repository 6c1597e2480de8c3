"""Secret scans: one Aho-Corasick pass finds keywords, anchored expressions run only at its hits, checksums confirm.

Base kinds are ``assign`` (keyword, separator, value of 12 or more characters), ``access`` (AKIA keys of 18 or more
characters) and ``hex`` (runs of 16 or more). Kind ``checked`` is added by the method: prefixed tokens whose last six
characters are the base-62 CRC-32 of the thirty before them. Nothing is shuffled: the scan is one narrow stage.

Defined results: a null or empty text has no spans; repeated rows each give a row; a null doc_id stays null; an empty
table gives an empty table; other columns are ignored. Every step is linear in the text's length.
"""

from __future__ import annotations

import itertools
import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import digest, id_and_text, map_texts

KINDS = ("assign", "access", "hex", "checked")
#: Keywords in either case, prefixes of access keys and of tokens with a checksum.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = "AKIA"
CHECKED = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

ASSIGN_AT = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS_AT = re.compile(r"AKIA[A-Z0-9]+")
CHECKED_AT = re.compile(r"[a-z]{3}_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
HEX = re.compile(r"[0-9a-f]{16,}")

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_checked long"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_checked", pa.int64())])


def either_case(word: str) -> set[str]:
    return {"".join(x) for x in itertools.product(*({c.lower(), c.upper()} for c in word))}


def automaton() -> ahocorasick.Automaton:
    """All keywords in every mixture of case, so that texts need no lower-casing, which could move offsets."""
    found = ahocorasick.Automaton()
    for word in KEYWORDS:
        for form in either_case(word):
            found.add_word(form, ("assign", len(form)))
    found.add_word(ACCESS, ("access", len(ACCESS)))
    for prefix in CHECKED:
        found.add_word(prefix, ("checked", len(prefix)))
    found.make_automaton()
    return found


def checksum(payload: str) -> str:
    """Six base-62 digits of the CRC-32."""
    left, out = zlib.crc32(payload.encode()), ""
    for _ in range(6):
        left, digit = divmod(left, 62)
        out = BASE62[digit] + out
    return out


def find_secrets(text: str, keywords: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span, in code points, by start and then kind."""
    found: list[tuple[str, int, int]] = []
    hits = sorted((end + 1 - size, kind) for end, (kind, size) in keywords.iter(text))
    past = dict.fromkeys(KINDS, 0)
    for start, kind in hits:
        if start < past[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN_AT.match(text, start):
                past[kind] = m.end()
                if m.end(2) - m.start(2) >= 12:
                    found.append((kind, start, m.end()))
        elif kind == "access":
            if m := ACCESS_AT.match(text, start):
                past[kind] = m.end()
                if m.end() - start >= 18:
                    found.append((kind, start, m.end()))
        elif m := CHECKED_AT.match(text, start):
            past[kind] = m.end()
            if checksum(m.group(1)) == m.group(2):
                found.append((kind, start, m.end()))
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def spans_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def kernel():
    keywords = automaton()

    def one(text: str) -> tuple:
        spans = find_secrets(text, keywords)
        kinds = [k for k, _, _ in spans]
        base = spans_text([x for x in spans if x[0] != "checked"])
        return kinds.count("assign"), kinds.count("access"), kinds.count("hex"), digest(base), spans_text(spans), kinds.count("checked")

    return one


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts by kind, a digest of the base spans, and all spans as ``kind:start:end``."""
    return map_texts(id_and_text(docs, id_col, text_col), kernel, SCHEMA, ARROW)

"""Secret scan: Aho-Corasick prefilter, anchored patterns near its hits, checksum validation.

One automaton finds the fixed beginnings of all kinds in one pass over the text; a pattern is
tried only where its beginning stands, which gives the same leftmost, non-overlapping matches as
a scan of the whole text. Hex runs have no fixed beginning: every run of 32 or more covers four
neighbouring multiples of 8, so only these places are probed. Tokens that carry a
checksum (six base-62 digits of a CRC-32) are reported only if it fits.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.shared import in_batches, with_value

# The words an assignment may begin with, and the prefixes of tokens that end in a checksum.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = "AKIA"
CHECKED = {"github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "npm": ("npm_",)}
KINDS = ("assign", "access", "hex", "github", "npm")
BASE = KINDS[:3]

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_CHECKED = re.compile(r"[a-z]{3}_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_STEP = 8
_HEX = np.zeros(256, bool)
_HEX[48:58] = _HEX[97:103] = True


@functools.cache
def _automaton():
    out = ahocorasick.Automaton()
    for word in ASSIGN_WORDS:
        out.add_word(word, ("assign", len(word)))
    out.add_word(ACCESS.lower(), ("access", len(ACCESS)))
    for kind, prefixes in CHECKED.items():
        for prefix in prefixes:
            out.add_word(prefix, (kind, len(prefix)))
    out.make_automaton()
    return out


def checksum(body: str) -> str:
    """Six base-62 digits of the CRC-32 of a token's body."""
    rest, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        rest, digit = divmod(rest, 62)
        out = _DIGITS[digit] + out
    return out


def _hex_runs(plain: bytes) -> list[tuple[int, int]]:
    """Byte spans of maximal runs of at least 32 of 0-9a-f."""
    codes = np.frombuffer(plain, np.uint8)
    out, end = [], 0
    probes = _HEX[codes[::_STEP]]
    four = probes[:-3] & probes[1:-2] & probes[2:-1] & probes[3:] if len(probes) > 3 else probes[:0]
    for place in np.flatnonzero(four) * _STEP:
        if place < end:
            continue
        low, high = int(place), int(place) + 1
        while low > 0 and _HEX[codes[low - 1]]:
            low -= 1
        while high < len(codes) and _HEX[codes[high]]:
            high += 1
        end = high
        if high - low >= 32:
            out.append((low, high))
    return out


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret, in code points, by start and then kind as listed."""
    raw = text.encode()
    lower = raw.lower().decode()
    found: list[tuple[int, int, str]] = []
    free = dict.fromkeys(KINDS, 0)
    hits = [(last + 1 - size, kind) for last, (kind, size) in _automaton().iter(lower)]
    for start, kind in sorted(hits):
        if start < free[kind]:
            continue
        if kind == "assign":
            match = _ASSIGN.match(text, start)
            good = match and len(match[2]) >= 8
        elif kind == "access":
            match = _ACCESS.match(text, start)
            good = match and len(match[0]) >= 16
        else:
            match = _CHECKED.match(text, start) if text.startswith(CHECKED[kind], start) else None
            good = match and checksum(match[1]) == match[2]
        if match:
            free[kind] = match.end()
            if good:
                found.append((start, match.end(), kind))
    runs = _hex_runs(raw)
    if runs and len(raw) != len(text):
        runs = [(len(raw[:low].decode()), len(raw[:high].decode())) for low, high in runs]
    found += [(low, high, "hex") for low, high in runs]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every stretch covered by spans replaced by [kind], the kind of the first one there."""
    out, at = [], 0
    for low, high, kind in spans:
        if low >= at:
            out += [text[at:low], f"[{kind}]"]
        at = max(at, high)
    return "".join(out) + text[at:]


def _listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{low}:{high}" for low, high, kind in spans)


def _report(batch: pa.RecordBatch) -> pa.RecordBatch:
    counts: dict[str, list[int]] = {k: [] for k in KINDS}
    digests, listed = [], []
    for text in batch.column(1):
        spans = scan(text.as_py() or "")
        kinds = [kind for _, _, kind in spans]
        for kind in KINDS:
            counts[kind].append(kinds.count(kind))
        digests.append(hashlib.sha256(_listed([s for s in spans if s[2] in BASE]).encode()).hexdigest())
        listed.append(_listed(spans))
    return pa.RecordBatch.from_arrays(
        [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(digests, pa.string()), pa.array(listed, pa.string()), *(pa.array(counts[k], pa.int64()) for k in KINDS[3:])],
        names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_github", "n_npm"],
    )


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans for every row of `docs` (doc_id, text).

    Null and empty texts have no secrets (the digest is that of an empty text). Repeated rows
    are scanned each; other columns are ignored; an empty table gives no rows. Spans of one kind
    never overlap, spans of different kinds may.
    """
    return in_batches(
        docs.select("doc_id", "text"),
        _report,
        "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_github bigint, n_npm bigint",
    )


def _mask_texts(texts: pa.Array) -> pa.Array:
    out = []
    for text in texts:
        value = text.as_py()
        spans = scan(value) if value else []
        out.append(mask(value, spans) if spans else value)
    return pa.array(out, pa.string())


def mask_secrets(docs: DataFrame) -> DataFrame:
    """`docs` with every secret in `text` replaced by its kind in brackets.

    All columns stay as they are otherwise; a null text stays null, an empty one empty.
    """
    found = with_value(docs, _mask_texts, T.StringType(), "masked")
    return found.select(*(F.col("masked").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))

"""Secret scans: fixed forms, and strings whose sliding windows have high Shannon entropy.

Fixed forms are assignments to a telling name, access key ids and long runs of hex digits. Beyond
them, every run of token characters, or what fixed forms leave of it, is a candidate: a window slides over it, its entropy kept up
by adding one character's count and taking one away, and the run is reported if a window reaches
the limit of the window's own character class. Identifiers and placeholders are cut out of a run
and what they leave is scanned; plain words and numbers are suppressed.

Null texts have no spans. Texts are scanned whole. Places are code points, ends exclusive. Equal
begins are ordered by kind. Repeated rows are scanned each. Only the named columns are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from parcelweave.llm.arrays import Texts, blocks
from parcelweave.llm.ship import ship

# The base forms and the order of kinds.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "entropy")

_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_HEX = np.zeros(128, bool)
_HEX[[ord(c) for c in "0123456789abcdef"]] = True
_TOKEN = np.zeros(128, bool)
_TOKEN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True
_DIGIT = np.zeros(128, bool)
_DIGIT[[ord(c) for c in "0123456789"]] = True

#: A candidate that matches is no secret: paths and dashed or underscored words, numbers, rules.
ALLOWED = (
    r"[0-9+/=_-]*",
    r"[A-Za-z+/=_-]*",
    r"[+/=_-]*([A-Za-z]+[0-9]{0,4}|[0-9]+)([+/=_-]+([A-Za-z]+[0-9]{0,4}|[0-9]+))*[+/=_-]*",
)
# Parts of a run that are no secret: identifiers in canonical form, and placeholders between signs.
_IDENTIFIER = re.compile(r"(?<![0-9A-Za-z])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9A-Za-z])")
_PLACEHOLDER = re.compile(r"example|sample|placeholder|changeme|your(?=[_-])|xxxx", re.ASCII | re.IGNORECASE)
_BETWEEN_SIGNS = re.compile(r"[0-9A-Za-z]+[_-]?")
_SIGNS = str.maketrans("", "", "+/_=-")


@dataclass(frozen=True)
class Limits:
    """Window length in characters and the least entropy in bits that makes a class suspicious."""

    window: int = 20
    hex: float = 3.0
    alnum: float = 3.6
    mixed: float = 3.8


def char_class(text: str) -> str:
    """hex (also in groups between signs), alnum (letters of one case and digits) or mixed (both cases, or signs)."""
    plain = text.translate(_SIGNS)
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", plain) and (plain == text or not (plain.isdigit() or plain.isalpha())):
        return "hex"
    return "alnum" if re.fullmatch(r"[0-9a-z]+|[0-9A-Z]+", text) else "mixed"


def entropies(text: str, window: int) -> list[float]:
    """Shannon entropy, in bits a character, of every window; of the whole if it is shorter."""
    window = min(window, len(text))
    if not window:
        return []
    part = [0.0, *(c * math.log2(c) for c in range(1, window + 2))]  # one more enters before one leaves
    counts: dict[str, int] = {}
    total = 0.0  # sum of c * log2(c) over the counts c in the window
    found = []
    for i, char in enumerate(text):
        c = counts.get(char, 0)
        total += part[c + 1] - part[c]
        counts[char] = c + 1
        if i >= window:
            old = text[i - window]
            c = counts[old]
            total += part[c - 1] - part[c]
            counts[old] = c - 1
        if i >= window - 1:
            found.append(math.log2(window) - total / window)
    return found


def window_entropy(text: str, window: int) -> float:
    """Largest entropy of any window."""
    return max(entropies(text, window), default=0.0)


def telling_entropy(text: str, limits: Limits) -> float | None:
    """Largest entropy of the windows that reach the limit of their own class; None if none does."""
    most = None
    for k, entropy in enumerate(entropies(text, limits.window)):
        if entropy >= min(limits.hex, limits.alnum, limits.mixed) and (most is None or entropy > most):
            own = text[k : k + limits.window]
            if not own.isdigit() and entropy >= getattr(limits, char_class(own)):
                most = entropy
    return most


def harmless(run: str) -> list[tuple[int, int]]:
    """Where identifiers and placeholders stand in a run."""
    found = [m.span() for m in _IDENTIFIER.finditer(run)]
    if _PLACEHOLDER.search(run):
        found += [m.span() for m in _BETWEEN_SIGNS.finditer(run) if _PLACEHOLDER.search(m[0])]
    return found


def remains(start: int, end: int, cuts: list[tuple[int, int]], least: int) -> Iterator[tuple[int, int]]:
    """What sorted ``cuts`` leave of a range, in stretches of at least ``least`` characters."""
    for s, e in [*cuts, (end, end)]:
        if min(s, end) - start >= least:
            yield start, min(s, end)
        start = max(start, e)


def scan(texts: Texts, limits: Limits, allowed: re.Pattern) -> list[list[tuple[int, int, str, float]]]:
    """For each text: (start, end, kind, entropy; 0 for fixed forms) by start, then kind."""
    found: list[list[tuple[int, int, str, float]]] = [[] for _ in range(texts.n)]
    codes = np.minimum(texts.codes, 127)  # 127 is in no class
    bounds, text = texts.bounds.tolist(), texts.text
    for i in range(texts.n):
        own = text[bounds[i] : bounds[i + 1]]
        low = own.lower()
        if any(name in low for name in _NAMES):
            found[i] += [
                (m.start(), m.end(), "assign", 0.0) for m in ASSIGN.finditer(own) if len(m[2]) >= LEAST["assign"]
            ]
        if "AKIA" in own:
            found[i] += [
                (m.start(), m.end(), "access", 0.0) for m in ACCESS.finditer(own) if len(m[0]) >= LEAST["access"]
            ]
    begins, ends = texts.runs(_HEX[codes])
    long = ends - begins >= LEAST["hex"]
    for a, b, i in zip(begins[long].tolist(), ends[long].tolist(), texts.owners(begins[long]).tolist()):
        found[i].append((a - bounds[i], b - bounds[i], "hex", 0.0))

    begins, ends = texts.runs(_TOKEN[codes])
    digits = np.concatenate(([0], np.cumsum(_DIGIT[codes])))
    long = (ends - begins >= limits.window) & (digits[ends] > digits[begins])
    for a, b, i in zip(begins[long].tolist(), ends[long].tolist(), texts.owners(begins[long]).tolist()):
        if allowed.fullmatch(text, a, b):
            continue
        first, last = a - bounds[i], b - bounds[i]
        cuts = [(s, e) for s, e, kind, _ in found[i] if kind != "entropy" and s < last and first < e]
        cuts += [(first + s, first + e) for s, e in harmless(text[a:b])]
        for start, end in remains(first, last, sorted(cuts), limits.window):
            own = text[bounds[i] + start : bounds[i] + end]
            if not allowed.fullmatch(own) and (entropy := telling_entropy(own, limits)) is not None:
                found[i].append((start, end, "entropy", entropy))
    for spans in found:
        spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return found


def _allow(patterns: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(f"(?:{p})" for p in patterns), re.DOTALL)


SPANS = ArrayType(
    StructType([
        StructField("start", IntegerType()),
        StructField("end", IntegerType()),
        StructField("kind", StringType()),
        StructField("entropy", DoubleType()),
    ])
)


def find_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    limits: Limits = Limits(),
    allowed: tuple[str, ...] = ALLOWED,
) -> DataFrame:
    """``id_col`` and ``spans`` of every row."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("entropy", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allow = _allow(allowed)
        for batch in batches:
            for block in blocks(batch, 1):
                found = scan(Texts(block.column(1)), limits, allow)
                rows = [[dict(zip(("start", "end", "kind", "entropy"), s)) for s in spans] for spans in found]
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(rows, kind)], names=[id_col, "spans"])

    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), StructField("spans", SPANS)])
    ship(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def redact(
    docs: DataFrame,
    text_col: str = "text",
    length_col: str | None = None,
    mask: str = "[SECRET]",
    limits: Limits = Limits(),
    allowed: tuple[str, ...] = ALLOWED,
) -> DataFrame:
    """The rows with every span replaced by ``mask``; spans that overlap become one.

    ``length_col`` names a column that holds the length of the text and follows it. A null text
    stays null. All other columns pass through.
    """
    at = docs.columns.index(text_col)
    length_at = docs.columns.index(length_col) if length_col else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allow = _allow(allowed)
        for batch in batches:
            for block in blocks(batch, at):
                texts, lengths = block.column(at).to_pylist(), None
                if length_at is not None:
                    lengths = block.column(length_at).to_pylist()
                for i, spans in enumerate(scan(Texts(block.column(at)), limits, allow)):
                    if spans:
                        parts, reached = [], 0
                        for start, end, _, _ in spans:
                            if start >= reached:
                                parts += [texts[i][reached:start], mask]
                            reached = max(reached, end)
                        texts[i] = "".join(parts) + texts[i][reached:]
                        if lengths is not None:
                            lengths[i] = len(texts[i])
                block = block.set_column(at, block.schema.field(at), pa.array(texts, block.schema.field(at).type))
                if lengths is not None:
                    kind = block.schema.field(length_at)
                    block = block.set_column(length_at, kind, pa.array(lengths, kind.type))
                yield block

    ship(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)

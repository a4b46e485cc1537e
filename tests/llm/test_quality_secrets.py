"""Repetition rules and secret scans against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from parcelweave.llm import quality, secrets
from parcelweave.llm.queries import QUERIES
from tests.llm.conftest import SF, texts_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_measures(text, rules):
    text = text or ""
    found = [(m.start(), m[0]) for m in WORD.finditer(text)]
    words = [w for _, w in found]
    chars = sum(map(len, words))
    seen, lines, line_chars = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            if line in seen:
                lines += 1
                line_chars += sum(map(len, WORD.findall(line)))
            seen.add(line)

    def covered(n, all_of_them):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        times, met, out = Counter(grams), set(), set()
        for i, gram in enumerate(grams):
            if times[gram] > 1 and (all_of_them or gram in met):
                out.update(range(i, i + n))
            met.add(gram)
        return out

    def top(n):
        times = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        return max((c * sum(map(len, g)) for g, c in times.items() if c > 1), default=0)

    dup = [sum(len(words[i]) for i in covered(n, False)) for n in rules.repeated]
    tops = [top(n) for n in rules.top]
    repeat = len(covered(3, True))
    base = len(words) < 50 or 100 * repeat > 50 * len(words)
    over = any(100 * d > m * chars for d, m in zip(dup, rules.repeated.values()))
    over |= any(100 * d > m * chars for d, m in zip(tops, rules.top.values()))
    over |= 100 * line_chars > rules.repeated_lines * chars
    return (
        len(words), chars, sum(text.count(c) for c in "#*$%&|<>"), lines, repeat, line_chars, tuple(dup), tuple(tops),
        base, not (base or over),
    )


@pytest.mark.parametrize("which", ["documents", "odd_docs", "no_docs"])
def test_quality(request, which):
    docs, rules = request.getfixturevalue(which), quality.Rules()
    got = Counter(
        (r["doc_id"], *[r[c] for c in quality.COUNTS], *[tuple(r[c]) for c in quality.LISTS], *[r[c] for c in quality.FLAGS])
        for r in quality.quality(docs).collect()
    )
    texts = texts_of(docs)
    assert got == Counter((i, *plain_measures(t, rules)) for i, t in texts)
    kept = quality.keep_good(docs)
    assert kept.schema == docs.schema
    assert Counter(texts_of(kept)) == Counter((i, t) for i, t in texts if plain_measures(t, rules)[-1])


def test_repetition_is_rejected_and_prose_kept(spark):
    prose = " ".join(f"word{i}" for i in range(200))
    line = "the same nine words stand in every single line"
    rows = [(1, prose), (2, "\n".join([line] * 30)), (3, prose + "\n" + "\n".join([line] * 20))]
    kept = {r["doc_id"]: r["kept"] for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {1: True, 2: False, 3: False}


def plain_base(text):
    """The base forms as stated: leftmost, failing matches dropped."""
    text, out = text or "", []
    name = "|".join("".join(f"[{c.upper()}{c}]" for c in word) for word in ("password", "passwd", "secret", "token"))
    assign = rf"""({name}|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [(m.start(), 0, m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(secrets.KINDS[k], a, b) for a, k, b in sorted(out)]


SECRET_TEXTS = [
    'x password = "hunter22" token:abcdefg', "api_key='ABCDEF' APIKEY=short ApiKey: 123456.=-/", "password=token:abcdefgh",
    "AKIA" + "A1" * 8 + " AKIAshort AKIAAKIA" + "B2" * 7, "0123456789abcdef01234567 0123456789abcdef0123456",
    "paſſword=abcdefgh Key", "key Zm9vYmFyYmF6cXV4MTIzNDU2Nzg5MGFiY2RlZg== end",
    "id 123e4567-e89b-12d3-a456-426614174000 and 11111111111111111111111", "secretsecret=secret=secret12", None, "",
]


def test_secrets_base_and_added(spark):
    docs = spark.createDataFrame(list(enumerate(SECRET_TEXTS)), "doc_id long, text string")
    for row in secrets.find_secrets(docs).collect():
        spans = [(s["kind"], s["start"], s["end"]) for s in row["spans"]]
        assert [s for s in spans if s[0] != "entropy"] == plain_base(SECRET_TEXTS[row["doc_id"]])
        assert [s[1] for s in spans] == sorted(s[1] for s in spans)
        assert (("entropy", 4, 44) in spans) == (row["doc_id"] == 6)
        assert row["doc_id"] != 7 or spans == []


def test_entropy_of_windows_by_counting():
    text = "aaaaaaaaaabcdefghij0123456789zzzz"
    for window in (1, 5, 20, 100):
        size = min(window, len(text))
        want = max(
            -sum(c / size * math.log2(c / size) for c in Counter(text[i : i + size]).values()) for i in range(len(text) - size + 1)
        )
        assert secrets.window_entropy(text, window) == pytest.approx(want)
    assert secrets.window_entropy("", 20) == 0


@pytest.mark.parametrize("which", ["documents", "odd_docs", "no_docs"])
def test_secrets_on_tables(request, which):
    docs = request.getfixturevalue(which)
    got = Counter(
        (r["doc_id"], tuple((s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] != "entropy"))
        for r in secrets.find_secrets(docs).collect()
    )
    assert got == Counter((i, tuple(plain_base(t))) for i, t in texts_of(docs))


def test_digests(spark):
    for row in QUERIES["op8_secrets"](spark, SF).collect():
        base = [s for s in row["spans"].split(",") if s and not s.startswith("entropy")]
        assert row["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert row["n_assign"] + row["n_access"] + row["n_hex"] == len(base)


def test_redaction(spark):
    rows = [(1, "say token=abcdef0123456789abcdef0123 now", 7), (2, None, None), (3, "clean", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in secrets.redact(docs, length_col="n_chars").collect()}
    assert got == {1: ("say [SECRET] now", 16), 2: (None, None), 3: ("clean", 5)}


def spans_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: [tuple(s)[:3] for s in r["spans"]] for r in secrets.find_secrets(docs).collect()}


TOKEN = "wJ4lrXUtnFq9K7MDvNGbPxRfiCY3zTQ8hLs2Ae5u"


def test_rest_of_a_run_beside_a_fixed_form(spark):
    access, digits = "AKIA" + "Q3ZT7XW9RB2MKD5H", "9f86d081884c7d659a2feaa0"
    texts = [f"a {access}/{TOKEN} b", f"a {digits}_{TOKEN} b", f"a {TOKEN}_{digits}_{TOKEN} b", f"a {access}/short1 b"]
    got = spans_of(spark, texts)
    assert got[0] == [(2, 22, "access"), (22, 63, "entropy")]
    assert got[1] == [(2, 26, "hex"), (26, 67, "entropy")]
    assert got[2] == [(2, 43, "entropy"), (43, 67, "hex"), (67, 108, "entropy")]
    assert got[3] == [(2, 22, "access")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert not any(TOKEN[8:16] in r["text"] for r in secrets.redact(docs).collect())


def test_classes_and_placeholders_of_parts(spark):
    pick = random.Random(6)
    keys = ["".join(pick.choice("0123456789ABCDEF") for _ in range(40)) for _ in range(200)]
    dashed = ["-".join(k[i : i + 8] for i in range(0, 40, 8)) for k in keys]
    for texts in ([f"{name}={k} ok" for k in keys for name in ("x", "sig")], [f"key {k.lower()} ok" for k in dashed], dashed):
        got = spans_of(spark, texts)
        assert sum(any(kind == "entropy" for _, _, kind in got[i]) for i in range(len(texts))) > 0.99 * len(texts)
    got = spans_of(spark, [f"/sample/uploads/{TOKEN}", f"example_key={TOKEN} end", f"your_{TOKEN}"])
    assert [any(a <= t and t + 40 <= b for a, b, _ in got[i]) for i, t in enumerate((16, 12, 5))] == [True] * 3
    harmless = [
        "id=123e4567-e89b-12d3-a456-426614174000", "123E4567-E89B-12D3-A456-426614174000/123e4567-e89b-12d3-a456-426614174001",
        "your_api_key_goes_here_1234", "EXAMPLEq8Zr2Lw9TnVb4XsKd7", "/data/2024/report-2024-03-17_12-30-45", "x=98765432109876543210",
    ]
    assert not any(spans_of(spark, harmless).values())

"""Pre-tokens, byte-level BPE and packing against the public libraries and brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from parcelweave.llm import bpe, packing, pretoken
from parcelweave.llm.arrays import Texts
from tests.llm.conftest import texts_of


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.RANKS), special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_boundaries_equal_the_pattern():
    pick = random.Random(3)
    alphabet = "abrevlstmd'''  \n\t\xa0\x85 12!é中ⅣA\U0001f600\x1c​́²"
    texts = ["".join(pick.choice(alphabet) for _ in range(pick.randint(0, 70))) for _ in range(5000)]
    block = Texts(pa.array([*texts, "", None, "'s", " "]))
    begins = pretoken.starts(block).tolist()
    found = [block.text[a:b] for a, b in zip(begins, [*begins[1:], len(block.text)])]
    assert found == [m for t in [*texts, "'s", " "] for m in regex.findall(public_tokenizers.PATTERN, t)]


def test_classes_follow_the_library(library):
    """Letters, numbers and white space as the library's own Unicode tables have them, on a spread of code points."""
    table = pretoken.classes()
    pick = random.Random(5)
    for code in [*range(0x250), *(pick.randrange(0x250, 0x1FFFF) for _ in range(3000))]:
        if 0xD800 <= code < 0xE000 or regex.match(r"\p{Cn}", chr(code)):
            continue
        text = f"a{chr(code)}a"
        block = Texts(pa.array([text]))
        assert bpe.encode_block(block)[0].tolist() == library.encode_ordinary(text), (hex(code), table[code])


def test_long_and_short_merges_agree():
    ranks = bpe.load_ranks(bpe.RANKS)
    pick = random.Random(1)
    for size in (1, 2, 3, 50, 700):
        piece = bytes(pick.choice(b"abcdeent the") for _ in range(size))
        assert bpe.merge_long(piece, ranks) == bpe.merge_short(piece, ranks)


def test_encode_and_decode(spark, odd_docs, odd_texts, library):
    encoded = bpe.encode(odd_docs)
    rows = encoded.collect()
    want = Counter((i, tuple(library.encode_ordinary(t or ""))) for i, t in odd_texts)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == want
    for row in rows:
        size = [len(library.decode_single_token_bytes(i)) for i in row["ids"]]
        assert row["byte_starts"] == np.cumsum([0, *size])[:-1].tolist()[: len(size)]
    back = Counter((r["doc_id"], bytes(r["decoded"])) for r in bpe.decode(encoded).collect())
    assert back == Counter((i, (t or "").encode()) for i, t in odd_texts)


def test_empty_tables(no_docs):
    assert bpe.decode(bpe.encode(no_docs)).collect() == []
    assert packing.place_pieces(packing.token_pieces(no_docs)).collect() == []


def test_patterns_hold_every_length_once():
    pick = random.Random(2)
    for histogram in ({}, {1024: 3}, {1: 5000}, {700: 10, 300: 4, 24: 90}, {n: pick.randint(0, 40) for n in range(1, 1025)}):
        patterns = packing.pack_lengths(histogram)
        used = Counter()
        for pattern, count in patterns:
            assert sum(pattern) <= 1024
            for length in pattern:
                used[length] += count
        assert used == Counter({k: v for k, v in histogram.items() if v})


def test_token_ids_equal_tokenizers(documents, tokenizer):
    for _, text in texts_of(documents):
        assert packing.token_ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def check_packing(rows, texts, tokenizer):
    """``texts``: (id, text) of all documents; a multiset of pieces must cover each exactly once."""
    want = Counter()
    for i, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for start in range(0, len(ids), 1024):
            part = ids[start : start + 1024]
            want[i, start, len(part), len(ids), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["doc_tokens"], r["ids_crc32"]) for r in rows) == want
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    return places


@pytest.mark.parametrize("which", ["documents", "odd_docs"])
def test_packing(request, which, tokenizer):
    from pyspark.sql import functions as F

    docs = request.getfixturevalue(which)
    pieces = packing.token_pieces(docs.drop("ids") if which == "odd_docs" else docs)
    placed = packing.place_pieces(pieces.withColumn("ids_crc32", F.crc32("ids"))).cache()
    places = check_packing(placed.collect(), texts_of(docs), tokenizer)
    if which == "documents":
        used = sum(length for parts in places.values() for _, length in parts)
        assert len(places) * 1024 < 1.05 * used + 1024
    packed = packing.sequences(placed).collect()
    assert len(packed) == len(places)
    for row in packed:
        assert len(row["ids"]) == 4 * sum(row["lengths"]) == 4 * sum(n for _, n in places[row["sequence_id"]])
    placed.unpersist()


def test_added_tokens_inside_texts(spark):
    """Against the library as the contract has it: added tokens are matched wherever they stand."""
    from pyspark.sql import functions as F

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"end {end} next", end, f"{end}{end}x", f" a  {end}  b\n{end}", f"<|endoftext{end}|>", "<|endoftext |>", f"don{end}'t"]
    for text in texts:
        assert packing.token_ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids
    assert packing.token_ids(texts[0]).tolist().count(50256) == 1
    long = " " * 1_200_000 + end + "x"
    spaces = bpe.encode_block(Texts(pa.array([" " * 1_200_000])))[0].tolist()
    assert packing.token_ids(long).tolist() == [*spaces, 50256, *packing.token_ids("x").tolist()]
    docs = spark.createDataFrame(list(enumerate([*texts, "a b " * 700 + end + " c" * 900])), "doc_id long, text string")
    placed = packing.place_pieces(packing.token_pieces(docs).withColumn("ids_crc32", F.crc32("ids")))
    check_packing(placed.collect(), texts_of(docs), plain)


def test_extreme_runs_fall_back():
    text = " " * 1_200_000 + "x"
    assert packing.token_ids(text).tolist() == bpe.encode_block(Texts(pa.array([text])))[0].tolist()

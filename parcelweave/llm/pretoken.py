"""Boundaries of byte-level BPE pre-tokens without a regular expression.

The pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` is a
finite automaton once the one or two characters it looks ahead are folded into the class of a
code point. Each class is a function from state to state; such functions compose associatively,
so states come from a two-level scan: compose the functions of every chunk, chain the chunks,
then run all chunks side by side from their known first states.
"""

from __future__ import annotations

import functools

import numpy as np
import regex

from parcelweave.llm.arrays import Texts

# The code points with the property White_Space.
WHITE_SPACE = (
    9, 10, 11, 12, 13, 32, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200,
    8201, 8202, 8232, 8233, 8239, 8287, 12288,
)

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
# Symbols: a code point's class with what it needs to know of what follows.
S_LETTER, S_NUMBER, S_OTHER, S_QUOTE1, S_QUOTE2, S_BLANK, S_BLANK_RUN, S_WHITE, S_WHITE_RUN = range(9)
SYMBOLS = 9
# States: what the token that holds the last character may still take.
CLOSED, LETTERS, NUMBERS, OTHERS, PREFIX, WHITES, SUFFIX1, SUFFIX2 = range(8)
STATES = 8
CHUNK = 256
SETTLES = 40


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether the character begins a token, by symbol and state.

    Symbols from SYMBOLS on are the same symbols at the begin of a text, whatever the state.
    """
    step = np.zeros((2 * SYMBOLS, STATES), np.uint8)
    opens = np.ones((2 * SYMBOLS, STATES), bool)
    alone = {
        S_LETTER: LETTERS, S_NUMBER: NUMBERS, S_OTHER: OTHERS, S_QUOTE1: SUFFIX1, S_QUOTE2: SUFFIX2,
        S_BLANK: PREFIX, S_BLANK_RUN: WHITES, S_WHITE: CLOSED, S_WHITE_RUN: WHITES,
    }
    for symbol, state in alone.items():
        step[symbol] = step[symbol + SYMBOLS] = state
    joins = [
        (S_LETTER, LETTERS, LETTERS), (S_LETTER, PREFIX, LETTERS), (S_LETTER, SUFFIX1, CLOSED),
        (S_LETTER, SUFFIX2, SUFFIX1), (S_NUMBER, NUMBERS, NUMBERS), (S_NUMBER, PREFIX, NUMBERS),
        (S_BLANK_RUN, WHITES, WHITES), (S_WHITE_RUN, WHITES, WHITES),
    ]
    joins += [(s, before, OTHERS) for s in (S_OTHER, S_QUOTE1, S_QUOTE2) for before in (OTHERS, PREFIX)]
    for symbol, before, after in joins:
        step[symbol, before] = after
        opens[symbol, before] = False
    return step, opens


STEP, OPENS = _automaton()


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point; surrogates, which no text holds, count as other."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for found in regex.finditer(pattern, every):
            first, last = (p + (0x800 if p >= 0xD800 else 0) for p in (found.start(), found.end() - 1))
            table[first : last + 1] = kind
    table[list(WHITE_SPACE)] = SPACE
    return table


def symbols(texts: Texts) -> np.ndarray:
    """The automaton's input: one symbol per code point."""
    codes, n = texts.codes, len(texts.codes)
    kind = classes()[codes]
    out = kind.copy()
    first = np.zeros(n + 1, bool)
    first[texts.bounds] = True
    white = kind == SPACE
    follows = np.zeros(n, bool)  # followed by a character of the same text that isn't white
    follows[:-1] = ~white[1:] & ~first[1:n]
    blank = codes == 32
    out[white] = np.where(
        blank[white],
        np.where(follows[white], S_BLANK, S_BLANK_RUN),
        np.where(follows[white], S_WHITE, S_WHITE_RUN),
    )
    quotes = np.flatnonzero(codes == 39)
    if len(quotes):
        padded = np.append(codes, [0, 0])
        next1 = np.where(first[quotes + 1], 0, padded[quotes + 1])
        next2 = np.where((next1 == 0) | first[np.minimum(quotes + 2, n)], 0, padded[quotes + 2])
        one = np.isin(next1, [ord(c) for c in "stmd"])
        two = np.zeros(len(quotes), bool)
        for pair in ("re", "ve", "ll"):
            two |= (next1 == ord(pair[0])) & (next2 == ord(pair[1]))
        out[quotes[one]] = S_QUOTE1
        out[quotes[two]] = S_QUOTE2
    out[first[:n]] += SYMBOLS
    return out


def states_before(symbol: np.ndarray) -> np.ndarray:
    """State before each symbol, by the scan over composed transition functions."""
    n = len(symbol)
    chunks = -(-n // CHUNK)
    padded = np.zeros(chunks * CHUNK, np.uint8)
    padded[:n] = symbol
    columns = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T).astype(np.int32) * STATES
    flat = STEP.ravel()
    whole = np.tile(np.arange(STATES, dtype=np.uint8), (chunks, 1))
    for column in columns[:SETTLES]:
        whole = flat[column[:, None] + whole]
    # Most compositions are constant by now: white space forgets what came before it.
    settled = (whole == whole[:, :1]).all(axis=1)
    open_rows = np.flatnonzero(~settled)
    rest, one = whole[open_rows], whole[:, 0].copy()
    for column in columns[SETTLES:]:
        one = flat[column + one]
        if len(open_rows):
            rest = flat[column[open_rows, None] + rest]
    whole = np.repeat(one[:, None], STATES, axis=1)
    whole[open_rows] = rest
    # Functions of chunks to functions of all chunks up to them: log2 rounds of composition.
    reach = 1
    while reach < chunks:
        whole[reach:] = np.take_along_axis(whole[reach:], whole[:-reach].copy(), axis=1)
        reach *= 2
    state = np.full(chunks, CLOSED, np.uint8)
    state[1:] = whole[:-1, CLOSED]
    before = np.empty((CHUNK, chunks), np.uint8)
    for j, column in enumerate(columns):
        before[j] = state
        state = flat[column + state]
    return before.T.ravel()[:n]


def starts(texts: Texts) -> np.ndarray:
    """Places where pre-tokens begin; each ends where the next one, or the block, begins."""
    if not len(texts.codes):
        return np.zeros(0, np.int64)
    symbol = symbols(texts)
    return np.flatnonzero(OPENS[symbol, states_before(symbol)])

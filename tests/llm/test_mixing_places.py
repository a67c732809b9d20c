"""Decisions of a context lie close together in the tables; blocks of texts are looked up symbol by symbol."""

import numpy as np
import pytest

from tidegauge.llm import mixing

LINE = 64


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 123, rng.integers(1, 9)).astype(np.uint8)) for _ in range(300)]
    texts = [b" ".join(words[i] for i in rng.zipf(1.4, n) % 300) for n in (1, 0, 40, 2500, 900, 350, 2500)]
    counts = sum(np.bincount(np.frombuffer(t, np.uint8), minlength=257) for t in texts)
    counts[256] = len(texts)
    tables = mixing.Tables(mixing.Code(counts))
    for t in texts:
        tables.add(t)
    tables.fold()
    return texts, mixing.Model(counts, [mixing.log_odds(c) for c in tables.counts])


def places(model, context, symbol):
    """Slots of a symbol's decisions from the definition."""
    code = model.code
    steps = range(int(code.offset[symbol]), int(code.offset[symbol] + code.length[symbol]))
    return [((context + int(code.stir[s]) & 0xFFFFFFFF) * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - mixing.TABLE_BITS) for s in steps]


def test_a_symbol_takes_few_cache_lines(model):
    texts, model = model
    text = texts[3]
    for h in mixing.contexts(mixing.symbols_of([text])[0]):
        own = h[max(mixing.ORDERS) : max(mixing.ORDERS) + len(text)].tolist()
        found = [places(model, c, s) for c, s in zip(own, text, strict=True)]
        lines = sum(len({at // LINE for at in one}) for one in found)
        assert lines < 2 * len(text) < sum(map(len, found)) / 1.5  # four decisions and more for a symbol


def test_slots_from_the_definition(model):
    """Contexts at the end of the table go on at its start."""
    _, model = model
    back = pow(0x85EBCA6B, -1, 1 << 32)
    known = [0, 1, 0xFFFFFFFF, *((((1 << mixing.TABLE_BITS) - d << 32 - mixing.TABLE_BITS) + 77) * back & 0xFFFFFFFF for d in (1, 2, 40, 900))]
    for context, first in zip(known, mixing.slots(np.array(known, np.uint32)).tolist(), strict=True):
        for symbol in range(mixing.END + 1):
            steps = slice(model.code.offset[symbol], model.code.offset[symbol] + model.code.length[symbol])
            want = places(model, context, symbol)
            assert ((first + model.code.near[steps]) % (1 << mixing.TABLE_BITS)).tolist() == want
            for ring, table in zip(model.rings, model.tables, strict=True):
                assert (ring[first + model.code.near[steps]] == table[want]).all()


@pytest.mark.parametrize("chunk", [7, 1 << 12])
def test_pieces_are_the_bits_in_their_order(model, monkeypatch, chunk):
    """Symbols that the edge of a block divides give each block its own bits."""
    texts, model = model
    monkeypatch.setattr(mixing, "CHUNK", chunk)
    sym, ends, own = mixing.symbols_of(texts)
    lengths = np.where(own, model.code.length.take(sym), 0)
    upto = np.cumsum(lengths)[ends]
    n_bits = np.diff(upto, prepend=0)
    longest = np.argsort(-n_bits, kind="stable")
    given = n_bits[longest], (upto - n_bits)[longest]
    plain, order = model._inputs(sym, lengths), mixing.blocks_first(*given)
    assert len(order) == lengths.sum() and (np.diff(order) != 1).sum() > 10
    for whole, part in zip(plain, model._inputs(sym, lengths, mixing.block_pieces(*given)), strict=True):
        assert (whole[..., order] == part).all()

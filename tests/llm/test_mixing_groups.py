"""Texts that are mixed side by side get what each gets alone; groups of training texts give the same tables."""

import numpy as np
import pytest

from tidegauge.llm import mixing


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(97, 123, rng.integers(1, 9)).astype(np.uint8)) for _ in range(300)]
    made = [b" ".join(words[i] for i in rng.zipf(1.4, n) % 300) for n in (0, 1, 40, 900, 3, 2500, 2500, 0, 350, 120)]
    return [*made, "é 你好".encode(), b"x" * 5000]


@pytest.fixture(scope="module")
def tables(texts):
    counts = sum(np.bincount(np.frombuffer(t, np.uint8), minlength=257) for t in texts[::2])
    counts[256] = len(texts[::2])
    out = mixing.Tables(mixing.Code(counts))
    for t in texts[::2]:
        out.add(t)
    out.fold()
    return counts, out.counts


def test_a_group_is_one_run(texts, tables, monkeypatch):
    """Each block of all texts at once, with the bits that each text has alone."""
    model = mixing.Model(tables[0], [mixing.log_odds(c) for c in tables[1]])
    alone = [model.bits([t])[0] for t in texts]
    runs, run = [], mixing.Mixer.run
    monkeypatch.setattr(mixing.Mixer, "run", lambda self, *parts: (runs.append(len(self.bits)), run(self, *parts))[1])
    small = [t for t in texts if len(t) < 6000]
    together = model.bits(small)
    assert runs == [len(small)]
    assert together == pytest.approx([a for t, a in zip(texts, alone, strict=True) if len(t) < 6000], rel=1e-6)
    monkeypatch.setattr(mixing, "GROUP", 3000)
    assert model.bits(texts) == pytest.approx(alone, rel=1e-6)


def test_blocks_first():
    first, last = mixing.FIRST_BLOCK, 2 * mixing.FIRST_BLOCK
    order = mixing.blocks_first(np.array([first + 3, first, 2]), np.array([10, 5000, 0]))
    assert order.tolist() == [*range(10, 10 + first), *range(5000, 5000 + first), 0, 1, *range(10 + first, 13 + first)]
    assert sorted(mixing.blocks_first(np.array([last * 9, last * 9]), np.array([0, last * 9]))) == list(range(last * 18))


def test_groups_of_training_texts_give_the_same_tables(texts, tables, monkeypatch):
    monkeypatch.setattr(mixing, "TRAIN_GROUP", 700)
    other = mixing.Tables(mixing.Code(tables[0]))
    for t in texts[::2]:
        other.add(t)
    other.fold()
    assert all((a == b).all() for a, b in zip(tables[1], other.counts, strict=True))

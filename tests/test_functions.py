import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from telespark.errors import CorruptedStream
from telespark.functions.checksum import crc32c, crc32c_many
from telespark.functions.shape import Mass, estimate, moment_ratio
from telespark.functions.varint import leb_decode, leb_encode, leb_lengths, unzigzag, zigzag
from telespark.operators import entropy, tokens


def test_checksum_vector_and_many_lengths():
    assert crc32c(b"123456789") == 0xE3069283
    some = [b"", b"a", b"abc" * 50, b"123456789"]
    assert crc32c_many(some).tolist() == [crc32c(x) for x in some]


def test_zigzag_and_leb_vectors():
    assert zigzag(np.array([0, -1, 1, -2, 2])).tolist() == [0, 1, 2, 3, 4]
    assert [leb_encode(np.array([v], np.uint64)).hex() for v in (0, 127, 128, 300)] == ["00", "7f", "8001", "ac02"]


@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=50))
def test_leb_round_trip(v):
    v = np.array(v, np.int64)
    raw = leb_encode(zigzag(v))
    assert len(raw) == leb_lengths(zigzag(v)).sum()
    assert unzigzag(leb_decode(raw)).tolist() == v.tolist()


@pytest.mark.parametrize("bad", [b"\x80", b"\x01\x80", b"\x80" * 10 + b"\x01"])
def test_leb_rejects(bad):
    with pytest.raises(CorruptedStream):
        leb_decode(bad)


def test_leb_reads_longer_encodings():
    assert leb_decode(b"\x81\x00").tolist() == [1]


@pytest.mark.parametrize("beta,ratio", [(0.2, 0.0629370629), (0.8, 0.4407938376), (1, 0.5), (2, 0.6366197724), (5, 0.7196847248)])
def test_moment_ratio(beta, ratio):
    assert abs(float(moment_ratio(beta)) - ratio) < 1e-9


def test_estimate_normal():
    x = np.random.default_rng(4).normal(0, 3, (1, 200_000)).astype(np.float32)
    alpha, beta = estimate(x, np.ones(x.shape, bool))
    assert abs(beta[0] - 2) < 0.12 and abs(alpha[0] - 3 * 2**0.5) < 0.12
    assert [float(v[0]) for v in estimate(np.full((1, 9), 7, np.float32), np.ones((1, 9), bool))] == [0.0, 2.0]


def test_mass_of_normal_and_laplace():
    import math

    t = np.array([[-1.0, 0.0, 0.5, 3.0]])
    mass, moment = Mass(np.array([2.0]))(t)
    assert np.allclose(mass, [[math.erf(x) / 2 for x in t[0]]], atol=1e-9)
    assert np.allclose(moment, (1 - np.exp(-(t**2))) / (2 * math.sqrt(math.pi)), atol=1e-9)
    mass, _ = Mass(np.array([1.0]))(t)
    assert np.allclose(mass, np.sign(t) * (1 - np.exp(-np.abs(t))) / 2, atol=1e-8)


def test_token_vector():
    made, n = tokens.encode(np.array([[0, 0, 0, 5, 0, -3]]), np.array([6]))
    assert made[0, : n[0]].tobytes().hex() == "0003010a00010105"


@given(st.lists(st.lists(st.sampled_from([0, 0, 0, 1, -1, 300, -70000, 2**31 - 1]), min_size=1, max_size=40), min_size=1, max_size=5))
def test_token_round_trip(rows):
    n = np.array([len(r) for r in rows])
    q = np.zeros((len(rows), n.max()), np.int64)
    for i, r in enumerate(rows):
        q[i, : len(r)] = r
    made, length = tokens.encode(q, n)
    for i, r in enumerate(rows):
        assert tokens.decode(made[i, : length[i]], len(r)).tolist() == r


@pytest.mark.parametrize("bad", [b"", b"\x00\x07", b"\x02\x01", b"\x01\x00", b"\x00\x00", b"\x00\x05\x01\x02\x01\x02", b"\x00"])
def test_token_rejects(bad):
    with pytest.raises(CorruptedStream):
        tokens.decode(np.frombuffer(bad, np.uint8), 6)


def test_frequencies():
    counts = np.zeros((2, 256), np.int64)
    counts[0, :2] = 1
    counts[1] = 1
    counts[1, 0] = 100_000
    f = entropy.normalise(counts)
    assert f[0, :2].tolist() == [2048, 2048] and (f.sum(axis=1) == 4096).all() and (f[1] > 0).all()


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 39, 100_003])
def test_entropy_round_trip(n):
    x = np.random.default_rng(19).integers(0, 64, n).astype(np.uint8)
    rows = np.zeros((2, max(n, 3)), np.uint8)
    rows[0, :n] = x
    rows[1, :3] = 9
    made = entropy.encode(rows, np.array([n, 3]))
    back = entropy.decode(made, None, np.array([n, 3]))
    assert back[0].tolist() == x.tolist() and back[1].tolist() == [9, 9, 9]


def test_entropy_rejects_every_truncation_and_finds_flips():
    x = np.random.default_rng(2).integers(0, 9, (1, 300)).astype(np.uint8)
    p = entropy.encode(x, np.array([300]))[0]
    for n in range(len(p)):
        with pytest.raises(CorruptedStream):
            entropy.decode([p[:n]], np.array([300]), np.array([300]))
    for bit in range(0, 8 * len(p), 7):
        q = bytearray(p)
        q[bit // 8] ^= 1 << bit % 8
        try:
            got = entropy.decode([bytes(q)], np.array([300]), np.array([300]))[0]
        except CorruptedStream:
            continue
        assert len(got) == 300


def test_code_books():
    from telespark.operators.quantizer import CodeBook, Sorted, best_of, cell_symbols, quantize, symbols_of_cells

    r = np.random.default_rng(2)
    x = r.laplace(size=5000)
    plain, coded = CodeBook(x, 8), CodeBook(x, 8, weight=0.3)
    loss = lambda b: np.mean((x - b.dequantize(b.quantize(x))) ** 2)
    bits = lambda b: -sum(p * np.log2(p) for p in np.bincount(b.quantize(x)) / len(x) if p)
    uniform = np.linspace(x.min(), x.max(), 9)
    middles = 0.5 * (uniform[1:] + uniform[:-1])
    assert loss(plain) < np.mean((x - middles[np.clip(np.searchsorted(uniform, x) - 1, 0, 7)]) ** 2) and bits(coded) < bits(plain) and loss(coded) > loss(plain)
    # at the optimum boundaries are the middles of the levels, and levels the means of their cells
    assert np.allclose(plain.bounds, 0.5 * (plain.levels[1:] + plain.levels[:-1]), atol=0.02)
    smooth = plain.polynomial()
    assert (plain.polynomial_cell(x, smooth) == plain.quantize(x)).all()
    on = plain.bounds[2]
    assert quantize(np.array([on]), plain.bounds) == 3 and quantize(np.array([on]), plain.bounds, lower_ties=True) == 2
    assert symbols_of_cells(5).tolist() == [1, 2, 0, 3, 4] and sorted(cell_symbols(np.arange(7), np.int64(7))) == list(range(7))
    for bad in (lambda: CodeBook(x, 1), lambda: CodeBook([np.nan], 4), lambda: CodeBook(x, 2).polynomial()):
        with pytest.raises(ValueError):
            bad()
    # cells by prefix sums against counting
    rows = r.normal(size=(3, 400))
    data = Sorted(rows)
    edges = np.sort(r.normal(size=(3, 6)), axis=1)
    count, total = data.cells(edges)
    for i in range(3):
        cell = np.searchsorted(edges[i], rows[i], side="right")
        assert count[i].tolist() == np.bincount(cell, minlength=7).tolist() and np.allclose(total[i], np.bincount(cell, weights=rows[i], minlength=7))
    made, cost = best_of(data, np.full(3, 400.0), 3.0, 0.3, (0.0, 0.25), np.full(3, 178.0))
    assert (cost.bytes <= 400).all() and (made.cells % 2 == 1).all()


def test_checksums_of_all_lengths():
    from telespark.functions.checksum import crc32c, crc32c_many

    def plain(data):
        state = 0xFFFFFFFF
        for byte in data:
            state ^= byte
            for _ in range(8):
                state = (state >> 1) ^ (0x82F63B78 if state & 1 else 0)
        return state ^ 0xFFFFFFFF

    r = np.random.default_rng(1)
    strings = [r.integers(0, 256, n, dtype=np.uint8).tobytes() for n in [*range(0, 140), 1000, 4095, 4096, 4097]]
    assert crc32c_many(strings).tolist() == list(map(plain, strings)) and crc32c(b"123456789") == 0xE3069283 and not len(crc32c_many([]))

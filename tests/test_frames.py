import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from telespark.config import BLOCK, CodecConfig
from telespark.errors import CorruptedStream, DeprecatedWireFormat, RateBudgetExceeded, UnsupportedWireFormat
from telespark.functions.checksum import crc32c
from telespark.operators import predictor
from telespark.operators.codec import as_rows
from telespark.sources.frame import IndexedView, StreamDecoder, StreamEncoder, compress, decompress, decompress_slice


def waves(n, a=0.017, b=0.071):
    i = np.arange(n)
    return (np.sin(a * i) + 0.31 * np.cos(b * i)).astype(np.float32)


def test_predictors():
    const, sine = np.full(64, 7, np.float32), np.sin(0.31 * np.arange(2048)).astype(np.float32)
    assert predictor.choose(*as_rows([const]))[0].tolist() == [0]
    x, n = as_rows([sine])
    mode, pole = predictor.choose(x, n)
    assert mode.tolist() == [1]
    r = predictor.residuals(x, mode, pole)
    linear = predictor.residuals(x, np.array([2]), np.zeros(1, np.float32))
    assert r.var() <= 0.70 * linear.var()
    assert np.abs(predictor.reconstruct(r, mode, pole) - x).max() < 1e-3


def test_hand_derived_frame():
    f = compress(np.zeros(1, np.float32), absolute_error=0.1)
    assert len(f) == 256
    assert f[:24].hex() == "485445410600000001000000000000000100000001000000" and not any(f[24:64])
    assert f[64:96].hex() == "b00000000100000000010000" + "00000000cdcc4c3e00000040" + "0000000094000000"
    assert f[96:112].hex() == "41535231" + "0200000000000000" + "0200" + "0000"[:4]
    assert struct.unpack_from("<I", f, 64 + 4 + 176)[0] == 0x5C1A4C6B
    assert decompress(f).tolist() == [0.0]


def test_empty_frames():
    assert compress(np.zeros(0, np.float32), absolute_error=0.1).hex() == "4854454106000000" + "00" * 12 + "01000000" + "00" * 40
    assert len(compress(np.zeros(0, np.float32), absolute_error=0.1, enable_index=True)) == 76
    with pytest.raises(RateBudgetExceeded):
        compress(np.zeros(0, np.float32))


def test_error_bound():
    i = np.arange(10_000)
    x = (0.5 * np.sin(0.01 * i) + 0.1 * np.cos(0.17 * i)).astype(np.float32)
    assert np.abs(decompress(compress(x, absolute_error=0.005)) - x).max() <= 0.005001


@pytest.mark.parametrize("rate", [2.0, 3.0, 4.0])
def test_rate_budget(rate):
    i = np.arange(32_768)
    x = (np.sin(0.013 * i) + 0.02 * np.cos(0.19 * i)).astype(np.float32)
    f = compress(x, rate)
    assert len(f) * 8 <= len(x) * rate
    assert np.isfinite(decompress(f)).all()


def test_mse_of_a_mixture():
    t = np.arange(10_137) / 1000
    x = (0.3 * np.sin(3 * t) + np.sin(17 * t) + 0.02 * np.cos(79 * t)).astype(np.float32)
    assert np.mean((decompress(compress(x, 4.0)) - x) ** 2) < 0.05


def test_short_input_fails_in_rate_mode():
    with pytest.raises(RateBudgetExceeded):
        compress(np.zeros(8, np.float32), 2.0)


def test_tail_guard():
    x = np.random.default_rng(41).normal(0, 0.02, 16_384).astype(np.float32)
    x[[7000, 7003, 7010, 7500, 9000, 12_000]] = [7, -8, 9, -7, 8, -9]
    with_tail, without = (np.mean((decompress(compress(x, 4.0, adaptive_tail=t)) - x) ** 2) for t in (True, False))
    assert with_tail <= without


def test_zero_runs_are_small():
    x = np.zeros(100_000, np.float32)
    x[::10_000] = 1
    assert len(compress(x, absolute_error=0.001)) < x.nbytes / 20


@pytest.mark.parametrize("settings_", [{"target_rate": 4.0}, {"absolute_error": 0.002}])
def test_slices_equal_full(settings_):
    x = waves(7 * BLOCK + 317)
    f = compress(x, enable_index=True, **settings_)
    y = decompress(f)
    view, n = IndexedView(f), len(x)
    for a, c in [(0, 1), (17, 301), (2025, 97), (4096, 2048), (6143, 4105), (n - 211, 211), (n, 0)]:
        assert view.slice(a, c).tobytes() == y[a : a + c].tobytes()
    for a, c in [(-1, 2), (n, 1), (0, n + 1)]:
        with pytest.raises(IndexError):
            view.slice(a, c)
    with pytest.raises(CorruptedStream):
        decompress_slice(compress(x, **settings_), 0, 1)
    bad = bytearray(f)
    bad[-9] ^= 1
    with pytest.raises(CorruptedStream):
        IndexedView(bytes(bad))


def test_versions_and_header():
    f = bytearray(compress(np.linspace(-1, 1, 4096).astype(np.float32), absolute_error=0.01))
    indexed = bytearray(compress(np.linspace(-1, 1, 4096).astype(np.float32), absolute_error=0.01, enable_index=True))
    for version, error in ((4, UnsupportedWireFormat), (7, UnsupportedWireFormat)):
        f[4] = version
        with pytest.raises(error):
            decompress(bytes(f))
    f[4] = 5
    assert len(decompress(bytes(f))) == 4096
    indexed[4] = 5
    with pytest.raises(DeprecatedWireFormat):
        decompress(bytes(indexed))
    f[4] = 6
    for at in (6, 21, 24, 63):
        g = bytearray(f)
        g[at] ^= 0x40
        with pytest.raises(CorruptedStream):
            decompress(bytes(g))


def test_truncations_and_flips():
    f = compress(waves(4096), 4.0, enable_index=True)
    for n in [*range(200), *range(200, len(f), 13), len(f) - 1]:
        with pytest.raises(CorruptedStream):
            decompress(f[:n])
    for at in range(0, 512):
        g = bytearray(f)
        g[at] ^= 1 << at % 8
        with pytest.raises(CorruptedStream):
            decompress(bytes(g))
    with pytest.raises(CorruptedStream):
        decompress(b"AETH")
    with pytest.raises(CorruptedStream):
        decompress(f, 4095)


def patched(f, at, value):
    """The frame with bytes of its first body changed and the checksum made right."""
    g = bytearray(f)
    g[68 + at : 68 + at + len(value)] = value
    size = struct.unpack_from("<I", g, 64)[0]
    g[68 + size : 72 + size] = struct.pack("<I", crc32c(bytes(g[68 : 68 + size])))
    return bytes(g)


@pytest.mark.parametrize("at,value", [(0, b"\0\0\0\0"), (0, struct.pack("<I", 2049)), (4, b"\3"), (5, b"\1"), (5, b"\2"), (6, b"\1"), (8, struct.pack("<f", float("nan"))), (12, struct.pack("<f", -1)), (16, struct.pack("<f", 0.1)), (16, struct.pack("<f", 6)), (20, struct.pack("<H", 257)), (20, struct.pack("<H", 3)), (22, b"\1"), (24, struct.pack("<I", 1)), (28, struct.pack("<f", float("inf")))])
def test_crafted_metadata(at, value):
    with pytest.raises(CorruptedStream):
        decompress(patched(compress(waves(2048), 4.0), at, value))


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), -float("inf")])
def test_non_finite_input(bad):
    x = waves(100)
    x[50] = bad
    for s in ({"target_rate": 4.0}, {"absolute_error": 0.1}):
        with pytest.raises(ValueError):
            compress(x, **s)


@pytest.mark.parametrize("bad", [{"target_rate": 1.9}, {"target_rate": 8.1}, {"target_rate": float("nan")}, {"deadzone": -1}, {"absolute_error": -0.1}, {"absolute_error": float("inf")}])
def test_settings(bad):
    with pytest.raises(ValueError):
        CodecConfig(**bad)


@pytest.mark.parametrize("settings_", [{"target_rate": 3.0}, {"absolute_error": 0.005}])
def test_streams_equal_batch(settings_):
    r = np.random.default_rng(7)
    x = (np.cumsum(r.normal(0, 0.01, 20_003)) + np.sin(0.13 * np.arange(20_003))).astype(np.float32)
    encoder, decoder, sent, got, at = StreamEncoder(**settings_), StreamDecoder(), b"", [], 0
    while at < len(x):
        n = int(r.integers(13, 258))
        sent += encoder.feed(x[at : at + n])
        at += n
    sent += encoder.flush()
    assert encoder.flush() == b""
    at = 0
    while at < len(sent):
        n = int(r.integers(1, 998))
        got.append(decoder.feed(sent[at : at + n]))
        at += n
    decoder.flush()
    assert np.concatenate(got).tobytes() == decompress(compress(x, **settings_)).tobytes()
    decoder.feed(sent[:100])
    with pytest.raises(CorruptedStream):
        decoder.flush()


def test_bad_packet_leaves_the_encoder_as_it_was():
    encoder = StreamEncoder(absolute_error=0.1)
    encoder.feed(np.zeros(2000, np.float32))
    with pytest.raises(ValueError):
        encoder.feed(np.array([np.nan] * 100, np.float32))
    assert len(decompress(encoder.feed(np.zeros(48, np.float32)))) == BLOCK


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(-1000, 1000, width=32), min_size=1, max_size=300), st.sampled_from([0.001, 0.1, 5.0]))
def test_bound_on_any_values(values, bound):
    x = np.array(values, np.float32)
    y = decompress(compress(x, absolute_error=bound))
    assert (np.abs(x - y) <= bound + 4 * np.finfo(np.float32).eps * np.maximum(1, np.abs(x)) + 1e-12).all()

import struct

import numpy as np
import pyarrow as pa
import pytest

from telespark.errors import CorruptedStream
from telespark.functions.varint import leb_encode, zigzag
from telespark.operators import quality
from telespark.sources.arrowbox import compress_arrow, decompress_arrow
from telespark.sources.seismic import decode_mseed
from telespark.sources.timeseries import parse_line, parse_lines, read_chunk, write_chunk


@pytest.mark.parametrize(
    "line,name,point",
    [
        ("m value=1.5 10", "", (10, 1.5)),
        ("m,tag=a\\ b value=3i -7", "value", (-7, 3.0)),
        ('m note="a b,c=1",value=2u 5', "value", (5, 2.0)),
        ("m on=true,x=4 5", "", (5, 4.0)),
        ("# a=1 5", "", (5, 1.0)),
    ],
)
def test_lines(line, name, point):
    assert parse_line(line, name) == point


@pytest.mark.parametrize("line", ["m", "m value=1", "m value=1 ", "m value=1 x", "m =1 5", "m value= 5", "m on=true 5", "m on=t 5", "m v=nan 5", "m v=1e99 5", "m v=1 99999999999999999999", "m v=1_0 5"])
def test_bad_lines(line):
    with pytest.raises(ValueError):
        parse_line(line)


def test_texts():
    ts, v = parse_lines("m v=1 1\r\n\nm v=2 2\n")
    assert ts.tolist() == [1, 2] and v.tolist() == [1, 2]


def test_chunks():
    ts = 1672531199 * 10**9 + np.arange(5000) * 10**7
    v = np.sin(0.01 * np.arange(5000)).astype(np.float32)
    c = write_chunk(ts, v, absolute_error=1e-4)
    back, got = read_chunk(c)
    assert (back == ts).all() and np.abs(got - v).max() <= 1.01e-4
    small = write_chunk(np.array([1000, 1010, 1020, 1035, 1040]), np.zeros(5, np.float32), absolute_error=0.1)
    assert small[20:24].hex() == leb_encode(zigzag(np.array([10, 0, 5, -10]))).hex() == "14000a13"
    for bad in (b"", c[:19], b"x" + c[1:], c[:-1], c[:4] + struct.pack("<I", 4999) + c[8:]):
        with pytest.raises(CorruptedStream):
            read_chunk(bad)
    for t in ([1, 1], [2, 1]):
        with pytest.raises(ValueError):
            write_chunk(np.array(t), np.zeros(2, np.float32), absolute_error=0.1)
    with pytest.raises(ValueError):
        write_chunk(np.array([1]), np.zeros(2, np.float32), absolute_error=0.1)


def test_arrow_container():
    i = np.arange(20_000)
    x = (np.sin(0.013 * i) + 0.1 * np.cos(0.071 * i)).astype(np.float32)
    column = pa.chunked_array([x[:12_000], x[12_000:]])
    box = compress_arrow(column, 4.0)
    from telespark.sources.frame import compress, decompress

    want = np.concatenate([decompress(compress(p, 4.0)) for p in (x[:12_000], x[12_000:])])
    assert decompress_arrow(box, 20_000).to_numpy().tobytes() == want.tobytes()
    with pytest.raises(TypeError):
        compress_arrow(pa.array([1.0]))
    with pytest.raises(ValueError):
        compress_arrow(pa.array([1.0, None], pa.float32()))
    for data, n in ((box, 19_999), (bytes(box)[:10], 20_000), (bytes(box)[:-1], 20_000), (b"XXXX" + bytes(box)[4:], 20_000)):
        with pytest.raises((ValueError, CorruptedStream)):
            decompress_arrow(data, n)


def record(encoding, count, words, first, last, order=">"):
    head = bytearray(64)
    struct.pack_into(order + "HH", head, 20, 2020, 100)
    struct.pack_into(order + "H", head, 30, count)
    struct.pack_into(order + "HH", head, 44, 64, 48)
    struct.pack_into(order + "HH", head, 48, 1000, 0)
    head[52:56] = bytes([encoding, 1 if order == ">" else 0, 9, 0])
    control = 0
    body = [0, first & 0xFFFFFFFF, last & 0xFFFFFFFF, *(w for w, _ in words)]
    for i, (_, c) in enumerate(words):
        control |= c << (30 - 2 * (i + 3))
    body[0] = control
    body += [0] * (16 - len(body))
    data = struct.pack(order + "16I", *body)
    return bytes(head) + data + bytes(512 - 64 - len(data))


def test_steim():
    one = record(10, 4, [(0x0001FE05, 1)], 100, 104)
    assert decode_mseed(one).tolist() == [100, 101, 99, 104]
    two = record(11, 3, [(0xC00CE007, 2)], 500, 307)
    assert decode_mseed(two).tolist() == [500, 300, 307]
    assert decode_mseed(one + two).tolist() == [100, 101, 99, 104, 500, 300, 307]
    with pytest.raises(ValueError):
        decode_mseed(record(10, 4, [(0x0001FE05, 1)], 100, 105))
    with pytest.raises(ValueError):
        decode_mseed(record(11, 3, [(0x000CE007, 2)], 500, 307))
    for bad in (b"", one[:40], one[:300]):
        with pytest.raises(ValueError):
            decode_mseed(bad)


@pytest.mark.parametrize("encoding,kind", [(1, "h"), (3, "i"), (4, "f"), (5, "d")])
def test_plain_encodings(encoding, kind):
    r = bytearray(record(encoding, 3, [], 0, 0, "<"))
    struct.pack_into("<3" + kind, r, 64, 1, -2, 3)
    assert decode_mseed(bytes(r)).tolist() == [1, -2, 3]
    struct.pack_into("<H", r, 30, 60_000)
    with pytest.raises(ValueError):
        decode_mseed(bytes(r))


def test_baselines():
    x = np.random.default_rng(1).normal(size=1000).astype(np.float32)
    assert quality.unshuffle_bytes(quality.shuffle_bytes(x)).tobytes() == x.tobytes()
    assert quality.undo_lossless(quality.lossless(x)).tobytes() == x.tobytes()

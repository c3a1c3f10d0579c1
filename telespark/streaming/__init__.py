"""Live series on Structured Streaming: the same blocks as a batch makes, from packets of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import CodecConfig
from ..errors import CorruptedStream
from ..session import ready
from ..sources.frame import StreamDecoder, StreamEncoder

FRAMES = "stream_id string, seq long, frame binary"
SAMPLES = "stream_id string, seq long, sample_idx long, values array<float>"


def encode_stream(packets: DataFrame, config: CodecConfig) -> DataFrame:
    """(stream_id, seq, frame) of packets (stream_id, seq, values array<float>, last boolean).

    State is at most one block of samples per stream. Every full block leaves as a frame of its own; a packet marked last, also an empty one,
    lets the short rest out. Packets of a stream must come in the order of seq: one behind what the stream has seen fails the query, as
    the codec has no place for late samples. A rate-mode rest too small for its framing fails likewise.
    """
    ready(packets.sparkSession)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, out_seq, held = state.get if state.exists else (-1, 0, b"")
        made = StreamEncoder(config.target_rate, config.absolute_error, config.deadzone)
        made.held = np.frombuffer(held, np.float32)
        rows = pd.concat(list(parts)).sort_values("seq")
        frames = []
        for seq, values, last in zip(rows["seq"], rows["values"], rows["last"], strict=True):
            if seq <= seen:
                raise ValueError(f"packet {seq} of stream {key[0]} is late")
            seen = int(seq)
            frames += split(made.feed(np.asarray(values if values is not None else [], np.float32)))
            if last:
                frames += split(made.flush())
        state.update((seen, out_seq + len(frames), made.held.astype("<f4").tobytes()))
        yield pd.DataFrame({"stream_id": [key[0]] * len(frames), "seq": range(out_seq, out_seq + len(frames)), "frame": frames})

    return packets.select("stream_id", "seq", "values", "last").groupBy("stream_id").applyInPandasWithState(step, FRAMES, "seen long, out_seq long, held binary", "append", GroupStateTimeout.NoTimeout)


def split(data: bytes) -> list[bytes]:
    """Frames in a row, one by one."""
    from ..sources.frame import frame_length

    out = []
    while data:
        n = frame_length(data)
        if n is None:
            raise CorruptedStream("the stream ends within a frame")
        out.append(data[:n])
        data = data[n:]
    return out


def decode_stream(fragments: DataFrame) -> DataFrame:
    """(stream_id, seq, sample_idx, values) of byte fragments (stream_id, seq, chunk) cut anywhere; state is an incomplete frame's bytes."""
    ready(fragments.sparkSession)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, samples, held = state.get if state.exists else (-1, 0, b"")
        decoder = StreamDecoder()
        decoder.held = bytes(held)
        rows = pd.concat(list(parts)).sort_values("seq")
        out = []
        for seq, chunk in zip(rows["seq"], rows["chunk"], strict=True):
            if seq <= seen:
                raise ValueError(f"fragment {seq} of stream {key[0]} is late")
            seen = int(seq)
            values = decoder.feed(chunk)
            if len(values):
                out.append((key[0], seen, samples, values.tolist()))
                samples += len(values)
        state.update((seen, samples, decoder.held))
        yield pd.DataFrame(out, columns=["stream_id", "seq", "sample_idx", "values"])

    return fragments.select("stream_id", "seq", "chunk").groupBy("stream_id").applyInPandasWithState(step, SAMPLES, "seen long, samples long, held binary", "append", GroupStateTimeout.NoTimeout)

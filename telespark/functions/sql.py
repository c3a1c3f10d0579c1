"""Functions for SQL: register() makes them known to a session.

Scalar functions work on Arrow batches; tel_estimate_ged aggregates; the tel_read_* and tel_parse_lines functions make tables:

    SELECT s.series_id, t.* FROM frames s, LATERAL tel_read_frame(s.frame) t
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from ..session import ready


def register(spark: SparkSession) -> SparkSession:
    """tel_crc32c, tel_encode_frame, tel_decode_frame, tel_estimate_ged, tel_read_frame, tel_read_index, tel_read_chunk, tel_parse_lines, tel_read_mseed."""
    ready(spark)

    @pandas_udf("bigint")
    def crc(data: pd.Series) -> pd.Series:
        from telespark.functions.checksum import crc32c_many

        made = crc32c_many([b"" if x is None else bytes(x) for x in data]).astype(np.int64)
        return pd.Series(made).where(data.notna().to_numpy()).astype("Int64")

    @pandas_udf("binary")
    def encode(values: pd.Series, rate: pd.Series, error: pd.Series) -> pd.Series:
        from telespark.sources.frame import compress

        return pd.Series([None if v is None else compress(v, r, e) for v, r, e in zip(values, rate, error, strict=True)])

    @pandas_udf("array<float>")
    def decode(data: pd.Series) -> pd.Series:
        from telespark.sources.frame import decompress

        return pd.Series([None if x is None else decompress(bytes(x)) for x in data])

    @pandas_udf("array<float>")
    def ged(residuals: pd.Series) -> list:
        from telespark.functions.shape import estimate

        x = residuals.dropna().to_numpy(np.float32)[None, :]
        alpha, beta = estimate(x, np.ones(x.shape, bool))
        return [float(alpha[0]), float(beta[0])]

    for name, f in (("tel_crc32c", crc), ("tel_encode_frame", encode), ("tel_decode_frame", decode), ("tel_estimate_ged", ged)):
        spark.udf.register(name, f)

    @udtf(returnType="sample_idx bigint, value float")
    class ReadFrame:
        def eval(self, data: bytes) -> Iterator[tuple]:
            from telespark.sources.frame import decompress

            yield from enumerate(decompress(bytes(data)).tolist())

    @udtf(returnType="block_no bigint, byte_offset bigint, start_sample bigint, sample_count bigint")
    class ReadIndex:
        def eval(self, data: bytes) -> Iterator[tuple]:
            from telespark.sources.frame import IndexedView

            for i, e in enumerate(IndexedView(bytes(data)).entries):
                yield (i, *e)

    @udtf(returnType="i bigint, ts bigint, value float")
    class ReadChunk:
        def eval(self, data: bytes) -> Iterator[tuple]:
            from telespark.sources.timeseries import read_chunk

            ts, value = read_chunk(bytes(data))
            for i, row in enumerate(zip(ts.tolist(), value.tolist(), strict=True)):
                yield (i, *row)

    @udtf(returnType="ts bigint, value float")
    class ParseLines:
        def eval(self, text: str, name: str) -> Iterator[tuple]:
            from telespark.sources.timeseries import parse_lines

            ts, value = parse_lines(text or "", name or "")
            yield from zip(ts.tolist(), value.tolist(), strict=True)

    @udtf(returnType="sample_idx bigint, value double")
    class ReadMseed:
        def eval(self, data: bytes) -> Iterator[tuple]:
            from telespark.sources.seismic import decode_mseed

            yield from enumerate(decode_mseed(bytes(data)).astype(float).tolist())

    for name, t in (("tel_read_frame", ReadFrame), ("tel_read_index", ReadIndex), ("tel_read_chunk", ReadChunk), ("tel_parse_lines", ParseLines), ("tel_read_mseed", ReadMseed)):
        spark.udtf.register(name, t)
    return spark

import numpy as np

from telespark.functions.sql import register
from telespark.sources.frame import compress
from telespark.sources.timeseries import write_chunk


def test_functions_in_sql(spark):
    register(spark)
    x = np.sin(0.1 * np.arange(5000)).astype(np.float32)
    rows = [("a", bytearray(compress(x, absolute_error=0.01, enable_index=True)), bytearray(write_chunk(np.arange(1, 5001), x, absolute_error=0.01)))]
    spark.createDataFrame(rows, "id string, frame binary, chunk binary").createOrReplaceTempView("held")
    assert spark.sql("SELECT tel_crc32c(CAST('123456789' AS BINARY)) AS c, tel_crc32c(CAST(NULL AS BINARY)) AS n").first()[:] == (0xE3069283, None)
    got = [r.value for r in spark.sql("SELECT t.* FROM held, LATERAL tel_read_frame(frame) t ORDER BY sample_idx").collect()]
    assert np.abs(np.array(got) - x).max() <= 0.0101
    assert [tuple(r)[2:] for r in spark.sql("SELECT t.* FROM held, LATERAL tel_read_index(frame) t ORDER BY 1").collect()] == [(0, 2048), (2048, 2048), (4096, 904)]
    assert spark.sql("SELECT max(ts), count(*) FROM (SELECT t.* FROM held, LATERAL tel_read_chunk(chunk) t)").first()[:] == (5000, 5000)
    assert [tuple(r) for r in spark.sql("SELECT * FROM tel_parse_lines('m v=1 5\nm v=2 6', 'v')").collect()] == [(5, 1.0), (6, 2.0)]
    both = spark.sql("SELECT tel_decode_frame(frame) AS d, tel_decode_frame(tel_encode_frame(tel_decode_frame(frame), 4D, 0.01D)) AS e FROM held").first()
    assert len(both.d) == len(both.e) == 5000
    spark.createDataFrame([(float(v),) for v in np.random.default_rng(3).normal(size=20_000)], "v float").createOrReplaceTempView("normal")
    alpha, beta = spark.sql("SELECT tel_estimate_ged(v) AS g FROM normal").first()["g"]
    assert abs(alpha - 2**0.5) < 0.15 and abs(beta - 2) < 0.2

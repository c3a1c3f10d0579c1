import os

import pytest

pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_stages_against_their_parts(spark):
    """Each stage on what its predecessor kept: columns stay, decisions take effect, nothing else changes."""
    import corpus_pipeline as P
    from telespark.llm import near_dedup, packing, secrets, toxicity
    from telespark.llm.common import materialise, table
    from telespark.llm.queries import vocabulary

    docs = table(spark, SF, "documents")
    stages = dict(P.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "secrets", "mixing", "packing"]
    clean = materialise(stages["toxicity"](spark, docs, SF))
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, SF, "labels")))
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in scored.where("predicted = 0").collect()}
    single = materialise(stages["near_dedup"](spark, clean, SF))
    assert single.columns == docs.columns
    assert {r.doc_id for r in single.collect()} == {r.component_id for r in near_dedup.near_groups(clean).collect()}
    masked = materialise(stages["secrets"](spark, single, SF))
    assert masked.columns == docs.columns
    before = {r.doc_id: r.text for r in single.collect()}
    for r in masked.collect():
        assert r.text == secrets.redact(before[r.doc_id], secrets.scan(before[r.doc_id])[1]) and r.n_chars == len(r.text)
    mixed = materialise(stages["mixing"](spark, masked, SF))
    assert mixed.columns == docs.columns
    after = {r.doc_id: r.text for r in masked.collect()}
    assert all(after[r.doc_id] == r.text for r in mixed.collect())
    packed = stages["packing"](spark, mixed, SF)
    assert packed.count() == packing.token_pieces(mixed, vocabulary("word_bpe_49k.json")).count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_run(spark):
    import corpus_pipeline as P

    rows = P.run(spark, SF).collect()
    ends = {}
    for r in rows:
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in ends.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_queries_have_their_columns(spark):
    from telespark.llm.queries import ORACLE_SQL, QUERIES

    want = {
        "op1_language": ["doc_id", "held_out", "lang_pred", "score"],
        "op3_pack": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        "op4_matroska": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        "op5_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        "op6_near_dedup": ["doc_id", "n_shingles", "component_id", "kept"],
        "op7_url_filter": ["page_id", "host", "path", "rule", "verdict"],
        "op8_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        "op9_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op10_nearest": ["query_id", "rank", "vec_id", "score"],
    }
    assert set(want) | {"op2_mix"} == set(QUERIES) and set(ORACLE_SQL) <= set(QUERIES)
    for name, columns in want.items():
        assert QUERIES[name](spark, SF).columns == columns
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    sql = sorted(con.sql(ORACLE_SQL["op7_url_filter"]).fetchall())
    assert sql == sorted(tuple(r) for r in QUERIES["op7_url_filter"](spark, SF).collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_stages_with_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, a shared doc_id, columns with names that stages use, and no rows at all."""
    import corpus_pipeline as P

    schema = "doc_id long, text string, lang string, source string, n_chars long, id int, p string, n int, key string, h0 string, keys int, score string, rate string, copies int, posterior string, _chance int, _row int, _longs int, piece string, length string"
    rest = (1, "p", 2, "k", "h", 3, "s", "r", 4, "q", 5, 6, 7, "c", "l")
    texts = [None, "", " \t", "one plain document about rivers and towns", "a few other words", "long text of many words " * 30_000, "password = hunter2hunter2 here", "x" * 50_000]
    rows = [(i, t, None if i % 2 else "en", None, None if t is None else len(t), *rest) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "a row without an id", None, None, 19, *rest), (None, None, None, None, None, *rest), (4, "quite another text under the same id", None, None, 36, *rest)]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    for table in (docs, docs.limit(0)):
        for name, stage in P.STAGES:
            out = stage(spark, table, SF)
            got = out.collect()
            if name == "packing":
                assert sum(r.piece == 0 for r in got) == table.count()
                continue
            assert out.schema.names == table.schema.names and out.dtypes == table.dtypes, name
            if table is not docs:
                assert not got
            elif name == "near_dedup":
                assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted([*((False, i) for i in range(8)), (False, 4), (True, 0), (True, 0)])
            elif name == "secrets":
                assert len(got) == len(rows) and {r.text for r in got if r.doc_id == 6} == {"[SECRET] here"}
            else:
                assert {r.doc_id for r in got} >= {0, 1, 3}

"""The registered queries against their SQL, and the pipeline's promises, on small tables."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from test_ops import brute_jaccard, brute_mix
from tokenizers import Tokenizer

import corpus_pipeline
from tributary.llm import queries, toxicity
from tributary.llm.common import new_folder
from tributary.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    cursor = db.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted(cursor.fetchall(), key=repr)


def test_registered_names():
    assert {re.match(r"op(\d+)_", n)[1] for n in QUERIES if n.startswith("op")} == {str(i) for i in range(1, 11)}
    assert "pipeline" in QUERIES


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op4_toxicity"](spark, sf).where("held_out").collect()}
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in got}
    right = sum(got[i].predicted == y for i, y in truth.items())
    assert right >= 0.9 * len(truth)


def queries_encoder(text):
    return Tokenizer.from_file(queries.tokenizer()).encode(text or "", add_special_tokens=False).ids + [1]


def ids_of_all(spark, sf, end):
    library = Tokenizer.from_file(queries.tokenizer())
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [end] for r in texts}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_of_all_documents(spark):
    ids = ids_of_all(spark, SF, 1)
    pieces, ends = QUERIES["op3_pack"](spark, SF).collect(), {}
    covered = dict.fromkeys(ids, 0)
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == covered[p.doc_id] and p.length > 0 and p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == crc(ids[p.doc_id][p.start : p.start + p.length])
        covered[p.doc_id] += p.length
    assert covered == {k: len(v) for k, v in ids.items()}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == ends.get(p.sequence_id, 0)
        ends[p.sequence_id] = p.offset + p.length
    assert max(ends.values()) <= 2048 and len(ends) * 2048 < 1.02 * sum(ends.values()) + 2048 * 4


def test_records_of_all_documents(spark):
    ids = ids_of_all(spark, SF, 2)
    got, start = {r.doc_id: r for r in QUERIES["op6_token_records"](spark, SF).collect()}, 0
    assert set(got) == set(ids)
    for k in sorted(ids):
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids[k]), crc(ids[k]))
        start += len(ids[k])


def test_toxicity_of_all_documents(spark):
    got = QUERIES["op4_toxicity"](spark, SF).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_run_is_whole_repeatable_and_leaves_nothing(spark):
    found = [sorted((r.sequence_id, r.offset, r.doc_id, r.start, bytes(r.ids)) for r in corpus_pipeline.run(spark, SF).collect()) for _ in range(2)]
    assert found[0] and found[0] == found[1]


def test_stages_on_an_empty_table_and_on_nulls(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "a b", None, None, None), (-1, "", "x", "y", 0)], docs.schema)
    odd.write.parquet(f"{tmp_path}/odd")
    for name, made in (("empty", docs.limit(0)), ("odd", spark.read.parquet(f"{tmp_path}/odd"))):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, made, SF)
            out.write.parquet(f"{tmp_path}/{name}{k}")
            made = spark.read.parquet(f"{tmp_path}/{name}{k}")
            if k < 4:
                assert made.columns == docs.columns and made.count() >= (0 if name == "empty" else 2)
        assert made.agg({"length": "sum"}).first()[0] is None if name == "empty" else made.count() >= 2


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        path = new_folder(spark, f"stage{k}").replace("/tributary/", "/pipeline-test/")
        out.write.parquet(path)
        out = spark.read.parquet(path)
        if k < 4:
            assert out.columns == columns
            kept.append(out.count())
        if k == 0:
            model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            assert out.count() == toxicity.score(docs, model).where("score < 0.5").count()
        if k == 1:
            plain = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in out.collect()]
            assert len(plain) == len(set(plain)) == len({re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in docs.collect()})
        if k == 2:
            texts = {r.doc_id: r.text for r in docs.collect()}
            groups = brute_jaccard(texts, 5, 80, 100)
            assert sorted(r.doc_id for r in out.collect()) == sorted({component for _, _, component in groups})
        if k == 3:
            assert sorted(r.doc_id for r in out.collect()) == sorted(d for d, *_ in brute_mix(docs, 2.0))
            held = {r.doc_id: r.text for r in out.collect()}
        if k == 4:
            ids = {d: queries_encoder(t) for d, t in held.items()}
            covered = Counter()
            for p in out.collect():
                part = np.frombuffer(p.ids, f"<u{p.id_bytes}").tolist()
                assert part == ids[p.doc_id][p.start : p.start + p.length] and p.doc_tokens == len(ids[p.doc_id])
                covered[p.doc_id] += p.length
            times = Counter(r.doc_id for r in docs.collect())
            assert covered == {d: n * len(ids[d]) for d, n in times.items()}
        docs = out
    assert kept[0] >= kept[1] > kept[2] >= kept[3] <= kept[4]
    assert docs.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").count() == 0

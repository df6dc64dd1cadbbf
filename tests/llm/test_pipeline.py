import __spark_entry__ as entry
import corpus_pipeline
from conftest import base_text
from test_models_and_search import SPEECH, speech
from test_near_and_repeats import plain_components, words
from tokenizers import Tokenizer

from studyloom.llm.queries import ORACLES, QUERIES, vocabulary


def test_every_operator_is_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= names and set(ORACLES) <= set(QUERIES)


def test_stages_on_a_small_corpus(spark, make, tmp_path):
    shared = base_text(77, 60)
    rows = [(i, speech(x, 60, i), x) for i, x in enumerate(list(SPEECH) * 12)]
    rows += [(100, rows[5][1], "en"), (101, rows[7][1] + " end", "en"), (102, "12 34 !!", "en"), (103, None, "en"), (104, "", None)]
    rows += [(105 + i, base_text(200 + i, 90) + " " + shared + " " + base_text(300 + i, 90), "en") for i in range(5)]
    rows += [(None, "no id at all", "en"), (200, "short", "en"), (200, "short", "en")]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns

    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns

    ids = [r.doc_id for r in after["language_id"]]
    assert not {102, 103, 104} & set(ids) and len(ids) == len(rows) - 3
    parts = plain_components([(r.doc_id, r.text, None) for r in after["language_id"]])
    left = {i for i, c in parts.items() if i == c}
    assert sorted(r.doc_id for r in after["near_dedup"] if r.doc_id is not None) == sorted(left)
    assert 100 not in left and 101 not in left and None in [r.doc_id for r in after["near_dedup"]]
    for r in after["substring_dedup"]:
        assert (shared in r.text) == (r.doc_id == 105) or r.doc_id not in range(105, 110)
    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    total = sum(len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in after["substring_dedup"])
    packed = after["best_fit_packing"]
    assert sum(r.length for r in packed) == total
    assert len({r.sequence_id for r in packed}) == -(-total // 4096)
    assert words(after["substring_dedup"][0].text)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or -1, r.piece, r.ids_crc32) for r in whole) == sorted((r.doc_id or -1, r.piece, r.ids_crc32) for r in packed)


def test_pipeline_of_nothing(spark, make, odd, tmp_path):
    make(odd).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_of_odd_rows(spark, make, odd, tmp_path):
    make(odd).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0

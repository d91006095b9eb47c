import hashlib

import pytest
import sentencepiece

from nestkit.llm.pieces import DEFAULT_MODEL
from nestkit.llm.queries import QUERIES

from .cases import ROWS, documents, empty

COLUMNS = {
    "op1_sentencepiece": ["doc_id", "n_tokens", "ids", "decoded_bytes", "decoded_sha256"],
    "op2_transport_stream": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    "op3_simhash": ["doc_id", "fingerprint", "component_id"],
    "op4_token_counts": ["doc_id", "n_tokens", "n_bytes"],
    "op5_lang_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op6_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op7_pii": ["doc_id", "text", "found", "changed"],
    "op8_line_dedup": ["doc_id", "n_lines", "n_deleted", "longest_run", "text"],
    "op9_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op10_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    out = {}
    for name, docs in (("edge", documents(spark)), ("empty", empty(spark))):
        out[name] = str(tmp_path_factory.mktemp(name))
        docs.write.parquet(f"{out[name]}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (6, 1, 1), (8, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{out[name]}/labels.parquet")
    return out


def test_all_ten_are_there():
    assert list(QUERIES) == list(COLUMNS)


@pytest.mark.parametrize("name", list(COLUMNS))
def test_edge_tables(spark, folders, name):
    got = QUERIES[name](spark, folders["edge"])
    assert got.columns[: len(COLUMNS[name])] == COLUMNS[name]
    rows = got.collect()
    assert sorted([r.doc_id for r in rows], key=str) == sorted([r[0] for r in ROWS], key=str)
    assert QUERIES[name](spark, folders["empty"]).collect() == []
    if "held_out" in got.columns:
        assert all(r.held_out in (True, False) for r in rows)
    if name == "op1_sentencepiece":
        library = sentencepiece.SentencePieceProcessor(model_file=DEFAULT_MODEL)
        want = [(r[0], library.encode(r[1] or ""), len((r[1] or "").encode()), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in ROWS]
        assert sorted([(r.doc_id, r.ids, r.decoded_bytes, r.decoded_sha256) for r in rows], key=str) == sorted(want, key=str)
    if name == "op4_token_counts":
        library = sentencepiece.SentencePieceProcessor(model_file=DEFAULT_MODEL)
        want = [(r[0], len(library.encode(r[1] or "")), len((r[1] or "").encode())) for r in ROWS]
        assert sorted([(r.doc_id, r.n_tokens, r.n_bytes) for r in rows], key=str) == sorted(want, key=str)

import sentencepiece

import corpus_pipeline
from nestkit.llm.mixing import mix
from nestkit.llm.pieces import DEFAULT_MODEL
from nestkit.llm.toxicity import held_out, score_toxicity, train

from .cases import ROWS, documents, empty
from .test_exact_dedup import LOWER
from .test_near import brute

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "simhash near-dedup", "mixing", "sentencepiece"]


def test_against_brute_force(spark):
    """The near-dedup stage links texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    got = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = train(docs.where(~held_out("doc_id", 5, 0)), spark.read.parquet(f"{SF}/labels.parquet"))
    clean = {r.doc_id for r in score_toxicity(docs, model).where("predicted = 0").collect()}
    rows = {r.doc_id: r for r in docs.collect() if r.doc_id in clean}
    last = {}
    for i in sorted(rows):
        last[rows[i].text.translate(LOWER)] = i
    kept = sorted(last.values())
    classes = brute([(i, rows[i].text) for i in kept])
    kept = [i for i in kept if classes[i] == i]
    copies = {r.doc_id: r.copies for r in mix(docs.where(docs.doc_id.isin(kept))).collect()}
    assert sorted(r.doc_id for r in got) == sorted(i for i, n in copies.items() for _ in range(n))
    library = sentencepiece.SentencePieceProcessor(model_file=DEFAULT_MODEL)
    for r in got:
        assert r.text == rows[r.doc_id].text and r.ids == library.encode(r.text) and r.n_tokens == len(r.ids)


def test_edge_tables(spark, tmp_path):
    """Nulls, empty texts, repeats, clashing columns, and tables without rows, through all stages."""
    marks = spark.createDataFrame([(1, 1, 0), (6, 1, 1), (None, 1, 1), (9, 1, None)], "doc_id long, quality int, toxic int")
    for name, frame, labels in (("edge", documents(spark), marks), ("empty", empty(spark), marks.limit(0))):
        folder = str(tmp_path / name)
        frame.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        got = corpus_pipeline.run(spark, folder)
        assert got.columns[: len(frame.columns)] == frame.columns and len(got.columns) == len(frame.columns) + 2
        texts = {(r.text or "").translate(LOWER) for r in got.collect()}
        assert texts <= {(r[1] or "").translate(LOWER) for r in ROWS} and (len(texts) > 5) == (name == "edge")

import pytest
import sentencepiece

from studyloom.llm import kernels
from studyloom.llm.token_count import check_model, model_path, token_counts
from tests.llm.conftest import corpus

ODD = ["", None, " ", "  ", "a", "▁", "▁▁ a", "a▁ b", "\n", "a\n b\t c", "<s> hi </s><unk>", "日本語 テスト", "x" * 3000, "   lead", "trail   ", "é   z", "　全角", "a  b   c    d", "\x00\x01 a", "😀😀 👨‍👩‍👧", "word " * 6000]


@pytest.mark.parametrize("slice_bytes", [500, 2 << 20])
def test_equals_library(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(kernels, "SLICE_BYTES", slice_bytes)
    rows = list(enumerate(ODD + ODD + [r[1] for r in corpus(8, 80)]))
    library = sentencepiece.SentencePieceProcessor(model_file=model_path())
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), model_path()).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == [(i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096) for i, t in rows]


def test_equals_library_on_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    library = sentencepiece.SentencePieceProcessor(model_file=model_path())
    want = {r.doc_id: len(library.encode(r.text)) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts(docs, model_path()).collect()} == want


def test_edges(spark, no_docs):
    assert token_counts(no_docs, model_path()).collect() == []
    rows = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string").selectExpr("*", "5 as N_TOKENS", "6 as slice")
    got = token_counts(rows, model_path()).collect()
    assert [r.n_tokens for r in got] == [got[0].n_tokens] * 3 and got[0].slice == 6


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(model_path(), "rb") as f:
        model.ParseFromString(f.read())
    model.pieces[300].piece = "x▁y"
    (tmp_path / "m.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="cross"):
        check_model(str(tmp_path / "m.model"))

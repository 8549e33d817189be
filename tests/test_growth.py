"""What is shuffled, dealt out and collected grows no faster than the input."""

from docassay.llm import tokens
from docassay.operators import layout
from docassay.sources import adapters, tables

TEXTS = [(k, f"alpha {k} beta\ngamma  delta {k % 3}\n\nomega" if k % 4 else None) for k in range(40)] + [(5, "again five"), (None, "no id")]


def folder_of(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_words_of_a_document_move_once(spark, tmp_path, capsys):
    folder = folder_of(spark, tmp_path)
    got = layout.document_texts(adapters.words(spark, folder, together=True), ["doc_id"], ["line"])
    got.explain()
    assert capsys.readouterr().out.count("Exchange") == 1  # the texts before they become words
    plain = layout.document_texts(adapters.words(spark, folder), ["doc_id"], ["line"])
    assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))
    lines = [layout.line_texts(adapters.words(spark, folder, together=t), ["doc_id", "line"]) for t in (True, False)]
    assert sorted(map(repr, lines[0].collect())) == sorted(map(repr, lines[1].collect()))


def test_rows_are_spread_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS_SPREAD", 10)
    df = tables.spread(spark.range(95))
    assert df.rdd.getNumPartitions() == 10 and df.count() == 95


def test_memory_is_settled_by_bytes(monkeypatch):
    calls = []
    monkeypatch.setattr(tokens, "settle", lambda: calls.append(1))
    monkeypatch.setattr(tokens, "_handled", 0)
    monkeypatch.setattr(tokens, "PIECE", 1000)
    for _ in range(100):
        tokens.settle_after(25)
    tokens.settle_after(5000)
    assert len(calls) == 3

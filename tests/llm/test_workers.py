import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from vestigia.llm import bpe, jaccard, toxicity
from vestigia.plans import workers
from vestigia.plans.storage import materialize


def test_f1_operators_let_go_of_the_tokenizers_tables(spark, monkeypatch):
    """A worker that has tokenized holds a vocabulary and two tables; the join and the scores don't need them."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        model = f.read()
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g h"), (3, None), (4, "x")], "doc_id long, text string")
    works, plain = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, work, *a, **b: works.append(work) or plain(df, work, *a, **b))
    jaccard.classes(docs, words=2, percent=50).collect()
    fitted = toxicity.fit([("a b c d e", 0), ("x y z x y", 1)] * 4, toxicity.Params())
    toxicity.kept(docs, fitted)
    assert len(works) > 5
    for work in works:
        assert bpe._codec(model) and bpe._codecs
        try:
            list(work(iter([])))
        except ValueError:  # a part without rows has no schema to give
            pass
        assert not bpe._codecs
    assert bpe._codec(model)
    list(workers.lean(iter, "bpe")(iter([])))
    assert bpe._codecs  # its own tables it keeps
    bpe._codecs.clear()


def test_f1_batches_are_bounded_by_bytes(spark):
    """6,000 rows of 4 KB are no single batch, neither while a table is written nor in a stage's result."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], ["size", "n"])

    rows = spark.range(0, 6000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("abcd "), 800).alias("text"))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    found = materialize(rows.mapInArrow(workers.lean(sizes), "size long, n long"), "sizes").collect()
    assert sum(r["n"] for r in found) == 6000 and max(r["size"] for r in found) < 5 << 20
    assert spark.conf.get(key, None) == before
    corpus_pipeline.tokenize(spark, rows, "")
    found = rows.mapInArrow(workers.lean(sizes), "size long, n long").collect()
    assert sum(r["n"] for r in found) == 6000 and max(r["size"] for r in found) < 5 << 20


def test_f1_many_new_words_are_merged_in_parts(monkeypatch):
    """The arrays of a merge stay small however many words are new; ids are those of single merges."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        codec = bpe.Codec(f.read())
    cells, plain = [], bpe.Codec.merge_many
    monkeypatch.setattr(bpe.Codec, "merge_many", lambda self, words, width: cells.append(len(words) * width) or plain(self, words, width))
    words = [f"w{i}x" for i in range(20_000)] + ["longer-words" * 3 + str(i) for i in range(3_000)]
    found = codec.learn(set(words))
    assert max(cells) <= 1 << 17 and sum(cells) > 1 << 18
    for w in words[::97]:
        assert np.frombuffer(found[w], "<u4").tolist() == codec.merge(w.encode())

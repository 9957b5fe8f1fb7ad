"""Dropout varies with every occurrence of a word and every copy of a document."""

import os

import numpy as np

import corpus_pipeline
from tessera.llm import sentencepieces

PATH = os.path.join(sentencepieces.VOCABULARIES, sentencepieces.MODEL)


def test_a_word_has_more_segmentations_than_four():
    codec = sentencepieces.Codec(PATH, 0.1, 23)
    found = {codec.encode(" ".join(["unbelievable"] * 2000), k).tobytes() for k in range(2)}
    assert len(found) == 2
    chunks = ["▁unbelievable"] * 2000
    assert len(set(codec.merge_many(chunks, list(range(2000))))) > 20


def test_remembered_pieces_equal_the_agenda():
    codec = sentencepieces.Codec(PATH, 0.2, 5)
    text = "the unbelievable houses, and überall 漢字 " * 40 + "x" * 60
    for key in range(5):
        places = sentencepieces.mix(np.arange(len(codec.cut(text)), dtype=np.uint64) + np.uint64(key))
        want = b"".join(codec.merge(c, int(p)) for c, p in zip(codec.cut(text), places, strict=True))
        assert codec.encode(text, key).tobytes() == want and codec.decode(codec.encode(text, key)) == text


def test_copies_differ_in_the_pipeline(spark):
    docs = spark.createDataFrame([(1, "the unbelievable houses stand everywhere " * 20)] * 4, "doc_id long, text string")
    assert len({tuple(r["ids"]) for r in corpus_pipeline.encoding(spark, docs, "").collect()}) == 4

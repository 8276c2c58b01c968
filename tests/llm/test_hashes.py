"""Hashes of words and windows: texts that collide under any polynomial modulo 2**64 don't here, and nothing rests on a lost file."""

import glob
import os

import numpy as np
import pyarrow as pa
import pytest

from strandloom.llm import hash_files, jaccard_join, kneser_ney, queries, sentencepiece_codec, substring_dedup, text_arrays


def pair(doublings=11):
    """The first 2**doublings letters of the Thue-Morse sequence in a and b, and their complement."""
    one = "a"
    for _ in range(doublings):
        one += one.translate(str.maketrans("ab", "ba"))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_windows_agree_with_spans_and_differ_from_each_other():
    words = [*"abab", "aaaaaaaa", "aaaaaaaaa", "aaaaaaaab", "é", "漢字漢字漢字", *pair(7)]
    (w,) = text_arrays.pieces(pa.array([" ".join(words)]))
    hashes = w.hashes()
    assert len(set(hashes.tolist())) == len(set(words)) and not set(hashes.tolist()) & set(w.hashes(text_arrays.SEEDS[1]).tolist())
    for width in range(1, 9):
        n = len(words) - width + 1
        got = text_arrays.window_hashes(hashes, width)[:n]
        assert (got == text_arrays.span_hashes(hashes, np.arange(n), np.arange(n) + width)).all()
        assert len(set(got.tolist())) == len({tuple(words[i : i + width]) for i in range(n)})


def test_sequences_of_two_words_that_differ_as_the_pair_does():
    texts = [" ".join(x) for x in pair()]
    for w in text_arrays.pieces(pa.array(texts)):
        whole = text_arrays.span_hashes(w.hashes(), w.bounds[:-1], w.bounds[1:])
        assert whole[0] != whole[1]


def test_op2_keeps_the_pair_apart(spark):
    docs = spark.createDataFrame(list(enumerate(pair())), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.join_report(docs).collect()} == {0: 0, 1: 1}


def test_op4_gives_each_its_own_ids(spark):
    import sentencepiece

    path = queries.piece_model()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.createDataFrame([(0, " ".join(pair()))], "doc_id long, text string")
    row = sentencepiece_codec.encode_documents(docs, path, keep_ids=True).first()
    assert row.ids == sp.encode(" ".join(pair()))


def test_op4_compares_bytes_where_hashes_are_equal(monkeypatch):
    text = np.frombuffer(b" one two one twx three one", np.uint8)
    bounds = np.array([0, 4, 8, 12, 16, 22, 26])
    for constant in (False, True):
        if constant:
            monkeypatch.setattr(sentencepiece_codec, "run_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
        first, inverse = sentencepiece_codec._distinct(text, bounds)
        runs = [text[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
        assert [runs[first[k]] for k in inverse] == runs and len(first) == 4


def test_op6_removes_no_word_that_occurs_once(spark):
    one, other = pair()
    common = [f"w{i}" for i in range(49)]
    docs = spark.createDataFrame([(0, " ".join([*common, one])), (1, " ".join([*common, other]))], "doc_id long, text string")
    assert {r.n_removed for r in substring_dedup.remove_repeats(docs).collect()} == {0}


def test_op8_counts_both_words(spark):
    one, other = pair()
    docs = spark.createDataFrame([(1, f"{one} x"), (2, f"{other} {other}")], "doc_id long, text string")
    model = kneser_ney.train(docs)
    assert (model.types, model.tokens) == (4, 6)


def test_a_lost_file_is_an_error(spark):
    docs = spark.createDataFrame([(i, f"some words {i} and more words {i * 7}") for i in range(40)], "doc_id long, text string")
    model = kneser_ney.train(docs)
    scored = kneser_ney.score(docs, model)
    assert scored.count() == 40
    files = glob.glob(f"{model.pairs.folder}/pairs-*")
    assert len(files) == 1 << model.pairs.bits
    for f in files:
        os.remove(f)
    with pytest.raises(Exception, match="is gone"):
        kneser_ney.score(docs, model).collect()
    with pytest.raises(FileNotFoundError):
        hash_files.load(files[0], np.uint64)


def test_every_file_is_written_for_an_empty_table(spark, empty):
    model = kneser_ney.train(empty.select("text"))
    assert model.tokens == 0 and len(glob.glob(f"{model.pairs.folder}/*")) == 2 << model.pairs.bits

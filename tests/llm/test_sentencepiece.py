import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import sentencepiece_codec

MODEL = public_tokenizers.path("piece_bpe_32k.model")
library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
coder = sentencepiece_codec.codec(open(MODEL, "rb").read())
ODD = [None, "", " ", "    ", "a" * 300, "ab" * 200, " " * 37 + "x", "\n\n\t a\r\n", "<s> </s> <0x0A>", "▁x ▁▁ y", "日本語 😀 naïve", "ﬁ ½ ａ", "\x00a\x01", "the the  the   the", "in" * 50 + "ininging"]


def same(texts):
    for text, (n, ids, decoded) in zip(texts, sentencepiece_codec.encode_texts(coder, pa.array(texts, pa.string())), strict=True):
        want = library.encode(text or "")
        assert [int(x) for x in ids.split(b",") if x] == want and n == len(want), repr(text)
        assert decoded.decode() == library.decode(want), repr(text)


def test_odd_texts():
    same(ODD)
    same([])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aabbeinrst  \n▁é日<0x>"), max_size=60), max_size=5))
def test_made_up_texts(texts):
    same(texts)


def test_documents(documents, awkward, empty):
    for frame in (documents, awkward, empty):
        rows = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in sentencepiece_codec.encode_documents(frame, MODEL).collect()}
        want = set()
        for r in frame.collect():
            ids = library.encode(r.text or "")
            want.add((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
        assert rows == want


def test_other_kinds_of_model_are_refused():
    with pytest.raises(Exception):
        sentencepiece_codec.Codec(b"")

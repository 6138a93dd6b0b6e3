import glob
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
from corpus_cases import empty, frame, odd_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from framewright.llm import op8_token_files as m
from framewright.session import shared_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
ENCODER = m.Encoder(PATH)


def ids(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 0]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab'.,! \n\t\x0b\x1c\x85\xa0é中1_-"), max_size=24))
def test_words_give_the_ids_of_the_whole_text(text):
    assert np.frombuffer(ENCODER.encode([text])[0], dtype="<u4").tolist() == ids(text)[:-1]


def test_special_tokens_are_encoded_as_the_library_does():
    text = "a <|endoftext|> b"
    assert np.frombuffer(ENCODER.encode([text])[0], dtype="<u4").tolist() == ids(text)[:-1]


def test_files_and_digests(spark):
    path = shared_path(spark, "tokens")
    m.write_tokens(frame(spark, odd_rows()), path, PATH)
    got = [tuple(r) for r in m.token_digests(m.read_tokens(spark, path)).orderBy("start").collect()]
    rows = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r[0] for r in got] == [r[0] for r in rows]
    start = 0
    for found, row in zip(got, rows, strict=True):
        own = ids(row[1])
        assert found == (row[0], start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)


def test_layout(spark):
    path = shared_path(spark, "tokens")
    m.write_tokens(frame(spark, odd_rows()), path, PATH)
    files = glob.glob(f"{path}/*.parquet")
    assert files
    for f in files:
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            names = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            tokens = next(c for n, c in names.items() if n.startswith("ids"))
            assert any("DICTIONARY" in e for e in tokens.encodings)
            assert names["doc_id"].has_offset_index and names["doc_id"].has_column_index
    some = m.read_documents(spark, path, 4, 7).collect()
    assert sorted(r.doc_id for r in some) == [4, 5, 5, 6, 7]


def test_empty_table(spark):
    path = shared_path(spark, "tokens")
    m.write_tokens(empty(spark), path, PATH)
    assert m.token_digests(m.read_tokens(spark, path)).collect() == []


def test_slices_of_words_are_encoded_in_parts(monkeypatch):
    monkeypatch.setattr(m, "_TOGETHER", 3)
    monkeypatch.setattr(m, "_AT_ONCE", 2)
    words = [f"w{i}é" for i in range(40)]
    texts = ["", " ", "a  b", " ".join(words), "a <|endoftext|> b", "one", "a　 b", "x \x1c", *words, "w3é w3é\n w7é"]
    for some in (texts, ["one"], [""], []):
        got = ENCODER.encode(pa.array(some, pa.string()))
        assert [np.frombuffer(c, dtype="<u4").tolist() for c in got] == [ids(t)[:-1] for t in some]


def test_words_met_in_slice_after_slice_are_encoded_twice_at_most(monkeypatch):
    encoder, given_ = m.Encoder(PATH, 4), []
    whole = encoder.all_at_once
    monkeypatch.setattr(encoder, "all_at_once", lambda texts: given_.extend(texts) or whole(texts))
    slices = [["x aa bb", "x cc  d", "x ee ff"], ["x bb aa", "y ee ff gg"], ["x ff bb", "x aa ee", "ff gg hh"], ["hh bb  gg"]]
    asked = []
    for some in slices:
        got = encoder.encode(some)
        assert [np.frombuffer(c, dtype="<u4").tolist() for c in got] == [ids(t)[:-1] for t in some]
        asked.append({w for t in given_ if t.startswith(" ") for w in t.split()})
        given_.clear()
    assert asked == [{"aa", "bb", "cc", "d", "ee", "ff"}, {"aa", "bb", "ee", "ff", "gg"}, {"gg", "hh"}, {"gg"}]
    assert sorted(encoder.kept.to_pylist()) == ["aa", "bb", "ee", "ff"]


def test_long_words_are_not_kept():
    encoder, long = m.Encoder(PATH), "é" * m.KEPT_BYTES
    for _ in range(3):
        assert np.frombuffer(encoder.encode([f"a {long}"])[0], dtype="<u4").tolist() == ids(f"a {long}")[:-1]
    assert len(encoder.kept) == 0

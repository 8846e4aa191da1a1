import hashlib
import struct

import duckdb
import public_tokenizers
import pytest
import sentencepiece

from orbitframe.llm.pieces import CharMap, codec, decode_ids, encode_documents, normalise, op2_sentencepiece

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_whole_query_against_the_library(spark):
    sf = "/root/testdata/sf0.001"
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = dict(duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())
    got = {r.doc_id: r for r in op2_sentencepiece(spark, sf).collect()}
    assert set(got) == set(docs)
    for i, t in docs.items():
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


TEXTS = ["", " ", "Hello  world ", "naïve café 𝔘𝔫𝔦", "日本語テキスト", "a\tb\nc", "▁ mark", " x", "é ﬁ"]


def test_spans_cover_the_text(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*TEXTS, None])] + [(None, "x", 1)], "doc_id long, text string, ids int")
    rows = {r.id: r for r in encode_documents(df).collect()}
    for i, t in enumerate(TEXTS):
        data, r = t.encode(), rows[i]
        assert len(r.ids) == len(r.starts) == len(r.ends)
        assert b"".join(data[s:e] for s, e in zip(r.starts, r.ends)) == data
    assert rows[len(TEXTS)].ids == [1, 2]
    back = {r.id: r.text for r in decode_ids(encode_documents(df)).collect()}
    assert all(back[i] == rows[i].decoded for i in rows)
    assert encode_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_character_map_like_the_library(rule):
    norm = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False)
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(norm.serialized_model_proto())
    chars = CharMap(m.normalizer_spec.precompiled_charsmap)
    assert chars.units
    for t in [*TEXTS, "ＡＢＣ ㍿ ½ ﬀ Å", "ÄÖÜ ß STRASSE"]:
        out, align = normalise(t.encode(), chars, False, False, escape=False)
        assert out.decode() == norm.normalize(t)
        assert len(align) == len(out) + 1 and list(align) == sorted(align)


def test_trimmed_like_the_library():
    norm = sentencepiece.SentencePieceNormalizer(rule_name="identity", add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=True)
    for t in TEXTS:
        assert normalise(t.encode(), CharMap(b""), False, True, escape=False)[0].decode() == norm.normalize(t)


def test_long_text(spark):
    c = codec(PATH)
    t = "abc déf " * 40_000
    (ids, starts, ends), = c.encode([t])
    assert ends[-1] == len(t.encode()) and len(ids) > 40_000

"""SentencePiece encoding with original byte spans, and decoding."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, functions as F
from sentencepiece import sentencepiece_model_pb2

from orbitframe.llm.batches import bound_batches, text_parts
from orbitframe.session import read_table

SPACE = "▁".encode()
ENCODED = "id long, ids array<int>, starts array<int>, ends array<int>, decoded string"


class CharMap:
    """A compiled character map: a double-array trie of byte sequences and their replacements."""

    def __init__(self, blob: bytes):
        n = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", n // 4, 4).tolist() if n else []
        self.texts = blob[4 + n :] if blob else b""
        self.leads = self._leads()

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _leads(self) -> frozenset[int]:
        """First bytes of any mapped sequence."""
        if not self.units:
            return frozenset()
        at = self._offset(self.units[0])
        return frozenset(c for c in range(256) if (at ^ c) < len(self.units) and self.units[at ^ c] & 0x800000FF == c)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest mapped prefix of data from ``at``."""
        if not self.units or data[at] not in self.leads:
            return None
        node, found = self._offset(self.units[0]), None
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units) or self.units[node] & 0x800000FF != data[i]:
                break
            unit = self.units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                begin = self.units[node] & 0x7FFFFFFF
                found = (i + 1 - at, self.texts[begin : self.texts.index(b"\0", begin)])
        return found


def normalise(data: bytes, chars: CharMap, dummy_prefix: bool, trim: bool, escape: bool = True) -> tuple[bytes, np.ndarray]:
    """Normalised bytes and, for each of them and the end, the source byte it comes from.

    At each position the longest mapped prefix is replaced, else one character is copied. ``trim``
    drops leading and trailing spaces and joins runs of them, as the model's option does; spaces
    become the piece mark if ``escape``. Bytes that an inserted mark has come from the next source byte.
    """
    n, at, out, align = len(data), 0, bytearray(), []
    space = SPACE if escape else b" "
    if not chars.leads and not trim:
        if not data:
            return b"", np.zeros(1, np.int32)
        head = space if dummy_prefix else b""
        raw = np.frombuffer(data, np.uint8)
        wide = np.where(raw == 32, len(space), 1)
        return head + data.replace(b" ", space), np.concatenate((np.zeros(len(head), np.int64), np.repeat(np.arange(n), wide), [n])).astype(np.int32)
    steps = []
    while at < n:
        hit = chars.longest(data, at)
        if hit is None:
            b = data[at]
            length = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            hit = (length, data[at : at + length])
        steps.append((at, hit[1]))
        at += hit[0]
    began, last_space = False, trim
    for at, piece in steps:
        if trim and not began and not piece.strip(b" "):
            continue
        if not began:
            began = True
            if dummy_prefix:
                out += space
                align += [at] * len(space)
        if last_space:
            piece = piece.lstrip(b" ")
        for c in piece:
            unit = space if c == 32 else bytes([c])
            out += unit
            align += [at] * len(unit)
        if piece:
            last_space = trim and piece.endswith(b" ")
    end = n
    if trim:
        while out.endswith(space) and len(out) > 0:
            end = align[-len(space)]
            del out[-len(space) :], align[-len(space) :]
    return bytes(out), np.array([*align, end], np.int32)


class Codec:
    """One model, loaded once in a worker."""

    def __init__(self, path: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.sp.serialized_model_proto())
        spec = model.normalizer_spec
        self.chars = CharMap(spec.precompiled_charsmap)
        self.options = (spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        byte = sentencepiece_model_pb2.ModelProto.SentencePiece.BYTE
        self.lengths = np.array([1 if p.type == byte else len(p.piece.encode()) for p in model.pieces], np.int64)

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids with begin and end ids, and the source byte span of each; the two marks have empty spans.

        The pieces partition the normalised bytes, so running piece lengths are offsets into them,
        and the alignment that normalisation recorded projects these to source bytes.
        """
        for text, ids in zip(texts, self.sp.encode(texts, add_bos=True, add_eos=True, num_threads=1)):
            ids = np.array(ids, np.int32)
            data, align = normalise(text.encode(), self.chars, *self.options)
            cuts = np.concatenate(([0], np.cumsum(self.lengths[ids[1:-1]])))
            if cuts[-1] != len(data):
                cuts = self._cuts(text, len(data))
            at = align[cuts]
            yield ids, np.concatenate((at[:1] * 0, at[:-1], at[-1:])), np.concatenate((at[:1] * 0, at[1:], at[-1:]))

    def _cuts(self, text: str, size: int) -> np.ndarray:
        """Normalised piece offsets where unknown pieces have lengths of their own.

        Pieces always partition the library's normalised text; the error means that ours differs from it,
        which no rule set tested does, and that spans of this text would be wrong.
        """
        lengths = [len(p.encode()) for p in self.sp.encode(text, out_type=str)]
        cuts = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
        if cuts[-1] != size:
            raise ValueError("the pieces don't cover the normalised text")
        return cuts


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """(id, text) batches to batches of ENCODED, a bounded part of a batch at a time."""
    c = codec(path)
    for b in batches:
        for at, part in text_parts(b, 1):
            rows = list(c.encode([t or "" for t in part]))
            cuts = pa.array(np.cumsum([0, *(len(r[0]) for r in rows)]), pa.int32())
            flat = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([r[k] for r in rows]), pa.int32())) for k in range(3)]
            decoded = pa.array([c.sp.decode(r[0].tolist()) for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), *flat, decoded], names=["id", "ids", "starts", "ends", "decoded"])


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """(id, ids, starts, ends, decoded) of every row.

    ids are the model's with begin and end ids; starts and ends are byte offsets of each piece in
    the UTF-8 text, of which a piece of several bytes per character may hold a part; decoded is the
    library's decode(ids). Null texts are empty ones: ids of the two marks alone. A null id stays
    null, repeated rows stay, other columns (whatever their names) are left out, an empty table gives no
    rows. A worker holds the tokens of a quarter of a megabyte of text at once, or of one longer text.
    """
    bound_batches(docs.sparkSession)
    path = model or public_tokenizers.path("piece_bpe_32k.model")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return src.mapInArrow(lambda it: encode_batches(it, path), ENCODED)


def decode_ids(rows: DataFrame, ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """``rows`` with the column ``text`` of the library's decode(ids); null ids give null."""
    path = model or public_tokenizers.path("piece_bpe_32k.model")

    @F.pandas_udf("string")
    def run(ids):
        sp = codec(path).sp
        return ids.map(lambda x: None if x is None else sp.decode([int(i) for i in x]))

    return rows.withColumn("text", run(F.col(ids_col)))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, cuts = b.column(1), b.column(1).offsets.to_numpy()
        flat = ids.values.to_numpy().astype("<u4")
        sums = [hashlib.sha256(flat[x:y].tobytes()).hexdigest() for x, y in zip(cuts[:-1], cuts[1:])]
        starts, ends = b.column(2).values.to_numpy(), b.column(3).values.to_numpy()
        spans = [hashlib.sha256(np.stack((starts[x:y], ends[x:y])).astype("<u4").tobytes()).hexdigest() for x, y in zip(cuts[:-1], cuts[1:])]
        texts = [hashlib.sha256(t.encode()).hexdigest() for t in b.column(4).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(np.diff(cuts).astype(np.int64)), pa.array(sums, pa.string()), pa.array(texts, pa.string()), pa.array(spans, pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"],
        )


def encoding_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """The digest columns of encode_documents, hashed in the worker that encoded the batch."""
    bound_batches(docs.sparkSession)
    path = model or public_tokenizers.path("piece_bpe_32k.model")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string"
    return src.mapInArrow(lambda it: _digests(encode_batches(it, path)), kinds)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(read_table(spark, sf_dir, "documents"))

"""SentencePiece (BPE type) encoding and decoding by a prefix table.

The encoding of a text by merges has two properties that make one left-to-right pass enough: every prefix of it
encodes the prefix of the text that it covers, and a token sequence is the encoding of its text if and only if each
two neighbours are (they are *compatible*) and each token encodes itself. So every prefix of a text has a unique last
token. An Aho-Corasick automaton lists the pieces that end at each position; the one that is compatible with the last
token of the prefix before it is stored, and the ids are read from the table backwards. Compatibility of a pair is
tested once by merging the two pieces' characters in score order, then remembered.

Characters that no piece contains become byte pieces and nothing merges with them. Pieces hold the space mark only at
their start, so texts are cut before spaces, and encoded cuts are remembered in a bounded cache.

Edge cases: null counts as empty and gives the end id alone; repeated rows get equal results; very long texts or
texts without any space take time in proportion; columns other than the id and the text are ignored; an empty table
gives an empty result. Decoding drops the mark put before the text, and ids beyond the vocabulary raise an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import trimmed, tune
from weftline.llm.unit_cache import UnitCache, joined, runs

MARK = "▁"
#: Separates units that are encoded together; no piece holds it.
GAP = "\0"
#: Units that are encoded together.
UNITS = 20_000
#: Pair tests that are remembered at once.
PAIRS = 400_000
#: Bytes of text that are encoded together.
BYTES = 3 << 20
#: Characters of cached units in one generation.
CACHED = 2_000_000


class PieceCodec:
    """Encoder and decoder of one model file. The library only reads the file's pieces, scores and kinds."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.end = model.eos_id()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        self.ids = {p: i for i, (p, s) in enumerate(zip(self.pieces, special, strict=True)) if not s}
        self.score = {p: model.get_score(i) for p, i in self.ids.items()}
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        if len(self.byte) != 256:
            raise ValueError("the model has no byte pieces")
        known = {c for p in self.ids for c in p}
        if not known <= self.ids.keys() or any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("the model isn't of a kind that this codec can encode")
        self.cut_lines = "\n" not in known
        if GAP in known:
            raise ValueError("the model has a piece with the character that separates units here")
        self.length = np.array([*map(len, self.pieces), 1])  # at its end, of a character without a piece (-1)
        self.alone = [p in self.ids and self.merge(p) == [p] for p in self.pieces]
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if self.alone[i]:  # no encoding holds another piece
                self.automaton.add_word(p, (i, len(p) - 1))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.units = UnitCache(self._many, CACHED)
        self.stops = {x: self.ids[x] for x in ".,;:)" if x in self.ids and self.alone[self.ids[x]]}
        self.bytes = [self._bytes(i, s) for i, s in enumerate(special)]
        self.raw = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.sizes = np.array([len(b) for b in self.bytes], np.int32)
        self.starts = np.cumsum(self.sizes, dtype=np.int32) - self.sizes

    def _bytes(self, i: int, special: bool) -> bytes:
        if not special:
            return self.pieces[i].replace(MARK, " ").encode()
        if re.fullmatch("<0x[0-9A-F]{2}>", self.pieces[i]):
            return bytes([int(self.pieces[i][3:5], 16)])
        return " ⁇ ".encode() if i == 0 else b""

    def forget(self) -> None:
        """Empties the caches."""
        self.units.clear()
        self.pairs.clear()

    def merge(self, text: str) -> list[str]:
        """Merges of neighbours in the order of the scores, leftmost first: the definition, for short texts."""
        parts = list(text)
        get, none = self.score.get, float("-inf")
        gain = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while gain:
            best = max(gain)
            if best == none:
                break
            k = gain.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del gain[k]
            if k:
                gain[k - 1] = get(parts[k - 1] + parts[k], none)
            if k < len(gain):
                gain[k] = get(parts[k] + parts[k + 1], none)
        return parts

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(self.pieces[a] + self.pieces[b]) == [self.pieces[a], self.pieces[b]]
        return known

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Ids of each text, as bytes. Texts already have marks for spaces. One pass fills the table of all, and the ids of
        all are read from it together, a token of each at a time from the ends backwards."""
        out: list[bytes] = []
        for at in range(0, len(units), UNITS):
            out += self._encode(units[at : at + UNITS])
        return out

    def _encode(self, units: list[str]) -> list[bytes]:
        whole = GAP.join(units)
        last = [-1] * (len(whole) + 1)  # the last token of each prefix; -1 at starts and after a character without a piece
        known, compatible = self.pairs.get, self.compatible
        for at, (piece, more) in self.automaton.iter(whole):
            if last[at + 1] < 0:
                before = last[at - more]
                if before < 0:
                    last[at + 1] = piece
                else:
                    good = known(before << 20 | piece)
                    if good or good is None and compatible(before, piece):
                        last[at + 1] = piece
        table = np.array(last, np.int32)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        read = np.zeros(len(table), bool)
        place, stop = ends[sizes > 0], starts[sizes > 0]
        while len(place):
            read[place] = True
            place = place - self.length[table[place]]
            more = place > stop
            place, stop = place[more], stop[more]
        path = np.flatnonzero(read)
        ids, n = table[path], np.ones(len(path), np.int64)
        bare = np.flatnonzero(ids < 0)  # characters without a piece become their bytes
        if len(bare):
            raw = [whole[i].encode("utf-8", "surrogatepass") for i in (path[bare] - 1).tolist()]
            n[bare] = [len(x) for x in raw]
            ids = np.repeat(ids, n)
            ids[ids < 0] = [self.byte[x] for b in raw for x in b]
        done = 4 * np.r_[0, np.cumsum(n)]
        cut = zip(done[np.searchsorted(path, starts, "right")].tolist(), done[np.searchsorted(path, ends, "right")].tolist(), strict=True)
        data = ids.astype("<i4").tobytes()
        return [data[a:z] for a, z in cut]

    def _many(self, units: list[str]) -> list[bytes]:
        """Units encoded. A unit that ends in a stop is what comes before it and the stop, if these are compatible."""
        stops = self.stops
        plain = [u for u in units if u[-1:] not in stops]
        done = dict(zip(plain, self.encode_units(plain), strict=True))
        stopped = [u for u in units if u[-1:] in stops]
        done.update(self.units.peek({u[:-1] for u in stopped} - done.keys()))
        fresh = list({u[:-1] for u in stopped} - done.keys())
        own = dict(zip(fresh, self.encode_units(fresh), strict=True))
        self.units.add(own)
        done.update(own)
        apart = []
        for u in stopped:
            ids, stop = done[u[:-1]], stops[u[-1]]
            if ids and self.compatible(int.from_bytes(ids[-4:], "little"), stop):
                done[u] = ids + stop.to_bytes(4, "little")
            else:
                apart.append(u)
        done.update(zip(apart, self.encode_units(apart), strict=True))
        return [done[u] for u in units]

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of the texts and ids of all, each text's end id included."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        # a mark before the text and for each space, a gap before each run of marks
        cut = pc.binary_join_element_wise("", pc.replace_substring(texts, " ", f" {MARK}"), MARK)
        cut = pc.replace_substring(cut, f"{MARK} ", MARK)
        if self.cut_lines:
            cut = pc.replace_substring(cut, "\n", " \n ")
        units = pc.split_pattern(pc.if_else(pc.equal(texts, ""), "", cut), " ")
        of = units.flatten().dictionary_encode()
        parts = self.units.get(of.dictionary.to_pylist())
        data = np.frombuffer(b"".join(parts), "<i4")
        size = np.fromiter((len(p) >> 2 for p in parts), np.int32, len(parts))
        start = np.cumsum(size, dtype=np.int32) - size
        unit = of.indices.to_numpy()
        ids = data[runs(start[unit], size[unit])]
        ends = np.r_[0, np.cumsum(size[unit], dtype=np.int64)][units.offsets.to_numpy() - units.offsets[0].as_py()]
        return ends + np.arange(len(ends)), np.insert(ids, ends[1:], self.end)

    def decode_array(self, ends: np.ndarray, ids: np.ndarray) -> pa.Array:
        """Texts of what encode_array returns, from the ids alone. Each text begins with the mark, which goes."""
        size = self.sizes[ids]
        raw = self.raw[runs(self.starts[ids], size)]
        at = np.r_[0, np.cumsum(size, dtype=np.int64)][ends]
        keep = np.ones(len(raw), bool)
        keep[at[:-1][np.diff(at) > 0]] = False
        at = at - np.r_[0, np.cumsum(np.diff(at) > 0)]
        return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(at.astype("<i4").tobytes()), pa.py_buffer(raw[keep].tobytes()))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text with the end id."""
        ends, ids = self.encode_array(pa.array(texts, pa.string()))
        return [ids[a:z] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def decode(self, ids: list[int]) -> str:
        out = b"".join(map(self.bytes.__getitem__, ids))
        return (out[1:] if out[:1] == b" " and self._marked(ids) else out).decode("utf-8", "replace")

    def _marked(self, ids: list[int]) -> bool:
        first = next((i for i in ids if self.bytes[i]), None)
        return first is not None and self.pieces[first].startswith(MARK)


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """(id_col, ids array<int>), and with ``decode`` also (decoded string), the text that the ids stand for."""
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([rows.schema[0], T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    if decode:
        schema = schema.add("decoded", "string")

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        c.forget()
        for b in joined(batches, BYTES):
            ends, ids = c.encode_array(b.column(1))
            columns = [b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))]
            if decode:
                columns.append(c.decode_array(ends, ids))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        c.forget()

    return rows.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, decoded string) of a table with ids; null ids give null."""
    rows = encoded.select(F.col(id_col), F.col(ids_col).cast("array<int>").alias("__ids"))
    schema = T.StructType([rows.schema[0], T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            texts = [None if x is None else c.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) of what encode_documents(decode=True) returns."""
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )

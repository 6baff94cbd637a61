"""Token-id files compressed by Re-Pair grammars.

Documents are sorted by id (range partitioning, so partitions are in order too), encoded, closed with an end id and
packed into shards of about ``SHARD`` tokens; a document never crosses shards. Within a shard, frequent pairs of
symbols are replaced by new symbols, round after round, until no pair has ``LEAST`` uses; the shard stores the rules, the length that each new symbol
expands to, and the remaining sequence. Any token range is decoded by finding its symbols in the running sum of
lengths and expanding only those.

The files are a Parquet folder, one row a shard: part, seq, first_token (in its part), n_tokens, doc_ids, doc_tokens,
base, rules, lengths, width, sequence. Spark writes and reads them, so they can be in any store that Spark reaches.

Tokens of a text are those of the library. White space always separates tokens of this vocabulary, so texts are cut
there, the distinct cuts of a batch are encoded by the library together, and a bounded cache keeps them.

Edge cases: null counts as empty and gives the end id alone; null ids come first; rows with equal ids stay next to each
other in any order; a very long text makes a shard of its own size; columns other than the id and the text are
ignored; an empty table gives files without rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from weftline.llm.common import new_path, trimmed, tune
from weftline.llm.unit_cache import joined, runs

END = 1
SHARD = 1 << 18
#: New symbols in a round, and uses that a new symbol needs: a rule and its length take 12 bytes and each use saves a symbol of 2, so with 7 uses a
#: symbol begins to pay (a shard of 262,144 tokens takes 398,456 bytes with 4 uses, 387,088 with 7, 387,510 with 8).
NEW, LEAST = 2048, 7
SCHEMA = (
    "part int, seq int, first_token long, n_tokens long, doc_ids array<long>, doc_tokens array<int>, base int, "
    "rules binary, lengths binary, width int, sequence binary"
)


#: Words of these letters only, in lower case, are one pre-token each: the library needs no normaliser for them.
_SIMPLE = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
_LATIN = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+"


class ChunkEncoder:
    """The library's ids of texts, chunk by chunk. Distinct chunks of a batch are found by Arrow; a chunk is its plain
    form (lower case, without a full stop or comma at its end) and what was cut off. Chunks and forms are cached."""

    def __init__(self, path: str, cached: int = 250_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.base = self.tokenizer.get_vocab_size(with_added_tokens=True)
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.last[i] = token.endswith("</w>")
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        added = self.tokenizer.get_added_tokens_decoder()
        self.mark, token = next(iter(added.items()))
        self.gap = f" {token.content} "
        self.cached = cached
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.stops = {x: int(np.frombuffer(self._one(x), "<u4")[0]) for x in ".,"}

    def _one(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    @staticmethod
    def _cut(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        return [ids[a:z].tobytes() for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]

    def _words(self, found: list[str]) -> list[bytes]:
        """Simple words, joined by spaces for one call; each ends with a token that ends a word."""
        ids = np.array(self.plain.encode_batch_fast([" ".join(found)], add_special_tokens=False)[0].ids if found else [], "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        return self._cut(ids, np.r_[0, ends[:-1]] if len(ends) else ends, ends)

    def _others(self, found: list[str]) -> list[bytes]:
        """Other chunks, with a special token between them, at which the ids of one call are cut again."""
        joined = self.gap.join(found)
        if joined.count(self.gap.strip()) != len(found) - 1:  # a text has special tokens of its own
            return [self._one(c) for c in found]
        ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(ids == self.mark)
        return self._cut(ids, np.r_[0, ends + 1], np.r_[ends, len(ids)])

    def _forms(self, forms: list[str]) -> list[bytes]:
        young, old = self.young, self.old
        out = list(map(young.get, forms))
        missing = [f for f, ids in zip(forms, out, strict=True) if ids is None]
        fresh = []
        for f in missing:
            if f in old:
                young[f] = old[f]
            else:
                fresh.append(f)
        simple, others = [], []
        for f in fresh:
            if _SIMPLE.fullmatch(f):
                simple.append(f)
            elif f:
                others.append(f)
        young[""] = b""
        young.update(zip(simple, self._words(simple), strict=True))
        young.update(zip(others, self._others(others) if others else [], strict=True))
        if missing:
            out = list(map(young.__getitem__, forms))
        for f in others:
            if len(f) > 64:
                del young[f]
        if len(young) > self.cached:
            self.old, self.young = young, {}
        return out

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text, the end id included."""
        cut = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        of = cut.flatten().dictionary_encode()
        chunks = of.dictionary
        latin = pc.match_substring_regex(chunks, f"^{_LATIN}[.,]?$")
        forms = pc.if_else(latin, pc.utf8_lower(pc.utf8_rtrim(chunks, ".,")), chunks).dictionary_encode()
        last = pc.if_else(latin, pc.utf8_slice_codeunits(chunks, -1), "")
        stop = np.select([pc.equal(last, x).to_numpy(zero_copy_only=False) for x in (".", ",")], [self.stops["."], self.stops[","]], -1)
        parts = self._forms(forms.dictionary.to_pylist())
        data = np.frombuffer(b"".join(parts), "<u4")
        size = np.fromiter((len(p) >> 2 for p in parts), np.int32, len(parts))
        start = np.cumsum(size, dtype=np.int32) - size
        # ids of each distinct chunk, its full stop or comma included; then of all chunks in their order
        form, stopped = forms.indices.to_numpy(), stop >= 0
        plain = size[form]
        whole = plain + stopped
        first = np.cumsum(whole, dtype=np.int32) - whole
        own = np.empty(int(whole.sum()), "<u4")
        own[runs(first, plain)] = data[runs(start[form], plain)]
        own[(first + plain)[stopped]] = stop[stopped]
        words = of.indices.to_numpy()
        size = whole[words]
        ids = own[runs(first[words], size)]
        ends = np.r_[0, np.cumsum(size, dtype=np.int32)][cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        out = np.insert(ids, ends[1:], END)
        ends = ends + np.arange(len(ends))
        return [out[a:z] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def compress(ids: np.ndarray, base: int, rounds: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (pairs of symbols), their expansion lengths and the sequence. Symbol base + k is rule k.

    Without ``rounds`` it ends when no pair occurs ``LEAST`` times without overlaps: the most frequent pair of a round gets all of its
    places, so a round that finds one makes a rule. A pair that is rare stays rare, as replacing only takes from it; so after the
    first round only the places of frequent pairs and those next to new symbols are counted again."""
    seq = ids.astype(np.int64)
    rules, lengths = np.empty((0, 2), np.int64), np.ones(0, np.int64)
    bits = max(base + len(seq) // LEAST + 1, int(seq.max()) + 1 if len(seq) else 0).bit_length()
    live = np.ones(len(seq), bool)  # where a pair begins that may be frequent
    for _ in count() if rounds is None else range(rounds):
        if len(seq) < 2 * LEAST:
            break
        place = np.flatnonzero(live[:-1])
        code = seq[place] << bits | seq[place + 1]
        # a run of one symbol holds its pair at every other place
        same = np.flatnonzero((code[1:] == code[:-1]) & (place[1:] == place[:-1] + 1)) + 1
        odd = same[:0]
        if len(same):
            new = np.r_[True, same[1:] != same[:-1] + 1]
            odd = same[(same - same[new][np.cumsum(new) - 1]) % 2 == 0]
            odd, code, place = place[odd], np.delete(code, odd), np.delete(place, odd)
        # pairs and their places in one number, so that one sort brings the places of each pair together
        shift = len(seq).bit_length()
        if 2 * bits + shift < 64:
            ordered = np.sort(code << shift | place)
            code, place = ordered >> shift, ordered & ((1 << shift) - 1)
        else:
            order = np.argsort(code, kind="stable")
            code, place = code[order], place[order]
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        counts = np.diff(np.r_[starts, len(code)])
        often = np.flatnonzero(counts >= LEAST)
        if not len(often):
            break
        top = often[np.argsort(-counts[often], kind="stable")[:NEW]]
        pairs = code[starts[top]]
        at, rank = place[runs(starts[top], counts[top])], np.repeat(np.arange(len(top)), counts[top])
        both = np.sort(at * NEW + rank)
        at, rank = both // NEW, both % NEW
        # of overlapping occurrences the most frequent pair wins, then the leftmost; the others wait for the next round
        touch = at[1:] == at[:-1] + 1
        first = rank[:-1] <= rank[1:]
        chosen = ~(np.r_[False, touch & first] | np.r_[touch & ~first, False])
        at, rank = at[chosen], rank[chosen]
        good = np.bincount(rank, minlength=len(pairs)) >= LEAST
        number = np.cumsum(good) - 1 + base + len(rules)
        at, rank = at[good[rank]], rank[good[rank]]
        new = np.stack([pairs[good] >> bits, pairs[good] & ((1 << bits) - 1)], axis=1)
        size = np.where(new < base, 1, np.r_[lengths, 0][np.minimum(np.maximum(new - base, 0), len(lengths))]).sum(1)
        rules, lengths = np.concatenate([rules, new]), np.concatenate([lengths, size])
        live = np.zeros(len(seq), bool)
        live[place[runs(starts[often], counts[often])]] = True
        live[odd] = live[at] = True
        live[np.maximum(at - 1, 0)] = True
        kept = np.ones(len(seq), bool)
        kept[at + 1] = False
        seq[at] = number[rank]
        seq, live = seq[kept], live[kept]
    return rules, lengths, seq


def _tables(rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expansions of all rules one after the other, their starts and sizes."""
    seq, of = rules.reshape(-1), np.repeat(np.arange(len(rules), dtype=np.int32), 2)
    while (seq >= base).any():
        n = np.where(seq >= base, 2, 1)
        child = np.repeat(seq, n)
        second = np.arange(len(child)) - np.repeat(np.cumsum(n) - n, n)
        new = child >= base
        child[new] = rules[child[new] - base, second[new]]
        seq, of = child, np.repeat(of, n)
    size = np.bincount(of, minlength=len(rules)).astype(np.int32)
    return seq.astype("<u4"), (np.cumsum(size) - size).astype(np.int32), size


def expand(seq: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """Token ids of a sequence of symbols."""
    seq = seq.astype(np.int32)
    data, start, size = _tables(rules.astype(np.int64), base)
    new = seq >= base
    n = np.where(new, np.r_[size, np.int32(1)][np.where(new, seq - base, 0)], 1).astype(np.int32)
    done = np.cumsum(n, dtype=np.int32)
    out = np.empty(done[-1] if len(done) else 0, "<u4")
    out[(done - 1)[~new]] = seq[~new]
    rule = seq[new] - base
    out[runs((done - n)[new], n[new])] = data[runs(start[rule], n[new])]
    return out


def pack(ids: list[np.ndarray], base: int) -> dict:
    rules, lengths, seq = compress(np.concatenate(ids), base)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    return {
        "base": base, "rules": rules.astype("<u4").tobytes(), "lengths": lengths.astype("<u4").tobytes(), "width": width, "sequence": seq.astype(f"<u{width}").tobytes(),
    }


def unpack(shard: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules, lengths and sequence of a shard row."""
    rules = np.frombuffer(shard["rules"], "<u4").reshape(-1, 2).astype(np.int64)
    return rules, np.frombuffer(shard["lengths"], "<u4").astype(np.int64), np.frombuffer(shard["sequence"], f"<u{shard['width']}").astype(np.int64)


class Shard:
    """Random access to the tokens of a shard row: only the symbols that cover a range are expanded."""

    def __init__(self, row: dict):
        self.base = row["base"]
        self.rules, lengths, self.seq = unpack(row)
        self.size = np.where(self.seq < self.base, 1, np.r_[lengths, 1][np.clip(self.seq - self.base, 0, len(lengths))])
        self.ends = np.cumsum(self.size)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Tokens start to stop (exclusive)."""
        start, stop = max(0, start), min(stop, int(self.ends[-1]) if len(self.ends) else 0)
        if start >= stop:
            return np.empty(0, np.int64)
        a, b = np.searchsorted(self.ends, start, "right"), np.searchsorted(self.ends, stop, "left") + 1
        skip, seq = start - int(self.ends[a] - self.size[a]), self.seq[a:b]
        while (new := seq >= self.base).any():  # a level of rules at a time
            n = np.where(new, 2, 1)
            first = np.cumsum(n) - n
            out = np.empty(int(n.sum()), np.int64)
            out[first] = np.where(new, self.rules[np.where(new, seq - self.base, 0), 0], seq)
            out[first[new] + 1] = self.rules[seq[new] - self.base, 1]
            seq = out
        return seq[skip : skip + stop - start]


def read_range(shard: dict, start: int, stop: int) -> np.ndarray:
    """Tokens start to stop (exclusive) of a shard row."""
    return Shard(shard).read(start, stop)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> None:
    """Encodes all documents in ascending order of id and writes the files to ``path``."""
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "id").sortWithinPartitions("id")

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part = encoder(tokenizer), TaskContext.get().partitionId()
        seq = first = size = 0
        names: list[int | None] = []
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            row = {"part": part, "seq": seq, "first_token": first, "n_tokens": size, "doc_ids": names, "doc_tokens": [len(x) for x in held]} | pack(held, e.base)
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for b in joined(batches, 12 << 20):
            for name, ids in zip(b.column(0).to_pylist(), e.encode(b.column(1)), strict=True):
                names.append(name)
                held.append(ids)
                size += len(ids)
                if size >= shard:
                    yield out()
                    seq, first, size, names, held = seq + 1, first + size, 0, [], []
        if held:
            yield out()

    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    arrow = pa.schema([(name, kinds[kind]) for name, kind in (x.split(" ") for x in SCHEMA.split(", "))])
    rows.mapInArrow(run, SCHEMA).write.mode("overwrite").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document in the files; ids are little-endian unsigned 32-bit integers."""
    shards = spark.read.schema(SCHEMA).parquet(path)
    sizes = sorted(shards.groupBy("part").agg(F.sum("n_tokens")).collect())  # a row for each partition of the writer
    before, total = [], 0
    for part, n in sizes:
        before.append((part, total))
        total += n
    bases = spark.createDataFrame(before, "part int, before long")

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                rules, _, seq = unpack(row)
                ids = expand(seq, rules, row["base"])
                ends = np.cumsum(row["doc_tokens"])
                starts = ends - np.array(row["doc_tokens"])
                blobs = [ids[a:z].tobytes() for a, z in zip(starts, ends, strict=True)]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(np.full(len(blobs), row["part"], np.int32)), pa.array(starts + row["first_token"], pa.int64()), pa.array(blobs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "first", "ids"])

    docs = shards.mapInArrow(run, "doc_id long, part int, first long, ids binary")
    return docs.join(F.broadcast(bases), "part").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "ids")


def read_documents(spark: SparkSession, path: str, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of the documents in the files whose ids are in ``wanted``, by random access: only shards that hold one are read
    whole, and of these only the symbols that cover the documents are expanded. A shard's own documents bound a row."""
    shards = spark.read.schema(SCHEMA).parquet(path)
    places = shards.select("part", "seq", F.posexplode("doc_ids").alias("place", "doc_id"))
    hits = places.join(wanted.select(F.col(id_col).cast("long").alias("doc_id")).distinct(), "doc_id").groupBy("part", "seq").agg(F.sort_array(F.collect_list("place")).alias("places"))
    rows = shards.join(hits, ["part", "seq"]).select("base", "rules", "lengths", "width", "sequence", "doc_ids", "doc_tokens", "places")

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                shard, ends = Shard(row), np.cumsum(row["doc_tokens"]).tolist()
                blobs = [shard.read(ends[k] - row["doc_tokens"][k], ends[k]).astype("<u4").tobytes() for k in row["places"]]
                names = [row["doc_ids"][k] for k in row["places"]]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "ids"])

    return rows.mapInArrow(run, "doc_id long, ids binary")


def store_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the files to the shared folder, reads them back: (doc_id, start, n_tokens, ids_crc32)."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer)
    back = read_tokens(spark, path)
    return back.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())

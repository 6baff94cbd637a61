"""Each operator against a brute-force version, the library it has to equal, an exact round trip or held-out rows; and
the odd rows: nulls, blanks, long texts, ties, repeats, empty tables, clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm import chat_format, decontaminate, piece_codec, rule_ledger, secret_scan, simhash_dedup, site_quality, token_store, toxicity, url_filter

WORDS = "alpha beta gamma delta omega river stone cloud paper green seven north light field ocean table".split()
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("word_bpe_49k.json")
DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Null, blank, repeated and tied rows.
ODD = [None, "", " \n\t", "one", "one", "one two", "é 漢字 😀", "the same text here", "the same text here"]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", ".", ","]) + r.choice(["", "\n"]) for _ in range(n))


def table(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], DOC)


def clashing(df):
    """The table with columns that operators use inside."""
    return df.withColumns({c: F.lit(1) for c in ("fp", "words", "ids", "h", "start", "n", "token", "root", "id", "label", "spans", "score", "host", "path", "fold")})


@pytest.fixture(scope="module")
def odd(spark):
    return clashing(table(spark, [*ODD, prose(30_000, 1)]))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


# --- 1 -------------------------------------------------------------------------------------------------------------


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_url_rules(spark):
    hosts = ["org", "example.org", "a.Example.ORG", "xexample.org", "b.com", "com", "net", "", "ÀB.org", "a..org", "org.", "x" * 500 + ".com"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/123?x=/es/", "/fr/x#y", "/de/", "?q", "#f", "/" + "p" * 5000]
    urls = [f"{s}{h}{p}" for s in ("http://", "x://", "") for h in hosts for p in paths] + [None, "", "http://a.org/x://b.com/de/"]
    pages = clashing(spark.createDataFrame([(i, u) for i, u in enumerate(urls * 2)], "page_id long, url string"))
    got = {r.page_id: (r.host, r["path"], r.rule, r.verdict) for r in url_filter.judge(pages, url_filter.rule_table(spark)).collect()}
    assert got == {i: brute_rule(u) for i, u in enumerate(urls * 2)}
    none = spark.createDataFrame([], "verdict string, rule_host string, rule_path string")
    assert {r.verdict for r in url_filter.judge(pages, none).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), url_filter.rule_table(spark)).count() == 0


def test_more_rules_than_are_broadcast(spark, monkeypatch):
    urls = [f"http://{h}{p}" for h in ("org", "x.example.org", "a.com", "net") for p in ("/", "/es/1", "/en/12", "/fr/", "/de/")]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 2)
    judged = url_filter.judge(pages, url_filter.rule_table(spark))
    assert {r.page_id: (r.host, r["path"], r.rule, r.verdict) for r in judged.collect()} == {i: brute_rule(u) for i, u in enumerate(urls)}


# --- 2 and 3 -------------------------------------------------------------------------------------------------------

BITS = [" ", "▁", "\n", "\t", "a", "e", "é", "th", "ing", " the", "\r", "\0", "漢", "😀", "\u0301", "\u200b", "\u3000", "\xa0", "<s>", "</s>", "<0x0A>", ".", ",", "  ", "ﬁ", "½", "'s", "don't", "<|endoftext|>", "Σ", "İ", "\x1c", "\x85", "A", "É"]


def odd_texts(n):
    r = random.Random(4)
    out = ["".join(r.choice(BITS) for _ in range(r.randint(0, 40))) for _ in range(n)]
    return out + ["".join(chr(r.choice([r.randint(1, 0x2FF), r.randint(0x300, 0xD7FF), r.randint(0x10000, 0x1FFFF)])) for _ in range(30)) for _ in range(n // 4)]


def test_pieces_equal_the_library():
    own, lib = piece_codec.PieceCodec(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [*odd_texts(2000), prose(3000, 2), "x" * 3000, " " * 300, "▁▁a"]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == [*lib.encode(text), 2]
        assert own.decode(ids.tolist()) == lib.decode(ids.tolist())


def test_piece_table(spark, odd, none):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    encoded = piece_codec.encode_documents(odd, PIECES, decode=True)
    texts = {r.doc_id: r.text or "" for r in odd.select("doc_id", "text").collect()}
    for r in encoded.collect():
        assert list(r.ids) == [*lib.encode(texts[r.doc_id]), 2] and r.decoded == texts[r.doc_id]
    back = piece_codec.decode_documents(encoded.drop("decoded"), PIECES)
    assert {r.doc_id: r.decoded for r in back.collect()} == texts
    assert piece_codec.encode_documents(none, PIECES).count() == 0


def test_chunks_equal_the_library():
    own, lib = token_store.ChunkEncoder(BPE, cached=300), Tokenizer.from_file(BPE)
    texts = [*odd_texts(2000), prose(3000, 3), "x" * 3000, "A. a, É, É. .,"]
    for at in range(0, len(texts), 50):
        part = texts[at : at + 50]
        for text, ids in zip(part, own.encode(pa.array(part)), strict=True):
            assert ids.tolist() == [*lib.encode(text, add_special_tokens=False).ids, 1]


def test_grammar_round_trip_and_random_access():
    r = np.random.default_rng(0)
    for n in (0, 1, 2, 50, 5000, 40_000):
        ids = r.integers(2, 9, n).astype("<u4")
        shard = token_store.pack([ids], 49408)
        rules, lengths, seq = token_store.unpack(shard)
        assert (token_store.expand(seq, rules, 49408) == ids).all()
        assert n < 40_000 or len(seq) < n / 2
        assert [len(token_store.expand(np.array([49408 + i]), rules, 49408)) for i in range(len(rules))] == lengths.tolist()
        for _ in range(20):
            a, b = sorted(r.integers(0, n + 1, 2).tolist())
            assert (token_store.read_range(shard, a, b) == ids[a:b]).all()


def test_token_files(spark, odd, none, tmp_path):
    lib = Tokenizer.from_file(BPE)
    path = str(tmp_path / "tokens")
    token_store.write_tokens(odd.repartition(3), path, BPE, shard=500)
    back = {r.doc_id: r for r in token_store.read_tokens(spark, path).collect()}
    start = 0
    for r in odd.orderBy("doc_id").collect():
        ids = np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        assert back[r.doc_id].start == start and bytes(back[r.doc_id].ids) == ids.tobytes()
        start += len(ids)
    some = odd.filter("doc_id in (2, 5, 9)").select("doc_id")
    assert {r.doc_id: bytes(r.ids) for r in token_store.read_documents(spark, path, some).collect()} == {i: bytes(back[i].ids) for i in (2, 5, 9)}
    assert token_store.read_documents(spark, path, some.limit(0)).count() == 0
    assert token_store.store_digests(odd, BPE).filter("n_tokens = 1").first().ids_crc32 == zlib.crc32(b"\1\0\0\0")
    assert token_store.store_digests(none, BPE).count() == 0


def test_grammar_is_driven_to_its_end():
    r = np.random.default_rng(2)
    phrase = r.integers(10, 40_000, 64)
    for ids in (np.tile(phrase, 40), np.full(3_000, 7), r.integers(10, 60, 20_000), np.concatenate([np.r_[phrase[:9], x] for x in r.integers(0, 9, 200)])):
        rules, lengths, seq = token_store.compress(ids, 49408)
        assert (token_store.expand(seq, rules, 49408) == ids).all()
        uses, last = collections.Counter(), {}
        for i, pair in enumerate(zip(seq[:-1].tolist(), seq[1:].tolist())):
            if last.get(pair) != i - 1:
                uses[pair] += 1
                last[pair] = i
        assert max(uses.values(), default=0) < token_store.LEAST
    assert token_store.compress(np.tile(phrase, 40), 49408)[1].max() > 8
    for ids in (np.full(100_000, 7), np.tile([1, 2], 5_000)):  # equal ids and a repeated pair shrink to almost nothing
        rules, _, seq = token_store.compress(ids, 49408)
        assert len(rules) < 20 and len(seq) < 20 and (token_store.expand(seq, rules, 49408) == ids).all()


# --- 4 -------------------------------------------------------------------------------------------------------------


def test_chat_round_trip():
    r = random.Random(5)
    bits = ["<|im_end|>", "<|im_start|>", "<\\|im_end|>", "<\\\\|im_start|>", "\n", "user", "assistant", "\\", "<|", "|>", "x", "é", "\\n", ""]
    for _ in range(3000):
        turns = [("".join(r.choice(bits) for _ in range(r.randint(0, 4))), "".join(r.choice(bits) for _ in range(r.randint(0, 8)))) for _ in range(r.randint(0, 4))]
        text, spans = chat_format.render(turns)
        assert chat_format.parse(text) == turns
        assert [chat_format.unescape(text[a:z]) for a, z in spans] == [t for role, t in turns if role == "assistant"]
    plain = [("user", "a \\ b <| c")]
    assert chat_format.render(plain)[0] == "<|im_start|>user\na \\ b <| c<|im_end|>\n"
    assert chat_format.parse("<|im_start|>user\nx") is None


def test_chat_table(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (2, None, None, "x"), (None, 0, "user", "y"), (3, 0, "assistant", "z" * 50_000)]
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(chat_format.with_conflict(df))).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[1].n_turns == 3 and got[1].turns_sha256 == sha("user\n\nassistant\nb\nassistant\nb\n") and got[1].loss_sha256 == sha("bb")
    said = "<|im_end|><|im_start|>assistant ok"
    assert got[-1].loss_chars == len(said) and got[-1].loss_sha256 == sha(said) and got[-1].turns_sha256 == sha(f"user\n{said}\nassistant\n{said}\n")
    assert got[3].loss_chars == 50_000 and got[None].n_turns == 1 and got[2].turns_sha256 == sha("\nx\n")
    assert chat_format.format_conversations(df.limit(0)).count() == 0
    out = chat_format.format_conversations(df)
    again = chat_format.read_back(out.repartition(7)).collect()  # in any order
    assert {r.conv_id: r for r in again} == {k: v for k, v in got.items() if k != -1}
    whole = "".join(r.formatted for r in out.filter("conv_id = 1").orderBy("place").collect())
    spans = [(r.loss_start, r.loss_end) for r in out.filter("conv_id = 1 and loss_start is not null").orderBy("place").collect()]
    assert [whole[a:z] for a, z in spans] == ["b", "b"] and chat_format.parse(whole) == [("user", ""), ("assistant", "b"), ("assistant", "b")]
    with pytest.raises(Exception, match="conversation 1: what begins at 0"):
        chat_format.read_back(out.filter("conv_id = 1").withColumn("formatted", F.lit("odd"))).collect()


@pytest.mark.parametrize("kind", ["int", "double", "string"])
def test_chat_turns_of_other_types(spark, kind):
    rows = spark.createDataFrame([(1, 2, "assistant", "b"), (1, 0, "user", "a"), (1, None, "system", "s")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(chat_format.with_conflict(rows.withColumn("turn", F.col("turn").cast(kind))))).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"system\ns\nuser\na\nassistant\nb\n").hexdigest() and got[-1].n_turns == 2


def test_chat_of_very_many_turns(spark):
    rows = spark.range(60_000).selectExpr("if(id % 3 = 0, null, 7) conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "concat('turn ', id) text")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(rows), ordered=True).collect()}
    for name, ids in ((7, [i for i in range(60_000) if i % 3]), (None, range(0, 60_000, 3))):
        said = "".join(f"{'assistant' if i % 2 else 'user'}\nturn {i}\n" for i in ids)
        learned = "".join(f"turn {i}" for i in ids if i % 2)
        assert got[name].n_turns == len(ids) and got[name].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[name].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest() and got[name].loss_chars == len(learned)


# --- 5 and 7 -------------------------------------------------------------------------------------------------------


def labelled(spark, bad):
    """400 documents; every fifth has words that ``bad`` makes."""
    texts, rows = [], []
    for i in range(600):
        words = prose(60, i).split()
        if i % 5 == 3:
            r = random.Random(i)
            for _ in range(3):
                words.insert(r.randrange(len(words)), bad(r))
        texts.append(" ".join(words))
        rows.append((i, 0 if i % 5 == 3 else 1, 1 if i % 5 == 3 else 0))
    return table(spark, texts), spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark, odd, none):
    docs, labels = labelled(spark, lambda r: "zork" + r.choice(["el", "ina", "ot", "um", "ax", "ith"]))
    got = toxicity.score(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(got) > 50 and sum(r.predicted == r.toxic for r in got) >= 0.97 * len(got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    scores = {r.doc_id: r.score for r in toxicity.score(odd, labels).collect()}
    assert len(scores) == 10 and all(0 <= s <= 1 for s in scores.values()) and scores[0] == scores[1] == scores[2] and scores[3] == scores[4]
    assert toxicity.score(none, labels).count() == 0
    assert {r.score for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}
    kept = {r.doc_id for r in toxicity.keep_ordinary(docs, labels).collect()}
    assert len(kept & {i for i in range(600) if i % 5 != 3}) >= 475 and len(kept & {i for i in range(600) if i % 5 == 3}) <= 5


def test_toxicity_never_learns_from_held_out_rows(spark):
    docs, labels = labelled(spark, lambda r: "zorkel")
    flipped = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity.score(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_site_quality(spark, odd, none):
    docs, labels = labelled(spark, lambda r: "# $ % | | #")
    got = site_quality.score(docs, labels, "source").join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.97 * len(got)
    assert site_quality.score(odd, labels, "source").count() == 10
    assert site_quality.score(none, labels, "source").count() == 0
    assert site_quality.score(docs, labels.limit(0), "source").count() == 600


def test_sparse_sites_shrink_to_the_prior(spark):
    docs, labels = labelled(spark, lambda r: "# $ % | | #")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 5 == 3, F.when(F.col("doc_id") == 3, "tiny").otherwise("bad")).otherwise("good"))
    post = {r.source: r.p for r in site_quality.score(docs, labels, "source").join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.first("host_posterior").alias("p")).collect()}
    assert post["bad"] < post["tiny"] < post["good"]


def brute_strength(groups):
    """From (mean, n, around) of each group."""
    n = sum(g[1] for g in groups)
    v = [a * (1 - a) for _, _, a in groups]
    within = sum(x * g[1] for x, g in zip(v, groups)) / n
    between = max((sum((m - a) ** 2 * k for m, k, a in groups) - sum(v)) / n, 1e-4 * within)
    return min(max(within / between, 1), 1e4)


def test_posteriors_equal_brute_force(spark):
    r = random.Random(77)
    rows = [(f"h{r.randrange(6)}", f"p{r.randrange(4)}", r.random() * r.choice([0.2, 0.6, 1])) for _ in range(400)]
    got, mean, k_host, k_path = site_quality.posteriors(spark.createDataFrame(rows, "host string, path string, own double"))
    hosts, paths = collections.defaultdict(list), collections.defaultdict(list)
    for h, p, x in rows:
        hosts[h].append(x)
        paths[h, p].append(x)
    whole = sum(x for *_, x in rows) / len(rows)
    kh = brute_strength([(np.mean(x), len(x), whole) for x in hosts.values()])
    host = {h: (sum(x) + kh * whole) / (len(x) + kh) for h, x in hosts.items()}
    prior = {(h, p): (sum(hosts[h]) - sum(x) + kh * whole) / (len(hosts[h]) - len(x) + kh) for (h, p), x in paths.items()}
    kp = brute_strength([(np.mean(x), len(x), prior[k]) for k, x in paths.items()])
    assert np.allclose([mean, k_host, k_path], [whole, kh, kp])
    for x in got.collect():
        own = paths[x.host, x["path"]]
        assert np.isclose(x.host_posterior, host[x.host]) and np.isclose(x.path_posterior, (sum(own) + kp * prior[x.host, x["path"]]) / (len(own) + kp))


def test_no_document_is_in_its_own_prior(spark):
    docs, labels = labelled(spark, lambda r: "# $ % | | #")
    docs = docs.withColumn("source", F.when(F.col("doc_id") < 300, F.concat(F.lit("http://a.org/x"), F.col("doc_id") % 3, F.lit("/y?z"))).otherwise("b"))
    rows = {r.doc_id: r for r in site_quality.score(docs, labels, "source").collect()}
    lone = site_quality.score(docs.withColumn("source", F.when(F.col("doc_id") == 3, "lone").otherwise(F.lit("b"))), labels, "source").filter("doc_id = 3").first()
    # a site of one document has no other: its posterior is the prior above, so its score is its own evidence
    assert lone.score < 0.05 and 0 < lone.path_posterior < 0.9 and lone.host_posterior < 0.9
    assert len({rows[i].path_posterior for i in range(300)}) == 3 and len({rows[i].host_posterior for i in range(600)}) == 2
    sites = spark.createDataFrame([("http://a.org/x/y",), ("a.org",), (None,), ("a.org/x?q",)], "s string")
    assert [tuple(r) for r in sites.select(site_quality.host_of(F.col("s")), site_quality.path_of(F.col("s"))).collect()] == [("a.org", "x"), ("a.org", ""), ("", ""), ("a.org", "x")]


def small_model(spark, n=40):
    """A model of folds 1 to 3 of labelled texts over all texts, and both."""
    texts = [(1 + i // 2 % 4, i % 2, f"{prose(30, 700 + i)} {'vile' if i % 2 else 'kind'}{i}") for i in range(n)]
    rows = spark.createDataFrame(texts, "fold int, toxic int, text string")
    more = [f"{prose(20, 900 + i)} unlabelled{i}" for i in range(n)]
    return toxicity.train(rows, rows.select("text").unionByName(spark.createDataFrame([(x,) for x in more], "text string"))), texts, more


def strings(words, k):
    for w in words:
        raw = b"\x01" + w + b"\x02"
        yield from (raw[j : j + k] for j in range(len(raw) - k + 1) if j + k > 1)


def as_key(g):
    return int.from_bytes(g, "big") | len(g) << 56


class BruteModel:
    """Modified Kneser-Ney by dictionaries: orders 6 to 4 of one class over orders 3 to 1 of all texts."""

    def __init__(self, own, everything):
        self.n = {}
        for k in range(1, 7):
            words = everything if k <= 3 else own
            raw = collections.Counter(strings(words, k))
            before = collections.Counter(g[1:] for g in set(strings(words, k + 1)))
            self.n[k] = {g: c if k == 6 or g[0] == 1 else before[g] for g, c in raw.items()}
        self.d = {}
        for k, n in self.n.items():
            c = [sum(x == i for x in n.values()) for i in (1, 2, 3, 4)]
            y = c[0] / max(1, c[0] + 2 * c[1])
            some = all(c)
            self.d[k] = [0, *([min(max(i - (i + 1) * y * c[i] / c[i - 1], 0.05), i) for i in (1, 2, 3)] if some else toxicity.DISCOUNTS)]

    def chance(self, ctx, byte):
        """Of a byte after all bytes of the word so far, the start sign included."""
        p = 1 / 256
        for k in range(1, min(6, len(ctx) + 1) + 1):
            c = ctx[len(ctx) - k + 1 :]
            seen = {g: n for g, n in self.n[k].items() if g[:-1] == c and n}
            total = sum(seen.values())
            if total:
                n = seen.get(c + bytes([byte]), 0)
                left = sum(self.d[k][min(x, 3)] for x in seen.values())
                p = (n - self.d[k][min(n, 3)]) / total + left / total * p
        return p


def test_models_equal_brute_force(spark):
    model, texts, more = small_model(spark)
    everything = [w for t in [x[2] for x in texts] + more for w in toxicity.words(t)]
    brute = [BruteModel([w for f, c, t in texts if f < 4 and c == k for w in toxicity.words(t)], everything) for k in (0, 1)]
    for w in (b"vile1", b"kind", b"river", b"unlabelled3", b"zq", b"a", "\u00e9t\u00e9".encode()):
        raw = b"\x01" + w + b"\x02"
        want = sum(np.log(brute[1].chance(raw[:i], raw[i])) - np.log(brute[0].chance(raw[:i], raw[i])) for i in range(1, len(raw)))
        assert abs(model.ratios([w])[0] - want) < 1e-4


def test_every_context_sums_to_one(spark):
    model, texts, _ = small_model(spark)
    contexts = {b"\x01" + w[:j] for _, _, t in texts[:12] for w in toxicity.words(t) for j in range(len(w) + 1)} | {b"\x01", b"\x01qqqqqq", b"\x01zz"}
    for c in contexts:
        assert np.abs(model.chances(np.array([as_key((c + bytes([b]))[-6:]) for b in range(256)])).sum(0) - 1).max() < 1e-5


def test_models_keep_every_string(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "HELD_WORDS", 50)  # handing over more often must not change the model
    model, texts, more = small_model(spark)
    own = [w for f, _, t in texts if f < 4 for w in toxicity.words(t)]
    everything = [w for t in [x[2] for x in texts] + more for w in toxicity.words(t)]
    assert {int(x) for x in model.own[0]} == {as_key(g) for k in (4, 5, 6) for g in strings(own, k)}
    assert {int(x) for x in model.base[0]} == {as_key(g) for k in (1, 2, 3) for g in strings(everything, k)}


# --- 6 -------------------------------------------------------------------------------------------------------------


def brute_contaminated(docs, items):
    def shingles(words, k):
        return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]

    out = {}
    for d, text in docs:
        words = re.findall(r"[^ \t-\r]+", (text or "").lower())
        for i, item in items:
            own = re.findall(r"[^ \t-\r]+", (item or "").lower())
            if not own:
                continue
            k = min(5, len(own))
            want, best = collections.Counter(shingles(own, k)), 0
            for s in range(max(1, len(words) - len(own) + 1)):
                have = collections.Counter(shingles(words[s : s + len(own)], k))
                both = sum((want & have).values())
                best = max(best, both / max(1, sum(have.values()) + sum(want.values()) - both))
            if best >= 0.8:
                out[d, i] = round(best, 6)
    return out


def test_contamination_equals_brute_force(spark, none):
    r = random.Random(6)
    items = [" ".join(r.choice(WORDS) for _ in range(r.choice([1, 3, 5, 30, 45, 60]))) for _ in range(14)]
    docs = []
    for i in range(90):
        words = prose(r.choice([0, 20, 120]), 100 + i).replace(".", "").replace(",", "").split()
        if i % 2:
            part = r.choice(items).split()
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                k = r.randrange(len(part))
                part[k : k + r.choice([0, 1])] = [r.choice(["zzz", "yyy"])]
            at = r.randrange(len(words) + 1)
            words[at:at] = part * r.choice([1, 1, 2])
        docs.append((i, " ".join(words).upper() if i % 7 == 0 else "\n".join(words)))
    docs += [(90, None), (91, ""), (92, docs[1][1]), (93, docs[1][1])]
    items = [*enumerate(items), (50, None), (51, " ")]
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): round(x.similarity, 6) for x in decontaminate.contaminated(df, bench).collect()}
    assert got == brute_contaminated(docs, items) and len(got) > 30
    kept = {x.doc_id for x in decontaminate.drop_contaminated(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}
    assert decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0


def test_items_of_any_length(spark):
    r = random.Random(67)
    varied = " ".join(f"{r.choice(WORDS)}{r.randrange(1000)}" for _ in range(70_000))
    docs = [(1, varied), (2, "again " * 70_000), (3, prose(50, 3))]
    bench = spark.createDataFrame(docs[:2], "item_id long, text string")
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {(x.doc_id, x.item_id, x.start, x.n_words, x.similarity) for x in got} == {(1, 1, 0, 70_000, 1.0), (2, 2, 0, 70_000, 1.0)}


def test_repeated_and_null_item_ids_equal_brute_force(spark):
    r = random.Random(66)
    texts = [" ".join(r.choice(WORDS) for _ in range(n)) for n in (30, 30, 30, 12, 3)]
    items = [(1, texts[0]), (1, texts[1]), (1, texts[0]), (None, texts[2]), (None, texts[3]), (2, texts[3].upper()), (3, None), (None, texts[4])]
    docs = [(i, f"{prose(15, 200 + i)} {t} {prose(15, 300 + i)}") for i, t in enumerate(texts)]
    docs += [(8, prose(40, 8)), (9, f"{texts[1]} {texts[0]}"), (None, texts[2])]
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.contaminated(df, bench).collect()
    got = {(x.doc_id, x.item_id): round(x.similarity, 6) for x in rows}
    want: dict = {}
    for item in items:  # one by one, as an id can have several texts
        for at, s in brute_contaminated(docs, [item]).items():
            want[at] = max(s, want.get(at, 0))
    assert got == want and len(rows) == len(got) and len(got) >= 9
    kept = {x.doc_id for x in decontaminate.drop_contaminated(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


# --- 8 -------------------------------------------------------------------------------------------------------------

ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def brute_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16])


def test_base_spans_equal_brute_force(spark, odd, none):
    r = random.Random(7)
    bits = ["password", "Secret", "TOKEN", "api_key", "apikey", "=", ":", " ", '"', "'", "abcdefghijklm", "AKIA", "ABCDEF0123456789", "0123456789abcdef", "é", "😀", "\n", "x", ".", "short"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(1500)]
    df = table(spark, texts)
    got = {x.doc_id: x for x in secret_scan.findings(df).collect()}
    for i, t in enumerate(texts):
        want = ",".join(f"{secret_scan.KINDS[k]}:{a}:{z}" for a, k, z in brute_spans(t))
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(got[i].spans.split(","))
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == j for _, k, _ in brute_spans(t)) for j in range(3))
    assert secret_scan.findings(odd).filter("spans = ''").count() == 10
    assert secret_scan.findings(none).count() == 0


def brute_battery(t):
    """(even, p) of one token, test by test."""
    kinds = [("digits", r"[0-9]+"), ("hex", r"[0-9a-f]+|[0-9A-F]+"), ("base32", r"[A-Z2-7=]+"), ("letters", r"[a-z]+|[A-Z]+"), ("alnum", r"[a-z0-9]+|[A-Z0-9]+")]
    kind = next((k for k, pattern in kinds if re.fullmatch(pattern, t)), "base64")
    n, size, change, plain = len(t), secret_scan.SIZES[kind], secret_scan.CHANGE[kind], secret_scan.ORDINARY_CHANGE[kind]
    chi = sum(c * c for c in collections.Counter(t).values()) * size / n - n
    free, gaps, shift = size - 1, n - 1, n * max(size * secret_scan.ORDINARY_SQUARES - 1, 0.5)
    changes = len(re.findall(r"[A-Z]?[a-z]+|(?:[A-Z](?![a-z]))+|[0-9]+|[^A-Za-z0-9]+", t)) - 1
    q = max(change, 0.01)
    runs = (changes - gaps * q) / (gaps * q * (1 - q)) ** 0.5 if change else 0
    codes = [ord(c) for c in t]
    mean = sum(codes) / n
    var = sum((x - mean) ** 2 for x in codes)
    serial = (sum((x - mean) * (y - mean) for x, y in zip(codes, codes[1:])) / var if var else 1) * n**0.5
    even = all(abs(z) < secret_scan.LIMIT for z in (runs, serial)) and (chi - free) / (2 * free * gaps / n) ** 0.5 < secret_scan.LIMIT
    z = ((chi - free - shift) / (2 * (free + 2 * shift)) ** 0.5 + ((gaps * plain - changes) / (gaps * plain * (1 - plain)) ** 0.5 if change else 0)) / 2**0.5
    return even, math.erfc(-z / 2**0.5) / 2


ALPHABETS = {
    "hex": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "alnum": "abcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
PLAIN = ["".join, "-".join, lambda w: "_".join(w).upper(), lambda w: "".join(x.title() for x in w), lambda w: "/".join(w) + "/2024"]


def token(r, alphabet, n):
    return "".join(r.choice(alphabet) for _ in range(n))


def test_tail_is_right_relatively(spark):
    z = [-25.0, -12.0, -8.0, -7.0, -6.0, -5.0, -4.0, -3.0, -1.0, -1e-9, 0.0, 0.5, 2.0, 6.0, 30.0]
    df = spark.createDataFrame([(x,) for x in z], "z double")
    got = {r.z: r.p for r in df.select("z", secret_scan._lower_tail(F.col("z")).alias("p")).collect()}
    assert all(np.isclose(got[x], math.erfc(-x / 2**0.5) / 2, rtol=3e-7, atol=0) for x in z)


def test_ordinary_tokens_pass_as_random_as_rarely_as_stated(spark):
    """The p-value of an ordinary token is below 0.001 for at most 0.1 % of them."""
    r = random.Random(4)
    tokens = [r.choice(PLAIN)(r.choices(WORDS, k=r.randint(4, 8))) for _ in range(4000)]
    df = table(spark, [t for t in tokens if len(t) >= 20])
    got = [x.t[0] for x in df.select(secret_scan.battery(F.array("text")).alias("t")).collect()]
    assert sum(t.even and t.p < 0.001 for t in got) <= 4


def test_the_labelled_sample_is_bounded_by_its_characters(spark):
    rows = [(1, 0, "x" * (10 if i % 2 else 30), i // 3) for i in range(30)] + [(1, 1, None, 0)]
    sample = spark.createDataFrame(rows, "fold int, toxic int, text string, part int")
    size = lambda df: df.agg(F.sum(F.length("text"))).first()[0]
    assert toxicity.within(sample, 600).count() == 31
    cut = toxicity.within(sample, 200)
    assert size(cut) <= 200 and size(sample.filter(F.col("part") <= cut.agg(F.max("part")).first()[0] + 1)) > 200
    assert toxicity.within(sample, 5).count() == 0 and toxicity.within(sample.limit(0), 5).count() == 0


def test_battery_and_discoveries_equal_brute_force(spark):
    r = random.Random(18)
    tokens = [token(r, a, r.choice([20, 24, 32, 40, 64, 100])) for a in ALPHABETS.values() for _ in range(40)]
    tokens += [r.choice(PLAIN)(r.choices(WORDS, k=6)) for _ in range(150)] + ["a" * 40, "0" * 30, "Ab" * 20, "1234567890" * 3, "=" * 25]
    tokens = [t for t in tokens if len(t) >= 20]
    df = table(spark, [f"see {t} there" for t in tokens])
    got = {x.doc_id: x.t[0] for x in df.select("doc_id", secret_scan.battery(F.array(F.substring_index(F.substring_index("text", " ", 2), " ", -1))).alias("t")).collect()}
    want = [brute_battery(t) for t in tokens]
    for i, t in enumerate(tokens):
        assert got[i].token == t and got[i].even == want[i][0] and np.isclose(got[i].p, want[i][1], rtol=1e-6)
    # the step-up rule, stratum by stratum
    found = {i: x.spans for i, x in ((x.doc_id, x) for x in secret_scan.findings(df).collect())}
    bins = [min(secret_scan.BINS, max(0, int(np.floor(-10 * np.log10(max(p, 1e-40)))))) if even else 0 for even, p in want]
    level = [int(np.log2(len(t))) for t in tokens]
    for k in set(level):
        own = [bins[i] for i in range(len(tokens)) if level[i] == k]
        good = [b for b in set(own) if b > 0 and 10 ** (-b / 10) * len(own) <= secret_scan.FDR * sum(x >= b for x in own)]
        for i in range(len(tokens)):
            if level[i] == k:
                free = not any(a < 4 + len(tokens[i]) and 4 < z for a, _, z in brute_spans(f"see {tokens[i]} there"))
                assert ("random" in found[i]) == (bool(good) and bins[i] >= min(good) and free)


@pytest.mark.parametrize("kind", ALPHABETS)
def test_random_tokens_are_found_and_words_are_not(spark, kind):
    r = random.Random(8)
    sizes = {"base64": [20, 24, 32, 40, 64], "base32": [48, 64, 100]}.get(kind, [32, 40, 64])  # the lengths from which the tests can tell
    texts = [f"see {token(r, ALPHABETS[kind], n)} there" for n in sizes for _ in range(40)]
    plain = [f"see {r.choice(PLAIN)(r.choices(WORDS, k=6))} and {'-'.join(r.choice(WORDS) for _ in range(5))} and {'abcdefghij' * 4} and {'Ab' * 20}" for _ in range(200)]
    got = {x.doc_id: x.spans for x in secret_scan.findings(table(spark, texts + plain)).collect()}
    for j, n in enumerate(sizes):
        assert sum(got[40 * j + i] == f"random:4:{4 + n}" for i in range(40)) >= 36
    assert sum("random" in got[len(texts) + i] for i in range(200)) <= 2


def test_many_matches_and_redaction_equal_brute_force(spark):
    r = random.Random(28)
    bits = ["token=abcdefghijklmnop", " ", "0123456789abcdef", "é", "😀\n", "x", "AKIA" + "B" * 16, "password: 0123456789abcdef", "plain words "]
    texts = ["".join(r.choice(bits) for _ in range(n)) for n in (1, 5, 30, 400, 6000) for _ in range(4)] + ["0123456789abcdef " * 20_000]
    got = {x.doc_id: x.text for x in secret_scan.redact(table(spark, texts)).collect()}
    spans = {x.doc_id: x.spans for x in secret_scan.findings(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        own = [tuple(map(int, x.split(":")[1:])) for x in spans[i].split(",") if x]
        assert len(own) >= len(brute_spans(t))
        out, at = "", -1
        for a, z in own:
            if a > at:
                out += t[max(at, 0) : a] + "[SECRET]"
            at = max(at, z)
        assert got[i] == out + t[max(at, 0) :]


def test_redaction(spark):
    df = table(spark, ["é token = abcdefghijklmnop and 0123456789abcdef.", "nothing", None])
    df = df.withColumns({c: F.lit(c) for c in ("spans", "base_spans", "__random", "tokens", "base")})
    rows = secret_scan.redact(df)
    assert rows.columns == df.columns and rows.select("spans", "__random").distinct().collect() == [("spans", "__random")]
    assert [r.text for r in rows.orderBy("doc_id").collect()] == ["é [SECRET] and [SECRET].", "nothing", None]


# --- 9 -------------------------------------------------------------------------------------------------------------


def brute_measure(text):
    text = text or ""
    words = re.findall(r"[^ \t-\r]+", text)
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^ \t-\r]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_measures_equal_brute_force(spark, odd, none):
    r = random.Random(9)
    texts = [*ODD, *odd_texts(300), *["".join(r.choice(["a ", "b ", "a b\n", "c#", "|\n", "\x0b", "\x85"]) for _ in range(r.randint(0, 60))) for _ in range(500)]]
    for t in texts:
        assert rule_ledger.measure(t)[:5] == brute_measure(t)
    got = rule_ledger.verdicts(rule_ledger.ledger(rule_ledger.measured(odd))).collect()
    assert len(got) == 10 and all(not x.kept for x in got if x.base_failed)
    assert rule_ledger.measured(none).count() == 0


def test_ablations_equal_counting(spark):
    texts = [prose(n, n) for n in (3, 8, 40, 60)] + ["# " * 30, "same line here now\n" * 12, "x " * 40]
    entries = rule_ledger.ledger(rule_ledger.measured(table(spark, texts))).cache()
    mask, _ = rule_ledger.POLICIES["v1"]
    own = [r.failed & mask for r in entries.collect()]
    for r in rule_ledger.ablations(entries).collect():
        b = rule_ledger.bit(r.rule)
        assert (r.failing, r.only_this, r.kept_without) == (sum(bool(x & b) for x in own), sum(x == b for x in own), sum(not x & ~b for x in own))


# --- 10 ------------------------------------------------------------------------------------------------------------


def brute_components(ids, fps):
    up = list(range(len(ids)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                up[find(i)] = find(j)
    least = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(ids))]


def test_fingerprint_is_the_definition():
    import xxhash

    text = "A b\tc d\x0bé"
    words = text.replace("\t", " ").replace("\x0b", " ").replace("A", "a").split(" ")
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(3)]
    assert simhash_dedup.simhash(text) == sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > 3)
    assert simhash_dedup.simhash("One") == xxhash.xxh64_intdigest(b"one", 42)
    assert simhash_dedup.simhash(None) == simhash_dedup.simhash(" \n") == 0


@pytest.mark.parametrize("limit", [3, 4096])
def test_components_equal_brute_force(spark, limit):
    r = random.Random(10)
    fps = []
    for _ in range(40):
        f = r.getrandbits(64)
        for _ in range(r.randint(1, 12)):  # chains and dense groups
            fps.append(f)
            for _ in range(r.randint(0, 4)):
                f ^= 1 << r.randrange(64)
    ids = list(range(len(fps)))
    r.shuffle(ids)
    ids[3] = None
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    rows = spark.createDataFrame(list(zip(ids, signed, strict=True)), "doc_id long, fp long")
    of = {x.fp: x.component_id for x in simhash_dedup.component_table(rows, group_limit=limit).collect()}
    assert [of[s] for s in signed] == brute_components(ids, fps)


def test_near_duplicates(spark, odd, none):
    got = {r.doc_id: r for r in simhash_dedup.near_duplicates(odd).collect()}
    assert len(got) == 10 and got[0].fingerprint == "0" * 16 and got[1].component_id == got[2].component_id == 0
    assert got[3].component_id == got[4].component_id == 3 and got[7].component_id == got[8].component_id
    assert simhash_dedup.near_duplicates(none).count() == 0
    kept = simhash_dedup.keep_one(odd.unionByName(odd.filter("doc_id = 9")))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 5, 6, 7, 9] and kept.columns == odd.columns

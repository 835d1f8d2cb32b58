"""Block naming, SimHash and packing against plain Python, with edge cases."""
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from shipshape.llm import block_naming, packing, simhash

from tests.conftest import MEDIUM

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [(1, None), (2, ""), (3, "a"), (4, "a"), (4, "a"), (5, "b" * 9000), (6, "b" * 9000), (7, "b" * 8999 + "c"),
        (8, "é" * 5000), (9, " \t\n"), (None, "a"), (10, "a b c"), (10, "another text here of words"), (11, "x" * 4096),
        (12, "x" * 8192), (13, "x" * 12288), (14, "x" * 12288), (15, "\x1f \x1f|.|"), (16, "ﬁ ＡΣ İstanbul 𝔘 a.b,c.. d.,")]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text")


def both(spark, corpus):
    real = [(r.doc_id, r.text) for r in corpus.collect()]
    return {"edge": EDGE, "real": real, "empty": []}


@pytest.mark.parametrize("case", ["edge", "real", "empty"])
@pytest.mark.parametrize("same_hash", [False, True])
def test_block_naming(spark, corpus, case, same_hash):
    rows = both(spark, corpus)[case]
    if same_hash and case == "real":
        rows = rows[:200]
    h = (lambda b: F.octet_length(b).cast("long") % 3) if same_hash else F.xxhash64
    got = block_naming.exact_dedup(docs_of(spark, rows), 1024, h).collect()
    units = {(i, t or "") for i, t in rows}
    groups = defaultdict(list)
    for i, t in units:
        groups[t].append(i)
    want = set()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want.add((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(want)


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c == " " or "\t" <= c <= "\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    if not words:
        return 0
    hashes = [xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, linked):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    low = {}
    for k, i in enumerate(ids):
        low.setdefault(find(k), []).append(i)
    return [min((i for i in low[find(k)] if i is not None), default=None) for k in range(len(ids))]


def links_of(fps, far):
    f = np.array(fps, dtype=np.uint64)
    return [(i, int(j)) for i in range(len(f)) for j in np.nonzero(np.bitwise_count(f[i + 1:] ^ f[i]) <= far)[0] + i + 1]


@pytest.mark.parametrize("case", ["edge", "real", "empty"])
def test_simhash(spark, corpus, case):
    rows = both(spark, corpus)[case]
    fps = [brute_fingerprint(t) for _, t in rows]
    comps = brute_components([i for i, _ in rows], links_of(fps, 4))
    want = sorted(map(str, ((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, comps))))
    assert sorted(str(tuple(r)[:3]) for r in simhash.simhash_dedup(docs_of(spark, rows)).collect()) == want


def test_fingerprint_links_on_chains_and_clusters(spark):
    """Chains of close fingerprints, clusters around centres and far noise: components as by all pairs."""
    rnd = random.Random(3)
    fps = [rnd.getrandbits(64) for _ in range(300)]
    for c in range(6):
        at = rnd.getrandbits(64)
        for _ in range(60):
            if c % 2:  # a chain
                for _ in range(rnd.randint(1, 4)):
                    at ^= 1 << rnd.randrange(64)
                fps.append(at)
            else:  # a cluster wider than one hub reaches
                x = at
                for _ in range(rnd.randint(0, 4)):
                    x ^= 1 << rnd.randrange(64)
                fps.append(x)
    fps = sorted({x - (1 << 64) if x >> 63 else x for x in fps})
    want = brute_components(fps, links_of([x % (1 << 64) for x in fps], 4))
    got = {r.fp: r.component for r in
           simhash.fingerprint_links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()}
    assert [got.get(x, x) for x in fps] == want


@pytest.mark.parametrize("case", ["edge", "real", "empty"])
def test_packing(spark, corpus, case):
    rows = both(spark, corpus)[case]
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    model.encode_special_tokens = True
    got = packing.pack(docs_of(spark, rows), public_tokenizers.path("word_bpe_49k.json")).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    ids = defaultdict(list)
    for i, t in rows:
        ids[i].append(np.array([*model.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
    for i, texts in ids.items():
        assert sum(r.length for r in by_doc[i]) == sum(len(x) // 4 for x in texts)
        if len(texts) == 1:
            assert b"".join(bytes(r.ids) for r in sorted(by_doc[i], key=lambda r: r.start)) == texts[0]
            assert {r.doc_tokens for r in by_doc[i]} == {len(texts[0]) // 4}
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length * 4 == len(r.ids) and r.length > 0
            at += r.length
        assert at <= 2048 and len(pieces) <= packing.MAX_SEGMENTS
        padding += pieces[0].padded_length - at
    assert padding <= 0.01 * sum(r.length for r in got)
    assert set(by_doc) == set(ids)


def test_packer_keeps_three_limits():
    rnd, packer = random.Random(5), packing.Packer(64, 4, 40, pool=16)
    sent, sequences = [], []
    for d in range(400):
        n = rnd.choice([1, 2, 5, 30, 63, 64, 65, 300])
        quiet = rnd.choice([0, 0, n // 2, n])
        ids = np.arange(n, dtype="<u4").tobytes()
        sent.append((n, quiet))
        sequences += list(packer.add(d, ids, quiet))
    sequences += list(packer.finish())
    seen = defaultdict(list)
    for s in sequences:
        assert 0 < sum(p.tokens for p in s) <= 64 and len(s) <= 4 and sum(p.loss() for p in s) <= 40
        for p in s:
            seen[p.doc].append((p.start, np.frombuffer(p.ids, "<u4").tolist()))
    for d, (n, _) in enumerate(sent):
        assert [x for _, part in sorted(seen[d]) for x in part] == list(range(n))


def test_word_tokenizer_equals_whole_text(corpus):
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    model.encode_special_tokens = True
    words = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["İ. İ, ΣΑΣ. ΣΑΣ ας. Å. é. é. don't. 's <|endoftext|>. a b c\x1cd\x0be A. AB, Ab.", "ǅ. Ǆ, ß. ẞ, ŉ.",
           "a" * 3000 + ". " + "Z" * 2000]
    for t in [r.text for r in corpus.collect()] + odd + [t or "" for _, t in EDGE]:
        want = np.array(model.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert words.encode(t) == want, t[:80]


def test_crc_is_unsigned(spark):
    assert spark.range(1).select(F.crc32(F.lit(b"\x01\x00\x00\x00"))).first()[0] == zlib.crc32(b"\x01\x00\x00\x00")


def test_packing_finds_added_tokens_as_the_library_does(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)  # as it comes: no flag is set
    texts = ["a <|endoftext|> b", "a<|endoftext|>b.", "<|startoftext|>A. <|endoftext|>, <|ENDOFTEXT|> x",
             "<|endoftext|><|endoftext|>\n<|endoftext |> <|endof\ttext|> \u0301<|startoftext|>\u0301e", "İ.<|endoftext|>'s"]
    want = {i: [*model.encode(t, add_special_tokens=False).ids, packing.END_ID] for i, t in enumerate(texts)}
    assert want[0] == [320, 49407, 321, packing.END_ID]
    got = packing.pack(docs_of(spark, list(enumerate(texts))), path).collect()
    ids = defaultdict(list)
    for r in sorted(got, key=lambda r: r.start):  # documents are cut where a sequence is full
        ids[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    assert ids == want


def test_many_tiny_documents_are_hardly_padded(spark):
    """Sequences that run out of segments end at powers of two."""
    df = spark.createDataFrame([(i, "a b c d") for i in range(20_000)], "doc_id long, text string").coalesce(1)
    got = packing.pack(df, public_tokenizers.path("word_bpe_49k.json"))
    tokens, places = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max("padded_length").alias("p"),
                                                    F.count("*").alias("s")).agg(F.sum("n"), F.sum("p")).first()
    assert tokens == 100_000 and places <= tokens * 1.05


def test_packing_a_very_long_document_is_linear():
    import time
    took = []
    for n in (1_000_000, 8_000_000):
        ids, at = bytes(4 * n), time.process_time()
        packer = packing.Packer(2048, 256, 2048)
        total = sum(p.tokens for s in [*packer.add(1, ids), *packer.finish()] for p in s)
        took.append(time.process_time() - at)
        assert total == n
    assert took[1] < 16 * took[0] + 0.5


def test_merges_of_plain_words_are_the_library_s():
    words = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"), added=True)
    assert words.direct
    for w in ("naïve", "ŉaŉ", "ªº", "ßẞ", "ĳsĳ", "ĸĸ", "àéîõü", "ſtſ", "ﬁne", "x" * 300, "don", "ÿ", "µm", "ǆǉ"):
        assert words.word(w) == words._whole(w), w

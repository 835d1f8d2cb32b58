"""ITQ links, licence places, BPE ids, HTML regions and tool calls against plain Python."""
import hashlib
import json
import math
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from shipshape.llm import byte_bpe, html_regions, itq, licenses, tool_calls

from tests.conftest import MEDIUM
from tests.llm.test_dedup import DOCS, EDGE, brute_components, docs_of

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# ---------------------------------------------------------------- op3

def brute_vectors(rows, least=0.95):
    by_id = {}
    for i, v in rows:
        good = v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        by_id[i] = v if good and i is not None else None
    ids = list(by_id)
    linked = []
    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            x, y = by_id[ids[a]], by_id[ids[b]]
            if x is not None and y is not None and len(x) == len(y):
                x, y = np.array(x, float) / max(map(abs, x)), np.array(y, float) / max(map(abs, y))
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                    linked.append((a, b))
    comps = brute_components(ids, linked)
    n = defaultdict(int)
    for a, b in linked:
        n[a] += 1
        n[b] += 1
    return {i: (n[k], c) for k, (i, c) in enumerate(zip(ids, comps))}


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")


def planted(n=400, size=32, seed=1):
    rnd = np.random.default_rng(seed)
    rows = [(i, rnd.normal(size=size).tolist()) for i in range(n)]
    for i in range(n, n + 120):  # near copies, exact copies and scaled copies
        at = np.array(rows[rnd.integers(12)][1])
        kind = i % 3
        rows.append((i, (at + rnd.normal(size=size) * (0.12 if kind == 0 else 0)).tolist() if kind < 2
                     else (3 * at).tolist()))
    return rows


def test_itq_links_and_recall(spark, monkeypatch):
    monkeypatch.setattr(itq, "UNIT", 40)  # buckets of copies are cut in parts
    rows = planted()
    want = brute_vectors(rows)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in itq.embedding_dedup(vectors_of(spark, rows)).collect()}
    assert set(got) == set(want)
    found, all_links = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert all(got[i][0] <= want[i][0] for i in want) and found >= 0.9 * all_links > 1000
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.99 * len(want)
    assert all(v[2] == (v[1] == i) for i, v in got.items())


def test_itq_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, nan]), (7, [1.0, inf]),
            (8, [1.0, None]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [1e300, 1e-300]), (11, [-0.0, 1.0])]
    want = brute_vectors(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in itq.embedding_dedup(vectors_of(spark, rows + rows[:2])).collect()}
    assert {i: got[i] for i in got if i is not None} == {i: want[i] for i in want if i is not None}
    assert got[None] == (0, None) and len(got) == len(rows)
    assert itq.embedding_dedup(vectors_of(spark, [])).count() == 0


def test_itq_repeated_and_null_ids(spark):
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (5, None), (6, [0.0, 2.0]), (7, [1.0, 0.01]), (5, [1.0, 0.02]),
            (None, [1.0, 0.0]), (None, [0.0, 1.0]), (None, None), (6, [0.0, 2.0])]
    got = sorted((tuple(r) for r in itq.embedding_dedup(vectors_of(spark, rows)).collect()), key=str)
    assert len(got) == len(rows) and got[-3:] == [(None, 0, None, True)] * 3
    five, six, seven = ([r[1:] for r in got if r[0] == i] for i in (5, 6, 7))
    # [1, 0], [1, 0.01] and [1, 0.02] are linked, and [0, 1] with [0, 2]; one vector of each component stays
    assert sorted(r[:2] for r in five) == [(0, 5), (1, 5), (2, 5), (2, 5)] and seven == [(2, 5, False)]
    assert six == [(1, 5, False)] * 2 and sorted(r[2] for r in five if r[0] == 2) == [False, True]
    assert all(r[2] for r in five if r[0] < 2)


# ---------------------------------------------------------------- op4

def brute_licences(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", low) if w]
    places = []
    for label, phrase, keys, base in [(b, p, [p], True) for p, b in licenses.BASE] + [
            (*t, False) for t in licenses.TEMPLATES]:
        t = phrase.split()
        for start in range(-len(t), len(words)):
            def there(i):
                return 0 <= start + i < len(words) and words[start + i] == t[i]
            must = set()
            for k in keys:
                k = k.split()
                at = next(i for i in range(len(t)) if t[i:i + len(k)] == k)
                must |= set(range(at, at + len(k)))
            if all(map(there, must)):
                looked = [i for i in range(len(t)) if i in must or t[i] not in licenses.COMMON]
                places.append((label, base, start, sum(map(there, looked)) / len(looked)))
    own = [p[2] for p in places if p[1]]
    return (len(words), len(own), min(own, default=None), max(own, default=None),
            ",".join(sorted({p[0] for p in places if p[1]})), ",".join(sorted({p[0] for p in places})),
            max((p[3] for p in places), default=0.0))


def test_licences(spark):
    texts = [t for _, t in EDGE if t is None or len(t) < 6000] + [
        "CC-BY cc by 4.0; Licensed under CC BY-NC 4.0.", "all rights reserved " * 300, "All Rights  Reserved",
        "GNU General Public License, version 3 general public license", "released under the mit licenseé mit license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files", "redistribution and use in source and binary forms, with or without modification, are "
        "permitted", "cc cc by by", "version 2 apache license version 2 0 Kcc by"]
    docs = docs_of(spark, list(enumerate(texts)) + [(0, texts[0])]).withColumn("pos", F.lit(1)).withColumn("word", F.lit(2))
    got = licenses.scan(docs).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        want = brute_licences(texts[r.doc_id])
        assert tuple(r)[1:7] == want[:6] and r.score == pytest.approx(want[6]), texts[r.doc_id]
    assert licenses.scan(docs_of(spark, [])).count() == 0


# ---------------------------------------------------------------- op5

def test_byte_bpe(spark, monkeypatch):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(RANKS),
                            special_tokens={})
    texts = [t for _, t in EDGE] + ["a" * 70, "x" * 20000, " \n\n  \t x", "don't 've 123４５ ١٢", "   é́ �\x00",
                                    "漢字かな交じり文 ภาษาไทย 🙂🙃", "=" * 500 + "-" * 63 + "*" * 64, "<|endoftext|>"]
    rows = list(enumerate(texts)) + [(1, texts[1]), (None, "null id")]
    got = byte_bpe.decode(byte_bpe.encode(docs_of(spark, rows).repartition(2), RANKS, public_tokenizers.PATTERN, 5000),
                          RANKS).collect()
    assert len(got) == len(rows)
    for r in got:
        t = "null id" if r.doc_id is None else texts[r.doc_id] or ""
        assert list(r.ids) == enc.encode_ordinary(t) and bytes(r.decoded) == t.encode(), t[:50]
    assert byte_bpe.encode(docs_of(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_on_corpus(spark):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(RANKS),
                            special_tokens={})
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    want = {r.doc_id: enc.encode_ordinary(r.text or "") for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: list(r.ids) for r in byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect()}
    assert got == want


# ---------------------------------------------------------------- op7

def test_main_text_on_pages(spark):
    pages = spark.read.parquet(f"{MEDIUM}/pages.parquet")
    got = html_regions.extract(pages).collect()
    assert len(got) == pages.count()
    html = {r.page_id: r.html for r in pages.collect()}
    import html as entities
    for r in got:
        inside = html[r.page_id].split("<article>", 1)[1].split("</article>", 1)[0]
        blocks = (" ".join(entities.unescape(re.sub("</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inside))
        assert r.text == "\n".join(b for b in blocks if b)


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("plain words only", "plain words only"), ("<p>a<script>var x='<p>no</p>'</script>b", "ab"),
    ("<body><nav>Menu</nav><article><h1>T</h1><p>Of.</p><ul><li>one<li>two &amp;lt;</ul></article><footer>f</footer>",
     "T\nOf.\none\ntwo &lt;"),
    ("<main><p>x <b>bold</b>\n  y</p><div class='comments'><p>nice post</p></div><aside>side</aside><p>z</main>", "x bold y\nz"),
    ("<article><p>kept</p><form><input>name</form><div class='ad'>buy</div><div id=cookie-notice>we use</div></article>",
     "kept"),
    ("<header><h1>Site</h1></header><div><p>first long enough line of text here</p><p>second line of text here</p></div>"
     "<div class=sidebar>x</div>", "first long enough line of text here\nsecond line of text here"),
    ("<article><p>a<p>b</article><!-- <p>c</p> --><p hidden>d</p>", "a\nb")])
def test_main_text_cases(html, text):
    assert html_regions.main_text(html) == text


LONG = "a line of the article that is long enough to be told from links, as its ratio of text to tags is high"
MORE = "another line of the article that is just as long, so that both of them stand in clusters of content"


@pytest.mark.parametrize("html, text", [
    # a word of layout doesn't take the article with it
    (f"<div id='content' class='has-sidebar'><article><p>{LONG}</p></article></div>", LONG),
    (f"<div class='sidebar-right'><article><p>{LONG}</p></article><div class=sidebar>x</div></div>", LONG),
    (f"<div class='page ad-layout'><p>Skip</p><article><p>{LONG}</p></article></div>", LONG),
    (f"<div class='comment-layout'><article><p>{LONG}</p></article></div>", LONG),
    (f"<div class='story'><p>{LONG}</p></div><div class='comments'><article><p>{MORE} {MORE}</p></article></div>", LONG),
    (f"<div class='related-layout'><article><p>{LONG}</p></article></div>", LONG),
    (f"<form id=f><nav>Menu</nav><article><p>{LONG} <b>bold</b></p></article><footer>f</footer></form>", f"{LONG} bold"),
    (f"<form id=f><nav>Menu</nav><div><p>{LONG}</p><p>{MORE}</p></div></form>", f"{LONG}\n{MORE}"),
    (f"<main><form><h1>T</h1><p>{LONG}</p></form></main>", f"T\n{LONG}"),
    (f"<article><div class='article-header'><h1>Title</h1></div><p>{LONG}</p></article>", f"Title\n{LONG}"),
    (f"<div class=post><div class='post-header'><h1>Title</h1></div><p>{LONG}</p></div>", f"Title\n{LONG}"),
    (f"<div class='cookie-page'><p>{LONG}</p></div><nav>Menu</nav>", LONG),
    # all clusters
    (f"<div class='story'><p>{LONG}</p><p>{LONG}</p></div><div class='advert'>buy</div><div class='story'><p>{MORE}</p></div>",
     f"{LONG}\n{LONG}\n{MORE}"),
    (f"<article><p>{LONG}</p><p>{LONG}</p></article><div class=ad>buy</div><article><p>{MORE}</p></article>",
     f"{LONG}\n{LONG}\n{MORE}"),
    # comments and advertisements in article elements
    (f"<article><p>{LONG}</p><article class='comment'><p>{MORE}</p></article></article>", LONG),
    (f"<main><p>{LONG}</p><div><article class='comment odd' id='comment-3'><p>{MORE} {MORE}</p></article></div></main>", LONG),
    (f"<article><p>{LONG}</p></article><article class='sponsored'><p>{MORE} {MORE}</p></article>", LONG),
    (f"<article class='post category-advertising comments-open'><p>{LONG}</p></article>", LONG),
    (f"<article><p>{LONG}</p></article><div class=related><article><p>{MORE} {MORE}</p></article></div>", LONG)])
def test_main_text_of_named_elements(html, text):
    assert html_regions.main_text(html) == text


def test_main_text_long_page():
    lines = [f"line {i} of a very long page" for i in range(20000)]
    assert html_regions.main_text("<article>" + "".join(f"<p>{x}</p>" for x in lines) + "</article>") == "\n".join(lines)


# ---------------------------------------------------------------- op8

def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def call(**c):
    return f"<tool_call>{json.dumps(c)}</tool_call>"


def result(**r):
    return f"<tool_result>{json.dumps(r)}</tool_result>"


def test_tool_calls_cases(spark):
    rows = [
        (1, 0, "user", "find it"),
        (1, 1, "assistant", "sure " + call(id="a", name="search", arguments={"query": "x", "limit": 3})
         + call(id="b", name="lookup", arguments={"key": "k"}, after="c")),
        (1, 2, "tool", result(id="a", content={"z": 1, "a": [1, "é\"" ]})),
        (1, 3, "assistant", call(id="c", name="convert", arguments={"unit": "m", "amount": 2.5}, after="a")),
        (1, 4, "tool", result(id="c", content=None) + result(id="b", content="late") + result(id="zz", content=1)),
        (2, 1, "assistant", call(id="a", name="search", arguments={"limit": "ten", "odd": 1})
         + call(id="a", name="search", arguments={"query": "again"}) + "<tool_call>{broken</tool_call>"),
        (2, 0, "tool", result(id="a", content="too early")),
        (3, 1, "assistant", call(id="p", name="lookup", arguments={"key": "1"}, after="q")
         + call(id="q", name="lookup", arguments={"key": "1"}, after="p")
         + call(id="r", name="lookup", arguments={"key": "1"}, after="r") + call(id="s", name="none", arguments=[], after="?")),
        (None, None, None, None), (1, 0, "user", "find it")]
    got = tool_calls.format_chats(chats(spark, rows)).collect()
    by = {(r.conv_id, r.kind, r.call_id, r.turn): r for r in got if r.kind != "message"}
    assert by[1, "call", "a", 1].status == "ok" and by[1, "call", "a", 1].depth == 0
    assert [by[1, "call", x, t].depth for x, t in (("a", 1), ("c", 3), ("b", 1))] == [0, 1, 2]
    order = [r.call_id for r in sorted((r for r in got if r.conv_id == 1 and r.kind != "message"), key=lambda r: r.position)]
    assert order.index("a") < order.index("c") < order.index("b")
    assert by[1, "result", "a", 2].json == '{"content":{"a":[1,"é\\""],"z":1},"id":"a","kind":"result"}'
    assert by[1, "result", "zz", 4].status == "orphan" and by[2, "result", "a", 0].status == "orphan"
    assert by[1, "call", "c", 3].json == ('{"after":"a","arguments":{"amount":2.5,"unit":"m"},"id":"c","kind":"call",'
                                          '"name":"convert"}')
    two = sorted((r for r in got if r.conv_id == 2 and r.kind == "call"), key=lambda r: r.status)
    assert [r.status for r in two] == ["duplicate", "invalid", "malformed"]
    assert two[1].errors == "missing query,type of limit,unknown odd"
    assert {r.call_id: r.status for r in got if r.conv_id == 3} == {"p": "cycle", "q": "cycle", "r": "cycle", "s": "invalid",
                                                                   None: "ok"}
    assert sum(r.kind == "message" for r in got) == len(rows) - 1
    for conv in (1, 2, 3, None):
        assert sorted(r.position for r in got if r.conv_id == conv) == list(range(sum(r.conv_id == conv for r in got)))
    for r in got:
        assert json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.json
    assert tool_calls.format_chats(chats(spark, [])).count() == 0


def test_tool_calls_long_chain(spark):
    n = 300
    rows = [(1, i, "assistant", call(id=f"c{i}", name="lookup", arguments={"key": "k"}, **({"after": f"c{i + 1}"} if i < n - 1 else {})))
            for i in range(n)]
    got = {r.call_id: r for r in tool_calls.format_chats(chats(spark, rows)).collect() if r.kind == "call"}
    assert [got[f"c{i}"].depth for i in range(n)] == list(range(n - 1, -1, -1))
    assert all(got[f"c{i + 1}"].position < got[f"c{i}"].position for i in range(n - 1))


def test_tool_calls_on_table(spark):
    """Links, validity and order of the derived calls, by plain Python."""
    messages = tool_calls.derived_calls(spark.read.parquet(f"{MEDIUM}/conversations.parquet"))
    rows = sorted({tuple(r) for r in messages.collect()})
    got = tool_calls.format_chats(messages).collect()
    calls, results = {}, {}
    n = 0
    for conv, turn, role, text in rows:
        n += 1
        if role == "assistant":
            for raw in re.findall("<tool_call>(.*?)</tool_call>", text, re.S):
                n += 1
                try:
                    c = json.loads(raw)
                except ValueError:
                    continue
                calls.setdefault((conv, c["id"]), (turn, c))
        for raw in re.findall("<tool_result>(.*?)</tool_result>", text, re.S):
            n += 1
            results.setdefault((conv, json.loads(raw)["id"]), turn)
    assert n == len(got) and calls and results
    place = {(r.conv_id, r.kind, r.call_id): r for r in reversed(sorted(got, key=lambda r: r.position)) if r.kind != "message"}

    def wrong(c):
        params, a = tool_calls.SCHEMAS.get(c["name"]), c["arguments"]
        if params is None:
            return True
        kinds = {"string": str, "integer": int, "number": (int, float), "boolean": bool}
        return (any(q and p not in a for p, (_, q) in params.items()) or any(k not in params for k in a)
                or any(not isinstance(a[p], kinds[k]) for p, (k, _) in params.items() if p in a))
    for key, (turn, c) in calls.items():
        r = place[key[0], "call", key[1]]
        answered = results.get(key, -1) >= turn
        assert r.status == ("invalid" if wrong(c) else "ok" if answered else "unanswered"), c
        if (up := (key[0], c.get("after"))) in calls:
            assert place[up[0], "call", up[1]].position < r.position
            assert r.depth == place[up[0], "call", up[1]].depth + 1
        else:
            assert r.depth == 0
        if answered:
            assert place[key[0], "result", key[1]].position > r.position

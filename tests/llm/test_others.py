"""Vector search, HTML extraction and chat formatting against plain implementations."""

import json
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tallyframe.llm import chat_format, html_extract, queries, vector_search

from .helpers import SF, empty


def clustered(path, n=50_000, dims=32):
    """Vectors around 400 centres, a third of them one and the same vector."""
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(400, dims))
    x = (centres[rng.integers(0, 400, n)] + 0.25 * rng.normal(size=(n, dims))).astype("f4")
    x[: n // 3] = x[0]
    ids = rng.permutation(n)
    pq.write_table(pa.table({"vec_id": ids, "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), dims).cast(pa.list_(pa.float32()))}), path)
    return x


def test_lists_prune_where_vectors_cluster(tmp_path):
    x = clustered(f"{tmp_path}/v.parquet").astype("f4")
    index = vector_search.fit(x[::5], len(x))
    near, cut = index.cut(x[-500:])
    assert (near >= cut[:, None])[:, index.assign(x[len(x) // 3 :])].mean() < 0.1


@pytest.mark.parametrize("name", ["sf0.1", "clustered"])
def test_recall(spark, tmp_path, name):
    if name == "clustered":
        clustered(f"{tmp_path}/v.parquet")
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet" if name == "sf0.1" else f"{tmp_path}/v.parquet")
    rows = table.select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in vector_search.nearest(table).collect():
        got.setdefault(r.query_id, []).append(r)
    at = {int(i): k for k, i in enumerate(ids)}
    assert all(abs(r.score - x[at[r.query_id]] @ x[at[r.vec_id]]) < 1e-12 * len(x) for rs in got.values() for r in rs)
    hit = 0
    asked = ids[ids % 20 == 0]
    for q in asked if len(asked) < 300 else asked[::10]:
        score = x @ x[ids == q][0]
        score[ids == q] = -np.inf
        hit += len({r.vec_id for r in got[q]} & set(ids[np.lexsort((ids, -score))[:20]]))
        assert [r.rank for r in sorted(got[q], key=lambda r: r.rank)] == list(range(1, 21))
    assert hit / (20 * (len(got) if len(got) < 300 else len(asked[::10]))) >= 0.9
    assert set(got) == set(ids[ids % 20 == 0])


@pytest.mark.parametrize("name", ["queries unlike the crowd", "some long vectors", "beyond single precision"])
def test_recall_on_other_rows(spark, name):
    """Rows whose sample does not tell how far the queries have to search."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(4000, 32))
    if name == "queries unlike the crowd":
        crowd = np.arange(4000) % 20 != 0
        x[crowd] = rng.normal(size=(80, 32))[rng.integers(0, 80, crowd.sum())] + 0.05 * rng.normal(size=(crowd.sum(), 32))
    elif name == "some long vectors":
        x = x[:1000] * rng.lognormal(0, 1, size=(1000, 1))
    else:
        x *= 1e25
    table = spark.createDataFrame(list(zip(range(len(x)), x.tolist(), strict=True)), "vec_id long, embedding array<double>")
    got = {}
    for r in vector_search.nearest(table).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    score = x[::20] @ x.T
    score[np.arange(len(score)), np.arange(0, len(x), 20)] = -np.inf
    want = np.argsort(-score, axis=1)[:, :20].tolist()
    assert sum(len(got[20 * k] & set(w)) for k, w in enumerate(want)) / (20 * len(want)) >= 0.95


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0], 0), (1, None, 0), (2, [0.0, 0.0], 0), (3, [float("nan"), 1.0], 0), (4, [None, 1.0], 0), (5, [1.0, 0.0], 0), (6, [1.0, 0.0], 0), (7, [1.0, 2.0, 3.0], 0), (None, [1.0, 1.0], 0), (20, [0.5, 0.5], 0), (20, [0.5, 0.75], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in vector_search.nearest(table).collect())
    assert got == [(0, 1, 5, 1.0), (0, 2, 6, 1.0), (0, 3, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 5, 0.5), (20, 3, 6, 0.5)]
    assert vector_search.nearest(empty(table)).collect() == []


def test_pages_equal_article(spark):
    """The test pages mark their article, whose blocks a pattern finds."""
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in html_extract.extract(pages).collect()}
    for p in pages.collect():
        body = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", p.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|ul|ol|li|div|table|tr|td|blockquote|pre|h2|h3)\b[^>]*>|<br>(?=<p)", body)]
        assert got[p.page_id].text == "\n\n".join(b for b in blocks if b), p.html[:3000]
        assert got[p.page_id].n_chars == len(got[p.page_id].text)


def test_wrapper_takes_constant_blocks(spark):
    page = "<html><body><div><p>Welcome to our site, read on</p><p>{}</p><p>{}</p><p>Call us any time</p></div></body></html>"
    rows = [(i, "http://h.example/x", page.format(f"story {i} begins", f"and {i} ends &amp; more")) for i in range(12)]
    rows += [(50, None, None), (51, "bad url", ""), (52, "http://h.example/y", "<p>a<li>b<script>x</script><div class='sidebar'>no</div>c <i>d</i>")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS host")
    got = {r.page_id: r.text for r in html_extract.extract(table).collect()}
    assert got[3] == "story 3 begins\n\nand 3 ends & more"
    assert (got[50], got[51], got[52]) == ("", "", "a\n\nb\n\nc d")
    assert html_extract.extract(empty(table)).collect() == []


def tree(source):
    page = html_extract.read(source)
    return html_extract.Tree(page.labels, page.parents, page.nodes, page.sigs)


def stories(rng, n, words=25):
    return [" ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 9999)}" for _ in range(words)) for _ in range(n)]


def test_induction_without_any_marks(spark):
    """Pages whose template only the alignment can tell: sections with boxes of their own, a large template, near copies, a host of two pages."""
    rng = random.Random(8)
    side = [f"<div class=z{s}>" + "".join(f"<p>{t}</p>" for t in stories(rng, 3, 5)) + "</div>" for s in range(4)]
    head, tail = stories(rng, 9, 4), stories(rng, 6, 30)
    lay = lambda s, body: "<body><div class=q><p>" + "</p><p>".join(head) + f"</p></div>{side[s]}<div class=w><div>" + "".join(f"<p>{t}</p>" for t in body) + "</div></div><div class=r><p>" + "</p><p>".join(tail) + "</p></div></body>"
    own = [stories(rng, rng.randint(2, 4)) for _ in range(240)]
    quote = own[0][0]
    own[1][1] = own[2][1] = quote  # a passage in three articles
    rows = [(i, "http://big.example/a", lay(0 if i % 2 else 1 + i // 2 % 3, body)) for i, body in enumerate(own)]
    near = [[own[7][0], own[7][1].replace(" ", f" x{k} ", 1), *own[7][2:]] for k in range(100)]
    rows += [(1000 + k, "http://big.example/b", lay(0, body)) for k, body in enumerate(near)]
    two = [stories(rng, 3), stories(rng, 3)]
    rows += [(2000 + k, "http://two.example/", lay(1, body)) for k, body in enumerate(two)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {i: "\n\n".join(b) for k, bodies in ((0, own), (1000, near), (2000, two)) for i, b in enumerate(bodies, k)}
    assert got == want


def test_marked_pages_are_aligned_too(spark):
    """In marked articles, what most of a host's pages hold is template; passages of some articles, and of near copies, are not."""
    rng = random.Random(4)
    own = [stories(rng, rng.randint(2, 4)) for _ in range(150)]
    for k in range(0, 150, 5):
        own[k][1] = own[0][1]  # a passage in every fifth article
    near = [[own[7][0], f"x{k} " + own[7][1], *own[7][2:]] for k in range(40)]
    lay = "<body><div>Out of it</div><article><div class=k1>Read this with our app</div>{}<p>Thank you for your visit</article>"
    rows = [(i, "http://m.example/a", lay.format("".join(f"<p>{t}</p>" for t in body))) for i, body in enumerate(own + near)]
    two = ["<article><p>one more<p>shared passage</article>", "<article><p>and another<p>shared passage</article>"]
    rows += [(1000 + k, "http://two.example/", page) for k, page in enumerate(two)]
    rows += [(2000 + k, "http://m.example/b", f"<body><p>Without a mark</p><p>Thank you for your visit</p><p>{t}</p>") for k, t in enumerate(stories(rng, 9))]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert html_extract.parse(table).filter("marked AND (size(labels) = 0 OR size(sketches) <> size(texts))").count() == 0
    got = {r.page_id: r.text for r in html_extract.extract(table).collect()}
    assert [got[i] for i in range(190)] == ["\n\n".join(body) for body in own + near]
    assert (got[1000], got[1001]) == ("one more\n\nshared passage", "and another\n\nshared passage")
    assert all("\n\n" not in got[2000 + k] for k in range(9))


def test_deep_and_long_pages(spark):
    deep = "<div>" * 30_000 + "end" + "</b>" * 30_000
    long_ = "".join(f"<p>paragraph {k}" for k in range(8000))
    rows = [(1, "http://d.example/", deep), (2, "http://d.example/", long_), (3, "http://d.example/", deep + "<p>more here"), (4, "http://d.example/", "<p>new words first" + long_.replace("7", "seven"))]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "end" and got[3] == "end\n\nmore here"
    # Two pages alone on a host: what they share is template, in the right order whatever stands between.
    sevens = [f"paragraph {k}" for k in range(8000) if "7" in str(k)]
    assert got[2].split("\n\n") == sevens and got[4].split("\n\n") == ["new words first", *[x.replace("7", "seven") for x in sevens]]


def test_names_do_not_hide_the_article():
    page = html_extract.read("<div class='sidebar widget'><p>out<article><h1>Title</h1>body<div class=comments><article>reply</article></div><div class='no-comments'>in</div></article></div><div class='layout has-sidebar'>out too</div>")
    assert page.texts == ["Title", "body", "in"]
    assert html_extract.read("<section class='social-policy'><p>kept</section><div id=sidebar>x</div>").texts == ["kept"]


def brute_matching(w):
    """Best total over all order-preserving matchings."""
    if not len(w) or not len(w[0]):
        return 0
    return max(brute_matching(w[1:]), max((w[0][j] + brute_matching([r[j + 1 :] for r in w[1:]]) for j in range(len(w[0])) if w[0][j]), default=0))


def test_tree_matching(monkeypatch):
    t, u = tree("<p>1</p><p>2</p><p>3</p>"), tree("<p>1</p><p>3</p>")
    same = [(x, y) for x, y in html_extract.Matcher(t, u).pairs() if x in t.sig and t.sig[x] == u.sig[y]]
    assert len(same) == 2
    # Containers of one label pair by what is in them, not by their places.
    t, u = tree("<div><p>a<p>b</div><div><ul><li>c<li>d</ul></div>"), tree("<div><ul><li>c<li>e</ul></div>")
    pairs = html_extract.Matcher(t, u).pairs()
    assert sum(t.sig.get(x) == u.sig.get(y) for x, y in pairs if x in t.sig) == 1
    rng = np.random.default_rng(3)
    for _ in range(60):
        w = rng.integers(0, 4, (rng.integers(1, 7), rng.integers(1, 7)))
        for cells in (4, 10**6):
            monkeypatch.setattr(html_extract, "CELLS", cells)
            got = html_extract.ordered_matching(*w.shape, lambda i, w=w: w[i].astype(float))
            assert all(a < c and b < d for (a, b), (c, d) in zip(got, got[1:], strict=False))
            assert sum(w[i, j] for i, j in got) == brute_matching(w.tolist())


def test_chat(spark):
    call = lambda i, name, **arguments: {"id": i, "name": name, "arguments": arguments}
    rows = [
        (1, 0, "user", "hello"),
        (1, 1, "assistant", json.dumps({"content": None, "tool_calls": [call("c1", "add", b=2, a=1), call("c2", "add", a="x")]})),
        (1, 2, "tool", json.dumps({"tool_call_id": "c1", "content": {"z": 1, "a": 2}})),
        (1, 3, "assistant", json.dumps({"tool_calls": [call("c3", "add", a=1, b="c1")]})),
        (1, 4, "tool", json.dumps({"tool_call_id": "nobody", "content": "x"})),
        (2, 0, "assistant", json.dumps({"tool_calls": [call("p", "f", q="q"), call("q", "f", p="p")]})),
        (3, None, None, None),
        (4, 0, "user", '{"broken'),
        (None, 1, "user", 'quote " and \n'),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "0 AS level")
    schemas = {"add": {"type": "object", "required": ["a", "b"], "properties": {"a": {"type": "integer"}}}}
    got = {(r.conv_id, r.turn): r for r in chat_format.format_chats(table, schemas).collect()}
    assert len(got) == len(rows)
    for r in got.values():
        value = json.loads(r.message)
        assert r.message == chat_format.canonical(value)
    m = json.loads(got[1, 1].message)
    assert [(c["id"], c["valid"], c["answered"], c["level"]) for c in m["calls"]] == [("c1", True, True, 0), ("c2", False, False, 0)]
    assert m["calls"][0]["arguments"] == {"a": 1, "b": 2}
    assert (got[1, 1].n_calls, got[1, 1].n_answered, got[1, 1].n_invalid) == (2, 1, 1)
    assert (got[1, 2].answers_turn, got[1, 2].level, got[1, 3].level, got[1, 4].answers_turn) == (1, 1, 2, None)
    assert got[2, 0].level is None
    assert json.loads(got[None, 1].message)["content"] == 'quote " and \n'
    assert chat_format.format_chats(empty(table)).collect() == []


def brute_chat(rows, schemas):
    """Every message of small conversations by the definitions, one at a time."""
    parsed = [(c, t, role, *chat_format.parse(text)) for c, t, role, text in rows]
    least = lambda found: min(found) if found else None
    out = []
    for conv, turn, role, content, calls, answers, _ in parsed:
        mine = [p for p in parsed if p[0] == conv]
        ids = {c["id"] for p in mine for c in p[4]} - {None}
        needs = {i: {m for p in mine for c in p[4] if c["id"] == i for m in c["mentions"]} & ids for i in ids}

        def level(i, trail=()):
            if i in trail:
                return None
            inner = [level(m, (*trail, i)) for m in needs[i]]
            return None if None in inner else max(inner, default=-1) + 1

        declared = {}
        for p in sorted(mine, key=lambda p: p[1]):
            for tool in p[6]:
                declared.setdefault(tool["name"], json.loads(tool["schema"]))
        told = []
        for at, c in enumerate(calls):
            rule = declared.get(c["name"], schemas.get(c["name"]))
            valid = False if not c["proper"] else None if rule is None else chat_format.validate(json.loads(c["arguments"]), rule)
            lv = None if c["id"] is None else level(c["id"])
            answered = c["id"] is not None and any(p[5] == c["id"] for p in mine)
            told.append((lv is None, lv or 0, at, {"id": c["id"], "name": c["name"], "arguments": json.loads(c["arguments"]), "valid": valid, "level": lv, "answered": answered}))
        told = [x[-1] for x in sorted(told, key=lambda x: x[:3])]
        call_turn = least([p[1] for p in mine for c in p[4] if answers is not None and c["id"] == answers])
        levels = [c["level"] for c in told if c["id"] is not None]
        if levels:
            place = None if None in levels else 2 * max(levels)
        else:
            place = 0 if call_turn is None else None if level(answers) is None else 2 * level(answers) + 1
        message = chat_format.canonical({"answers": answers, "calls": told, "content": content, "role": role, "turn": turn})
        out.append((conv, turn, role, len(calls), sum(c["answered"] for c in told), sum(c["valid"] is False for c in told), call_turn, place, message))
    return sorted(out, key=repr)


def tool_chats(rng, n):
    """Conversations with declared tools, chains, cycles, repeated and missing identifiers, both forms of calls."""
    rows = []
    for conv in [None, *range(n)]:
        rows.append((conv, 0, "system", json.dumps({"tools": [{"name": "add", "parameters": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}}}}, {"type": "function", "function": {"name": "find", "parameters": {"properties": {"q": {"minLength": 2}}}}}]})))
        names = [f"c{k}" for k in range(6)]
        for turn in range(1, 9):
            kind = rng.random()
            if kind < 0.5:
                calls = []
                for _ in range(rng.randint(1, 3)):
                    call = {"name": rng.choice(["add", "find", "other", None]), "arguments": {"a": rng.choice([1, "x", rng.choice(names)]), "q": [rng.choice(["", "long", rng.choice(names)])]}}
                    if rng.random() < 0.3:
                        call = {"type": "function", "function": {**call, "arguments": json.dumps(call["arguments"])}}
                    calls.append({"id": rng.choice([*names, None, 7]), **call})
                rows.append((conv, turn, "assistant", json.dumps({"content": None, "tool_calls": rng.choice([calls, calls, [*calls, "odd"]])})))
            elif kind < 0.8:
                rows.append((conv, turn, "tool", json.dumps({"tool_call_id": rng.choice([*names, "nobody"]), "content": {"b": [1, {"z": None}], "a": "é"}})))
            else:
                rows.append((conv, turn, None, rng.choice([None, "", "plain", '{"x": 1}', "{broken"])))
    return rows


@pytest.mark.parametrize("edges", [200_000, 2])
def test_chat_equals_brute_force(spark, monkeypatch, edges):
    monkeypatch.setattr(chat_format, "EDGES", edges)
    rows, schemas = tool_chats(random.Random(5), 12), {"other": {"required": ["zz"]}}
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(map(tuple, chat_format.format_chats(table, schemas).collect()), key=repr)
    assert got == brute_chat(rows, schemas)
    assert {r[7] for r in got} >= {None, 0, 1, 2, 3, 4} and any(r[5] for r in got)


def test_chat_query_declares_its_tools(spark, tmp_path):
    rows = tool_chats(random.Random(9), 6)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted(map(tuple, queries.QUERIES["op10_chat_format"](spark, str(tmp_path)).collect()), key=repr) == brute_chat(rows, {})


def test_deep_and_chained_chats(spark):
    deep = lambda n: json.dumps({"tool_calls": [{"id": "d", "name": "f", "arguments": 0}]}).replace("0", "[" * n + "]" * n)
    chain = [(1, k, "assistant", json.dumps({"tool_calls": [{"id": f"k{k}", "name": "f", "arguments": {"from": f"k{k - 1}"}}]})) for k in range(1500)]
    odd = json.dumps({"tool_call_id": "x", "content": "\ud800"})
    rows = [(2, 0, "assistant", deep(1500)), (3, 0, "assistant", deep(300_000)), (4, 0, "tool", odd), *chain]
    got = {(r.conv_id, r.turn): r for r in chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1, 1499].level == 2 * 1499 and got[2, 0].n_calls == 1 and len(got) == len(rows)
    assert got[3, 0].message.count("[") >= 300_000 and json.loads(got[4, 0].message)["content"] == odd

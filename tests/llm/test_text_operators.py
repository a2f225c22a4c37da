"""Operators on texts against brute-force versions, with null, empty and long texts, ties, repeated rows and empty tables."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
import xxhash

import corpus_pipeline
from lexiloom.llm import byte_bpe, decontaminate, html_extract, line_dedup, similar_texts, simhash_dedup, substring_dedup, token_counts
from lexiloom.llm.components import forest

BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def rows(df):
    return {r["doc_id"]: r.asDict(recursive=True) for r in df.collect()}


# html ------------------------------------------------------------------------------------------------------------------------
PAGE = (
    '<html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies.</div>{main}'
    '<div id="comments"><p>' + "I like the text and the way in which it is written, but not the end of it. " * 5 + "</p></div><footer>&copy; us</footer></body></html>"
)


def test_html_article():
    main = "<article><h1>A &amp; B</h1><p>One<br>two  <b>three</b><p>Four<script>var x='</p>'</script></p></article>"
    assert html_extract.main_text(PAGE.replace("{main}", main)) == "A & B\n\nOne two three\n\nFour"


def test_html_text_rules():
    good = "This is the text of the page and it is long enough for the rules to keep it as the main text of all. " * 3
    page = PAGE.replace("{main}", f"<div><h2>Title here</h2><p>{good}</p><p>Short one.</p><p>{good}</p></div><ul><li><a href=a>One</a><li><a href=b>Two</a></ul>")
    assert html_extract.main_text(page) == "\n\n".join(["Title here", good.strip(), "Short one.", good.strip()])


def test_html_rules_decide_inside_an_article():
    good = "This is the text of the page and it is long enough for the rules to keep it as the main text of all. " * 3
    links = '<ul><li><a href="a">Read another page of ours</a></li><li><a href="b">And one more of them</a></li></ul>'
    main = f"<article><h1>Title</h1><p>{good}</p><p>Short.</p><p>xq zv kj.</p><p>{good}</p>{links}<p>Between two lists.</p>{links}</article>"
    assert html_extract.main_text(PAGE.replace("{main}", main)) == "\n\n".join(["Title", good.strip(), "Short.", "xq zv kj.", good.strip()])


def test_html_text_outside_of_teaser_articles_is_kept():
    good = "This is the text of the page and it is long enough for the rules to keep it as the main text of all. " * 3
    teasers = '<article><p><a href="a">Another page of ours</a></p></article><article><p><a href="b">One more of them</a></p></article>'
    page = PAGE.replace("{main}", f"<div><p>{good}</p><p>A short one.</p><p>{good}</p></div>{teasers}<div>Some few words.</div>")
    assert html_extract.main_text(page) == "\n\n".join([good.strip(), "A short one.", good.strip()])


def test_html_names_do_not_lose_the_article():
    good = "This is the text of the page and it is long enough for the rules to keep it as the main text of all. " * 4
    article = f"<article{{}}><h1>Title</h1><p>{good}</p></article>"
    rest = '<nav><a href="x">Home page</a></nav><div class="sidebar"><p>' + "Some of the other texts that we have for you in this list of ours. " * 5 + '</p></div><div class="comments"><article class="comment-5"><p>' + "I like the text and the way in which it is written, but not the end of it. " * 5 + "</p></article></div>"
    whole = "Title\n\n" + good.strip()
    for attributes in (' style="overflow:hidden"', ' title="the hidden truth"', ' data-id="comment-5"', ' class="post comments-open"', " data-class='sidebar' data-hidden=1", ' class="post promo"', ' id="main-widget"'):
        assert html_extract.main_text(f"<body>{article.format(attributes)}{rest}</body>") == whole, attributes
    for wrapper in ('<div class="layout has-sidebar">', '<div class="no-sidebar">', '<div class="page-header-fixed">', '<form id="aspnetForm">', '<div class="with-menu is-sticky header">', '<div class="widget"><form><div id="overlay">'):
        assert html_extract.main_text(f"<body>{wrapper}{article.format('')}{rest}</body>") == whole, wrapper
        plain = f"<body>{wrapper}<div><h1>Title</h1><p>{good}</p></div>{rest}</body>"
        assert html_extract.main_text(plain) == whole, wrapper
    # dense text elsewhere: what is called out by name stays out
    assert html_extract.main_text(f'<body><div><h1>Title</h1><p>{good}</p></div><div class="promo"><p>{good}</p></div></body>') == whole


def test_html_keeps_the_only_text_of_a_page():
    short, russian = "One plain paragraph of some ninety characters, which has the page to itself and no other.", "Этот текст написан на языке, для которого здесь нет списка частых слов. " * 7
    assert html_extract.main_text(f"<body><nav><a href=a>x</a></nav><p>{short}</p></body>") == short
    assert html_extract.main_text("<body><p>Short one.</p></body>") == "Short one."
    assert html_extract.main_text(f"<body><nav><a href=a>Дом</a></nav><div><p>{russian}</p><p>Конец.</p><p>{russian}</p></div><footer>©</footer></body>") == f"{russian.strip()}\n\nКонец.\n\n{russian.strip()}"
    assert html_extract.main_text('<body><nav><a href="a">Home</a></nav><div class="cookie-notice">We use cookies.</div><footer>Us</footer></body>') == ""
    assert html_extract.main_text(None) == html_extract.main_text("<div class=") == ""


def test_html_names_nested_deeply_take_linear_time():
    n, text = 20_000, "This is the text of the page and it is long enough for the rules to keep it as the main text of all. " * 4
    assert html_extract.main_text('<div class="x widget">' * n + f"<p>{text}</p>" + "</div>" * n) == text.strip()


def brute_kept(blocks, labels):
    """The second pass by its definition: for each block a walk to its nearest decided neighbours."""

    def nearest(i, step):
        k = i + step
        while 0 <= k < len(blocks):
            if blocks[k].article == blocks[i].article and labels[k] in ("good", "bad") and not (blocks[k].article and blocks[k].outside):
                return labels[k]
            k += step
        return "good" if blocks[i].article else "bad"

    out = []
    for i, block in enumerate(blocks):
        sides = [nearest(i, -1), nearest(i, 1)]
        if labels[i] in ("good", "bad"):
            out.append(labels[i] == "good")
        elif block.article:
            out.append(sides != ["bad", "bad"])
        elif labels[i] == "near":
            out.append("good" in sides or any(labels[k] == "near" for k in (i - 1, i + 1) if 0 <= k < len(labels)))
        else:
            out.append(sides == ["good", "good"] or bool(block.heading) and sides[1] == "good")
    return out


def test_html_passes_over_driver_pages():
    import pyarrow.dataset as ds

    pages = ds.dataset("/root/testdata/sf0.01/pages.parquet").to_table(columns=["html"])["html"].to_pylist()
    seen = Counter()
    for html in pages:
        for page in (html or "", (html or "").replace("<article", "<div").replace("</article", "</div")):
            blocks = html_extract._blocks(page)
            has_article = any(b.article and not b.outside for b in blocks)
            labels = [html_extract._first_pass(b, has_article) for b in blocks]
            seen.update(labels)
            kept = brute_kept(blocks, labels)
            assert html_extract._second_pass(blocks, labels) == kept
            if not any(kept):  # the only text of a page
                kept = [not b.outside and b.linked <= 0.4 * len(b.text) and b.text[0] != "©" for b in blocks]
            assert html_extract.main_text(page) == "\n\n".join(b.text for b, k in zip(blocks, kept, strict=True) if k)
    assert min(seen[x] for x in ("good", "bad", "near", "short")) > 100


def test_html_article_of_driver_pages():
    """The whole text of the article element, as a plain parser of the standard library reads it."""
    import pyarrow.dataset as ds
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.parts = False, []

        def handle_starttag(self, tag, attributes):
            self.inside = self.inside or tag == "article"
            if self.inside:
                self.parts.append(" ")

        def handle_endtag(self, tag):
            self.inside = self.inside and tag != "article"

        def handle_data(self, data):
            if self.inside:
                self.parts.append(data)

    plain = 0
    for html in ds.dataset("/root/testdata/sf0.01/pages.parquet").to_table(columns=["html"])["html"].to_pylist():
        if not html or "class=" in html[html.find("<article") : html.find("</article")]:
            continue
        parser = Article()
        parser.feed(html)
        assert html_extract.main_text(html).split() == "".join(parser.parts).split()
        plain += 1
    assert plain > 100


def test_html_time_is_linear_in_tags():
    import time

    for page in ("<b>x</i>", "<b>", "<p>a", "<li>a", "<a href=x>", "<div class='x>"):
        began = time.perf_counter()
        html_extract.main_text(page * (400_000 // len(page)))
        assert time.perf_counter() - began < 20


def test_html_edges(spark):
    pages = spark.createDataFrame([(1, "u", None, 1), (2, None, "", 1), (3, "u", "<article>x", 1), (3, "u", "<article>x", 1), (4, "u", "<" * 5000 + "<p", 1)], "page_id long, url string, html string, text int")
    got = sorted((r.page_id, r.url, r.text, r.n_chars) for r in html_extract.html_extract(pages).select("page_id", "url", "text", "n_chars").na.fill("-").collect())
    assert got[0] == (1, "u", "", 0) and got[1] == (2, "-", "", 0) and got[2] == got[3] == (3, "u", "x", 1) and len(got) == 5
    assert html_extract.html_extract(pages.limit(0)).count() == 0


# tokens ----------------------------------------------------------------------------------------------------------------------
def reference_bpe():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), list(ranks)


def test_bpe_matches_library(spark, docs, sample):
    expected, _ = reference_bpe()
    frame = docs(sample)
    encoded = byte_bpe.encode(frame, BPE, public_tokenizers.PATTERN)
    got = rows(encoded)
    for i, text in enumerate(sample):
        ids = expected.encode_ordinary(text or "")
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    back = rows(byte_bpe.decode(encoded, BPE, public_tokenizers.PATTERN))
    assert all(bytes(back[i]["bytes"]) == (t or "").encode() for i, t in enumerate(sample))
    assert byte_bpe.encode(frame.limit(0), BPE, public_tokenizers.PATTERN).count() == 0


def test_bpe_random_pieces():
    expected, tokens = reference_bpe()
    own, rnd = byte_bpe.load(BPE, public_tokenizers.PATTERN), random.Random(4)
    for _ in range(3000):
        text = b"".join(rnd.choice(tokens) for _ in range(rnd.randint(1, 5))).decode("utf-8", "replace") if rnd.random() < 0.6 else "".join(rnd.choice("ab é中\n ") for _ in range(30))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == expected.encode_ordinary(text)


def test_token_counts(spark, docs, sample):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [*sample, "a▁b " * 300, "中文" * 900, "ab" * 900, " " * 900, "\u0000\u0001" * 400]
    for chunk, overlap in ((1 << 15, 512), (120, 30)):
        got = rows(token_counts.token_counts(docs(texts), PIECES, limit=50, chunk=chunk, overlap=overlap))
        for i, text in enumerate(texts):
            n = len(model.encode(text or ""))
            assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((text or "").encode()), n > 50)
    assert token_counts.token_counts(docs([]), PIECES).count() == 0


# substring dedup -------------------------------------------------------------------------------------------------------------
def brute_substrings(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def test_substring_dedup(docs, sample):
    rnd = random.Random(2)
    passage = " ".join(rnd.choice("abcdefghij") * rnd.randint(1, 3) for _ in range(60))
    texts = [*sample, *(" ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 90))) for _ in range(40)), "x " + passage + " y", "z\n" + passage, passage[:80], "a b " * 80, "b a " * 70, "q " * 100]
    for window in (35, 7):
        got = rows(substring_dedup.substring_dedup(docs(texts), window))
        for i, expected in enumerate(brute_substrings(texts, window)):
            assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept"]) == expected
    assert substring_dedup.substring_dedup(docs([])).count() == 0
    assert substring_dedup.substring_dedup(docs([None, "", None])).filter("n_words = 0 and n_removed = 0 and kept = ''").count() == 3


def test_substring_dedup_null_and_repeated_rows(docs, sample):
    rnd = random.Random(7)
    draw = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    one, two, three, four = (draw(60) for _ in range(4))
    texts = [one, one, two, f"x {two} y", three, f"{three} z", four, draw(50), draw(10), draw(10), None]
    ids = [1, 1, None, 2, 3, 3, None, None, 4, 4, None]
    got = substring_dedup.substring_dedup(docs(texts, ids=ids)).collect()
    expected = [(-1 if i is None else i, *e) for i, e in zip(ids, brute_substrings(texts, 35), strict=True)]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == sorted(expected)


def test_substring_dedup_in_pieces_and_hot_passages(docs):
    rnd = random.Random(9)
    draw = lambda n: " ".join("".join(rnd.choice("abc") for _ in range(3)) for _ in range(n))
    passage = draw(50)
    texts = [draw(900) + " " + passage + " " + draw(700), *(f"{draw(5)} {passage} {draw(5)}" for _ in range(40)), "w" * 5000 + " " + draw(60), draw(2000), passage + " " + passage]
    expected = brute_substrings(texts, 12)
    for piece in (1 << 22, 700):  # a piece of 700 bytes has some 170 words
        got = rows(substring_dedup.substring_dedup(docs(texts), 12, piece))
        assert [(got[i]["n_words"], got[i]["n_removed"], got[i]["kept"]) for i in range(len(texts))] == expected


# decontamination -------------------------------------------------------------------------------------------------------------
def brute_items(texts, items, window):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for text in texts:
        words, hit, found = split(text), set(), set()
        for item, body in items:
            own = split(body)
            size = min(len(own), window)
            grams = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
            for i in range(len(words) - size + 1 if own else 0):
                if tuple(words[i : i + size]) in grams:
                    hit.update(range(i, i + size))
                    found.add("null" if item is None else str(item))
        out.append((len(words), len(hit), sorted(found)))
    return out


def test_decontaminate_both_ways(spark, docs):
    rnd = random.Random(8)
    draw = lambda n: " ".join(rnd.choice(["Ab", "cd", "é", "f7", "x"]) for _ in range(n))
    items = [(1, draw(14)), (2, draw(3)), (10, "One"), (11, draw(10)), (12, None), (13, ""), (14, "!!"), (1, draw(14)), (None, "rare words here")]
    texts = [draw(rnd.randint(0, 60)) for _ in range(30)] + ["pre, " + items[0][1].replace(" ", " - ") + "; one", None, "", "??", "one", "Rare WORDS here", items[0][1]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = brute_items(texts, items, 10)
    for most in (10_000, 0):  # by broadcast, and as a join
        got = rows(decontaminate.decontaminate(docs(texts), bench, broadcast_windows=most))
        for i, e in enumerate(expected):
            assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == e
            assert sum(s["end"] - s["start"] for s in got[i]["spans"]) == e[1]
        assert decontaminate.decontaminate(docs([]), bench, broadcast_windows=most).count() == 0
    assert decontaminate.decontaminate(docs(texts), bench.limit(0)).filter("n_hit > 0").count() == 0


def test_decontaminate_null_and_repeated_ids(spark, docs):
    passage = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    texts = [passage, "clean words", "so " + passage, "clean too", f"a {passage} b", None, passage]
    frame = docs(texts, ids=[None, None, 4, 4, 5, 6, None])
    hits = sorted((-1 if i is None else i, n) for i, n in zip([None, None, 4, 4, 5, 6, None], [11, 0, 11, 0, 11, 0, 11], strict=True))
    for most in (10_000, 0):  # by broadcast, and as a join
        found = decontaminate.decontaminate(frame, bench, broadcast_windows=most).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_hit) for r in found) == hits
        kept = decontaminate.keep_clean(frame, bench, broadcast_windows=most)
        assert kept.schema.names == frame.schema.names
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.text or "", r.words) for r in kept.collect()) == [(-1, "clean words", "w"), (4, "clean too", "w"), (6, "", "w")]


def test_f1_index_takes_no_python_rows(spark, docs, monkeypatch):
    seen, counts = [], decontaminate._counts
    monkeypatch.setattr(decontaminate, "_counts", lambda texts, widths, shingles: seen.append(shingles) or counts(texts, widths, shingles))
    bench = spark.createDataFrame([(1, "one two three four"), (2, "five")], "item_id long, text string")
    kept = decontaminate.keep_clean(docs(["so one two three four", "five four", "four three", None]), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3]
    # such rows are made by Python workers of another pool than that of Arrow functions, two more in each executor
    assert "PythonRDD" not in seen[0]._jdf.queryExecution().toRdd().toDebugString()
    assert seen[0].dtypes == [("shingle", "bigint")] and seen[0].count() == 3


# near-duplicates -------------------------------------------------------------------------------------------------------------
def brute_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(prints, most=4):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(prints))]


def test_fingerprints_and_components(docs, sample):
    texts = [*sample, *(sample[k] + f" tail{k}" for k in range(20))]
    got = rows(simhash_dedup.simhash_dedup(docs(texts)))
    prints = [brute_print(t) for t in texts]
    assert [got[i]["print"] & (2**64 - 1) for i in range(len(texts))] == prints
    assert [got[i]["component_id"] for i in range(len(texts))] == brute_components(prints)
    assert simhash_dedup.simhash_dedup(docs([])).count() == 0


def test_golay_keys_meet():
    rnd = random.Random(5)
    for _ in range(300):
        a = rnd.getrandbits(64)
        b = a
        for bit in rnd.sample(range(64), rnd.randint(0, 4)):
            b ^= 1 << bit
        keys, own = simhash_dedup.golay_keys(np.array([a, b], np.uint64))
        assert set(keys[own == 0].tolist()) & set(keys[own == 1].tolist())


def test_links_of_large_groups(spark):
    rnd = random.Random(6)
    base = [rnd.getrandbits(63) for _ in range(3)]
    prints = sorted({b ^ sum(1 << x for x in rnd.sample(range(63), rnd.randint(0, 3))) for b in base for _ in range(120)})
    frame = spark.createDataFrame([(p,) for p in prints], "print long")
    for dense in (1024, 20, 2):  # 20 and 2: the linear way for groups of more
        found = [(r.a, r.b) for r in simhash_dedup.links(frame, dense=dense).collect()]
        place = {p: i for i, p in enumerate(prints)}
        a, b = (np.array([place[x[k]] for x in found]) for k in (0, 1))
        nodes, roots = forest(a, b)
        label = dict(zip(nodes.tolist(), roots.tolist(), strict=True))
        assert [label.get(i, i) for i in range(len(prints))] == brute_components(prints)


def brute_similar(texts):
    """The first of each text's group, by exact similarities."""
    words = [(t or "").encode().lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(sets))]


def test_similar_texts(docs, sample):
    rnd = random.Random(3)
    base = [rnd.choice("abcdefghijklmnop") * rnd.randint(1, 4) for _ in range(150)]
    near = [" ".join(rnd.choice("qrstuv") if rnd.random() < 0.013 else w for w in base) for _ in range(60)]
    texts = [*sample, *near, *(t and t.upper() for t in sample[:9]), " ".join(base[:9]), " ".join(base[:8])]
    roots = brute_similar(texts)
    for few, block in ((32, 2048), (2, 2048), (2, 7), (1000, 7)):  # pairs only, and cells of one and of two blocks
        kept = similar_texts.keep_one(docs(texts), few=few, block=block)
        assert sorted(r.doc_id for r in kept.collect()) == sorted(set(roots))
    stage = corpus_pipeline.near_dedup_stage(docs(texts).sparkSession, docs(texts), "")
    assert sorted(r.doc_id for r in stage.collect()) == sorted(set(roots))
    assert similar_texts.keep_one(docs([])).count() == 0


def test_similar_texts_null_and_repeated_ids(docs, sample):
    texts = [sample[0], sample[0], sample[1], sample[1], sample[2], sample[2], sample[3], sample[4]]
    kept = similar_texts.keep_one(docs(texts, ids=[None, None, 7, 7, None, 3, 5, 5])).collect()
    place = {t: i for i, t in enumerate(sample[:5])}
    assert sorted((place[r.text], -1 if r.doc_id is None else r.doc_id) for r in kept) == [(0, -1), (1, 7), (2, 3), (3, 5), (4, 5)]


def test_f1_components_of_cells_need_one_worker_a_task(docs, monkeypatch):
    seen, components = [], similar_texts.components
    monkeypatch.setattr(similar_texts, "components", lambda links: seen.append(links) or components(links))
    rnd = random.Random(3)
    base = [f"w{k}" for k in range(150)]
    texts = [" ".join(rnd.choice("qrstuv") if rnd.random() < 0.013 else w for w in base) for _ in range(30)]
    kept = similar_texts.keep_one(docs(texts), few=2, block=7)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_similar(texts)))
    plan = seen[0]._jdf.queryExecution().toString()
    assert "Union" in plan and "MapInArrow" not in plan


def test_f2_near_texts_meet_by_golay_keys(docs):
    rng = np.random.default_rng(5)
    sums = rng.integers(-9, 10, (300, 23)).astype(np.float32)
    products = sums @ simhash_dedup.codewords()
    index = similar_texts.nearest(sums)
    assert (products[np.arange(300), index // 2 + 2048 * (index % 2)] == products.max(axis=1)).all()
    for own, more in ((4, (1, 0)), (8, (1, 1)), (40, (5, 5)), (400, (100, 0))):  # similarities of 0.8, with the bounds' worst sizes
        x = rng.integers(0, 1 << 63, (200, own + sum(more))).astype(np.uint64)
        sets = [np.unique(r[: own + more[0]]) for r in x], [np.unique(np.append(r[:own], r[own + more[0] :])) for r in x]
        (a, p), (b, q) = (similar_texts._keys_and_prints(s) for s in sets)
        assert abs((a == b).mean() - 0.265) < 0.02 and (a == b).any(axis=1).all() and (a[1:] == b[:-1]).mean() < 0.001
        assert similar_texts._near(p, q).all() and not similar_texts._near(p[1:], q[:-1]).any()
    # pairs at 0.8 just: 48 words, and 11 more; none is lost, and no other is joined
    texts = [" ".join(f"w{i}x{k}" for k in range(n)) for i in range(60) for n in (48, 59)]
    kept = similar_texts.keep_one(docs(texts))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 120, 2))


@pytest.mark.parametrize("size", [40, 900])  # along the sorted rows, and by parts
def test_f2_groups_of_one_key_lose_no_pair(size):
    rng = np.random.default_rng(size)
    centres = rng.integers(0, 1 << 63, (12, 4)).astype(np.uint64)
    which = np.where(rng.random(size) < 0.5, 0, rng.integers(0, 12 * size, size))
    prints = np.where(which[:, None] < 12, centres[which % 12], rng.integers(0, 1 << 63, (size, 4)).astype(np.uint64))
    prints[:, 0] ^= np.uint64(1) << rng.integers(0, 63, size).astype(np.uint64)
    n, name, key = np.sort(rng.integers(10, 40, 2 * size)), rng.permutation(2 * size), np.repeat([3, 4], size)
    n[:size].sort()
    n[size:] = n[:size]
    prints = np.concatenate([prints, prints])
    rows = pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(name), pa.array(n), *(pa.array(p) for p in prints.view(np.int64).T)], ["key", "name", "n", *similar_texts._PRINT])
    got = pa.Table.from_batches(similar_texts._group_rows(0.8, 6)(iter([rows.slice(0, 17), rows.slice(17)]))).to_pylist()
    pairs, parts = {frozenset((r["a"], r["b"])) for r in got if r["b"] is not None}, {}
    for r in got:
        if r["b"] is None:
            parts.setdefault(r["key"], set()).add(r["a"])
    part = {(a, k) for k, own in parts.items() for a in own}
    label = {a: [k for k in parts if (a, k) in part] for a in name.tolist()}
    near = lambda i, j: n[i] >= 0.8 * n[j] and similar_texts._near(prints[i], prints[j])
    wanted = [(int(name[i]), int(name[j])) for g in (0, size) for i in range(g, g + size) for j in range(i + 1, g + size) if near(i, j)]
    assert wanted and parts and all(frozenset(w) in pairs or set(label[w[0]]) & set(label[w[1]]) for w in wanted)
    assert all(len(own) > 6 for own in parts.values()) and pairs & {frozenset(w) for w in wanted}


def test_f1_parts_of_many_keys_share_their_heads():
    rng = np.random.default_rng(7)
    k, keys = 400, 56
    name, n, signs = rng.permutation(10 * k)[:k], np.sort(rng.integers(90, 110, k)), rng.integers(0, 1 << 63, 4)
    some = [np.flatnonzero(rng.random(k) < 0.5) for _ in range(keys)]
    at, key = np.concatenate(some), np.repeat(np.arange(keys, dtype=np.int32), [len(x) for x in some])
    rows = pa.RecordBatch.from_arrays([pa.array(key), pa.array(name[at]), pa.array(n[at]), *(pa.array(np.full(len(at), x)) for x in signs)], ["key", "name", "n", *similar_texts._PRINT])
    got = pa.Table.from_batches(similar_texts._group_rows(0.8, 6)(iter([rows]))).to_pylist()
    pairs = {(r["a"], r["b"]) for r in got if r["b"] is not None}
    # one head for each key would give each set 28 pairs or so
    assert len({b for _, b in pairs}) <= 16 and len(pairs) <= 10 * k
    assert sum(r["b"] is None for r in got) == len(at)
    place = {x: i for i, x in enumerate(name.tolist())}
    assert all(k // 8 < place[b] < k - k // 8 for _, b in pairs)  # heads are of middle size


# line dedup ------------------------------------------------------------------------------------------------------------------
def test_line_dedup(docs):
    texts = [f"own {i}\n All rights reserved. \n\nmore {i}\n{'long ' * 60}" for i in range(12)] + ["All rights reserved.", None, "", "x\nAll rights reserved.\r", "rare\nline", "line"]
    sources = [f"s{i}" for i in range(12)] + ["s0", "s1", "s2", None, "s1", "s2"]
    got = rows(line_dedup.line_dedup(docs(texts, sources=sources), min_sites=10))
    assert got[3]["text"] == "own 3\n\nmore 3" and (got[3]["n_lines"], got[3]["n_removed"]) == (5, 2)
    assert got[12]["text"] == "All rights reserved." and got[12]["n_removed"] == 0  # nothing else: left alone
    assert got[13]["text"] is None and got[13]["n_lines"] == 0 and got[14]["text"] == ""
    assert got[15]["text"] == "x" and got[16]["text"] == "rare\nline" and got[3]["key"] == 1
    short = rows(line_dedup.line_dedup(docs(texts, sources=sources), min_sites=10, max_chars=200))
    assert short[3]["text"] == f"own 3\n\nmore 3\n{'long ' * 60}" and short[3]["n_removed"] == 1
    assert rows(line_dedup.line_dedup(docs(texts, sources=sources), min_sites=13))[3]["n_removed"] == 0
    assert line_dedup.line_dedup(docs([])).count() == 0


def test_line_dedup_null_and_repeated_rows(docs):
    texts = [f"own {i}\nshared line" for i in range(12)] + ["a\nshared line", "a\nshared line", "b\nshared line", "c\nshared line", "c\nshared line"]
    ids = [*range(12), None, None, 3, 20, 20]
    got = line_dedup.line_dedup(docs(texts, ids=ids, sources=[f"s{i}" for i in range(17)])).collect()
    found = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in got)
    assert found == sorted([(i, f"own {i}") for i in range(12)] + [(-1, "a"), (-1, "a"), (3, "b"), (20, "c"), (20, "c")])


def test_line_spread_counts_sites_exactly(docs):
    """Lines of 1 to 60 sites, each several times: sketches decide far from the threshold, exact counts near it."""
    texts = [f"own {i}\n" + "\n".join(f"line of {n}" for n in range(1, 61) if i % 60 < n) for i in range(240)]
    got = line_dedup.line_dedup(docs(texts, sources=[f"s{i % 60}" for i in range(240)]), min_sites=20).collect()
    left = {line for r in got for line in r.text.split("\n") if not line.startswith("own")}
    assert left == {f"line of {n}" for n in range(1, 20)}


def test_line_stage_has_no_longest_line(spark, docs):
    long = " ".join(f"word{k}" for k in range(80))
    texts = [f"own {i}\n{long}\nmore {i}" for i in range(12)] + [long, f"x\n{long} y"]
    got = rows(corpus_pipeline.line_stage(spark, docs(texts, sources=[f"s{i}" for i in range(14)]), ""))
    assert got[3]["text"] == "own 3\nmore 3" and got[3]["n_chars"] == 12
    assert got[12]["text"] == long and got[13]["text"] == texts[13]  # nothing else: left alone; and a rare line


# names that clash ------------------------------------------------------------------------------------------------------------
CLASHES = ("score", "lang_pred", "held_out", "n_lines", "n_removed", "__found", "___found", "__gone", "__kept", "__a", "__b", "__text_a", "__text_b", "__doc", "__doc_id", "__n", "line", "site", "a", "b", "name", "root", "items", "passed", "found", "n_hit", "line_")


def test_stages_decide_as_without_clashing_names(spark, tmp_path, sample):
    """Columns with every name that an operator makes come through untouched, and change no decision."""
    from pyspark.sql import functions as F

    plain = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(spark.createDataFrame([(None, "the same text of nobody", "en", None, 3), (9, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    clash = plain.withColumns({c: F.concat(F.lit(c), F.coalesce("doc_id", F.lit(-1)).cast("string")) for c in CLASHES})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        one, other = (stage(spark, docs, "/root/testdata/sf0.001") for docs in (plain, clash))
        assert other.columns == clash.columns
        rows = other.collect()
        assert sorted(map(tuple, one.collect()), key=str) == sorted((tuple(r)[:5] for r in rows), key=str), name
        assert all(r[c] == f"{c}{-1 if r.doc_id is None else r.doc_id}" for r in rows for c in CLASHES), name

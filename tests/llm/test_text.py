"""Main text, URL verdicts, decontamination, toxicity and the pipeline."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.llm.decontam import drop_leaks, leaks, window_hashes
from panelyard.llm.htmltext import array_runs, blocks, core, main_text, packed, suffix_array, unpacked, word_codes
from panelyard.llm.toxicity import drop_toxic, fit, passages, segments
from panelyard.llm.urlfilter import judge_urls


def kept(html):
    return [line for line, standing in blocks(html) if standing > 0]


@pytest.mark.parametrize("html, want", [
    ("", []),
    ("just text", ["just text"]),
    ("<p>a&amp;b &lt;i&gt;&nbsp;c\n\t d<p>e<br>f", ["a&b <i> c d", "e f"]),
    ("<script>var t='</p>';</script><style>p{}</style><p>x</p><!-- <p>no</p> -->", ["x"]),
    ("<nav>menu</nav><div class='cookie-notice'>ok?</div><p>x</p><div id=sidebar>s</div><footer>f</footer>", ["x"]),
    ("<body class='sidebar home'><p>x</p></body>", ["x"]),
    ("<article><header><h1>Title</h1></header><p>x<aside>ad</aside>y</article><section class=comments><p>hi</p></section>", ["Title", "x", "y"]),
    ("<article><div class='article-header'><h2>T</h2></div><p>x</p></article><div class='page-header'>site</div>", ["T", "x"]),
    ("<form><p>sign up</p></form><ul><li>a<li>b</ul>", ["a", "b"]),
    ("<article><p>cut in the mid", ["cut in the mid"]),
    ("<p title='a>b'>x</p><p", ["x"]),
    ("a < b and <b>c</b>", ["a < b and c"]),
    ("<script>never closed <p>x</p>", []),
])
def test_blocks(html, want):
    assert kept(html) == want


def brute_main(pages, run, least, share):
    """(head, tail) of each page, a list of words, by the definition."""
    cores = [core(word_codes([p]), run) if p else 0 for p in pages]
    every = {c for c, p in zip(cores, pages) if len(p) >= run}
    need = max(least, math.ceil(share * len(every)))

    def longest(p, turned):
        for w in range(len(p), run - 1, -1):
            if len({c for c, q in zip(cores, turned) if q[:w] == p[:w] and len(q) >= run}) >= need:
                return w
        return 0

    backwards = [p[::-1] for p in pages]
    out = [(longest(p, pages), longest(p[::-1], backwards)) for p in pages]
    return [(0, 0) if 2 * (h + t) > len(p) else (h, t) for p, (h, t) in zip(pages, out)]


def test_main_text_equals_brute_force(spark):
    rng = random.Random(9)
    heads, tails = ([[f"{n}{k}w{j}" for j in range(23)] for k in range(3)] for n in ("head", "tail"))
    sites = []
    for _ in range(3):
        pages = []
        for _ in range(40):
            own = [f"o{rng.randint(0, 60)}" for _ in range(rng.randint(0, 70))]
            head, tail = (rng.choice(x)[: rng.choice([0, 5, 8, 9, 15, 16, 17, 23])] for x in (heads, tails))
            pages.append(head + own + tail)
        sites.append(pages + pages[:2] + [pages[5] + ["end"]])
    rows = [(100 * s + k, f"http://s{s}.org/{k}", f"<p>{' '.join(p)}</p>") for s, pages in enumerate(sites) for k, p in enumerate(pages)]
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7), least_pages=4, share=0.1).collect()}
    cut = 0
    for s, pages in enumerate(sites):
        for k, (p, (h, t)) in enumerate(zip(pages, brute_main(pages, 8, 4, 0.1))):
            assert got[100 * s + k] == " ".join(p[h : len(p) - t])
            cut += h + t
    assert cut > 500 and len(got) == len(rows)


@pytest.mark.parametrize("seed", range(20))
def test_suffix_array_equals_sorted_suffixes(seed):
    rng = random.Random(seed)
    tokens = [rng.randint(0, rng.choice([1, 3, 50])) for _ in range(rng.randint(0, 120))] + [99]
    order, shared = suffix_array(np.array(tokens))
    want = sorted(range(len(tokens)), key=lambda k: tokens[k:])
    assert order.tolist() == want
    for a, b, n in zip(want, want[1:], shared[1:].tolist()):
        assert tokens[a : a + n] == tokens[b : b + n] and tokens[a + n] != tokens[b + n]


@pytest.mark.parametrize("seed", range(20))
def test_array_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    heads, tails = ([[k * 100 + rng.randint(0, 4) for k in range(12)] for _ in range(2)] for _ in range(2))
    made = set()
    for _ in range(40):
        inner = [rng.randint(0, 2) for _ in range(rng.randint(0, 4))]
        words = rng.choice(heads)[: rng.randint(0, 12)] + inner + rng.choice(tails)[rng.randint(0, 12) :]
        if len(words) >= 3:
            made.add((tuple(words), rng.random() < 0.6, rng.random() < 0.6))
    made = sorted(made)
    found = array_runs([np.array(w, dtype=np.uint64) for w, _, _ in made], *(np.array([m[k] for m in made], dtype=np.int64) for k in (1, 2)), 3)
    carried: dict = {}
    for c, side, n, number, place in found:
        carried.setdefault((side, n, number), set()).add(c)
        assert place == (0 if side == 0 else len(made[c][0]) - n)
    for c, (words, *signs) in enumerate(made):
        for side, sign in enumerate(signs):
            own = {n: held for (s, n, _), held in carried.items() if s == side and c in held}
            for n in range(3, len(words) + 1 if sign else 0):
                cut = (lambda w: w[:n]) if side == 0 else (lambda w: w[-n:])
                want = {k for k, m in enumerate(made) if m[1 + side] and len(m[0]) >= n and cut(m[0]) == cut(words)}
                # a run that is not given is carried by the same as the next longer one that is
                assert own[min(k for k in own if k >= n)] == want
            assert sign or not own


def test_packed_numbers_come_back():
    for numbers in ([5], [0, 0, 7, 2**32 - 1], sorted(random.Random(1).choices(range(2**32), k=1000))):
        assert unpacked(packed(np.array(numbers, dtype=np.uint32))).tolist() == numbers


def test_main_text_is_the_same_in_parts_and_slices(spark):
    rng = random.Random(4)
    head, tail, line = ([f"{name}{j}" for j in range(30)] for name in ("head", "tail", "line"))
    rows, texts = [], {}
    for k in range(60):
        own = [f"own{k}x{j}" for j in range(70)]
        a, b = rng.choice([0, 20, 30]), rng.choice([0, 20, 30])
        rows.append((k, "http://h.org/", f"<p>{' '.join(head[:a] + own[:40])}</p><p>{' '.join(line)}</p><p>{' '.join(own[40:] + tail[30 - b:])}</p>"))
        texts[k] = "\n\n".join(map(" ".join, (own[:40], line, own[40:])))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for sizes in ({}, {"part_windows": 200}, {"slice_words": 25}, {"part_windows": 1000, "slice_words": 3}):
        assert {r["page_id"]: r["text"] for r in main_text(pages, share=0.2, **sizes).collect()} == texts


def test_main_text(spark):
    head, tail = "start of our site with links to all of its parts", "read more of our many stories on this and other sites today"
    own = {k: f"{k}\n\nown words of page number {k} " + " ".join(f"u{k}x{j}" for j in range(40)) for k in range(12)}
    rows = [(k, f"http://host.org/{k}", f"<div>{head} {k}</div><div>{own[k].split(chr(10))[2]}</div><div>{tail}</div>") for k in range(12)]
    rows += [(50, "http://A.org/x", "<nav>m</nav><article><h1>T</h1><p>one  two</p></article>"), (51, None, None), (52, "no scheme", ""), (50, "http://A.org/x", "<p>again</p>"), (None, "http://b.org", "<p>" + "long " * 50_000 + "</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as host", "'x' as key", "'x' as id", "'x' as text")
    got = sorted(((r["page_id"], r["url"], r["text"]) for r in main_text(pages).collect()), key=repr)
    rest = [(50, "http://A.org/x", "T\n\none two"), (51, None, ""), (52, "no scheme", ""), (50, "http://A.org/x", "again"), (None, "http://b.org", ("long " * 50_000).strip())]
    assert got == sorted([(k, f"http://host.org/{k}", text) for k, text in own.items()] + rest, key=repr)
    assert main_text(pages.limit(0)).collect() == []


def test_main_text_keeps_quotes_copies_and_pages_of_boilerplate(spark):
    quote = " ".join(f"quote{j}" for j in range(40))
    line = "this work may be copied by all who name its first author"
    own = [" ".join(f"own{k}x{j}" for j in range(30)) for k in range(40)]
    rows = [(k, f"<article><p>{own[k]}</p><p>{line} half{k}</p></article>", f"{own[k]}\n\n{line} half{k}") for k in range(4)]
    # a quotation inside twelve articles, and one that ends two of them
    rows += [(10 + k, f"<article><p>{own[10 + k]}</p><p>{quote}</p><p>{own[39 - k]}</p></article>", f"{own[10 + k]}\n\n{quote}\n\n{own[39 - k]}") for k in range(12)]
    rows += [(30 + k, f"<article><p>{own[30 + k]}</p><p>{quote}</p></article>", f"{own[30 + k]}\n\n{quote}") for k in range(2)]
    # copies and near copies of one page
    rows += [(40 + k, f"<nav>menu {k}</nav><div>{quote} {own[9]}</div>", f"{quote} {own[9]}") for k in range(15)]
    rows += [(60 + k, f"<article><p>near {own[8]} end{k}</p></article>", f"near {own[8]} end{k}") for k in range(15)]
    pages = spark.createDataFrame([(i, f"http://h.org/{i}", h) for i, h, _ in rows], "page_id long, url string, html string")
    assert {(r["page_id"], r["text"]) for r in main_text(pages, share=0.05).collect()} == {(i, text) for i, _, text in rows}


def test_main_text_keeps_what_stands_beside_an_article(spark):
    banner, foot = "welcome to our site and all of its many pages", "read more of our many stories on this and other sites today"
    own = [" ".join(f"own{k}x{j}" for j in range(20)) for k in range(16)]
    side = [" ".join(f"side{k}x{j}" for j in range(12)) for k in range(16)]
    rows, texts = [], {}
    for k in range(12):
        before = f"<div>{banner} {side[k]}</div>" if k % 2 else f"<div>{banner}</div>"
        rows.append((k, f"<nav>menu {k}</nav>{before}<article><h1>T{k}</h1><p>{own[k]}</p></article><div>{side[k]} end{k}</div><div>{foot}</div><footer>f</footer>"))
        texts[k] = "\n\n".join([side[k]] * (k % 2) + [f"T{k}", own[k], f"{side[k]} end{k}"])
    # the main text stands beside a teaser, between two articles, and in containers only
    rows += [(12, f"<article><p>teaser</p></article><div><p>{own[12]}</p></div>"), (13, f"<article>a</article><p>{own[13]}</p><article>b</article>")]
    rows += [(14, f"<form><h1>T</h1><p>{own[14]}</p></form>"), (15, f"<div class='has-sidebar'><article>{own[15]}</article></div>")]
    texts |= {12: f"teaser\n\n{own[12]}", 13: f"a\n\n{own[13]}\n\nb", 14: f"T\n\n{own[14]}", 15: own[15]}
    pages = spark.createDataFrame([(k, f"http://h.org/{k}", h) for k, h in rows], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in main_text(pages).collect()} == texts


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None, None
    after = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", after)[0]
    path = re.match(r"[^?#]*", after[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = max((r for r in RULES if (host == r[1].split("/", 1)[0] or host.endswith("." + r[1].split("/", 1)[0])) and path.startswith("/" + r[1].split("/", 1)[1])), key=lambda r: len(r[1]), default=(None, None))
    return host, path, best[1], best[0]


URLS = [
    "http://a.example.com/en/1", "https://WWW.example.com/en/2?x=1", "http://www.example.com/de/", "http://example.com", "http://x.net/es/1", "http://x.net/fr/1#t", "http://x.net/de/1",
    "http://com/", "http://notexample.com/en/", "ftp://Ä.NET/es/", "no scheme", "", None, "http://", "a://b://c.com/", "http://q?x=/en/", "http://h#/en/", "http://x.net/es", "http://x.net//es/", "http://a b.com/\n/x", "HTTP://X.COM/EN/",
]


def test_url_verdicts(spark):
    rng = random.Random(1)
    many = [f"http://s{rng.randint(0, 9)}.example.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'es', 'fr', 'de'])}/{rng.randint(0, 9999)}" for _ in range(300)]
    rows = list(enumerate(URLS + many)) + [(0, "http://twice.org/"), (None, "http://no.org/id")]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' as host", "'x' as rule", "'x' as label", "'x' as length")
    got = judge_urls(pages, RULES).collect()
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"]) for r in got), key=repr) == sorted(((i, *brute_url(u)[:3]) for i, u in rows), key=repr)
    for r in got:
        assert r["verdict"] in ("allow", "block") and (r["rule"] is None) == (r["chance"] is not None)
        if r["rule"]:
            assert r["verdict"] == dict((t, v) for v, t in RULES)[r["rule"]]
    assert judge_urls(pages.limit(0), RULES).collect() == []
    assert {r["verdict"] for r in judge_urls(pages, []).collect()} == {"allow"}
    assert {r["verdict"] for r in judge_urls(pages, [("block", "com/")]).collect()} == {"block"}


def test_trees_learn_unseen_urls(spark):
    """Spam hosts are long and full of digits; the trees must tell held-out ones from plain ones."""
    rng = random.Random(4)

    def url(bad, tld):
        name = "".join(rng.choice("abcdefgh0123456789-") for _ in range(24)) if bad else "".join(rng.choice("abcdefgh") for _ in range(6))
        return f"http://{name}.{tld}/" + (f"{rng.randint(10**8, 10**9)}/{rng.randint(10**8, 10**9)}?a=1&b=2" if bad else "news/today")

    rows = [(i, url(i % 2 == 0, "bad.com" if i % 2 == 0 else "good.com")) for i in range(400)] + [(1000 + i, url(i % 2 == 0, "org")) for i in range(200)]
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string"), [("block", "bad.com/"), ("allow", "good.com/")]).filter("page_id >= 1000").collect()
    right = sum((r["verdict"] == "block") == (r["page_id"] % 2 == 0) for r in got)
    assert len(got) == 200 and right >= 180


def test_a_suffix_with_one_kind_of_label_is_no_verdict(spark):
    """All labels of net are blocks; what else stands in net is judged by its letters, as in com."""
    rng = random.Random(6)

    def url(bad, tld):
        name = "".join(rng.choice("abcdefgh0123456789-") for _ in range(24)) if bad else "".join(rng.choice("abcdefgh") for _ in range(6))
        return f"http://{name}.{tld}/" + (f"x/{rng.randint(10**8, 10**9)}?a=1&b=2" if bad else "x/news")

    rows = [(i, url(i % 2 == 0, "bad.com" if i % 2 == 0 else "good.com")) for i in range(400)]
    rows += [(1000 + i, url(False, "net").replace("/x/", "/es/")) for i in range(200)] + [(2000 + i, url(i % 2 == 0, "net")) for i in range(200)]
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string"), [("block", "bad.com/"), ("allow", "good.com/"), ("block", "net/es/")])
    asked = got.filter("page_id >= 2000").collect()
    assert sum((r["verdict"] == "block") == (r["page_id"] % 2 == 0) for r in asked) >= 180


ITEM = "A train travels 60 km in 2 hours while Alice walks 5 km to the old station near the river. How fast is the train?"
OTHER = "The green parrot of the captain learned to sing eleven songs before winter came over the quiet harbour town again."


def test_leaks(spark, docs):
    fill = " ".join(f"filler{k}" for k in range(60))
    rows = [
        (1, fill + " " + ITEM + " " + fill),
        (2, fill + ". " + ITEM.upper() + " " + fill),
        (3, "A train travels 75 km in 3 hours while Bob walks 9 km to the old station near the river. How fast is the train?"),
        # two numbers of the item are one here, so the slots do not map one to one
        (4, "A train travels 60 km in 60 hours while Alice walks 60 km to the old station near the river. How fast is the train?"),
        (5, fill + " the old station near the river. How fast is " + fill),
        (6, None), (7, ""), (8, fill * 200), (9, OTHER + " " + OTHER), (1, "another row of one"), (None, ITEM), (10, "12 13 14 15 16 17 18 19 20 21 22"),
    ]
    items = spark.createDataFrame([(7, ITEM), (8, OTHER), (9, None), (10, ""), (11, "1 2 3 4 5 6 7 8 9 10 11"), (12, "tiny item")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks(docs(rows, True), items).collect()}
    assert got >= {(1, 7), (2, 7), (3, 7), (9, 8)}
    assert got <= {(1, 7), (2, 7), (3, 7), (4, 7), (9, 8)}
    rows9 = [r for r in leaks(docs(rows), items).collect() if r["doc_id"] == 9]
    assert rows9[0]["hits"] == rows9[0]["windows"] == rows9[0]["equal_hits"]
    assert leaks(docs([]), items).collect() == [] and leaks(docs(rows), items.limit(0)).collect() == []
    kept_rows = drop_leaks(docs(rows, True), items)
    assert kept_rows.columns == docs(rows, True).columns
    ids = sorted((r["doc_id"] for r in kept_rows.collect()), key=repr)
    assert {5, 6, 7, 8, 10, None} <= set(ids) and not {1, 2, 3, 9} & set(ids)


FARM = "The farmer keeps 12 brown cows in the northern barn and feeds 7 of the small calves each morning before the children walk to school."
DENSE = "Add 3 kg and 4 kg and 5 kg to 6 kg then 7 kg and 8 kg and 9 kg before the cook weighs the whole basket."
WORDY = "Maria bought nine red apples. Peter gave her four more pears. Maria ate two of them today. Peter then sold the rest."


def test_leaks_with_other_slots(spark, docs):
    rows = [
        (1, FARM.replace("12", "30").replace("7", "30")),
        (2, DENSE.translate(str.maketrans("3456789", "7689354"))),
        (3, WORDY.replace("Maria", "Sofia").replace("Peter", "Oscar")),
        # one number becomes two, far from each other
        (4, (FARM + " " + FARM).replace("12", "30", 1)),
        (5, "3 kg and 4 kg and 5 kg and 6 kg and 7 kg and 8 kg and 9 kg"),
    ]
    items = spark.createDataFrame([(1, FARM), (2, DENSE), (3, WORDY), (4, FARM + " " + FARM)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in leaks(docs(rows), items).collect()}
    assert {(1, 1), (2, 2), (3, 3), (4, 4)} <= set(got) and not any(d == 5 for d, _ in got)
    for pair in ((1, 1), (2, 2), (3, 3)):
        assert got[pair]["hits"] == got[pair]["windows"]


def test_leaks_of_parts(spark, docs):
    """A long quote of a longer item, and a short item with one changed word, are leaks; shorter quotes are not."""
    long = " ".join(f"item{k}" for k in range(100))
    short = " ".join(f"brief{k}" for k in range(16))
    split = long.split()[:20]
    split[9] = "other"
    rows = [
        (1, "before " + " ".join(long.split()[30:70]) + " after"), (2, short.replace("brief8", "changed")), (3, "before " + " ".join(long.split()[30:42]) + " after"),
        (4, " ".join(split)), (5, " ".join(long.split()[:9] + ["x", "y"] + long.split()[11:16])),
    ]
    items = spark.createDataFrame([(1, long), (2, short)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in leaks(docs(rows), items).collect()}
    assert set(got) == {(1, 1), (2, 2), (4, 1)}
    assert (got[1, 1]["start"], got[1, 1]["end"]) == (1, 41) and (got[2, 2]["start"], got[2, 2]["end"]) == (0, 16)


def brute_segments(scores):
    """Recursively: the best sum, the shortest and leftmost of equal ones, then both sides."""
    best = None
    for a in range(len(scores)):
        total = 0.0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > 1e-12 and (best is None or total > best[2] + 1e-9 or abs(total - best[2]) < 1e-9 and b + 1 - a < best[1] - best[0]):
                best = (a, b + 1, total)
    if best is None:
        return []
    a, b, total = best
    right = [(x + b, y + b, s) for x, y, s in brute_segments(scores[b:])]
    return [*brute_segments(scores[:a]), best, *right]


@pytest.mark.parametrize("seed", range(40))
def test_segments_equal_brute_force(seed):
    rng = random.Random(seed)
    scores = [rng.uniform(-3, 2) for _ in range(rng.randint(0, 40))]
    got, want = segments(np.array(scores)), brute_segments(scores)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_toxicity_held_out(spark, docs):
    rng = random.Random(2)
    plain = [f"word{k}" for k in range(300)]
    rows, marks = [], []
    for i in range(900):
        toxic = i % 4 == 0
        words = [rng.choice(plain) for _ in range(rng.randint(20, 300))]
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vilestuff", "nastystuff", f"grubb{rng.randint(0, 10**6)}"]))
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    rows += [(2000, None), (2001, ""), (2002, "word1 " * 50_000), (None, "no id"), (5, "twice")]
    labels = spark.createDataFrame(marks + [(4000, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    model = fit(docs(rows, True), labels)
    got = {r["doc_id"]: r for r in passages(docs(rows, True), model).collect() if r["doc_id"] is not None}
    import zlib

    out = [(i, t) for i, t in marks if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((got[i]["score"] >= 0.7) == bool(t) for i, t in out if i != 5)
    assert right >= 0.97 * len(out)
    assert got[2000]["score"] == got[2001]["score"] < 0.3 and got[2000]["passages"] == []
    assert got[2002]["score"] < 0.3 and passages(docs(rows), model).count() == len(rows)
    left = drop_toxic(docs(rows, True), model)
    assert left.columns == docs(rows, True).columns and {2000, 2001, 2002} <= {r["doc_id"] for r in left.select("doc_id").collect()}
    assert passages(docs([]), model).collect() == []
    # labels of one kind, or none
    for few in (labels.filter("toxic = 0"), labels.limit(0)):
        assert all(r["score"] < 0.5 for r in passages(docs(rows[:5]), fit(docs(rows), few)).collect())


def test_held_out_labels_change_nothing(spark, docs):
    from panelyard.llm.toxicity import held_out

    rows = [(i, f"some words here number{i % 7} bad{i % 3}") for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    turned = labels.withColumn("toxic", F.when(held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = fit(docs(rows), labels), fit(docs(rows), turned)
    assert np.array_equal(a.toxic, b.toxic) and a.calibration == b.calibration


def test_rolling_window_hashes():
    """Two windows have one hash exactly when their words are the same, wherever they stand and however it is asked."""
    rng = np.random.default_rng(3)
    kinds = np.concatenate([rng.integers(1, 2**60, 3).astype(np.uint64) << np.uint64(3), np.array([8, 16, 24, 32], dtype=np.uint64)])
    words = kinds[rng.integers(0, len(kinds), 5000)]
    for width in (1, 3, 8):
        found = window_hashes(words, width)
        seen = {}
        for p in range(len(words) - width + 1):
            assert seen.setdefault(tuple(words[p : p + width].tolist()), found[p]) == found[p]
        assert len(set(found.tolist())) == len(seen)
        some = rng.integers(0, len(found), 50)
        assert (window_hashes(words, width, some) == found[some]).all()
    assert len(window_hashes(words[:2], 3)) == 0


def test_leaks_with_a_common_beginning(spark, docs):
    """An instruction that many items begin with is no leak; an item with it is, and so are copies of one item under many ids."""
    head = " ".join(f"choose{k}" for k in range(18))
    items = [(k, head + " " + " ".join(f"own{k}x{j}" for j in range(7))) for k in range(20)]
    items += [(100 + k, " ".join(f"copied{j}" for j in range(20)) + f" with {k} parts") for k in range(10)]
    rows = [(1, "before " + head + " after that"), (2, items[5][1]), (3, items[-1][1]), (4, head + " " + " ".join(items[7][1].split()[18:22]))]
    got = {(r["doc_id"], r["item_id"]) for r in leaks(docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(2, 5), (4, 7)} | {(3, 100 + k) for k in range(10)}

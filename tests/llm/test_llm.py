import gzip
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.llm import chat, embed_dedup, html_extract, langid, media, minhash, mixing, packing, sharding, url_filter
from topicloom.llm.bpe import Encoder
from topicloom.llm.dom import Page
from topicloom.llm.graph import connected_components
from topicloom.llm.shingles import Centre

DOCS = "doc_id long, text string, lang string, source string, component_id long, size string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 7, "clash") for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, clashing extra columns."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, "x", "en", "a"), (3, "x", "en", "a"), (None, "null id", "en", "b"), (4, long, "en", "b"), (5, long, "en", "b")]
    return documents(spark, rows)


def empty(df):
    return df.limit(0)


def test_page_text():
    page = '<nav>no</nav><article><h1>T &amp; U</h1><p>a<b>b</b>\n c<p>d<form>no</form><div class="comments">no</div></article><footer>no</footer>'
    assert Page(page).main_text() == "T & U ab c d"
    assert Page(None).main_text() == "" and Page("<p cut").main_text() == ""
    assert Page('<div class="has-sidebar"><main>yes</main></div><script>var t="</p>";</script>').main_text() == "yes"


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_style_tree_removes_template(spark, most):
    rows = [(i, f"http://h.com/{i}", f'<div class="top">Same words here</div><div class="body"><p>unique {i}</p></div>') for i in range(12)]
    pages = spark.createDataFrame([*rows, (99, None, None)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(pages, most=most).collect()}
    assert got == {i: f"unique {i}" for i in range(12)} | {99: ""}
    assert html_extract.extract(empty(pages)).count() == 0


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_style_tree_decides_inside_and_outside_landmarks(spark, most):
    shared = '<article><h1>title {0}</h1><p>body {0}</p><div class="box">the same on every page</div></article><div class="tail">same tail</div>'
    cards = '<article class="card"><p>teaser</p></article><div class="story"><p>story {0}</p><p>more {0}</p></div>'
    rows = [(i, f"http://a.com/{i}", shared.format(i)) for i in range(12)] + [(100 + i, f"http://b.com/{i}", cards.format(i)) for i in range(12)]
    pages = spark.createDataFrame([*rows, (200, "http://c.com/", shared.format(7))], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(pages, most=most).collect()}
    want = {i: f"title {i} body {i}" for i in range(12)} | {100 + i: f"story {i} more {i}" for i in range(12)}
    assert got == want | {200: "title 7 body 7 the same on every page"}


def test_noise_in_inline_elements_at_any_depth():
    deep = "<p>a<span class=ad><a><b><i><em><u><s>advert</s></u></em></i></b></a></span>b</p>"
    assert Page(f"<article>{deep}</article>").main_text() == "a b" or Page(f"<article>{deep}</article>").main_text() == "ab"
    assert Page("<article><p>a</p><ins class=ad><div>no<p>no</p></div></ins><p>b</p></article>").main_text() == "a b"
    assert Page("<article><p>x <math><mi>y</mi></math></p><svg><title>no</title><text>z</text></svg></article>").main_text() == "x y z"
    assert Page("<div>" * 3000 + "deep" + "</div>" * 3000).main_text() == "deep"


def test_deep_nesting_and_names():
    """Time is linear in the nesting; only whole names count as marks."""
    import time

    for deep in ("<div>" * 100_000 + "deep", "<div>" * 50_000 + "<li>x</zz>" * 10_000, "<b>" * 50_000 + "deep"):
        began = time.monotonic()
        assert Page(deep).main_text()
        assert time.monotonic() - began < 8  # about 1 s on an idle machine
    assert Page('<article><p>a</p><div class="related-work">b</div><div class="share">no</div></article>').main_text() == "a b"


def test_the_tree_alone_finds_what_landmarks_say(spark):
    """Menus, adverts and footers whose words differ from page to page go by their fixed place."""
    rng = np.random.default_rng(3)
    said = lambda n: " ".join(f"w{rng.integers(3000)}" for _ in range(n))
    page = '<nav><ul>{}</ul></nav><div class="ad">{}</div><article><h1>{}</h1>{}</article><footer>{}</footer>'
    rows = []
    for i in range(40):
        items = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in said(6).split())
        rows.append((i, f"http://h.com/{i}", page.format(items, said(8), said(4), "".join(f"<p>{said(60)}</p>" for _ in range(rng.integers(1, 12))), said(9))))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    marked, alone = ({r.page_id: r.text for r in html_extract.extract(pages, landmarks=x).collect()} for x in (True, False))
    assert marked == alone == {i: Page(h).main_text() for i, _, h in rows}


def test_importance_against_the_recursive_formula(spark):
    from collections import Counter, defaultdict

    shapes = ["<div class=top>same</div><article><h1>t{0}</h1><p>b{0}</p>{1}</article>", "<ul><li>x{2}</li><li>y</li></ul><div><p>q{0}</p></div>", "<div class=top>same</div><div><p>only</p></div>"]
    rows = [("h.com" if i < 14 else "g.com", shapes[i % 3].format(i, "<p>more</p>" * (i % 4), i % 2)) for i in range(20)]
    got = {(r.host, r.path): r for r in html_extract.style_tree(spark.createDataFrame([*rows, rows[0]], "host string, html string")).collect()}
    rows, seen = [*rows, rows[0]], 0
    for host in ("h.com", "g.com"):
        pages = [Page(h) for x, h in rows if x == host]
        shown, texts, styles, share, parent = Counter(), defaultdict(Counter), defaultdict(Counter), Counter(), {}
        for page in pages:
            for path in {e.path for e in page.elements}:
                shown[path] += 1
            for e in page.elements:
                parent[e.path] = e.parent and e.parent.path
                if e.kids:
                    styles[e.path][tuple(e.kids)] += 1
                    for k in e.kids:
                        share[k] += 1 / len(e.kids)
            for path, t in {(e.path, w) for e, t in page.blocks for w in t.split()}:
                texts[path][t] += 1
        count = Counter(e.path for page in pages for e in page.elements)

        def composite(path):
            m, l = shown[path], len(styles[path])
            if not l:
                return content(path) if texts[path] else 1.0
            total = sum(styles[path].values())
            present = 1.0 if m <= 1 else min(1.0, -sum(n / total * np.log(n / total) for n in styles[path].values()) / np.log(m))
            below = sum(share[k] / count[path] * composite(k) for k in parent if parent[k] == path)
            return (1 - 0.9**l) * present + 0.9**l * below

        def content(path):
            m = shown[path]
            return 1.0 if m <= 1 else 1 - np.mean([np.log(n) / np.log(m) for n in texts[path].values()])

        for path in shown:
            want = max(composite(path), content(path) if texts[path] else 0)
            assert got[host, path].importance == pytest.approx(want, abs=1e-9) and got[host, path].pages == shown[path]
            told = {p: sum(n * (1 - np.log(n) / np.log(shown[p])) if shown[p] > 1 else n for n in texts[p].values()) for p in shown}
            below = lambda p: told[p] + sum(below(k) for k in parent if parent[k] == p)
            if parent[path] in shown and below(parent[path]) > 0:
                assert got[host, path].share == pytest.approx(below(path) / below(parent[path]), abs=1e-9)
            seen += 1
    assert seen == len(got) > 12


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_pages_odd(spark, most):
    """Repeated rows, columns whose names clash, nulls, a very long page, a host that holds most pages."""
    long = "<article>" + "".join(f"<p>word{i} &lt;{i}&gt;</p>" for i in range(30_000)) + "</article>"
    rows = [(1, "http://h.io/a", long), (1, "http://h.io/a", long), (2, None, "<p>x</p>"), (3, "http://h.io/b", None), (None, "http://h.io/c", ""), (4, "http://h.io/d", "plain  text")]
    rows += [(i, "http://h.io/x", f"<div><b>same</b></div><p>n{i}</p>") for i in range(10, 40)]
    df = spark.createDataFrame([(*r, "salt", 1, "no") for r in rows], "page_id long, url string, html string, host string, row int, text string")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in html_extract.extract(df, most=most).collect())
    want = " ".join(f"word{i} <{i}>" for i in range(30_000))
    texts = [(1, want), (1, want), (2, "x"), (3, ""), (0, ""), (4, "plain text"), *((i, f"n{i}") for i in range(10, 40))]
    assert got == sorted((i, t, len(t)) for i, t in texts)


def test_wrapper_with_a_noise_word_is_kept():
    page = '<div class="page has-sidebar"><h1>T</h1><p>long text of the page</p><div class="sidebar">no</div></div><div class="comments">no</div>'
    assert Page(page).main_text() == "T long text of the page"
    assert Page('<p>text</p><div class="comments"><p>a comment longer than the text</p></div>').main_text() == "text"


@pytest.mark.parametrize("tile,few", [(512, 20_000), (4, 0)])
def test_embeddings_against_brute_force(spark, monkeypatch, tile, few):
    """Also with buckets cut into tiles, and nothing broadcast."""
    monkeypatch.setattr(embed_dedup, "TILE", tile)
    monkeypatch.setattr("topicloom.llm.common.BROADCAST_ROWS", few)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    x = np.concatenate([base, base[:40] + rng.standard_normal((40, 16)) * 0.08, base[:5], base[7:8] * 3])
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [1.0], 0), (903, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep int")
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    g = u @ u.T >= 0.95
    np.fill_diagonal(g, False)
    assert [got[i].n_links for i in range(len(x))] == g.sum(1).tolist()
    comp = np.arange(len(x))
    for _ in range(len(x)):
        comp = np.minimum(comp, np.where(g, comp[None, :], 10**9).min(1))
    assert [got[i].component_id for i in range(len(x))] == comp.tolist()
    assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902)) and got[903].n_links == 1
    assert embed_dedup.near_duplicates(empty(df)).count() == 0


@pytest.mark.parametrize("n", [10**4, 10**6, 10**8])
def test_embedding_pairs_meet_at_every_table_size(n):
    words = embed_dedup.codebook_size(n)
    for dim, cosine in ((64, 0.951), (16, 0.96)):
        codes = embed_dedup.codes_for(dim, words)
        x, y = embed_dedup.random_pairs(2000, dim, cosine, 11)
        p, q = (embed_dedup.decode(v, words, codes)[1].reshape(len(v), -1) for v in (x, y))
        assert all(np.intersect1d(a, b).size for a, b in zip(p, q, strict=True))
        assert embed_dedup.miss_rate(dim, words, embed_dedup.COSINE) ** codes <= embed_dedup.MISS


def test_language(spark, odd):
    en, de = "the cat and the dog went there with this thing", "der hund und die katze gehen nicht zu einem haus"
    rows = [(i, (en if i % 2 else de) + f" {i}", "en" if i % 2 else "de", "s") for i in range(200)]
    df = documents(spark, [*rows, (900, None, "en", "s"), (901, "12 ... ", "en", "s"), (902, "the dog with this", None, "s")])
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") for i in range(200))
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "en"
    assert got[5].held_out == (zlib.crc32(b"5") % 4 == 2)
    assert langid.identify(odd).count() == odd.count() and langid.identify(empty(odd)).count() == 0
    assert langid.accept(df).columns == df.columns and langid.accept(df).count() == 201


def test_code_lengths_are_exact():
    """Costs in every context are a complete code: probabilities sum to at most one."""
    gram = langid._grams(np.frombuffer(b"abracadabra abracadabra abracadabra", np.uint8), np.array([0]))
    key, n = np.unique(gram, return_counts=True)
    m = langid.Model(["x"], np.zeros(len(key), int), key.astype(np.int64), n.astype(float))
    total = np.exp2(-m.cost[:, :, 0].astype(float)).sum(1)
    assert (total <= 1 + 1e-5).all() and (total > 0.9).all()


def test_language_model_keeps_all_contexts_and_is_exact():
    """Against PPM with exclusions written out, with many and unequal languages."""
    rng = np.random.default_rng(8)
    texts = [bytes(rng.choice(list(b"abcdefgh"), 4000 if i else 300, p=rng.dirichlet(np.ones(8))).tolist()) for i in range(200)]
    parts = [np.unique(langid._grams(np.frombuffer(t, np.uint8), np.array([0])), return_counts=True) for t in texts]
    lang = np.repeat(np.arange(200), [len(k) for k, _ in parts])
    gram, n = np.concatenate([k for k, _ in parts]).astype(np.int64), np.concatenate([c for _, c in parts]).astype(float)
    m = langid.Model([f"l{i:03}" for i in range(200)], lang, gram, n)
    assert len(m.contexts[3]) > 256
    grams = [langid._grams(np.frombuffer(t, np.uint8), np.array([0])) for t in texts]

    def cost(i, g):
        bits, out = 0.0, set()
        for k in range(3, -1, -1):
            c = int(g) >> 8 & (1 << 8 * k) - 1
            if not (m.contexts[k] == c).any():
                continue
            seen = {int(b): x for b, x in zip(*tables[i][k].get(c, ((), ())), strict=True) if int(b) not in out}
            total = sum(seen.values()) + len(seen)
            if int(g) & 255 in seen:
                return bits - np.log2(seen[int(g) & 255] / total)
            bits -= np.log2(len(seen) / total) if seen else 0
            out |= set(seen)
        return bits + np.log2(256 - len(out))

    tables = {}
    for i in (0, 1, 199):
        tables[i] = [{c: np.unique(grams[i][(grams[i] >> 8 & (1 << 8 * k) - 1) == c] & 255, return_counts=True) for c in np.unique(grams[i] >> 8 & (1 << 8 * k) - 1)} for k in range(4)]
        asked = np.concatenate([grams[1][:200], langid._grams(np.frombuffer(b"abcz hgfe\xff", np.uint8), np.array([0]))])
        assert m.trees[i].costs(asked) == pytest.approx([cost(i, g) for g in asked], abs=1e-4)
    data = np.frombuffer(b"".join(t[:300] for t in texts), np.uint8)
    assert (m.score(data, np.arange(201) * 300).argmin(1) == np.arange(200)).mean() > 0.97


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<s>\\<s>", "\\", "[\\INST]", "", None, "<\\s>[/INST"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(nasty)] + [(2, 0, "user", "only")] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    ex = chat.expand(df)
    got = {r.conv_id: r for r in chat.read_back(ex).collect()}
    said = "".join(f"{r}\n{t or ''}\n" for _, _, r, t in rows[:7])
    loss = "".join(t or "" for _, _, r, t in rows[:7] if r == "assistant")
    assert got[1].n_turns == 7 and got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[1].loss_chars == len(loss) and got[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert got[2].loss_chars == 0 and got[None].n_turns == 1
    assert ex.filter("conv_id = 1 AND trainable").count() == 3 and chat.expand(empty(df)).count() == 0


def test_url_rules_and_list(spark):
    urls = ["http://a.example.net/en/x", "http://b.net/", "http://b.net", "HTTP://X.Example.COM/de/?q", "http://org/fr/#f", "nothing", None, "http://www.bad.io/p/?utm_x=1", "http://ok.io/p"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame([("bad.io/p",), (None,), ("bad.io/p",)], "key string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, listed).orderBy("page_id").collect()]
    assert got == [
        ("a.example.net", "/en/x", "example.net/en/", "allow"), ("b.net", "/", "net/", "block"), ("b.net", "", None, "allow"), ("x.example.com", "/de/", "example.com/de/", "block"),
        ("org", "/fr/", "org/fr/", "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("www.bad.io", "/p/", None, "block"), ("ok.io", "/p", None, "allow"),
    ]
    assert url_filter.judge(empty(pages), empty(listed)).count() == 0


def test_chat_odd(spark):
    """Repeated rows, columns whose names clash, very long texts, a conversation that holds most turns."""
    long = "<s>\\é" * 30_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (1, 1, "assistant", long), *((2, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(60))]
    df = spark.createDataFrame([(*r, "shown", 1) for r in rows], "conv_id long, turn long, role string, text string, shown string, n_turns int")
    got = {r.conv_id: r for r in chat.read_back(chat.expand(df)).collect()}
    for c in (1, 2):
        own = [r for r in rows if r[0] == c]
        loss = "".join(r[3] for r in own if r[2] == "assistant")
        assert got[c].n_turns == len(own) and got[c].turns_sha256 == hashlib.sha256("".join(f"{r[2]}\n{r[3]}\n" for r in own).encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_urls_against_brute_force(spark, monkeypatch, most):
    """Filter broadcast or shuffled, so full that it passes pages that are not listed; one URL is very common."""
    monkeypatch.setattr(url_filter, "KEYS_PER_BLOCK", 200)
    rng = np.random.default_rng(12)
    hosts, sections = ["a.io", "www.a.io", "m.b.org", "B.org", "spam.example.com", "example.com", "x.net"], ["", "/", "/de/", "/fr/x", "/de/9.html"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(sections)}{rng.choice(['', '/', '?page=2&ref=x', '#top', '?utm_a=1&q'])}" for _ in range(300)]
    urls += ["http://a.io/hot"] * 200 + [None, "nothing", "://", "http://a.io\n/de"]
    listed = [k for h in ("a.io", "b.org", "spam.example.com") for k in (h, f"{h}/de", f"{h}/de/9?page=2")] + [f"other{i}.io/de" for i in range(150)]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate([*urls, *urls[:40]])], "page_id long, url string, key string")
    got = {r.page_id: r for r in url_filter.judge(df, spark.createDataFrame([(k,) for k in listed], "key string"), most=most).collect()}
    assert len(got) == len(urls) + 40
    for i, u in enumerate([*urls, *urls[:40]]):
        m = re.match(r"[^?#]*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?", u or "", re.S) if u and "://" in u else None
        host, path, query = (m[1].lower(), m[2], m[3] or "") if m else ("", "", "")
        kept = "&".join(f for f in query.split("&") if f and not f.startswith(("utm_", "ref=")))
        key = m and re.sub(r"^(www|m)\.", "", host) + re.sub(r"(\.html)?/*\Z", "", path, count=1) + ("?" + kept if kept else "")
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, default=(0, None, "block" if key in listed else "allow"))
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict, got[i].listed) == (host, path, rule[1], rule[2], key in listed)
        assert got[i].possible or not got[i].listed
    assert sum(r.possible and not r.listed for r in got.values()) > 20


def test_published_list_is_canonical(spark):
    keys = url_filter.published_list(spark, sites=("a.com",), pages=3)
    assert keys.count() == 24 and keys.filter(url_filter.canonical(F.concat(F.lit("http://www."), "key")) != F.col("key")).isEmpty()


def test_tokens_equal_the_tokenizer(monkeypatch):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.tokenizer_path())
    rng = np.random.default_rng(1)
    alphabet = [*"ab's tmdrevl'' \n\t 1½²é\xa0\x85\x1c.,-<|endoftext|>ÀßLL've’中", "<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 25))) for _ in range(3000)] + ["a <|endoftext|> b", "don't " * 3000]
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    enc = Encoder(packing.tokenizer_path())
    assert [x.tolist() for x in enc.encode(texts)] == want and enc.known > 100
    assert [x.tolist() for x in enc.encode(texts[::-1])] == want[::-1]
    # Hashes that tell nothing apart: the comparison of the pieces finds it.
    monkeypatch.setattr("topicloom.llm.bpe._R", np.uint64(0))
    assert [x.tolist() for x in Encoder(packing.tokenizer_path()).encode(texts)] == want


def test_packing(spark, odd):
    got = packing.pack_documents(odd).toPandas()
    assert (got.groupby("sequence_id").length.sum() <= 1024).all()
    s = got.sort_values(["sequence_id", "offset"])
    assert ((s.groupby("sequence_id").length.cumsum() - s.length) == s.offset).all()
    assert (got[got.piece > 0].length == 1024).all() and (got[got.doc_id == 1].length == 1).all() and (got.doc_id == 3).sum() == 2
    assert packing.pack_documents(empty(odd)).count() == 0


def test_stack_match_takes_the_smallest_gap_that_fits():
    rng = np.random.default_rng(3)
    for _ in range(200):
        rows = sorted(((int(rng.integers(1, 12)), bool(rng.integers(2))) for _ in range(int(rng.integers(0, 40)))), key=lambda r: (-r[0], not r[1]))
        got = packing.stack_match(np.array([g for _, g in rows], bool))
        free, want = [], []
        for i, (size, gap) in enumerate(rows):
            want.append(-1 if gap or not free else free.pop())
            if gap:
                free.append(i)
        assert got.tolist() == want and all(rows[j][0] >= rows[i][0] for i, j in enumerate(got) if j >= 0)
        # Dealt to three ranges, what is matched inside and between them is as much.
        at = sorted(rng.integers(0, len(rows) + 1, 2).tolist())
        waiting, free, inside = [], [], 0
        for lo, hi in zip([0, *at], [*at, len(rows)], strict=True):
            gap = np.array([g for _, g in rows[lo:hi]], bool)
            to = packing.stack_match(gap)
            inside += (to >= 0).sum()
            waiting.append(int((~gap & (to < 0)).sum()))
            free.append(int(gap.sum() - (to >= 0).sum()))
        segments, taken, left = packing.carry(waiting, free)
        assert inside + sum(taken) == sum(w >= 0 for w in want) and sum(taken) == sum(free) - sum(left) == sum(hi - lo for _, lo, hi, _, _ in segments)


def best_fit_decreasing(sizes, capacity):
    gaps: list[int] = []
    for x in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= x]
        if fit:
            gaps[gaps.index(min(fit))] -= x
        else:
            gaps.append(capacity - x)
    return len(gaps)


def test_packing_against_best_fit_decreasing(spark):
    rng = np.random.default_rng(0)
    for sizes in (rng.integers(1, 101, 400), np.minimum(rng.geometric(0.15, 300), 100), np.full(40, 34)):
        df = spark.createDataFrame([(i, 0, 0, int(x), 9) for i, x in enumerate(sizes)], packing.PIECES)
        got = packing.pack(df.repartition(3), 100).toPandas().sort_values(["sequence_id", "offset"])
        assert sorted(got.doc_id) == list(range(len(sizes))) and got.length.tolist() == [sizes[i] for i in got.doc_id]
        assert ((got.groupby("sequence_id").length.cumsum() - got.length) == got.offset).all() and (got.groupby("sequence_id").length.sum() <= 100).all()
        assert got.sequence_id.nunique() <= best_fit_decreasing(sizes.tolist(), 100) * 1.02 + 1
    with pytest.raises(ValueError, match="do not fit"):
        packing.pack(df, 33)


def test_media(spark, odd):
    p, gz = media.png(b"\0", 1), gzip.compress(b"hello" * 50)
    wav = media.wav(b"12" + p + b"BM GIF89a RIFF" + gz)
    assert media.sniff_bytes(wav) == ("audio/wav", len(wav), [("image/png", 46, len(p)), ("application/gzip", 46 + len(p) + 14, len(gz))])
    assert media.sniff_bytes(p[:-1]) == (media.PLAIN, len(p) - 1, []) and media.sniff_bytes(b"") == (media.PLAIN, 0, [])
    df = spark.createDataFrame([(1, bytearray(wav), "image/png"), (2, None, None)], "id int, media binary, declared string")
    s = media.sniff(df)
    rows = {r.id: r for r in s.collect()}
    assert rows[1].media_type == "audio/wav" and rows[1].corrected and rows[2].media_type is None
    assert bytes(media.carve(s, keep=["id"]).filter("media_type = 'image/png'").first().bytes) == p
    with pytest.raises(ValueError, match="media_type"):
        media.sniff(s)


def test_stored_texts_against_themselves(spark, odd):
    """Every digest column against the text itself, in all forms."""
    rng = np.random.default_rng(9)
    texts = {i: "".join(rng.choice(list("aé中 \n\0BMGIF89a"), int(rng.integers(0, 400)))) for i in range(60)} | {100: None, 101: "", 102: "x" * 64, 103: "y" * 100_000}
    df = documents(spark, [(i, t, "en", "s") for i, t in texts.items()] + [(104, texts[3], "fr", None)])
    stored = {r.doc_id: r for r in media.store_texts(df).collect()}
    got = {r.doc_id: r for r in media.digest(media.store_texts(df)).collect()}
    kinds = set()
    for i, t in texts.items():
        raw, value = (t or "").encode(), bytes(stored[i].media)
        payload = raw + bytes(64 if not raw else -len(raw) % 64)
        want = (i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(value), hashlib.sha256(value).hexdigest())
        assert tuple(got[i])[:7] == want
        kind = got[i].feature.partition("+")[0]
        kinds.add(kind)
        assert kind.rstrip("!") in ("audio/wav", "image/png", "image/bmp") and kind.endswith("!") == (stored[i].declared == "text/plain")
        assert len(re.findall(r"\+image/", got[i].feature)) >= ("bmp" not in kind)
    assert len(kinds) == 6 and tuple(got[104])[1:] == tuple(got[3])[1:]
    back = media.digest(media.store_texts(odd))
    assert back.count() == odd.count() and media.digest(media.store_texts(empty(odd))).count() == 0


def test_shards(spark, odd, tmp_path):
    texts = {i: None if i == 7 else "é" * (i % 50) + "t" * (i * i % 700) for i in range(3000)}
    many = documents(spark, [(i, t, "en", "s") for i, t in texts.items()])
    got = sharding.shard_documents(many, map_root=str(tmp_path / "map")).toPandas()
    raw = {i: (t or "").encode() for i, t in texts.items()}
    assert dict(zip(got.doc_id, got["size"], strict=True)) == {i: len(b) + 8 for i, b in raw.items()}
    assert dict(zip(got.doc_id, got.text_crc32, strict=True)) == {i: zlib.crc32(b) for i, b in raw.items()}
    load = got.groupby("shard")["size"].sum()
    assert len(load) == 24 and load.max() - load.min() <= load.mean() * 0.01
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    one, two = (sharding.load_map(spark, str(tmp_path / "map"), v) for v in (1, 2))
    assert one == sharding.first_map(24) and 0 < sum(one[s] != two[s] for s in one) < 400
    assert (got.shard == got.vslot.map(two)).all() and (got.map_version == 2).all()
    assert sharding.shard_documents(odd).count() == odd.count() and sharding.shard_documents(empty(odd)).count() == 0


def test_rebalance_moves_little(spark, tmp_path):
    load = {s: 10 + s % 7 for s in range(512)}
    one = sharding.rebalance(sharding.first_map(8, 512), load, 8)
    two = sharding.rebalance(one, load, 9)
    total = [sum(load[s] for s in two if two[s] == k) for k in range(9)]
    assert max(total) - min(total) <= 2 and sum(one[s] != two[s] for s in one) < 512 / 9 * 1.3
    fewer = sharding.rebalance(two, load, 5)
    assert set(fewer.values()) == set(range(5))
    for version, m in ((1, one), (2, two)):
        sharding.store_map(spark, str(tmp_path), version, m)
    assert sharding.load_map(spark, str(tmp_path), 1) == one and sharding.load_map(spark, str(tmp_path), 2) == two
    giant = sharding.rebalance(sharding.first_map(4, 16), {3: 1000} | {s: 10 for s in range(16) if s != 3}, 4)
    rest = [sum(10 for s in giant if giant[s] == k and s != 3) for k in range(4) if k != giant[3]]
    assert max(rest) - min(rest) <= 10


@pytest.mark.parametrize("few", [20_000, 0])
def test_mixture(spark, odd, monkeypatch, few):
    monkeypatch.setattr("topicloom.llm.common.BROADCAST_ROWS", few)
    rng = np.random.default_rng(0)
    rows = [(i, "w " * int(rng.lognormal(3, 1)), "en", [None, "a", "b", "c"][i % 4 if i % 3 else 1]) for i in range(2000)]
    df = documents(spark, rows)
    got = mixing.plan_copies(df).select("row.doc_id", "row.source", "size", "source_size", "target", "copies").toPandas()
    assert all(n == len(re.findall(r"[^\x20\x09-\x0D]+", rows[i][1])) for i, n in zip(got.doc_id, got["size"], strict=True))
    g = got.assign(taken=got.copies * got["size"]).groupby(got.source.fillna("~")).agg({"taken": "sum", "target": "first", "source_size": "first"})
    assert (abs(g.taken - g.target) <= 0.01 * g.target + 1).all() and (got.copies <= 2).all()
    assert abs(g.target.sum() - min(1.5 * g.source_size.sum(), 2 * g.source_size.sum())) < 1e-6 * g.target.sum()
    again = mixing.plan_copies(df.repartition(5)).select("row.doc_id", "copies").toPandas()
    assert dict(zip(got.doc_id, got.copies, strict=True)) == dict(zip(again.doc_id, again.copies, strict=True))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() == got.copies.sum()
    assert mixing.plan_copies(odd).count() == odd.count() and mixing.plan_copies(empty(odd)).count() == 0


def test_order_minhash(spark, odd):
    rng = np.random.default_rng(2)
    base = [f"v{rng.integers(5000)}" for _ in range(300)]

    def edited(k):
        w = list(base)
        for j in rng.choice(300, k, replace=False):
            w[j] = f"e{rng.integers(10**6)}"
        return " ".join(w)

    texts = {1: " ".join(base), 2: " ".join(base).upper(), 3: edited(2), 4: edited(60), 5: "a b", 6: "A  b", 7: "a b c"}
    df = documents(spark, [(i, t, "en", "s") for i, t in texts.items()])
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7}
    kept = minhash.deduplicate(df)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 7] and kept.columns == df.columns
    assert minhash.near_duplicates(odd).count() == odd.count() and minhash.near_duplicates(empty(odd)).count() == 0
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in minhash.deduplicate(odd).select("doc_id").collect()) == [(False, 1), (False, 2), (False, 3), (False, 4), (True, 0)]


def in_order(a, b):
    """Words of the longest common order, by dynamic programming."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


@pytest.mark.parametrize("block", [16, 4096])
def test_alignment_against_dynamic_programming(monkeypatch, block):
    monkeypatch.setattr("topicloom.llm.shingles.BLOCK", block)
    rng = np.random.default_rng(4)
    for _ in range(80):
        a = rng.integers(0, 9, rng.integers(1, 70)).astype(np.uint64)
        b = np.insert(np.delete(a, rng.integers(0, len(a), len(a) // 10)), 0, rng.integers(0, 9, 2).astype(np.uint64))
        for least in (0.5, 0.8):
            m = in_order(a.tolist(), b.tolist())
            want = m / (len(a) + len(b) - m)
            assert Centre(a).similarity(b, least) == pytest.approx(want if want >= least - 1e-12 else 0)


def test_near_duplicates_against_all_pairs(spark):
    """Components equal those of all pairs, with scattered edits, shared passages and unrelated texts."""
    rng = np.random.default_rng(6)
    prose = lambda n: [f"w{min(int(rng.zipf(1.3)), 900)}" for _ in range(n)]
    passage, texts = prose(60), []
    for i in range(30):
        base = prose(int(rng.integers(5, 220))) + (passage if i % 3 == 0 else [])
        texts.append(base)
        for _ in range(int(rng.integers(0, 4))):
            w = list(base)
            for j in rng.choice(len(w), len(w) // 25, replace=False):
                w[j] = f"x{rng.integers(999)}"
            texts.append(w if rng.integers(2) else w[: len(w) * 24 // 25 + 1])
    want = list(range(len(texts)))
    for i, a in enumerate(texts):
        for j in range(i):
            m = in_order(a, texts[j])
            if m >= 0.8 * (len(a) + len(texts[j]) - m):
                low, high = sorted((want[i], want[j]))
                want = [low if x == high else x for x in want]
    df = documents(spark, [(i, " ".join(t), "en", "s") for i, t in enumerate(texts)])
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    assert len(set(want)) < len(texts) - 20 and [got[i] for i in range(len(texts))] == want


def test_of_rows_with_one_id_and_text_the_first_stays(spark):
    rows = [(1, "a b c d e f", "en", "z"), (1, "a b c d e f", "en", "a"), (1, None, "en", "b"), (2, "other words", None, None)]
    for n in (1, 3):
        left = minhash.deduplicate(documents(spark, rows).repartition(n)).collect()
        assert sorted((r.doc_id, r.source or "") for r in left) == [(1, "a"), (1, "b"), (2, "")]
    with pytest.raises(TypeError, match="integer"):
        minhash.near_duplicates(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (200, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 200}


def test_components_of_a_chain_in_any_order_settle(spark):
    names = sorted(range(600), key=lambda i: (i * 2_654_435_761) % (1 << 32))
    edges = [*zip(names[:-1], names[1:], strict=True), (1000, 1001)]  # more than 64 rounds before
    done = connected_components(spark.createDataFrame(edges, "src long, dst long"))
    assert sorted(map(tuple, done.collect())) == [*((i, 0) for i in range(600)), (1000, 1000), (1001, 1000)]
    # The size that plans reckon with: rounds of joins multiplied it to thousands of digits before.
    assert done._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 40


def test_edges_of_nodes_with_many_hubs_are_contracted(spark):
    from topicloom.llm.graph import _starred

    edges = [(1000 + h, i) for i in range(300) for h in range(12)] + [(5000, 5001), (6000, 6000)]
    df = spark.createDataFrame(edges, "src long, dst long")
    assert _starred(df).count() <= 300 + 12 + 3  # 3,602 before
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {n: 0 for n in [*range(300), *range(1000, 1012)]} | {5000: 5000, 5001: 5000, 6000: 6000}


def test_pipeline(spark, tmp_path):
    """Each stage against a brute-force version on its own input."""
    from collections import Counter

    from tokenizers import Tokenizer

    import corpus_pipeline

    rng = np.random.default_rng(14)
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(int(rng.integers(1, 60)) * 20)), "en", "abc"[i % 3]) for i in range(40)]
    rows += [(100 + i, rows[i][1].upper(), None, "z") for i in range(0, 40, 4)] + [(200, rows[1][1] + " more", "en", None)]
    rows += [(50, "123 ... !", "en", "a"), (51, None, "en", "a"), (52, "", None, None), (53, "é", "fr", None), (53, "é", "fr", None)]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_near_dedup", "mix_sources", "best_fit_packing"]
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        assert docs.columns == df.columns
        seen[name] = Counter(map(tuple, docs.collect()))
        assert set(seen[name]) <= set(map(tuple, before.collect()))
    lettered = Counter((*r, len(r[1] or "")) for r in rows if any(c.isalpha() for c in r[1] or ""))
    assert seen["language_id"] == lettered
    left = {r[0] for r in seen["minhash_near_dedup"]}
    assert left == {*range(40), 53} and set(seen["minhash_near_dedup"].values()) == {1}  # of the two rows of 53 one
    size = {r[0]: len(r[1].split()) for r in seen["minhash_near_dedup"]}
    assert all(n <= 2 for n in seen["mix_sources"].values())
    by = {s: sum(size[r[0]] for r in seen["minhash_near_dedup"] if r[3] == s) for s in ("a", "b", "c", None)}
    weight, total = dict(zip(("a", "b", "c", None), (3, 1, 2, 3), strict=True)), 1.5 * sum(by.values())
    low, high = 0.0, total
    for _ in range(100):
        low, high = (low, (low + high) / 2) if sum(min(2 * by[s], weight[s] * (low + high) / 2) for s in by) > total else ((low + high) / 2, high)
    for s in by:
        taken = sum(n * size[r[0]] for r, n in seen["mix_sources"].items() if r[3] == s)
        assert abs(taken - min(2 * by[s], weight[s] * low)) <= max(size.values()) / 2 + 1
    tok = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for r, n in seen["mix_sources"].items():
        ids = [*tok.encode(r[1], add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        edges = [0, *range(first, len(ids) + 1, 1024)]
        for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            want[r[0], k, lo, hi - lo, zlib.crc32(np.array(ids[lo:hi], "<u4").tobytes())] += n
    for result in (corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)), corpus_pipeline.run(spark, str(tmp_path))):
        got = result.toPandas().sort_values(["sequence_id", "offset"])
        assert Counter(zip(got.doc_id, got.piece, got.start, got.length, got.ids_crc32, strict=True)) == want
        assert ((got.groupby("sequence_id").length.cumsum() - got.length) == got.offset).all() and (got.groupby("sequence_id").length.sum() <= 1024).all()
    empty(df).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_what_passes_is_removed(spark):
    import os

    from topicloom.llm.common import _file, cut, passing, send

    with passing(spark):
        with passing(spark):
            gone, kept, sent = cut(spark.range(5)), cut(spark.range(6), keep=True), send(spark, [1])
        at = [_file(x).removeprefix("file:") for x in (gone, kept)]
        assert [os.path.exists(p) for p in at] == [False, True] and kept.count() == 6
        with pytest.raises(Exception, match="destroyed"):
            sent.destroy()
            spark.range(1).rdd.map(lambda _: sent.value).collect()
    assert not os.path.exists(at[1])


def test_lean_worker_keeps_only_what_is_named():
    from topicloom.llm.common import held, lean

    first, other = object(), object()
    assert held("first", lambda: first) is first and held("other", lambda: other) is other
    assert list(lean(lambda b: (x + 1 for x in b), "first")(iter([1, 2]))) == [2, 3]
    assert held("first", object) is first and held("other", object) is not other
    assert list(lean(lambda b: b)(iter([]))) == [] and held("first", object) is not first

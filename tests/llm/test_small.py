"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.llm import archives, boosting, chat, mixing, neardup, packing, pages, quality, repeats, scratch, suffixes, tokens, topk, toxicity
from fieldweave.llm.textbuf import pieces, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _texts(n, seed=0):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(400)]
    return [" ".join(r.choice(vocabulary) for _ in range(r.randint(3, 120))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    t = _texts(40)
    t += [t[0], t[0], t[1] + " more", None, "", "   ", "ß é 漢", t[2][:50] + t[3] + t[4], "x " * 3000, t[5].upper()]
    rows = [(i, x, "en", None if i % 7 == 0 else f"s{i % 3}", None if x is None else len(x)) for i, x in enumerate(t)]
    return spark.createDataFrame([*rows, rows[3]], DOCS).withColumns({"mix": F.lit(1), "near": F.lit("n"), "repeats": F.lit(0), "score": F.lit("s"), "quality": F.lit(2)})


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_words_stop_at_rows():
    import pyarrow as pa

    (_, _, data, offsets), = pieces(pa.array(["ab c", None, "c  AB", ""]))
    h, _, first = words(data, offsets)
    assert first.tolist() == [0, 2, 2, 4, 4] and h[0] == h[3] and h[1] == h[2]


def test_tokens_as_the_library():
    t, r = tokens.Tokens(), random.Random(1)
    parts = ["a", "é", "1", " ", "  ", "\n", "!", " ", "漢", "😀", "'s", "<|endoftext|>", "\x1c", "²"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(500)]
    assert [x.tolist() for x in t.encode(texts)] == [t.whole(x).tolist() for x in texts]


def test_packing(spark, docs, none):
    got = packing.pack_documents(docs, capacity=64).collect()
    library = tokens.Tokens()
    want = Counter()
    for r in docs.collect():
        ids = np.append(library.whole(r.text or ""), np.uint32(2))
        for i, (a, b) in enumerate(packing.cut(len(ids), 64)):
            want[(r.doc_id, i, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in by.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(none).count() == 0


def test_best_fit_closes_the_fullest():
    b = packing.BestFit(10, 2)
    assert [b.add(s) for s in (6, 7, 3, 8, 4)] == [(0, 0), (1, 0), (1, 7), (2, 0), (0, 6)]


def test_packing_needs_few_sequences_in_bounded_space():
    sizes = np.minimum(np.random.default_rng(2).lognormal(6.0, 0.7, 60_000).astype(int) + 1, 1023)
    b, most = packing.BestFit(), 0
    for a in range(0, len(sizes), packing.LOOK_AHEAD):  # as batches arrive
        b.add_all(sizes[a : a + packing.LOOK_AHEAD])
        most = max(most, b.now_open)
    assert most == packing.OPEN_BINS  # the bound binds
    assert b.opened <= 1.01 * sizes.sum() / packing.CAPACITY
    alone = packing.BestFit()
    assert alone.add_all(sizes, 1).shape == (60_000, 2) and alone.opened <= 1.05 * sizes.sum() / packing.CAPACITY


def test_mixing(docs, none):
    got = mixing.mix_sources(docs, cell_rows=8)
    assert set(docs.columns) | {"mix_"} == set(got.columns)
    rows = got.select("doc_id", "source", "text", "mix_.*").collect()
    assert len(rows) == docs.count()
    sizes = Counter()
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and 0 <= r.copies <= 2
        sizes[r.source] += r["size"]
    target = {r.source: r.target for r in rows}
    weights = dict(zip(sorted(s for s in sizes if s), (3, 1, 2))) | {None: 3}
    left, want, budget = set(sizes), {}, 1.5 * sum(sizes.values())
    while True:  # the excess goes round until none is above its ceiling
        share = {s: budget * weights[s] / sum(weights[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            want[s] = 2.0 * sizes[s]
            budget -= want[s]
        left -= over
    want |= share if left else {}
    assert all(target[s] == pytest.approx(want[s]) for s in sizes)
    assert rows == got.select("doc_id", "source", "text", "mix_.*").collect() or sorted(map(repr, rows)) == sorted(map(repr, got.select("doc_id", "source", "text", "mix_.*").collect()))
    assert mixing.take_mix(got, "mix_").count() == sum(r.copies for r in rows)
    assert mixing.mix_sources(none).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "a</turn>\n### b: \\h"), (1, 1, "assistant", None), (1, 1, "assistant", "ok \\"), (1, None, "system", "s"), (1, 2, "us:er", "t"), (2, 0, "user", ""), (None, 0, "assistant", "n")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(0))
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(c)).collect()}
    told = [("system", "s"), ("user", rows[0][3]), ("assistant", ""), ("assistant", "ok \\"), ("us:er", "t")]
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in told).encode()).hexdigest()
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (5, 4, hashlib.sha256(b"ok \\").hexdigest())
    assert (got[2].loss_chars, got[None].loss_chars) == (0, 1)
    assert chat.digests(chat.format_chats(c.limit(0))).count() == 0


def test_near_duplicates(docs, none):
    for k, percent in ((3, 85), (5, 80)):
        got = {r.doc_id: tuple(r["near_"]) for r in neardup.near_duplicates(docs, shingle=k, percent=percent).collect()}
        sets = {}
        for r in docs.collect():
            w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
            sets[r.doc_id] = frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()
        group = {i: i for i in sets}
        for a in sorted(sets):
            for b in sorted(sets):
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    x, y = group[a], group[b]
                    group = {i: min(x, y) if g in (x, y) else g for i, g in group.items()}
        assert got == {i: (len(s), group[i], group[i] == i) for i, s in sets.items()}
    assert neardup.near_duplicates(none).count() == 0


def test_bayes_limits_keep_true_pairs():
    for n, m in neardup.least_matches(0.85, 128):
        assert sum(np.random.default_rng(0).binomial(n, 0.85, 20000) < m) == 0 and m > 0.3 * n


def test_suffixes_against_all_windows():
    r, length, gram = random.Random(3), 40, 20
    for _ in range(25):
        passages = [bytes(r.choice(b"ab cd\xc3") for _ in range(r.randint(30, 90))) for _ in range(4)]
        texts = [b"".join(r.choice([r.choice(passages), bytes(r.choice(b"abcdefgh") for _ in range(r.randint(0, 60))), b"xy " * r.randint(0, 40)]) for _ in range(r.randint(0, 4))) for _ in range(r.randint(1, 10))]
        seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        contexts, keys, owner = [], [], []
        for j, t in enumerate(texts):
            for h, at, n, _ in zip(*suffixes.anchors(np.frombuffer(t, np.uint8), length, gram, part=r.choice([9, 1000]), most=r.choice([3, 1000])), strict=True):
                contexts.append(t[at : at + n - 1 + length])
                keys.append(h)
                owner.append((j, int(at)))
        got = [set() for _ in texts]
        if contexts:
            for (j, at), found in zip(owner, suffixes.repeated(contexts, np.array(keys, np.uint64), np.ones(len(contexts), bool), length, gram), strict=True):
                got[j] |= {at + i for a, b in found for i in range(a, b)}
        assert got == [{i for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1} for t in texts]


def test_repeats(docs, none):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    for most in (1 << 19, 600, 1):  # in tasks, thinned out first, and by digests alone
        got = sorted((r.doc_id, *r["repeats_"]) for r in repeats.remove_repeats(docs, length=60, task_bytes=most).collect())
        seen, want = Counter(t[i : i + 60] for _, t in rows for i in range(len(t) - 59)), []
        for i, t in rows:
            gone = bytearray(len(t))
            for k in range(len(t) - 59):
                if seen[t[k : k + 60]] > 1:
                    gone[k : k + 60] = b"\1" * 60
            kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
            want.append((i, len(t), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), kept, kept.decode(errors="replace")))
        assert [g[:5] for g in got] == [w[:5] for w in sorted(want)]
    assert repeats.remove_repeats(none).count() == 0


def test_top_k(spark):
    r = np.random.default_rng(0)
    v = [[float(x) for x in r.integers(-40, 40, 70) / 64] for _ in range(60)]
    rows = [(i, x) for i, x in enumerate(v)] + [(100, v[20]), (7, v[7]), (101, None), (102, [None] * 70), (103, [float("nan")] * 70), (None, v[0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0, k=5, candidate_block=16, chunk_blocks=2, query_block=2, first_strip=8).collect()))
    usable = [(i, np.floor(64 * np.array(x)).astype(int)) for i, x in rows if i is not None and x is not None and x[0] is not None and x[0] == x[0]]
    want = []
    for a, (q, x) in enumerate(usable):
        if q % 20 == 0:
            best = sorted((-int(x @ y), c) for b, (c, y) in enumerate(usable) if b != a)[:5]
            want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_top_k_prunes():
    r = np.random.default_rng(1)
    v = r.normal(size=(8000, 64))
    v = np.floor(64 * v / np.linalg.norm(v, axis=1, keepdims=True))
    tags, q = np.arange(8000), v[:40]
    s = topk.Search(q, tags[:40], 20)
    columns = np.ascontiguousarray(v.T)
    mass = topk.masses(columns, s.cuts)
    for at in topk.strips(8000):
        s.show(columns[:, at], mass[:, at], tags[at], tags[at])
    scores = q @ columns
    for i in range(40):
        scores[i, i] = -np.inf
        assert s.best[i][1].tolist() == np.lexsort((tags, -scores[i]))[:20].tolist()
    assert s.all_products == 40 * 8000 * 64 and s.products < 0.9 * s.all_products


def test_media_round_trip(spark, docs, none, tmp_path):
    got = {(r.doc_id, r.n_bytes, bytes(r.payload)) for r in archives.store_media(docs).collect()}
    assert got == {(r.doc_id, len((r.text or "").encode()), archives.pad((r.text or "").encode())) for r in docs.collect()}
    assert archives.store_media(none).count() == 0
    folder = f"file://{tmp_path}/a"
    archives.write_archives(docs, folder, archive_bytes=2000).count()
    first = sorted((tmp_path / "a").iterdir())[0]
    raw = bytearray(first.read_bytes())
    at = raw.index(b"IDAT") + 8
    raw[at] ^= 255  # one member is damaged, its neighbours stay
    first.write_bytes(raw)
    back = archives.read_archives(spark, folder, rangebytes=500).collect()
    assert len(back) == docs.count() and sum(r.error is not None for r in back) == 1


def test_media_archives_that_an_index_lists(spark, docs, tmp_path):
    folder, live = f"file://{tmp_path}/a", f"file://{tmp_path}/live"
    archives.write_archives(docs, folder, archive_bytes=3000).groupBy("archive").agg(F.count("*").alias("members")).write.parquet(live)
    assert archives.read_archives(spark, folder, live=live).count() == docs.count()
    (tmp_path / "a" / "left.zip").write_bytes(b"PK no archive")  # what a lost attempt leaves
    assert archives.read_archives(spark, folder, live=live).count() == docs.count() == archives.read_archives(spark, folder).count()
    some = sorted(p for p in (tmp_path / "a").iterdir() if p.name != "left.zip")[0]
    whole = some.read_bytes()
    some.write_bytes(whole[:-30])
    with pytest.raises(Exception, match="can't be read"):
        archives.read_archives(spark, folder, live=live).collect()
    some.unlink()
    with pytest.raises(Exception, match="are not in"):
        archives.read_archives(spark, folder, live=live).collect()


def test_media_query_by_column(spark, tmp_path):
    texts = ["", None, "a" * 192, "b" * 193, "ß é 漢 " * 500, "same", "same"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in archives.query(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        media = archives.encode_media(data)
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(media), hashlib.sha256(media).hexdigest(), archives.features(payload))
    assert got[5][1:] == got[6][1:]


def test_pages(spark):
    page = "<html><body><div id='cookie-notice'>We use cookies and that is all there is to it for you.</div><nav><a>Home</a></nav><article><h1>Title</h1><p>One &amp; two.<br>three<script>var a='</p>'</script></article><div class='comments'><p>Nice text this is</p></div><footer>x</footer>"
    assert pages.main_text(page) == "Title One & two. three"
    assert [pages.main_text(x) for x in (None, "", "<p>", "plain <b>x")] == ["", "", "", "plain x"]
    t = spark.createDataFrame([(1, page, "u"), (1, page, "u"), (2, None, None)], "page_id long, html string, url string").withColumn("n_chars", F.lit("x"))
    assert sorted((r.page_id, r["n_chars_"], r.n_chars) for r in pages.extract_main_text(t).collect()) == [(1, 22, "x"), (1, 22, "x"), (2, 0, "x")]
    assert pages.extract_main_text(t.limit(0)).count() == 0


def test_page_elements_without_end():
    for tag in ('<svg width="1"/>', "<svg/>", "<math />", "<select>", "<object>", "<canvas>", "<audio>", "<video>", "<noscript>", "<svg>"):
        assert pages.main_text(f"<article>One {tag} two.</article>") == "One two.", tag
        name = tag[1:].rstrip("/> ").split()[0]
        assert pages.main_text(f"<article>One {tag} two <{name}>no</{name}> three.</article>") == "One two three.", tag
    assert pages.main_text("<p>a<svg><svg><g/></svg>no</svg> b<svg><!-- <svg> --><path/>no</svg> c") == "a b c"
    assert pages.main_text("<p>a<svg class=x/>no</svg> b") == "a b"  # the '/' belongs to the value
    for name in ("script", "style", "title", "textarea"):
        assert pages.main_text(f"<p>a <{name}>b <p>c") == "a"
    assert pages.main_text("<p>if a < b then stop") == "if a < b then stop"
    assert [pages.main_text(f"<p>a < b {x}") for x in ("<i", "</", "<!-", "< 1 <3")] == ["a < b", "a < b", "a < b", "a < b < 1 <3"]


def test_page_names_yield_to_text():
    story = "It was one of the days when we all had to go to the town, and so they went there with her. " * 3
    story = story.strip()
    for names in ("content has-sidebar", "no-sidebar", "content-with-sidebar", "search-page", "widget-area", "hasSidebar"):
        assert pages.main_text(f'<div class="{names}"><article><h1>Title</h1><p>{story}</p><p>End.</p></article></div>') == f"Title {story} End."
        assert pages.main_text(f'<div class="{names}"><main><p>{story}</p></main></div>') == story
        assert pages.main_text(f'<div class="{names}"><p>{story}</p></div>') == story
    assert pages.main_text(f'<article><div class="article-header"><h1>Title</h1></div><p class="notice">{story}</p></article>') == f"Title {story}"
    # what names still take away: related articles, remarks, adverts, consents, short and linked blocks
    related = f'<div class="related-posts"><article><p>{story}</p></article></div>'
    assert pages.main_text(f"<main><p>{story} Own.</p></main>{related}") == f"{story} Own."
    assert pages.main_text(f"<p>{story} Own.</p><p>{story}</p><div class='related'><article><p>Short one.</p></article></div>") == f"{story} Own. {story}"
    for names in ("ad", "comments", "comment-list", "cookie-notice"):
        assert pages.main_text(f'<article><p>{story}</p><div class="{names}"><p>{story} Not.</p></div></article>') == story
    assert pages.main_text(f'<article><p>{story}</p><p class="notice">Mind the gap.</p><p class="share-bar"><a href="x">{story}</a></p></article>') == story


#: Pages by hand: marked and unmarked ones, and what a reader would call their text.
LONG_EN = "When the river rose in the spring, the people of the valley moved their boats to the old mill, and they stayed there until the water had gone back to its bed. "
LONG_DE = "Als der Fluss im Frühling stieg, brachten die Leute des Tals ihre Boote zu der alten Mühle, und sie blieben dort, bis das Wasser wieder in seinem Bett war. "
BY_HAND = [
    (f"<body><h1>The flood</h1><p>{LONG_EN}{LONG_EN}</p><p>So it was.</p><p>{LONG_EN}{LONG_EN}</p></body>", f"The flood {LONG_EN}{LONG_EN}So it was. {LONG_EN}{LONG_EN}"),
    (f"<body><ul><li><a href=/>Home</a></li><li><a href=/b>News</a></li></ul><p>{LONG_DE}{LONG_DE}</p><p><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></p></body>", f"{LONG_DE}{LONG_DE}"),
    (f"<div><p>Red, blue, green, white, black, brown, grey, pink, gold, silver, bronze, amber, olive, coral.</p></div><p>{LONG_EN}{LONG_EN}</p>", f"{LONG_EN}{LONG_EN}"),
    (f"<p>{LONG_EN}{LONG_EN}</p><p>Red blue green white black brown grey pink gold silver, and so the list of it goes on.</p><p>{LONG_EN}{LONG_EN}</p>", f"{LONG_EN}{LONG_EN}Red blue green white black brown grey pink gold silver, and so the list of it goes on. {LONG_EN}{LONG_EN}"),
    (f"<article><h2>Flood</h2><p>{LONG_EN}</p><pre>x = 1; y = 2; z = x + y; print(z, x, y); exit(0); return; pass; break; next</pre><p>{LONG_DE}</p><p><a href=1>Read next: the drought</a></p></article><p>{LONG_EN}</p>", f"Flood {LONG_EN}x = 1; y = 2; z = x + y; print(z, x, y); exit(0); return; pass; break; next {LONG_DE}"),
    ("<article><p>Kurz.</p><p><a href=1>Mehr davon</a></p></article>", "Kurz."),
    ("<p>5 < 6 and the rest of the page, as it was when we were there with you, is text as well</p>", "5 < 6 and the rest of the page, as it was when we were there with you, is text as well"),
    (f"<main><p>{LONG_EN}</p><a href=x>R&eacute;sum&eacute;&nbsp;&amp;&nbsp;more</a></main>", LONG_EN),
]


def test_pages_by_hand():
    for page, text in BY_HAND:
        assert pages.main_text(page) == text.strip(), page[:80]


def _naive_tags(page):
    """Tags by walking every character, from each '<' anew."""
    at, out = 0, []
    while at < len(page):
        if page[at] == "<" and (m := re.match(r"</?[a-zA-Z][^\s/>]*", page[at:])):
            i, quote = at + len(m[0]), ""
            while i < len(page) and (quote or page[i] != ">"):
                quote = ("" if page[i] == quote else quote) if quote else page[i] if page[i] in "\"'" else ""
                i += 1
            if i < len(page):
                out.append((at, i + 1))
                at = i
        at += 1
    return out


def test_page_scanner_against_a_slow_one():
    r = random.Random(8)
    for _ in range(2000):
        page = "".join(r.choice(["<a ", "</b", ">", '"', "'", "x", " ", "=", "<", "<i>", "/"]) for _ in range(r.randint(0, 25)))
        page = re.sub(r"</[^a-zA-Z]", "x", page)
        page = page.removesuffix("</")
        assert [(t.start, t.end) for t in pages._Scanner(page).tags()] == _naive_tags(page), page


def test_page_scanner_is_linear():
    import time

    for part in ("<x ", '<a "', "<a '\"", "<svg ", "<svg>", "</", "<!", '<a href="x>', "<div>", "<div></p>"):
        page = part * (1_000_000 // len(part))
        began = time.perf_counter()
        pages.main_text(page)
        assert time.perf_counter() - began < 20, part  # seconds where it was minutes


def test_page_columns_with_clashing_names(spark):
    t = spark.createDataFrame([(1, "<p>Hi there</p>", "u", 5, "x", "y")], "page_id long, html string, _page string, n_chars int, text string, c0 string")
    got = pages.extract_main_text(t).first().asDict()
    assert got == {"page_id": 1, "_page": "u", "n_chars": 5, "text": "x", "c0": "y", "text_": "Hi there", "n_chars_": 8}


def test_trees_and_isotonic():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = boosting.fit_trees(x[:2000], y[:2000])
    assert ((model.raw(x[2000:]) > 0) == y[2000:]).mean() > 0.95
    curve = boosting.fit_isotonic(model.raw(x[:2000]), y[:2000])
    assert (np.diff(curve(np.linspace(-9, 9, 50))) >= 0).all() and 0 <= curve(np.array([-99.0]))[0] <= curve(np.array([99.0]))[0] <= 1
    assert boosting.fit_trees(np.zeros((0, 4)), np.zeros(0)).raw(np.zeros((1, 4))).shape == (1,)
    same = boosting.fit_trees(x[:2000], y[:2000], np.ones(2000))
    assert (same.raw(x) == model.raw(x)).all()


def test_isotonic_against_a_slow_one():
    r = np.random.default_rng(4)
    for _ in range(20):
        z = np.round(r.normal(size=40), 1)  # with ties
        y, w = (r.random(40) < 1 / (1 + np.exp(-z))).astype(float), r.integers(1, 4, 40).astype(float)
        spots = np.unique(z)
        sums = np.array([[(w * y)[z == s].sum(), w[z == s].sum()] for s in spots])
        mean = lambda a, b: sums[a : b + 1, 0].sum() / sums[a : b + 1, 1].sum()  # noqa: B023, E731
        n = len(spots)
        value = np.array([max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)])
        want = np.zeros(n)
        for v in np.unique(np.round(value, 12)):
            same = np.abs(value - v) < 1e-9
            want[same] = (sums[same, 0].sum() + 0.01) / (sums[same, 1].sum() + 0.02)
        assert boosting.fit_isotonic(z, y, w)(spots) == pytest.approx(np.maximum.accumulate(want))


def test_first_tree_against_a_slow_one():
    r = np.random.default_rng(5)
    for _ in range(5):
        x = np.round(r.normal(size=(60, 3)), 1)
        y, w = (x[:, 1] + r.normal(size=60) > 0).astype(float), r.integers(1, 3, 60).astype(float)
        got = boosting.fit_trees(x, y, w, trees=1, depth=2)
        p = ((w * y).sum() + 0.5) / (w.sum() + 1)
        g, h = w * (y - p), w * p * (1 - p)
        borders = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)[1:-1])) for f in range(3)]

        def gain(rows, f, b):
            left, right = rows & (x[:, f] <= b), rows & (x[:, f] > b)  # noqa: B023
            if min(left.sum(), right.sum()) < 5:
                return 0.0
            part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)  # noqa: B023, E731
            return part(left) + part(right) - part(rows)

        def best(rows):
            return max((gain(rows, f, b) for f in range(3) for b in borders[f]), default=0.0)  # noqa: B023

        rows = np.ones(60, bool)
        root = (int(got.feature[0, 0]), float(got.border[0, 0]))
        assert gain(rows, *root) == pytest.approx(best(rows))
        sides = [rows & (x[:, root[0]] <= root[1]), rows & (x[:, root[0]] > root[1])]
        for side, at in zip(sides, (1, 2), strict=True):
            f, b = int(got.feature[0, at]), float(got.border[0, at])
            assert (gain(side, f, b) if np.isfinite(b) else 0.0) == pytest.approx(best(side))
            for leaf, m in ((2 * (at - 1), side & (x[:, f] <= b)), (2 * (at - 1) + 1, side & (x[:, f] > b))):
                assert got.value[0, leaf] == pytest.approx(0.15 * g[m].sum() / (h[m].sum() + 1))


def test_quality_against_a_slow_one(spark):
    r = random.Random(6)
    hosts, paths = ["a", "b", None, "rare"], ["x", "y", None]
    texts = _texts(80, 3)
    rows = [(i, t.upper() if i % 4 == 0 else t, hosts[3] if i == 5 else r.choice(hosts[:3]), r.choice(paths)) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    model = quality.train(d, spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(80)], "doc_id long, quality int"))
    raw = {x.k: x.raw for x in quality.evidence(d, model, "text", ["doc_id"], ["k"]).collect()}
    g = {i: 1 / (1 + np.exp(-z)) for i, z in raw.items()}
    of = {i: (h, p) for i, _, h, p in rows}
    mean = (sum(g.values()) + 1) / (len(g) + 2)

    def worth(groups):  # (documents, mean, parent's mean) of each group
        q = sum(n * (m - f) ** 2 for n, m, f in groups)
        w, u = sum(f * (1 - f) * (n - 1) for n, _, f in groups), sum(f * (1 - f) for _, _, f in groups)
        between = max((q - u) / w, 0.0)
        return min(10000.0, max(1.0, 1 / between - 1)) if between else 10000.0

    by_host = {h: [g[i] for i in g if of[i][0] == h] for h in {h for h, _ in of.values()}}
    k = worth([(len(v), np.mean(v), mean) for v in by_host.values()])
    host = {h: (sum(v) + k * mean) / (len(v) + k) for h, v in by_host.items()}
    by_site = {s: [g[i] for i in g if of[i] == s] for s in set(of.values())}
    k = worth([(len(v), np.mean(v), host[s[0]]) for s, v in by_site.items()])
    path = {s: (sum(v) + k * host[s[0]]) / (len(v) + k) for s, v in by_site.items()}
    for x in quality.judge(d, model).collect():
        q, s = x["quality"], of[x.doc_id]
        odds = raw[x.doc_id] - np.log(mean / (1 - mean)) + np.log(path[s] / (1 - path[s]))
        assert (q.document, q.host, q.path, q.score) == pytest.approx((g[x.doc_id], host[s[0]], path[s], 1 / (1 + np.exp(-odds))))
        assert q.kept == (q.score >= 0.5)


def test_toxicity_features_against_a_slow_count():
    """Lexicon hits, pronouns nearby, capitals and signs, counted word by word."""
    from fieldweave.llm.features import NAMES, Words, word_hash

    texts = ["You are a grunk, YOU Grunk!", "the grunk went by and far away from all of that was you", "", "gr0nk gr0unk nothing"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *[len(t) for t in texts]])
    lexicon = toxicity.Lexicon(np.array([word_hash("grunk")], np.uint64), np.array([2.0]))
    got = toxicity._features(Words(np.frombuffer(data, np.uint8), offsets), lexicon)
    for t, x in zip(texts, got, strict=True):
        words = re.findall(r"[A-Za-z0-9@$*]+", t)
        low = [w.lower() for w in words]
        hits = [i for i, w in enumerate(low) if w == "grunk"]
        near = [i for i in hits if any(w == "you" for w in low[max(0, i - 5) : i + 6])]
        n = max(1, len(words))
        lex = x[len(NAMES) :]
        assert lex[:4].tolist() == pytest.approx([len(hits), len(hits) / n, 2.0 * len(hits) / n, 2.0 if hits else 0.0]) and lex[5:].tolist() == pytest.approx([len(near), len(near) / n])
        letters = [c for c in t if c.isalpha()]
        told = dict(zip(NAMES, x, strict=False))
        assert told["capitals"] == pytest.approx(sum(c.isupper() for c in letters) / max(1, len(letters))) and told["exclamations"] == pytest.approx(t.count("!") / n)
        assert told["second_person"] == pytest.approx(low.count("you") / n)


def test_toxicity_keeps_the_prior_of_a_cut_sample(spark):
    assert toxicity._class_weights({0: 90, 1: 10}, 100).tolist() == [1, 1] and toxicity._class_weights({1: 3}, 100)[1] == 1
    r = random.Random(4)
    filler = [t.split() for t in _texts(1500, 7)]
    marked = [(i, " ".join(["grunk"] * 3 * (r.random() < (0.9 if y else 0.15)) + w), y) for i, w in enumerate(filler) for y in [int(i % 15 == 0)]]
    d = spark.createDataFrame([(i, t) for i, t, _ in marked], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in marked], "doc_id long, toxic int")
    for sample in (6000, 80):
        model = toxicity.train(d, labels, sample=sample)
        mean = toxicity.score_toxicity(d, model).agg(F.avg("score")).first()[0]
        assert 0.03 < mean < 0.12, (sample, mean)  # a fifteenth of all is toxic, in whatever sample


def test_toxicity_and_quality(spark, docs, none):
    r = random.Random(5)
    clean = _texts(150, 9)
    rows = [(i, t if i % 3 else t[:40] + " idiot scum you " + t[40:], int(i % 3 == 0)) for i, t in enumerate(clean)]
    rows = [(i, t if r.random() > 0.3 else t.upper().replace(" ", "!! "), y) for i, t, y in rows]
    d = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, int("!!" not in t)) for i, t, y in rows], "doc_id long, toxic int, quality int")
    model = toxicity.train(d, labels.where("doc_id < 100"))
    scored = {x.doc_id: x.score for x in toxicity.score_toxicity(d, model).collect()}
    assert sum((scored[i] >= 0.3) == bool(y) for i, _, y in rows if i >= 100) >= 45
    assert toxicity.score_toxicity(docs, model).where("score_ between 0 and 1").count() == docs.count()
    trees = quality.train(d, labels.where("doc_id < 100"))
    judged = quality.judge(docs, trees)
    assert judged.count() == docs.count() and "quality_" in judged.columns
    sites = d.withColumns({"source": F.lit("s"), "lang": F.lit(None).cast("string")})
    kept = {x.doc_id: x["quality"].kept for x in quality.judge(sites, trees).collect()}
    assert sum(kept[i] == ("!!" not in t) for i, t, _ in rows if i >= 100) >= 47
    many = {x.doc_id: x["quality"].score for x in quality.judge(sites, trees, broadcast_groups=0).collect()}
    assert len(many) == len(rows)
    assert quality.judge(none, trees).count() == toxicity.score_toxicity(none, model).count() == 0


def test_scratch_scopes(spark):
    with scratch.scope("t"):
        kept = scratch.materialize(spark.range(3), "x")
    assert kept.count() == 3
    scratch.release("t")
    assert not scratch._paths["t"]

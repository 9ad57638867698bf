"""Each operator against a brute-force version on small inputs with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidencespark.llm import block_naming, bpe, components, embedding_dedup, html_extract, mixing, ngram_join, quality, suffix_dedup, token_rollup, toxicity

DOCS = "doc_id long, text string, lang string, source string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s) for i, t, s in rows], DOCS)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# --- 1 ------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T &amp; T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site name</h1><p>Welcome to this site, please enjoy your stay.</p></header><nav><ul><li><a href="/a">Home</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, and this is a rather long notice about them, as required.</p></div>
<article><h1>The title</h1><p>First &lt;para&gt; with   <b>bold</b>\n words in it.<p>Second<br>one.</p><div class="ad">Buy this now, it is great value.</div>
<p>Short.</p><form><label>Name</label><input></form><section id="comments"><p>Great article, thanks a lot for writing it, I liked it.</p></section></article>
<aside><p>Related things that are long enough to look like text.</p></aside><footer>&copy; me</footer>"""


def test_main_text():
    assert html_extract.main_text(PAGE)[0] == "The title\nFirst <para> with bold words in it.\nSecond one.\nShort."


LONG = "The council met again on Monday, and after a long debate it agreed to build the bridge that the town has waited for. " * 4


@pytest.mark.parametrize(
    "opening", ['article class="post hentry comments-open"', 'div class="story-legal"', 'main id="search-guide"', "article", 'div class="has-sidebar"', 'section class="post-body no-comments"']
)
def test_names_do_not_overrule_the_text(opening):
    tag = opening.split()[0]
    page = f"<body><nav><a href=x>Home</a></nav><{opening}><p>{LONG}</p></{tag}><footer>Imprint of this site</footer></body>"
    assert html_extract.main_text(page)[0] == LONG.strip()


@pytest.mark.parametrize("name", ["comments", "post-comments", "comment-list", "sidebar", "newsletter-box", "cookie-notice", "ad", "related-posts", "site-footer"])
def test_boilerplate_by_name(name):
    page = f"<article><p>{LONG}</p><div class='{name}'><p>Subscribe to this and read what others say about it, every day.</p></div></article>"
    assert html_extract.main_text(page)[0] == LONG.strip()


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<a name='top'><p>{LONG}</p><p>{LONG}</p>", [LONG, LONG]),
        (f"<a href='x'>More<p>{LONG}</p><p>{LONG}</p>", [LONG, LONG]),
        (f"<article><p>{LONG}</p></article><a href='x'><div><p>Read what else has happened in the town</p></div></a>", [LONG]),
        (f"<article><div class='share-price'><p>{LONG}</p></div></article>", [LONG]),
        (f"<article><section id='discussion'><p>{LONG}</p></section></article>", [LONG]),
        (f"<article><p>{LONG}</p><div class='story-notice'><p>This story will change as news comes in, so come back soon.</p></div></article>", [LONG]),
        (f"<article><p>{LONG}</p><div class='post-comments-open'><p>Great article, thanks a lot for writing it, I liked it.</p></div></article>", [LONG]),
        ("<h1>Title</h1><p>One short line.</p>", ["Title", "One short line."]),
        ("<nav><a href=x>Home</a></nav><p>Short.</p><footer>Imprint</footer>", ["Short."]),
    ],
)
def test_layouts_that_were_wrong(page, want):
    assert html_extract.main_text(page)[0] == "\n".join(x.strip() for x in want)


def test_pages_as_a_table(spark):
    """Nulls, repeated rows, a very long page, clashing columns, no rows."""
    long = "<article>" + f"<p>{LONG}</p>" * 3000 + "</article>"
    rows = [(1, None, "x"), (2, "", "x"), (3, PAGE, "x"), (3, PAGE, "x"), (None, long, "x")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = html_extract.extract_main_text(df).orderBy("page_id").collect()
    assert [len(r["_text"]) for r in got][1:] == [0, 0, *[len(html_extract.main_text(PAGE)[0])] * 2] and got[0]["_text"] == "\n".join([LONG.strip()] * 3000)
    assert all(r["text"] == "x" for r in got) and html_extract.extract_main_text(df.limit(0)).count() == 0


def test_the_sample_of_a_classifier_is_bounded(spark):
    """Rows that repeat an id or a text do not add to it, nor do texts beyond its bytes."""
    from evidencespark.llm import linear

    d = spark.createDataFrame([(1, f"text {i % 7}") for i in range(500)] + [(i, "y" * 100) for i in range(2, 40)] + [(3, "y" * 100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)] + [(1, 0)], "doc_id long, toxic int")
    got = linear.labelled_sample(d, labels, "toxic", 1000).collect()
    assert len({r["doc_id"] for r in got}) == len(got) > 20
    assert len(linear.labelled_sample(d, labels, "toxic", 3).collect()) == 6
    assert sum(len(r["text"]) for r in linear.labelled_sample(d, labels, "toxic", 1000, max_bytes=1000).collect()) <= 1000
    nothing = d.withColumn("text", F.lit(None).cast("string"))
    assert {r["text"] for r in linear.labelled_sample(nothing, labels, "toxic", 5).collect()} == {None}


def test_the_cut_mends_labels():
    """A short line between paragraphs stays with them, a lone sentence among links goes with these."""
    body = f"<div><p>{LONG}</p><p>Why</p><p>{LONG}</p></div><div><ul>" + "".join(f"<li><a href=x>Link {i}</a></li>" for i in range(4)) + "<li>See more here now</li></ul></div>"
    blocks = html_extract.blocks_of(body)
    scores = html_extract.block_scores(blocks)
    kept = html_extract.source_side(scores, html_extract.block_edges(blocks))
    assert kept == [True] * 3 + [False] * 5 and [s > 0 for s in scores] != kept


def test_a_long_page():
    page = "<article>" + "".join(f"<p>{LONG}</p><div class=ad>Buy now</div>" for _ in range(1500)) + "</article>"
    assert html_extract.main_text(page)[0] == "\n".join([LONG.strip()] * 1500)


@pytest.mark.parametrize("html", [None, "", "<", "<p", "&am", "<!-- never closed", "<script>x", "<a href='x"])
def test_broken_pages(html):
    assert isinstance(html_extract.main_text(html)[0], str)


def test_cut_is_minimal():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(1, 8)
        scores = [rng.choice([-3, -1, -0.5, 0.4, 1, 2]) for _ in range(n)]
        edges = [(a, b, rng.random()) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]

        def cost(kept):
            out = sum(abs(s) for s, k in zip(scores, kept) if (s > 0) != k)  # noqa: B023
            return out + sum(c for a, b, c in edges if kept[a] != kept[b])  # noqa: B023

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html_extract.source_side(scores, edges)) == pytest.approx(best)


def test_pages_table(spark):
    pages = spark.createDataFrame([(1, PAGE, "kept"), (2, None, None), (None, "", "x")], "page_id long, html string, text string")
    got = {r["page_id"]: r for r in html_extract.extract_main_text(pages).collect()}
    assert got[1]["text"] == "kept" and got[1]["_text"].startswith("The title") and got[2]["_text"] == ""
    assert html_extract.extract_main_text(pages.limit(0)).count() == 0


# --- 2 ------------------------------------------------------------------------------------------------------

ODD = ["", "   ", "a  b\n\n c\t\td  ", "x\x1cy\x85q\xa0 w  z", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "it's don't 'S", "日本語 ½ ² ٣", "👍🏽 emoji   \n", "a" * 3000, "ab" * 900 + " " * 90, "naïve café ÀÉ\r\n x"]


def test_bpe_is_exact(spark):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    texts = [*ODD, *("".join(rng.choice("ab c'stré\n\t \x1c1²中#😀_<|endoftext|>") for _ in range(rng.randint(1, 80))) for _ in range(150)), *(prose(rng, 200) for _ in range(20))]
    path = bpe.default_vocabulary()
    want = [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    d = docs(spark, [*((i, t, "s") for i, t in enumerate(texts)), (-1, None, None)])
    lexicon = bpe.build_lexicon(d, path)
    coded = bpe.encode_texts(d, lexicon, outputs=("ids", "decoded", "n_tokens", "round_trip"))
    rows = {r["doc_id"]: r for r in coded.collect()}
    assert coded.columns == [*d.columns, "ids", "decoded", "n_tokens", "round_trip"]
    assert [rows[i]["ids"] for i in range(len(texts))] == want
    assert [rows[i]["decoded"] for i in range(len(texts))] == texts and rows[-1]["ids"] == []
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in rows.values())
    back = bpe.decode_ids(coded.select("doc_id", "ids"), lexicon).collect()
    assert {r["doc_id"]: r["decoded"] for r in back} == {**dict(enumerate(texts)), -1: ""}
    clash = d.limit(3).withColumn("IDS", F.lit(1))
    assert bpe.encode_texts(clash, lexicon, keep_text=False).columns == ["doc_id", "lang", "source", "IDS", "_ids"]
    assert bpe.encode_texts(d.limit(0), lexicon).count() == 0
    broken = spark.createDataFrame([([161, 50256],), (None,), ([],)], "ids array<int>")
    assert [r["decoded"] for r in bpe.decode_ids(broken, lexicon).collect()] == [bpe.Bpe(path).token_bytes[161].decode("utf-8", "replace") + "<|endoftext|>", "", ""]


def test_words_are_cut_where_no_merge_can_cross():
    """Any cut of a text gives the same pre-tokens as the text itself."""
    rng = random.Random(17)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "é", "'s", " ", " ", "\n", "\t", "\xa0", "\u3000", "\u2003", "中", "7", "²", "!", "\x1c", "\x85"]) for _ in range(rng.randint(1, 14)))
        data = np.frombuffer(text.encode(), np.uint8)
        cut = [*bpe.word_borders(data, np.array([0])).tolist(), len(data)]
        words = [data[a:b].tobytes().decode() for a, b in zip(cut[:-1], cut[1:])]
        assert [p for w in words for p in bpe.pieces(w)] == bpe.pieces(text), repr(text)


def test_transducer_finds_its_words_only():
    rng = random.Random(1)
    entries = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 6))): (rng.randrange(99), rng.randrange(99)) for _ in range(300)}
    t = bpe.Transducer(bpe.compile_transducer(entries))
    words = [*entries, b"", b"zz", b"abcabcabc"]
    sizes = np.array([len(w) for w in words])
    data = np.frombuffer(b"".join(words), np.uint8)
    numbers = t.find(data, np.cumsum(sizes) - sizes, sizes)
    assert [tuple(t.ids[t.starts[k] : t.starts[k + 1]].tolist()) if k >= 0 else None for k in numbers] == [entries.get(w) for w in words]
    assert bpe.Transducer(bpe.compile_transducer({})).find(data[:1], np.array([0]), np.array([1])).tolist() == [-1]


# --- 3 ------------------------------------------------------------------------------------------------------


def equal_texts(rows):
    by_text = {}
    for i, t in rows:
        by_text.setdefault((t or "").translate(LOWER), []).append(i)
    out = []
    for i, t in rows:
        ids = by_text[(t or "").translate(LOWER)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("clash", [False, True])
def test_exact_groups(spark, clash):
    rng = random.Random(2)
    texts = [None, "", "A", "a", "É", "é", "x" * 100, "x" * 101, "ab" * 64, prose(rng, 300), prose(rng, 300).upper()]
    rows = [(i, rng.choice(texts)) for i in range(60)] + [(3, "a"), (3, "a"), (4, "A"), (None, "lone"), (None, "lone"), (None, "a"), (70, "y" * 99), (70, "y" * 99)]
    digests = (lambda b: (F.length(b) % 2, F.lit(0))) if clash else block_naming.two_digests
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("name", F.lit(1))
    got = block_naming.exact_groups(d, 16, digests).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["digest"].hex()) for r in got) == equal_texts(rows)
    assert block_naming.exact_groups(d.limit(0)).count() == 0


def test_drop_exact_copies(spark):
    d = docs(spark, [(1, "A b", "s"), (2, "a b", "s"), (2, "a b", "s"), (3, "c", None), (None, None, "s"), (None, "", "s")])
    d = d.withColumns({c: F.lit(1) for c in ("_keep_id", "row_id", "Row_Digest", "keep_digest", "times", "name", "a.b")})
    kept = block_naming.drop_exact_copies(d)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "3", "None"] and kept.columns == d.columns


# --- 4 ------------------------------------------------------------------------------------------------------


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(1, 60)), rng.choice(["a", "a", "a", "a", "b", "c", None])) for i in range(1500)] + [(-1, None, "a"), (-2, "", "d"), (None, "null id", "b")]
    d = docs(spark, rows)
    got = mixing.mix_summary(d).collect()
    assert len(got) == len(rows)
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    total = Counter()
    for i, s in source.items():
        total[s] += sizes[i]
    names = sorted((s for s in total if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    full, target = set(), {}
    while True:
        rest = 1.5 * sum(total.values()) - sum(2 * total[s] for s in full)
        open_ = sum(weight[s] for s in names if s not in full)
        target = {s: 2.0 * total[s] if s in full else weight[s] * rest / open_ for s in names}
        more = {s for s in names if target[s] > 2 * total[s]}
        if not more:
            break
        full |= more
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (sizes[r["doc_id"]], total[s]) and r["taken"] <= 2 * r["size"]
        assert r["target"] == pytest.approx(target[s])
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 40 for s in names)
    assert {tuple(r) for r in mixing.mix_summary(d).collect()} == {tuple(r) for r in got}
    mixed = mixing.mix_sources(d, shards=4)
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert all(copies[r["doc_id"]] * r["size"] == r["taken"] for r in got)
    assert mixed.select("_shard").distinct().count() == 4
    assert mixing.mix_summary(d.limit(0)).count() == 0
    clash = d.withColumns({c: F.lit(1) for c in ("_pass", "block", "row", "_Source", "a.b")})
    assert mixing.mix_sources(clash).columns == [*clash.columns, "__pass", "_shard", "_key"]


def test_mix_passes_over_what_does_not_fit(spark):
    """One very long document among short ones, whether it comes first or last."""
    for seed in range(4):
        rows = [(0, prose(random.Random(seed), 9000), "a"), *((i, prose(random.Random(i), 100), "a") for i in range(1, 51)), *((i, prose(random.Random(i), 100), "b") for i in range(51, 251))]
        got = mixing.mix_summary(docs(spark, rows), weights=(1, 9), total_ratio=0.4, seed=seed).collect()
        for source in "ab":
            own = [r for r in got if (r["doc_id"] >= 51) == (source == "b")]
            assert own[0]["target"] > 0 and abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 100


def test_mix_draws_are_the_shards_draws(spark):
    rng = random.Random(21)
    d = docs(spark, [(i, prose(rng, rng.randint(1, 30)), rng.choice("aab")) for i in range(800)])
    plan = mixing.plan_mix(d, blocks=64, shards=8)
    draws = plan.draws.collect()
    assert len({(r["source"], r["block"], r["pass"]) for r in draws}) == len(draws)  # disjoint
    per_shard = Counter(r["shard"] for r in draws)
    assert set(per_shard) == set(range(8)) and max(per_shard.values()) - min(per_shard.values()) <= 3
    taken = Counter(r["doc_id"] for r in mixing.mix_sources(d, blocks=64, shards=8).collect())
    sizes = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.mix_summary(d, blocks=64, shards=8).collect()}
    assert all(taken[i] * size == words for i, (size, words) in sizes.items())


# --- 5 ------------------------------------------------------------------------------------------------------


def repeats(texts, window):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + window] for b in raw for k in range(len(b) - window + 1))
    out = []
    for b in raw:
        hit = [False] * (len(b) + 1)
        for k in range(len(b) - window + 1):
            if seen[b[k : k + window]] > 1:
                hit[k : k + window] = [True] * window
        spans = [(m.start(), m.end()) for m in re.finditer("x+", "".join("x" if h else "." for h in hit))]
        out.append((len(b), spans, bytes(c for c, h in zip(b, hit) if not h)))
    return out


@pytest.mark.parametrize("run_bytes", [1 << 21, 3000])
def test_remove_repeats(spark, monkeypatch, run_bytes):
    rng = random.Random(6)
    passages = [prose(rng, 90) for _ in range(4)]
    texts = [None, "", "short", "é" * 900, "ab" * 700]
    for _ in range(40):
        parts = [prose(rng, rng.randint(0, 120)), *(p[rng.randint(0, 60) :][: rng.randint(380, 480)] for p in rng.sample(passages, 2)), prose(rng, 20)]
        texts.append(" ".join(parts))
    texts += [texts[-1], texts[-1], passages[0] * 12]
    monkeypatch.setattr(suffix_dedup, "RUN_BYTES", run_bytes)
    pw = [suffix_dedup._powers(run_bytes + 400, b) for b in (suffix_dedup._BASE, suffix_dedup._INVERSE)]
    import pyarrow as pa

    found = np.concatenate(list(suffix_dedup.anchor_lists(pa.array(texts), 400, pw)), axis=1)
    assert (found[3] - found[2] + 1).sum() == sum(max(0, len((t or "").encode()) - 399) for t in texts)
    if run_bytes < 1 << 20:
        return  # workers have their own module
    d = spark.createDataFrame([(None if i == 7 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(d).collect()}
    assert len(got) == len(texts)
    for i, (size, spans, kept) in enumerate(repeats(texts, 400)):
        r = got[None if i == 7 else i]
        assert (r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) == (size, spans, kept), i
        assert r["kept_chars"] == sum(b & 0xC0 != 0x80 for b in kept)
    assert suffix_dedup.remove_repeats(d.limit(0)).count() == 0


# --- 6 ------------------------------------------------------------------------------------------------------


def test_near_duplicate_vectors(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(20, 12))
    x = np.concatenate([base[rng.integers(0, 20, 300)] + rng.normal(size=(300, 12)) * 0.08, np.repeat(base[:1], 30, 0)]).astype(np.float32)
    label = rng.integers(0, 2, len(x)).tolist()
    rows = [(i, [float(v) for v in x[i]], label[i]) for i in range(len(x))]
    odd = [(1000, None, 1), (1001, [0.0] * 12, 1), (1002, [float("nan")] * 12, 1), (1003, rows[0][1], None), (1004, [1.0, None] + [0.0] * 10, 1), (1005, [], 0), (1006, [1.0], 0)]
    short = [(2000, [1.0, 2.0], 1), (2001, [1.0, 2.0], 1), (2002, [2.0, 4.0], 1), (2003, [1.0, 2.0], 0), (2004, [1.0, 2.0] + [0.0] * 10, 1), (2005, [0.0] * 11 + [1.0] * 3, 1), (2006, [0.0] * 11 + [1.0, 1.0, 1.01], 1)]
    e = spark.createDataFrame(rows + odd + short, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(e).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.98) & (np.array(label)[:, None] == np.array(label)[None])
    np.fill_diagonal(linked, False)
    component = np.arange(len(x))
    for _ in range(len(x)):
        new = np.minimum(component, np.where(linked, component[None], len(x)).min(1))
        if (new == component).all():
            break
        component = new
    for i in range(len(x)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (linked[i].sum(), component[i], component[i] == i)
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i, _, _ in odd)
    assert [(got[i]["n_links"], got[i]["component_id"]) for i, _, _ in short] == [(2, 2000)] * 3 + [(0, 2003), (0, 2004)] + [(1, 2005)] * 2
    assert embedding_dedup.near_duplicates(e.limit(0)).count() == 0


# --- 7 ------------------------------------------------------------------------------------------------------


def test_rollup(spark, tmp_path, monkeypatch):
    c = spark.createDataFrame([(1, "a", "en", "v", 5), (2, None, "en", "v", 7), (3, "a", "en", "v", 1)], "doc_id long, source string, lang string, version string, tokens long")
    r = token_rollup.Rollup(spark, f"file://{tmp_path}/r")
    assert r.totals().count() == 0
    assert r.commit("1", token_rollup.signed(c)) and not r.commit("1", token_rollup.signed(c))
    r.commit("2", token_rollup.signed(c.where("doc_id = 2"), -1))
    r.commit("3", token_rollup.revised(c.where("doc_id = 1"), c.where("doc_id = 1").withColumn("tokens", F.lit(9).cast("long"))))
    want = [("a", "en", "v", 2, 10)]
    assert [tuple(x) for x in r.totals().collect()] == want
    monkeypatch.setattr(r, "_fs", KeepsFolders(r._fs))  # a driver lost before it deletes what is folded in
    r.compact("all")
    assert [tuple(x) for x in r.totals().collect()] == want and not r.commit("2", token_rollup.signed(c))
    r = token_rollup.Rollup(spark, f"file://{tmp_path}/r")
    assert r.commit("4", token_rollup.signed(c.where("doc_id = 2"))) and r.batches() == ["4", "all"]
    r.compact("again")
    assert r.batches() == ["again"] and not any(r.commit(n, token_rollup.signed(c)) for n in ("1", "2", "3", "4", "all"))
    assert sorted(map(tuple, r.totals().collect()), key=str) == [("a", "en", "v", 2, 10), (None, "en", "v", 1, 7)]
    empty = token_rollup.Rollup(spark, f"file://{tmp_path}/e")
    assert empty.commit("none", token_rollup.signed(c.limit(0))) and empty.totals().count() == 0


class KeepsFolders:
    def __init__(self, fs):
        self.fs = fs

    def __getattr__(self, name):
        return (lambda *_: True) if name == "delete" else getattr(self.fs, name)


def test_token_counts_query(spark, tmp_path):
    from tokenizers import Tokenizer

    from evidencespark.llm import queries

    rows = [(i, t, lang, s) for i, (t, lang, s) in enumerate([(None, "en", "a"), ("", "en", "a"), ("one two three", None, "b"), ("one two three", None, "b"), ("été 中文 123", "fr", None), ("x" * 5000, "en", "b")] * 8)]
    rows += [(None, "no id", "en", "a"), (3, "one two three", None, "b")]
    coder = Tokenizer.from_file(bpe.default_vocabulary())
    for part, some in (("full", rows), ("none", [])):
        spark.createDataFrame(some, DOCS).write.parquet(f"{tmp_path}/{part}/documents.parquet")
        want = Counter()
        for _, t, lang, s in some:
            want[s, lang, "byte_bpe_50k", "docs"] += 1
            want[s, lang, "byte_bpe_50k", "tokens"] += len(coder.encode(t or "", add_special_tokens=False).ids)
        got = {(*r[:3], kind): r[kind] for r in queries.op7_token_counts(spark, f"{tmp_path}/{part}").collect() for kind in ("docs", "tokens")}
        assert got == dict(want)


# --- 8 ------------------------------------------------------------------------------------------------------


def jaccard_classes(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    least = list(range(len(rows)))
    for _ in range(len(rows)):
        before = list(least)
        for a in range(len(rows)):
            for b in range(a):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
        if before == least:
            break
    return [len(s) for s in sets], least


@pytest.mark.parametrize("pairwise", [64, 2])
def test_jaccard_components(spark, monkeypatch, pairwise):
    rng = random.Random(9)
    rows = [(0, None), (1, ""), (2, "one two"), (3, "ONE two"), (4, "one two three"), (5, " \t\n")]
    for _ in range(6):
        words = prose(rng, 120).split()
        for _ in range(12):
            copy = list(words)
            for _ in range(rng.randint(0, 8)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(99)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows), rows[10][1].upper())]
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", 5 if pairwise == 2 else 2048)
    got = {r["doc_id"]: r for r in ngram_join.jaccard_components(docs(spark, [(i, t, "s") for i, t in rows])).collect()}
    sizes, least = jaccard_classes(rows)
    assert [got[i]["n_shingles"] for i in range(len(rows))] == sizes
    assert [got[i]["component_id"] for i in range(len(rows))] == least
    assert ngram_join.jaccard_components(docs(spark, [(1, "x", "s")]).limit(0)).count() == 0


def test_hot_passages_of_sets_of_two_sizes(spark, monkeypatch):
    rng = random.Random(13)
    short, long = ([f"{name}{k}" for k in range(n)] for name, n in (("t", 100), ("p", 300)))

    def variant(words, i):
        words = list(words)
        words[rng.randrange(10, 90)] = f"e{i}"
        return " ".join(words)

    texts = [variant(short, i) for i in range(40)] + [variant(short + long, 40 + i) for i in range(40)]
    texts += [" ".join(long + [f"f{i}w{k}" for k in range(300)]) for i in range(60)]  # the short one's n-grams are rarer
    rows = list(enumerate(rng.sample(texts, len(texts))))
    monkeypatch.setattr(ngram_join, "HOT", 4)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs(spark, [(i, t, "s") for i, t in rows])).collect()}
    least = jaccard_classes(rows)[1]
    assert [got[i] for i, _ in rows] == least and len(set(least)) == 62


@pytest.mark.parametrize(("hot", "pairwise", "parts"), [(100, 1024, 64), (4, 2, 3), (1 << 40, 2, 64)])
def test_hot_words_of_short_and_long_texts(spark, monkeypatch, hot, pairwise, parts):
    rng = random.Random(19)
    shared = [f"s{k}" for k in range(11)]
    texts = [" ".join([*shared, f"own{i}"]) for i in range(150)] + [" ".join([*shared, *(f"l{i}w{k}" for k in range(20))]) for i in range(150)]
    rows = list(enumerate(rng.sample(texts, len(texts))))
    for name, value in (("HOT", hot), ("PAIRWISE", pairwise), ("HOT_PARTS", parts)):
        monkeypatch.setattr(ngram_join, name, value)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs(spark, [(i, t, "s") for i, t in rows])).collect()}
    least = jaccard_classes(rows)[1]
    assert [got[i] for i, _ in rows] == least and len(set(least)) == 151


def test_near_copies_are_dropped_by_row(spark):
    text = " ".join(f"w{k}" for k in range(40))
    near = text + " end"
    rows = [(1, "clean text of its own, six words"), (1, near), (2, text), (2, text), (None, text + " x"), (None, None), (None, ""), (5, "lone one"), (6, "lone two")]
    d = docs(spark, [(i, t, "s") for i, t in rows]).withColumns({"row_id": F.lit(1), "Component": F.lit(2), "a.b": F.lit(3)})
    kept = ngram_join.drop_near_copies(d)
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect()) == sorted([("1", rows[0][1]), ("1", near), ("None", ""), ("None", ""), ("5", "lone one"), ("6", "lone two")])
    assert kept.columns == d.columns and ngram_join.drop_near_copies(d.limit(0)).count() == 0
    twice = docs(spark, [(2, text, "s"), (2, text, "s"), (3, text, "s")])
    assert [r["doc_id"] for r in ngram_join.drop_near_copies(twice).collect()] == [2]


def test_prefix_tree_finds_all_links():
    rng = np.random.default_rng(10)
    for _ in range(20):
        base = [np.unique(rng.integers(0, 60, 40)) for _ in range(3)]
        sets = [np.unique(np.concatenate([base[rng.integers(3)], rng.integers(0, 80, rng.integers(0, 8))])) for _ in range(25)]
        forest = ngram_join.link_forest(list(range(25)), sets, [len(x) for x in sets], [0] * 25, 75)
        label = list(range(25))
        for a, b in forest:
            assert 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))
            label = [label[a] if x == label[b] else x for x in label]
        for a in range(25):
            for b in range(a):
                if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b])):
                    assert label[a] == label[b]


def test_bitmaps_lose_no_link():
    rng = np.random.default_rng(12)
    for _ in range(20):
        base = [np.unique(rng.integers(0, 1 << 60, rng.integers(90, 700))) for _ in range(3)]
        sets = []
        for _ in range(24):
            x = base[rng.integers(3)]
            sets.append(np.unique(np.concatenate([x[rng.random(len(x)) > 0.1], rng.integers(0, 1 << 60, rng.integers(0, 30))])))
        linked = [[100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b)) for b in sets] for a in sets]
        bitmaps = [ngram_join.parity_bitmap(x) for x in sets]
        for side in ([0] * 24, [0, 1] * 12):
            forest = ngram_join.near_forest(list(range(24)), bitmaps, [len(x) for x in sets], side, 75)
            label = list(range(24))
            for a, b in forest:
                label = [label[a] if x == label[b] else x for x in label]
            for a in range(24):
                for b in range(a):
                    if linked[a][b] and not side[a] == side[b] == 1:
                        assert label[a] == label[b]
    far = [np.arange(k * 1000, k * 1000 + 900) for k in range(5)]
    assert ngram_join.near_forest(list(range(5)), [ngram_join.parity_bitmap(x) for x in far], [900] * 5, [0] * 5, 75) == []
    wide = ngram_join.parity_bitmap(far[0])
    assert len(ngram_join.folded(wide, 4)) == 4 and len(ngram_join.parity_bitmap(far[0][:0])) == 4


def test_encoding_holds_few_arrays_at_once():
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(3)
    texts = pa.array([prose(rng, 20_000, 3000) for _ in range(20)])  # 2 MB
    b = bpe.Bpe(bpe.default_vocabulary())
    coder = bpe.Coder(bpe.Transducer(bpe.compile_transducer({f" w{i}".encode(): b.encode_word(f" w{i}".encode()) for i in range(3000)})), b)

    def encoded(most):
        out, ends = [], []
        tracemalloc.start()
        for part in bpe.slices(texts, most):
            ids, upto = coder.encode(*bpe.text_bytes(part))
            out.append(ids)
            ends += np.diff(upto).tolist()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return np.concatenate(out).tolist(), ends, peak

    ids, ends, peak = encoded(bpe.ENCODED_BYTES)
    whole = encoded(bpe.SLICE_BYTES)
    assert (ids, ends) == whole[:2] and peak < 40 * bpe.ENCODED_BYTES + 8 * len(ids) and 2 * peak < whole[2]


def test_texts_that_share_a_passage_only_are_not_tied(spark):
    rng = random.Random(7)
    passages = [prose(rng, 30, 10**6) for _ in range(61)]
    rows = [(i, f"{passages[i]} {prose(rng, 120, 10**6)} {passages[i + 1]}") for i in range(60)]  # a chain through all texts
    rows += [(100 + i, rows[i][1].rsplit(" ", 2)[0] + " end") for i in range(0, 60, 20)] + [(200, rows[5][1])]
    d = docs(spark, [(i, t, "s") for i, t in rows])
    order = spark.sparkContext.broadcast(ngram_join.GramOrder(np.zeros(0, np.int64), 0))
    left = ngram_join.linkable(ngram_join.sets_table(d, order, 5, 75), 75)
    assert sorted(r["doc_id"] for r in left.collect()) == [0, 20, 40, 100, 120, 140]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(d).collect()}
    assert {i: c for i, c in got.items() if i != c} == {100: 0, 120: 20, 140: 40, 200: 5}


@pytest.mark.parametrize("held", [1, 65_536])
def test_shared_counts(spark, monkeypatch, held):
    monkeypatch.setattr(ngram_join, "HELD_ROWS", held)
    rng = random.Random(held)
    rows = [(rng.randrange(40) % (1 + rng.randrange(40)), rng.randrange(9)) for _ in range(400)] + [(77, 1), (77, 1), (78, 2)]
    holders = {g: {n for f, n in rows if f == g} for g, _ in rows}
    expected = Counter(n for x in holders.values() if len(x) > 1 for n in x)
    with ngram_join.small_batches(spark, 7):
        got = {r["node"]: r["shared"] for r in ngram_join.shared_counts(spark.createDataFrame(rows, "gram long, node long")).collect()}
    assert got == expected


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7)]
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    label = {r["node"]: r["component"] for r in got}
    assert len({label[i] for i in range(51)}) == 1 and len({label[i] for i in range(100, 140)}) == 1 and label[0] != label[100]
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 9, 10 --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_learn_and_score_empty_texts(spark, module):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(400):
        y = i % 2
        text = prose(rng, 60)
        if (module is toxicity) == bool(y):
            text += " nastyword nastyword " if module is toxicity else " ### $$$ ### $$$ ### $$$"
        rows.append((i, text, "s"))
        labels.append((i, y, y))
    d = docs(spark, [*rows, (1000, None, "s"), (1001, "", "s"), (None, "x" * 200_000, "s")]).withColumn("score", F.lit("own"))
    known = spark.createDataFrame([*labels, (None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")
    model = module.train(d, known)
    scored = (toxicity.toxicity_scores if module is toxicity else quality.quality_scores)(d, model)
    got = {r["doc_id"]: r["_score"] for r in scored.collect()}
    assert len(got) == 403 and all(0 <= s <= 1 for s in got.values()) and got[1000] == got[1001]
    held = [r["doc_id"] for r in d.where("crc32(cast(doc_id as string)) % 3 = 1 AND doc_id < 400").collect()]
    assert sum((got[i] >= 0.5) == bool(i % 2) for i in held) >= 0.95 * len(held)
    untrained = module.train(d, known.limit(0))
    assert {r[0] for r in (toxicity.toxicity_scores if module is toxicity else quality.quality_scores)(d, untrained).select("_score").collect()} == {0.5}


MASK = (1 << 64) - 1


def slow_gram(gram, size, bits):
    """The cell of a few characters."""
    h = sum(ord(c) * pow(0x100000001B3, i, 1 << 64) for i, c in enumerate(gram)) & MASK
    return ((((h ^ (h >> 29)) + size) * 0x9E3779B97F4A7C15) & MASK) >> (64 - bits)


def slow_toxicity(model, text):
    folded = " " + re.sub("[\t-\r]", " ", (text or "").translate(LOWER)) + " "
    cells = {slow_gram(folded[i : i + n], n, model.bits) for n in toxicity.SIZES for i in range(len(folded) - n + 1)}
    z = sum(float(model.weights[c]) for c in cells) / (len(toxicity.SIZES) * len(folded)) ** toxicity.DAMPING + model.bias
    return 1 / (1 + np.exp(-z))


def slow_quality(model, text):
    text = text or ""
    cells, before = [slow_gram(text[i : i + n], n, model.bits) for n in quality.GRAMS for i in range(len(text) - n + 1)], None
    for word in re.findall(r"[^\x20\x09-\x0D]+", text):
        h = sum((ord(c) + 1) * pow(0x100000001B3, i, 1 << 64) for i, c in enumerate(word)) & MASK
        mark = 1 if h == before else h
        cells.append((((mark ^ (mark >> 29)) * 0x9E3779B97F4A7C15) & MASK) >> (64 - model.bits))
        before = h
    z = model.bias + (sum(float(model.logits[c]) for c in cells) / len(cells) if cells else 0)
    return 1 / (1 + np.exp(-z))


@pytest.mark.parametrize(("name", "module", "slow", "at"), [("op9_toxicity", toxicity, slow_toxicity, 0.7), ("op10_quality", quality, slow_quality, 0.5)])
def test_scores_equal_a_slow_scorer(spark, name, module, slow, at):
    """The query over whole texts, with the model that it trains: every score, the fold and the decision."""
    import zlib

    from evidencespark.llm import queries

    sf = "/root/testdata/sf0.001"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = module.train(d, labels)
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    got = queries.QUERIES[name](spark, sf).collect()
    assert {r["doc_id"] for r in got} == set(texts)
    for r in got:
        want = slow(model, texts[r["doc_id"]])
        assert abs(r["score"] - want) < 1e-6 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= at)


@pytest.mark.parametrize(("module", "slow"), [(toxicity, slow_toxicity), (quality, slow_quality)])
def test_scores_of_odd_texts(spark, module, slow):
    """Ties, repeated rows, other scripts, white space only, bytes that are no UTF-8."""
    rng = np.random.default_rng(4)
    model = toxicity.ToxicityModel(rng.normal(size=1 << 12).astype(np.float32), 0.2, 12) if module is toxicity else quality.QualityModel(rng.normal(size=1 << 12).astype(np.float32), 0.2, 12)
    texts = ["Abc déf GHI abc abc", "Abc déf GHI abc abc", "", None, " \t\n", "中文 😀 ÉÉÉ", "a", "ab", "x" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scored = toxicity.toxicity_scores if module is toxicity else quality.quality_scores
    for r in scored(df, model).collect():
        assert abs(r["score"] - slow(model, texts[r["doc_id"]])) < 1e-6
    broken = spark.sql("SELECT 1L AS doc_id, cast(unhex('41FF42') AS string) AS text UNION ALL SELECT 2L, 'A\ufffdB'")
    a, b = (r["score"] for r in scored(broken, model).orderBy("doc_id").collect())
    assert a == b


# --- pipeline -----------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_classifier"](spark, d, sf)
    assert good.columns == d.columns and 0 < good.count() <= d.count()
    unique = corpus_pipeline.stored(stages["exact_dedup"](spark, d, sf), "t")
    texts = [r["text"].translate(LOWER) for r in d.select("text").collect()]
    assert unique.columns == d.columns and unique.count() == len(set(texts))
    near = stages["ngram_jaccard_join"](spark, unique, sf)
    rows = [(i, r["text"]) for i, r in enumerate(unique.orderBy("doc_id").collect())]
    ids = [r["doc_id"] for r in unique.orderBy("doc_id").collect()]
    want = {ids[i] for i, c in enumerate(jaccard_classes(rows)[1]) if c == i}
    assert {r["doc_id"] for r in near.collect()} == want and near.columns == d.columns
    coded = stages["bpe"](spark, stages["source_mix"](spark, near, sf), sf)
    assert coded.where("NOT round_trip").count() == 0 and coded.count() > 0


@pytest.mark.parametrize("name", ["op3_exact_dedup", "op4_source_mix", "op11_merkle_manifest"])
def test_same_rows_as_sql(spark, tmp_path, name):
    import duckdb

    from evidencespark.llm import queries

    own = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    own = own.unionByName(own.limit(5)).unionByName(own.limit(2).withColumns({"text": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "doc_id": F.col("doc_id") + 10_000}))
    own.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES[name](spark, str(tmp_path))
    columns = sorted(got.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    plain = lambda rows: sorted(str([round(x, 6) if isinstance(x, float) else x for x in r]) for r in rows)
    assert plain([r[c] for c in columns] for r in got.collect()) == plain(want)


def test_pipeline_runs_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows, shared ids, clashing columns; then no rows at all."""
    import corpus_pipeline

    rng = random.Random(23)
    base = [prose(rng, 80) for _ in range(12)]
    rows = [(i, base[i % 12] + (f" tail{i}" if i % 3 else ""), "en", f"s{i % 3}") for i in range(36)]
    rows += [(1, base[2], None, None), (None, base[3], "en", "s0"), (None, None, None, None), (50, "", "en", "s1"), (51, "", "en", "s1"), (4, rows[4][1], "en", "s1"), (52, "x" * 300_000, "en", "s2")]
    d = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("own") for c in ("score", "ids", "row_id", "N_tokens", "_shard", "keep_id")})
    for part, some in (("full", d), ("none", d.limit(0))):
        some.write.parquet(f"{tmp_path}/{part}/documents.parquet")
        spark.createDataFrame([(i, 1, 0) for i in range(36)], "doc_id long, quality int, toxic int").where("false" if part == "none" else "true").write.parquet(f"{tmp_path}/{part}/labels.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/full")
    assert got.columns == [c for c in d.columns if c != "text"] + ["_ids", "_n_tokens", "round_trip"]
    out = got.collect()
    assert out and all(r["round_trip"] and r["ids"] == "own" and len(r["_ids"]) == r["_n_tokens"] for r in out)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    stage = dict(corpus_pipeline.STAGES)
    unique = stage["exact_dedup"](spark, d, None)
    kept = stage["ngram_jaccard_join"](spark, unique, None)
    texts = Counter((t or "").translate(LOWER) for _, t, _, _ in rows)
    assert unique.count() == len(texts) and kept.columns == d.columns
    ordered = [(r["doc_id"], r["text"]) for r in unique.collect()]
    assert kept.count() == len(set(jaccard_classes(ordered)[1]))


def test_suffix_dedup_memory_of_a_task():
    """Windows of 8 MB of texts are found, and batches taken, in little memory, whatever a batch holds."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(4)
    texts = ["".join(chr(c) for c in rng.integers(97, 123, 40_000)) for _ in range(200)]
    run = suffix_dedup.RUN_BYTES
    tracemalloc.start()
    powers = [suffix_dedup._powers(run + 400, b) for b in (suffix_dedup._BASE, suffix_dedup._INVERSE)]
    n = sum(found.shape[1] for found in suffix_dedup.anchor_lists(pa.array(texts), 400, powers))
    assert n and tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000))], names=["a"])
    cut = list(suffix_dedup.pieces([batch, batch.slice(0, 0), batch.slice(3, 5)]))
    assert max(p.num_rows for p in cut) <= suffix_dedup.PIECE_ROWS
    assert sum((p.column(0).to_pylist() for p in cut), []) == [*range(10_000), *range(3, 8)]


def test_features_come_packed(spark):
    """Features reach the driver and stay there compressed, give back what was packed, and can be read twice."""
    from evidencespark.llm import linear

    def features(data):
        at = np.unique(data.astype(np.int64) * 257 % 65_536)
        return at, np.arange(len(at)) / 8

    texts = [prose(random.Random(i), 400) for i in range(30)] + [""]
    sample = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(texts)], "doc_id long, text string, y int").repartition(3)
    rows = linear.collect_features(sample, features)
    assert len(rows) == len(list(rows)) == 31
    for i, (y, at, value) in enumerate(rows):
        want = features(np.frombuffer(texts[i].encode(), np.uint8))
        assert y == i % 2 and (at == want[0]).all() and (value == want[1]).all() and at.dtype == np.int32 and value.dtype == np.float32
    at = np.sort(np.random.default_rng(1).choice(65_536, 2_000, replace=False))
    packed = linear.packed_features(at, np.ones(2_000) / 5_000)
    assert sum(len(x) for x in packed) < 2 * len(at)


def test_quality_memory_of_a_run():
    """Scoring holds little beside the batch, and a text's score does not depend on its run."""
    import tracemalloc

    import pyarrow as pa

    from evidencespark.llm import linear

    rng = np.random.default_rng(3)
    texts = ["".join(chr(c) for c in rng.choice([32, *range(97, 123)], 50_000)) for _ in range(80)]
    model = quality.QualityModel(rng.normal(size=1 << 16).astype(np.float32), 0.1, 16)
    column = pa.array(texts)
    tracemalloc.start()
    got = np.concatenate([quality.score(model, *run) for run in linear.runs(column)])
    assert tracemalloc.get_traced_memory()[1] < 80 << 20
    tracemalloc.stop()
    assert (got == np.concatenate([quality.score(model, *run) for run in linear.runs(column, 1 << 21)])).all()

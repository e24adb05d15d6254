"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import html
import itertools
import json
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import common, dedup, html_cut, idfile, lm, mixing, ngram_join, packing, queries, quoting, tokens, topk, toxicity

WORDS = "the of and a to in is it on that for was with as by ab cd ef gh ij kl mn op qr st uv wx yz".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, size long, key string, score double, label string, block int, n int"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + ("," if rng.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    texts = [prose(rng, int(rng.integers(1, 120))) for _ in range(40)]
    texts += [None, "", "  \n\t ", "x", "x", "x ", " x", "é ü　ß", "a  b   c \n d", prose(rng, 3000), texts[3], texts[3] + " ", texts[5].replace(" ", "\n", 1), "w" * 9000, "w" * 9000 + " "]
    base = prose(rng, 100)
    texts += [base + f" tail{i}" for i in range(12)]
    out = [(i, t, "en", f"s{i % 4}" if i % 7 else None, 0) for i, t in enumerate(texts)]
    out += [out[2], out[2], (5, "same id, other text", "en", "s1", 0), (None, "no id", None, None, None)]
    return [(*r, 1, 2, "k", 0.5, "l", 3, 4) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('docs')}/documents.parquet"
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


def pdf(df):
    return df.toPandas()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.vocabulary_path())


def encode(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


TRICKY = ["", "a  b", "a   b", " \n b", "a \nb", "x  \ny ", "a ", "  ", "don't  's", "a b\n c\n\n d", "é  ü\t x", "\n \n", " 's a's", "\x00 b \x1c c", "<|endoftext|> x", "<|endoftext|>", "x<|endoftext|>y", "a <|endoftext|> b", "a  <|endoftext|>  <|endoftext|>\n b ", "word<|endoftext|><|endoftext|>", "<|endoftext| >", "<|endoftext|>" + " long words here" * 9, "a\xa0 b", "1,2. 3,\n4."]


@pytest.mark.parametrize("memo", [700_000, 5])
def test_encoder_gives_the_tokenizers_ids(tokenizer, monkeypatch, memo):
    monkeypatch.setattr(tokens, "MEMO", memo)
    monkeypatch.setattr(tokens, "SLICE", 50)
    rng = np.random.default_rng(1)
    texts = TRICKY + [prose(rng, 200) for _ in range(20)] + ["".join(rng.choice(list("ab,. \n\t'é1"), 60)) for _ in range(300)]
    texts += ["".join(rng.choice(["a", "b", " ", "\n", ",", "<|endoftext|>"], 30)) for _ in range(100)]
    code = tokens.Encoder(tokens.vocabulary_path())
    for part in (texts, texts[::-1], [*texts[:5], None]):
        for text, ids in zip(part, code.encode(part), strict=True):
            assert ids.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, text


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 32])
def test_pack_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype(np.uint32)
    assert (idfile.unpack(idfile.pack(ids, bits), len(ids), bits) == ids).all()


def test_id_file_random_access(tmp_path, monkeypatch):
    monkeypatch.setattr(idfile, "BLOCK", 16)
    rng = np.random.default_rng(0)
    held = [rng.integers(0, 50_257, n).astype(np.uint32) for n in (0, 1, 40, 16, 0, 7, 100)]
    path = f"file://{tmp_path}/a.glids"
    assert idfile.write_file(path, held, 16) == (7, 164)
    f = idfile.IdFile(path)
    assert len(f) == 7 and all((f[i] == x).all() for i, x in enumerate(held)) and all((a == b).all() for a, b in zip(f.documents(), held, strict=True))
    flat = np.concatenate(held)
    assert all((f.read(s, n) == flat[s : s + n]).all() for s, n in ((0, 164), (15, 2), (33, 60), (163, 1)))


def test_id_files(spark, docs, rows, empty, tokenizer):
    got = pdf(idfile.digest(idfile.write(docs, common.work_path(spark, "t"))))
    want = sorted(((r[0] is not None, r[0] or 0), encode(tokenizer, r[1])) for r in rows)
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got.itertuples():
        by[None if pd.isna(r.doc_id) else int(r.doc_id)].append((r.n_tokens, r.ids_crc32))
    expected = defaultdict(list)
    for r in rows:
        ids = encode(tokenizer, r[1])
        expected[r[0]].append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert {k: sorted(v) for k, v in by.items()} == {k: sorted(v) for k, v in expected.items()}
    order = got.sort_values("start")
    assert (order["start"] + order["n_tokens"]).tolist()[:-1] == order["start"].tolist()[1:] and order["start"].iloc[0] == 0
    assert order["doc_id"].fillna(-1).is_monotonic_increasing and order["n_tokens"].sum() == sum(len(x) for _, x in want)
    assert pdf(idfile.digest(idfile.write(empty, common.work_path(spark, "t")))).empty


def test_packing(docs, rows, empty, tokenizer):
    got = pdf(packing.digest(packing.pack(docs, capacity=64)))
    expected = Counter()
    for r in rows:
        ids, at, piece = encode(tokenizer, r[1]), 0, 0
        while at < len(ids):
            n = (len(ids) - at) % 64 or 64
            expected[(r[0], piece, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()))] += 1
            at, piece = at + n, piece + 1
    key = [(None if pd.isna(x.doc_id) else int(x.doc_id), x.piece, x.start, x.length, x.ids_crc32) for x in got.itertuples()]
    assert Counter(key) == expected
    g = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (g["length"].sum() <= 64).all() and (g["length"].cumsum() - got.sort_values(["sequence_id", "offset"])["length"] == got.sort_values(["sequence_id", "offset"])["offset"]).all()
    assert pdf(packing.pack(empty)).empty


def test_reduction_is_optimal_on_small_instances():
    def least(items, capacity):
        best = [len(items)]

        def go(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(items):
                best[0] = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] >= items[i]:
                    bins[k] -= items[i]
                    go(i + 1, bins)
                    bins[k] += items[i]
            go(i + 1, [*bins, capacity - items[i]])

        go(0, [])
        return best[0]

    rng = np.random.default_rng(5)
    for _ in range(60):
        items = sorted(rng.integers(1, 21, int(rng.integers(1, 9))).tolist(), reverse=True)
        plan = packing.reduce_and_fit(Counter(items), 20)
        assert all(sum(p) <= 20 for p, _ in plan.patterns) and Counter(x for p, n in plan.patterns for x in p * n) == Counter(items)
        # what dominance fixes is part of an optimal solution
        probe = packing.Plan(20)
        assert plan.sequences <= least(items, 20) + 1 and probe.sequences == 0
        if plan.fixed == plan.sequences:
            assert plan.sequences == least(items, 20)
    big = packing.reduce_and_fit({x: 10**9 for x in range(1, 1025)}, 1024)
    assert len(big.patterns) < 6000 and sum(len(p) * n for p, n in big.patterns) == 1024 * 10**9


def test_exact_dedup(docs, rows, empty, monkeypatch):
    for block, spread in ((4096, 200), (8, 2)):
        monkeypatch.setattr(dedup, "BLOCK", block)
        monkeypatch.setattr(dedup, "SPREAD", spread)
        got = pdf(dedup.decide(docs))
        groups = defaultdict(list)
        norm = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
        for r in rows:
            groups[norm(r[1])].append((-len(r[1] or ""), r[0] is None, r[0] or 0, r[0]))
        expected = Counter((r[0], min(groups[norm(r[1])])[3], len(groups[norm(r[1])]), hashlib.sha256(norm(r[1]).encode()).hexdigest()) for r in rows)
        none = lambda x: None if pd.isna(x) else int(x)
        assert Counter((none(x.doc_id), none(x.keep_id), x.group_size, x.text_sha256) for x in got.itertuples()) == expected
        assert got.groupby("text_sha256")["kept"].sum().eq(1).all()
    left = pdf(dedup.deduplicate(docs))
    assert list(left.columns) == docs.columns and len(left) == len(groups)
    assert pdf(dedup.decide(empty)).empty and pdf(dedup.deduplicate(empty)).empty


def test_dedup_uses_no_python(docs):
    plan = dedup.decide(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_toxicity_learns_and_holds_out(spark, empty):
    rng = np.random.default_rng(9)
    bad = ["vile", "gruesome", "hateful"]
    texts, labels = [], []
    for i in range(600):
        toxic = int(rng.random() < 0.15)
        texts.append(prose(rng, 40) + (" " + " ".join(rng.choice(bad, 2)) + "ly" if toxic else ""))
        labels.append(toxic)
    frame = spark.createDataFrame([(i, t, 9.0) for i, t in enumerate(texts)] + [(None, None, 1.0), (600, "", 1.0), (0, texts[0], 1.0)], "doc_id long, text string, score double")
    known = spark.createDataFrame([*enumerate(labels), (0, None), (None, 1), (1, labels[1])], "doc_id long, toxic int")
    model = toxicity.train(frame, known, held_out=toxicity.held_out)
    got = pdf(toxicity.score(frame, model)).dropna(subset=["doc_id"]).drop_duplicates("doc_id").set_index("doc_id")["score"]
    test = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    predicted = np.array([got[i] >= 0.7 for i in test])
    truth = np.array([labels[i] == 1 for i in test])
    assert (predicted == truth).mean() > 0.97 and predicted[truth].mean() > 0.9
    assert got.between(0, 1).all() and got[600] < 0.5
    # labels of held-out rows change nothing
    other = spark.createDataFrame([(i, 1 - y if i in set(test) else y) for i, y in enumerate(labels)], "doc_id long, toxic int")
    assert toxicity.train(frame, other, held_out=toxicity.held_out).weights == toxicity.train(frame, known, held_out=toxicity.held_out).weights
    blank = toxicity.train(empty, known.limit(0))
    assert blank.weights == {} and pdf(toxicity.score(empty, blank)).empty


@pytest.mark.parametrize("group_bytes", [256 << 20, 300])
def test_language_model(spark, docs, rows, empty, monkeypatch, group_bytes):
    monkeypatch.setattr(lm, "GROUP_BYTES", group_bytes)
    model = lm.train(docs)
    assert (len(model.files) > 1) == (group_bytes == 300)
    got = pdf(lm.score(docs.select("doc_id", "text", "score"), model))
    assert got.columns.tolist() == ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    split = lambda t: [*(t or "").encode().lower().split(), b" end"]
    c = Counter(w for r in rows for w in split(r[1]))
    n, v = sum(c.values()), len(c)
    want = Counter((r[0], len(split(r[1])), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in split(r[1])), 6)) for r in rows)
    assert Counter((None if pd.isna(x.doc_id) else int(x.doc_id), x.n_tokens, round(x.base_score, 6)) for x in got.itertuples()) == want
    assert (got["train_tokens"] == n).all() and (got["n_known"] == got["n_tokens"]).all() and (got["score"] <= 1e-9).all()
    assert got["score"].sum() > got["base_score"].sum()
    # the whole score, from plain counts of pairs
    pairs = Counter(p for r in rows for p in zip([b" end", *split(r[1])], split(r[1])))  # noqa: B905
    assert abs(sum(k**model.beta for k in c.values()) / len(pairs) - 1) < 0.05
    value = lambda k: lm.VALUES[np.searchsorted(lm.LEVELS, k, "right")]

    def brute(text):
        out, h = 0.0, b" end"
        for w in split(text):
            t = c[h] ** model.beta
            out += math.log10((min(value(pairs[h, w]), c[h], c[w]) + t * (c[w] + 1) / (n + v + 1)) / (c[h] + t))
            h = w
        return out

    by = {r.doc_id: r.score for r in got.itertuples()}
    once = [r for r in rows if r[0] is not None and sum(x[0] == r[0] for x in rows) == 1]
    # the filter may take a pair for a more frequent one, and rarely does
    off = [by[r[0]] - brute(r[1]) for r in once]
    assert min(off) > -1e-6 and np.mean(np.array(off) < 0.05 * np.array([len(split(r[1])) for r in once])) > 0.9
    nothing = lm.train(empty)
    other = pdf(lm.score(docs.select("doc_id", "text"), nothing))
    assert (other["base_score"].abs() < 1e-9).all() and (other["n_known"] == 0).all() and pdf(lm.score(empty, nothing)).empty


def test_filter_levels_never_fall_short():
    keys = lm.mix(np.arange(1, 2000, dtype=np.uint64))
    counts = np.random.default_rng(0).zipf(1.5, len(keys)).clip(1, 10**6)
    level = np.searchsorted(lm.LEVELS, counts, "right")
    bits = int(level.sum()) * lm.BITS // 64 * 64 + 64
    flags = np.zeros(bits, bool)
    for q in range(1, level.max() + 1):
        for i in range(lm.PROBES):
            flags[lm.positions(keys[level >= q], q, i, np.uint64(bits))] = True
    g = lm.Group.__new__(lm.Group)
    g.first, g.last, g.n_shards = 0, 1, 1
    g.table, g.bits = np.array([[0, bits]], np.uint64), np.packbits(flags, bitorder="little")
    found = g.level(keys)
    assert (found >= level).all() and (found == level).mean() > 0.9 and (g.level(lm.mix(keys)) == 0).mean() > 0.93


def test_mixing(docs, rows, empty):
    got = pdf(mixing.mix(docs).decisions)
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    assert len(got) == len(rows) and Counter(got["size"]) == Counter(size(r[1]) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped, left = {}, dict(weight)
    while True:
        level = (1.5 * sum(sizes.values()) - sum(capped.values())) / sum(left.values())
        over = [s for s in left if left[s] * level > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            capped[s] = 2 * sizes[s]
            del left[s]
    want = {s: capped.get(s, weight[s] * level) for s in names}
    for s, part in got.groupby(got["source"].fillna("~")):
        goal = want[None if s == "~" else s]
        assert np.allclose(part["target"], goal) and abs(part["taken"].sum() - goal) <= max(r for r in part["size"])
    assert (got["taken"] <= 2 * got["size"]).all() and (got["taken"] % got["size"].clip(1) == 0).all()
    again = pdf(mixing.mix(docs).decisions)
    assert Counter(map(tuple, got[["size", "taken"]].to_numpy())) == Counter(map(tuple, again[["size", "taken"]].to_numpy()))
    applied = pdf(mixing.apply(docs))
    assert list(applied.columns) == docs.columns and sum(size(t) for t in applied["text"]) == got["taken"].sum()
    assert pdf(mixing.mix(empty).decisions).empty and pdf(mixing.apply(empty)).empty


@pytest.mark.parametrize("few", [10_000, 5])
def test_mixing_goes_on_behind_long_documents(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW", few)  # 5: by steps over the whole table
    ids = [r["id"] for r in spark.range(600).orderBy(mixing.key(F.col("id"), F.lit(1.0))).collect()]
    rng = np.random.default_rng(5)
    n = {i: int(rng.integers(1, 60)) for i in ids}
    n[ids[0]], n[ids[3]] = 30_000, 4_000
    n |= {i: 0 for i in ids[20:24]}
    data = [(i, " ".join(["w"] * n[i]), "s") for i in ids] + [(ids[1], " ".join(["w"] * n[ids[1]]), "s")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3)
    docs = common.stored(docs, "long-first")
    got = pdf(mixing.mix(docs, total=0.4).decisions)
    gap = goal = 0.4 * sum(len(t.split()) for _, t, _ in data)
    want, skipped = Counter(), []
    for i in [ids[0], ids[1], *ids[1:]]:
        if 0 < n[i] <= gap:
            want[i] += 1
            gap -= n[i]
        elif n[i]:
            skipped.append((n[i], i))
    if skipped and min(skipped)[0] < 2 * gap:
        want[min(skipped)[1]] += 1
    taken = got[got["size"] > 0].groupby("doc_id")["copies"].sum()
    assert {i: c for i, c in taken.items() if c} == dict(want)
    assert abs(got["taken"].sum() - goal) < 60
    assert Counter(i for i in pdf(mixing.apply(docs, total=0.4))["doc_id"] if n[i]) == want


@pytest.mark.parametrize("weight", [1.0, 0.1, 0.01])
def test_no_bucket_of_keys_is_crowded(spark, weight):
    parts = 32
    buckets = spark.range(40_000).select(F.floor(F.log2(mixing.key(F.col("id"), F.lit(weight))) * (mixing.FINE * parts)).alias("b")).groupBy("b").count()
    assert buckets.agg(F.max("count")).first()[0] < 1.5 * 0.26 * 40_000 / parts


def test_mixing_draws_rows_without_ids_apart(spark):
    rows = [(None, " ".join(["w"] * 5) + f" {i}", "s") for i in range(400)] + [(None, "same text here", "s")] * 3
    docs = common.stored(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), "no-ids")
    got = pdf(mixing.mix(docs, total=0.3).decisions)
    goal = 0.3 * got["size"].sum()
    assert abs(got["taken"].sum() - goal) <= 6 and 80 < (got["copies"] > 0).sum() < 160
    assert sorted(r["text"] for r in mixing.apply(docs, total=0.3).collect()) == sorted(r["text"] for r in mixing.apply(docs, total=0.3).collect())


def test_heavier_documents_are_drawn_sooner(spark):
    frame = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 4.0).otherwise(1.0).alias("w"), mixing.key(F.col("id"), F.when(F.col("id") % 2 == 0, 4.0).otherwise(1.0)).alias("k"))
    first = frame.orderBy("k").limit(1000).where("w = 4").count()
    assert abs(first / 1000 - 0.8) < 0.04


ARTICLE = """<html><head><title>T</title><style>p{}</style></head><body class="content"><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies, accept.</div><aside class=sidebar><p>Popular reads of the week are here.</p></aside>
<article><header><h1>Real &amp; true</h1></header><p>First   para<br>goes &lt;on&gt; here, with words.<p>Second one<script>var a="</p>";</script> is fine.</p>
<div class="ad">Buy now!</div><ul><li>Point one.</li><li>Point two.</li></ul><div class="comments"><article><p>I like this article a lot.</p></article></div></article>
<form><label>Mail</label><input></form><footer>&copy; me</footer>"""


def test_html_main_text(spark):
    w = html_cut.fit(np.zeros((0, html_cut.FEATURES)), np.zeros(0))
    assert html_cut.main_text(ARTICLE, w) == "Real & true\n\nFirst para goes <on> here, with words.\n\nSecond one is fine.\n\nPoint one.\n\nPoint two."
    assert [html_cut.main_text(x, w) for x in (None, "", "<", "<p", "<!-- x", "<article><p>a</article>")] == ["", "", "", "", "", "a"]
    pages = spark.createDataFrame([(1, "u", ARTICLE, "t", 5), (2, None, None, "t", 5), (2, None, "<p>" * 3000 + "x", "t", 5)], "page_id long, url string, html string, text string, n_chars long")
    got = pdf(html_cut.extract(pages, html_cut.train(pages)))
    assert got.columns.tolist() == ["page_id", "url", "text", "n_chars"] and (got["text"].str.len() == got["n_chars"]).all() and got["text"][0].startswith("Real")
    assert pdf(html_cut.extract(pages.limit(0), html_cut.train(pages.limit(0)))).empty


def weights_of(pages):
    sums = []
    for x in pages:
        told = [b for b in html_cut.parse(x)[0] if b.mark]
        for sign in (1, -1):
            own = [html_cut.shape(b) for b in told if (b.mark > 0) == (sign > 0)]
            sums += [(int(sign > 0), np.mean(own, axis=0).tolist())] if own else []
    sums.sort()
    return html_cut.fit(np.array([x for _, x in sums]), np.array([y for y, _ in sums]))


@pytest.fixture(scope="module")
def pages(spark):
    return [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()]


def test_html_against_a_plain_reading(pages):
    """These pages hold their text in one article; what a cut of the text at its tags gives is what is wanted."""
    w = weights_of(pages)
    for x in pages:
        inside = re.sub(r"(?s)<!--.*?-->|<(script|style)\b.*?</\1>|<div class=\"ad\">.*?</div>", "", re.search(r"(?s)<article>(.*?)</article>", x)[1])
        parts = re.split(r"</?(?:p|h1|h2|h3|ul|ol|li|div|section|article)\b[^>]*>", re.sub(r"<br\s*/?>", " ", inside))
        plain = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", part)).split()) for part in parts]
        assert html_cut.main_text(x, w) == "\n\n".join(t for t in plain if t)


def test_the_cut_outvotes_names_of_classes(pages):
    """Share of the text that is kept, and that is right, when markup tells less or something wrong."""
    w = weights_of(pages)
    less = lambda x: re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", x)
    bare = lambda x: re.sub(r"<(/?)(?:article|nav|aside|footer|header)\b", r"<\1div", less(x))
    wrong = lambda x: re.sub(r"<(p|h1)>", r'<\1 class="promo">', x)
    for change, least in ((less, 0.99), (bare, 0.9), (wrong, 0.9)):
        right = said = whole = 0
        for x in pages:
            want, got = html_cut.main_text(x, w).split("\n\n"), html_cut.main_text(change(x), w).split("\n\n")
            right, said, whole = right + sum(len(t) for t in got if t in want), said + sum(map(len, got)), whole + sum(map(len, want))
        assert right / said > least and right / whole > least


LONG = "This is a whole sentence of an article, and it goes on for long enough. "


def test_nothing_of_an_article_is_lost(pages):
    w = weights_of(pages)
    read = lambda x: html_cut.main_text(x, w)
    said = [f"{i} {LONG * 2}".strip() for i in range(4)]
    paragraphs = "".join(f"<p>{x}</p>" for x in said)
    whole = "\n\n".join(said)
    nav = "<nav><a href=a>Home</a> <a href=b>All</a></nav>"
    # the word hidden in a value hides nothing; as an attribute it does
    for attrs in ('title="a hidden gem"', "alt='hidden'", 'data-x="x hidden y"', "title = hidden", 'title="" data-hidden="1"'):
        assert read(f"{nav}<article><p {attrs}>{said[0]}</p>{paragraphs}</article>") == said[0] + "\n\n" + whole
    for attrs in ("hidden", 'class="x" hidden', "hidden=''", 'HIDDEN="until-found" title="a"', 'title="a"hidden'):
        assert read(f"{nav}<article><p {attrs}>{said[0]}</p>{paragraphs}</article>") == whole
    # reviews are articles too; readers' comments are not
    for name in ("review", "reviews", "discussion"):
        assert read(f'{nav}<article><h1>A book</h1><div class="{name}">{paragraphs}</div></article>') == "A book\n\n" + whole
    assert read(f'{nav}<article>{paragraphs}<div class="comments"><p>{LONG}</p></div></article>') == whole
    # formulas stay in their line
    math = "<math><mrow><mi>E</mi><mo>=</mo><msup><mi>mc</mi><mn>2</mn></msup></mrow><annotation>E=mc^2</annotation></math>"
    assert read(f"{nav}<article><p>Energy is {math} and so on, as {LONG}</p>{paragraphs}</article>") == f"Energy is E=mc2 and so on, as {LONG}".strip() + "\n\n" + whole
    # a heading stays with what it heads
    assert read(f'{nav}<article>{paragraphs}<section id="related-work"><h2>Related work</h2>{paragraphs}</section></article>') == f"{whole}\n\nRelated work\n\n{whole}"
    assert read(f'{nav}<article>{paragraphs}<section class="related"><h2>Related</h2><ul><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul></section></article>') == whole


def test_deep_and_broken_pages_take_linear_time():
    import time

    for name in ("div", "b", "x-y"):
        assert html_cut.main_text(f"<{name}>" * 100_000 + "deep", np.zeros(html_cut.FEATURES)) in ("deep", "")
    for name in ("svg", "select", "button", "video", "head", "embed", "annotation", "math"):
        began = time.process_time()
        html_cut.parse(f"<{name}> a " * 60_000)
        assert time.process_time() - began < 10


def test_cut_is_least():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n = 6
        a, b = rng.random(n), rng.random(n)
        joins = [(i, j, float(rng.random())) for i in range(n) for j in range(i)]
        flow = html_cut.Flow(n + 2)
        for i in range(n):
            flow.add(n, i, float(a[i]))
            flow.add(i, n + 1, float(b[i]))
        for i, j, c in joins:
            flow.add(i, j, c, c)
        side = flow.cut(n, n + 1)[:n]
        cost = lambda s: sum(b[i] if s[i] else a[i] for i in range(n)) + sum(c for i, j, c in joins if s[i] != s[j])
        assert abs(cost(side) - min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))) < 1e-6


def brute_join(rows, similarity=0.8):
    sets = []
    for r in rows:
        w = (r[1] or "").encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links, root = Counter(), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    members = defaultdict(list)
    for i, r in enumerate(rows):
        members[find(i)].append(r[0])
    return Counter((r[0], min((x for x in members[find(i)] if x is not None), default=None), links[i]) for i, r in enumerate(rows))


@pytest.mark.parametrize("sizes", [(1000, 16, 64), (3, 16, 64), (1000, 5, 2)])  # the others cut groups into blocks
def test_ngram_join(docs, rows, empty, monkeypatch, sizes):
    none = lambda x: None if pd.isna(x) else int(x)
    for name, value in zip(("BLOCK_SETS", "SPREAD", "LEAST_SETS"), sizes, strict=True):
        monkeypatch.setattr(ngram_join, name, value)
    got = pdf(ngram_join.join(docs))
    assert Counter((none(x.doc_id), none(x.class_id), x.links) for x in got.itertuples()) == brute_join(rows)
    left = pdf(ngram_join.keep_one(docs))
    assert list(left.columns) == docs.columns and left["doc_id"].nunique() == got["class_id"].nunique()
    assert pdf(ngram_join.join(empty)).empty and pdf(ngram_join.keep_one(empty)).empty


@pytest.fixture(scope="module")
def chained():
    """Chains and crowds of texts whose similarities lie about the threshold."""
    rng = np.random.default_rng(8)
    out = []
    for _ in range(6):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 90)]
        for step in range(30):  # each is like its neighbours only
            words = words[2:] + [f"w{x}" for x in rng.integers(0, 10**6, 2)] if step % 3 else [*words[:40], f"w{step}", *words[41:]]
            out.append(" ".join(words))
    for size in (3, 40):
        base = [f"w{x}" for x in rng.integers(0, 10**6, 150)]
        for _ in range(size):
            own = list(base)
            for at in rng.integers(0, 150, int(rng.integers(0, 4))):
                own[at] = f"w{rng.integers(0, 10**6)}"
            out.append(" ".join(own))
    return [(i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("stop", [0.9995, 0.5])
def test_forest_shortens_prefixes_to_the_recall(spark, chained, monkeypatch, stop):
    depths = []
    found = ngram_join._found
    monkeypatch.setattr(ngram_join, "_found", lambda *a: depths.append(a[-2]) or found(*a))
    monkeypatch.setattr(ngram_join, "LEAST_SETS", 8)
    docs = common.stored(spark.createDataFrame(chained, "doc_id long, text string").repartition(3), "chained")
    got = pdf(ngram_join.join(docs, recall=stop))
    want = brute_join(chained)
    links = {i: n for i, _, n in want}
    recall = got["links"].sum() / sum(links.values())
    assert all(r.links <= links[r.doc_id] for r in got.itertuples())  # never a link that is none, or twice
    if stop == 0.5:
        assert depths == [6] and recall >= 0.5
    else:
        assert depths == [6, 5] and recall >= 0.9995
        assert Counter((r.doc_id, r.class_id, r.links) for r in got.itertuples()) == want


def test_tries_name_groups_alike_over_partitions(spark):
    rng = np.random.default_rng(6)
    labels = rng.integers(0, 2, (300, 4, 7)).astype(">u2")
    rows = [(i, x.tobytes()) for i, x in enumerate(labels)]
    forest = ngram_join.Forest(spark.createDataFrame(rows, "rid long, labels binary").repartition(3), 4, 7, 3)
    for d in (3, 5, 7):
        groups = defaultdict(set)
        for r in forest.at(d).collect():
            groups[(r["tree"], r["group"])].add(r["rid"])
        want = defaultdict(set)
        for i, x in enumerate(labels):
            for t in range(4):
                want[(t, x[t, :d].tobytes())].add(i)
        assert sorted(sorted(g) for g in groups.values() if len(g) > 1) == sorted(sorted(g) for g in want.values() if len(g) > 1)
        order = sorted(groups, key=lambda k: k[1])
        assert [t for t, _ in order] == sorted(t for t, _ in order)


def test_letters_are_merged_without_being_split(monkeypatch):
    rng = np.random.default_rng(11)
    alphabet = [*"abcdefghijklmnopqrstuvwxyzABCXYZáéíñóúüçßøÿªºµŁžǅɏ", "ɐ", "ж", "中", "e\u0301", "\xad", "7", "'", "×"]
    words = ["".join(rng.choice(alphabet, rng.integers(1, 14))) + str(rng.choice(["", ",", ".", "..", "\n"])) for _ in range(3000)]
    words += ["".join(rng.choice(alphabet[:40], rng.integers(1, 14))) + str(rng.choice(["", ",", "."])) for _ in range(3000)]
    code = tokens.Encoder(tokens.vocabulary_path())
    split = []
    joined = code._encode_joined
    monkeypatch.setattr(code, "_encode_joined", lambda pieces: split.extend(pieces) or joined(pieces))
    texts = [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)]
    got = code.encode(texts)
    assert [x.tolist() for x in got] == [code.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert split and not [x for x in split if x.strip(",.").isascii() and x.strip(",.").isalpha() and len(x) - len(x.strip(",.")) < 2]


def test_letters_with_marks_are_made_of_parts(monkeypatch):
    rng = np.random.default_rng(12)
    letters = [*"abcdefghijklmnopqrstuvwxyzABCXYZáéíñóúüçßøÿªºµŁžǅɏ"]
    marks = [*"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"]
    lines = ["".join(rng.choice(letters, rng.integers(1, 9))) + "".join(rng.choice(marks, rng.integers(0, 4))) for _ in range(6000)]
    words = ["\n".join(lines[i : i + n]) for n, of in ((1, 3000), (2, 2000), (3, 900)) for i in range(0, of, n)]
    code = tokens.Encoder(tokens.vocabulary_path())
    split = []
    joined = code._encode_joined
    monkeypatch.setattr(code, "_encode_joined", lambda pieces: split.extend(pieces) or joined(pieces))
    texts = [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)]
    others = ["don't I'll,'s x'", "a1. 1a, a.b a..b\n\nc d.\n e\n", "e\u0301. ж, ɐ! a\u00a0b. \xad,", "\n a\n. .a .\na", "x.'s 's. a.\tb a\r\nb"]
    assert [x.tolist() for x in code.encode(texts)] == [code.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert not [x for x in split if x in words]
    assert [x.tolist() for x in code.encode(others)] == [code.tokenizer.encode(t, add_special_tokens=False).ids for t in others]


def test_most_used_pieces_are_remembered(monkeypatch, tokenizer):
    monkeypatch.setattr(tokens, "MEMO", 40)
    words = [a + b for a in "xyz" for b in "abcdefghijklmnopqrst"]
    code = tokens.Encoder(tokens.vocabulary_path())
    text = " ".join(w for i, w in enumerate(["first", *words]) for _ in range(5 if i < 10 else 2))
    for t in (text, "zz", text):
        assert code.encode([t])[0].tolist() == tokenizer.encode(t, add_special_tokens=False).ids
        if t == "zz":
            assert set(words[:9]) <= set(code.memo) and len(code.memo) < 25


@pytest.mark.parametrize("records", ["1", "7"])
def test_tries_take_batches_where_nobody_meets(spark, records):
    rng = np.random.default_rng(9)
    labels = rng.integers(0, 1 << 16, (60, 4, 6)).astype(">u2")
    labels[50:, 2] = labels[40:50, 2]
    rows = [(i, x.tobytes()) for i, x in enumerate(labels)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    try:
        forest = ngram_join.Forest(spark.createDataFrame(rows, "rid long, labels binary"), 4, 6, 5)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    groups = defaultdict(set)
    for r in forest.at(5).collect():
        groups[r["group"]].add(r["rid"])
    assert sorted(sorted(g) for g in groups.values() if len(g) > 1) == [[i, i + 10] for i in range(40, 50)]


def test_join_takes_small_batches(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = pdf(ngram_join.join(docs))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert Counter((int(r.doc_id), int(r.class_id), r.links) for r in got.itertuples()) == brute_join([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_join_finds_pairs_that_share_no_five_values(spark):
    docs = []
    for k in (1896, 2612, 3576, 13375):  # the ones of 20,000 such pairs, of 50 in 62 shingles, that share five values in no tree
        words = [f"w{k}x{i}" for i in range(60)]
        docs += [(k, " ".join(words)), (20_000 + k, " ".join([*words[:30], "other", "words", *words[32:]]))]
    got = pdf(ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string")))
    assert Counter((int(r.doc_id), int(r.class_id), r.links) for r in got.itertuples()) == brute_join(docs)


def test_ngram_join_without_ids(spark):
    base = [prose(np.random.default_rng(k), 100) for k in range(3)]
    rows = [(None, base[0]), (None, base[0]), (None, base[0] + " end"), (7, base[0] + " other"), (None, base[1]), (None, base[1] + " end"), (7, base[2]), (8, base[2] + " end"), (None, ""), (None, None), (9, ""), (9, "")]
    docs = common.stored(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "without-ids")
    none = lambda x: None if pd.isna(x) else int(x)
    got = Counter((none(r.doc_id), none(r.class_id), r.links) for r in pdf(ngram_join.join(docs)).itertuples())
    assert got == Counter({(None, 7, 3): 3, (7, 7, 3): 1, (None, None, 1): 2, (7, 7, 1): 1, (8, 7, 1): 1, (None, None, 0): 2, (9, 9, 0): 2})
    kept = [(r.doc_id, r.text) for r in ngram_join.keep_one(docs).collect()]
    assert sum(i is None and (t or "").startswith(base[1]) for i, t in kept) == 1
    assert Counter(i for i, t in kept if t) == Counter({7: 2, None: 1}) and sum(not t for _, t in kept) == 4


def test_least_depth_reaches_the_recall():
    d = ngram_join.least_depth()
    assert ngram_join.met(0.8, d) >= ngram_join.RECALL and (d == ngram_join.DEPTH or ngram_join.met(0.8, d + 1) < ngram_join.RECALL)


def test_quote_linking(spark):
    rows = [
        (1, 0, "u", "Hello there.\nSecond line of it.\n\nThird para."), (1, 1, "a", "> Hello there.\n> Second line\n> of it.\nI agree."),
        (1, 2, "b", "On Monday, X wrote:\n> > Hello there.\n> I agree.\nMe too"), (1, 3, "c", "new topic"), (2, 0, "x", None), (2, 1, "y", ">> I agree.\n> nothing"),
        (None, 1, "z", "> Hello there."), (1, 3, "c", "new topic"), (3, 0, "q", ""),
    ]
    got = pdf(quoting.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert len(got) == len(rows)
    at = {(r.conv_id, r.turn): r for r in got.itertuples()}
    assert at[(1, 1)].parent_turn == 0 and at[(1, 1)].text == "I agree." and at[(1, 2)].parent_turn == 1 and at[(1, 2)].text == "Me too"
    assert (at[(1, 2)].depth, at[(1, 2)].thread_root, at[(1, 2)].n_quotes, at[(1, 2)].n_linked) == (2, 0, 2, 2)
    assert pd.isna(at[(1, 3)].parent_turn) and at[(1, 3)].thread_root == 3 and pd.isna(at[(2, 1)].parent_turn) and at[(1, 0)].text == rows[0][3]
    assert pdf(quoting.link(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).empty


def test_quotes_from_elsewhere_stay(spark):
    rows = [
        (1, 0, "u", "A line of mine.\nAnother one."), (1, 1, "a", "On Monday, X wrote:\n> A line of mine.\n> From a book.\n\nI see.\n> all of it unknown\nEnd."),
        (1, 2, "b", "> > A line of mine.\n> > Another one.\n> I see.\n>\nYes.\n\n\n\nNo."), (2, 0, "u", "> quoted from nowhere"), (2, 1, "u", ">"), (2, 2, "u", "w " * 40_000 + "\n> x"), (2, 3, "u", "> " + "w " * 40_000 + "\nok"),
    ]
    frame = spark.createDataFrame([(*r, 7, "p") for r in rows], "conv_id long, turn long, role string, text string, position int, found string")
    at = {(r.conv_id, r.turn): r for r in pdf(quoting.link(frame)).itertuples()}
    assert at[(1, 1)].text == "On Monday, X wrote:\n> From a book.\n\nI see.\n> all of it unknown\nEnd." and at[(1, 1)].parent_turn == 0
    assert at[(1, 2)].text == "Yes.\n\nNo." and (at[(1, 2)].n_quotes, at[(1, 2)].n_linked, at[(1, 2)].parent_turn) == (2, 2, 1)
    assert at[(2, 0)].text == "> quoted from nowhere" and at[(2, 1)].text == ">" and at[(2, 3)].text == "ok" and at[(2, 3)].parent_turn == 2


def brute_links(rows):
    """parent_turn and n_linked of each row, by going through all earlier messages of its conversation."""
    norm = lambda lines: " ".join(" ".join(lines).casefold().split())

    def passages(lines):
        parts = [[line for line in p if line.strip()] for blank, p in itertools.groupby(lines, lambda x: not x.strip()) if not blank]
        return norm(lines), [(norm(p), [norm([x]) for x in p]) for p in parts]

    def known(conv, turn, words):
        for c, t, _, text in sorted((r for r in rows if r[0] == conv and r[1] < turn), key=lambda r: r[1]):
            whole, parts = passages([line for level, line in quoting.split_levels(text) if level == 0])
            if words in [whole, *[p for p, _ in parts], *[x for _, lines in parts for x in lines]]:
                return t
        return None

    out = {}
    for conv, turn, _, text in rows:
        found = []
        for level, block in itertools.groupby(quoting.split_levels(text), lambda x: x[0]):
            if not level:
                continue
            whole, parts = passages([line for _, line in block])
            if (t := known(conv, turn, whole)) is not None and whole:
                found.append((level, t))
                continue
            for p, lines in parts:
                if (t := known(conv, turn, p)) is not None:
                    found.append((level, t))
                else:
                    found += [(level, t) for x in dict.fromkeys(lines) if (t := known(conv, turn, x)) is not None]
        out[(conv, turn)] = (max((t for level, t in found if level == 1), default=None), len(found))
    return out


def test_quotes_against_brute_force(spark):
    rng, rows = np.random.default_rng(12), []
    for conv in range(12):
        said = []
        for turn in range(12):
            lines = []
            for _ in range(int(rng.integers(1, 5))):
                if said and rng.random() < 0.6:
                    source = said[rng.integers(0, len(said))]
                    lines += [">" * int(rng.integers(1, 3)) + " " + x for x in source[: int(rng.integers(1, len(source) + 1))]]
                    lines += [">"] * int(rng.random() < 0.3)
                else:
                    lines += [str(rng.choice(WORDS)) + " " + str(rng.choice(WORDS[:4])), ""][: int(rng.integers(1, 3))]
            rows.append((conv, turn, "u", "\n".join(lines)))
            said.append(lines)
    got = pdf(quoting.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)))
    assert {(r.conv_id, r.turn): (None if pd.isna(r.parent_turn) else int(r.parent_turn), r.n_linked) for r in got.itertuples()} == brute_links(rows)
    for r in got.itertuples():
        if not pd.isna(r.parent_turn):
            up = got[(got["conv_id"] == r.conv_id) & (got["turn"] == r.parent_turn)].iloc[0]
            assert r.thread_root == up["thread_root"] and r.depth == up["depth"] + 1
    order = got.sort_values(["conv_id", "position"])
    assert (order.groupby("conv_id").cumcount() + 1 == order["position"]).all()


def test_quotes_of_two_messages_in_one_block(spark):
    rows = [
        (1, 0, "u", "First words.\nMore of them."), (1, 1, "a", "Second words."), (1, 2, "b", "> First words.\n> Second words.\nYes."), (1, 3, "c", "> Second words.\n>\n> First words.\nNo."),
        (1, 4, "d", "> First words.\n> More of them.\nFine."), (2, 0, "u", "One."), (None, 0, "u", "x"), (None, 0, "u", "x"),
    ]
    got = quoting.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))
    at = {(r.conv_id, r.turn): r for r in pdf(got).itertuples()}
    assert [(at[(1, i)].parent_turn, at[(1, i)].n_quotes, at[(1, i)].n_linked) for i in (2, 3, 4)] == [(1, 1, 2), (1, 1, 2), (0, 1, 1)]
    order = [(r.conv_id, r.turn, r.position) for r in quoting.ordered(got).collect()]
    assert order == [(None, 0, 1), (None, 0, 2), (1, 0, 1), (1, 4, 2), (1, 1, 3), (1, 2, 4), (1, 3, 5), (2, 0, 1)]


def brute_topk(rows, k):
    held = [(n, i, [math.floor(64 * x) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for m, q, a in held:
        if q % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for n, i, b in held if n != m)[:k]
            out.update((q, r + 1, i, -s) for r, (s, i) in enumerate(best))
    return out


@pytest.mark.parametrize("sizes", [(4096, 2048), (50, 4)])  # the second: many blocks and batches
def test_topk(spark, monkeypatch, sizes):
    monkeypatch.setattr(topk, "BLOCK", sizes[0])
    monkeypatch.setattr(topk, "BATCH", sizes[1])
    monkeypatch.setattr(topk, "STEP", 30)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(300)]
    rows += [(300, None), (301, [None, *[1.0] * 5]), (302, [float("nan"), *[1.0] * 5]), (303, [float("inf"), *[1.0] * 5]), (None, [1.0] * 6), (304, [0.0] * 6), (305, rows[7][1]), (306, rows[7][1])]
    rows += [rows[40], (60, rows[7][1]), (400, [1e6] * 6)]  # a query row twice, another vector for a query's id, a long vector
    frame = spark.createDataFrame([(*r, 1, 2.0, [3]) for r in rows], "vec_id long, embedding array<float>, rid int, d double, v array<int>")
    exact = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    got = pdf(topk.search(frame, F.col("vec_id") % 20 == 0))
    assert Counter(map(tuple, got[["query_id", "rank", "vec_id", "score"]].to_numpy().tolist())) == brute_topk(exact, 20)
    assert pdf(topk.search(frame.limit(0), F.col("vec_id") % 20 == 0)).empty
    huge = spark.createDataFrame([(0, [2.0**40, 1.0]), (20, [2.0**40, 3.0]), (1, [1.0, -(2.0**20)])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="long"):
        topk.search(huge, F.col("vec_id") % 20 == 0)
    wide = spark.createDataFrame([(0, [2.0**24, 1.0]), (20, [2.0**24 + 0.25, 3.0]), (1, [2.0**24, -3.0]), (2, [2.0**24, -2.0])], "vec_id long, embedding array<double>")
    exact = [(r["vec_id"], r["embedding"]) for r in wide.collect()]
    got = pdf(topk.search(wide, F.col("vec_id") % 20 == 0, k=2))
    assert Counter(map(tuple, got[["query_id", "rank", "vec_id", "score"]].to_numpy().tolist())) == brute_topk(exact, 2)


def test_bounds_leave_most_pairs_of_clustered_vectors_out():
    rng = np.random.default_rng(4)
    centre = rng.integers(-400, 400, (40, 8)).astype(float)
    x = centre[rng.integers(0, 40, 4000)] + rng.integers(-3, 4, (4000, 8))
    most = float((x * x).sum(axis=1).max())
    pivots = topk.choose_pivots(x[:500])
    dx, dq = topk.distances(x, most, pivots).astype("f4"), topk.distances(x[:20], most, pivots, query=True).astype("f4")
    n = np.arange(4000)
    found, evaluated = topk.search_block(n[:20], x[:20], dq, np.full(20, -np.inf), n, n, x, np.ascontiguousarray(dx.T), most, 10)
    assert evaluated < 0.3 * 20 * 4000 and len(found) == 200
    total = 0
    for q in range(20):
        assert sorted(s for i, _, s in found if i == q) == np.sort((x @ x[q])[n != q])[-10:].astype(int).tolist()
        # what the k-th score is known to be leaves out more
        floor = np.array([min(s for i, _, s in found if i == q)], float)
        again, fewer = topk.search_block(n[q : q + 1], x[q : q + 1], dq[q : q + 1], floor, n, n, x, np.ascontiguousarray(dx.T), most, 10)
        assert sorted(again) == sorted(r for r in found if r[0] == q)
        total += fewer
    assert total <= evaluated


@pytest.mark.parametrize("prior, shift", [(0.1, -1.0), (0.4, 0.5), (0.9, -2.0), (0.9, -6.0)])
def test_risk_and_its_gradient_against_plain_sums(prior, shift):
    rng = np.random.default_rng(6)
    k, texts_p, texts_u = 7, [set(rng.choice(7, 3).tolist()) for _ in range(9)], [set(rng.choice(7, 2).tolist()) for _ in range(15)]
    matrix = lambda texts: (np.array([c for t in texts for c in sorted(t)]), np.array([i for i, t in enumerate(texts) for _ in t]), len(texts))
    w, b, decay = rng.normal(size=k), shift, 0.01

    def plain(w, b):
        f = lambda t: b + sum(w[c] for c in t)
        loss = lambda z: math.log(1 + math.exp(-z))
        mean = lambda x: sum(x) / len(x)
        rest = mean([loss(-f(t)) for t in texts_u]) - prior * mean([loss(-f(t)) for t in texts_p])
        ridge = decay / 2 * sum(x * x for x in w)
        return prior * mean([loss(f(t)) for t in texts_p]), rest, ridge

    first, rest, ridge = plain(w, b)
    value, step = toxicity.risk(w, b, matrix(texts_p), matrix(texts_u), prior, decay)
    assert value == pytest.approx(first + max(0, rest) + ridge)
    sign = 1 if rest >= 0 else -1  # below nothing that part is turned round
    for j in range(k + 1):
        e = np.zeros(k + 1)
        e[j] = 1e-5
        at = lambda d: (lambda x: x[0] + sign * x[1] + x[2])(plain(w + d[:-1], b + d[-1]))  # noqa: E731, B023
        assert step[j] == pytest.approx((at(e) - at(-e)) / 2e-5, abs=1e-7)


def test_fitting_lowers_the_risk_and_finds_planted_features():
    rng = np.random.default_rng(8)
    draw = lambda toxic: np.unique(np.append(rng.choice(np.arange(10, 60), 12), [1, 2] if toxic and rng.random() < 0.9 else [])).astype(np.uint32)
    positive, unlabelled = [draw(True) for _ in range(200)], [draw(rng.random() < 0.2) for _ in range(800)]
    model = toxicity.fit(positive, unlabelled, 0.2)
    assert min(model.weights.get(1, 0), model.weights.get(2, 0)) > max(abs(x) for f, x in model.weights.items() if f > 2)
    test = [(draw(y), y) for y in (rng.random(400) < 0.2)]
    assert np.mean([(model.of(x.tolist()) >= 0.5) == y for x, y in test]) > 0.93


def test_toxicity_as_registered(spark):
    folder = "/root/testdata/sf0.01"
    got = pdf(queries.op5_toxicity(spark, folder)).set_index("doc_id")
    docs = spark.read.parquet(f"{folder}/documents.parquet").toPandas().set_index("doc_id")
    assert sorted(got.columns) == ["held_out", "predicted", "score"] and sorted(got.index) == sorted(docs.index)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for i, r in got.iterrows())
    truth = spark.read.parquet(f"{folder}/labels.parquet").toPandas().set_index("doc_id")["toxic"]
    test = got[got["held_out"]].join(truth, how="inner")
    assert (test["predicted"] == test["toxic"]).mean() > 0.9
    # the model's own sum over a text's distinct features
    model = toxicity.Model({toxicity.features("vile")[0]: 2.0, toxicity.features("good")[0]: -1.0}, -0.5)
    assert abs(model.score("Vile vile good") - 1 / (1 + math.exp(-0.5))) < 1e-9 and abs(model.score(None) - 1 / (1 + math.exp(0.5))) < 1e-9
    assert abs(model.score("vile " * 100_000) - 1 / (1 + math.exp(-1.5))) < 1e-9


REGISTERED = {
    "op2_id_files": ("documents", {"doc_id", "start", "n_tokens", "ids_crc32"}), "op3_best_fit_packing": (None, {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}),
    "op7_quote_linking": ("conversations", {"conv_id", "turn", "parent_turn", "position", "text"}), "op8_mix_sources": ("documents", {"doc_id", "size", "source_size", "target", "taken"}),
    "op9_html_min_cut": ("pages", {"page_id", "url", "text", "n_chars"}), "op10_ngram_jaccard_join": ("documents", {"doc_id", "class_id", "links"}),
}


@pytest.mark.parametrize("name", REGISTERED)
def test_registered_queries_cover_their_tables(spark, tokenizer, name):
    folder = "/root/testdata/sf0.001"
    got, (table, columns) = pdf(queries.queries()[name](spark, folder)), REGISTERED[name]
    assert columns <= set(got.columns)
    if table:
        assert len(got) == spark.read.parquet(f"{folder}/{table}.parquet").count()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    if name == "op2_id_files":
        assert all(zlib.crc32(np.array(encode(tokenizer, docs[r.doc_id]), "<u4").tobytes()) == r.ids_crc32 for r in got.itertuples())
    if name == "op3_best_fit_packing":
        assert got.groupby("doc_id")["length"].sum().to_dict() == {i: len(encode(tokenizer, t)) for i, t in docs.items()} and got.groupby("sequence_id")["length"].sum().max() <= 1024
    if name == "op10_ngram_jaccard_join":
        assert Counter((int(r.doc_id), int(r.class_id), r.links) for r in got.itertuples()) == brute_join(list(docs.items()))


def test_registered_on_small_tables(spark):
    got = queries.op6_lm_scoring(spark, "/root/testdata/sf0.001").toPandas()
    assert json.dumps(sorted(got.columns)) == json.dumps(sorted(["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))

"""Spelling variants, fill-in-the-middle and decontamination against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, fim, queries, spelling

SF = "/root/testdata/sf0.001"
UPPER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n long, word string, segment long, term string, form string"


def frame(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "s", 0, "k", 1, "w", 2, "t", "f") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# op11


def spelled(texts, misspell=31, ids=None):
    """Every word with its near words, by trying each pair."""
    n = Counter()
    for i, text in enumerate(texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{i if ids is None else ids[i]}:{run}".encode())
            if misspell and h % misspell == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    # words with a deletion in common are the only ones that can be near
    holes = {}
    for w in n:
        for k in range(len(w)):
            holes.setdefault((k, w[:k] + w[k + 1 :]), []).append(w)
    near = {w: set() for w in n}
    for (k, x), ws in holes.items():
        for w in ws:
            near[w].update(v for v in ws if v != w)
            if x in n:
                near[w].add(x)
                near[x].add(w)
    form = {}
    for w, c in n.items():
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * c else None
    out = []
    for w, c in n.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, c, len(near[w]), None if form[w] is None else n[form[w]]))
    return sorted(out, key=str)


def got_spelled(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


@pytest.fixture(scope="module")
def misspelt():
    rng = np.random.default_rng(5)
    letters = list("abcdenorst") + ["é", "ß", "×"]
    base = ["".join(rng.choice(letters, rng.integers(7, 13))) for _ in range(30)] + ["aaaaaaaa", "abababab", "abababa", "bababab", "aaaaaaa", "aaaaaaaaa"]
    texts = []
    for _ in range(150):
        row = []
        for w in rng.choice(base, 25):
            w = list(w)
            for _ in range(rng.integers(0, 3) if rng.random() < 0.4 else 0):
                k, way = int(rng.integers(0, len(w))), rng.integers(0, 3)
                w[k : k + 1] = [[], [w[k], str(rng.choice(letters))], [str(rng.choice(letters))]][way]
            row.append("".join(w).upper() if rng.random() < 0.1 else "".join(w))
        texts.append(" ".join(row) + " 12x short ÀÉîõü_÷÷÷÷÷÷÷")
    # a chain of three forms: each ten times as frequent as the one before
    texts += ["chainword " * 2000, "chainwor " * 200, "chainwors " * 20, "hainwors " * 2]
    return texts + [None, "", "w" * 9000, "w" * 9000, "w" * 8999 + " " + "w" * 8999, texts[0], "Ààààààà àààààààà"]


@pytest.mark.parametrize("misspell", [None, 31, 3])
def test_variants_are_those_of_all_pairs(spark, misspelt, misspell):
    rows = spelling.variants(frame(spark, misspelt).repartition(5), misspell=misspell)
    want = spelled(misspelt, misspell)
    assert got_spelled(rows) == want
    assert sum(1 for r in want if r[1]) > 20 and (misspell or any(r[0] == "hainwors" and r[2] == "chainword" for r in want))


def test_variants_of_nothing(spark):
    assert spelling.variants(frame(spark, ["x"]).limit(0)).count() == 0
    assert got_spelled(spelling.variants(frame(spark, [None, "", "only words occurring once"]))) == []
    assert got_spelled(spelling.variants(frame(spark, ["nullids nullids"], [None]))) == [("nullids", None, "nullids", 2, 0, None)]


def test_only_the_rarest_bigrams_of_a_half_meet(spark):
    vocabulary = spark.createDataFrame([(f"{a}{b}common{c}", 2) for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuvwx"], "word string, n long")
    from graphloom.llm import common

    vocabulary = common.stored(vocabulary, "words")
    pairs = spelling.near_pairs(vocabulary)
    assert pairs.count() == 512 * 21 // 2  # each differs from 21 others in one letter
    assert pairs.where("a = b").count() == 0


def test_registered_variants(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert got_spelled(queries.op11_spelling_variants(spark, SF)) == spelled(list(texts.values()), 31, list(texts))


# op12


def test_units_and_places():
    rng = np.random.default_rng(2)
    for _ in range(300):
        text = "".join(rng.choice(list("ab \n\té漢🙂"), rng.integers(0, 40)))
        data = text.encode()
        by = {"chars": list(text), "words": re.findall(r"[ \t\n\x0b\x0c\r]*[^ \t\n\x0b\x0c\r]+|[ \t\n\x0b\x0c\r]+", text), "lines": re.findall(r"[^\n]*\n|[^\n]+", text)}
        for unit, units in by.items():
            mask = fim.starts(data, unit)
            assert mask.bit_count() == len(units), (text, unit)
            at = 0
            for k, x in enumerate(units):
                assert fim.select(mask, len(data), k) == at
                at += len(x.encode())
            assert fim.select(mask, len(data), len(units)) == len(data)


def filled(doc_id, text):
    text = text or ""
    n = len(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


ODD = [None, "", "x", "é", "🙂", " ", "\n\n", "<P>", "a<S>b", "x<M>", "<P", "<<S", "S><", "漢字🙂" * 50, "w" * 300_000 + "é" * 70_000, "a\x00b\x01", "same", "same", "<S<M<P>" * 3]


def test_every_text_is_cut_where_its_id_says(spark):
    texts = ODD * 4 + [f"text {i} é" for i in range(200)]
    ids = [*range(len(texts) - 1), None]
    docs = frame(spark, texts, ids)
    got = fim.transform(docs).withColumn("back", fim.restored()).collect()
    assert sorted(map(str, (tuple(r)[:6] for r in got))) == sorted(map(str, (filled(i, t) for i, t in zip(ids, texts, strict=True))))
    assert sorted(r["back"] for r in got) == sorted(t or "" for t in texts)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.transform(docs.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["words", "lines"])
def test_other_units_are_restored_too(spark, unit):
    docs = frame(spark, [t for t in ODD if t != "w"] + ["one two  three\nfour five \n\n six"] * 30)
    got = fim.transform(docs, unit, plain=0).withColumn("back", fim.restored()).collect()
    texts = {i: t or "" for i, t in ((r["doc_id"], r["text"]) for r in docs.collect())}
    for r in got:
        assert r["back"] == texts[r["doc_id"]]
        if r["form"] != "plain":
            cut = texts[r["doc_id"]][: r["prefix_chars"]], texts[r["doc_id"]][r["prefix_chars"] : r["prefix_chars"] + r["middle_chars"]]
            assert r["output"].endswith("<M>" + cut[1]) and "<P>" + cut[0] in r["output"]


# op13


def worded(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(UPPER))


def contaminated(docs, items, size=10):
    wins = {}
    for i, t in items:
        w = worded(t)
        for k in range(max(1, len(w) - size + 1) if w and i is not None else 0):
            wins.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    lengths = {len(x) for x in wins}
    out = []
    for i, t in docs:
        w = worded(t)
        hit, found = set(), set()
        for m in lengths:
            for k in range(len(w) - m + 1):
                if s := wins.get(tuple(w[k : k + m])):
                    hit.update(range(k, k + m))
                    found |= s
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return sorted(map(str, out))


def digest(rows):
    return sorted(map(str, ((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], sha(",".join(r["item_ids"])), r["contaminated"]) for r in rows.collect())))


@pytest.fixture(scope="module")
def leaks():
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(30)] + ["the"] * 30 + ["É", "Übung", "x2"]
    prose = lambda n: " ".join(rng.choice(words, n))
    items = [(i, prose(int(rng.integers(1, 30)))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "...!?"), (103, "The, THE the"), (104, items[3][1]), (None, prose(12)), (105, "the " * 14), (106, "uniqueword"), (3, prose(15))]
    docs = []
    for k in range(120):
        text = prose(int(rng.integers(0, 200)))
        if k % 3 == 0:
            for _ in range(int(rng.integers(1, 4))):
                text += "; " + str(items[int(rng.integers(0, 25))][1]).upper() + " - " + prose(5)
        docs.append((k, text))
    docs += [(200, None), (201, ""), (202, "?!"), (203, "the " * 40), (204, "long " * 5000 + items[7][1]), (205, docs[0][1]), (0, docs[3][1]), (None, items[1][1]), (206, "\x00".join(items[2][1].split())), (207, "uniqueword")]
    return docs, items


@pytest.mark.parametrize("segment, block", [(1 << 21, 50_000), (700, 50_000), (300, 40)])
def test_contamination_is_that_of_every_window(spark, leaks, monkeypatch, segment, block):
    monkeypatch.setattr(decontaminate, "SEGMENT", segment)
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    docs, items = leaks
    rows = [(*d, "en", "s", 0, "k", 1, "w", 2, "t", "f") for d in docs]
    got = decontaminate.contamination(spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame([(*i, 1, "t") for i in items], "item_id long, text string, segment long, terms string"))
    want = contaminated(docs, items)
    assert digest(got) == want
    assert sum("True" in x for x in want) > 30


def test_nothing_to_search(spark, leaks):
    docs, items = leaks
    table, none = frame(spark, [t for _, t in docs]), spark.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] for r in decontaminate.contamination(table, none).collect())
    assert decontaminate.contamination(table.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_near_matches_are_the_shortest_stretches(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(list("abcdefg"), int(rng.integers(0, 60)))) for _ in range(60)]
    phrases = {"p": ["a", "b", "c"], "q": ["a", "a", "d"], "r": ["e"], "s": ["a", "zzz"], "t": ["f", "g", "f", "a"]}
    path = decontaminate.build(frame(spark, texts).repartition(2))
    got = decontaminate.match(spark, path, spark.createDataFrame(list(phrases.items()), "phrase string, terms array<string>"), within=6)
    place = decontaminate.documents(spark, path)
    got = sorted(tuple(r) for r in got.join(place.withColumnRenamed("start", "begin"), ["segment", "ordinal"]).select("doc_id", "phrase", "kind", "start", "stop").collect())
    want = []
    for i, t in enumerate(texts):
        w = t.split()
        for p, terms in phrases.items():
            need = Counter(terms)
            want += [(i, p, "exact", k, k + len(terms)) for k in range(len(w)) if w[k : k + len(terms)] == terms]
            fits = [(a, b) for a in range(len(w)) for b in range(a + 1, min(len(w), a + 6) + 1) if not need - Counter(w[a:b])]
            want += [(i, p, "near", a, b) for a, b in fits if not any((c, d) != (a, b) and a <= c and d <= b for c, d in fits)]
    assert got == sorted(want)


def test_a_search_reads_only_its_terms(spark, leaks):
    path = decontaminate.build(frame(spark, [t for _, t in leaks[0]]))
    plan = decontaminate.postings(spark, path).where(F.col("term") == "w1")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,w1)" in plan and "doc_id" not in plan


def test_registered_cuts_and_contamination(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted(str(tuple(r)) for r in queries.op13_decontamination(spark, SF).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())
    assert got == contaminated(docs, items)
    got = sorted(str(tuple(r)) for r in queries.op12_fill_in_middle(spark, SF).collect())
    assert got == sorted(str((*filled(i, t)[:5], sha(filled(i, t)[5]), sha(t or ""))) for i, t in docs)

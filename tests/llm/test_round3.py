"""Toxicity, source divergence and spelling variants: brute force, held-out accuracy and odd inputs; the pipeline over odd rows."""

import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from test_llm import ODD, docs_of, empty_like
from tidemark.llm import common, divergence, spelling, toxicity

# ---------------------------------------------------------------- 11


def brute_terms(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode()
    out = set()
    for w in re.findall(rb"[a-z\x80-\xff]+", low):
        out.add((0, w))
        out.update((k, w[:p]) for k, p in enumerate(toxicity.PREFIXES, 1) if len(w) > p)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aBcdé_1 \n你"), max_size=30)), max_size=6))
def test_terms_are_words_and_prefixes(texts):
    names = defaultdict(set)
    for i, data, offsets in common.text_slices(pa.array(texts, pa.string())):
        d, h = toxicity.terms_of(data, offsets)
        for k in range(len(offsets) - 1):
            want = brute_terms(texts[i + k])
            got = h[d == k]
            assert len(got) == len(want) == len(set(got.tolist()))
        known = np.unique(h)[::2]
        d2, at = toxicity.terms_of(data, offsets, known)
        assert list(zip(d2.tolist(), known[at].tolist(), strict=True)) == [(a, b) for a, b in zip(d.tolist(), h.tolist(), strict=True) if b in set(known.tolist())]
    assert not names


def test_machine_sums_pairs_as_by_the_definition():
    rng = np.random.default_rng(1)
    m = toxicity.Machine(np.arange(6), 0.3, rng.normal(size=6), rng.normal(size=(6, 3)))
    rows = [[], [2], [0, 3, 5], [0, 1, 2, 3, 4, 5]]
    idx, at = np.concatenate([np.array(r, int) for r in rows]), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    want = [0.3 + sum(m.w[i] for i in r) + sum(m.v[i] @ m.v[j] for i in r for j in r if i < j) for r in rows]
    assert np.allclose(m.logits(idx, at), want)


def test_machine_learns_what_only_pairs_tell():
    rows = [np.array(r) for r in ([0, 1], [0], [1], [2], [0, 1, 2], [0, 2], [1, 2])] * 40
    y = np.array([1.0 if 0 in r and 1 in r else 0.0 for r in rows])
    m = toxicity.fit(np.arange(3), rows, y, epochs=60)
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    assert ((m.logits(np.concatenate(rows), at) > 0) == (y == 1)).all()
    assert m.v[0] @ m.v[1] > 1
    again = toxicity.fit(np.arange(3), rows, y, epochs=60)
    assert np.array_equal(m.v, again.v) and m.w0 == again.w0


def test_toxicity_on_documents_it_has_not_seen(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (common.table(spark, folder, n) for n in ("documents", "labels"))
    got = toxicity.score(docs, labels)
    held = got.where("held_out").join(labels.select("doc_id", "toxic"), "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in held}
    assert n[1, 1] >= 0.88 * (n[1, 1] + n.get((1, 0), 0))  # six in a hundred of these labels stand at texts without any of the words
    assert n[0, 0] >= 0.99 * (n[0, 0] + n.get((0, 1), 0))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.limit(200).collect())


def test_toxicity_of_odd_rows(spark, sf):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(40)] + [(0, 1, "x"), (1, None, "x"), (None, 1, "x")], "doc_id long, toxic int, text string")
    docs = docs_of(spark, ODD + [f"plain words {'awful' if i % 2 else 'lovely'} more" for i in range(40)], [*range(100, 100 + len(ODD)), *range(39), None])
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(ODD) + 40 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[100] == by[101] == by[102]  # no terms
    assert sorted(map(str, got)) == sorted(map(str, toxicity.score(docs, labels).collect()))
    assert toxicity.score(empty_like(docs), labels).count() == 0
    assert {r.score for r in toxicity.score(docs, empty_like(labels)).collect()} == {0.5}
    ones = toxicity.score(docs, labels.where("toxic = 1")).collect()
    assert len({r.score for r in ones}) == 1 and ones[0].score > 0.9


# ---------------------------------------------------------------- 12


def brute_audit(rows, top=200):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t in df if df[t] >= 3)
        n = defaultdict(Counter)
        for _, s, words in mine:
            n[s].update(w for w in words if df[w] >= 3)
        share = lambda c, k=kept: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(k)) for t in k}
        p = {s: share(c) for s, c in n.items()}
        q = share(sum(n.values(), Counter()))
        for s in p:
            pairs = [(-sum((p[s][t] - p[b][t]) ** 2 // p[b][t] for t in kept), b) for b in p if b != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t) for t in kept if n[s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, item, -v, k) for k, (v, item) in enumerate(found, 1)]
    return Counter(out)


def audited(docs, **kw):
    return Counter(tuple(r) for r in divergence.audit(docs, **kw).collect())


@pytest.mark.parametrize("share", [0.0, 0.25, 2.0])
def test_divergence_is_the_same_for_any_split(spark, share):
    rng = np.random.default_rng(3)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)] + ["ü", "Ärger", "你好"]
    rows = [(["en", "de", None][i % 3], f"s{int(rng.integers(0, 7))}" if i % 11 else None, " ".join(rng.choice(words, int(rng.integers(0, 40))))) for i in range(120)]
    rows += [("one", "alone", "a a b"), ("few", "x", "only here"), ("few", "y", None), ("few", "z", "")]
    docs = spark.createDataFrame([(1, t, lang, s, "x", 3, 4) for lang, s, t in rows], "doc_id long, text string, lang string, source string, term string, n long, p0 long")
    assert audited(docs, dense_share=share, tile_terms=7, tile_groups=3, top=20) == brute_audit(rows, 20)


def test_divergence_of_odd_rows(spark):
    docs = docs_of(spark, ODD * 3, sources=["a", None, ""] * len(ODD))
    assert audited(docs) == brute_audit([(r.lang, r.source, r.text) for r in docs.collect()])
    assert divergence.audit(empty_like(docs)).count() == 0


def test_shares_of_great_counts_are_exact(spark):
    rows = [(10**18, 3 * 10**18, 7), (0, 0, 0), (5, 9 * 10**17, 10**9)]
    got = spark.createDataFrame(rows, "c long, t long, k long").select("c", "t", "k", divergence.share(*map(__import__("pyspark").sql.functions.col, "ctk")).alias("p")).collect()
    assert all(r.p == (1 + 10**9 * (r.c + 1) // (r.t + r.k) if r.k else None) for r in got)


# ---------------------------------------------------------------- 13


def brute_counts(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n):
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {w: min(v, key=lambda x: (-n[x], x)) if (v := near[w]) else None for w in n}
    form = {w: f if f and n[f] >= 10 * n[w] else None for w, f in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return Counter((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def test_variants_by_all_distances(spark):
    rng = np.random.default_rng(5)
    base = ["straßenfest", "BALLOON", "aaaaaaa", "übermorgen", "tigernacht", "mississippi"]
    words = []
    for w in base:
        words += [w] * 400
        for _ in range(12):
            k, c = int(rng.integers(0, len(w))), rng.choice(list("abtsßé"))
            words += [rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :], w[:k] + c + w[k:]])] * int(rng.integers(1, 30))
    words += [w + "x" + w for w in base for _ in range(3)] + ["y" * 3000] * 2 + ["y" * 3001] * 40 + ["short", "x÷yzzzzz", "x÷yzzzzz"]
    rng.shuffle(words)
    texts = [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)] + ODD
    docs = docs_of(spark, texts, [None if i == 3 else i // 2 for i in range(len(texts))])
    n = brute_counts([(r.doc_id, r.text) for r in docs.collect()])
    got = Counter(tuple(r) for r in spelling.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert got == brute_variants(n)
    assert any(r[1] and r[1] != r[2] for r in got) or any(r[1] for r in got)
    assert spelling.variants(empty_like(docs)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="abñß", min_size=1, max_size=9), min_size=1, max_size=5, unique=True))
def test_neighbourhood_is_full_and_distinct(words):
    alphabet = np.array(sorted({ord(c) for w in words for c in w} | {ord("a")}), np.uint8)
    got = Counter()
    for places, found in spelling.neighbours(pa.array(words), alphabet):
        got.update(zip([words[p] for p in places], found.to_pylist(), strict=True))
    letters = [chr(c) for c in alphabet]
    want = set()
    for w in words:
        for i in range(len(w) + 1):
            want |= {(w, w[:i] + c + w[i:]) for c in letters}
            if i < len(w):
                want |= {(w, w[:i] + c + w[i + 1 :]) for c in letters if c != w[i]} | ({(w, w[:i] + w[i + 1 :])} if len(w) > 1 else set())
    assert set(got) == want and set(got.values()) <= {1}
    bits = np.zeros(16, np.uint64)
    table = spelling.Table(bits)
    for probe in range(spelling.PROBES):
        at = spelling._bits(spelling.hashes(pa.array(words)), probe, table.bits)
        np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(int), np.uint64(1) << (at & np.uint64(63)))
    passed = {x for places, found in spelling.neighbours(pa.array(words), alphabet, table) for x in found.to_pylist()}
    assert {x for w, x in want if x in words} <= passed  # no word is ruled out


def test_chains_end_at_their_root(spark):
    chain = [f"w{k:03d}" for k in range(40)]
    got = {r.word: r.root for r in spelling._roots(spark.createDataFrame(list(pairwise(chain)), "word string, root string")).collect()}
    assert got == {w: chain[-1] for w in chain[:-1]}


# ---------------------------------------------------------------- the pipeline


def test_pipeline_over_odd_rows(spark, tmp_path):
    import corpus_pipeline

    texts = ODD + [f"many different words number {chr(97 + i)} stand in this sentence about the {w}" for i, w in enumerate(("river", "house", "garden", "river"))] * 2
    docs = docs_of(spark, texts, [None if i % 5 == 0 else i // 2 for i in range(len(texts))], [None if i % 3 == 0 else "a" for i in range(len(texts))])
    for name, df in (("documents", docs), ("benchmark", spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")), ("labels", spark.createDataFrame([(1, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    rows = out.collect()
    assert 0 < len(rows) <= len(texts) and {"doc_id", "size", "taken"} <= set(out.columns)
    empty = tmp_path / "empty"
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").where("false").write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
    assert not math.isnan(sum(r.taken for r in rows))

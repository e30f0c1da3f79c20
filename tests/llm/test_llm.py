"""The operators of the training-data pipeline: SQL or brute force on the smallest tables, and odd inputs."""

import base64
import hashlib
import math
import os
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import chat, common, decontamination, embedding_dedup, licenses, mixing, ngram_lm, quality, queries, simhash, token_counts, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, fp string, row string, shard string, _lost long, h string, _id string, n long, y string, terms string, word string, term string"


def docs_of(spark, texts, ids=None, sources=None):
    """Documents with more columns, whose names operators might use themselves."""
    ids = ids or list(range(len(texts)))
    rows = [(i, t, "en", s, 0, "x", "y", "z", "w", 1, "h", "i", 7, "q", "t", "v", "u") for i, t, s in zip(ids, texts, sources or ["a"] * len(texts), strict=True)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", "   \n\t ", "one", "One two", "the same text as another row of this table here", "the same text as another row of this table here", "déjà vu ÄÖ ß", "x" * 50_000, "very long " * 30_000]


def empty_like(df):
    return df.where("false")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(name, spark, sf, same_rows):
    same_rows(queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name])


# ---------------------------------------------------------------- tokenising


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aB é_ß1.\n\t\x0b你"), max_size=12), max_size=8))
def test_words_and_their_hashes(texts):
    import pyarrow as pa

    got = []
    for _, data, offsets in common.text_slices(pa.array(texts, pa.string())):
        data = common.LOWER[data]
        for table, pattern in ((common.NOT_SPACE, r"[^\x20\x09-\x0D]+"), (common.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
            s, e, first = common.words(data, offsets, table)
            h = common.word_hashes(data, s, e)
            low = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in texts]
            want = [re.findall(pattern, t) for t in low]
            got = [[bytes(data[s[k] : e[k]]).decode() for k in range(first[i], first[i + 1])] for i in range(len(offsets) - 1)]
            assert got == want
            by = defaultdict(set)
            for w, x in zip([w for d in want for w in d], h.tolist(), strict=True):
                by[x].add(w)
            assert all(len(v) == 1 for v in by.values()) and len(by) == len({w for d in want for w in d})


# ---------------------------------------------------------------- 1


def test_warc_round_trip_with_copies_and_odd_rows(spark):
    rows = [(5, "http://a/b c", "same"), (3, "http://x", "same"), (9, None, "same"), (1, "u", ""), (2, "u", None), (None, "u", "alone"), (7, "ü", "ß" * 9000), (3, "http://x", "same")]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, path string")
    index = warc.write(pages)
    got = warc.read(index).collect()
    low = {"same": 3, "": 1, "alone": None, "ß" * 9000: 7}
    want = []
    for i, _, h in rows:
        h = h or ""
        refers = None if low[h] is None or low[h] == i else low[h]
        want.append((i, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if refers is None else "revisit", refers))
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    assert all(r.payload == ("" if r.record_type == "revisit" else next((h or "") for i, _, h in rows if i == r.page_id and ((h or "") == "alone") == (i is None))) for r in got if r.page_id not in (1, 2, 3))
    some = warc.read(index.where("page_id = 7")).collect()
    assert len(some) == 1 and some[0].payload == "ß" * 9000
    assert warc.read(warc.write(empty_like(pages))).count() == 0


def test_warc_small_payloads_stay_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.read(warc.write(pages, min_bytes=3)).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


@given(st.lists(st.tuples(st.integers(1, 200_000), st.integers(0, 300_000)), max_size=30))
def test_ranges_cover_every_record_once(gaps):
    offset, length, at = [], [], 0
    for n, gap in gaps:
        offset.append(at)
        length.append(n)
        at += n + gap
    runs = warc.ranges(np.array(offset, np.int64), np.array(length, np.int64))
    assert [k for i, j in runs for k in range(i, j)] == list(range(len(gaps)))


# ---------------------------------------------------------------- 2


def test_token_totals_against_brute_force(spark, sf):
    import public_tokenizers

    bpe = token_counts._bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    want = defaultdict(lambda: [0, 0])
    for r in common.table(spark, sf, "documents").collect():
        for v, f in (("words@1", lambda t: len(t.split())), ("byte_bpe_50k@1", bpe)):
            w = want[r.source, r.lang, v]
            w[0] += 1
            w[1] += f(r.text)
    got = {(r.source, r.lang, r.tokenizer): [r.docs, r.tokens] for r in token_counts.op2_token_counts(spark, sf).collect()}
    assert got == dict(want)


def test_rollup_commits_once_and_compacts(spark):
    kind = "kind string, old struct<source:string,lang:string,tokenizer:string,tokens:long>, new struct<source:string,lang:string,tokenizer:string,tokens:long>"
    roll = token_counts.Rollup(spark, common.new_path(spark, "t"))
    change = lambda *rows: spark.createDataFrame(list(rows), kind)
    first = change(("insert", None, ("a", "en", "w", 5)), ("insert", None, (None, None, "w", 2)))
    assert roll.totals().count() == 0
    assert roll.commit("1", first) and not roll.commit("1", first)
    roll.commit("2", change(("revise", ("a", "en", "w", 5), ("b", "en", "w", 7)), ("delete", (None, None, "w", 2), None)))
    want = [("b", "en", "w", 1, 7)]
    assert [tuple(r) for r in roll.totals().collect()] == want
    roll.compact()
    assert roll.committed() == ["1", "2"] and not roll.commit("2", first)
    assert [tuple(r) for r in roll.totals().collect()] == want
    roll.compact()  # nothing new
    assert roll.committed() == ["1", "2"] and [tuple(r) for r in roll.totals().collect()] == want
    with pytest.raises(Exception, match="unknown kind"):
        roll.commit("3", change(("replace", None, ("a", "en", "w", 5))))
    assert token_counts.count(empty_like(docs_of(spark, ODD)), {"w": None}).count() == 0
    got = token_counts.count(docs_of(spark, ODD), {"w": None}).orderBy("doc_id").collect()
    assert [r.tokens for r in got] == [len((t or "").split()) for t in ODD]


def test_rollup_survives_what_breaks_off(spark):
    kind = "kind string, old struct<source:string,lang:string,tokenizer:string,tokens:long>, new struct<source:string,lang:string,tokenizer:string,tokens:long>"
    folder = common.new_path(spark, "t")
    roll = token_counts.Rollup(spark, folder)
    fs, _ = token_counts._fs(spark, folder)
    path = spark._jvm.org.apache.hadoop.fs.Path
    put = lambda name, n: roll.commit(name, spark.createDataFrame([("insert", None, (name, "en", "w", n))], kind))
    totals = lambda: {r.source: r.tokens for r in roll.totals().collect()}
    put("1", 5)
    put("2", 7)
    want = {"1": 5, "2": 7}
    saved = common.new_path(spark, "t")
    copy = lambda a, b: spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, path(a), fs, path(b), False, spark.sparkContext._jsc.hadoopConfiguration())
    for b in ("1", "2"):
        copy(f"{folder}/batch-{b}", f"{saved}/batch-{b}")
    roll.compact()
    for b in ("1", "2"):  # broken off after its write and before its deletes: the batches lie beside the generation
        copy(f"{saved}/batch-{b}", f"{folder}/batch-{b}")
    assert totals() == want and roll.committed() == ["1", "2"]
    roll.compact()
    assert totals() == want and not put("1", 5)
    put("3", 1)
    want["3"] = 1
    roll.totals().write.parquet(f"{folder}/sums-2")  # broken off before the names
    assert totals() == want
    spark.range(0).selectExpr("cast(id as string) batch").write.parquet(f"{folder}/names-2")
    fs.delete(path(f"{folder}/names-2/_SUCCESS"), False)  # while the names were written
    assert totals() == want and roll.committed() == ["1", "2", "3"]
    roll.compact()
    assert totals() == want and roll.committed() == ["1", "2", "3"]
    copy(f"{saved}/batch-1", f"{folder}/batch-4")
    fs.delete(path(f"{folder}/batch-4/_SUCCESS"), False)  # a batch that broke off doesn't count and is written anew
    assert totals() == want and put("4", 2) and totals() == want | {"4": 2}


# ---------------------------------------------------------------- 3


def test_decontamination_in_blocks_and_odd_rows(spark, monkeypatch):
    passage = " ".join(f"w{i}" for i in range(14))
    bench = spark.createDataFrame([(1, passage), (2, "short item"), (2, "w1 again"), (3, None), (None, "nameless thing"), (4, "..."), (10, passage + " more")], "item_id long, text string")
    texts = [*ODD, "before " + passage.upper() + " after", "a Short-ITEM, here", passage[: len(passage) // 2], "nameless thing", "x w1 again y short item"]
    docs = docs_of(spark, texts)
    want = {10: (16, 14, "1,10"), 11: (4, 2, "2"), 13: (2, 2, ""), 14: (6, 4, "2")}

    def check():
        got = {r.doc_id: r for r in decontamination.summary(decontamination.scan(docs, bench)).collect()}
        assert len(got) == len(texts)
        for i, r in got.items():
            n, hit, ids = want.get(i, (r.n_words, 0, ""))
            assert (r.n_words, r.n_hit, r.items_sha256, r.contaminated) == (n, hit, hashlib.sha256(ids.encode()).hexdigest(), hit > 0), i
        assert got[10].longest_words == 14 and got[10].longest_at == 1

    check()
    kept = decontamination.decontaminate(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(len(texts))) - set(want)
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 30)
    check()
    monkeypatch.undo()
    assert decontamination.scan(empty_like(docs), bench).count() == 0
    assert decontamination.decontaminate(docs, empty_like(bench)).count() == len(texts)
    assert {r.n_hit for r in decontamination.summary(decontamination.scan(docs, empty_like(bench))).collect()} == {0}


# ---------------------------------------------------------------- 4


def test_embedding_groups_against_brute_force(spark, monkeypatch):
    r = np.random.default_rng(2)
    base = r.standard_normal((6, 16))
    x = [b + 0.03 * r.standard_normal(16) for b in base for _ in range(25)] + [3 * base[0]] * 3
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, x[0].tolist(), None), (904, [1.0, None], 1), (905, [], 0), (906, [1e200, 1e200], 0), (907, [1e-200, 1e-200], 0), (3, x[3].tolist(), 1)]
    df = spark.createDataFrame([(*v, "k") for v in rows], "vec_id long, embedding array<double>, label int, key string")
    ok = [(i, np.array(v), lab) for i, v, lab in rows if v and lab is not None and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    unit = [v / abs(v).max() / np.linalg.norm(v / abs(v).max()) for _, v, _ in ok]
    link = [[b for b in range(len(ok)) if a != b and ok[a][2] == ok[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93] for a in range(len(ok))]
    want = Counter()
    for a in range(len(ok)):
        seen, todo = {a}, [a]
        while todo:
            for b in link[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        low = min(ok[b][0] for b in seen)
        want[ok[a][0], len(link[a]), low, ok[a][0] == low] += 1
    for i in (900, 901, 902, 903, 904, 905):
        want[i, 0, i, True] += 1
    assert Counter(map(tuple, embedding_dedup.groups(df).collect())) == want
    monkeypatch.setattr(embedding_dedup, "CHUNK", 7)  # hot buckets are cut into blocks
    assert Counter(map(tuple, embedding_dedup.groups(df).collect())) == want
    assert embedding_dedup.groups(empty_like(df)).count() == 0


def test_hashing_finds_pairs_at_the_limit():
    r = np.random.default_rng(3)
    a = r.standard_normal((3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    n = r.standard_normal(a.shape)
    n -= (n * a).sum(1, keepdims=True) * a
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    b = 0.93 * a + math.sqrt(1 - 0.93**2) * n
    found = (embedding_dedup.signatures(a) == embedding_dedup.signatures(b)).any(1).mean()
    assert found >= 0.93


# ---------------------------------------------------------------- 5


def test_licenses_inherit_from_the_nearest_directory(spark):
    rows = [
        (1, "/r/LICENSE", "Released under the MIT License."),
        (2, "/r/a/LICENSE", "Licensed under the Apache License, Version 2.0."),
        (3, "/r/a/b/code", "nothing here"),
        (4, "/r/c/code", "int main; a licence is not named"),
        (5, "/other/code", None),
        (6, "/r/a/own", "words first.\nThis work is licensed under the GNU General Public License, version 3. And then a lot of other words follow it here"),
        (7, "/r/a/b/code", ""),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, path string, text string, row int")
    got = {r.doc_id: (r.own_license, r.license, r.inherited_from) for r in licenses.scan(df).collect()}
    assert got == {
        1: ("MIT", "MIT", None), 2: ("Apache-2.0", "Apache-2.0", None), 3: (None, "Apache-2.0", "/r/a"), 4: (None, "MIT", "/r"), 5: (None, None, None), 6: ("GPL-3.0", "GPL-3.0", None), 7: (None, "Apache-2.0", "/r/a"),
    }
    assert licenses.scan(empty_like(df)).count() == 0


LICENSE_FILES = "/usr/share/common-licenses"


def test_every_template_finds_itself(spark):
    rows = [(i, f"/{i}/x", text, name) for i, (name, text) in enumerate(licenses.TEMPLATES)]
    # wrapped and behind marks of comments, as in the head of a source file
    rows += [(1000 + i, f"/{i}/y", "\n".join(f" * {x}" for p in text.split("\n\n") for x in [*textwrap.wrap(p, 60, break_on_hyphens=False), ""]), name) for i, (name, text) in enumerate(licenses.TEMPLATES)]
    rows = [r for r in rows if (r[3], licenses.TEMPLATES[r[0] % 1000][1]) != ("BSD-3-Clause", licenses._BSD)]  # by itself this is the two-clause licence
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string, name string")).collect()
    assert all(r.own_license == licenses.TEMPLATES[r.doc_id % 1000][0] and r.own_score >= 0.9 and r.is_license_file for r in got), [r for r in got if r.own_license != licenses.TEMPLATES[r.doc_id % 1000][0]]


def test_license_files_as_they_are_found(spark):
    full = {"MIT": "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + next(t for n, t in licenses.TEMPLATES if n == "MIT" and t.startswith("Permission")), "BSD-2-Clause": "Copyright 2019 B. Person\nAll rights reserved.\n\n" + next(t for n, t in licenses.TEMPLATES if n == "BSD-2-Clause")}
    clause = next(t for n, t in licenses.TEMPLATES if n == "BSD-3-Clause" and t.startswith("Neither"))
    full["BSD-3-Clause"] = full["BSD-2-Clause"].replace("THIS SOFTWARE", f"3. {clause}\n\nTHIS SOFTWARE")
    for name, path in (("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-3.0", "LGPL-3"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")):
        if os.path.exists(f"{LICENSE_FILES}/{path}"):
            full[name] = open(f"{LICENSE_FILES}/{path}", encoding="utf-8", errors="replace").read()
    wrap = lambda t: "\n\n".join(textwrap.fill(p, 70) for p in t.split("\n\n"))
    rows = [(i, f"/{n}/LICENSE", wrap(t) if n in ("MIT", "BSD-2-Clause", "BSD-3-Clause") else t, n) for i, (n, t) in enumerate(full.items())]
    rows += [(100 + i, f"/{n}/src/deep/code.c", "int main;", n) for i, n in enumerate(full)]
    got = {(r.doc_id, r.license, r.inherited_from) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string, name string")).collect()}
    assert got == {(i, n, None) for i, n in enumerate(full)} | {(100 + i, n, f"/{n}") for i, n in enumerate(full)}


def test_license_ties_repeated_rows_and_long_texts(spark):
    mit, bsd = "Released under the MIT License.", "SPDX-License-Identifier: BSD-3-Clause"
    rows = [
        (1, "/a/x", f"{mit}\n{mit}"), (1, "/a/x", f"{mit}\n{mit}"), (None, "/a/y", None), (3, "/b/LICENSE", mit), (4, "/b/COPYING", bsd), (5, "/b/z", ""), (6, "/c/z", "prose and more of it. " * 20_000 + mit), (7, "/c/w", "x" * 100_000),
    ]
    got = Counter((r.doc_id, r.own_license, r.license, r.inherited_from, r.is_license_file) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect())
    assert got == Counter({
        (1, "MIT", "MIT", None, True): 2, (None, None, "MIT", "/a", False): 1, (3, "MIT", "MIT", None, True): 1, (4, "BSD-3-Clause", "BSD-3-Clause", None, True): 1,
        (5, None, "BSD-3-Clause", "/b", False): 1, (6, "MIT", "MIT", None, False): 1, (7, None, None, None, False): 1,
    })


# ---------------------------------------------------------------- 6


def test_targets_share_what_is_above():
    assert mixing.targets([100, 100], [1, 1], 200) == [100, 100]
    assert mixing.targets([10, 1000], [5, 1], 1010) == [30, 980]
    assert mixing.targets([], [], 0) == [] and mixing.targets([0, 50], [5, 1], 50) == [0, 50]


def test_flow_prefers_first_passes():
    sent = [sum(x.values()) for x in mixing.min_cost_flow([((0,), 100), ((0, 1), 100), ((1,), 100)], [150, 250])]
    assert sum(sent) == 400 and min(sent) == 100  # no pattern is passed over while another is repeated twice
    assert mixing.min_cost_flow([((0,), 10), ((0, 1), 10), ((1,), 10)], [10, 20]) == [{0: 10}, {0: 0, 1: 10}, {1: 10}]
    assert mixing.min_cost_flow([((0,), 10)], [100]) == [{0: 30}] and mixing.min_cost_flow([((), 10)], [5]) == [{}]


def brute_flow(patterns, quotas, costs=mixing.PASS_COST):
    """Words and cost of the cheapest full flow, word by word along the cheapest path (Bellman-Ford)."""
    n, m = len(patterns), len(quotas)
    cap, price = defaultdict(int), {}
    for i, (of, size) in enumerate(patterns):
        for k, c in enumerate(costs):
            cap["S", (i, k)], price["S", (i, k)] = size, c
            cap[(i, k), ("p", i)], price[(i, k), ("p", i)] = size, 0
        for s in of:
            cap[("p", i), ("s", s)], price[("p", i), ("s", s)] = 10**9, 0
    for s in range(m):
        cap[("s", s), "T"], price[("s", s), "T"] = quotas[s], 0
    for (x, y), c in list(price.items()):
        price[y, x] = -c
    words = cost = 0
    while True:
        dist, via = {"S": 0}, {}
        for _ in range(3 * n + m + 3):
            for (x, y), c in price.items():
                if cap[x, y] > 0 and x in dist and dist[x] + c < dist.get(y, 1e18):
                    dist[y], via[y] = dist[x] + c, x
        if "T" not in dist:
            return words, cost
        words, cost, y = words + 1, cost + dist["T"], "T"
        while y != "S":
            x = via[y]
            cap[x, y] -= 1
            cap[y, x] += 1
            y = x


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 2)), st.integers(0, 4)), max_size=4), st.lists(st.integers(0, 9), min_size=3, max_size=3))
def test_flow_is_the_cheapest_full_one(patterns, quotas):
    patterns = [(tuple(sorted(of)), size) for of, size in patterns]
    sent = mixing.min_cost_flow(patterns, quotas)
    assert all(sum(x[s] for x in sent if s in x) <= q for s, q in enumerate(quotas)) and all(v >= 0 for x in sent for v in x.values())
    whole = [sum(x.values()) for x in sent]
    assert all(t <= 3 * size for t, (_, size) in zip(whole, patterns, strict=True))
    cost = sum(c * min(max(t - k * size, 0), size) for t, (_, size) in zip(whole, patterns, strict=True) for k, c in enumerate(mixing.PASS_COST))
    assert (sum(whole), cost) == brute_flow(patterns, quotas)


def test_flow_of_many_patterns():
    import itertools

    patterns = [(x, 50 + 7 * i % 31) for i, x in enumerate(c for k in (1, 2, 3, 4) for c in itertools.combinations(range(22), k))][:9000]
    total = sum(size for _, size in patterns)
    sent = mixing.min_cost_flow(patterns, [total // 22] * 22)
    assert sum(sum(x.values()) for x in sent) == total // 22 * 22 and max(sum(x.values()) / size for x, (_, size) in zip(sent, patterns, strict=True)) <= 3


def test_mix_comes_near_targets_and_repeats(spark, sf):
    docs = common.table(spark, sf, "documents")
    a, b = (sorted(map(str, mixing.plan(docs).collect())) for _ in range(2))
    assert a == b
    by = mixing.plan(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source", "target").agg(F.sum("taken").alias("taken"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).collect()
    assert all(abs(r.taken - r.target) <= 0.1 * r.target and r.over <= 0 for r in by)


def test_mix_goes_on_after_a_document_that_does_not_fit(spark):
    order = sorted(range(601), key=lambda i: hashlib.md5(f"17:{i}".encode()).hexdigest())
    texts = ["w " * 10] * 601 + ["v " * 5500]
    texts[order[0]] = "w " * 6000  # the first in the order, over the whole target
    docs = docs_of(spark, texts, sources=["b"] * 601 + ["a"])
    by = {r.source: r for r in mixing.plan(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source", "target").agg(F.sum("taken").alias("taken")).collect()}
    assert by["b"].target == 5000 and by["b"].taken == 5000


def test_mix_of_odd_rows_and_overlapping_sources(spark):
    docs = docs_of(spark, ODD, sources=["a", "a", None, None, "b", "b", "b", "c", "c", "a"])
    got = {r.doc_id: r for r in mixing.plan(docs).collect()}
    assert len(got) == len(ODD) and [got[i].size for i in range(len(ODD))] == [len((t or "").split()) for t in ODD]
    assert mixing.plan(empty_like(docs)).count() == 0
    none = mixing.plan(docs, sources=F.when(F.col("source") == "a", F.lit(None)).when(F.col("source") == "b", F.array().cast("array<string>")).otherwise(F.array("source"))).collect()
    assert len(none) == len(ODD) and all(r.taken == 0 for r in none if r.doc_id in (0, 1, 4, 5, 6, 9))


def test_words_are_charged_to_the_sources_of_overlapping_patterns(spark):
    sources = [["a"], ["a", "b"], ["b", "c"], ["a", "b", "c"]]
    docs = docs_of(spark, ["w " * (5 + i % 17) for i in range(800)], sources=[str(i % 4) for i in range(800)])
    of = F.element_at(F.array(*[F.array(*map(F.lit, x)) for x in sources]), F.col("source").cast("int") + 1)
    rows = mixing.plan(docs, sources=of).collect()
    sizes = [5 + i % 17 for i in range(800)]
    member = [sources[i % 4] for i in range(800)]
    by = Counter()
    for r in rows:
        assert sum(c.words for c in r.charged) == r.taken <= 3 * r["size"] and {c.source for c in r.charged} <= set(member[r.doc_id])
        by.update({c.source: c.words for c in r.charged})
    names = ["a", "b", "c"]
    target = mixing.targets([sum(z for z, m in zip(sizes, member, strict=True) if n in m) for n in names], [5, 2, 1], sum(sizes))
    quota = [round(t) for t in target]
    patterns = [(tuple(names.index(x) for x in p), sum(z for i, z in enumerate(sizes) if i % 4 == k)) for k, p in enumerate(sources)]
    assert sum(by.values()) >= brute_flow(patterns, quota)[0] - 4
    assert all(abs(by[n] - q) <= 40 for n, q in zip(names, quota, strict=True)), (by, quota)


# ---------------------------------------------------------------- 7


def brute_fingerprint(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(fps, radius):
    u = sorted(set(fps))
    root = {x: x for x in u}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(u):
        for y in u[i + 1 :]:
            if (x ^ y).bit_count() <= radius:
                root[find(y)] = find(x)
    return [find(x) for x in fps]


def test_simhash_groups_against_brute_force(spark, sf):
    rows = common.table(spark, sf, "documents").select("doc_id", "text").collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    g = brute_groups(fps, 3)
    low = {x: min(r.doc_id for r, y in zip(rows, g, strict=True) if y == x) for x in set(g)}
    want = {(r.doc_id, f"{f:016x}", low[x]) for r, f, x in zip(rows, fps, g, strict=True)}
    assert {tuple(r) for r in simhash.groups(common.table(spark, sf, "documents")).collect()} == want


def similar_firsts(rows):
    """Smallest ids of chains of near copies, by all pairs."""
    rows = sorted(map(tuple, rows))
    fps = [brute_fingerprint(t) for _, t in rows]

    def grams(t):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t).split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            d = (fps[i] ^ fps[j]).bit_count()
            if d <= 3 or (d <= 10 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {rows[find(i)][0] for i in range(len(rows))}


def test_dedup_takes_near_copies_and_leaves_others(spark):
    r = np.random.default_rng(9)
    word = lambda: "".join(r.choice(list("abcdefghij"), 5))
    texts, kin = [], []
    for g in range(30):
        base = [word() for _ in range(300)]
        for c in range(4):
            w = list(base)
            for k in r.choice(300, 2 * c, replace=False):
                w[k] = word()
            texts.append(" ".join(w))
            kin.append(g)
    docs = docs_of(spark, texts)
    kept = [x.doc_id for x in simhash.dedup(docs).collect()]
    assert set(kept) == similar_firsts([(i, t) for i, t in enumerate(texts)])
    assert len({kin[i] for i in kept}) == 30 and len(kept) <= 38


def similar_texts(r, n, size, change):
    """A base of `size` words and `n` variants with `change` words of their own each, at places of their own."""
    base = [f"w{i}" for i in range(size)]
    out = [base]
    for k in range(n):
        w = list(base)
        for i in r.choice(size, change, replace=False):
            w[i] = f"v{k}x{i}"
        out.append(w)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("chunk, grams", [(2048, 2048), (64, 40)])
def test_dedup_of_hubs_chains_and_texts_of_one_fingerprint(spark, chunk, grams, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "GRAMS", grams)
    r = np.random.default_rng(5)
    texts = similar_texts(r, 300, 120, 2)  # of the base 0.84, of one another mostly under 0.8
    links = [f"c{i}" for i in range(150)]
    for k in range(30):  # a chain: each differs from the one before
        links[(k * 7) % 150] = f"d{k}"
        texts.append(" ".join(links))
    texts += ["a b " * k + " ".join(f"q{i}" for i in range(k % 3)) for k in range(2, 40)]  # few fingerprints, many texts
    order = r.permutation(len(texts)).tolist()
    texts = [texts[i] for i in order]
    want = similar_firsts(list(enumerate(texts)))
    assert {x.doc_id for x in simhash.dedup(docs_of(spark, texts)).collect()} == want


@pytest.mark.parametrize("radius, segments, chunk", [(3, 2, 2048), (3, 4, 2048), (7, 4, 2048), (6, 2, 2048), (3, 2, 16)])
def test_links_connect_what_brute_force_connects(spark, radius, segments, chunk, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    r = np.random.default_rng(radius + segments)
    base = r.integers(0, 2**63, 40, dtype=np.uint64)
    fps = [int(b) ^ sum(1 << int(k) for k in r.choice(64, r.integers(0, radius + 2), replace=False)) for b in base for _ in range(6)]
    fps += [int(base[0]) ^ (1 << i) ^ (1 << j) for i in range(24) for j in range(i)]  # one hot bucket
    signed = sorted({x - (1 << 64) if x >> 63 else x for x in fps})
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    comp = {r.node: r.component for r in common.components(simhash.links(df, radius, segments)).collect()}
    got = [comp.get(x, x) for x in signed]
    want = brute_groups([x & (2**64 - 1) for x in signed], radius)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_simhash_odd_rows(spark):
    texts = [*ODD, "b " * 40 + "end"]
    docs = docs_of(spark, texts, ids=[8, 7, 6, 5, 4, 3, 3, 2, 1, None, 0])
    got = simhash.groups(docs).collect()
    assert len(got) == len(texts)
    assert {r.component_id for r in got if r.fingerprint == "0" * 16} == {6}
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert Counter(ids)[3] == 1 and 6 in ids and not {7, 8} & set(ids) and len(ids) == len(set(ids))
    unique = docs_of(spark, ["same words in this text", "same words in this text", "quite another text than that"])
    assert sorted(r.doc_id for r in simhash.dedup(unique).collect()) == [0, 2]
    assert simhash.groups(empty_like(docs)).count() == 0 and simhash.dedup(empty_like(docs)).count() == 0


def test_components_of_long_chains(spark):
    n = 300
    order = np.random.default_rng(4).permutation(n).tolist()
    edges = [(order[i], order[i + 1]) for i in range(n - 1) if i % 100 != 99] + [(1000, 1001), (5, 5)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    for k in range(0, n, 100):
        part = order[k : k + 100]
        assert {got[x] for x in part} == {min(part)}
    assert got[1001] == 1000


# ---------------------------------------------------------------- 8


def lm_brute(train, texts):
    toks = lambda t: [*re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split(), None]
    pairs, uni = Counter(), Counter()
    for t in train:
        w = toks(t)
        uni.update(w)
        pairs.update(zip(["<s>", *w[:-1]], w, strict=True))
    cont, ctx = Counter(w for _, w in pairs), defaultdict(lambda: [0, 0, 0, 0])
    for (v, _), c in pairs.items():
        ctx[v][0] += c
        ctx[v][min(c, 3)] += 1

    def discounts(values):
        n = [Counter(values)[k] for k in (1, 2, 3, 4)]
        if min(n[:3]) > 0:
            y = n[0] / (n[0] + 2 * n[1])
            d = [0, *(k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3))]
            if all(0 < d[k] <= k for k in (1, 2, 3)):
                return d
        return [0, 0.5, 1.0, 1.5]

    d, e = discounts(pairs.values()), discounts(cont.values())
    total, v_size, n = sum(cont.values()), len(uni), sum(uni.values())
    g = sum(e[min(c, 3)] for c in cont.values()) / total if total else 1.0

    def p(v, w):
        low = (cont[w] - e[min(cont[w], 3)]) / max(total, 1) + g / (v_size + 1)
        if v not in ctx:
            return low
        t, a, b, c3 = ctx[v]
        c = pairs[v, w]
        return (c - d[min(c, 3)]) / t + (d[1] * a + d[2] * b + d[3] * c3) / t * low

    out = []
    for t in texts:
        w = toks(t)
        s = sum(math.log10(p(a, b)) for a, b in zip(["<s>", *w[:-1]], w, strict=True))
        out.append((len(w), sum(uni[x] > 0 for x in w), n, sum(math.log10((uni[x] + 0.1) / (n + 0.1 * (v_size + 1))) for x in w), s))
    assert not uni or abs(sum(p("<s>", w) for w in [*uni, "unseen!"]) - 1) < 1e-9
    return out


def test_lm_against_brute_force(spark, sf):
    rows = common.table(spark, sf, "documents").select("doc_id", "text").orderBy("doc_id").collect()
    out = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    want = lm_brute([r.text for r in rows if not out(r.doc_id)], [r.text for r in rows])
    for r, w in zip(ngram_lm.op8_ngram_lm(spark, sf).orderBy("doc_id").collect(), want, strict=True):
        assert r.held_out == out(r.doc_id)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == pytest.approx(w)


def test_lm_odd_rows_and_large_counts(spark):
    texts = [*ODD, "pair again " * 700]
    docs = docs_of(spark, texts)
    want = lm_brute(texts, texts)
    got = ngram_lm.score(docs, ngram_lm.train(docs)).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in got] == [w[:3] for w in want]
    assert [r.score for r in got] == pytest.approx([w[4] for w in want]) and [r.base_score for r in got] == pytest.approx([w[3] for w in want])
    none = ngram_lm.score(docs, ngram_lm.train(empty_like(docs))).collect()
    assert {(r.score, r.base_score, r.train_tokens, r.n_known) for r in none} == {(0.0, 0.0, 0, 0)}
    assert ngram_lm.score(empty_like(docs), ngram_lm.train(docs)).count() == 0


def test_followers_that_share_their_leading_bits_keep_their_counts(spark, tmp_path):
    near = [5 << 22 | k for k in (7, 9, 11)]
    v, w = np.array([3, 3, 3, 3, 8], np.int64), np.array([2 << 22, *near, near[0]], np.int64)
    c = np.array([4, 1, 300, 2, 6], np.int64)
    order = np.lexsort((w, v))
    blob = ngram_lm._pack_pairs(v[order], w[order], c[order])
    pairs = spark.createDataFrame([(0, bytearray(blob))], "shard int, blob binary")
    made = [r for r in ngram_lm._write_pairs(pairs, f"file://{tmp_path}/lm", 1).collect() if r["path"]]
    reader = ngram_lm.Reader({"shards": 1, "pairs": {0: (made[0]["path"], made[0]["sizes"])}, "words": {}, "d_pair": [0, 0.5, 1.0, 1.5]})
    ask = [(3, near[0]), (3, near[1]), (3, near[2]), (3, 5 << 22 | 8), (3, 5 << 22 | 12), (3, 2 << 22), (8, near[0]), (9, near[0])]
    got, total, _ = reader.pair(*(np.array(x, np.int64) for x in zip(*ask, strict=True)))
    assert got.tolist() == [1, 300, 2, 0, 0, 4, 6, 0] and total.tolist() == [307] * 6 + [6, 0]


# ---------------------------------------------------------------- 9


def test_chat_round_trip(spark):
    pieces = ["<|im_start|>", "<|im_sep|>", "<|im_end|>", "</s>", "<\\/s>", "[INST]", "[\\\\/INST]", "<<SYS>>", "\\", "\n", "<|im_", "plain", "é"]
    r = np.random.default_rng(6)
    said = {c: [(t, str(r.choice(["user", "assistant", "system", "<|im_sep|>"])), "".join(r.choice(pieces, r.integers(0, 7)))) for t in range(int(r.integers(1, 9)))] for c in range(40)}
    rows = [(c, t, role, x, 1) for c, turns in said.items() for t, role, x in turns] + [(100, 1, None, None, 1), (100, 1, "assistant", None, 1), (None, 0, "assistant", "a", 1), (101, None, "user", "b", 1)]
    said |= {100: [(1, "", ""), (1, "assistant", "")], None: [(0, "assistant", "a")], 101: [(None, "user", "b")]}
    df = spark.createDataFrame([rows[i] for i in r.permutation(len(rows))], "conv_id long, turn long, role string, text string, example int")
    found = chat.examples(df)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {x.conv_id: x for x in chat.read_back(found).collect()}
    assert got.keys() == said.keys()
    for c, turns in said.items():
        loss = "".join(x for _, role, x in turns if role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha("".join(f"{a}\n{x}\n" for _, a, x in turns)), len(loss), sha(loss))
    for x in found.collect():
        assert x.text.count(chat.OPEN) == x.text.count(chat.CLOSE) == x.text.count(chat.SEP) == x.n_turns and "</s>" not in x.text and "[INST]" not in x.text
    per = Counter(x.conv_id for x in found.collect() if x.mask_start is not None)
    assert all(per[c] == sum(role == "assistant" for _, role, _ in turns) for c, turns in said.items())
    assert chat.read_back(chat.examples(empty_like(df))).count() == 0


# ---------------------------------------------------------------- 10


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = common.table(spark, sf, "labels")
    got = quality.op10_quality(spark, sf).join(labels, "doc_id").where("held_out").collect()
    right = [r.predicted == r.quality for r in got]
    assert np.mean(right) >= 0.93 and all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.predicted for r in got if r.quality == 1]) >= 0.98


def plain_features(text):
    """The features one by one, from their names."""
    b = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", b)
    threes = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    lines = [x for x in b.split(b"\n") if x]
    of = lambda pattern: len(re.findall(pattern, b)) / max(len(b), 1)
    share = lambda xs: len(set(xs)) / len(xs) if xs else 0
    return [
        math.log1p(len(words)), sum(map(len, words)) / max(len(words), 1), of(rb"[A-Z]"), of(rb"[#$%&*@^~=<>{}\[\]\\]"), of(rb"!"), of(rb"\|"), of(rb"[0-9]"), of(rb"[.,;:?\-'\"()/]"),
        sum(b[i] == b[i - 1] == b[i - 2] and b[i] not in b" \t\n\x0b\x0c\r" for i in range(2, len(b))) / max(len(b), 1),
        sum(x == y for x, y in zip(words, words[1:], strict=False)) / max(len(words), 1), share(words), share(threes), math.log1p(len(b) / max(len(lines), 1)), share(lines),
    ]


def test_quality_features_and_scores_against_brute_force(spark, sf, monkeypatch):
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    more = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(ODD[:-1])], "doc_id long, text string")
    docs = docs.select("doc_id", "text").union(more)
    monkeypatch.setattr(common, "SLICE_BYTES", 5000)
    text = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.f for r in quality.features(docs).collect()}
    assert got.keys() == text.keys()
    want = {i: plain_features(t) for i, t in text.items()}
    for i in text:
        assert got[i] == pytest.approx(want[i], abs=1e-12), i
    m = quality.train(docs, labels)
    for r in quality.score(docs, labels).collect():
        b = [sum(v >= e for e in edges) for v, edges in zip(got[r.doc_id], m.edges, strict=True)]
        at = lambda k: b[k] * quality.PAIR_BINS // quality.BINS
        logit = m.intercept + sum(t[k] for t, k in zip(m.tables, b, strict=True)) + sum(t[at(i), at(j)] for i, j, t in m.pairs)
        assert r.score == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-9) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_quality_odd_rows(spark):
    docs = docs_of(spark, ODD)
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, 1), (5, None), (None, 1)], "doc_id long, quality int")
    for lab in (labels, labels.where("doc_id = 3"), empty_like(labels)):
        got = quality.score(docs, lab).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert {r.score for r in quality.score(docs, empty_like(labels)).collect()} == {0.5}
    assert quality.score(empty_like(docs), labels).count() == 0
    kept = quality.keep_good(docs, empty_like(labels))
    assert kept.columns == docs.columns and kept.count() == len(ODD)


def test_boosted_tables_learn_an_interaction():
    r = np.random.default_rng(8)
    x = r.random((4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.fit(x[:3000], y[:3000])
    assert ((m.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


# ---------------------------------------------------------------- the pipeline


def test_pipeline_stage_by_stage(spark, sf):
    import corpus_pipeline as P

    docs = common.table(spark, sf, "documents")
    seen = docs
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, seen, sf)
        assert after.columns == docs.columns, name
        assert after.exceptAll(seen).count() == 0, name  # stages take rows away and change none
        seen = common.materialize(after, "t")
    graded = {r.doc_id for r in quality.score(docs, common.table(spark, sf, "labels")).where("predicted = 1").collect()}
    kept = docs.where(F.col("doc_id").isin(list(graded)))
    first = similar_firsts(kept.select("doc_id", "text").collect())
    dirty = {r.doc_id for r in decontamination.op3_decontamination(spark, sf).where("contaminated").collect()}
    assert {r.doc_id for r in seen.collect()} == first - dirty
    last = P.run(spark, sf)
    assert sorted(map(str, last.collect())) == sorted(map(str, mixing.plan(seen).collect()))

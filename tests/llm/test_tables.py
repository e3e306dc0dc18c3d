"""Mixing, sharding, licences and top-k: SQL where there is some, laws and plain versions elsewhere; the pipeline."""

import random

import pytest
from pyspark.sql import functions as F

from tests.oracle import rows_of, same
from tidemark.llm import licenses, mixing, registry, sharding, topk


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    same(registry.queries()[name](spark, sf_dir).toPandas(), rows_of(registry.oracle_sql()[name], sf_dir))


DOCS = "doc_id long, text string, source string, target string"


def test_mix_laws(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(["w"] * rng.randrange(1, 50)), rng.choice(["a", "b", "c", "d", None]), "clash") for k in range(400)]
    rows += [(1000, None, "a", None), (1001, "", "b", None), (None, "one two", "c", None), (5, "twice", "a", None), (5, "twice", "a", None), (2000, "tiny", "z", None)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).toPandas()
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all() and (got.taken >= 0).all()
    by = got.fillna({"source": "~"}).groupby("source").agg(size=("size", "sum"), total=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by.total).all() and ((by.taken - by.target).abs() <= 1).all() and (by.target <= 3 * by.total + 1e-9).all()
    assert abs(by.target.sum() - got["size"].sum()) < 1e-6
    whole = mixing.mix(spark.createDataFrame(rows, DOCS), split_last=False).toPandas()
    assert (whole.taken[whole["size"] > 0] % whole["size"][whole["size"] > 0] == 0).all()
    assert mixing.mix(spark.createDataFrame([], DOCS)).isEmpty()


@pytest.mark.parametrize("sources", [100_000, 0])
def test_mix_agrees_in_any_order(spark, monkeypatch, sources):
    """Null and repeated ids, one text under several ids, repeated rows; with few and with many sources."""
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", sources)
    rows = [(None, "w " * (1 + k % 9) + str(k), "ab"[k % 2], None) for k in range(39)] + [(k % 3, "same text", "a", None) for k in range(9)] + [(1, "x " * k, "b", None) for k in range(20)]
    seen = set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = mixing.mix(spark.createDataFrame(rows, DOCS).repartition(3 + seed), weights=(1, 5, 2), keep=("text", "target", "Size")).collect()
        assert set(got[0].asDict()) == {"text", "doc_id", "source", "size", "source_size", "target", "taken"}
        seen.add(tuple(sorted((r.doc_id or -1, r.text, r.source, r.taken) for r in got)))
    assert len(seen) == 1


def plain_targets(sizes, weights, epochs):
    """Shares by weight; what is above goes to the others, until none is."""
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {n: weights[k % len(weights)] for k, n in enumerate(names)}
    full = set()
    while True:
        left, open_ = sum(sizes.values()) - sum(epochs * sizes[n] for n in full), sum(weight[n] for n in names if n not in full)
        above = {n for n in names if n not in full and epochs * sizes[n] * open_ <= left * weight[n]}
        if not above:
            return {n: float(epochs * sizes[n]) if n in full else left * weight[n] / open_ for n in names}
        full |= above


def test_targets_of_many_sources(spark):
    rng = random.Random(6)
    for n in (1, 2, 50, 400):
        sizes = {f"s{k:04d}é" if k else None: int(10 ** rng.uniform(0, 6)) for k in range(n)} | {"none": 0}
        frame_ = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        for epochs in (1, 3):
            got = {r.source: r.target for r in mixing.source_targets(frame_, (5, 2, 1), epochs).collect()}
            assert got == pytest.approx(plain_targets(sizes, (5, 2, 1), epochs))


def test_mix_does_not_depend_on_buckets(spark):
    rows = spark.createDataFrame([(k, "w " * (k % 7), "ab"[k % 2], None) for k in range(200)], DOCS)
    a, b = (sorted(map(tuple, mixing.mix(rows, buckets=n).collect())) for n in (1, 1000))
    assert a == b


def plain_capacity(sizes, shards):
    low, high = max([0, *sizes]), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        used, room = 1, mid
        for s in sizes:
            if s > room:
                used, room = used + 1, mid
            room -= s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("first,step", [(14, 8), (2, 2)])
def test_shards(spark, monkeypatch, first, step):
    monkeypatch.setattr(sharding, "FIRST_BITS", first)
    monkeypatch.setattr(sharding, "STEP_BITS", step)
    rng = random.Random(first)
    texts = [None, "", *("x" * rng.randrange(400) + str(k % 150) for k in range(300)), *["hot"] * 80]
    docs = spark.createDataFrame([(k % 370, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, shard int")
    got = sharding.shard(docs, 7).toPandas()
    assert len(got) == len(texts)
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    hashed = docs.select("doc_id", sharding.text_hash(docs.text).alias("h")).toPandas()
    import pandas as pd

    sizes = pd.Series([len((t or "").encode()) + 16 for t in texts]).groupby(hashed.h).sum().sort_index().tolist()
    left, first = sum(sizes), []
    for x in sorted(sizes, reverse=True)[:7]:
        if x * (7 - len(first)) > left:
            first.append(x)
            left -= x
            sizes.remove(x)
        else:
            break
    assert got.groupby("shard")["size"].sum().max() == plain_capacity([*first, *sizes], 7)
    assert got[got.text_crc32 == __import__("zlib").crc32(b"hot")].shard.nunique() == 1
    assert sharding.shard(docs.limit(0), 7).isEmpty()


@pytest.mark.parametrize("copies", [0, 400, 3000])
def test_shards_are_near_equal(spark, copies):
    """Beside a hot group that no cut can split; null and repeated ids; reruns agree."""
    rng = random.Random(8)
    rows = [(k, "w " * rng.randrange(1, 40) + str(k)) for k in range(2000)] + [(None if k % 2 else 7, "hot " * 50) for k in range(copies)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(docs, 40).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    others = sizes.drop(sizes.idxmax()) if copies else sizes
    assert len(got) == len(rows) and len(sizes) == 40 and others.max() <= 1.1 * others.min()
    if copies:
        assert sizes.max() == copies * (16 + 200)
    again = sharding.shard(docs.repartition(5), 40).toPandas()
    assert sorted(map(tuple, got.fillna(-1).values.tolist())) == sorted(map(tuple, again.fillna(-1).values.tolist()))
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))


def test_licences(spark):
    known = licenses.SENTENCES
    mit = f"{known['MIT_GRANT'].replace('a copy of', chr(10).join(['a copy', 'of']))}:\n\n{known['MIT_NOTICE']}.\n\n{known['MIT_WARRANTY']}."
    texts = [None, "", "A licence plate.", mit, "prose\nReleased under the MIT License.", "LICENSED under the  Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0.", "not Released under the MIT License at all", "w " * 50_000 + "\nReleased under the MIT License."]
    rows = spark.createDataFrame([(None if k == 4 else k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, sentence string")
    got = [(r.sentence_ids, r.licences) for r in licenses.scan(rows).collect()]
    assert got == [([], []), ([], []), ([], []), (["MIT_GRANT", "MIT_NOTICE", "MIT_WARRANTY"], ["MIT"]), (["MIT_SHORT"], ["MIT"]), (["APACHE_SHORT", "CC_BY_NC"], ["Apache-2.0", "CC-BY-NC-4.0"]), ([], []), (["MIT_SHORT"], ["MIT"])]
    assert licenses.scan(rows.limit(0)).isEmpty()


def test_licences_of_wrapped_and_unwrapped_notices(spark):
    known = licenses.SENTENCES
    wrap = lambda name: known[name].replace(" ", "\n", 3)
    mit = f"{wrap('MIT_GRANT')}:\n\n{wrap('MIT_NOTICE')}.\n\n{wrap('MIT_WARRANTY')}."
    texts = [f"{known['CC_BY']}\nanother line\n\n{mit}", f"{known['CC_BY']}\nanother line\n\n{wrap('ISC_GRANT')}."]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r.sentence_ids, r.licences) for r in licenses.scan(rows).collect()]
    assert got == [(["CC_BY", "MIT_GRANT", "MIT_NOTICE", "MIT_WARRANTY"], ["CC-BY-4.0", "MIT"]), (["CC_BY", "ISC_GRANT"], ["CC-BY-4.0", "ISC"])]


GPL = "free software{}you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation{} version {} of the License{}\n"
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
HEADERS = [
    (APACHE, "Apache-2.0", 6),
    ("\n".join("# " + x if x else "#" for x in APACHE.split("\n")) + "\nimport os", "Apache-2.0", 6),
    ("/*\n" + "\n".join(" * " + x for x in APACHE.split("\n")) + "\n */\nclass A {}", "Apache-2.0", 6),
    (" ".join(APACHE.split()), "Apache-2.0", 4),
    ("This program is " + GPL.format("; ", ";", "2", ".") + "more", "GPL-2.0-only", 3),
    ("This program is " + GPL.format("; ", "; either", "2", ", or\n(at your option) any later version."), "GPL-2.0-or-later", 3),
    ("// This program is " + GPL.format("; ", "; either", "3", ", or (at\nyour option) any later version.").replace("\n", "\n// "), "GPL-3.0-or-later", 3),
    ("This program is " + GPL.format(": ", ", either", "3", ", or\n(at your option) any later version."), "GPL-3.0-or-later", 2),
    ("This program is free-software.", "", 1),
    ("This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this file", "MPL-2.0", 1),
]


def test_real_headers(spark, tmp_path):
    rows = spark.createDataFrame([(k, text, "own", [k], "z") for k, (text, _, _) in enumerate(HEADERS)], "doc_id long, text string, Licences string, sentence_ids array<int>, _left string")
    got = {r.doc_id: r for r in licenses.scan(rows).collect()}
    for k, (_, licence, n) in enumerate(HEADERS):
        assert (",".join(got[k].licences), len(got[k].sentence_ids), got[k]["_left"]) == (licence, n, "z"), HEADERS[k]
    rows.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    same(licenses.op5(spark, str(tmp_path)).toPandas(), rows_of(licenses.OP5_SQL, str(tmp_path)))


def test_mix_of_a_target_just_below_the_source(spark):
    """Target 99.6 of 100 words: rounding takes them all."""
    texts = [("a", "w " * 10)] * 10 + [("b", "w " * 149)]
    docs = spark.createDataFrame([(k, t, s) for k, (s, t) in enumerate(texts)], "doc_id long, text string, source string")
    for split in (True, False):
        got = mixing.mix(docs, weights=(2, 3), split_last=split).filter("source = 'a'").collect()
        assert {(r.target, r.taken) for r in got} == {(99.6, 10)}


def test_top_k(spark):
    rng = random.Random(9)
    vectors = [(k, [rng.choice([-1.0, 0.25, 0.5]) for _ in range(6)]) for k in range(60)]
    odd = [(100, None), (101, [1.0, None]), (102, [float("nan")] * 6), (103, [float("inf")] * 6), (104, []), (105, [1.0, 1.0]), (None, [1.0] * 6)]
    rows = topk.scaled(spark.createDataFrame([(i, v, "clash") for i, v in vectors + odd], "vec_id long, embedding array<float>, score string"))
    got = {}
    for r in topk.top_k(rows, rows.filter("vec_id % 10 = 0"), 4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    import math

    whole = {i: [math.floor(256 * x) for x in v] for i, v in vectors}
    for q in range(0, 60, 10):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:4]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert set(got) == set(range(0, 60, 10))
    assert topk.top_k(rows.limit(0), rows.limit(0)).isEmpty()


def test_few_candidates_and_large_values(spark):
    rows = topk.scaled(spark.createDataFrame([(0, [1e6, 2e6]), (1, [3e6, -1e6]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>"))
    got = sorted(topk.top_k(rows, rows.filter("vec_id = 0"), 5).collect(), key=lambda r: r.rank)
    assert [(r.vec_id, r.score) for r in got] == [(1, 65536 * (3 * 10**12 - 2 * 10**12)), (2, 65536 * 3 * 10**6)]


def test_products_beyond_64_bits(spark):
    """One huge component ends nothing while the answers fit; an answer that doesn't fit fails."""
    rng = random.Random(4)
    vectors = [(k, [float(rng.randrange(-9, 9)) for _ in range(4)]) for k in range(30)] + [(30, [1e9, -1e9, 1.0, 0.0]), (31, [1e12, 1e12, 0.0, 1.0]), (33, [-1e12, 2.0, 0.0, 1.0])]
    rows = topk.scaled(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"))
    whole = {i: [int(256 * x) for x in v] for i, v in vectors}
    got = {}
    for r in topk.top_k(rows, rows.filter("vec_id IN (0, 1, 30)"), 3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in (0, 1, 30):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:3]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    both = rows.unionByName(topk.scaled(spark.createDataFrame([(40, [1e12, 1e12, 0.0, 1.0])], "vec_id long, embedding array<double>")))
    with pytest.raises(Exception, match="62 bits"):
        topk.top_k(both, both.filter("vec_id = 40"), 1).collect()


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = set(docs.columns)
    from tidemark.llm.shared import stored

    ids = {r.doc_id for r in docs.collect()}
    for name, stage in p.STAGES[:-1]:
        out = stored(stage(spark, docs, sf_dir))
        assert set(out.columns) == columns, name
        now = {r.doc_id for r in out.collect()}
        assert now and now <= ids, name
        docs, ids = out, now
    last = p.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == docs.count()
    empty = docs.limit(0)
    for name, stage in p.STAGES:
        assert stage(spark, empty, sf_dir).isEmpty(), name


def test_pipeline_of_odd_rows(spark, sf_dir):
    """Null ids, null and empty texts, repeated rows, copies under null ids, extra columns: every stage, then all together."""
    import corpus_pipeline as p
    from tidemark.llm.shared import stored

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("n_chars > 400").limit(60)
    texts = [r.text for r in docs.orderBy("doc_id").limit(6).collect()]
    odd = [(None, texts[0], "en", None, 1), (None, texts[1] + " and more", "en", "s", 1), (None, "own words of no other text " * 3, "en", "s", 1), (None, None, None, None, None), (10**7, "", "en", "s", 0), (10**7, texts[2], "en", "s", 1), (10**7, texts[2], "en", "s", 1), (10**7 + 1, texts[3], None, "t", 1)]
    odd = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long"))
    odd = odd.withColumns({"kept": F.lit("x"), "quality_score": F.lit("y"), "taken": F.lit("z"), "ids": F.lit(1)})
    columns = {"doc_id", "text", "lang", "source", "n_chars"}
    for name, stage in p.STAGES[:-1]:
        assert set(stored(stage(spark, odd, sf_dir)).columns) == columns, name
    near = [(r.doc_id, r.text) for r in p.drop_near_copies(spark, odd, sf_dir).collect()]
    # copies under null and larger ids go, what only shares the null id stays; nothing is empty but one
    assert (None, texts[0]) not in near and (10**7, texts[2]) not in near and (None, "own words of no other text " * 3) in near
    assert [t for _, t in near if not t] == [""]  # the null text's id is null, so it comes after the empty one's
    cut = p.cut_repeats(spark, odd, sf_dir).collect()
    assert all(r.text is None or len(r.text) == r.n_chars or r.n_chars in (0, 1) for r in cut)
    assert p.STAGES[-1][1](spark, odd, sf_dir).count() == odd.count()


def test_near_copies_against_brute_force(spark):
    """Every pair of 0.8 or more is joined, nothing below it alone; chains join."""
    from tidemark.llm import simhash

    rng = random.Random(12)
    words = ["w%03d" % k for k in range(400)]
    rows = []
    for k in range(25):
        text = rng.choices(words, k=rng.randrange(30, 120))
        rows.append((len(rows), " ".join(text)))
        for _ in range(rng.randrange(4)):
            text = [w if rng.random() > rng.choice([0.005, 0.02, 0.05]) else rng.choice(words) for w in text]
            rows.append((None if rng.random() < 0.2 else len(rows), " ".join(text)))
    rows += [(3, ""), (None, None), (2, " \n")]
    got = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = [frozenset(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (k, t) in enumerate(rows):
        groups.setdefault(find(i), []).append((k is None, k, __import__("hashlib").md5((t or "").encode()).hexdigest()))
    want = sorted(repr((k, d, min(g)[1], (e, k, d) == min(g))) for g in groups.values() for e, k, d in g)
    assert sorted(repr((r.doc_id, r.digest, r.component_id, r.kept)) for r in got) == want


def test_no_name_of_a_column_clashes(spark):
    """Kept columns may have any names, also those that operators use inside."""
    from tidemark.llm import bpe, quality, suffix

    names = ["doc", "th", "row", "kept0", "_digest", "_key", "_bucket", "_part", "_start", "spans", "key", "uses", "_text", "copy", "n", "h", "node", "sentence", "bucket", "target_source"]
    docs = spark.createDataFrame([(k, "one two three " * (k % 3 + 10), "s", *("own" for _ in names)) for k in range(6)], "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    path, pattern = bpe.multilingual()
    found = {
        "mix": mixing.mix(docs, keep=tuple(names)),
        "bpe": bpe.decode(bpe.encode(docs, path, pattern, ("doc_id", *names)), path),
        "suffix": suffix.remove_repeats(docs),
        "licences": licenses.scan(docs),
        "quality": quality.score(docs, (__import__("numpy").zeros(quality.BUCKETS), 0.0)),
    }
    for what, out in found.items():
        rows = out.collect()
        assert len(rows) == 6 and len(set(out.columns)) == len(out.columns) and all(r[n] == "own" for r in rows for n in names), what

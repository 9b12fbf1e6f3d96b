"""Operators of the training-data subpackage against brute force on small tables with awkward rows."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from anchorgrid.llm import decontaminate as dc, html_wrappers as hw, line_dedup as ld, minhash as mh, mixing, nearest as nn, quality, sharding, substring_dedup as sd, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long, score string, shard string, bucket int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    """Rows (doc_id, text, source) with extra columns whose names clash with those the operators use."""
    return spark.createDataFrame([(i, t, None, s, None, "x", "y", 1) for i, t, s in rows], DOC)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 60))) for _ in range(40)]
    passage = " ".join(rng.choices(vocabulary, k=30))
    for i in range(0, 40, 3):
        texts[i] += "\n" + passage
    for i in range(10):
        words = texts[i].split()
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    out = [(i, t, f"s{i % 4}") for i, t in enumerate(texts)]
    return out + [(50, None, None), (51, "", "s1"), (52, " \t\n", None), (53, texts[3], "s2"), (53, texts[3], "s2"), (54, "one two", "s3"), (55, "z " * 4000 + texts[0], "s0"), (None, texts[1], "s1"), (56, texts[2].upper(), "S"), (57, "é à ü " * 9, "s0")]


def test_substring_dedup(spark, rows):
    got = {(r.doc_id, r.n_words): (r.n_removed, r.kept_sha256) for r in sd.substring_dedup(documents(spark, rows)).collect()}
    first = {}
    for i, t, _ in rows:
        w = WORDS.findall(t or "")
        for p in range(len(w) - 12 if i is not None else 0):
            first[tuple(w[p : p + 13])] = min(i, first.get(tuple(w[p : p + 13]), i))
    for i, t, _ in rows:
        w = WORDS.findall(t or "")
        gone = set()
        for p in range(len(w) - 12 if i is not None else 0):
            if first[tuple(w[p : p + 13])] < i:
                gone.update(range(p, p + 13))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        assert got[(i, len(w))] == (len(gone), hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("parameters", [{"hot_share": 20, "sample_one_in": 1}, {"bucket_windows": 1, "hot_share": 1}, {"hot_share": 20, "sample_one_in": 1, "window_share": 5}])
def test_substring_dedup_ways_agree(spark, rows, parameters):
    key = lambda d: sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in d.collect())
    assert key(sd.substring_dedup(documents(spark, rows), **parameters)) == key(sd.substring_dedup(documents(spark, rows)))


def _components(rows, width, percent=80):
    sets = {}
    for i, t, _ in rows:
        w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        if i is not None:
            sets[i] = {tuple(w[p : p + width]) for p in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(spark, rows, width):
    want = _components(rows, width)
    for r in mh.near_duplicates(documents(spark, rows), width=width).collect():
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert ((r.n_shingles, r.component_id), r.kept) == (want[r.doc_id], r.doc_id == want[r.doc_id][1])


def test_near_duplicates_large_group(spark):
    """Members of one group that are mostly linked through others, more than a block of them."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(90):
        words = list(base)
        for p in rng.sample(range(120), rng.randint(0, 5)):
            words[p] = f"x{i}"
        rows.append((i, " ".join(words), None))
    want = _components(rows, 4)
    got = {r.doc_id: r.component_id for r in mh.near_duplicates(documents(spark, rows), block=16).collect()}
    assert got == {i: c for i, (_, c) in want.items()}


def test_forward_backward_enumerated():
    rng = np.random.default_rng(1)
    gain, trans, start = rng.normal(size=7), rng.normal(size=(2, 2)), 0.4
    first = np.array([0, 4, 5, 7])
    log_z, marginal, _ = quality.forward_backward(gain, first, trans, start)
    for c in range(3):
        a, b = first[c], first[c + 1]
        total, good = 0.0, np.zeros(b - a)
        for path in itertools.product((0, 1), repeat=b - a):
            weight = np.exp(start * path[0] + sum(gain[a + t] * s for t, s in enumerate(path)) + sum(trans[x, y] for x, y in zip(path, path[1:])))
            total += weight
            good += weight * np.array(path)
        assert np.allclose(log_z[c], np.log(total)) and np.allclose(marginal[a:b], good / total)


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = quality.score_quality(docs, quality.fit_quality(docs, labels)).join(labels, "doc_id").where(quality.held_out("doc_id"))
    assert scored.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] >= 0.95


def test_quality_awkward_rows(spark, rows):
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    out = quality.score_quality(docs, quality.fit_quality(docs, labels))
    assert out.count() == len(rows) and out.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    none = quality.fit_quality(docs, labels.limit(0))
    assert {r.score for r in quality.score_quality(docs, none).select("score").collect()} == {0.5}


def test_mixing(spark, rows):
    out = mixing.mix(documents(spark, rows)).toPandas()
    assert len(out) == len(rows)
    assert (out["taken"] <= 3 * out["size"]).all() and abs(out["taken"].sum() - out["size"].sum()) <= 8
    for _, part in out.fillna({"source": "none"}).groupby("source"):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= 1 and part["target"].iloc[0] <= 3 * part["source_size"].iloc[0]
    again = mixing.repeat_documents(documents(spark, rows))
    assert again.columns == documents(spark, rows).columns and 0 < again.count() <= 3 * len(rows)


def test_sharding(spark, rows):
    docs = documents(spark, rows * 5)
    for out in (sharding.shard_table(docs, 4, ranges_per_shard=4), sharding.shard_documents(docs, 4, ranges_per_shard=4)):
        frame = out.toPandas()
        assert len(frame) == 5 * len(rows)
        biggest = frame["size"].max()
        sums = frame.groupby("shard")["size"].sum()
        assert sums.max() - sums.min() <= 2 * biggest
        for _, part in frame.groupby("shard"):
            assert sorted(part["slot"]) == list(range(len(part)))


def _product(x, y):
    total = 0.0
    for a, b in zip(x, y):  # sum() would compensate
        total += a * b
    return total


def test_nearest(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 8)).round(1)
    rows = [(i, [float(x) for x in v[i % 250]]) for i in range(300)]
    rows += [(300, None), (301, []), (302, [0.0] * 8), (303, [float("nan")] + [1.0] * 7), (304, [None] + [1.0] * 7), (None, [1.0] * 8), (305, [1.0, 2.0])]
    table = spark.createDataFrame([(i, x, "c") for i, x in rows], "vec_id long, embedding array<double>, score string")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in nn.nearest(table.where("vec_id % 20 = 0"), table, 20, query_block=4, candidate_block=64).collect()}
    use = {i: np.array(x) for i, x in rows if i is not None and x and len(x) == 8 and all(c is not None and np.isfinite(c) for c in x) and any(x)}
    for q in range(0, 300, 20):
        best = sorted((-_product(use[q].tolist(), x.tolist()), i) for i, x in use.items() if i != q)[:20]
        assert [got[(q, r + 1)] for r in range(20)] == [(i, -s) for s, i in best]


def test_nearest_with_repeated_rows(spark):
    rng = np.random.default_rng(5)
    v = {i: rng.normal(size=4).tolist() for i in range(60)}
    v[7] = [9.0, 0.0, 0.0, 0.0]
    rows = list(v.items()) + [(7, v[7])] * 30 + [(7, [9.0, float(z), 0.0, 0.0]) for z in range(1, 31)]  # alike to a query without second component
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    query = [1.0, 0.0, 0.5, 0.25]
    got = [(r.rank, r.vec_id, r.score) for r in nn.nearest(spark.createDataFrame([(100, query)], "vec_id long, embedding array<double>"), table, 20).collect()]
    best = sorted((-_product(query, x), i) for i, x in v.items())[:20]
    assert sorted(got) == [(r + 1, i, -s) for r, (s, i) in enumerate(best)]


def test_leaks(spark, rows):
    items = [(1, "A train leaves Paris at 7 and travels 120 km to reach Lyon before noon. How fast does the train go on its way?"), (2, "short item here"), (3, None), (4, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    cases = {
        100: "before it " + items[0][1] + " after it",
        101: "So: a train leaves Rome at 9 and travels 450 miles to reach Milan before noon. How fast does the train go on its way?",
        102: "A train leaves on time and everybody is glad about it because the noon was hot",
        103: "they had a short item here too",
    }
    docs = documents(spark, rows + [(i, t, None) for i, t in cases.items()])
    found = {(r.doc_id, r.item_id): r.reworded for r in dc.leaks(docs, bench).collect()}
    assert set(found) == {(100, 1), (101, 1)} | ({(103, 2)} if (103, 2) in found else set())
    assert not found[(100, 1)] and found[(101, 1)]
    assert {100, 101}.isdisjoint(r.doc_id for r in dc.decontaminate(docs, bench).select("doc_id").collect())
    assert dc.leaks(docs, bench.limit(0)).count() == 0


def _leaks_of(spark, items, docs):
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = dc.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    return {(r.doc_id, r.item_id): (r.first_word, r.n_words, r.reworded) for r in out}, len(out)


def test_leaks_with_few_literal_words(spark):
    table = "12 + 7 = 19 , 13 * 4 = 52 , 8 - 3 = 5 , 90 / 6 = 15 , 33 + 9 = 42"
    names = "seen Alice Baker Carol Dan Evans Fox Greg Hill Irving Jones Kent Lee Moore Nash"
    items = [(1, table), (2, names), (3, "Is 17 prime?"), (4, "Add 3 and 4"), (5, names + " " + table)]
    docs = [(1, "we saw " + table + " there"), (2, "they were " + names + " at last"), (3, "ask: is 17 prime? no"), (4, "Is 18 prime?"), (5, table.replace("12", "11").replace("52", "58").replace("15", "20")), (6, "x " + names + "\n" + table)]
    found, n = _leaks_of(spark, items, docs)
    assert {k for k in found if k[1] != 5} == {(1, 1), (2, 2), (3, 3), (6, 1), (6, 2)}
    assert found[(1, 1)][1] == len(re.findall(r"\d+", table)) and found[(2, 2)] == (2, 15, False) and found[(3, 3)] == (1, 3, False)
    assert found[(6, 5)] == (1, 30, False)


def test_leaks_after_marks_and_with_longer_names(spark):
    items = [(1, "Which metal melts at a lower heat than tin"), (2, "Ann buys apples and pays with a large note"), (3, "What melts first?")]
    long = "A boat sails with {0} to the far island and {0} eats there while the old captain asks {0} for a song and then sleeps until {0} wakes him"
    items.append((4, long.format("Ann")))
    docs = [(1, "1) " + items[0][1]), (2, "no stop here\n" + items[0][1]), (3, "- Bob buys apples and pays with a large note"), (4, "so Mary Lou buys apples and pays with a large note"), (5, "(b) What melts first?")]
    docs += [(6, "so " + long.format("Mary Ann")), (7, "so " + long.format("Mary Ann Lee").replace("asks Mary Ann Lee", "asks Bob")), (8, "- Where melts first?"), (9, "- Buys apples and pays with a large note")]
    found, n = _leaks_of(spark, items, docs)
    assert set(found) == {(1, 1), (2, 1), (3, 2), (4, 2), (5, 3), (6, 4), (7, 4)} and n <= 8
    assert found[(1, 1)] == (1, 9, False) and found[(2, 1)] == (3, 9, False) and found[(3, 2)][1:] == (9, True) and found[(4, 2)] == (1, 9, True)
    assert found[(6, 4)] == (1, 29, True)


def test_slots_must_agree():
    hit = lambda at, a, b: {"item_at": at, "size": 8, "item_slots": a, "slots": b}
    assert dc._consistent([hit(0, ["tom", "3"], ["ann", "5"]), hit(1, ["3", "tom"], ["5", "ann"])]) == [(0, 9, 2)]
    assert dc._consistent([hit(0, ["tom"], ["ann"]), hit(1, ["tom"], ["bob"])]) == [(0, 8, 1), (1, 8, 1)]
    assert dc._consistent([hit(0, ["tom", "tom"], ["ann", "bob"])]) == []


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_automaton():
    rng = random.Random(3)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choices("abé", k=rng.randint(0, 12)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            b[rng.randint(0, len(b)) : rng.randint(0, len(b)) + 1] = rng.choices("abé", k=rng.randint(0, 2))
        pairs.append((a, "".join(b)))
    for edits in (1, 2, 3):
        assert ld.within([a for a, _ in pairs], [b for _, b in pairs], edits).tolist() == [_distance(a, b) <= edits for a, b in pairs]


@pytest.mark.parametrize("block", [256, 2])
def test_line_classes(spark, block):
    rng = random.Random(5)
    base = ["the quick brown fox jumps over it", "a line of quite another kind here", "numbered line 0 of the long report"]
    rows = []
    for i in range(30):
        line = list(base[i % 3])
        for _ in range(rng.randint(0, 3)):
            line[rng.randrange(len(line))] = rng.choice("xyz")
        rows.append((i, "".join(line) + "\n\n  short \r", None))
    rows += [(30, None, None), (31, "", None), (None, base[0], None), (5, rows[5][1], None)]
    lines = {}
    for i, t, _ in rows:
        for n, line in enumerate((t or "").split("\n")):
            line = line.strip(" \t\r\x0b\x0c")
            if line:
                lines.setdefault(line, []).append(((i is None, i), n))
    first = {line: min(p, key=lambda x: (x[0][0], x[0][1] or 0, x[1])) for line, p in lines.items()}
    links = {x: [y for y in lines if y != x and min(len(x), len(y)) >= 24 and _distance(x, y) <= 2] for x in lines}
    got = {(r.doc_id, r.line_no): (r.n_rows, r.n_links, (r.class_doc_id, r.class_line_no), r.kept) for r in ld.line_classes(documents(spark, rows), block=block).collect()}
    assert len(got) == len(lines)
    for line, place in first.items():
        seen, todo = {line}, [line]
        while todo:
            for y in links[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        named = min((first[x] for x in seen), key=lambda x: (x[0][0], x[0][1] or 0, x[1]))
        assert got[(place[0][1], place[1])] == (len(lines[line]), len(links[line]), (named[0][1], named[1]), named == place)


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "é" * 300_000 + "</p>"
    pages = [(1, "http://a/x", big), (2, "http://a/y", big), (3, None, None), (4, "u", "<b>tiny</b>"), (5, "u", "<b>tiny</b>"), (6, "v", big), (None, "w", big), (2, "http://a/y", big)]
    table = spark.createDataFrame([(*p, "k") for p in pages], "page_id long, url string, html string, payload_digest string")
    files = warc.write_warc(table, f"file://{tmp_path}/out")
    back = warc.read_warc(files).collect()
    assert len(back) == len(pages)
    for r in back:
        html = (next(h for i, _, h in pages if i == r.page_id) or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(html), hashlib.sha256(html).hexdigest())
        assert r.record_type == ("revisit" if r.page_id in (2, 6) else "response")
        assert r.payload == (html if r.record_type == "response" else None)
    assert {r.refers_to for r in warc.archive_round_trip(table).collect()} == {None, 1}
    path = files.first().path.removeprefix("file://")
    with open(path, "rb") as f:
        data = bytearray(f.read())
    with pytest.raises(Exception):
        import io
        import zlib

        raw = bytearray(zlib.decompressobj(31).decompress(bytes(data)))
        raw[-8] ^= 1
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        list(warc.read_records(io.BytesIO(packer.compress(bytes(raw)) + packer.flush()), path, False))


PAGE = """<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies</div>
<div id=wrap><div class=col><h1>{title}</h1><p>First &amp; <b>bold</b>{n} text.<p>Second\n  paragraph</p><ul><li>one<li>two {n}</ul></div><p>Fixed line of the site</p></div>
<div class="comments"><p>reader says</p></div><form><p>field</p></form><footer>foot</footer><script>var a="</p><p>x"</script></body></html>"""


def test_wrappers(spark):
    pages = [(i, "http://h.example/p", PAGE.format(title=f"Title {i}", n=i), "x") for i in range(8)]
    pages += [(20, None, None, "x"), (21, "", "", "x"), (22, "http://one.example/", "<main><header>Top</header><h2>A</h2>x<br>y<aside>no</aside></main>", "x"), (23, "http://deep.example/", "<div>" * 3000 + "deep", "x"), (22, "http://one.example/", "<main><header>Top</header><h2>A</h2>x<br>y<aside>no</aside></main>", "x")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in hw.main_text(table).collect()}
    for i in range(8):
        assert got[i] == f"Title {i}\n\nFirst & bold{i} text.\n\nSecond paragraph\n\none\n\ntwo {i}"
    assert got[20] == got[21] == "" and got[22] == "Top\n\nA\n\nx y" and got[23] == "deep"
    assert hw.main_text(table.limit(0)).count() == 0


def test_wrappers_keep_all_parts():
    split = "<body><nav>Home</nav><div class=lead><p>Lead {n} of some length</p></div><div class=body><p>Body {n} that is quite a bit longer than the lead</p></div></body>"
    wrapper = hw.infer([split.format(n=i) for i in range(4)])
    for w in (wrapper, None):
        assert hw.extract(split.format(n=9), w) == "Lead 9 of some length\n\nBody 9 that is quite a bit longer than the lead"
    named = "<body><p>Site</p><article class=a><p>First {n}</p></article><div><article class=b><p>The second and longer one {n}</p><article>inner</article></article></div><article class=c>Third</article></body>"
    wrapper = hw.infer([named.format(n=i).replace("class=c", "class=d") for i in range(4)])
    assert hw.extract(named.format(n=9), wrapper) == "First 9\n\nThe second and longer one 9\n\ninner\n\nThird"
    two = "<main class=x>One {n}</main><main class=y>Two and more {n}</main>"
    assert hw.extract(two.format(n=9), hw.infer([two.format(n=i) for i in range(4)])) == "One 9\n\nTwo and more 9"


def test_fold_and_align():
    rule = lambda *labels: [{"l": x, "c": [], "n": 1, "a": 0} for x in labels]
    assert [(r["l"], r.get("r", False)) for r in hw.fold(rule("h", "p", "p", "p", "x"))] == [("h", False), ("p", True), ("x", False)]
    assert [r["l"] for r in hw.fold(rule("h", "p", "h", "p", "h", "p"))] == ["()"]
    assert [(r["l"], r.get("o", False)) for r in hw.align(rule("a", "b", "c"), rule("a", "c", "d"))] == [("a", False), ("b", True), ("c", False), ("d", True)]


def test_warc_reader_has_a_task_for_each_archive(spark, tmp_path):
    pages = spark.range(60).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.sha2((F.col("id") * 100 + i).cast("string"), 512))).alias("html")).repartition(3)
    files = warc.write_warc(pages, f"file://{tmp_path}/out", file_bytes=8000)
    n = files.count()
    read = warc.read_warc(files, with_payload=False)
    where = read.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.countDistinct("path").alias("archives")).collect()
    assert n >= 8 and len(where) == n and {r.archives for r in where} == {1} and read.count() == 60


def test_empty_tables(spark):
    docs = documents(spark, []).select("*")
    assert sd.substring_dedup(docs).count() == mh.near_duplicates(docs).count() == ld.line_classes(docs).count() == 0
    assert mixing.mix(docs).count() == mixing.repeat_documents(docs).count() == sharding.shard_documents(docs).count() == 0
    assert quality.score_quality(docs, quality.fit(pa.array([], pa.string()), np.zeros(0, np.int64))).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert nn.nearest(vectors, vectors).count() == 0
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, stage(spark, kept, "/root/testdata/sf0.001")
        assert kept.count() > 0
        if name != "sharding":
            assert kept.columns == columns
        if name not in ("mixing", "sharding"):
            assert kept.exceptAll(before).count() == 0
    assert kept.count() == corpus_pipeline.run(spark, "/root/testdata/sf0.001").count()

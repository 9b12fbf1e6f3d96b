"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from anchorgrid.llm import spelling as sp

RUNS = re.compile(r"[A-Za-zÀ-ÿ]+")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, one_in=31):
    counts = Counter()
    for i, t in rows:
        for run in RUNS.findall(t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 2}
    out = {}
    for w, n in counts.items():
        others = [x for x in counts if near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= 10 * n else None
        out[w] = [form, w, n, len(others), counts[form] if form else None]
    for w in out:
        while out[out[w][1]][0]:
            out[w][1] = out[out[w][1]][0]
    return {w: tuple(v) for w, v in out.items()}


def collected(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def texts():
    rng = random.Random(2)
    base = ["station", "stations", "stationen", "aaaaaaa", "aaaaaaaa", "éléments", "ÉLÉMENTS", "zoologist", "straße×÷ÿ", "orchard"]
    words = []
    for i, w in enumerate(base):
        words += [w] * (400 if i % 3 == 0 else 30 if i % 3 == 1 else 3)
        for _ in range(40):
            spot = rng.randrange(len(w) + 1)
            words += [rng.choice([w[:spot] + w[spot + 1 :], w[:spot] + rng.choice("aeést") + w[spot:], w[:spot] + rng.choice("aeést") + w[spot + 1 :]])] * rng.randint(1, 4)
    words += ["".join(rng.choices("ab", k=rng.randint(7, 9))) for _ in range(400)]
    rng.shuffle(words)
    rows = [(i % 11, rng.choice([" ", "\n", "漢", "1", "-"]).join(words[i * 40 : i * 40 + 40])) for i in range(len(words) // 40 + 1)]
    return rows + [(None, "station Station STATION"), (3, None), (4, ""), (5, "x" * 5000), (5, "x" * 5000), (6, "short words only"), (7, "éléments " * 3000)]


@pytest.mark.parametrize("one_in", [31, 3])
def test_variants(spark, monkeypatch, one_in):
    monkeypatch.setattr(sp, "PIECE", 64)
    rows = texts()
    df = spark.createDataFrame([(i, t, "w", 1, "f") for i, t in rows], "doc_id long, text string, word string, n int, form string").repartition(5)
    assert collected(sp.spelling_variants(df, one_in=one_in)) == brute(rows, one_in)
    assert sp.spelling_variants(df.where("false")).count() == 0


@pytest.mark.parametrize("parts", [(3, 2), (5, 4)])
def test_parts_only_change_the_buckets(spark, parts):
    rng = random.Random(8)
    words = sorted({"".join(rng.choices("abcé", k=rng.randint(1, 6))) for _ in range(700)})
    df = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long")
    got = sorted((r.a, r.n_a, r.b, r.n_b) for r in sp.near_pairs(df, parts_two=parts[0], parts_one=parts[1]).collect())
    at = {w: i + 1 for i, w in enumerate(words)}
    want = sorted((a, at[a], b, at[b]) for i, a in enumerate(words) for b in words if near(a, b) and ((len(a) == len(b) and a < b) or len(a) < len(b)))
    assert got == want


def test_signatures_meet_under_every_edit():
    a = "abcabcé"
    edits = {a[:i] + c + a[i + 1 :] for i in range(7) for c in "xa"} | {a[:i] + a[i + 1 :] for i in range(7)} | {a[:i] + c + a[i:] for i in range(8) for c in "xab"}
    edits = sorted(edits - {a})
    tables = {}
    for kind, values in sp.signatures(pa.array([a, *edits]), 4, 3):
        for w, v in zip([a, *edits], values.tolist()):
            tables.setdefault((w, kind), set()).add(v)
    for b in edits:
        short, long = sorted((a, b), key=len)
        kinds = (sp.SAME, sp.SAME) if len(a) == len(b) else (sp.SHORT, sp.LONG)
        assert tables[(short, kinds[0])] & tables[(long, kinds[1])], b


def test_roots_follow_long_chains(spark):
    forms = spark.createDataFrame([(f"w{i:02d}", f"w{i + 1:02d}") for i in range(37)], "word string, form string")
    assert {r.root for r in sp.variant_roots(forms).collect()} == {"w37"}
    assert sp.variant_roots(forms.where("false")).count() == 0


def test_pairs_read_one_exchange(spark):
    words = spark.createDataFrame([("station", 2), ("statiin", 3)], "word string, n long")
    # not wide enough for a broadcast: the two sides differ in nothing, so the second is a reuse
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = sp.near_pairs(words)
        pairs.collect()
        plan = pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ReusedExchange" in plan


def test_signatures_are_never_broadcast(spark, tmp_path):
    # read from files, whose size says nothing of the signatures
    spark.createDataFrame([("station", 2), ("statiin", 3)], "word string, n long").write.parquet(f"{tmp_path}/words")
    pairs = sp.near_pairs(spark.read.parquet(f"{tmp_path}/words"))
    assert [(r.a, r.b) for r in pairs.collect()] == [("statiin", "station")]
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and "ReusedExchange" in plan

"""Fill-in-the-middle documents against plain string work, and the exact way back."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from anchorgrid.llm import fill_middle as fm

WORD_UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def texts():
    rng = random.Random(3)
    alphabet = "ab \n\té漢🤦<PSM>"
    out = ["", None, " ", "\n\n", "x", "<P>", "a<S>b", "<M", "tail <", "<S", "🤦🏼‍♂️ é", " lead", "trail  "]
    out += ["".join(rng.choices(alphabet, k=rng.randint(1, 80))) for _ in range(60)]
    shared = " ".join(rng.choices(["alpha", "béta", "漢字", "d"], k=900))
    out += [shared, "front " + shared, shared[7:] + " back", "z" * 30_000, "é" * 20_001, " " * 9000, shared * 9]
    return out


def arranged(key, text, split, seed=1):
    text = text or ""
    parts = split(text)
    n, digits = len(parts), hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h = [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in fm.MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("unit,split", [("point", list), ("word", WORD_UNIT.findall)])
def test_arranged_and_restored(spark, unit, split):
    rows = [(i % 70, t, "x", 5, "y") for i, t in enumerate(texts())] + [(None, "no id", "x", 5, "y"), (3, "x", "x", 5, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, n int, output string")
    made = fm.fill_in_middle(df, unit=unit, mean_chunk=64).withColumn("back", fm.restored("output", "form"))
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_units, r.middle_units, r.output, r.back) for r in made.collect()), key=repr)
    want = sorted(((i, *arranged("null" if i is None else i, t, split), t or "") for i, t, *_ in rows), key=repr)
    assert got == want
    assert fm.fill_in_middle(df.where("false"), unit=unit).count() == 0


def test_chunks_follow_the_content():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 3 * fm.BLOCK + 17, dtype=np.uint8)
    ends = fm.chunk_ends(data, 512)
    assert ends[-1] == len(data) and sorted(set(ends)) == ends and max(np.diff([0, *ends])) <= 4096
    assert 300 < np.mean(np.diff(ends)) < 700
    # the same bytes behind another head fall into the same chunks once the first common border is met
    moved = fm.chunk_ends(np.concatenate([rng.integers(0, 256, 1001, dtype=np.uint8), data]), 512)
    cut = lambda e, shift: {x - shift for x in e}
    assert len(cut(moved, 1001) & set(ends)) > 0.99 * len(ends)
    h = fm.rolling_hash(data[:100])
    assert h[80] == fm.rolling_hash(data[49:81])[-1]


def test_cache_counts_by_content(monkeypatch):
    monkeypatch.setattr(fm, "CACHE_BYTES", 2000)
    units = fm.Units("word", 32)
    rng = random.Random(5)
    for _ in range(50):
        text = "".join(rng.choices(["aa", " ", "\n", "é", "passage of words "], k=200))
        units.read(text.encode())
        parts = WORD_UNIT.findall(text)
        assert units.n == len(parts) and units.held < 2000 + 32 * 8 + 1
        for i in range(0, len(parts) + 1, 7):
            assert units.byte_of(i) == len("".join(parts[:i]).encode())


def test_seed_and_percentages(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("some words here").alias("text"))
    assert {r.form for r in fm.fill_in_middle(df, plain_percent=0, spm_percent=100).collect()} == {"spm"}
    assert {r.form for r in fm.fill_in_middle(df, plain_percent=100).collect()} == {"plain"}
    a, b = (sorted(map(tuple, fm.fill_in_middle(df, seed=s).collect())) for s in (1, 2))
    assert a != b

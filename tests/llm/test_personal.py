"""Personal data against the patterns taken literally, and disguises against the identifiers they hide."""

import hashlib
import random
import re
import time

import pytest

from anchorgrid.llm import personal as pd
from anchorgrid.llm.queries import QUERIES

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(text):
    total = 0
    for i, d in enumerate(reversed(text)):
        d = int(d) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def literal(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


PLAIN = [
    "a.b+c@mail.example.com", "x@y", "x@y.", "@a.b", "a@b.c@d.e", "a@@b.c", "é.a@b.cé", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "001.002.003.0255", "1.2.3", "0" * 30 + "9.1.1.1",
    "4539148803436467", "4539-1488 0343-6467", "4539 1488  0343 6467", "4539148803436468", "1" * 40, "+1 (555) 010-9999", "+49.30.901820", "+1 2 3", "++1 555 5555555", "+1555(", "+12345678901234567",
]


def test_plain_spans_are_the_literal_matches():
    rng = random.Random(1)
    texts = [*PLAIN, "", " ", " ".join(PLAIN), ",".join(PLAIN)]
    texts += ["".join(rng.choices("0149.@+ -()aé%", k=rng.randint(1, 60))) for _ in range(20_000)]
    texts += ["".join(rng.choices(["4539148803436467", "1.2.3.4", "+", "@", ".", "-", " ", "a", "9"], k=12)) for _ in range(5000)]
    for t in texts:
        assert pd.plain_spans(t) == literal(t), t
        got = pd.personal_data(t)
        assert [s[:3] for s in got if not s[3]] == literal(t), t
        assert all(0 <= a < b <= len(t) for _, a, b, *_ in got)


DISGUISED = [
    ("email", "john.smith at mail dot example dot com", "john.smith@mail.example.com"), ("email", "john [at] example [dot] org", "john@example.org"), ("email", "bob(at)example(dot)com", "bob@example.com"),
    ("email", "jоhn@exаmple.com", "john@example.com"), ("email", "ｊohn＠example．com", "john@example.com"), ("email", "jo​hn@ex­ample.com", "john@example.com"),
    ("email", "me @ example . com", "me@example.com"), ("email", "me&#64;example&#46;com", "me@example.com"), ("email", "ana arroba ejemplo punto es", "ana@ejemplo.es"), ("email", "joe_at_example_dot_net", "joe@example.net"),
    ("email", "\U0001d423\U0001d428@a.com", "jo@a.com"), ("ip", "192[.]168[.]1[.]10", "192.168.1.10"), ("ip", "192 dot 168 dot 1 dot 10", "192.168.1.10"), ("ip", "١٠.١.٢.٣", "10.1.2.3"),
    ("ip", "one nine two dot one six eight dot one dot one", "192.168.1.1"), ("card", "four five three nine 1488 0343 6467", "4539 1488 0343 6467"), ("card", "4539–1488–0343–6467", "4539-1488-0343-6467"),
    ("card", "4539 1488 O343 6467", "4539 1488 0343 6467"), ("card", "４５３９　１４８８ ０３４３ ６４６７", "4539 1488 0343 6467"),
    ("phone", "plus one, five five five, oh one nine two three four", "+15550192" + "34"), ("phone", "+49 three zero nine zero one eight two zero", "+49 30901820"), ("phone", "+1 double five five 0192 77", "+1 555 0192 77"),
    ("phone", "+1 555 010 9999", "+1 555 010 9999"), ("phone", "más tres cuatro nueve uno dos tres cuatro cinco", "+34912345"),
]


@pytest.mark.parametrize("kind,written,meant", DISGUISED)
def test_disguised(kind, written, meant):
    for head, tail in (("", ""), ("Schreib él ", ", ok"), ("\U0001f926 1.2.3.4 (", ") a@b.cd слово")):
        text = head + written + tail
        got = pd.personal_data(text)
        assert (kind, len(head), len(head) + len(written), True, meant) in got, got
        assert [s[:3] for s in got if not s[3]] == literal(text)
        assert sum(s[3] for s in got) == 1, got


@pytest.mark.parametrize("text", [
    "Find us at example.com today.", "Look at the dot on the map.", "I am @ home. The end.", "one two three four five", "at 5 point 3 they met", "Маша сама 1990–1995",
    "(a) first. (b) second.", "He was at home dot she said", "½ ² ① 10⁵", "l0 and O2", "plus 3 or minus 4", "call at 10.30.", "version 2.0 at last",
])
def test_clean_texts_stay_clean(text):
    assert pd.personal_data(text) == []


def test_a_number_before_a_word_keeps_its_end():
    text = "ouvi. +1 (848) 555-1373 Un an oule"
    assert pd.personal_data(text) == [("phone", 6, 23, False, "+1 (848) 555-1373")]


def test_tape_maps_back_through_all_rewrites():
    rng = random.Random(4)
    for _ in range(300):
        source = [(f"{i:03d}", i) for i in range(rng.randint(1, 30))]
        tape, origin = pd.Tape("".join(s for s, _ in source)), [(i, i + 1) for i in range(3 * len(source))]
        for _ in range(rng.randint(0, 4)):
            edits, at, made = [], 0, []
            while at < len(tape.text):
                step = rng.randint(1, 4)
                end = min(at + step, len(tape.text))
                if rng.random() < 0.3:
                    put = "x" * rng.randint(0, 5)
                    edits.append((at, end, put))
                    made += [(origin[at][0], origin[end - 1][1])] * len(put)
                else:
                    made += origin[at:end]
                at = end
            tape.rewrite(edits)
            origin = made
        for _ in range(10):
            if origin:
                a = rng.randrange(len(origin))
                b = rng.randint(a + 1, len(origin))
                assert tape.source(a, b) == (origin[a][0], origin[b - 1][1])


@pytest.mark.parametrize("unit", ["a", "a@", "1", "1.", "1 ", "+1", "1 (", " ", "o", "[", "a at ", "a_at_", "a dot ", "one ", "а", "aж", "​", "１", "&#64;", "@b.c", "x at b."])
def test_long_texts_take_linear_time(unit):
    start = time.time()
    pd.personal_data(unit * (200_000 // len(unit)) + "b dot com")
    assert time.time() - start < 10


def test_table_and_mask(spark):
    rows = [(1, "mail a@b.cd or a(at)b.cd", "s", 1), (1, "mail a@b.cd or a(at)b.cd", "s", 1), (2, None, "s", 1), (3, "", "s", 1), (None, "+1 555 010 9999", "s", 1), (4, "é " * 5000 + "1.2.3.4", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, masked int").repartition(3)
    got = {r.doc_id: ([tuple(s) for s in r.spans], r.masked) for r in pd.find_personal(df, mask=True).collect()}
    assert got[1] == ([("email", 5, 11, False, "a@b.cd"), ("email", 15, 24, True, "a@b.cd")], "mail <email> or <email>")
    assert got[2] == got[3] == ([], "") and got[None][1] == "<phone>" and got[4][0][0][1:3] == (10_000, 10_007)
    assert pd.find_personal(df).count() == 6 and pd.find_personal(df.where("false")).count() == 0


def test_query_digest(spark, tmp_path):
    text = "4539148803436467 a@b.cd, 1.2.3.4 bob(at)example.com"
    spark.createDataFrame([(7, text), (8, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in QUERIES["op13_personal_data"](spark, str(tmp_path)).collect()}
    base = "email:17:23,ip:25:32,card:0:16"
    assert rows[7].spans == "email:17:23,email:33:51,ip:25:32,card:0:16" and rows[7].n_disguised == 1
    assert rows[7].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and rows[8].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert (rows[7].n_email, rows[7].n_ip, rows[7].n_card, rows[7].n_phone) == (1, 1, 1, 0) and rows[8].spans == ""

"""The registered queries of this subpackage over the test tables, with SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorgrid.llm.decontaminate import leaks
from anchorgrid.llm.fill_middle import fill_in_middle, restored
from anchorgrid.llm.html_wrappers import main_text
from anchorgrid.llm.line_dedup import line_classes
from anchorgrid.llm.minhash import near_duplicates
from anchorgrid.llm.mixing import mix
from anchorgrid.llm.nearest import nearest
from anchorgrid.llm.personal import KINDS, find_personal
from anchorgrid.llm.quality import fit_quality, held_out, score_quality
from anchorgrid.llm.sharding import shard_table
from anchorgrid.llm.spelling import spelling_variants
from anchorgrid.llm.substring_dedup import substring_dedup
from anchorgrid.llm.warc import archive_round_trip

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return add


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SUBSTRINGS = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
spots AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS pos FROM w),
windows AS (SELECT doc_id, pos, words[pos : pos + 12] AS win FROM spots),
firsts AS (SELECT win, min(doc_id) AS first_doc FROM windows GROUP BY win),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS pos
         FROM windows JOIN firsts USING (win) WHERE first_doc < doc_id),
lost AS (SELECT doc_id, count(*) AS n, list(pos) AS spots FROM gone GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN words ELSE
    [z[1] FOR z IN list_zip(words, range(1, len(words) + 1)) IF NOT list_contains(spots, z[2])] END, ' ')) AS kept_sha256
FROM w LEFT JOIN lost USING (doc_id)
"""


@query("op1_substring_dedup", SUBSTRINGS)
def op1(spark, sf_dir):
    """Words left of every document once windows of 13 words that a smaller doc_id holds are removed."""
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


MIX = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER below, 0))::DOUBLE
               / (sum(weight) OVER () - coalesce(sum(weight) OVER below, 0))::DOUBLE AS level FROM w
      WINDOW below AS (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN level * weight >= 3 * source_size THEN 3.0::DOUBLE * source_size
        ELSE weight * (SELECT max(level) FROM l AS o WHERE o.level * o.weight < 3 * o.source_size) END AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
q AS (SELECT *, greatest(0, round(target)::BIGINT - whole * source_size) AS rest FROM r)
SELECT doc_id, size, source_size, target, (whole * size + least(size, greatest(0, rest - coalesce(sum(size) OVER
  (PARTITION BY d.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::BIGINT AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
"""


@query("op4_mix_sources", MIX)
def op4(spark, sf_dir):
    """Words of every document that a mix of all sources by weight 1, 2, 3 takes, at most three passes of a source."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op9_shard_by_bytes")
def op9(spark, sf_dir):
    """All documents in 24 shards of near-equal bytes."""
    return shard_table(table(spark, sf_dir, "documents"))


NEAREST = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum([z[1] * z[2] FOR z IN list_zip(q.v, c.v)]) AS score
      FROM v AS q JOIN v AS c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query("op5_nearest_by_product", NEAREST)
def op5(spark, sf_dir):
    """The 20 nearest of every 20th vector among all vectors."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors.where("vec_id % 20 = 0"), vectors)


WARC = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to FROM f
"""


@query("op8_warc_round_trip", WARC)
def op8(spark, sf_dir):
    """Every page written to WARC archives and read back."""
    return archive_round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("op3_quality_field")
def op3(spark, sf_dir):
    """Quality score of every document by a field fitted on labelled documents outside the held-out fifth."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = fit_quality(documents, table(spark, sf_dir, "labels"))
    scored = score_quality(documents, field)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


@query("op6_template_leaks")
def op6(spark, sf_dir):
    """Benchmark passages found in all documents, also with other numbers, names and units."""
    return leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


NEAR = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [words]
        ELSE [words[i : i + 3] FOR i IN range(1, len(words) - 2)] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
reach AS (WITH RECURSIVE r(root, node) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.root, link.b FROM r JOIN link ON link.a = r.node) SELECT root, min(node) AS least FROM r GROUP BY root)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(least, doc_id) AS component_id, doc_id = coalesce(least, doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN reach ON root = doc_id
"""


@query("op2_near_duplicates", NEAR)
def op2(spark, sf_dir):
    """Components of documents that share at least 80 of 100 of their word 4-shingles."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op10_main_text")
def op10(spark, sf_dir):
    """Main text of every page along the wrapper of its host."""
    return main_text(table(spark, sf_dir, "pages"))


LINES = r"""
WITH r AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM documents WHERE text IS NOT NULL),
l AS (SELECT line, min((doc_id, line_no)) AS place, count(*) AS n_rows, length(line) AS n FROM r WHERE line <> '' GROUP BY line),
link AS (SELECT a.line AS a, b.line AS b FROM l AS a JOIN l AS b ON a.n >= 24 AND b.n BETWEEN a.n AND a.n + 2 AND b.n >= 24
  AND a.line <> b.line AND levenshtein(a.line, b.line) <= 2
  AND (substr(a.line, 1, a.n // 3) = substr(b.line, 1, a.n // 3) OR contains(b.line, substr(a.line, 1 + a.n // 3, a.n // 3)) OR right(a.line, a.n // 3) = right(b.line, a.n // 3))),
two AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (WITH RECURSIVE s(root, node) AS (SELECT a, a FROM two UNION SELECT s.root, two.b FROM s JOIN two ON two.a = s.node) SELECT root, min(l.place) AS class FROM s JOIN l ON l.line = s.node GROUP BY root),
k AS (SELECT a AS line, count(*) AS n_links FROM two GROUP BY a)
SELECT place[1] AS doc_id, place[2]::INTEGER AS line_no, n_rows, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(class, place)[1] AS class_doc_id,
  coalesce(class, place)[2]::INTEGER AS class_line_no, coalesce(class, place) = place AS kept
FROM l LEFT JOIN k USING (line) LEFT JOIN reach ON root = line
"""


@query("op7_near_lines", LINES)
def op7(spark, sf_dir):
    """Classes of all different lines of all documents under two edits."""
    return line_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


SPELLING = r"""
WITH RECURSIVE t AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
g AS (SELECT doc_id, run, count(*)::BIGINT AS n FROM t WHERE length(run) >= 7 GROUP BY ALL),
crc AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) AS r(i))),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || b)::BIGINT FOR b IN regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, 'null') || ':' || run)), '..')]),
        lambda c, x: xor(c // 256, tab[xor(c % 256, x) + 1])), 4294967295) AS h FROM g, crc),
r AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM r WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
holes AS (SELECT word, n, unnest(range(0, length(word) + 1)) AS i, CASE WHEN i = 0 THEN word ELSE substr(word, 1, i - 1) || substr(word, i + 1) END AS hole FROM w),
pairs AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m FROM holes AS a JOIN holes AS b ON a.hole = b.hole AND a.word <> b.word AND (a.i = b.i OR a.i = 0 OR b.i = 0)),
best AS (SELECT word, count(*) AS n_near, min((-m, other)) AS best FROM pairs GROUP BY word),
f AS (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best[1] >= 10 * n THEN best[2] END AS form, CASE WHEN -best[1] >= 10 * n THEN -best[1] END AS form_n FROM w LEFT JOIN best USING (word)),
up AS (SELECT word, form AS root, 1 AS step FROM f WHERE form IS NOT NULL UNION ALL SELECT up.word, f.form, step + 1 FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL),
last AS (SELECT word, arg_max(root, step) AS root FROM up GROUP BY word)
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n::BIGINT AS form_n FROM f LEFT JOIN last ON last.word = f.word
"""


@query("op11_spelling_variants", SPELLING)
def op11(spark, sf_dir):
    """The usual spelling of every word of all documents among the words one edit away."""
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


MIDDLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents),
h AS (SELECT *, ('0x' || k[1:8])::BIGINT % (n + 1) AS u1, ('0x' || k[9:16])::BIGINT % (n + 1) AS u2,
        CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || k[17:24])::BIGINT % 100 >= 90 THEN 'plain'
             WHEN ('0x' || k[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT *, substr(text, 1, least(u1, u2)) AS p, substr(text, 1 + least(u1, u2), abs(u1 - u2)) AS m, substr(text, 1 + greatest(u1, u2)) AS s FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(u1, u2) END AS prefix_chars, CASE WHEN form <> 'plain' THEN abs(u1 - u2) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM c
"""


@query("op12_fill_in_middle", MIDDLE)
def op12(spark, sf_dir):
    """All documents with their middle moved to the end, and the texts got back from that."""
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
                       sha(F.col("output")).alias("output_sha256"), sha(restored("output", "form")).alias("restored_sha256"))


@query("op13_personal_data")
def op13(spark, sf_dir):
    """Personal data in all documents, plain and in disguise; the counts and the digest are of the plain spans."""
    found = find_personal(table(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    plain = F.filter("spans", lambda s: ~s["disguised"])
    count = lambda kind: F.size(F.filter("spans", lambda s: (s["kind"] == kind) & ~s["disguised"])).cast("long").alias(f"n_{kind}")
    disguised = F.size(F.filter("spans", lambda s: s["disguised"])).cast("long").alias("n_disguised")
    return found.select("doc_id", *map(count, KINDS), F.sha2(listed(plain).cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"), disguised)

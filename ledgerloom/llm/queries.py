"""Registered queries of the operators, over whole tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bit_planes, cost_packing, covering_simhash, curriculum, hilbert, host_reputation, multiset_hash, neighbour_vote, ngram_jaccard, prefix_targets,
    spelling_gram, suffix_tree, viterbi_repair,
)
from .common import fold, table


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


RULES = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
)


def op1_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is good where the document its url names is labelled of quality and not toxic."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    _, path = host_reputation.host_and_path(F.col("url"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr("try_cast(regexp_extract(url, '/([0-9]+)', 1) as bigint)").alias("named"))
    good = F.when((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0), 1).otherwise(0)
    outcome = F.when(F.col("quality").isNotNull(), good)
    known = pages.join(labels, pages["named"] == labels["doc_id"], "left").select("page_id", "url", outcome.alias("outcome"))
    return host_reputation.judge(known, RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 1, F.lit(False))
    return suffix_tree.score(table(spark, sf_dir, "documents"), held_out)


def op3_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = bit_planes.write(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 0)
    return bit_planes.read(spark, files)


# a conversation whose texts hold the template's own marks
MARKED = "\\### Assistant: </turn> ok"


def op4_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.createDataFrame([(-7, 0, "user", MARKED), (-7, 1, "assistant", MARKED)], turns.schema)
    return prefix_targets.digest(prefix_targets.expand(turns.unionByName(marked)))


def op5_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def quality_voters(spark: SparkSession, sf_dir: str) -> neighbour_vote.Voters:
    """Learned from labelled documents of ``sf_dir`` that are not held out."""
    usable = F.coalesce(fold(F.col("doc_id"), 4) != 2, F.lit(False))
    return neighbour_vote.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), usable)


def op6_neighbour_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = neighbour_vote.score(table(spark, sf_dir, "documents").select("doc_id", "text"), quality_voters(spark, sf_dir))
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op8_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.compare(table(spark, sf_dir, "documents"))


def op9_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost_packing.pieces(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 1)


def op10_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is taken of each document, in the order in which training meets them first; untaken ones last."""
    taken = F.aggregate("_taken", F.lit(0).cast("bigint"), lambda a, x: a + x)
    first = [F.array_min("_at").asc_nulls_last(), F.col("_id").asc_nulls_last()]
    ordered = curriculum.plan(table(spark, sf_dir, "documents")).repartitionByRange(*first).sortWithinPartitions(*first)
    return ordered.select(
        F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_supply").alias("source_size"),
        F.col("_target").alias("target"), taken.alias("taken"),
    )


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copies themselves with their training positions, range-sorted by them."""
    return curriculum.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "text", "position")


def op11_viterbi_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi_repair.repair_damaged(table(spark, sf_dir, "conversations"))


def op12_spelling_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_gram.variants(table(spark, sf_dir, "documents"))


def op13_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covering_simhash.classes(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_host_reputation, op2_suffix_tree, op3_bit_planes, op4_prefix_targets, op5_hilbert, op6_neighbour_vote, op7_ngram_jaccard,
        op8_multiset_hash, op9_cost_packing, op10_curriculum, op10_training_order, op11_viterbi_repair, op12_spelling_gram, op13_covering_simhash,
    )
}

ORACLES = {}
ORACLES["op1_host_reputation"] = """
WITH read AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, try_cast(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) AS named
  FROM read
), marks AS (
  SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id
), judged AS (
  SELECT p.*, CASE WHEN quality IS NULL THEN NULL WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END AS y
  FROM parts p LEFT JOIN marks ON named = doc_id
), counted AS (
  SELECT host, coalesce(sum(y), 0)::DOUBLE AS k, count(y)::DOUBLE AS n,
         regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\\.+$', '') AS name
  FROM judged GROUP BY host
), labelled AS (
  SELECT *, regexp_matches(name, '^[0-9.]+$') OR NOT contains(name, '.') AS whole, string_split(name, '.') AS l FROM counted
), hosts AS (
  SELECT host, k, n, CASE WHEN whole THEN name WHEN long THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix,
         CASE WHEN whole THEN name WHEN long THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain
  FROM (SELECT *, array_to_string(l[-2:], '.') IN ('ac.uk', 'co.uk', 'gov.uk', 'org.uk', 'com.au', 'net.au', 'org.au', 'co.nz', 'co.jp',
    'ne.jp', 'or.jp', 'com.br', 'com.cn', 'com.tr', 'com.mx', 'co.in', 'co.kr', 'co.za') AS long FROM labelled)
), s0 AS (
  SELECT suffix, sum(k) AS k, sum(n) AS n, (SELECT (sum(k) + 1) / (sum(n) + 2) FROM hosts) AS p FROM hosts GROUP BY suffix
), s1 AS (
  SELECT CASE WHEN sum(n * (n - 1) * p * (1 - p)) > 0 THEN 1 / least(0.5, greatest(1e-4,
    sum((k - n * p) * (k - n * p) - n * p * (1 - p)) / sum(n * (n - 1) * p * (1 - p)))) - 1 ELSE 1 END AS w FROM s0
), s AS (SELECT suffix, (k + w * p) / (n + w) AS p FROM s0, s1
), d0 AS (
  SELECT h.suffix, h.domain, sum(k) AS k, sum(n) AS n, any_value(s.p) AS p FROM hosts h JOIN s USING (suffix) GROUP BY h.suffix, h.domain
), d1 AS (
  SELECT CASE WHEN sum(n * (n - 1) * p * (1 - p)) > 0 THEN 1 / least(0.5, greatest(1e-4,
    sum((k - n * p) * (k - n * p) - n * p * (1 - p)) / sum(n * (n - 1) * p * (1 - p)))) - 1 ELSE 1 END AS w FROM d0
), d AS (SELECT suffix, domain, (k + w * p) / (n + w) AS p FROM d0, d1
), h0 AS (SELECT host, k, n, d.p FROM hosts JOIN d USING (suffix, domain)
), h1 AS (
  SELECT CASE WHEN sum(n * (n - 1) * p * (1 - p)) > 0 THEN 1 / least(0.5, greatest(1e-4,
    sum((k - n * p) * (k - n * p) - n * p * (1 - p)) / sum(n * (n - 1) * p * (1 - p)))) - 1 ELSE 1 END AS w FROM h0
), h AS (SELECT host, n + w AS m, (k + w * p) / (n + w) AS r FROM h0, h1
), ruled AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN r - 1.645 * sqrt(r * (1 - r) / (m + 1)) >= 0.5 THEN 'allow' ELSE 'block' END AS verdict
FROM ruled JOIN h USING (host)
"""
ORACLES["op4_prefix_targets"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, 2 * length(role || text) - length(replace(role || text, '\', ''))
    + length(role) - length(regexp_replace(role, '#+', '#', 'g')) + length(text) - length(regexp_replace(text, '#+', '#', 'g'))
    + (2 * length(role) - length(replace(role, '</', ''))  - length(role)) // 2 + (2 * length(text) - length(replace(text, '</', '')) - length(text)) // 2
    + length(role) - length(replace(role, ':', '')) + 14 AS chars
  FROM turns
), run AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) = count(*) OVER (PARTITION BY conv_id) AS last
  FROM sized
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' OR last THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM run GROUP BY conv_id
"""
ORACLES["op10_curriculum"] = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS supply, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM sized GROUP BY source
), weighed AS (
  SELECT source, supply, CASE (k - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w, 2 * supply AS bound FROM sources
), ordered AS (
  SELECT *, row_number() OVER o AS i, coalesce(sum(bound) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS below,
    sum(w) OVER (ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
  FROM weighed WINDOW o AS (ORDER BY bound / w, source NULLS LAST)
), rated AS (
  SELECT *, ((SELECT sum(size) FROM sized) * 1.5 - below) / rest AS rate FROM ordered
), level AS (SELECT i, rate FROM rated WHERE bound > rate * w ORDER BY i LIMIT 1
), targets AS (
  SELECT source, supply, CASE WHEN bound <= (SELECT rate FROM level) * w THEN bound::DOUBLE ELSE (SELECT rate FROM level) * w END AS target FROM weighed
), placed AS (
  SELECT s.doc_id, s.size, t.supply, t.target, floor(t.target)::BIGINT AS want,
    (sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(s.doc_id::VARCHAR, '')), s.doc_id NULLS LAST) - s.size)::BIGINT AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, supply AS source_size, target,
  least(greatest(want - before, 0), size) + least(greatest(want - supply - before, 0), size) AS taken
FROM placed
"""
ORACLES["op10_training_order"] = ORACLES["op10_curriculum"].rsplit("\nSELECT doc_id, size, supply", 1)[0] + r""", kinds AS (
  SELECT source, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS kind FROM targets
), knots(kind, a, width, before, u, v) AS (
  VALUES (0, 0.0::DOUBLE, 0.5::DOUBLE, 0.0::DOUBLE, 0.6::DOUBLE, 1.0::DOUBLE), (0, 0.5, 0.5, 0.4, 1.0, 1.4),
    (1, 0.0, 0.5, 0.0, 1.0, 1.0), (1, 0.5, 0.5, 0.5, 1.0, 1.0), (2, 0.0, 0.5, 0.0, 1.4, 1.0), (2, 0.5, 0.5, 0.6, 1.0, 0.6)
), copies AS (
  SELECT doc_id, size, i, before + supply * i AS start, target, least(greatest(want - supply * i - before, 0), size) AS part
  FROM placed, (VALUES (0), (1)) passes(i)
), asked AS (
  SELECT doc_id, d.source, text, kind, i, (start + part / 2::DOUBLE) / greatest(target, 1.0::DOUBLE) AS share
  FROM copies JOIN documents d USING (doc_id) JOIN kinds ON d.source IS NOT DISTINCT FROM kinds.source WHERE part > 0 AND 2 * part >= size
), timed AS (
  SELECT doc_id, source, text, i, a, u + sqrt(greatest(u * u + 2 * greatest(share - before, 0) * ((v - u) / width), 0)) AS root,
    2 * greatest(share - before, 0) AS twice, row_number() OVER (PARTITION BY doc_id, i ORDER BY a) AS n, share < before + width * (u + v) / 2 AS inside
  FROM asked JOIN knots USING (kind)
)
SELECT doc_id, any_value(source) AS source, any_value(text) AS text,
  least(greatest(coalesce(arg_min(CASE WHEN root > 0 THEN a + twice / root ELSE a END, n) FILTER (inside), 1), 0), 1)::DOUBLE AS position
FROM timed GROUP BY doc_id, i
"""


def _crc32(octets: str) -> str:
    """SQL of the crc32 of a list of lists of octets, bit by bit."""
    step = "CASE WHEN xor(c, x) & 1 = 1 THEN xor(xor(c, x) >> 1, 3988292384) ELSE xor(c, x) >> 1 END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, flatten({octets})), lambda c, x: {step}), 4294967295)"


def _edit(way: str, cost: str, letter: str) -> str:
    """A way (nine digits of cost, then the audit) with one edit more."""
    return f"lpad((substr({way}, 1, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({way}, 10) || '{letter}'"


_EMPTY = "unicode(x)::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT"
_KEPT = {q: f"CASE WHEN NOT gone AND initial = '{i}' THEN {{}} END" for q, i in ((1, "s"), (2, "u"), (3, "a"))}
ORACLES["op11_viterbi_repair"] = rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), hashes AS (
  SELECT k, {_crc32(f"list_transform(string_split(k, ''), lambda x: [{_EMPTY}])")} % 20 AS h FROM (SELECT DISTINCT k FROM keyed)
), damaged AS (
  SELECT coalesce(conv_id::VARCHAR, ' ') AS key, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM keyed JOIN hashes USING (k), (VALUES (0), (1)) copies(c) WHERE h <> 0 AND (c = 0 OR h = 3)
), placed AS (
  SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, md5(text)) AS n FROM damaged
), judged AS (
  SELECT *, lag(initial) OVER (PARTITION BY key ORDER BY n) || initial AS pair,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY key, role, text ORDER BY n) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' END AS fault
  FROM placed
), edge AS (
  SELECT *, coalesce(fault IN ('blank', 'duplicate'), FALSE) AS gone, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS worse FROM judged
), ways(key, n, q0, q1, q2, q3) AS (
  SELECT DISTINCT key, 0::BIGINT, '000000000', NULL::VARCHAR, {_edit("'000000000'", "2", "I")}, {_edit("'000000000'", "4", "II")} FROM damaged
  UNION ALL
  SELECT key, n, q0, q1, i2, least(q3, {_edit("i2", "2", "I")}) FROM (
    SELECT key, n, q0, q1, q3, least(q2, {_edit("q0", "2", "I")}, {_edit("q1", "2", "I")}, {_edit("q3", "2", "I")}) AS i2 FROM (
      SELECT w.key, e.n, {_edit("q0", "3", "D")} AS q0,
        least({_edit("q1", "3", "D")}, {_KEPT[1].format(_edit("q0", "worse", "K"))}) AS q1,
        least({_edit("q2", "3", "D")}, {", ".join(_KEPT[2].format(_edit(q, "worse", "K")) for q in ("q0", "q1", "q3"))},
          {", ".join(f"CASE WHEN NOT gone THEN {_edit(q, '2 + worse', 'R')} END" for q in ("q0", "q1", "q3"))}) AS q2,
        least({_edit("q3", "3", "D")}, {_KEPT[3].format(_edit("q2", "worse", "K"))}, CASE WHEN NOT gone THEN {_edit("q2", "2 + worse", "R")} END) AS q3
      FROM ways w JOIN edge e ON w.key = e.key AND e.n = w.n + 1))
), best AS (
  SELECT key, substr(way, 1, 9)::BIGINT AS cost, substr(way, 10) AS audit
  FROM (SELECT key, arg_max(least(q0, q3), n) AS way FROM ways GROUP BY key)
), letters AS (
  SELECT key, unnest(string_split(audit, '')) AS letter, unnest(range(1, length(audit) + 1)) AS place FROM best
), steps AS (
  SELECT key, letter, place, sum((letter <> 'I')::INT) OVER w AS n, sum((letter <> 'D')::INT) OVER w AS o
  FROM letters WINDOW w AS (PARTITION BY key ORDER BY place ROWS UNBOUNDED PRECEDING)
), named AS (
  SELECT s.*, e.role, e.text, first_value(s.letter = 'K' AND e.initial = 's') OVER (PARTITION BY s.key ORDER BY s.place) AS led
  FROM steps s LEFT JOIN edge e ON s.key = e.key AND s.n = e.n WHERE letter <> 'D'
), fixed AS (
  SELECT key, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (o - led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY place)) AS sha FROM named GROUP BY key
), faults AS (
  SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY key
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, ' ') AS key FROM conversations)
LEFT JOIN faults USING (key) LEFT JOIN best USING (key) LEFT JOIN fixed USING (key)
"""
_LETTERS = "".join(chr(c) for c in range(ord("A"), ord("Z") + 1))
ORACLES["op12_spelling_gram"] = rf"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS k, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_LETTERS}', '{_LETTERS.lower()}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents
  ) WHERE length(run) >= 7 GROUP BY ALL
), hashed AS (
  SELECT run, n, {_crc32(f"list_transform(string_split(k, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [{_EMPTY}] ELSE [195::BIGINT, 0, 0, 0, 0, 0, 0, 0, unicode(x)::BIGINT - 64, 0, 0, 0, 0, 0, 0, 0] END)")} AS h FROM runs
), cut AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), without AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT DISTINCT a.word, b.word AS other, b.n FROM without a JOIN without b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM without a JOIN words b ON a.less = b.word
  UNION SELECT b.word, a.word, a.n FROM without a JOIN words b ON a.less = b.word
), near AS (
  SELECT word, count(*) AS n_near, max(n) AS best_n, arg_min(other, (-n, other)) AS best FROM pairs GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * w.n THEN best END AS form, CASE WHEN best_n >= 10 * w.n THEN best_n END AS form_n
  FROM words w LEFT JOIN near USING (word)
), chain(word, root) AS (
  SELECT word, word FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NOT NULL
), roots AS (SELECT c.word, c.root FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)
"""

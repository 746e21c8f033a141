"""Registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_personal_data

    return find_personal_data(_read(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contamination

    # proximity matches have no SQL counterpart; op5_proximity returns them
    return contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("n_near", "near_items")


def op5_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contamination

    found = contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_near", "near_items", "contaminated")


def op6_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ppm import score_documents

    return score_documents(_read(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import hypergeometric_shuffle

    placed = hypergeometric_shuffle(_read(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest_neighbours

    return nearest_neighbours(_read(spark, sf_dir, "embeddings"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import line_report

    return line_report(_read(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_components

    return simhash_components(_read(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece import digest, read_model

    return digest(_read(spark, sf_dir, "documents"), read_model())


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import classify_toxicity

    return classify_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify_quality

    return classify_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import repair_conversations

    return repair_conversations(_read(spark, sf_dir, "conversations"))


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import repeat_report

    return repeat_report(_read(spark, sf_dir, "documents"))


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked import rank_documents

    return rank_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": op1_ann,
    "op2_line_dedup": op2_line_dedup,
    "op3_simhash": op3_simhash,
    "op4_pii": op4_pii,
    "op5_decontamination": op5_decontamination,
    "op5_proximity": op5_proximity,
    "op6_ppm": op6_ppm,
    "op7_sharding": op7_sharding,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_toxicity": op9_toxicity,
    "op10_quality": op10_quality,
    "op11_conversations": op11_conversations,
    "op12_repeats": op12_repeats,
    "op13_ranked": op13_ranked,
}

def _repair_sql() -> str:
    """Conversations by a recursive fold: cost, audit and lines of the best way into each state, row after row."""

    def way(state: str, cost: str, letter: str, line: str | None = None) -> str:
        lines = f"{state}.o" if line is None else f"list_append({state}.o, {line})"
        return f"struct_pack(c := {state}.c + {cost}, a := {state}.a || '{letter}', o := {lines})"

    def states(nothing: str, system: str, user: str, assistant: str) -> str:
        return f"[{nothing}, {system}, {user}, {assistant}]"

    def bound(value: str, body: str) -> str:
        return f"list_transform([{value}], lambda l: {body})[1]"

    insert = [way(f"l[{k}]", "5", "I", "'user:'") for k in (1, 2, 4)]
    closed = states("l[1]", "l[2]", f"list_min([l[3], {', '.join(insert)}])", f"list_min([l[4], {way('l[3]', '5', 'I', chr(39) + 'assistant:' + chr(39))}])")

    def keep(k: int, initial: str) -> str:
        return way(f"l[{k}]", f"(CASE WHEN must OR initial <> '{initial}' THEN 1000000 ELSE extra END)", "K", "role || ':' || text")

    def rerole(k: int, to: str) -> str:
        return way(f"l[{k}]", "(CASE WHEN must THEN 1000000 ELSE extra + 1 END)", "R", f"'{to}:' || text")

    gone = [way(f"l[{k}]", "2", "D") for k in (1, 2, 3, 4)]
    to_user = [f(k, x) for k in (1, 2, 4) for f, x in ((keep, "u"), (rerole, "user"))]
    step = states(gone[0], f"list_min([{gone[1]}, {keep(1, 's')}])", f"list_min([{gone[2]}, {', '.join(to_user)}])", f"list_min([{gone[3]}, {keep(3, 'a')}, {rerole(3, 'assistant')}])")

    def inserted(value: str) -> str:
        return bound(bound(bound(value, closed), closed), closed)

    start = "struct_pack(c := 0, a := '', o := CAST([] AS VARCHAR[]))"
    none = "struct_pack(c := 1000000, a := '', o := CAST([] AS VARCHAR[]))"
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH RECURSIVE given AS (
  SELECT conv_id AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
coded AS (
  SELECT *, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(name, ''),
              lambda x: [CAST(ord(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
            lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1))), 4294967295) % 20 AS code FROM given),
hurt AS (
  SELECT conv, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE code WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM coded WHERE code <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS pos, rtrim(text, {white}) AS bare FROM hurt),
faulty AS (
  SELECT *, bare = '' AS blank, bare <> '' AND row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 AS late,
         role[1] || lead(role[1]) OVER (PARTITION BY conv ORDER BY pos) AS pair FROM placed),
line AS (
  SELECT *, NOT blank AND NOT late AND right(bare, 1) NOT IN ('.', '!', '?') AS cut FROM faulty),
row AS (SELECT conv, pos, role, text, role[1] AS initial, blank OR late AS must, CASE WHEN cut THEN 5 ELSE 0 END AS extra FROM line),
sums AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (late) AS duplicate, count(*) FILTER (cut) AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS rows FROM line GROUP BY conv),
walk AS (
  SELECT conv, CAST(0 AS BIGINT) AS pos, {inserted(states(start, none, none, none))} AS l FROM sums
  UNION ALL
  SELECT w.conv, w.pos + 1, {inserted(bound("w.l", step))} FROM walk w JOIN row r ON r.conv IS NOT DISTINCT FROM w.conv AND r.pos = w.pos + 1),
best AS (SELECT w.conv, list_min([l[1], l[4]]) AS b FROM walk w JOIN sums s ON s.conv IS NOT DISTINCT FROM w.conv AND s.rows = w.pos)
SELECT i.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(b.c, 0) AS BIGINT) AS cost,
       coalesce(b.a, '') AS audit, sha256(coalesce(array_to_string(b.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN sums ON sums.conv IS NOT DISTINCT FROM i.conv_id LEFT JOIN best ON best.conv IS NOT DISTINCT FROM i.conv_id
"""


ORACLE_SQL: dict[str, str] = {
    # lines by word sets; pairs that share one of their rarest words, compared on all words
    "op2_line_dedup": r"""
WITH cut AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
line AS (
  SELECT doc_id, i - 1 AS line_no,
         list_sort(list_distinct(list_filter(string_split_regex(ls[i], '[\x09\x0B-\x0D ]+'), lambda x: x <> ''))) AS w
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM cut)),
node AS (
  SELECT row_number() OVER (ORDER BY min(struct_pack(d := doc_id, l := line_no))) AS id, w,
         min(struct_pack(d := doc_id, l := line_no)) AS first
  FROM line WHERE len(w) > 0 GROUP BY w),
freq AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM line) GROUP BY word),
ranked AS (
  SELECT id, size, word, row_number() OVER (PARTITION BY id ORDER BY freq.n, word) AS place
  FROM (SELECT id, len(w) AS size, unnest(w) AS word FROM node) JOIN freq USING (word)),
head AS (SELECT * FROM ranked WHERE place <= size - (size * 4 + 4) // 5 + 1),
pair AS (SELECT DISTINCT a.id AS a, b.id AS b FROM head a JOIN head b USING (word)
         WHERE a.id < b.id AND a.size * 5 >= b.size * 4 AND b.size * 5 >= a.size * 4),
near AS (
  SELECT DISTINCT b FROM pair JOIN node x ON x.id = pair.a JOIN node y ON y.id = pair.b
  WHERE len(list_intersect(x.w, y.w)) * 9 >= (len(x.w) + len(y.w)) * 4),
gone AS (
  SELECT line.doc_id, line_no, struct_pack(d := line.doc_id, l := line_no) <> node.first AS exact
  FROM line JOIN node USING (w) LEFT JOIN near ON near.b = node.id
  WHERE struct_pack(d := line.doc_id, l := line_no) <> node.first OR near.b IS NOT NULL),
sums AS (
  SELECT doc_id, count(*) FILTER (exact) AS e, count(*) FILTER (NOT exact) AS n,
         string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS numbers
  FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(e, 0) AS BIGINT) AS n_exact,
       CAST(coalesce(n, 0) AS BIGINT) AS n_near, CAST(len(ls) - coalesce(e, 0) - coalesce(n, 0) AS BIGINT) AS n_kept,
       sha256(coalesce(numbers, '')) AS removed_sha256
FROM cut LEFT JOIN sums USING (doc_id)
""",
    # words, windows and hits by brute force: every document word position against every window of that length
    "op5_decontamination": r"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (
  SELECT DISTINCT item, len(piece) AS size, list_aggregate(piece, 'string_agg', ' ') AS phrase FROM (
    SELECT item, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: w[i:i + 9])) AS piece
    FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
gram AS (
  SELECT r, size, i, list_aggregate(w[i:i + size - 1], 'string_agg', ' ') AS phrase FROM (
    SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc, sizes WHERE len(w) >= size)),
hit AS (SELECT g.r, g.i, g.size, win.item FROM gram g JOIN win USING (size, phrase)),
places AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hit) GROUP BY r),
ids AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(places.n, 0) AS n_hit, coalesce(ids.n, 0) AS n_items,
       sha256(coalesce(ids.s, '')) AS items_sha256, coalesce(places.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN places USING (r) LEFT JOIN ids USING (r)
""",
    "op11_conversations": _repair_sql(),
    # every window as a string, numbered by place among its equals
    "op12_repeats": r"""
WITH doc AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x09-\x0D ]+'), lambda x: x <> '') AS w FROM documents),
win AS (
  SELECT doc_id, i, list_aggregate(w[i:i + 19], 'string_agg', ' ') AS phrase
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM doc WHERE len(w) >= 20)),
again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY phrase ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM again),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS rest
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM doc) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(rest, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)
""",
    # every document's score for every item
    "op13_ranked": r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
stats AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS words FROM doc WHERE len(w) > 0),
item AS (
  SELECT row_number() OVER () AS q, item_id,
         list_distinct(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS w FROM benchmark),
asked AS (SELECT q, unnest(w) AS term FROM item),
post AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM doc) WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
weighed AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM post, stats GROUP BY term, docs),
part AS (
  SELECT r, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(doc.w) * docs) // words))) AS points
  FROM post JOIN weighed USING (term) JOIN doc USING (r), stats),
scored AS (SELECT q, r, CAST(sum(points) AS BIGINT) AS score FROM asked JOIN part USING (term) GROUP BY q, r HAVING sum(points) > 0),
ranked AS (
  SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scored JOIN doc USING (r))
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked JOIN item USING (q) WHERE rank <= 10
""",
}

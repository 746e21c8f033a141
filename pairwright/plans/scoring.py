"""Queries of scorers, normalisers, token arithmetic, pairing and file formats, over texts, vectors and files made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions import arrays
from pairwright.functions import text as tx
from pairwright.operators import integrity, pairing
from pairwright.session import scratch, table
from pairwright.sources import readers, sinks

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
PER_FILE = 100_000


def _query(sql: str):
    def add(function):
        QUERIES[function.__name__] = function
        ORACLE_SQL[function.__name__] = sql
        return function

    return add


@_query("""
WITH o AS (SELECT o_orderkey AS id, o_orderkey % 6 AS k, o_custkey AS a, 2 + o_orderkey % 7 AS b FROM orders)
SELECT id, round(CASE k WHEN 0 THEN a / b WHEN 1 THEN a / b WHEN 2 THEN a * 1000.0 WHEN 3 THEN a WHEN 4 THEN a + 1 ELSE a / 4 END, 6) AS got,
       k <> 4 AS correct, CASE k WHEN 2 THEN a * 1000 % 1000 = 0 WHEN 4 THEN false ELSE true END AS lenient FROM o
""")
def math_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in six layouts (fraction, box, thousands, degrees, a wrong one, last line) scored strictly and leniently."""
    a, b = F.col("o_custkey").cast("string"), (F.col("o_orderkey") % 7 + 2).cast("string")
    k = F.col("o_orderkey") % 6

    def text(*parts):
        return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])

    reply = (
        F.when(k == 0, text("First, 3 apples.\nAnswer: $\\frac{", a, "}{", b, "}$\n"))
        .when(k == 1, text("thus $x = 1$ and\n\\boxed{\\dfrac{", a, "}{", b, "}}."))
        .when(k == 2, text("It is \\boxed{", F.format_string("%,d", F.col("o_custkey").cast("bigint") * 1000), "}"))
        .when(k == 3, text("Answer: 1\nNo.\nAnswer:  ", a, "^{\\circ}"))
        .when(k == 4, text("Answer: ", (F.col("o_custkey") + 1).cast("string")))
        .otherwise(text("We add.\n\n \\left( no \\right)\n  $\\frac{", a, "}{4}$  \n\n"))
    )
    want = F.when(k <= 1, text(a, " / ", b)).when(k == 2, text(a, "000")).when(k == 5, text("\\tfrac{", a, "}{4}")).otherwise(a)
    got = tx.normalize_strict(tx.math_answer(reply))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.round(tx.number(got), 6).alias("got"),
        tx.score_math(reply, want).alias("correct"),
        tx.equivalent(got, F.regexp_replace(want, " ", "")).alias("lenient"),
    )


@_query("""
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 4 THEN chr(CAST(65 + (o_orderkey // 5) % 4 AS INTEGER)) END AS letter,
       o_orderkey % 5 <> 4 AND (o_orderkey // 5) % 4 = o_custkey % 4 AS correct FROM orders
""")
def mmlu_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters behind a mark, in bold or brackets, and letters that stand alone near the end; the last one counts."""
    k, n = F.col("o_orderkey") % 5, (F.floor(F.col("o_orderkey") / 5) % 4 + 1).cast("int")
    letter = F.substring(F.lit("ABCD"), n, F.lit(1))
    reply = (
        F.when(k == 0, F.concat(F.lit("A or B?\nAnswer: ("), letter, F.lit(")")))
        .when(k == 1, F.concat(F.lit("Answer: D.\nWait.\nanswer : **"), F.lower(letter), F.lit("** it is")))
        .when(k == 2, F.concat(F.lit("C is tempting.\nStill\nit must be "), letter, F.lit(".")))
        .when(k == 3, F.concat(letter, F.lit(" is right\n\nIndeed\n  ")))
        .otherwise("No idea.\nAs before.\nDone.")
    )
    rows = table(spark, sf_dir, "orders").withColumn("reply", reply)
    return rows.select(F.col("o_orderkey").alias("id"), tx.mmlu_answer("reply").alias("letter"), tx.score_mmlu("reply", (F.col("o_custkey") % 4).cast("int")).alias("correct"))


@_query("""
WITH n AS (SELECT item_id, translate(substr(text, 4, 4), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS needle FROM benchmark),
c AS (SELECT conv_id, turn, text, conv_id % (SELECT count(*) FROM benchmark) AS item_id FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, contains(lower(text), lower(needle)) AS found FROM c JOIN n USING (item_id)
""")
def needle_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a turn holds four characters of a benchmark item, whatever their case."""
    needle = F.translate(F.substring("text", 4, 4), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    items = table(spark, sf_dir, "benchmark").select("item_id", needle.alias("needle"))
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL").withColumn("item_id", F.col("conv_id") % F.lit(items.count()))
    return turns.join(items, "item_id").select("conv_id", "turn", tx.score_needle("text", "needle").alias("found"))


@_query(r"""
WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '[ \n]+'), lambda x: x <> '') AS w FROM conversations WHERE text IS NOT NULL),
a AS (SELECT conv_id, turn, coalesce(w[1], '') || '  ' || coalesce(w[2], '') AS pair, coalesce(w[CASE WHEN turn % 2 = 0 THEN 1 ELSE 3 END], '') AS gold FROM w),
f AS (SELECT conv_id, turn, regexp_replace(trim(lower(trim(' "' || pair || '." ')), '"''`.,:; '), '\s+', ' ', 'g') AS form,
             regexp_replace(trim(lower(trim(gold)), '"''`.,:; '), '\s+', ' ', 'g') AS g FROM a)
SELECT conv_id, turn, form, form = g AS exact, length(form) >= 3 AND length(g) >= 3 AND (contains(form, g) OR contains(g, form)) AS lenient FROM f
""")
def qa_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two words of a turn, quoted, as an answer, and one of the turn as the right one: equal forms, or one in the other."""
    words = F.filter(F.split("text", r"[ \n]+"), lambda x: x != "")
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL").withColumn("w", words)

    def word(i):
        return F.coalesce(F.get("w", i), F.lit(""))

    answer = F.concat(F.lit(' "'), word(F.lit(0)), F.lit("  "), word(F.lit(1)), F.lit('." '))
    rows = rows.withColumns({"answer": answer, "gold": word(F.when(F.col("turn") % 2 == 0, 0).otherwise(2))})
    return rows.select(
        "conv_id", "turn", tx.qa_form("answer").alias("form"), (tx.qa_form("answer") == tx.qa_form("gold")).alias("exact"), tx.qa_lenient("answer", "gold").alias("lenient")
    )


@_query("""
WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS x FROM conversations)
SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN NULL WHEN 1 THEN sha256(x || chr(10)) ELSE sha256(x) END AS code_sha256,
       CASE turn % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS n_blocks FROM c
""")
def code_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last fenced block of replies with none, one (with a language) or two blocks, which hold the turns' own texts."""
    x, k = F.coalesce("text", F.lit("")), F.col("turn") % 3
    reply = F.when(k == 0, x).when(k == 1, F.concat(F.lit("See:\n```python\n"), x, F.lit("\n```\nDone."))).otherwise(F.concat(F.lit("```\nfirst\n``` then ```sql\n"), x, F.lit("```")))
    rows = table(spark, sf_dir, "conversations").withColumn("reply", reply)
    return rows.select("conv_id", "turn", F.sha2(tx.last_code_block("reply").cast("binary"), 256).alias("code_sha256"), F.size(tx.code_blocks("reply")).alias("n_blocks"))


@_query("""
WITH l AS (SELECT vec_id, list_transform(embedding[1:16], lambda x: CAST(x AS DOUBLE) * 6) AS z FROM embeddings WHERE len(embedding) >= 16),
e AS (SELECT vec_id, list_transform(z, lambda x: exp(x - list_max(z))) AS w FROM l),
p AS (SELECT vec_id, list_transform(w, lambda x: x / list_sum(w)) AS p FROM e),
r AS (SELECT vec_id, x, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS k, lead(x) OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS following,
             coalesce(sum(x) OVER (PARTITION BY vec_id ORDER BY x DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM (SELECT vec_id, unnest(p) AS x, unnest(range(1, 17)) AS i FROM p)),
s AS (SELECT vec_id, count(*) FILTER (k <= 8 AND before <= 0.9) AS kept, max(ln(x) - ln(following)) FILTER (k = 1) AS gap, sum(-x * ln(x)) AS entropy,
             count(*) FILTER (ln(x) < -0.7) / 16 AS low, avg(x) AS mean_p FROM r GROUP BY vec_id),
o AS (SELECT a.vec_id, list_sum(list_transform(range(1, 17), lambda i: least(a.p[i], b.p[i]))) AS overlap,
             list_sum(list_transform(range(1, 17), lambda i: greatest(a.p[i] - b.p[i], 0))) AS over, list_max(list_transform(range(1, 17), lambda i: greatest(a.p[i] - b.p[i], 0))) AS top
      FROM p a JOIN p b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, kept, round(gap, 6) AS gap, round(entropy, 6) AS entropy, round(low, 6) AS low, round(mean_p, 6) AS mean_p, round(overlap, 6) AS overlap,
       round(top / over, 5) AS top_residual FROM s JOIN o USING (vec_id)
""")
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sixteen components of vectors as logits: kept tokens, gap of the two likeliest, entropy, and how a draft from one
    is met by the next vector's distribution."""
    logits = F.transform(F.slice("embedding", 1, 16), lambda x: x.cast("double") * 6)
    rows = table(spark, sf_dir, "embeddings").where(F.size("embedding") >= 16).select("vec_id", arrays.softmax(logits).alias("p"))
    pair = rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("q")), "vec_id")
    logs = F.transform("p", lambda x: F.ln(x))
    return pair.select(
        "vec_id",
        F.size(arrays.kept_by_top_p("p", 0.9, 8)).cast("long").alias("kept"),
        F.round(arrays.top_gap(logs), 6).alias("gap"),
        F.round(arrays.entropy("p"), 6).alias("entropy"),
        F.round(tx.low_confidence_share(logs), 6).alias("low"),
        F.round(tx.mean_probability(logs), 6).alias("mean_p"),
        F.round(arrays.overlap("p", "q"), 6).alias("overlap"),
        F.round(F.array_max(arrays.residual("p", "q")), 5).alias("top_residual"),
    )


@_query("""
SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS k, round(avg(value), 6) AS mean_wall FROM events GROUP BY event_type
""")
def jsonl_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome rows appended to JSON Lines in two goes, read back under a strict schema and summed up."""
    rows = table(spark, sf_dir, "events").select("event_type", F.col("event_id").alias("id"), (F.col("value") > 50).alias("correct"), F.col("value").alias("wall_s"))
    place = f"{scratch(spark, 'appended')}/rows"
    for half in (0, 1):
        sinks.append_jsonl(rows.where(F.col("id") % 2 == half), place)
    back = readers.read_jsonl(spark, place, "event_type STRING, id BIGINT, correct BOOLEAN, wall_s DOUBLE")
    return back.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("correct").alias("k"), F.round(F.avg("wall_s"), 6).alias("mean_wall"))


@_query(f"""
WITH e AS (SELECT event_id // {PER_FILE} AS part, event_id, user_id % 5 AS unit, CAST(round(value * 1000) AS BIGINT) AS mib FROM events),
f AS (SELECT part, arg_min(mib, event_id) FILTER (mib % 2 = 1) AS first_odd, CASE WHEN count(DISTINCT unit) = 1 THEN min(unit) END AS sole,
             sum(mib) AS total FROM e GROUP BY part),
l AS (SELECT part, unit, arg_max(mib, event_id) AS last FROM e GROUP BY part, unit)
SELECT part, unit, last, first_odd, sole, total FROM l JOIN f USING (part)
""")
def log_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of a log, read back: the last value of each unit, the first odd one, the one unit if there is just one, and the sum."""
    mib = F.round(F.col("value") * 1000).cast("bigint")
    line = F.concat(F.lit("unit "), (F.col("user_id") % 5).cast("string"), F.lit(" holds "), F.format_string("%,d", mib), F.lit(" MiB"), F.when(mib % 2 == 1, " odd").otherwise(""))
    rows = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / PER_FILE).alias("part"), "event_id", line.alias("value"))
    place = f"{scratch(spark, 'log')}/rows"
    rows.repartition("part").sortWithinPartitions("part", "event_id").select("part", "value").write.partitionBy("part").text(place)
    lines = readers.read_lines(spark, f"{place}/*")
    part = F.regexp_extract("file", r"part=(\d+)/", 1).cast("bigint").alias("part")
    plain = lambda c: F.regexp_replace(c, ",", "").cast("bigint")
    last = readers.last_per_key(lines, r"unit (\d+) holds ([0-9,]+) MiB", 1, 2).select(part, F.col("key").cast("bigint").alias("unit"), plain("value").alias("last"))
    first = readers.first_match(lines, r"holds ([0-9,]+) MiB odd").select(part, plain("value").alias("first_odd"))
    sole = readers.sole_value(lines, r"unit (\d+)").select(part, F.col("value").cast("bigint").alias("sole"))
    sums = readers.metrics_lines(lines, {"mib": r"holds ([0-9,]+) MiB"}).groupBy(part).agg(F.sum("mib").cast("bigint").alias("total"))
    return last.join(first, "part", "left").join(sole, "part").join(sums, "part")


@_query("""
SELECT event_id, printf('%.3f', value) AS fixed, CASE WHEN event_id % 7 = 3 THEN NULL ELSE printf('%g', value * power(10, event_id % 9 - 5)) END AS general FROM events
""")
def csv_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in fixed and in shortest six-digit form through a CSV file; a null is an empty field."""
    rows = table(spark, sf_dir, "events").select("event_id", "value", (F.col("value") * F.pow(F.lit(10.0), (F.col("event_id") % 9 - 5).cast("double"))).alias("x"))
    place = f"{scratch(spark, 'report')}/csv"
    general = sinks.general(F.when(F.col("event_id") % 7 == 3, None).otherwise(F.col("general")))
    rows = rows.select("event_id", F.col("value").alias("fixed"), F.col("x").alias("general"))
    sinks.write_csv(rows, place, {"general": general, "fixed": sinks.fixed(F.col("fixed"), 3)})
    return readers.read_csv(spark, place, "event_id BIGINT, fixed STRING, general STRING")


@_query("""
WITH d AS (SELECT doc_id // 1000 AS part, doc_id, concat(doc_id, ':', n_chars, chr(10)) AS line FROM documents)
SELECT part, sha256(string_agg(line, '' ORDER BY doc_id)) AS sha256, CAST(sum(strlen(line)) AS BIGINT) AS bytes, CASE WHEN part % 3 = 1 THEN 'changed' ELSE 'ok' END AS status
FROM d GROUP BY part
""")
def file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a thousand documents each, hashed whole and held against a manifest with some wrong entries."""
    rows = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 1000).alias("part"), "doc_id", F.concat("doc_id", F.lit(":"), "n_chars").alias("value"))
    place = f"{scratch(spark, 'hashed')}/rows"
    rows.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "value").write.partitionBy("part").text(place)
    files = readers.file_digests(spark, place).withColumn("part", F.regexp_extract("path", r"part=(\d+)/", 1).cast("bigint")).where(F.col("path").endswith(".txt"))
    told = files.select("path", F.when(F.col("part") % 3 == 1, F.reverse("sha256")).otherwise(F.col("sha256")).alias("sha256"))
    found = integrity.verify_manifest(files, told)
    return files.join(found, "path").select("part", "sha256", "bytes", "status")


@_query("""
SELECT doc_id, 4200000 + doc_id AS seed, (n_chars // 4) % 2 = 1 AS bit, abs(n_chars - length(coalesce(text, ''))) <= 1 AS near,
       regexp_full_match(CASE WHEN doc_id % 2 = 0 THEN sha256(coalesce(text, '')) ELSE source END, '[0-9a-f]{64}') AS hashed FROM documents
""")
def item_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds from ids, a bit of a hexadecimal field, lengths within a tolerance, forms of ids."""
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        arrays.derived_seed(F.concat(F.lit("item_"), F.col("doc_id").cast("string")), 4_200_000).alias("seed"),
        integrity.has_bit(F.concat(F.lit("0x"), F.hex("n_chars")), 4).alias("bit"),
        integrity.close(F.col("n_chars"), F.char_length(F.coalesce("text", F.lit(""))), 1).alias("near"),
        tx.has_form(F.when(F.col("doc_id") % 2 == 0, digest).otherwise(F.col("source")), "sha256").alias("hashed"),
    )


@_query("""
WITH a AS (SELECT user_id, event_id % 50 AS item, max(value) AS v, bool_or(event_id % 11 = 0) AS bad FROM events WHERE event_type = 'click' GROUP BY ALL),
b AS (SELECT user_id, event_id % 50 AS item, max(value) AS v, bool_or(event_id % 13 = 0) AS bad FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT user_id, item, round(a.v, 6) AS v_a, round(b.v, 6) AS v_b FROM a JOIN b USING (user_id, item) WHERE NOT a.bad AND NOT b.bad
""")
def paired_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of two event types paired by user; a pair goes if either side has an error."""
    events = table(spark, sf_dir, "events").withColumn("item", F.col("event_id") % 50)

    def side(kind: str, n: int) -> DataFrame:
        own = events.where(F.col("event_type") == kind)
        return own.groupBy("user_id", "item").agg(F.max("value").alias("v"), F.bool_or(F.col("event_id") % n == 0).alias("bad"))

    out = pairing.paired(side("click", 11), side("view", 13), ["user_id", "item"], drop_errors="bad")
    return out.select("user_id", "item", F.round("v_a", 6).alias("v_a"), F.round("v_b", 6).alias("v_b"))


@_query("SELECT sha256(text) AS digest, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY digest HAVING count(*) > 1")
def repeated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that occur more than once."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    return pairing.duplicates(docs, "digest")

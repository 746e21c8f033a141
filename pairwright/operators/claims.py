"""Recomputing and reconciling published figures: summaries against rows, pooled and paired records, survival, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.functions.statistics import fisher_p, mcnemar_p, rate
from pairwright.operators.aggregates import nearest_rank_counts, recovered_count
from pairwright.operators.folds import ordered_digests
from pairwright.operators.timeseries import range_join


#: Bands of a verdict table, which each task compares its rows with.
MOST_BANDS = 10_000


def _share(hits: Column, of: Column) -> Column:
    return F.try_divide(F.count_if(hits).cast("double"), F.count_if(of))


def reconcile(summaries: DataFrame, rows: DataFrame, by: list[str], correct: Column) -> DataFrame:
    """Stored summaries (``by``, n, accuracy) against the rows they came from.

    status: no_rows, partial (fewer rows than n), complete (all rows, same number right) or contradiction.
    """
    held = rows.groupBy(*by).agg(F.count("*").alias("rows_n"), F.count_if(correct).alias("rows_k"))
    told = summaries.withColumn("summary_k", recovered_count(F.col("accuracy"), F.col("n")))
    status = (
        F.when(F.col("rows_n").isNull(), "no_rows")
        .when((F.col("rows_n") < F.col("n")) & (F.col("rows_k") <= F.coalesce("summary_k", "n")), "partial")
        .when((F.col("rows_n") == F.col("n")) & (F.col("rows_k") == F.col("summary_k")), "complete")
        .otherwise("contradiction")
    )
    zero = F.lit(0).cast("long")
    return told.join(held, by, "left").select(
        *by, "n", "summary_k", F.coalesce("rows_n", zero).alias("rows_n"), F.coalesce("rows_k", zero).alias("rows_k"), status.alias("status")
    )


def comparison_records(specs: DataFrame, outcomes: DataFrame, config: str, item: str, correct: Column) -> DataFrame:
    """One record per row of ``specs`` (name, config_a, config_b): Fisher's test of the two whole sets, and the paired table
    where both hold the same items; ``unavailable`` says why there is none.

    Specs are data, so a new comparison is a new row.
    """
    marked = outcomes.select(F.col(config).alias("config"), F.col(item).alias("item"), correct.alias("ok"))
    sums = marked.groupBy("config").agg(F.count("*").alias("n"), F.count_if("ok").alias("k"))
    a, b = (sums.select(F.col("config").alias(f"config_{s}"), F.col("n").alias(f"n_{s}"), F.col("k").alias(f"k_{s}")) for s in "ab")
    whole = specs.join(a, "config_a", "left").join(b, "config_b", "left")
    left = specs.join(marked.select(F.col("config").alias("config_a"), "item", F.col("ok").alias("ok_a")), "config_a")
    right = specs.join(marked.select(F.col("config").alias("config_b"), "item", F.col("ok").alias("ok_b")), "config_b")
    met = left.join(right.select("name", "item", "ok_b"), ["name", "item"])
    pairs = met.groupBy("name").agg(
        F.count("*").alias("n_common"),
        F.count_if(F.col("ok_a") & ~F.col("ok_b")).alias("a_only"),
        F.count_if(~F.col("ok_a") & F.col("ok_b")).alias("b_only"),
    )
    joined = whole.join(pairs, "name", "left")
    missing = (
        F.when(F.col("n_a").isNull() | F.col("n_b").isNull(), "no rows")
        .when(F.coalesce("n_common", F.lit(0)) != F.greatest("n_a", "n_b"), "items differ")
    )
    fisher = fisher_p(F.col("k_a"), F.col("n_a") - F.col("k_a"), F.col("k_b"), F.col("n_b") - F.col("k_b"))
    out = joined.withColumn("unavailable", missing).withColumn("fisher_p", fisher)
    paired = F.col("unavailable").isNull()
    return out.select(
        "name", "config_a", "config_b", "n_a", "k_a", "n_b", "k_b", "fisher_p",
        *[F.when(paired, F.col(c)).alias(c) for c in ("a_only", "b_only")],
        F.when(paired, mcnemar_p("a_only", "b_only")).alias("mcnemar_p"),
        "unavailable",
    )


def pooled(tables: DataFrame, by: list[str]) -> DataFrame:
    """2x2 tables of several suites summed, then one exact test on the pooled discordant counts."""
    sums = tables.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n", "both", "a_only", "b_only", "neither")])
    return sums.withColumn("p", mcnemar_p("a_only", "b_only"))


def identity_rates(pairs: DataFrame, by: list[str], sha_a: str, sha_b: str, tokens_a: str, tokens_b: str) -> DataFrame:
    """Equal outputs and equal lengths, each by both denominators: pairs with both values, and all pairs."""
    shas = F.col(sha_a).isNotNull() & F.col(sha_b).isNotNull()
    same = F.coalesce(F.col(sha_a) == F.col(sha_b), F.lit(False))
    as_long = F.coalesce(F.col(tokens_a) == F.col(tokens_b), F.lit(False))
    return pairs.groupBy(*by).agg(
        F.count("*").alias("n_pairs"),
        F.count_if(shas).alias("n_hashed"),
        F.count_if(same).alias("identical"),
        _share(same, shas).alias("identity_hashed"),
        _share(same, F.lit(True)).alias("identity_all"),
        F.count_if(as_long & (F.col(tokens_a) > 0)).alias("same_tokens_positive"),
        F.count_if(as_long).alias("same_tokens"),
    )


def length_changes(pairs: DataFrame, by: list[str], a: str, b: str, share: float = 0.2) -> DataFrame:
    """How many pairs grew or shrank by more than ``share`` of the first length."""
    more, less = F.lit(1 + share), F.lit(1 - share)
    return pairs.groupBy(*by).agg(
        F.count("*").alias("n_pairs"),
        F.count_if(F.col(b) > more * F.col(a)).alias("longer"),
        F.count_if(F.col(b) < less * F.col(a)).alias("shorter"),
    )


def survival(items: DataFrame, by: list[str], survives: Column, correct: Column) -> DataFrame:
    """Right answers split by whether the gold answer is still in the shortened text."""
    gone = ~survives
    return items.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(survives).alias("n_survive"),
        F.count_if(survives & correct).alias("k_survive"),
        F.count_if(gone).alias("n_destroyed"),
        F.count_if(gone & correct).alias("k_destroyed"),
        _share(survives & correct, survives).alias("acc_survive"),
        _share(gone & correct, gone).alias("acc_destroyed"),
    )


def attempt_summary(attempts: DataFrame, by: list[str], accepted: Column, error: str) -> DataFrame:
    """Attempts of a generation ledger: accepted, rejected, distinct error kinds and the commonest of them."""
    whole = attempts.groupBy(*by).agg(
        F.count("*").alias("attempts"),
        F.count_if(accepted).alias("accepted"),
        F.count_if(~accepted).alias("rejected"),
        F.count_distinct(error).alias("error_kinds"),
    )
    kinds = attempts.where(F.col(error).isNotNull()).groupBy(*by, error).agg(F.count("*").alias("_n"))
    top = kinds.groupBy(*by).agg(F.min_by(error, F.struct(-F.col("_n"), F.col(error))).alias("top_error"))
    return whole.join(top, by, "left")


def divergence_summary(rows: DataFrame, by: list[str], place: str, gap: str, near: float) -> DataFrame:
    """Diverging rows: number, median place of divergence, share of near ties (gap under ``near``) among them."""
    apart = F.col(place).isNotNull()
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(apart).alias("diverged"),
        F.median(place).alias("median_place"),
        _share(apart & (F.col(gap) < near), apart).alias("near_tie_share"),
    )


def largest_gap(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """Largest absolute difference of one value between two measurement modes, and the key it occurs at."""
    met = a.select(*key, F.col(value).alias("_a")).join(b.select(*key, F.col(value).alias("_b")), key)
    gap = F.abs(F.col("_a") - F.col("_b"))
    return met.agg(F.count("*").alias("n"), F.max(gap).alias("largest_gap"), F.max_by(F.struct(*key), F.struct(gap, *key)).alias("_at")).select(
        "n", "largest_gap", "_at.*"
    )


def bits_per_weight(size_bytes: Column, parameters: Column) -> Column:
    return F.try_divide(8.0 * size_bytes, parameters)


def shard_rollup(shards: DataFrame, model: str, place: str, first: list[str], declared: str) -> DataFrame:
    """Shards (bytes, params, tensors) summed per model; columns in ``first`` come from the shard of the least place,
    and the number of shards is held against the declared one."""
    out = shards.groupBy(model).agg(
        F.count("*").alias("n_shards"),
        *[F.sum(c).alias(c) for c in ("bytes", "params", "tensors")],
        F.min_by(F.struct(*first, declared), place).alias("_first"),
    )
    return out.select(
        model, "n_shards", "bytes", "params", "tensors",
        bits_per_weight(F.col("bytes"), F.col("params")).alias("bits_per_weight"),
        *[F.col(f"_first.{c}").alias(c) for c in first],
        (F.col("n_shards") == F.col(f"_first.{declared}")).alias("all_shards"),
    )


def run_summary(rows: DataFrame, by: list[str], correct: Column, wall: Column, expected: int) -> DataFrame:
    """Per condition: rows, right answers, mean wall time, and whether all expected rows are there."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(correct).alias("k"),
        F.avg(wall).alias("mean_wall"),
        (F.count("*") == expected).alias("complete"),
    )


def turn_summary(turns: DataFrame, by: list[str], turn: str, first_token: str, tokens: str, wall: str) -> DataFrame:
    """First turns (cold) against later ones: mean time to the first token, and tokens per second over all."""
    cold = F.col(turn) == 0
    return turns.groupBy(*by).agg(
        F.count_if(cold).alias("cold_turns"),
        F.avg(F.when(cold, F.col(first_token))).alias("cold_first_token"),
        F.avg(F.when(~cold, F.col(first_token))).alias("later_first_token"),
        F.try_divide(F.sum(tokens), F.sum(wall)).alias("tokens_per_second"),
    )


def mean_above(value: Column, floor: float) -> Column:
    """Mean of the samples over a floor: a sampler's idle readings don't count."""
    return F.avg(F.when(value > floor, value))


def energy_rates(runs: DataFrame, tokens: str, energy: str, span: str, idle_power: str) -> DataFrame:
    """tokens per joule by the whole energy and by what exceeds the idle power over the span, and tokens per kilojoule."""
    net = F.col(energy) - F.col(idle_power) * F.col(span)
    return runs.withColumns(
        {
            "tokens_per_joule": F.try_divide(F.col(tokens).cast("double"), F.col(energy)),
            "net_tokens_per_joule": F.try_divide(F.col(tokens).cast("double"), F.when(net > 0, net)),
            "tokens_per_kilojoule": F.try_divide(1000.0 * F.col(tokens), F.col(energy)),
        }
    )


def idle_power(samples: DataFrame, runs: DataFrame, by: list[str], t: str, power: str, start: str, width: float) -> DataFrame:
    """Mean power in the ``width`` seconds before each run's start, per ``by`` and run (column ``start``). Runs are listed under the stretches
    of time that they look at, so a sample meets the runs near it, and counts for each whose stretch holds it."""
    looked = runs.select(*by, F.col(start), (F.col(start) - width).alias("_from"), F.col(start).alias("_to"))
    met = range_join(samples, looked, t, "_from", "_to", width, by).where(F.col(t) < F.col("_to"))
    return met.groupBy(*by, start).agg(F.count("*").alias("idle_samples"), F.avg(power).alias("idle_power"))


def scaling(rows: DataFrame, by: list[str], clients: str, rates: str, base: int = 1) -> DataFrame:
    """Throughput at each number of clients over that at ``base``, and the mean of each stream."""
    one = rows.where(F.col(clients) == base).select(*by, F.col(rates).alias("_base"))
    return rows.join(one, by, "left").select(
        *by, clients, rates,
        F.try_divide(rates, "_base").alias("scale"),
        F.try_divide(F.col(rates), F.col(clients)).alias("per_stream"),
    )


def frame_pins(rows: DataFrame, stratum: str, expected: dict[str, int]) -> DataFrame:
    """Rows of each stratum against the number it must have; strata on one side only are shown too."""
    have = rows.groupBy(stratum).agg(F.count("*").alias("n"))
    want = rows.sparkSession.createDataFrame(sorted(expected.items()), f"{stratum} string, expected bigint")
    full = have.join(want, stratum, "full_outer")
    return full.select(stratum, F.coalesce("n", F.lit(0).cast("long")).alias("n"), "expected", F.col("n").eqNullSafe(F.col("expected")).alias("ok"))


def order_kept(before: DataFrame, after: DataFrame, key: str, pos: str) -> DataFrame:
    """Keys of ``after`` (a later version of a frame) that come out of the order they had before: n_common, out_of_order."""
    met = before.select(key, F.col(pos).alias("_was")).join(after.select(key, F.col(pos).alias("_is")), key)
    # ranges of the new position keep a task from seeing all rows; only each range's first and last old place is compared across
    width = 1 << 16
    met = met.withColumn("_part", F.floor(F.col("_is") / width))
    w = Window.partitionBy("_part").orderBy("_is")
    inside = met.withColumn("_drop", F.col("_was") < F.lag("_was").over(w))
    sums = inside.groupBy("_part").agg(
        F.count("*").alias("_n"), F.count_if("_drop").alias("_bad"), F.min_by("_was", "_is").alias("_first"), F.max_by("_was", "_is").alias("_last")
    )
    edge = F.coalesce(F.col("_first") < F.lag("_last").over(Window.orderBy("_part")), F.lit(False))
    return sums.withColumn("_edge", edge.cast("long")).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_common"), F.coalesce(F.sum(F.col("_bad") + F.col("_edge")), F.lit(0)).alias("out_of_order")
    )


def inventory(rows: DataFrame, by: list[str], truncated: Column, errored: Column) -> DataFrame:
    """Truncated and errored items of every cell, with their shares."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(truncated).alias("truncated"),
        F.count_if(errored).alias("errored"),
        rate(F.count_if(truncated), F.count("*")).alias("truncated_share"),
    )


def file_predicates(lines: DataFrame, file: str, line: str, all_hold: str, some_holds: str) -> DataFrame:
    """Per file: lines, whether every one holds a text, whether any holds another."""
    return lines.groupBy(file).agg(
        F.count("*").alias("n_lines"),
        F.bool_and(F.contains(F.col(line), F.lit(all_hold))).alias("all_hold"),
        F.bool_or(F.contains(F.col(line), F.lit(some_holds))).alias("some_hold"),
    )


#: Kinds of an error record: an HTTP status, or an exception's name and message; never both.
ERROR_RECORD = "kind STRING, status INT, exception STRING, message STRING, attempts INT"


def error_contract(text: Column) -> Column:
    """Whether a JSON text is a sound error record: struct<ok, reason>. A null text (no error) is sound."""

    def fault(e: Column) -> Column:
        return (
            F.when(e.isNull() | e["kind"].isNull(), "not a record")
            .when(~e["kind"].isin("http", "exception"), "unknown kind")
            .when((e["kind"] == "http") & ~F.coalesce(e["status"].between(400, 599), F.lit(False)), "status out of range")
            .when((e["kind"] == "http") & e["exception"].isNotNull(), "both kinds")
            .when((e["kind"] == "exception") & (e["exception"].isNull() | e["status"].isNotNull()), "exception without a name")
            .when(~F.coalesce(e["attempts"] >= 1, F.lit(False)), "no attempts")
        )

    # an array of one, so that the text is parsed once and not for each use
    reason = F.when(text.isNotNull(), F.get(F.transform(F.array(F.from_json(text, ERROR_RECORD)), fault), F.lit(0)))
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"))


def provenance(rows: DataFrame, sample: DataFrame, key: str, pos: str, pattern: str) -> DataFrame:
    """A data set against the sample it claims to be, in one row: odd ids, repeats, missing, unexpected and misplaced ones."""
    want = sample.select(F.col(key).alias("_want"), F.col(pos).alias("_want_pos"))
    have = rows.groupBy(key).agg(F.count("*").alias("_n"), F.min(pos).alias("_pos"))
    full = have.join(want, F.col(key) == F.col("_want"), "full_outer")
    return full.agg(
        F.count_if(F.col(key).isNotNull() & ~F.col(key).cast("string").rlike(pattern)).alias("odd_ids"),
        F.count_if(F.col("_n") > 1).alias("repeated"),
        F.count_if(F.col(key).isNull()).alias("missing"),
        F.count_if(F.col("_want").isNull()).alias("unexpected"),
        F.count_if(F.col("_pos") != F.col("_want_pos")).alias("misplaced"),
    )


def banded(rows: DataFrame, value: str, bands: DataFrame) -> DataFrame:
    """The verdict of the band (low inclusive, high exclusive; null is open) that a value lies in, from a table of bands."""
    if bands.limit(MOST_BANDS + 1).count() > MOST_BANDS:
        raise ValueError(f"more than {MOST_BANDS} bands")
    b = F.broadcast(bands)
    inside = (F.col("low").isNull() | (F.col(value) >= F.col("low"))) & (F.col("high").isNull() | (F.col(value) < F.col("high")))
    return rows.join(b, inside, "left").drop("low", "high")


def ordered_values(rows: DataFrame, by: list[str], pivot: str, value: str, chain: list[str]) -> DataFrame:
    """Whether a value falls strictly along a chain of conditions, per group; null if one is missing."""
    wide = rows.groupBy(*by).pivot(pivot, chain).agg(F.first(value))
    falls = None
    for a, b in zip(chain, chain[1:]):
        step = F.col(f"`{a}`") > F.col(f"`{b}`")
        falls = step if falls is None else falls & step
    return wide.withColumn("falls", falls)


def traffic_summary(rows: DataFrame, by: list[str], value: str, cached: Column, cold: Column) -> DataFrame:
    """p50, p90 and largest value of a traffic log, and its shares of cached and cold requests."""
    ranks = nearest_rank_counts(rows, value, by, [0.5, 0.9]).drop("n")
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.max(value).alias("largest"), _share(cached, F.lit(True)).alias("cached_share"), _share(cold, F.lit(True)).alias("cold_share")
    )
    return sums.join(ranks, by)


def component_summary(rows: DataFrame, by: list[str], value: str, depth: str, bands: int, layers: int) -> DataFrame:
    """Median and largest value per component and depth band (0 is the first of ``bands`` equal parts)."""
    band = F.least(F.floor(F.col(depth) * bands / layers), F.lit(bands - 1)).cast("int")
    return rows.groupBy(*by, band.alias("band")).agg(F.count("*").alias("n"), F.median(value).alias("median"), F.max(value).alias("largest"))


def position_means(rows: DataFrame, by: list[str], values: str) -> DataFrame:
    """Mean of an array's values at each position over the rows of a group."""
    return rows.select(*by, F.posexplode(values).alias("place", "_v")).groupBy(*by, "place").agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"))


def length_prefixed(value: Column) -> Column:
    """UTF-8 bytes behind their number as eight big-endian bytes; what an ordered digest hashes of each field."""
    data = F.coalesce(value.cast("string"), F.lit("")).cast("binary")
    size = F.unhex(F.lpad(F.hex(F.octet_length(data).cast("long")), 16, "0"))
    return F.concat(size, data)


def ordered_digest(rows: DataFrame, by: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """sha-256 of a group's rows in order, every field length-prefixed, as a running hash over sorted rows."""
    framed = rows.withColumn("_frame", F.concat(*[length_prefixed(F.col(f)) for f in fields]))
    return ordered_digests(framed, by, order, "_frame")


def response_audit(intents: DataFrame, terminals: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    """Three-legged ledger: one intent, one terminal and one response each; ``finding`` names the first leg that fails."""
    legs = None
    for name, rows in (("intents", intents), ("terminals", terminals), ("responses", responses)):
        one = rows.groupBy(key).agg(F.count("*").alias(f"n_{name}"))
        legs = one if legs is None else legs.join(one, key, "full_outer")
    zero = F.lit(0).cast("long")
    legs = legs.select(key, *[F.coalesce(c, zero).alias(c) for c in ("n_intents", "n_terminals", "n_responses")])
    finding = (
        F.when(F.col("n_intents") != 1, "intent")
        .when(F.col("n_terminals") != 1, "terminal")
        .when(F.col("n_responses") != 1, "response")
        .otherwise("closed")
    )
    return legs.withColumn("finding", finding)


def session_audit(sessions: DataFrame, intents: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    """One row per session: how often it is registered, and its intents and responses. ``repeated``: registered more than once; ``unknown``:
    never, but referred to; ``unused``: without an intent, so nothing says that it was safe to use; else ``sound``."""
    legs = None
    for name, rows in (("registered", sessions), ("intents", intents), ("responses", responses)):
        one = rows.groupBy(key).agg(F.count("*").alias(name))
        legs = one if legs is None else legs.join(one, key, "full_outer")
    zero = F.lit(0).cast("long")
    legs = legs.select(key, *[F.coalesce(c, zero).alias(c) for c in ("registered", "intents", "responses")])
    finding = (
        F.when(F.col("registered") == 0, "unknown").when(F.col("registered") > 1, "repeated").when(F.col("intents") == 0, "unused").otherwise("sound")
    )
    return legs.withColumn("finding", finding)


def plot_points(rows: DataFrame, x: str, y: str, panel: str, lowest: float, highest: float, pad: float = 0.05) -> DataFrame:
    """Points of a figure with each panel's padded axis limits; points that are null or out of range are marked, not dropped."""
    sound = F.col(x).isNotNull() & F.coalesce(F.col(y).between(lowest, highest), F.lit(False))
    limits = rows.where(sound).groupBy(panel).agg(F.min(y).alias("_low"), F.max(y).alias("_high"))
    margin = F.lit(pad) * (F.col("_high") - F.col("_low"))
    limits = limits.select(panel, (F.col("_low") - margin).alias("axis_low"), (F.col("_high") + margin).alias("axis_high"))
    return rows.withColumn("valid", sound).join(limits, panel, "left")

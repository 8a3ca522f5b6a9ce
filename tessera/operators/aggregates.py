"""Aggregations: timings, forecasts, roll-ups, audits, coverage and order by urgency."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import micros, severity, severity_base


def picked_ranks(samples: DataFrame, by: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """by, n and, per name of ``ranks``, the value at that place (from 1, an expression over n) of each group in ascending order.

    Values are counted by group and slot first (slots follow the binary logarithm of the value, so that they keep its order); prefix sums over a
    group's slots tell which slots hold a wanted place, and only their values are ranked. No task sorts a whole group.
    """
    v = F.col(value)
    size = F.floor(F.log2(F.abs(v)) * 64).cast("long") + F.lit(80_000)
    slot = F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0).cast("long"))
    rows = samples.where(v.isNotNull()).select(*by, v.alias("__v"), slot.alias("__slot"))
    counts = rows.groupBy(*by, "__slot").agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*by)
    sums = counts.withColumns({"n": F.sum("__c").over(w), "__before": F.sum("__c").over(w.orderBy("__slot")) - F.col("__c")})
    inside = reduce(lambda x, y: x | y, [(r > F.col("__before")) & (r <= F.col("__before") + F.col("__c")) for r in ranks.values()])
    wanted = sums.where(inside).select(*by, "__slot", "n", "__before")
    rank = F.row_number().over(Window.partitionBy(*by, "__slot").orderBy("__v")) + F.col("__before")
    near = rows.join(wanted, [*by, "__slot"]).withColumn("__rank", rank)
    return near.groupBy(*by, "n").agg(*[F.max(F.when(F.col("__rank") == r, F.col("__v"))).alias(name) for name, r in ranks.items()])


def timing_stats(samples: DataFrame, by: list[str], value: str, per_hour_of: int | None = None) -> DataFrame:
    """n, mean, median (the mean of the two middle values) and nearest-rank 95th percentile per group; with ``per_hour_of``, also the
    hours that so many units take at the mean of milliseconds."""
    n = F.col("n")
    half = lambda x: F.floor(x / F.lit(2))
    picks = picked_ranks(samples, by, value, {"__lo": half(n + 1), "__hi": half(n) + 1, "p95": F.floor((n * 95 + 99) / F.lit(100))})
    means = samples.where(F.col(value).isNotNull()).groupBy(*by).agg(F.avg(value).alias("mean"))
    more = [] if per_hour_of is None else [(F.col("mean") * per_hour_of / F.lit(3.6e6)).alias("projected_hours")]
    return picks.join(means, by).select(*by, "n", "mean", ((F.col("__lo") + F.col("__hi")) / 2).alias("median"), "p95", *more)


def forecast(samples: DataFrame, by: list[str], value: str, remaining: int, most: float = 86400.0) -> DataFrame:
    """Range of the time for ``remaining`` units: lower and upper quartile picks and the upper median of usable samples.

    Fewer than three usable samples give nulls and a reason, not zero; nothing remaining takes no time, whatever the samples.
    """
    n = F.col("n")
    usable = samples.where((F.col(value) > 0) & (F.col(value) <= most) & ~F.isnan(value))
    g = picked_ranks(usable, by, value, {"__lo": F.floor((n - 1) / F.lit(4)) + 1, "__hi": F.ceil((n - 1) * 3 / F.lit(4)) + 1, "__mid": F.floor(n / F.lit(2)) + 1})
    everyone = samples.select(*by).distinct().join(g.withColumnRenamed("n", "samples"), by, "left").fillna(0, ["samples"])
    if remaining == 0:
        return everyone.select(*by, "samples", F.lit(0.0).alias("low"), F.lit(0.0).alias("high"), F.lit(None).cast("double").alias("median"), F.lit(None).cast("string").alias("reason"))
    enough = F.col("samples") >= 3
    return everyone.select(*by, "samples", F.when(enough, F.col("__lo") * remaining).alias("low"), F.when(enough, F.col("__hi") * remaining).alias("high"), F.when(enough, F.col("__mid")).alias("median"), F.when(~enough, "fewer_than_three").alias("reason"))


def envelope(parts: DataFrame, by: list[str], low: str, high: str) -> DataFrame:
    """Parts that run side by side: [largest low, sum of highs]; null as soon as one part is unknown."""
    known = F.count_if(F.col(low).isNull() | F.col(high).isNull()) == 0
    return parts.groupBy(*by).agg(F.when(known, F.max(low)).alias("low"), F.when(known, F.sum(high)).alias("high"))


def usable_samples(samples: DataFrame) -> DataFrame:
    """Samples (kind, units, elapsed_ms, workers, ...) that can tell a rate."""
    return samples.where("kind IS NOT NULL AND units > 0 AND elapsed_ms > 0 AND workers > 0")


def rates(samples: DataFrame) -> DataFrame:
    """Seconds per unit of every usable sample, by kind and, for processing, the number of workers that it ran with (null for other
    kinds, whose rate does not depend on it), with their count and mean."""
    key = F.when(F.col("kind") == "processing", F.col("workers"))
    per = (F.col("elapsed_ms") / 1000.0 / F.col("units")).alias("per_unit")
    return usable_samples(samples).select("kind", key.alias("workers"), per).groupBy("kind", "workers").agg(F.count("*").alias("samples"), F.avg("per_unit").alias("per_unit"), F.min("per_unit").alias("least"), F.max("per_unit").alias("most"))


def projected_volume(samples: DataFrame, by: list[str], labels: int, kind: str = "packaging", order: str = "unix_ms") -> DataFrame:
    """Volume of ``labels`` items by the last usable sample of ``kind`` that has labels: units / labels * target, rounded up."""
    ok = usable_samples(samples).where((F.col("kind") == kind) & (F.col("labels") > 0))
    last = ok.groupBy(*by).agg(F.max_by(F.struct("units", "labels"), order).alias("s"))
    return last.select(*by, F.ceil(F.col("s.units") / F.col("s.labels") * labels).cast("long").alias("projected"))


def last_committed(events: DataFrame, item: str, order: list[str], fields: list[str]) -> DataFrame:
    """The last event of each item, and how often it was committed: repeats do not raise the yield."""
    return events.groupBy(item).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("r"), F.count("*").alias("commits")).select(item, "r.*", "commits")


def throughput(events: DataFrame, session: str, ts: str, kind: str, finish: str, item: str) -> DataFrame:
    """Items per hour of sessions that finished; null otherwise."""
    g = events.groupBy(session).agg(F.count_if(F.col(kind) == finish).alias("__done"), F.countDistinct(item).alias("items"), ((micros(F.max(ts)) - micros(F.min(ts))) / F.lit(3.6e9)).alias("__h"))
    return g.select(session, "items", F.when((F.col("__done") > 0) & (F.col("__h") > 0), F.col("items") / F.col("__h")).alias("per_hour"))


def merged_counters(key: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per key in each table; keys of any table, 0 where a table has none. One union, one shuffle."""
    tagged = [df.select(F.col(key).alias("key")).withColumn("__t", F.lit(name)) for name, df in tables.items()]
    both = reduce(DataFrame.unionByName, tagged)
    return both.groupBy("key").agg(*[F.count_if(F.col("__t") == name).alias(name) for name in tables])


def action_ledger(items: DataFrame, events: DataFrame, item: str, kind: str, kinds: list[str], transfer: str) -> DataFrame:
    """Every item with its counts by kind of action, their total, the nominal target (4 with a transfer, else 2) and whether anything
    was observed; an item without events has zero actions and is not observed."""
    g = events.groupBy(item).pivot(kind, kinds).count().withColumn("__seen", F.lit(True))
    out = items.select(item, transfer).join(g, item, "left").fillna(0, kinds)
    total = sum((F.col(k) for k in kinds), F.lit(0))
    return out.select(item, *kinds, total.cast("long").alias("total"), F.when(F.coalesce(F.col(transfer), F.lit(False)), 4).otherwise(2).alias("target"), F.coalesce("__seen", F.lit(False)).alias("observed"))


def observation_consensus(observations: DataFrame, keys: list[str], ok: str, sha: str, claimed: Column) -> DataFrame:
    """validated (the claimed hash was read and no other), conflicting (a valid hash differs from the claim or from another one),
    unconfirmed (nothing valid was read); null where nothing is claimed."""
    g = observations.groupBy(*keys).agg(F.collect_set(F.when(F.col(ok), F.col(sha))).alias("__s"), F.max(claimed).alias("__c"))
    n, agrees = F.size("__s"), F.array_contains("__s", F.col("__c"))
    state = F.when(F.col("__c").isNull(), None).when((n > 1) | ((n > 0) & ~agrees), "conflicting").when(n > 0, "validated").otherwise("unconfirmed")
    return g.select(*keys, n.alias("hashes"), state.alias("state"))


def track_summary(observations: DataFrame, track: list[str], id_: str, revolution: str, id_ok: str, data_ok: str, violations: str, payload: str) -> DataFrame:
    """Per track: ids present and valid, observations with a bad check sum or without data, ids repeated within a revolution, ids whose
    valid payloads differ, and ids that are valid in one observation and not in another. ``data_ok`` null: no data was found."""
    clean = F.coalesce(F.col(data_ok), F.lit(False)) & (F.col(violations) == 0)
    valid = F.col(id_ok) & clean
    o = observations.select(*track, F.col(id_).alias("__id"), F.col(revolution).alias("__rev"), F.col(id_ok).alias("__id_ok"), F.col(data_ok).alias("__data"), valid.alias("__valid"), F.when(F.col(id_ok) & F.col(data_ok).isNotNull(), clean).alias("__state"), F.when(valid, F.col(payload)).alias("__p"))
    within = o.groupBy(*track, "__id", "__rev").agg(
        F.count("*").alias("n"), F.count_if(~F.col("__id_ok") | (F.col("__data") == F.lit(False))).alias("bad"), F.count_if(F.col("__data").isNull()).alias("none"), F.max("__valid").alias("valid"),
        F.min("__p").alias("lo"), F.max("__p").alias("hi"), F.min("__state").alias("worst"), F.max("__state").alias("best"),
    )
    ids = within.groupBy(*track, "__id").agg(F.max("n").alias("most"), F.sum("bad").alias("bad"), F.sum("none").alias("none"), F.max("valid").alias("valid"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("worst").alias("worst"), F.max("best").alias("best"))
    return ids.groupBy(*track).agg(
        F.count("*").alias("present_ids"), F.count_if("valid").alias("valid_ids"), F.sum("bad").alias("bad_observations"), F.sum("none").alias("missing_data"),
        F.count_if(F.col("most") > 1).alias("repeated_ids"), F.count_if(F.col("lo") != F.col("hi")).alias("differing_ids"), F.count_if(F.col("worst") != F.col("best")).alias("varying_ids"),
    )


def claim_check(claims: DataFrame, observations: DataFrame, item: str, pos: str, attempt: str, sha: str) -> DataFrame:
    """Every claimed position with its state and the attempts that support it.

    ``claims``: item, pos, sha, unresolved, attempts (array). ``observations``: valid reads (item, pos, attempt, sha). A valid read of
    another hash is conflicting; else attempts that are claimed and hold the hash validate it; without one it is unconfirmed.
    """
    read = observations.select(item, pos, F.col(attempt).alias("__a"), F.col(sha).alias("__s"))
    met = claims.join(read, [item, pos], "left").groupBy(item, pos).agg(
        F.first("unresolved").alias("__u"), F.max(F.coalesce(F.col("__s") != F.col(sha), F.lit(False))).alias("__other"),
        F.array_sort(F.collect_set(F.when((F.col("__s") == F.col(sha)) & F.array_contains("attempts", F.col("__a")), F.col("__a")))).alias("supporting"),
    )
    state = F.when(F.col("__u"), "unresolved").when(F.col("__other"), "conflicting").when(F.size("supporting") == 0, "unconfirmed").otherwise("validated")
    return met.select(item, pos, state.alias("state"), F.when(state == "validated", F.col("supporting")).alias("supporting"))


def claim_totals(checked: DataFrame, sizes: DataFrame, item: str, size: str) -> DataFrame:
    """Per item the number of positions in each state, and complete: they add up to the item's size."""
    names = ("validated", "unconfirmed", "conflicting", "unresolved")
    g = checked.groupBy(item).agg(*[F.count_if(F.col("state") == n).alias(n) for n in names])
    total = sum((F.col(n) for n in names), F.lit(0))
    return sizes.select(item, size).join(g, item, "left").fillna(0, list(names)).select(item, *names, size, (total == F.col(size)).alias("complete"))


def final_summary(items: DataFrame, files: DataFrame, deliveries: DataFrame, conversions: DataFrame, checks: DataFrame) -> DataFrame:
    """One row of totals over five tables: items (image, audit_status, imaging_status, raw_exception), files (eligible), deliveries
    (integrity), conversions (status, modern_ok, pdf_ok), checks (recorded_success, integrity). The success share of nothing is 0."""
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    no = lambda c, v: F.count_if(~F.col(c).eqNullSafe(F.lit(v)))
    parts = [
        items.agg(F.count("*").alias("items_audited"), F.count_if(F.col("image")).alias("images_present"), is_("audit_status", "OK").alias("items_ok"), no("audit_status", "OK").alias("items_attention"), is_("imaging_status", "OK").alias("imaging_ok"), no("imaging_status", "OK").alias("imaging_not_ok"), F.count_if(F.col("raw_exception")).alias("raw_exceptions")),
        files.agg(F.count("*").alias("source_files"), F.count_if(~F.col("eligible")).alias("excluded_files")),
        deliveries.agg(F.count("*").alias("delivery_files"), is_("integrity", "UNTRACKED").alias("untracked_files")),
        conversions.agg(F.count("*").alias("conversions"), is_("status", "OK").alias("conversions_ok"), is_("status", "PARTIAL").alias("conversions_partial"), is_("status", "FAILED").alias("conversions_failed"), F.count_if(F.col("modern_ok")).alias("modern_good"), F.count_if(F.col("pdf_ok")).alias("pdf_good")),
        checks.agg(F.count("*").alias("integrity_checks"), F.count_if(F.col("recorded_success") & ~F.col("integrity").eqNullSafe(F.lit("VALID"))).alias("invalid_outputs")),
    ]
    one = reduce(lambda a, b: a.join(b, "__one"), [p.withColumn("__one", F.lit(1)) for p in parts]).drop("__one")
    return one.withColumn("conversion_percent", F.when(F.col("conversions") == 0, 0.0).otherwise(F.col("conversions_ok") * 100.0 / F.col("conversions")))


def outcomes(jobs: DataFrame, status: str, retried: str) -> DataFrame:
    """Jobs and retried outputs by status."""
    return jobs.groupBy(status).agg(F.count("*").alias("jobs"), F.sum(F.col(retried).cast("long")).alias("retried"))


def job_issues(jobs: DataFrame, status: str, detail: str, by: list[str]) -> DataFrame:
    """Rows that are not OK with their detail, ordered: the list that a report shows."""
    return jobs.where(~F.col(status).eqNullSafe(F.lit("OK"))).select(*by, status, detail).orderBy(*by)


def report(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` in the fixed order of a report: all columns break ties, so that equal inputs give equal reports."""
    return rows.orderBy(*order, *[c for c, t in rows.dtypes if not t.startswith("map")])


def coverage(rows: DataFrame, keys: list[str], reachable: Column) -> DataFrame:
    """Copies per key, all and reachable ones."""
    return rows.groupBy(*keys).agg(F.count("*").alias("copies"), F.count_if(reachable).alias("reachable"))


def bag_verdict(larger: DataFrame, smaller: DataFrame, item: str, keys: list[str], count: str = "n") -> DataFrame:
    """Per item of ``smaller``, whether ``larger`` holds its whole bag, and how many keys it lacks."""
    return covers(larger, smaller, [item, *keys], count).groupBy(item).agg(F.count_if(~F.col("covered")).alias("lacking"), F.min("covered").alias("superset"))


def covers(larger: DataFrame, smaller: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """Keys of ``smaller`` and whether ``larger`` has at least as many copies (bag superset by key)."""
    return smaller.join(larger.select(*keys, F.col(count).alias("__have")), keys, "left").select(*keys, F.coalesce(F.col("__have") >= F.col(count), F.lit(False)).alias("covered"))


def urgency(items: DataFrame, missing: str, total: str, first_missing: str, age: str, ready: str, item: str) -> DataFrame:
    """Score of each item and its place: ready first, then score, age and item. The place is a global sort of one row per item."""
    score = severity_base(F.col(missing), F.col(total)) + F.when(F.col(first_missing), 50).otherwise(0) + 10 * F.least(F.coalesce(F.col(age), F.lit(0)), F.lit(64))
    return items.withColumn("severity", severity(F.col(missing), F.col(total))).withColumn("score", score.cast("long")).orderBy(F.desc(ready), F.desc("score"), F.desc(F.coalesce(F.col(age), F.lit(0))), item)


def bounded(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group with a flag that more exist."""
    w = Window.partitionBy(*by)
    return rows.withColumn("__rk", F.row_number().over(w.orderBy(*order))).where(F.col("__rk") <= n + 1).withColumn("more", F.count("*").over(w) > n).where(F.col("__rk") <= n).drop("__rk")


def map_validity(positions: DataFrame, item: str, pos: str, total: int) -> DataFrame:
    """Whether a position map has no repeats and stays in range."""
    return positions.groupBy(item).agg(F.count("*").alias("n"), F.countDistinct(pos).alias("distinct_n"), F.max(pos).alias("highest")).select(item, "n", ((F.col("n") == F.col("distinct_n")) & (F.col("highest") < total)).alias("valid"))


def single_candidate(candidates: DataFrame, item: str, name: str, good: str, bad: str, least: int = 32) -> DataFrame:
    """The only candidate with at least ``least`` good units; else the only one with 80 % good while the others have no error and
    at most 5 %; else null with a reason. An ambiguous case is never guessed."""
    all_units = F.col(good) + F.col(bad)
    c = candidates.withColumn("__strong", F.col(good) >= least).withColumn("__share", (F.col(good) * 100 >= all_units * 80) & (all_units > 0)).withColumn("__weak", (F.col(bad) == 0) & (F.col(good) * 100 <= all_units * 5))
    g = c.groupBy(item).agg(F.count_if("__strong").alias("s"), F.max(F.when(F.col("__strong"), F.col(name))).alias("sn"), F.count_if("__share").alias("h"), F.max(F.when(F.col("__share"), F.col(name))).alias("hn"), F.count_if(~F.col("__share") & ~F.col("__weak")).alias("o"))
    chosen = F.when(F.col("s") == 1, F.col("sn")).when((F.col("s") == 0) & (F.col("h") == 1) & (F.col("o") == 0), F.col("hn"))
    return g.select(item, chosen.alias("chosen"), F.when(chosen.isNotNull(), F.lit(None)).when(F.col("s") > 1, "ambiguous").otherwise("insufficient").alias("reason"))


def affected_files(damage: DataFrame, item: str, path: str, role: str, pos: str) -> DataFrame:
    """Files with damaged positions (rows of a range join; role is payload or metadata): counts by role, incomplete flag, class."""
    one = damage.groupBy(item, path).agg(*[F.countDistinct(F.when(F.col(role) == r, F.col(pos))).alias(r) for r in ("payload", "metadata")])
    kind = F.when((F.col("payload") > 0) & (F.col("metadata") > 0), "both").when(F.col("payload") > 0, "payload").otherwise("metadata")
    return one.withColumn("incomplete", F.col("payload") > 0).withColumn("class", kind)


def item_summaries(attempts: DataFrame, item: str, attempt: str, attention: str, bad: str, total: str, preferred: str | None = None) -> DataFrame:
    """Per item: attempts, figures of the latest one and of the best one. The best is the preferred one, else needs no attention, has the least damage, is the newest.

    One aggregation: both are the row of an extreme order, nothing is sorted.
    """
    first = F.coalesce(F.col(preferred), F.lit(False)) if preferred else F.lit(False)
    needs = F.coalesce(F.col(attention), F.lit(True))
    best = F.max_by(F.struct(F.col(attempt).alias("n"), F.col(bad).alias("b"), needs.alias("a"), F.col(total).alias("t")), F.struct(first, ~needs, -F.col(bad), F.col(attempt)))
    latest = F.max_by(F.struct(F.col(attempt).alias("n"), F.col(bad).alias("b")), F.col(attempt))
    g = attempts.groupBy(item).agg(F.count("*").alias("attempts"), latest.alias("l"), best.alias("x"))
    return g.select(item, "attempts", F.col("l.n").alias("latest_attempt"), F.col("l.b").alias("latest_bad"), F.col("x.n").alias("best_attempt"), F.col("x.b").alias("best_bad"), F.col("x.a").alias("attention"), F.col("x.t").alias("total"))


def project_rollup(summaries: DataFrame) -> DataFrame:
    """One row of ``item_summaries``: items, attempts, items whose best attempt is fine (ok) or needs attention (partial), damage of the latest and of the best."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return summaries.agg(F.count("*").alias("items"), total("attempts").alias("attempts"), F.count_if(~F.col("attention")).alias("ok"), F.count_if("attention").alias("partial"), total("latest_bad").alias("latest_bad"), total("best_bad").alias("best_bad"))


def counts_by(rows: DataFrame, label: Column, name: str, missing: str = "unknown") -> DataFrame:
    """Rows by label; a null label is ``missing``."""
    return rows.groupBy(F.coalesce(label, F.lit(missing)).alias(name)).agg(F.count("*").alias("n"))


def impact(items: DataFrame, inspected: DataFrame, key: str, by: list[str], affected: str) -> DataFrame:
    """By group: items inspected, items refused (without a result, which is not zero), and the sum of what is affected."""
    j = items.select(key, *by).join(inspected.select(key, F.col(affected), F.lit(1).alias("__hit")), key, "left")
    return j.groupBy(*by).agg(F.count("__hit").alias("inspected"), F.count_if(F.col("__hit").isNull()).alias("refused"), F.sum(affected).alias("affected"))


def counterfactual(rows: DataFrame, by: list[str], passes: Column, gate: Column) -> DataFrame:
    """By group: rows that pass with the gate (ok), and those that would without it."""
    return rows.groupBy(*by).agg(F.count_if(passes & gate).alias("ok"), F.count_if(passes).alias("without_gate"))


def verified_by_both(items: DataFrame, reports: DataFrame, key: str, own: Column, reported: Column) -> DataFrame:
    """Items with verified: their own check and that of their report say so; a missing report says no."""
    told = reports.select(key, F.coalesce(reported, F.lit(False)).alias("__told"))
    return items.withColumn("__own", F.coalesce(own, F.lit(False))).join(told, key, "left").select(key, (F.col("__own") & F.coalesce("__told", F.lit(False))).alias("verified"))

"""Window-shaped operators: choosing attempts, ranges of positions, merges of copies, intervals and event order.

Every operator takes DataFrames and column names and returns a DataFrame. Windows are partitioned by the item, never global. An item may be
of any size where positions are merged or ranged: they are dealt in cells of ``width`` positions, each solved in its own task, and an item
alone only meets a few rows of each of its cells.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import micros
from ..sources.scratch import tasks_for


#: positions of a cell
WIDTH = 1 << 16


def cell_of(pos: str, width: int) -> Column:
    return F.floor(F.col(pos) / F.lit(width)).alias("__cell")


def met(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``a`` joined with ``b`` on ``keys``, where null meets null."""
    renamed = b.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(keys)})
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    return a.join(renamed, on, how).drop(*[f"__k{i}" for i in range(len(keys))])


def running(rows: DataFrame, item: list[str], order: str, sums: dict[str, Column], width: int = WIDTH) -> DataFrame:
    """``rows`` with sums over the rows of the item before each, in the order of a number: sums inside its cell and of the cells before it."""
    dealt = rows.withColumn("__cell", cell_of(order, width))
    totals = dealt.groupBy(*item, "__cell").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    cells = totals.select(*item, "__cell", *[F.coalesce(F.sum(n).over(before(*item).orderBy("__cell")), F.lit(0)).alias(f"__b_{n}") for n in sums])
    inside = dealt.withColumns({f"__i_{n}": F.coalesce(F.sum(c).over(before(*item, "__cell").orderBy(order)), F.lit(0)) for n, c in sums.items()})
    out = met(inside, cells, [*item, "__cell"])
    return out.withColumns({n: F.col(f"__b_{n}") + F.col(f"__i_{n}") for n in sums}).drop("__cell", *[f"__{x}_{n}" for n in sums for x in "bi"])


def best_attempt(attempts: DataFrame, item: str, order: list[Column]) -> DataFrame:
    """The first row of each item in ``order``."""
    return attempts.withColumn("__rn", F.row_number().over(Window.partitionBy(item).orderBy(*order))).where("__rn = 1").drop("__rn")


def latest_attempt(attempts: DataFrame, item: str, attempt: str) -> DataFrame:
    rest = [c for c in attempts.columns if c != item]
    row = F.max_by(F.struct(*rest), attempt).alias("r")
    return attempts.groupBy(item).agg(row, F.count("*").alias("attempts")).select(item, "r.*", "attempts")


def islands(positions: DataFrame, item: list[str], pos: str, width: int = WIDTH) -> DataFrame:
    """Runs of consecutive positions: first, last, length. Repeated positions count once.

    Runs are found in every cell, by one sort: its first and last rows are those without a neighbour. Runs that touch a border of their cell, two a
    cell at most, are stitched item by item. Positions are counted first, so that what is costly to make should be written before.
    """
    cells = _by_position(positions, item, pos, width)
    w = Window.partitionBy(*item, "__cell").orderBy(pos)
    lone = lambda apart: F.coalesce(apart, F.lit(True))
    ends = cells.withColumns({"__opens": lone(F.col(pos) - 1 > F.lag(pos).over(w)), "__ends": lone(F.lead(pos).over(w) - 1 > F.col(pos))}).where("__opens OR __ends")
    runs = ends.withColumn("last", F.when(F.col("__ends"), F.col(pos)).otherwise(F.lead(pos).over(w))).where("__opens")
    runs = runs.select(*item, "__cell", F.col(pos).alias("first"), "last", (F.col("last") - F.col(pos) + 1).cast("long").alias("length"))
    touches = (F.col("first") == F.col("__cell") * width) | (F.col("last") == (F.col("__cell") + 1) * width - 1)
    w = Window.partitionBy(*item).orderBy("first")
    new = F.coalesce(F.lag("last").over(w) != F.col("first") - 1, F.lit(True)).cast("int")
    border = runs.where(touches).withColumn("__new", new).withColumn("__run", F.sum("__new").over(w))
    stitched = border.groupBy(*item, "__run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("length").alias("length")).drop("__run")
    return runs.where(~touches).drop("__cell").unionByName(stitched)


def _by_position(positions: DataFrame, item: list[str], pos: str, width: int) -> DataFrame:
    """Item, position and cell of ``positions`` but nulls, a cell in one task; repeats stay."""
    return positions.where(F.col(pos).isNotNull()).select(*item, pos, cell_of(pos, width)).repartition(tasks_for(positions), *item, "__cell")


def gaps(positions: DataFrame, item: list[str], pos: str, width: int = WIDTH) -> DataFrame:
    """Runs of positions that are missing between the first and the last one of each item, inside cells and between them.

    Positions are counted first, so that what is costly to make should be written before."""
    cells = _by_position(positions, item, pos, width)
    inside = cells.withColumn("__next", F.lead(pos).over(Window.partitionBy(*item, "__cell").orderBy(pos))).select(*item, pos, "__next")
    ends = cells.groupBy(*item, "__cell").agg(F.min(pos).alias("__from"), F.max(pos).alias(pos))
    between = ends.withColumn("__next", F.lead("__from").over(Window.partitionBy(*item).orderBy("__cell"))).select(*item, pos, "__next")
    missing = inside.unionByName(between).where(F.col("__next") - 1 > F.col(pos))
    return missing.select(*item, (F.col(pos) + 1).alias("first"), (F.col("__next") - 1).alias("last"), (F.col("__next") - F.col(pos) - 1).alias("length"))


def coalesce_extents(extents: DataFrame, item: list[str], seq: str, pos: str, width: int = WIDTH) -> DataFrame:
    """Extents that follow each other both in the file and in the source become one. Extents that repeat count once.

    Such a run has one distance of pos and seq, so that it is an island of seq within that distance.
    """
    runs = islands(extents.withColumn("__d", F.col(pos) - F.col(seq)), [*item, "__d"], seq, width)
    return runs.select(*item, F.col("first").alias("first_seq"), (F.col("first") + F.col("__d")).alias("first_pos"), "length")


def surviving_fragments(units: DataFrame, item: str, seq: str, size: str, ok: str, declared: str, width: int = WIDTH) -> DataFrame:
    """Runs of readable units, with their offset and length clipped to the declared size."""
    u = running(units, [item], seq, {"__off": F.col(size), "__run": F.when(F.col(ok), 0).otherwise(1)}, width).where(ok)
    u = u.withColumn("__len", F.greatest(F.lit(0), F.least(F.col(size), F.col(declared) - F.col("__off")))).where("__len > 0")
    return u.groupBy(item, "__run").agg(F.min("__off").alias("offset"), F.sum("__len").alias("bytes"), F.count("*").alias("units")).drop("__run")


def attempt_changes(units: DataFrame, item: str, attempt: str, pos: str, totals: DataFrame | None = None) -> DataFrame:
    """Damaged positions of the last two attempts of each item: recovered, newly_bad, still_bad.

    ``totals``: item, attempt, total. Two attempts of different sizes cannot be compared: all three are null.
    """
    last = units.select(item, attempt).distinct().withColumn("__rk", F.row_number().over(Window.partitionBy(item).orderBy(F.desc(attempt)))).where("__rk <= 2")
    marks = units.join(last, [item, attempt]).groupBy(item, pos).agg(F.max(F.col("__rk") == 1).alias("now"), F.max(F.col("__rk") == 2).alias("before"))
    both = last.groupBy(item).agg(F.count("*").alias("__n")).where("__n = 2").drop("__n")
    out = marks.join(both, item, "left_semi").groupBy(item).agg(F.count_if(~F.col("now")).alias("recovered"), F.count_if(~F.col("before")).alias("newly_bad"), F.count_if(F.col("now") & F.col("before")).alias("still_bad"))
    if totals is None:
        return out
    sizes = totals.join(last, [item, attempt]).groupBy(item).agg((F.min("total") == F.max("total")).alias("__same"))
    return out.join(sizes, item, "left").select(item, *[F.when(F.col("__same"), F.col(c)).alias(c) for c in ("recovered", "newly_bad", "still_bad")])


def complete_units(units: DataFrame, item: str, attempt: str, pos: str, good: str, payload: str) -> DataFrame:
    """Units of attempts that all cover every position of their item; a position that an attempt does not have is not good."""
    attempts, positions = units.select(item, attempt).distinct(), units.select(item, pos).distinct()
    full = attempts.join(positions, item).join(units, [item, attempt, pos], "left")
    return full.select(item, attempt, pos, F.coalesce(F.col(good), F.lit(False)).alias(good), F.col(payload))


def _copies(units: DataFrame, item: str, pos: str, good: str, payload: str, width: int, *more: Column) -> DataFrame:
    """Per position (item, __cell, pos): copies that are good, and __clash, whether two of them differ (a null and a value do)."""
    value = F.when(F.col(good), F.col(payload))
    cells = units.groupBy(item, cell_of(pos, width), pos).agg(F.count_if(F.col(good)).alias("copies"), F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.count(value).alias("__set"), *more)
    clash = F.coalesce(F.col("__lo") != F.col("__hi"), F.lit(False)) | ((F.col("__set") > 0) & (F.col("__set") < F.col("copies")))
    return cells.withColumn("__clash", clash).drop("__lo", "__hi", "__set")


def _by_cell(units: DataFrame, items: DataFrame, item: str, pos: str, width: int) -> DataFrame:
    """Columns of ``items``, one row a cell of the item, so that no task gets all of its positions."""
    return met(units.select(item, cell_of(pos, width)).distinct(), items, [item])


def composite(units: DataFrame, item: str, attempt: str, pos: str, good: str, payload: str, width: int = WIDTH, complete: bool = False) -> tuple[DataFrame, DataFrame]:
    """(merged positions, refused items with reason and conflicts).

    The base is the attempt with the least damage, of equals the newest. A position that is bad there is filled from the first
    attempt in that order where it is good. Attempts that cover different numbers of positions refuse the item (mixed_totals), and so do
    two good copies that differ (conflict): nothing is padded and nothing is voted on.
    Returned positions have source (null: unresolved) and filled (whether it is not from the base; false where unresolved).

    Units meet by position; the order of an item's attempts is a short list, which its cells are given. ``complete`` gives what ``complete_units``
    would, without its rows: a position that an attempt does not have is not good, so that the least damage is the most good positions.
    """
    size, bad = (F.lit(0), -F.count_if(F.col(good))) if complete else (F.count("*"), F.count_if(~F.col(good)))
    sizes = units.groupBy(item, attempt).agg(bad.alias("__bad"), size.alias("__size"))
    ranked = sizes.withColumn("__rank", F.row_number().over(Window.partitionBy(item).orderBy("__bad", F.desc(attempt))))
    order = F.transform(F.array_sort(F.collect_list(F.struct("__rank", F.col(attempt).alias("a")))), lambda x: x["a"])
    items = ranked.groupBy(item).agg(order.alias("__order"), (F.min("__size") != F.max("__size")).alias("__mixed"))
    cells = _copies(units, item, pos, good, payload, width, F.collect_set(F.when(F.col(good), F.col(attempt))).alias("__from"))
    conflicts = cells.where("__clash").groupBy(item).agg(F.count("*").alias("conflicts"))
    if complete:
        refused = conflicts.select(item, F.lit("conflict").alias("reason"), "conflicts")
        fine = met(items, conflicts, [item], "left").where("conflicts IS NULL").select(item, "__order")
    else:
        judged = met(items, conflicts, [item], "left").withColumn("conflicts", F.coalesce("conflicts", F.lit(0).cast("long")))
        bad = F.col("__mixed") | (F.col("conflicts") > 0)
        refused = judged.where(bad).select(item, F.when(F.col("__mixed"), "mixed_totals").otherwise("conflict").alias("reason"), "conflicts")
        fine = judged.where(~bad).select(item, "__order")
    merged = met(cells, _by_cell(units, fine, item, pos, width), [item, "__cell"])
    source = F.try_element_at(F.filter("__order", lambda a: F.array_contains("__from", a)), F.lit(1))
    return merged.select(item, pos, source.alias("source"), F.coalesce(source != F.element_at("__order", 1), F.lit(False)).alias("filled")), refused


def _states(cells: DataFrame) -> Column:
    return F.when(F.col("copies") == 0, "unreadable").when(F.col("__clash"), "conflict").when(F.col("copies") > 1, "corroborated").otherwise("single")


def consensus(units: DataFrame, item: str, pos: str, source: str, good: str, payload: str) -> DataFrame:
    """Per position: corroborated, single, conflict or unreadable, with the sources that read it. A null payload is a value of its own."""
    cells = _copies(units, item, pos, good, payload, WIDTH, F.array_sort(F.collect_set(F.when(F.col(good), F.col(source)))).alias("sources"))
    return cells.select(item, pos, "copies", _states(cells).alias("state"), "sources")


def consensus_of_one_item(units: DataFrame, item: str, pos: str, source: str, good: str, payload: str, width: int, controls: int = 2, least: int = 16, cell: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(``consensus`` rows of accepted items, refused items with reason).

    The first ``controls`` blocks of ``width`` positions that the item's first source reads in full are its controls. Every other source has to
    hold at least ``least`` control positions with the same payload (else: identity), and no control position may be in conflict.

    Units meet once, by position, with the short list of their good copies; all else are counts by block, and the controls alone are opened.
    """
    read = F.collect_list(F.when(F.col(good), F.struct(F.col(source).alias("s"), F.col(payload).alias("p")))).alias("__read")
    cells = _copies(units, item, pos, good, payload, cell, read)
    items = units.groupBy(item).agg(F.min(source).alias("__first"), F.collect_set(source).alias("__all"))
    dealt = met(cells, _by_cell(units, items.select(item, "__first"), item, pos, cell), [item, "__cell"])
    based = dealt.withColumns({"__base": F.filter("__read", lambda r: r["s"] == F.col("__first")), "__block": F.floor(F.col(pos) / F.lit(width))})
    full = based.groupBy(item, "__block").agg(F.count_if(F.size("__base") > 0).alias("__n")).where(F.col("__n") == width)
    chosen = full.withColumn("__nth", F.row_number().over(Window.partitionBy(item).orderBy("__block"))).where(F.col("__nth") <= controls).select(item, "__block")
    held = met(based, chosen.withColumn("__control", F.lit(True)), [item, "__block"])
    agreeing = F.filter("__read", lambda r: F.exists("__base", lambda x: x["p"].eqNullSafe(r["p"])))
    matches = held.select(item, F.explode(F.array_distinct(F.transform(agreeing, lambda r: r["s"]))).alias("__s")).groupBy(item, "__s").agg(F.count("*").alias("__match"))
    others = items.select(item, "__first", F.explode("__all").alias("__s")).where("__s <> __first")
    strange = met(others, matches, [item, "__s"], "left").where(F.coalesce("__match", F.lit(0)) < least).select(item, F.lit("identity").alias("reason"))
    torn = held.where("__clash").select(item, F.lit("control_conflict").alias("reason"))
    refused = strange.unionByName(torn).groupBy(item).agg(F.max("reason").alias("reason"))  # identity before control_conflict
    kept = met(items, refused.withColumn("__no", F.lit(True)), [item], "left").where("__no IS NULL").select(item)
    rows = met(cells, _by_cell(units, kept, item, pos, cell), [item, "__cell"])
    sources = F.array_sort(F.array_distinct(F.transform("__read", lambda r: r["s"])))
    return rows.select(item, pos, "copies", _states(rows).alias("state"), sources.alias("sources")), refused


def numbered_name(name: Column, k: Column) -> Column:
    """The name with `` [recovered copy k]`` before its extension; k = 1 leaves it."""
    ext = F.regexp_extract(name, r"[^/\\](\.[^./\\]*)$", 1)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    return F.when(k > 1, F.concat(stem, F.lit(" [recovered copy "), k.cast("string"), F.lit("]"), ext)).otherwise(name)


def pause_time(events: DataFrame, session: str, ts: str, kind: str, pause: str, resume: str) -> DataFrame:
    """Seconds paused per session: repeated pauses are ignored, an open pause ends with the session's last event."""
    w = Window.partitionBy(session).orderBy(ts, kind)
    end = events.groupBy(session).agg(F.max(ts).alias("__end"))
    edge = events.where(F.col(kind).isin(pause, resume)).withColumn("__was", F.lag(kind).over(w)).where(F.col("__was").isNull() | (F.col("__was") != F.col(kind)))
    nxt = edge.withColumn("__until", F.lead(ts).over(w)).where(F.col(kind) == pause).join(end, session)
    return nxt.groupBy(session).agg(F.count("*").alias("pauses"), F.sum(micros(F.coalesce(F.col("__until"), F.col("__end"))) - micros(F.col(ts))).alias("paused_us"))


def occupancy(intervals: DataFrame, item: str, lane: str, start: str, end: str) -> DataFrame:
    """Per item, time with at least one lane busy and time with at least two, from intervals that may overlap."""
    marks = reduce(DataFrame.unionByName, [intervals.select(item, lane, F.col(start).alias("__t"), F.lit(1).alias("__d")), intervals.select(item, lane, F.col(end).alias("__t"), F.lit(-1).alias("__d"))])
    marks = marks.groupBy(item, lane, "__t").agg(F.sum("__d").alias("__d"))
    w = Window.partitionBy(item, lane).orderBy("__t")
    open_ = F.sum("__d").over(w)
    edges = marks.withColumn("__busy", (open_ > 0).cast("int")).withColumn("__before", F.coalesce(F.lag("__busy").over(w), F.lit(0)))
    lanes = edges.groupBy(item, "__t").agg(F.sum(F.col("__busy") - F.col("__before")).alias("__d"))
    t = Window.partitionBy(item).orderBy("__t")
    spans = lanes.withColumn("__active", F.sum("__d").over(t)).withColumn("__len", F.lead("__t").over(t) - F.col("__t"))
    return spans.groupBy(item).agg(F.coalesce(F.sum(F.when(F.col("__active") >= 1, F.col("__len"))), F.lit(0)).alias("busy"), F.coalesce(F.sum(F.when(F.col("__active") >= 2, F.col("__len"))), F.lit(0)).alias("both"))


def sequence_faults(events: DataFrame, session: str, seq: str, elapsed: str, kind: str, start: str, finish: str, order: list[str] | None = None) -> DataFrame:
    """Per session, in the order of seq: gaps in a dense sequence from 0, events whose elapsed time goes back, a first event that is no
    start, further starts, and events after a finish."""
    w = Window.partitionBy(session).orderBy(*(order or [seq]))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    done = F.max(flag(F.col(kind) == finish)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = events.withColumns({"__n": F.row_number().over(w) - 1, "__was": F.lag(elapsed).over(w), "__done": F.coalesce(done, F.lit(0))})
    first, begins = F.col("__n") == 0, F.col(kind) == start
    faults = {"gaps": F.col("__n") != F.col(seq), "backward": F.col(elapsed) < F.col("__was"), "bad_start": first & ~begins, "extra_starts": ~first & begins, "after_finish": F.col("__done") == 1}
    return marked.groupBy(session).agg(F.count("*").alias("events"), *[F.sum(flag(c)).alias(n) for n, c in faults.items()])


def stalls(attempts: DataFrame, item: str, order: list[Column], left: str, limit: int) -> DataFrame:
    """Per item: the longest run of attempts without progress, and the attempt at which ``limit`` is reached first (from 1)."""
    w = Window.partitionBy(item).orderBy(*order)
    a = attempts.withColumn("__n", F.row_number().over(w)).withColumn("__stuck", F.coalesce((F.col(left) >= F.lag(left).over(w)).cast("int"), F.lit(0)))
    a = a.withColumn("__group", F.sum(1 - F.col("__stuck")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(item, "__group").orderBy("__n")
    a = a.withColumn("__run", F.sum("__stuck").over(run))
    return a.groupBy(item).agg(F.max("__run").alias("longest_stall"), F.min(F.when(F.col("__run") >= limit, F.col("__n"))).alias("stop_at"))


def pass_attribution(log: DataFrame, positions: DataFrame, item: str, pos: str, line: str, kind: str, number: str, direction: str, bad: str) -> tuple[DataFrame, DataFrame]:
    """(position rows, refused items) from retry logs and the final map (``positions``: item, pos, ``bad``).

    Kinds are read_failed (the initial pass), retry_failed and recovered; odd passes go backward, even ones forward. A position
    that fails needs its initial failure first and once, rising pass numbers, the right direction and nothing after a recovery; the map
    has to agree: a recovered position is not bad, a failed one is, a bad one is in the log. One contradiction refuses the item.
    Rows: outcome, successful_pass (null: none), last_pass, direction of that pass, evidence (a position that no log names
    succeeded silently in the initial pass).
    """
    w = Window.partitionBy(item, pos).orderBy(line)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    initial, won = F.col(kind) == "read_failed", F.col(kind) == "recovered"
    seen = log.withColumns({
        "__started": F.coalesce(F.max(initial.cast("int")).over(before), F.lit(0)), "__won": F.coalesce(F.max(won.cast("int")).over(before), F.lit(0)),
        "__last": F.coalesce(F.max(F.when(~initial, F.col(number))).over(before), F.lit(0)),
    })
    right = F.when(F.col(number) % 2 == 1, "backward").otherwise("forward")
    wrong = F.when(initial, (F.col("__started") == 1) | (F.col("__last") > 0)).otherwise((F.col("__started") == 0) | (F.col("__won") == 1) | ~F.coalesce(F.col(number) > F.col("__last"), F.lit(False)) | ~F.col(direction).eqNullSafe(right))
    rows = seen.groupBy(item, pos).agg(F.max(wrong).alias("__wrong"), F.max(won).alias("__won"), F.coalesce(F.max(F.when(~initial, F.col(number))), F.lit(0)).alias("__pass"))
    met = positions.select(item, pos, F.col(bad).alias("__bad")).join(rows, [item, pos], "full_outer")
    logged = F.col("__won").isNotNull()
    fault = F.col("__bad").isNull() | F.coalesce("__wrong", F.lit(False)) | (logged & (F.col("__won") == F.col("__bad"))) | (~logged & F.coalesce("__bad", F.lit(False)))
    refused = met.where(fault).groupBy(item).agg(F.count("*").alias("contradictions"))
    last = F.coalesce("__pass", F.lit(0)).cast("int")
    evidence = F.when(F.coalesce("__won", F.lit(False)), "explicit_recovery").when(F.col("__bad"), "explicit_failure").otherwise("implicit_initial_success")
    out = met.join(refused, item, "left_anti").select(item, pos, F.when(F.col("__bad"), "unreadable").otherwise("readable").alias("outcome"), F.when(~F.col("__bad"), last).alias("successful_pass"), last.alias("last_pass"), F.when(last % 2 == 0, "forward").otherwise("backward").alias("direction"), evidence.alias("evidence"))
    return out, refused


def primary_log(paths: DataFrame, item: str, path: str) -> DataFrame:
    """One log per item (a number): by the stem of the file name 100 for the item itself, 90 for its attempts, 70 for other names that start
    with it but are no scan, retry or note, 20 for the rest of those; ties go to the smallest path. Other files take no part. Words and scores are
    fixed values."""
    name = F.regexp_extract(F.lower(F.translate(path, "\\", "/")), r"([^/]*)$", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    label = F.lpad(F.col(item).cast("string"), 3, "0")
    label = F.when(F.length(F.col(item).cast("string")) > 3, F.col(item).cast("string")).otherwise(label)
    score = F.when(stem == label, 100).when(stem.startswith(F.concat(label, F.lit("_attempt_"))), 90).when(stem.startswith(label), F.when(stem.rlike("scan|retry|note"), 20).otherwise(70))
    return best_attempt(paths.withColumn("score", score).where("score IS NOT NULL"), item, [F.desc("score"), F.col(path)])

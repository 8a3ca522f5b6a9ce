"""Join-shaped operators: matching inventories, mapping damage, comparing copies, lineage and change."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import kept
from .ranks import HOT_ROWS, ranked

#: fixed values: labels of the five outcomes of a match, in the order in which they are tried
SAME, MOVED, CHANGED = "same_path_and_hash", "same_hash_different_path", "same_path_changed_bytes"
MISSING, CURRENT_ONLY = "missing_from_current", "current_only"
SALTS = 64
#: windows of needles, and bytes of their texts, that are sent to every executor; more of them are joined by a shuffle
BROADCAST_WINDOWS, BROADCAST_BYTES = 1_000_000, 32 << 20


def folded(path: Column) -> Column:
    """A path as it is compared: forward slashes, no case."""
    return F.lower(F.translate(path, "\\", "/"))


def bag_match(reference: DataFrame, current: DataFrame, item: list[str], sha: str = "sha", size: str = "bytes", path: str = "path", scope: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One-to-one match of two inventories, item by item: item columns, ref_id, cur_id, status. Inputs have ref_id and cur_id.

    Reference rows in ``scope`` go through three modes (same path and hash; same hash and size; same path) before any other row
    starts. A row is used once; equal candidates are taken in the order of path and id. Each mode deals all rows by its key once; the kth open row
    of a key on one side takes the kth on the other. Rows in which a key is null match nothing by it. Where a key has more than ``hot_rows`` rows,
    finished rows are set aside after every mode, and open ones are ranked by ranges (``ranked``) and paired by place.
    """

    def side(df: DataFrame, name: str, row: str) -> DataFrame:
        rank = F.coalesce(F.col(scope), F.lit(False)) if scope and name == "ref" else F.lit(True)
        return df.select(*item, F.lit(name).alias("__side"), F.col(row).alias("__id"), F.col(path).alias("__path"), folded(F.col(path)).alias("__key"), F.col(sha).alias("__sha"), F.col(size).alias("__size"), rank.alias("__in"))

    pool = side(reference, "ref", "ref_id").unionByName(side(current, "cur", "cur_id")).withColumns({"status": F.lit(None).cast("string"), "__other": F.lit(None).cast("long")})
    ref = F.col("__side") == "ref"
    modes = ((SAME, ["__key", "__sha"]), (MOVED, ["__sha", "__size"]), (CHANGED, ["__key"]))
    # Only a group of all rows that one mode can bring together may be too large for a task.
    large = pool.count() > hot_rows and not pool.select(*item, F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.xxhash64(*k).alias("h")) for m, k in modes])).alias("g")).groupBy(*item, "g").count().where(F.col("count") > hot_rows).isEmpty()
    for wanted in (True, False) if scope else (True,):
        for status, keys in modes:
            known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
            open_ = F.col("status").isNull() & known & (~ref | (F.col("__in") == wanted))
            if large:
                pool = kept(pool)
                live = ranked(pool.where(open_), [*item, *keys, "__side"], [F.col("__path"), F.col("__id")], "__nth", hot_rows).withColumns({"__open": F.lit(True), "__salt": F.lit(0).cast("long")})
                rest = pool.where(~open_)
            else:
                # Rows that take no part are dealt by id, so that those without a key do not meet in one task.
                salt = F.when(open_, F.lit(0)).otherwise(F.pmod(F.xxhash64("__id"), F.lit(SALTS))).cast("long")
                dealt = pool.withColumns({"__open": open_, "__salt": salt}).repartition(*item, *keys, "__salt")
                live = dealt.withColumn("__nth", F.row_number().over(Window.partitionBy(*item, *keys, "__salt", "__open", "__side").orderBy("__path", "__id")))
                rest = None
            pair = Window.partitionBy(*item, *keys, "__salt", "__open", "__nth")
            met = live.withColumns({"__r": F.max(F.when(ref, F.col("__id"))).over(pair), "__c": F.max(F.when(~ref, F.col("__id"))).over(pair)})
            hit = F.col("__open") & F.col("__r").isNotNull() & F.col("__c").isNotNull()
            other = F.when(hit, F.when(ref, F.col("__c")).otherwise(F.col("__r"))).otherwise(F.col("__other"))
            pool = met.withColumns({"__other": other, "status": F.when(hit, status).otherwise(F.col("status"))}).drop("__open", "__nth", "__salt", "__r", "__c")
            if rest is not None:
                pool = pool.unionByName(rest)
    done = pool.where(ref | F.col("status").isNull())
    return done.select(*item, F.when(ref, F.col("__id")).alias("ref_id"), F.when(ref, F.col("__other")).otherwise(F.col("__id")).alias("cur_id"), F.coalesce("status", F.when(ref, MISSING).otherwise(CURRENT_ONLY)).alias("status"))


def residual_match(matched: DataFrame, reference: DataFrame, candidates: DataFrame, item: list[str], scope: str, sha: str = "sha", size: str = "bytes", path: str = "path") -> DataFrame:
    """Reference rows in scope that ``matched`` (of ``bag_match``) left missing, against a second inventory. The first totals stay as they are."""
    lost = matched.where(F.col("status") == MISSING).select("ref_id")
    return bag_match(reference.where(scope).join(lost, "ref_id", "left_semi"), candidates, item, sha, size, path)


def range_join(points: DataFrame, ranges: DataFrame, item: list[str], pos: str, first: str, last: str, width: int = 64) -> DataFrame:
    """Points with the ranges that hold them, by equi-joins on (item, level, position div width of the level).

    A range is entered at the level (widths grow by 16) at which it touches 17 cells at most, so that long ranges are not cut into many
    rows; a point asks at the levels that its item has. No pair outside a cell meets.
    """
    size = F.greatest(F.col(last) - F.col(first) + 1, F.lit(1))
    level = F.greatest(F.ceil(F.log2(size / F.lit(16.0 * width)) / 4), F.lit(0)).cast("int")
    cell = lambda c: F.floor(F.col(c) / (F.lit(float(width)) * F.pow(F.lit(16.0), F.col("__level")))).cast("long")
    r = ranges.where(F.col(first) <= F.col(last)).withColumn("__level", level)
    levels = r.groupBy(*item).agg(F.collect_set("__level").alias("__levels"))  # a dozen of them at most
    p = points.join(levels, item).withColumn("__level", F.explode("__levels")).drop("__levels").withColumn("__b", cell(pos))
    r = r.withColumn("__b", F.explode(F.sequence(cell(first), cell(last))))
    return p.join(r, [*item, "__level", "__b"]).where(F.col(pos).between(F.col(first), F.col(last))).drop("__b", "__level")


def damaged_files(damage: DataFrame, extents: DataFrame, item: list[str], pos: str, first: str, last: str, file_offset: str, unit: int) -> DataFrame:
    """Every damaged position with the files that depend on it and its offset in the file; known_dependency is false where no extent holds it."""
    hits = range_join(damage.select(*item, pos).distinct(), extents, item, pos, first, last)
    at = (F.col(file_offset) + (F.col(pos) - F.col(first)) * unit).alias("file_byte")
    found = hits.withColumn("file_byte", at).drop(first, last, file_offset).withColumn("known_dependency", F.lit(True))
    return damage.select(*item, pos).distinct().join(found, [*item, pos], "left").fillna(False, ["known_dependency"])


def agreement(a: DataFrame, b: DataFrame, item: str, pos: str, payload: str, sizes: DataFrame | None = None) -> DataFrame:
    """Per item, readable positions of each source, those that both hold (agree, conflict), and the verdict.

    ``sizes``: item, a_size, b_size, the positions that each source should have; sources of different or unknown size are not compared.
    """
    left = a.select(item, pos, F.col(payload).alias("__a"), F.lit(1).alias("__ina"))
    right = b.select(item, pos, F.col(payload).alias("__b"), F.lit(1).alias("__inb"))
    both = left.join(right, [item, pos], "full_outer")
    pair = F.col("__ina").isNotNull() & F.col("__inb").isNotNull()
    same = F.col("__a").eqNullSafe(F.col("__b"))
    out = both.groupBy(item).agg(F.count("__ina").alias("a_readable"), F.count("__inb").alias("b_readable"), F.count_if(pair & same).alias("agree"), F.count_if(pair & ~same).alias("conflict"))
    verdict = F.when(F.col("conflict") > 0, "disagree").when(F.col("agree") > 0, "consistent").otherwise("no_overlap")
    if sizes is not None:
        out = sizes.select(item, "a_size", "b_size").join(out, item, "full_outer").fillna(0, ["a_readable", "b_readable", "agree", "conflict"])
        verdict = F.when(F.coalesce(F.col("a_size") != F.col("b_size"), F.lit(True)), "geometry").otherwise(verdict)
    return out.withColumn("verdict", verdict).drop("a_size", "b_size")


def conflict_gate(counts: DataFrame, most: int = 32, least_agree: int = 128) -> DataFrame:
    """Whether the conflicts are few enough to go on: 1 to ``most`` of them, enough agreement, at most one in a hundred.

    A source without any readable position can only be taken by custody; it never counts as a match.
    """
    a, c = F.col("agree"), F.col("conflict")
    gate = F.when((F.col("a_readable") == 0) & (a == 0) & (c == 0), "custody_only").when((c >= 1) & (c <= most) & (a >= least_agree) & (100 * c <= a + c), "pass").otherwise("refuse")
    return counts.withColumn("gate", gate)


def mirror_fill(units: DataFrame, item: str, pos: str, good: str, start: int, length: int, copies: int = 2) -> DataFrame:
    """Bad positions with the first good position of the same offset in another copy of the mirrored region, which holds ``copies``
    runs of ``length`` positions from ``start``. Positions outside it have no donor."""
    inside = F.col(pos).between(start, start + length * copies - 1)
    off = F.when(inside, (F.col(pos) - start) % length).alias("__off")
    donors = units.where(F.col(good) & inside).select(item, off, F.col(pos).alias("__p")).groupBy(item, "__off").agg(F.min("__p").alias("donor"))
    return units.where(~F.col(good)).select(item, pos, off).distinct().join(donors, [item, "__off"], "left").drop("__off")


def pair_events(starts: DataFrame, results: DataFrame, keys: list[str], start_ts: str, result_ts: str) -> DataFrame:
    """Starts and results with the same keys; state is paired, open (no result) or orphan (no start)."""
    both = starts.select(*keys, F.col(start_ts).alias("started")).join(results.select(*keys, F.col(result_ts).alias("finished")), keys, "full_outer")
    return both.withColumn("state", F.when(F.col("finished").isNull(), "open").when(F.col("started").isNull(), "orphan").otherwise("paired"))


def reuse(current: DataFrame, previous: DataFrame, key: str, binding: list[str], recorded: str | None = None, found: str | None = None) -> DataFrame:
    """Whether the previous result of each row still holds: all binding columns equal, nulls included, and, if given, the hash ``found`` in
    the stored output equal to the ``recorded`` one."""
    old = previous.select(F.col(key), F.lit(True).alias("__had"), *[F.col(c).alias(f"__{c}") for c in binding], *([F.coalesce(F.col(recorded) == F.col(found), F.lit(False)).alias("__kept")] if recorded else [F.lit(True).alias("__kept")]))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in binding])
    return current.join(old, key, "left").select(key, F.when(F.col("__had").isNull(), "new").when(same & F.col("__kept"), "reuse").otherwise("redo").alias("action"))


def snapshot_changes(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys that were added, removed or changed between two inventories."""
    a = before.select(key, F.lit(True).alias("__a"), *[F.col(c).alias(f"__a_{c}") for c in fields])
    b = after.select(key, F.lit(True).alias("__b"), *[F.col(c).alias(f"__b_{c}") for c in fields])
    same = reduce(lambda x, y: x & y, [F.col(f"__a_{c}").eqNullSafe(F.col(f"__b_{c}")) for c in fields])
    both = a.join(b, key, "full_outer")
    return both.select(key, F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(same, "same").otherwise("changed").alias("change")).where("change <> 'same'")


def leaf_digits(rows: int, per_leaf: int = 4096) -> int:
    """Hex digits of a key's hash that name a leaf of a digest tree, so that a leaf has about ``per_leaf`` rows."""
    digits = 2
    while rows > per_leaf << (4 * digits):
        digits += 2
    return digits


def _hashed(rows: DataFrame, key: str, fields: list[str], digits: int) -> DataFrame:
    """prefix (of the key's SHA-256) and the SHA-256 of key and fields, nulls included."""
    row = F.to_json(F.struct(key, *fields), {"ignoreNullFields": "false"})
    return rows.select(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, digits).alias("prefix"), F.sha2(row, 256).alias("digest"))


def digest_tree(rows: DataFrame, key: str, fields: list[str], digits: int) -> list[DataFrame]:
    """The levels of a tree of digests, leaves first: prefix, rows, digest. A leaf's digest is the SHA-256 of the sorted digests of its rows, a
    node's that of the digests of its at most 256 children in the order of their prefixes, two hex digits a level; the root's prefix is empty.

    Null keys are one leaf with a null prefix, a child of the root. Groups stay small if ``digits`` comes from ``leaf_digits``.
    """
    leaves = _hashed(rows, key, fields, digits).groupBy("prefix").agg(F.count("*").alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list("digest")), ""), 256).alias("digest"))
    levels = [leaves]
    for n in range(digits - 2, -1, -2):
        children = F.array_sort(F.collect_list(F.struct("prefix", "digest")))
        up = levels[-1].groupBy((F.substring("prefix", 1, n) if n else F.lit("")).alias("__up")).agg(F.sum("rows").alias("rows"), F.sha2(F.array_join(F.transform(children, lambda c: c["digest"]), ""), 256).alias("digest"))
        levels.append(up.withColumnRenamed("__up", "prefix"))
    return levels


def snapshot_digest(rows: DataFrame, key: str, fields: list[str], digits: int | None = None) -> DataFrame:
    """One row: the number of rows and the root of ``digest_tree``, which does not depend on their order. Without rows, the digest is that of nothing."""
    root = digest_tree(rows, key, fields, digits or leaf_digits(rows.count()))[-1]
    return root.agg(F.coalesce(F.max("rows"), F.lit(0)).alias("rows"), F.coalesce(F.max("digest"), F.sha2(F.lit(""), 256)).alias("digest"))


def changed_leaves(before: DataFrame, after: DataFrame, key: str, fields: list[str], digits: int) -> DataFrame:
    """Prefixes of the leaves whose rows differ."""
    a, b = (digest_tree(x, key, fields, digits)[0].withColumnsRenamed({"prefix": f"__{n}", "digest": f"__d{n}"}).drop("rows") for n, x in (("a", before), ("b", after)))
    both = a.join(b, F.col("__a").eqNullSafe(F.col("__b")), "full_outer").where(~F.col("__da").eqNullSafe(F.col("__db")))
    return both.select(F.coalesce("__a", "__b").alias("prefix"))


def changes_in_leaves(before: DataFrame, after: DataFrame, key: str, fields: list[str], digits: int) -> DataFrame:
    """``snapshot_changes`` of the rows of changed leaves alone: all other rows are the same. Null keys take no part."""
    leaves = changed_leaves(before, after, key, fields, digits)
    inside = lambda df: df.join(leaves, F.substring(F.sha2(F.col(key).cast("string"), 256), 1, digits) == F.col("prefix"), "left_semi")
    return snapshot_changes(inside(before), inside(after), key, fields)


def changed_during_run(before: DataFrame, after: DataFrame, key: str, fields: list[str], digits: int | None = None) -> DataFrame:
    """One row: rows of the inventory at both ends of a run, and whether their digests differ."""
    digits = digits or leaf_digits(before.count())
    ends = snapshot_digest(before, key, fields, digits).withColumn("__end", F.lit(0)).unionByName(snapshot_digest(after, key, fields, digits).withColumn("__end", F.lit(1)))
    one = lambda c, e: F.max(F.when(F.col("__end") == e, F.col(c)))
    return ends.agg(one("rows", 0).alias("rows_before"), one("rows", 1).alias("rows_after"), (one("digest", 0) != one("digest", 1)).alias("changed_during_run"))


def cut(content: Column, size: int) -> Column:
    """The content in cells of ``size`` characters, in one pass."""
    return F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit("(?s).{1,%d}" % size), F.lit(0))


def cells(df: DataFrame, keys: list[str], content: str, size: int) -> DataFrame:
    """Cells of ``size`` characters (128 to 4096): pos, cell. Empty content has none."""
    if not 128 <= size <= 4096:
        raise ValueError("cells have 128 to 4096 characters")
    return df.select(*keys, F.posexplode(cut(F.col(content), size)).alias("pos", "cell"))


def compare_cells(a: DataFrame, b: DataFrame, item: str, pos: str = "pos", cell: str = "cell", ranges: DataFrame | None = None) -> DataFrame:
    """Per item (and per name of ``ranges``: item, name, first, last) the characters of cells that agree, differ or are unavailable on
    a side. A null cell is unavailable."""
    if ranges is not None:
        in_range = lambda df: range_join(df, ranges, [item], pos, "first", "last").drop("first", "last")
        a, b = in_range(a), in_range(b)
    keys = [item] + (["name"] if ranges is not None else [])
    both = a.select(*keys, pos, F.col(cell).alias("__a")).join(b.select(*keys, pos, F.col(cell).alias("__b")), [*keys, pos], "full_outer")
    x, y = F.col("__a"), F.col("__b")
    longest = F.greatest(F.coalesce(F.length(x), F.lit(0)), F.coalesce(F.length(y), F.lit(0)))
    differing = F.size(F.filter(F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: F.coalesce(p, F.lit("")) == F.coalesce(q, F.lit(""))), lambda same: ~same))
    none = x.isNull() | y.isNull()
    d = F.when(none, 0).when(x == y, 0).otherwise(differing)
    counted = both.select(*keys, F.when(none, 0).otherwise(longest - d).alias("agree"), d.alias("differ"), F.when(none, longest).otherwise(0).alias("unavailable"))
    return counted.groupBy(*keys).agg(*[F.sum(c).cast("long").alias(c) for c in ("agree", "differ", "unavailable")])


def compare_components(a: DataFrame, b: DataFrame, container: str, component: str, content: str, summary: list) -> DataFrame:
    """Per container: components of each side alone and of both, equal ones, whether all are equal, and whether only ``summary`` ones differ."""
    one = lambda df, x: df.select(container, component, F.col(content).alias(x), F.lit(True).alias(f"{x}_in"))
    both = one(a, "__a").join(one(b, "__b"), [container, component], "full_outer")
    in_a, in_b = F.coalesce("__a_in", F.lit(False)), F.coalesce("__b_in", F.lit(False))
    same = in_a & in_b & F.col("__a").eqNullSafe(F.col("__b"))
    differ = F.count_if(~same)
    return both.groupBy(container).agg(
        F.count_if(~in_b).alias("left_only"), F.count_if(~in_a).alias("right_only"), F.count_if(in_a & in_b).alias("both_sides"), F.count_if(same).alias("equal_parts"), (differ == 0).alias("all_equal"),
        ((differ > 0) & (F.count_if(~same & ~F.col(component).isin(summary)) == 0)).alias("only_summary_differs"),
    )


def diff_runs(df: DataFrame, keys: list[str], a: str, b: str, most: int = 32) -> DataFrame:
    """Per row: different characters, the first ``most`` maximal runs of them (offset from 0, length), and whether there are more.

    The longer value's tail differs. A null value is empty.
    """
    chars = lambda c: F.split(F.coalesce(F.col(c), F.lit("")), "")
    same = F.zip_with(chars(a), chars(b), lambda x, y: F.coalesce(x, F.lit("")).eqNullSafe(F.coalesce(y, F.lit(""))))
    marks = df.select(*keys, same.alias("__same"))
    rows = marks.select(*keys, F.posexplode("__same").alias("__pos", "__ok")).where(~F.col("__ok"))
    w = Window.partitionBy(*keys).orderBy("__pos")
    runs = rows.withColumn("__run", F.col("__pos") - F.row_number().over(w)).groupBy(*keys, "__run").agg(F.min("__pos").cast("long").alias("offset"), F.count("*").alias("length"))
    found = runs.groupBy(*keys).agg(F.sum("length").alias("different"), F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("runs"))
    out = df.select(*keys).join(found, keys, "left")
    return out.select(*keys, F.coalesce("different", F.lit(0)).alias("different"), F.slice(F.coalesce("runs", F.array().cast("array<struct<offset:bigint,length:bigint>>")), 1, most).alias("runs"), F.coalesce(F.size("runs") > most, F.lit(False)).alias("more"))


def containment(needles: DataFrame, haystacks: DataFrame, needle_id: str, needle: str, hay_id: str, hay: str, least: int = 128, anchor: int = 32, most: int = 16) -> DataFrame:
    """(needle_id, hay_id, offset, offsets, further_unknown) of every needle of at least ``least`` characters that occurs whole.

    A haystack is probed every least - anchor + 1 characters, so that an occurrence holds a whole probe of ``anchor`` characters; probes
    are joined by hash with all windows of the needles, and each candidate place is verified once. ``offsets`` are the first ``most``
    places, from 0; with so many of them, further ones are unknown.
    """
    stride = least - anchor + 1
    n = needles.where(F.length(needle) >= least).select(needle_id, F.col(needle).alias("__needle"))
    window = F.posexplode(F.transform(F.sequence(F.lit(1), F.length("__needle") - anchor + 1), lambda i: F.xxhash64(F.substring(F.col("__needle"), i, F.lit(anchor))))).alias("__w", "__h")
    windows = n.select(needle_id, window)
    size = n.agg(F.coalesce(F.sum(F.length("__needle") - anchor + 1), F.lit(0)).alias("windows"), F.coalesce(F.sum(F.octet_length("__needle")), F.lit(0)).alias("bytes")).first()
    few, light = size.windows <= BROADCAST_WINDOWS, size.bytes <= BROADCAST_BYTES
    # A cell and the start of the next one; a cell starts at every multiple of the stride.
    texts = haystacks.select(hay_id, cut(F.col(hay), stride).alias("__cells"))
    probe = F.transform("__cells", lambda x, i: F.substring(F.concat(x, F.coalesce(F.try_element_at("__cells", i + 2), F.lit(""))), 1, anchor))
    probes = texts.select(hay_id, F.posexplode(probe).alias("__cell", "__probe")).where(F.length("__probe") == anchor)
    probes = probes.select(hay_id, (F.col("__cell") * stride).cast("long").alias("__at"), F.xxhash64("__probe").alias("__h"))
    places = probes.join(F.broadcast(windows) if few else windows, "__h").select(needle_id, hay_id, (F.col("__at") - F.col("__w")).alias("__place")).where("__place >= 0").distinct()
    known = places.join(F.broadcast(n) if light else n, needle_id)
    whole = known.join(haystacks.select(hay_id, F.col(hay).alias("__hay")), hay_id).where(F.substring(F.col("__hay"), (F.col("__place") + 1).cast("int"), F.length("__needle")) == F.col("__needle"))
    nth = F.row_number().over(Window.partitionBy(needle_id, hay_id).orderBy("__place"))  # no more than ``most`` places leave a task
    found = whole.select(needle_id, hay_id, "__place").withColumn("__nth", nth).where(F.col("__nth") <= most).groupBy(needle_id, hay_id).agg(F.array_sort(F.collect_list("__place")).alias("offsets"))
    return found.select(needle_id, hay_id, F.element_at("offsets", 1).alias("offset"), "offsets", (F.size("offsets") >= most).alias("further_unknown"))


def trace_extents(extents: DataFrame, item: str, seq: str, payload: str) -> DataFrame:
    """Per item the extents in order, joined and hashed. An item's extents are one group, as its content is one value."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(seq), F.col(payload).alias("p"))))
    return extents.groupBy(item).agg(parts.alias("x")).select(item, F.size("x").alias("extents"), F.sha2(F.array_join(F.transform("x", lambda e: e["p"]), "").cast("binary"), 256).alias("sha"))


def check_traces(traces: DataFrame, files: DataFrame, item: str, sha: str) -> DataFrame:
    """Every file with whether its extents give its recorded hash: traced, differs, or no_extents."""
    recorded = files.select(item, F.col(sha).alias("__recorded"))
    state = F.when(F.col("extents").isNull(), "no_extents").when(F.col("sha").eqNullSafe(F.col("__recorded")), "traced").otherwise("differs")
    return recorded.join(traces, item, "left").select(item, F.coalesce("extents", F.lit(0)).alias("extents"), state.alias("state"))


def lineage(merged: DataFrame, units: DataFrame, item: str, pos: str, source: str, attempt: str, sha: str, recorded: str, derived: DataFrame) -> DataFrame:
    """Positions of a derived item with the donor's hash and a state: original, hash_differs, donor_missing, or donor_is_derived.

    ``derived``: item and attempt of attempts that are themselves derived; a donor has to be original.
    """
    donors = units.select(item, pos, F.col(attempt).alias(source), F.col(sha).alias("donor_sha"), F.lit(True).alias("__found"))
    made = derived.select(item, F.col(attempt).alias(source), F.lit(True).alias("__made")).distinct()
    joined = merged.where(F.col(source).isNotNull()).join(donors, [item, pos, source], "left").join(made, [item, source], "left")
    state = F.when(F.col("__found").isNull(), "donor_missing").when(F.coalesce("__made", F.lit(False)), "donor_is_derived").when(F.col("donor_sha").eqNullSafe(F.col(recorded)), "original").otherwise("hash_differs")
    return joined.select(item, pos, source, "donor_sha", state.alias("state"))


def bound_results(results: DataFrame, sources: DataFrame, item: str, path: str, sha: str) -> DataFrame:
    """Results with found (a source of the item has the path, case ignored) and valid (and the same hash)."""
    have = sources.select(F.col(item), folded(F.col(path)).alias("__key"), F.col(sha).alias("__sha"))
    have = have.groupBy(item, "__key").agg(F.collect_set("__sha").alias("__shas"))
    out = results.withColumn("__key", folded(F.col(path))).join(have, [item, "__key"], "left")
    return out.withColumn("found", F.col("__shas").isNotNull()).withColumn("valid", F.coalesce(F.array_contains("__shas", F.col(sha)), F.lit(False))).drop("__key", "__shas")


def file_roles(stored: DataFrame, originals: DataFrame, generated: DataFrame, path: str, sha: str) -> DataFrame:
    """Stored files with role (original, generated, untracked: first hit) and integrity (valid, changed; null if untracked)."""
    side = lambda df, x: df.groupBy(F.col(path)).agg(F.collect_set(sha).alias(x))
    both = stored.join(side(originals, "__o"), path, "left").join(side(generated, "__g"), path, "left")
    role = F.when(F.col("__o").isNotNull(), "original").when(F.col("__g").isNotNull(), "generated").otherwise("untracked")
    expected = F.coalesce("__o", "__g")
    return both.withColumn("role", role).withColumn("integrity", F.when(expected.isNotNull(), F.when(F.coalesce(F.array_contains(expected, F.col(sha)), F.lit(False)), "valid").otherwise("changed"))).drop("__o", "__g")


def missing_rows(rows: DataFrame, done: DataFrame, keys: list[str], eligible: Column | None = None) -> DataFrame:
    """Eligible rows whose keys ``done`` does not have."""
    return (rows if eligible is None else rows.where(eligible)).join(done.select(*keys).distinct(), keys, "left_anti")


def claims_of(labels: DataFrame, index: DataFrame, extraction: DataFrame, item: str, status: str) -> DataFrame:
    """Every label with its claim: the status of the index, else of the extraction, else NO STATUS, and which of them it is."""
    one = lambda df, x: df.groupBy(item).agg(F.min(status).alias(x))
    j = labels.select(item).distinct().join(one(index, "__i"), item, "left").join(one(extraction, "__e"), item, "left")
    return j.select(item, F.coalesce("__i", "__e", F.lit("NO STATUS")).alias("claim"), F.when(F.col("__i").isNotNull(), "index").when(F.col("__e").isNotNull(), "extraction").otherwise("none").alias("origin"))


def claims_against_inventory(claims: DataFrame, inventory: DataFrame, by: list[str], order: list[str], key: str, size: str) -> DataFrame:
    """Claims with a state: duplicate (a later record of ``by``), missing from the inventory, size differs, or ok. Of records equal in
    ``order`` that with the smaller size is first, null before all."""
    w = Window.partitionBy(*by).orderBy(*order, size)
    have = inventory.select(key, F.col(size).alias("__have"), F.lit(True).alias("__in"))
    state = F.when(F.col("__nth") > 1, "duplicate").when(F.col("__in").isNull(), "missing").when(~F.col(size).eqNullSafe(F.col("__have")), "size").otherwise("ok")
    return claims.withColumn("__nth", F.row_number().over(w)).join(have, key, "left").withColumn("state", state).drop("__nth", "__have", "__in")


def status_disagreement(claimed: DataFrame, parsed: DataFrame, item: str) -> DataFrame:
    """Items whose parsed status is another word than the claimed one, case ignored."""
    return claimed.select(item, "claimed").join(parsed.select(item, "derived"), item).where(F.lower("claimed") != F.lower("derived"))


def mapped_hits(hits: DataFrame, maps: DataFrame, damage: DataFrame, hit: list[str], hay_id: str, first: str, last: str, pos: str = "pos") -> DataFrame:
    """Hits with the number of damaged positions that they cover; ``maps`` lists the haystacks whose damage is known, others get a null."""
    covered = range_join(damage, hits, [hay_id], pos, first, last).groupBy(*hit).agg(F.countDistinct(pos).alias("damaged"))
    known = maps.select(hay_id).distinct().withColumn("__known", F.lit(True))
    out = hits.join(covered, hit, "left").join(known, hay_id, "left")
    damaged = F.when(F.col("__known"), F.coalesce("damaged", F.lit(0).cast("long")))
    return out.withColumn("damaged", damaged).withColumn("state", F.when(F.col("damaged").isNull(), "map unavailable").when(F.col("damaged") > 0, "damaged").otherwise("clear")).drop("__known")


def packaged_outputs(outputs: DataFrame, manifest: DataFrame, item: str, path: str, sha: str) -> DataFrame:
    """Per item, how many distinct outputs are in the manifest with the same hash, and how many are not."""
    one = outputs.select(item, path, sha).distinct()
    listed = manifest.select(path, sha).distinct().withColumn("__in", F.lit(True))
    found = one.join(listed, [path, sha], "left").groupBy(item, path).agg(F.max(F.coalesce("__in", F.lit(False))).alias("__in"))
    return found.groupBy(item).agg(F.count_if("__in").alias("included"), F.count_if(~F.col("__in")).alias("missing"))

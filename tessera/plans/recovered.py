"""Queries of logs and listings, of items of any size and of hot groups, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates, audit, generations, joins, windows
from ..sources import logs, readers
from ..sources.scratch import kept
from .catalog import ORACLE_SQL, QUERIES, query

__all__ = ["ORACLE_SQL", "QUERIES"]

# Logs: the events of a user are the lines of a log, written as text and read back ----------------------------------------
LOG = """e AS (SELECT user_id AS file, user_id % 840 AS u, event_id AS n, event_type AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
l AS (SELECT file, u, n, r, CASE WHEN r = 1 THEN 'begin' WHEN r = 2 THEN 'geometry' WHEN r = 3 AND u % 3 > 0 OR r = 5 AND u % 10 = 0 THEN 'policy' WHEN r = 4 AND u % 2 = 0 THEN 'range'
      WHEN r <= 5 THEN 'note' WHEN k = 'click' THEN 'bad' WHEN k = 'purchase' THEN 'end' WHEN k = 'view' THEN 'failed' WHEN k = 'signup' THEN 'recovered' ELSE 'note' END AS kind FROM e),
b AS (SELECT DISTINCT file, n % 2850 AS pos FROM l WHERE kind = 'bad'),
g AS (SELECT file, any_value(u) AS u, CASE WHEN count(*) FILTER (kind = 'end') > 0 THEN arg_max(CASE WHEN n % 2 = 1 THEN 'PARTIAL' ELSE 'OK' END, r) FILTER (kind = 'end') ELSE 'IN PROGRESS' END AS status,
      count(*) FILTER (kind = 'failed') AS retry_failures, coalesce(arg_max(n % 9, r) FILTER (kind = 'end' AND n % 5 = 0), count(*) FILTER (kind = 'recovered')) AS retry_recovered,
      arg_max(n, r) FILTER (kind = 'end') AS bytes_written, arg_max(sha256(CAST(n AS VARCHAR)), r) FILTER (kind = 'end' AND n % 3 = 0) AS sha256, count(*) FILTER (kind = 'end') > 0 AS end_seen,
      count(*) FILTER (kind = 'policy') AS policies, min(r) FILTER (kind = 'policy') AS policy_line FROM l GROUP BY file),
h AS (SELECT *, u % 2 = 0 AS ranged, 2800 + u % 5 * 40 AS first, CASE WHEN u % 7 = 0 THEN 2900 ELSE 3000 END AS last, policies > 0 AND u % 4 < 3 AS allowed FROM g),
f AS (SELECT *, CASE WHEN policy_line = 3 AND NOT allowed THEN {'line': 2, 'reason': 'policy_budget'} WHEN ranged AND first >= last THEN {'line': 3, 'reason': 'range_invalid'}
      WHEN policies > 1 THEN {'line': 4, 'reason': 'duplicate_policy'} WHEN policy_line = 5 AND NOT allowed THEN {'line': 4, 'reason': 'policy_budget'}
      WHEN ranged AND (NOT allowed OR status <> 'PARTIAL' OR last <> 3000 OR EXISTS (SELECT 1 FROM b WHERE b.file = h.file AND pos >= first AND pos < last)) THEN {'line': NULL, 'reason': 'unsupported_range'} END AS fault FROM h)"""


def _log_lines(t) -> DataFrame:
    r = F.row_number().over(windows.Window.partitionBy("user_id").orderBy("ts", "event_id"))
    n, u = F.col("event_id"), F.col("user_id") % 840
    s = lambda c: c.cast("string")
    join = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else s(x) for x in p])
    bad = F.when(n % 3 == 0, join("BAD_SECTOR | LBA=", n % 2850, " | zero_filled=true")).when(n % 3 == 1, join("BAD_SECTOR | sector=", n % 2850)).otherwise(join("BAD_SECTOR: ", n % 2850, " unreadable"))
    end = F.concat(join("END | status=", F.when(n % 2 == 1, "partial").otherwise("SUCCESS"), " | bytes=", n), F.when(n % 5 == 0, join(" | retry_recovered=", n % 9)).otherwise(""), F.when(n % 3 == 0, join(" | SHA256=", F.upper(F.sha2(s(n), 256)))).otherwise(""))
    k, row = F.col("event_type"), F.col("r")
    text = (
        F.when(row == 1, join("BEGIN | disk=00", F.col("user_id"), " | attempt=", u % 5)).when(row == 2, "GEOMETRY | cylinders=80 | heads=2 | total_sectors=3000")
        .when(((row == 3) & (u % 3 > 0)) | ((row == 5) & (u % 10 == 0)), join("USB_HANDOFF_POLICY | retries=", u % 4))
        .when((row == 4) & (u % 2 == 0), join("UNREAD_RANGE | first=", 2800 + u % 5 * 40, " | end_exclusive=", F.when(u % 7 == 0, 2900).otherwise(3000), " | reason=usb_fast_handoff"))
        .when(row <= 5, "NOTE | lba=1").when(k == "click", bad).when(k == "purchase", end).when(k == "view", "SECTOR_READ_FAILED | lba=3").when(k == "signup", "RETRY_RECOVERED | lba=4").otherwise("NOTE | a=b")
    )
    lines = t("events").withColumn("r", r).select(F.col("user_id").alias("file"), (F.col("r") - 1).alias("line"), text.alias("text"))
    stamped = F.when(F.col("line") % 2 == 1, F.concat(F.lit("[2026-01-01 00:00:00.000] "), "text")).otherwise(F.concat(F.lit("2026-01-01 00:00:00.000  "), F.translate("text", "|", " ")))
    return lines.withColumn("text", stamped)


def _folded(t):
    # Lines are matched once; every branch of the fold reads what was written.
    return logs.fold_log(kept(logs.log_records(_log_lines(t), "file", "line", "text")))


@query("src2_log_records", f"""WITH {LOG},
c AS (SELECT file, count(*) AS n FROM b GROUP BY file)
SELECT file, status, file AS disk, u % 5 AS attempt, CAST(NULL AS VARCHAR) AS source, 80 AS cylinders, 2 AS heads, CAST(NULL AS BIGINT) AS sectors_per_track, CAST(NULL AS BIGINT) AS bytes_per_sector, 3000 AS total_sectors, CAST(NULL AS BIGINT) AS total_bytes,
  CASE WHEN policies > 0 THEN u % 4 END AS policy_retries, retry_failures, retry_recovered, bytes_written, sha256, TRUE AS begin_seen, end_seen,
  coalesce(c.n, 0) + CASE WHEN ranged THEN last - first ELSE 0 END AS bad_positions, CASE WHEN ranged THEN last - first ELSE 0 END AS unread_positions
FROM f LEFT JOIN c USING (file) WHERE fault IS NULL""")
def _(t):
    return _folded(t)[0]


@query("src2_log_positions", f"""WITH {LOG}
SELECT file, pos, 'bad' AS state FROM b JOIN f USING (file) WHERE fault IS NULL UNION ALL SELECT file, unnest(range(first, last)) AS pos, 'unread' AS state FROM f WHERE fault IS NULL AND ranged""")
def _(t):
    return _folded(t)[1]


@query("src2_refused_logs", f"WITH {LOG} SELECT file, fault.line AS line, fault.reason AS reason FROM f WHERE fault IS NOT NULL")
def _(t):
    return _folded(t)[2]


# Map logs: the lines of an order ---------------------------------------------------------------------------------------
MAP = """a AS (SELECT l_orderkey AS file, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) AS line, l_partkey AS p, l_suppkey AS s, CAST(l_quantity AS BIGINT) AS q, l_returnflag AS f FROM lineitem),
b AS (SELECT *, CASE p % 10 WHEN 0 THEN 'start' WHEN 1 THEN 'stop' WHEN 2 THEN 'sector' ELSE 'record' END AS kind,
      CASE WHEN p % 10 < 3 THEN NULL WHEN s % 19 = 0 THEN 'row' WHEN s % 23 = 0 THEN 'direction' WHEN s % 29 = 0 THEN 'number' WHEN s % 31 = 0 THEN 'bound' END AS fault, CASE WHEN f = 'R' THEN 'E' ELSE 'C' END AS state, p % 60 AS start, q % 20 + 1 AS n FROM a),
c AS (SELECT *, count(*) FILTER (kind IN ('start', 'stop')) OVER (PARTITION BY file ORDER BY line) AS pass FROM b),
g AS (SELECT file, count(*) FILTER (kind = 'start') AS starts, count(*) FILTER (kind = 'stop') AS stops, arg_max(512 + q, line) FILTER (kind = 'sector') AS sector_size, arg_min({'line': line, 'reason': fault}, line) FILTER (fault IS NOT NULL) AS bad_line, count(*) FILTER (kind = 'record') AS records, max(start + n) FILTER (kind = 'record') AS highest FROM c GROUP BY file),
r AS (SELECT file, pos, arg_max(state, line) AS state FROM (SELECT file, line, state, unnest(range(start, start + n)) AS pos FROM c WHERE kind = 'record' AND fault IS NULL) JOIN g USING (file) WHERE bad_line IS NULL GROUP BY file, pos)"""


def _map_lines(t) -> DataFrame:
    p, s, q = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity").cast("long")
    line = F.row_number().over(windows.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity"))
    state = F.when(F.col("l_returnflag") == "R", "E").otherwise("C")
    way = F.when(s % 23 == 0, "> <").when(s % 2 == 0, "> >").otherwise("< <")
    start = F.when(s % 29 == 0, "x").when((s % 31 == 0) & (s % 19 > 0), "1048570").otherwise((p % 60).cast("string"))
    record = F.when(s % 19 == 0, F.concat(state, F.lit(" 1 > > 5"))).otherwise(F.concat_ws(" ", state, F.lit("1"), way, start, F.lit(":"), F.when(s % 31 == 0, q + 7).otherwise(q % 20 + 1).cast("string")))
    text = F.when(p % 10 == 0, "Start scan").when(p % 10 == 1, "STOP scan").when(p % 10 == 2, F.concat(F.lit("logsec="), (q + 512).cast("string"))).otherwise(F.concat(F.lit("  "), record))
    return t("lineitem").select(F.col("l_orderkey").alias("file"), line.alias("line"), text.alias("text"))


@query("src3_map_log", f"""WITH {MAP},
n AS (SELECT file, count(*) FILTER (state = 'C') AS copied, count(*) FILTER (state = 'E') AS bad FROM r GROUP BY file),
w AS (SELECT file, count(*) FILTER (s % 2 = 0) AS forward, count(*) FILTER (s % 2 = 1) AS reverse FROM (SELECT file, pass, arg_min(s, line) AS s FROM c WHERE kind = 'record' GROUP BY file, pass) GROUP BY file)
SELECT file, CASE WHEN starts > stops THEN 'IN PROGRESS' WHEN bad = 0 THEN 'OK' ELSE 'PARTIAL' END AS status, sector_size, greatest(forward + reverse, starts) AS passes, forward, reverse, copied, bad, highest, starts, stops
FROM g JOIN n USING (file) JOIN w USING (file) WHERE bad_line IS NULL AND records > 0""")
def _(t):
    return logs.map_log(_map_lines(t), "file", "line", "text")[0]


@query("src3_refused_maps", f"WITH {MAP} SELECT file, bad_line.line AS line, coalesce(bad_line.reason, 'no_records') AS reason FROM g WHERE bad_line IS NOT NULL OR records = 0")
def _(t):
    return logs.map_log(_map_lines(t), "file", "line", "text")[2]


# Listings: the documents of a source and a language are the lines of one file, in UTF-8 or UTF-16 -------------------------------
LISTING = """d AS (SELECT source || '/' || lang || '/' || doc_id % 40 AS file, CASE WHEN doc_id % 997 = 5 THEN '../up' WHEN doc_id % 991 = 5 THEN 'c:/x' ELSE 'dir é/part ' || n_chars // 40 END AS path, n_chars AS size,
      CASE doc_id % 4 WHEN 0 THEN 'deleted' WHEN 1 THEN 'live' WHEN 2 THEN 'signature_carved' ELSE 'unknown' END AS state, doc_id % 997 = 5 OR doc_id % 991 = 5 AS unsafe, doc_id % 40 = 39 AS torn FROM documents),
x AS (SELECT file, CASE WHEN bool_or(torn) THEN 'encoding' WHEN bool_or(unsafe) THEN 'unsafe_path' END AS reason FROM d GROUP BY file)"""


def _listings(t):
    i = F.col("doc_id")
    mark = F.element_at(F.array(*map(F.lit, ("xf", ".", "+.doc", "?"))), (i % 4 + 1).cast("int"))
    path = F.when(i % 997 == 5, "..\\up").when(i % 991 == 5, "C:\\x").otherwise(F.concat(F.lit("Dir É\\part "), F.floor(F.col("n_chars") / F.lit(40)).cast("string")))
    line = F.concat_ws(" ", F.lit("a b"), F.col("n_chars").cast("string"), F.lit("c d"), mark, path)
    file = F.concat_ws("/", "source", "lang", (i % 40).cast("string"))
    text = t("documents").select(file.alias("file"), (i % 40).alias("k"), line.alias("line")).groupBy("file", "k").agg(F.array_join(F.collect_list("line"), "\r\n").alias("text"))
    text = F.concat(F.lit("name path size other more state\r\n"), "text"), text
    wide = F.encode(text[0], "UTF-16LE")
    content = F.when(F.col("k") == 39, F.concat(F.unhex(F.lit("FFFE")), wide, F.unhex(F.lit("41")))).when(F.col("k") % 3 == 0, wide).when(F.col("k") % 3 == 1, F.concat(F.unhex(F.lit("FFFE")), wide)).otherwise(F.encode(text[0], "UTF-8"))
    return readers.parse_listing(readers.decode_listing(text[1].select("file", content.alias("content"))), "file", "text")


@query("src6_listing_files", f"""WITH {LISTING}
SELECT file, path, CASE WHEN count(*) > 1 THEN 0 ELSE min(size) END AS bytes, CASE WHEN count(*) > 1 THEN 'ambiguous' ELSE min(state) END AS state FROM d JOIN x USING (file) WHERE reason IS NULL GROUP BY 1, 2""")
def _(t):
    return _listings(t)[0]


@query("src6_refused_listings", f"WITH {LISTING} SELECT file, reason FROM x WHERE reason IS NOT NULL")
def _(t):
    return _listings(t)[1]


# Digest trees: two states of the parts --------------------------------------------------------------------------------
TREE = """r AS (SELECT p_partkey, substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 4) AS b, p_size + CASE WHEN p_partkey % 97 = 3 THEN 1 ELSE 0 END AS new, p_size, p_brand FROM part),
d AS (SELECT b, sha256('{"p_partkey":' || p_partkey || ',"p_size":' || p_size || ',"p_brand":"' || p_brand || '"}') AS old, sha256('{"p_partkey":' || p_partkey || ',"p_size":' || new || ',"p_brand":"' || p_brand || '"}') AS new, p_partkey FROM r),
l AS (SELECT b AS prefix, count(*) AS rows, sha256(string_agg(old, '' ORDER BY old)) AS digest, sha256(string_agg(new, '' ORDER BY new) FILTER (p_partkey % 89 <> 5)) AS now FROM d GROUP BY 1),
n AS (SELECT substr(prefix, 1, 2) AS prefix, CAST(sum(rows) AS BIGINT) AS rows, sha256(string_agg(digest, '' ORDER BY prefix)) AS digest FROM l GROUP BY 1)"""


def _part_states(t):
    before = t("part").select("p_partkey", "p_size", "p_brand")
    size = F.when(F.col("p_partkey") % 97 == 3, F.col("p_size") + 1).otherwise(F.col("p_size"))
    return before, before.where("p_partkey % 89 <> 5").withColumn("p_size", size)


@query("j26_digest_tree", f"WITH {TREE} SELECT prefix, rows, digest FROM l UNION ALL SELECT * FROM n UNION ALL SELECT '' AS prefix, CAST(sum(rows) AS BIGINT) AS rows, sha256(string_agg(digest, '' ORDER BY prefix)) AS digest FROM n")
def _(t):
    leaves, nodes, root = joins.digest_tree(_part_states(t)[0], "p_partkey", ["p_size", "p_brand"], 4)
    return leaves.unionByName(nodes).unionByName(root)


@query("j26_changed_leaves", f"WITH {TREE} SELECT prefix FROM l WHERE digest IS DISTINCT FROM now")
def _(t):
    return joins.changed_leaves(*_part_states(t), "p_partkey", ["p_size", "p_brand"], 4)


@query("j26_changes_in_leaves", "SELECT p_partkey, CASE WHEN p_partkey % 89 = 5 THEN 'removed' ELSE 'changed' END AS change FROM part WHERE p_partkey % 89 = 5 OR p_partkey % 97 = 3")
def _(t):
    return joins.changes_in_leaves(*_part_states(t), "p_partkey", ["p_size", "p_brand"], 4)


# Consensus by the rule itself: two control blocks of 16 positions, 16 matches ------------------------------------------------
W17 = """u AS (SELECT o_custkey // 40 AS item, (o_custkey % 40) * 4 + n % 4 AS pos, n // 4 % 2 AS source, o_orderkey % 153 > 0 AS good, CASE WHEN o_orderkey % 301 = 0 THEN 'x' WHEN o_orderkey % 307 = 0 THEN NULL ELSE 'y' END AS payload
           FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders)),
p AS (SELECT item, pos, count(*) FILTER (good) AS copies, count(DISTINCT coalesce(payload, '-')) FILTER (good) > 1 AS clash, list_sort(list_distinct(list(source) FILTER (good))) AS sources FROM u GROUP BY 1, 2),
f AS (SELECT item, min(source) AS first FROM u GROUP BY 1),
g AS (SELECT item, pos, any_value(coalesce(payload, '-')) AS base FROM u JOIN f USING (item) WHERE source = first AND good GROUP BY 1, 2),
k AS (SELECT item, pos // 16 AS block, row_number() OVER (PARTITION BY item ORDER BY pos // 16) AS nth FROM g GROUP BY 1, 2 HAVING count(*) = 16),
c AS (SELECT g.item, pos, base FROM g JOIN k ON g.item = k.item AND g.pos // 16 = k.block AND nth <= 2),
m AS (SELECT item, source, count(*) AS n FROM u JOIN c USING (item, pos) WHERE good AND coalesce(payload, '-') = base GROUP BY 1, 2),
x AS (SELECT item, 'identity' AS reason FROM (SELECT DISTINCT item, source FROM u) s JOIN f USING (item) LEFT JOIN m USING (item, source) WHERE source <> first AND coalesce(n, 0) < 16
      UNION ALL SELECT item, 'control_conflict' AS reason FROM c JOIN p USING (item, pos) WHERE clash),
y AS (SELECT item, max(reason) AS reason FROM x GROUP BY 1)"""


def _sixteen(t):
    n = F.row_number().over(windows.Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    o = t("orders").select("o_custkey", "o_orderkey", n.alias("n"))
    key = F.col("o_orderkey")
    payload = F.when(key % 301 == 0, "x").when(key % 307 == 0, F.lit(None)).otherwise("y")
    u = o.select(F.floor(F.col("o_custkey") / 40).alias("item"), (F.col("o_custkey") % 40 * 4 + F.col("n") % 4).alias("pos"), (F.floor(F.col("n") / 4) % 2).alias("source"), (key % 153 > 0).alias("good"), payload.alias("payload"))
    return windows.consensus_of_one_item(u, "item", "pos", "source", "good", "payload", 16)


@query("w17_sixteen_matches", f"WITH {W17} SELECT item, pos, copies, CASE WHEN copies = 0 THEN 'unreadable' WHEN clash THEN 'conflict' WHEN copies > 1 THEN 'corroborated' ELSE 'single' END AS state, coalesce(array_to_string(sources, ','), '') AS sources FROM p WHERE item NOT IN (SELECT item FROM y)")
def _(t):
    return _sixteen(t)[0].withColumn("sources", F.array_join("sources", ","))


@query("w17_sixteen_refused", f"WITH {W17} SELECT * FROM y")
def _(t):
    return _sixteen(t)[1]


# Generations: every document is in up to four recoveries of its item; some lose it, find it by signature or name it ----------------------
CHOICE = """f0 AS (SELECT doc_id // 12 AS item, unnest([1, 2, 3, 4]) AS g, doc_id AS d, sha256(text) AS sha, strlen(text) AS bytes FROM documents),
f AS (SELECT item, g, {'s': sha, 'n': bytes} AS key, bytes, d % 29 <> 0 AS counted, NOT (d % 7 = 0 AND g < 3) AS reach, d % 5 < g AND d % 31 > g AS named FROM f0 WHERE d % 61 <> g AND (g < 4 OR item % 5 > 0)),
x AS (SELECT DISTINCT item FROM f WHERE item % 17 = 3 AND g = 2),
b AS (SELECT item, g, key, count(*) AS n, count(*) FILTER (reach) AS r FROM f WHERE counted GROUP BY ALL),
t AS (SELECT item, g, count(*) FILTER (counted) AS files, coalesce(CAST(sum(bytes) FILTER (counted) AS BIGINT), 0) AS bytes, count(*) FILTER (counted AND reach) AS reachable, count(*) FILTER (counted AND named) AS names,
      row_number() OVER (PARTITION BY item ORDER BY g) AS step FROM f WHERE item NOT IN (SELECT item FROM x) GROUP BY item, g),
p AS (SELECT o.item, o.step AS old, n.step AS new, n.names >= o.names AND NOT EXISTS (SELECT 1 FROM b WHERE b.item = o.item AND b.g = o.g AND NOT EXISTS (SELECT 1 FROM b AS c WHERE c.item = n.item AND c.g = n.g AND c.key = b.key AND c.n >= b.n AND c.r >= b.r)) AS ok
      FROM t AS o JOIN t AS n ON o.item = n.item AND n.step > o.step),
c AS (SELECT item, step, step AS chosen, CAST(NULL AS BIGINT) AS before, TRUE AS ok FROM t WHERE step = 1
      UNION ALL SELECT c.item, p.new AS step, CASE WHEN p.ok THEN p.new ELSE c.chosen END AS chosen, c.chosen AS before, p.ok FROM c JOIN p ON p.item = c.item AND p.old = c.chosen AND p.new = c.step + 1)"""


def _choice(t):
    d, g = F.col("doc_id"), F.col("g")
    f = t("documents").select("doc_id", F.floor(d / 12).alias("item"), F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("bytes"), F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("g"))
    f = f.where((d % 61 != g) & ((g < 4) | (F.col("item") % 5 > 0)))
    folder = F.when(d % 29 == 0, "System Volume Information\\x").when((d % 7 == 0) & (g < 3), "DirectoryRecovery/").otherwise("docs/")
    image = F.when((F.col("item") % 17 == 3) & (g == 2), "other").otherwise("image")
    f = f.withColumns({"path": F.concat(folder, d.cast("string")), "image": image, "named": (d % 5 < g) & (d % 31 > g)})
    return generations.generation_choice(f, "item", "g", "image", "path", "sha", "bytes", F.col("named"))


@query("w15_generation_choice", f"""WITH RECURSIVE {CHOICE}
SELECT t.item, t.g AS generation, CASE WHEN c.ok THEN 'promoted' ELSE 'alternate' END AS state,
  CASE WHEN NOT c.ok THEN 'loses' WHEN before IS NULL THEN 'first' WHEN t.files > o.files THEN 'more' WHEN t.names > o.names THEN 'names' ELSE 'newer' END AS reason, t.files, t.bytes, t.reachable, t.names
FROM c JOIN t USING (item, step) LEFT JOIN t AS o ON o.item = c.item AND o.step = c.before""")
def _(t):
    return _choice(t)[0]


@query("w15_refused_items", f"WITH {CHOICE.split('b AS (SELECT item, g, key')[0].rstrip().rstrip(',')} SELECT item, 'different_images' AS reason FROM x")
def _(t):
    return _choice(t)[1]


# Audit: customers as items, their orders as recovered files ---------------------------------------------------------------
AUDIT = """o AS (SELECT o_custkey AS item, count(*) AS files, CAST(sum(o_orderkey) AS BIGINT) AS bytes, count(*) FILTER (o_orderstatus = 'P') AS issues FROM orders GROUP BY 1),
a AS (SELECT c_custkey AS item, CASE c_custkey % 5 WHEN 0 THEN 'DERIVED' WHEN 1 THEN 'PARTIAL' ELSE 'OK' END AS status, CASE WHEN c_custkey % 5 = 1 THEN 3 ELSE 0 END AS bad, c_custkey % 41 = 0 AS unread, c_custkey % 37 > 0 AS recorded, c_custkey % 29 = 0 AS legacy,
      c_custkey % 5 = 1 OR c_custkey % 43 = 0 OR c_custkey % 10 = 0 AS attention, c_custkey % 86 = 0 AS custody, c_custkey % 31 > 0 AS has_image, c_custkey % 23 > 0 AS readable, c_custkey % 19 = 0 AND c_custkey % 37 > 0 AS other, c_custkey % 58 = 0 AS short,
      CASE WHEN c_custkey % 13 = 0 THEN 'manual' WHEN c_custkey % 17 = 0 THEN 'invalid' WHEN o.item IS NOT NULL THEN 'automatic' END AS kind, c_custkey % 16 > 0 AS checked, c_custkey % 14 = 0 AS native, coalesce(files, 0) AS files, coalesce(bytes, 0) AS bytes, issues, c_nationkey % 6 > 0 AND o.item IS NOT NULL AS converted
      FROM customer LEFT JOIN o ON c_custkey = item),
s AS (SELECT *, CASE WHEN NOT has_image THEN 'image_missing' WHEN NOT readable THEN 'image_unreadable' WHEN recorded AND other THEN 'image_hash_differs' END AS stop FROM a),
e AS (SELECT *, stop IS NULL AND recorded AS hashed, kind = 'automatic' AND checked AND stop IS NULL AS files_ok, stop IS NULL AND coalesce(kind = 'automatic' AND native, FALSE) AS attn,
      CASE WHEN stop IS NOT NULL OR kind IS NULL THEN 'MISSING' WHEN kind = 'manual' THEN 'MANUAL_UNVERIFIED' WHEN kind = 'automatic' AND checked THEN CASE WHEN native THEN 'PARTIAL_VERIFIED_FILES' ELSE 'VERIFIED' END ELSE 'INVALID' END AS ex,
      CASE WHEN stop IS NOT NULL THEN 'NOT_RUN' WHEN NOT converted THEN 'NO_CANDIDATES' WHEN issues = 0 THEN 'VERIFIED' ELSE 'CHECK' END AS conv FROM s),
f AS (SELECT *, CASE WHEN ex IN ('VERIFIED', 'PARTIAL_VERIFIED_FILES', 'MANUAL_UNVERIFIED') THEN files ELSE 0 END AS n, list_filter(CASE WHEN stop IS NOT NULL THEN [stop] ELSE [CASE WHEN legacy AND short THEN 'extent_differs' END, CASE WHEN legacy AND item % 3 = 0 THEN 'log_hash_differs' END,
      CASE WHEN unread THEN 'unread_positions' END, CASE ex WHEN 'INVALID' THEN 'extraction_invalid' WHEN 'MANUAL_UNVERIFIED' THEN 'manual_recovery' WHEN 'MISSING' THEN 'no_extraction' END, CASE WHEN conv = 'CHECK' THEN 'conversion_issues' END] END, lambda x: x IS NOT NULL) AS found FROM e),
g AS (SELECT *, hashed AND len(found) = 0 AND NOT attention AND NOT attn AND coalesce(files_ok, FALSE) AND n > 0 AS proven, stop IS NULL AND NOT legacy AND attention AND custody AS cust, stop IS NULL AND NOT legacy AND attention AND status = 'OK' AND bad = 0 AS crossed FROM f),
r AS (SELECT item, hashed AS image_hash_verified, ex AS extraction_status, n AS extracted_files, CASE WHEN ex IN ('VERIFIED', 'PARTIAL_VERIFIED_FILES', 'MANUAL_UNVERIFIED') THEN bytes ELSE 0 END AS extracted_bytes, conv AS conversion_status,
      CASE WHEN stop IS NULL AND converted THEN files ELSE 0 END AS conversion_jobs, CASE WHEN stop IS NULL AND converted THEN files - issues ELSE 0 END AS outputs_verified,
      CASE WHEN cust THEN 'OPERATOR_CUSTODY_ONLY' WHEN crossed THEN 'CONFIRMED_CROSS_READER_CONFLICTS' WHEN stop IS NOT NULL THEN 'CHECK' WHEN proven THEN 'IMAGE_FILES_CONVERSIONS_VERIFIED' WHEN attention OR attn THEN CASE WHEN status = 'DERIVED' THEN 'DERIVED_RECOVERY' ELSE 'PARTIAL_IMAGE_READ' END
           WHEN len(found) = 0 AND (n = 0 OR NOT hashed) THEN 'CHECK' WHEN conv = 'CHECK' THEN 'CHECK_CONVERSION' ELSE 'CHECK' END AS evidence_status,
      concat_ws(';', CASE WHEN len(found) > 0 THEN array_to_string(found, ';') END, CASE WHEN stop IS NOT NULL OR proven OR len(found) > 0 THEN NULL WHEN attention OR attn THEN 'unresolved_positions' WHEN n = 0 THEN 'no_recovered_files' WHEN NOT hashed THEN 'no_recorded_hash' END,
           CASE WHEN cust THEN 'custody_only' WHEN crossed THEN 'reader_conflicts' END) AS issues FROM g)"""


def _audited(t):
    k = F.col("c_custkey")
    text = k.cast("string")
    orders = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("b"), F.count_if(F.col("o_orderstatus") == "P").alias("partial"))
    c = t("customer").select("c_custkey", "c_nationkey").join(orders, "c_custkey", "left")
    status = F.when(k % 5 == 0, "DERIVED").when(k % 5 == 1, "PARTIAL").otherwise("OK")
    attempts = c.select(
        k.alias("item"), status.alias("status"), F.when(k % 5 == 1, 3).otherwise(0).alias("bad"), F.when(k % 41 == 0, 2).alias("unread"), F.when(k % 37 > 0, F.upper(F.sha2(text, 256))).alias("sha"), (k % 29 == 0).alias("legacy"),
        ((k % 5 == 1) | (k % 43 == 0) | (k % 10 == 0)).alias("attention"), (k % 86 == 0).alias("custody"), F.when(k % 3 == 0, "x").alias("log_sha"), F.when(k % 58 == 0, 1).otherwise(512).alias("expected_bytes"),
    )
    images = c.where(k % 31 > 0).select(k.alias("item"), F.when(k % 23 > 0, F.sha2(F.when((k % 19 == 0) & (k % 37 > 0), "other").otherwise(text), 256)).alias("sha"), F.lit(512).alias("bytes"))
    kind = F.when(k % 13 == 0, "manual").when(k % 17 == 0, "invalid").when(F.col("n").isNotNull(), "automatic")
    extractions = c.where(kind.isNotNull()).select(k.alias("item"), kind.alias("kind"), (k % 16 > 0).alias("verified"), F.col("n").alias("files"), F.col("b").alias("bytes"), (k % 14 == 0).alias("attention"))
    conversions = c.where((F.col("c_nationkey") % 6 > 0) & F.col("n").isNotNull()).select(k.alias("item"), F.col("n").alias("jobs"), (F.col("n") - F.col("partial")).alias("verified"), F.col("partial").alias("issues"))
    return audit.audit_items(attempts, images, extractions, conversions)


@query("agg16_evidence", f"WITH {AUDIT} SELECT * FROM r")
def _(t):
    return _audited(t).withColumn("issues", F.array_join("issues", ";"))


@query("agg16_totals", f"WITH {AUDIT} SELECT count(*) AS items, count(*) FILTER (evidence_status = 'IMAGE_FILES_CONVERSIONS_VERIFIED') AS verified, count(*) FILTER (evidence_status <> 'IMAGE_FILES_CONVERSIONS_VERIFIED') AS attention FROM r")
def _(t):
    return audit.audit_totals(_audited(t))


# Roll-up: the orders of a customer are attempts, cents of their price the damage ------------------------------------------------
ROLLUP = """o AS (SELECT o_custkey, o_orderkey, o_orderstatus <> 'F' AS attention, CAST(floor(o_totalprice) AS BIGINT) % 500 AS bad, o_orderkey % 2880 AS total, o_orderkey % 53 = 0 AS preferred FROM orders),
b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY preferred DESC, attention, bad, o_orderkey DESC) = 1),
i AS (SELECT o_custkey, count(*) AS attempts, max(o.o_orderkey) AS latest_attempt, arg_max(o.bad, o.o_orderkey) AS latest_bad, any_value(b.o_orderkey) AS best_attempt, any_value(b.bad) AS best_bad, any_value(b.attention) AS attention, any_value(b.total) AS total FROM o JOIN b USING (o_custkey) GROUP BY 1)"""


def _summaries(t):
    key = F.col("o_orderkey")
    o = t("orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") != "F").alias("attention"), (F.floor("o_totalprice") % 500).alias("bad"), (key % 2880).alias("total"), (key % 53 == 0).alias("preferred"))
    return aggregates.item_summaries(o, "o_custkey", "o_orderkey", "attention", "bad", "total", "preferred")


@query("agg1_items", f"WITH {ROLLUP} SELECT * FROM i")
def _(t):
    return _summaries(t)


@query("agg1_project", f"WITH {ROLLUP} SELECT count(*) AS items, CAST(sum(attempts) AS BIGINT) AS attempts, count(*) FILTER (NOT attention) AS ok, count(*) FILTER (attention) AS partial, CAST(sum(latest_bad) AS BIGINT) AS latest_bad, CAST(sum(best_bad) AS BIGINT) AS best_bad FROM i")
def _(t):
    return aggregates.project_rollup(_summaries(t))

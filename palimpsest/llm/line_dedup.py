"""Line deduplication with a suffix array over line IDs, in DataFrame operations only.

* The alphabet is the lines, known by two 64-bit hashes.  Every line of every document starts
  a suffix of its document's line sequence.
* `suffix_array`: prefix doubling.  A suffix's rank by its first h lines is the first place of
  its group in the order of all suffixes; a round splits the groups by the ranks h lines on, and
  puts the parts in order by counting.  From h = 2 on a round doubles twice, by the ranks h, 2 h
  and 3 h lines on.  A suffix leaves when its rank is its own or when it ends
  inside its group; rounds go on until all have left.  Documents without open suffixes drop out,
  so a round works on what is still repeated.
* `common_prefixes`: the longest common prefix of each group of equal suffixes with the group
  before it, by descending through the rounds' ranks: h lines more are common if the ranks by
  h lines are equal there.  Deletion asks only whether it reaches `min_lines`, and so descends
  from there.
* `intervals`: stretches of the array in which neighbours have at least so many lines in common,
  as running counts.  All suffixes of an interval start with the same lines.  Every member but
  the first (by doc_id and place) is a later copy; chained members are one maximal repeated run,
  and its lines are deleted.

A run counts from `min_lines` lines; given `min_chars`, also from that many characters (white
space aside) in however few lines.  A suffix's first lines fix how many lines count as a run
(`least`, at most `min_lines`), so the intervals of `least` to `min_lines` lines decide; a longer
run is the chain of these.  Repeated runs with fewer lines and fewer characters stay.

Groups only meet in sums (with partial sums before the shuffle), in joins that Spark may split,
and in sorts by range, whose parts' sums (one row a partition) are added up on the driver; so a
line that a third of all documents share is no hot task.

Defined results: null text has no lines and stays null; empty text is one empty line; the
documents' order is doc_id, nulls first, then the text's hash; identical rows count once
and get the same result; a document of any number of lines is one sequence; other columns are
kept as they are, whatever their names, in `row`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import materialise, table

#: Least lines of a repeated run.
MIN_LINES = 3
#: Least characters of a repeated run of fewer lines (about five words), where characters count.
MIN_CHARS = 25

_KEY = ["dd_doc", "dd_text"]
_SUFFIX = [*_KEY, "pos", "left", "least"]


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents' key beside their rows, whose own columns may have any names."""
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    return docs.select(number.alias("dd_doc"), F.xxhash64("text").alias("dd_text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def line_ids(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int | None = None) -> DataFrame:
    """(document key, pos, left, least, line, line2): one row per line of each distinct document: lines from here on, how many of them count as a run, and the line's hashes."""
    lines = F.split("row.text", "\n")
    keyed = _keyed(docs.select("doc_id", "text")).where("row.text is not null")
    size = F.lit(0) if min_chars is None else lambda x: F.char_length(F.translate(x, " \t\n\x0b\x0c\r", ""))
    ids = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("line"), F.xxhash64(x, F.lit(7)).alias("line2"), (size if min_chars is None else size(x)).alias("size")))
    each = keyed.select(*_KEY, ids.alias("ids")).dropDuplicates(_KEY).select(*_KEY, F.size("ids").alias("n"), F.posexplode("ids").alias("pos", "of"))
    each = each.select(*_KEY, "pos", (F.col("n") - F.col("pos")).alias("left"), "of.*")
    order = Window.partitionBy(*_KEY).orderBy("pos")  # as the documents were made distinct: no exchange
    from_here = (F.when(F.sum("size").over(order.rowsBetween(0, n - 1)) >= min_chars, n) for n in range(1, min_lines)) if min_chars is not None else ()
    return each.withColumn("least", F.coalesce(*from_here, F.lit(min_lines))).drop("size")


def _in_order(df: DataFrame, by: list[str], **sums: str) -> tuple[DataFrame, list]:
    """The rows dealt into ranges of `by` (`part`), and of each range its first and last value of by[0], sums, and the last value's share of them."""
    dealt = materialise(df.repartitionByRange(*by).withColumn("part", F.spark_partition_id()))
    each = dealt.groupBy("part", F.col(by[0]).alias("of")).agg(*(F.sum(F.expr(v)).alias(k) for k, v in sums.items()))
    parts = each.groupBy("part").agg(F.min("of").alias("first"), F.max("of").alias("last"), *(F.sum(k).alias(k) for k in sums), *(F.max_by(k, "of").alias(f"last_{k}") for k in sums))
    return dealt, parts.orderBy("part").collect()  # one row a partition


def _places(rows: DataFrame, by: list[str], open_: str) -> tuple[DataFrame, int]:
    """(by, place, n): for each group its first place in order, and its size; and how many groups are open.  by[0] is `rank`, the place of the group that it is part of."""
    dealt, parts = _in_order(rows.groupBy(*by).agg(F.count("*").alias("n")), by, n="n", open=f"cast({open_} as long)")
    spark, begun, last, start, carried = rows.sparkSession, 0, None, 0, []
    for p in parts:
        carry = start if p.first == last else begun
        carried.append((p.part, begun, p.first, carry))
        start = carry if p.first == p.last else begun + p.n - p.last_n
        last, begun = p.last, begun + p.n
    offsets = F.broadcast(spark.createDataFrame(carried, "part int, begun long, first long, carry long"))
    order = Window.partitionBy("part").orderBy(*by)
    before = F.col("begun") + F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = dealt.join(offsets, "part").withColumn("before", before)
    own = F.min("before").over(Window.partitionBy("part", "rank"))
    place = F.col("rank") + F.col("before") - F.when(F.col("rank") == F.col("first"), F.col("carry")).otherwise(own)
    return numbered.select(*by, place.alias("place"), "n"), sum(p["open"] for p in parts)


def suffix_array(lines: DataFrame) -> tuple[DataFrame, list[tuple[int, DataFrame]]]:
    """The suffixes whose first line is repeated, each with its rank (place in the array, equal for equal suffixes) and the size n of its group; and by h, ascending, the ranks by the first h lines of suffixes that share these."""
    columns = [*_SUFFIX, "rank", "n", "open", "since"]
    lines = materialise(lines.withColumn("rank", F.lit(0).cast("long")))
    by = ["rank", "line", "line2"]
    places, groups = _places(lines, by, "n > 1")
    first = lines.join(places, by).withColumns({"rank": F.col("place"), "open": F.col("n") > 1, "since": F.lit(1)})
    rows, h, levels, left = materialise(first.select(columns)), 1, [], []
    while True:
        levels.append((h, rows.where(f"n > 1 and left >= {h}").select(*_KEY, "pos", "rank")))
        if not groups:
            break
        document, times = Window.partitionBy(*_KEY), 2 if h == 1 else 4
        onward = {f"next{k}": F.first("rank").over(document.orderBy("pos").rangeBetween(k * h, k * h)) for k in range(1, times)}
        busy = materialise(rows.withColumns({"busy": F.max("open").over(document), **onward}).where("busy").drop("busy"))
        split, by, goes_on = busy.where("open").fillna(-1, [*onward]), ["rank", *onward], f"n > 1 and next{times - 1} >= 0"
        places, groups = _places(split, by, goes_on)
        h *= times
        moved = split.drop("n").join(places, by).withColumns({"rank": F.col("place"), "open": F.expr(goes_on), "since": F.lit(h)})
        rows = materialise(busy.where("not open").select(columns).union(moved.select(columns)))
        left.append(rows.where(f"not open and since = {h}").select(*_SUFFIX, "rank", "n"))
    array = left[0] if left else rows.where("false").select(*_SUFFIX, "rank", "n")
    for part in left[1:]:
        array = array.union(part)
    return array, levels


def common_prefixes(array: DataFrame, levels: list[tuple[int, DataFrame]], most: int | None = None) -> DataFrame:
    """(rank, n, lcp): each group of equal suffixes, and how many lines it has in common with the group before it in the array; with `most`, counted that far at least."""
    groups = materialise(array.groupBy("rank").agg(F.first("n").alias("n"), F.min(F.struct(*_KEY, "pos")).alias("at")))
    before = groups.select((F.col("rank") + F.col("n")).alias("rank"), F.col("at").alias("other"))
    pairs = groups.join(before, "rank").select("rank", *(F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in ("at", "other") for c in (*_KEY, "pos")), F.lit(0).alias("lcp"))
    above = [h for h, _ in levels[1:]] + [2 * levels[-1][0]]
    for (h, level), next_h in reversed(list(zip(levels, above))):
        for _ in range(min(next_h // h - 1, most // h if most else next_h)):
            for x in ("at", "other"):
                here = level.select(*(F.col(c).alias(f"{x}_{c}") for c in _KEY), F.col("pos").alias(f"{x}_place"), F.col("rank").alias(f"{x}_rank"))
                pairs = pairs.withColumn(f"{x}_place", F.col(f"{x}_pos") + F.col("lcp")).join(here, [*(f"{x}_{c}" for c in _KEY), f"{x}_place"], "left").drop(f"{x}_place")
            more = F.when(F.col("at_rank") == F.col("other_rank"), h).otherwise(0)
            pairs = pairs.withColumn("lcp", F.col("lcp") + more).drop("at_rank", "other_rank")
        pairs = pairs if most else materialise(pairs)
    return groups.select("rank", "n").join(pairs.select("rank", "lcp"), "rank", "left").withColumn("lcp", F.coalesce("lcp", F.lit(0)))


def intervals(prefixes: DataFrame, most: int) -> DataFrame:
    """(rank, interval_1, ..., interval_most): the number of the stretch of the array with at least so many lines in common that each group is in."""
    wanted = range(1, most + 1)
    dealt, parts = _in_order(prefixes, ["rank"], **{f"s{m}": f"cast(lcp < {m} as long)" for m in wanted})
    begun, carried = [0] * most, []
    for p in parts:
        carried.append((p.part, *begun))
        begun = [b + p[f"s{m}"] for b, m in zip(begun, wanted)]
    offsets = F.broadcast(prefixes.sparkSession.createDataFrame(carried, "part int, " + ", ".join(f"b{m} long" for m in wanted)))
    order = Window.partitionBy("part").orderBy("rank")
    return materialise(dealt.join(offsets, "part").select("rank", *((F.col(f"b{m}") + F.sum(F.expr(f"cast(lcp < {m} as long)")).over(order)).alias(f"interval_{m}") for m in wanted)))


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int | None = None) -> DataFrame:
    """(document key, dd_runs): maximal runs [first, end) of lines that are later copies."""
    array, levels = suffix_array(line_ids(docs, min_lines, min_chars))
    found = array.withColumn("m", F.explode(F.sequence("least", F.lit(min_lines)))).where("left >= m").join(intervals(common_prefixes(array, levels, min_lines), min_lines), "rank")
    own = F.element_at(F.array(*(f"interval_{m}" for m in range(1, min_lines + 1))), F.col("m"))
    found = materialise(found.select(*_KEY, "pos", "m", own.alias("interval")))
    first = materialise(found.groupBy("m", "interval").agg(F.min(F.struct(*_KEY, "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    later = found.join(first, ["m", "interval"]).where(F.struct(*_KEY, "pos") > F.col("first"))
    later = later.groupBy(*_KEY, "pos").agg((F.col("pos") + F.max("m")).alias("end"))
    order = Window.partitionBy(*_KEY).orderBy("pos")
    before = F.max("end").over(order.rangeBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce((F.col("pos") > before).cast("int"), F.lit(1))
    runs = later.withColumn("opens", opens).withColumn("run", F.sum("opens").over(order)).groupBy(*_KEY, "run").agg(F.min("pos").alias("first"), F.max("end").alias("end"))
    return runs.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("first", "end"))).alias("dd_runs"))


def deduplicated(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int | None = None) -> DataFrame:
    """Every row as a struct `row`, its text without later copies, and n_lines, n_removed, n_runs."""
    runs = repeated_runs(docs, min_lines, min_chars)
    lines = F.split("row.text", "\n")
    outside = lambda x, i: ~F.exists("dd_runs", lambda r: (r["first"] <= i) & (i < r["end"]))
    kept = F.when(F.col("dd_runs").isNull(), lines).otherwise(F.filter(lines, outside))
    out = _keyed(docs).join(runs.hint("shuffle_hash"), _KEY, "left").select("row", kept.alias("kept"), F.size(lines).alias("lines"), F.col("dd_runs").alias("runs"))
    some = lambda n, known: F.when(known.isNull(), 0).otherwise(n).cast("long")
    return out.select(
        F.col("row").withField("text", F.array_join("kept", "\n")).alias("row"),
        some(F.col("lines"), F.col("row.text")).alias("n_lines"),
        some(F.col("lines") - F.size("kept"), F.col("row.text")).alias("n_removed"),
        some(F.size("runs"), F.col("runs")).alias("n_runs"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=MIN_CHARS)
    return out.select("row.doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("row.text", F.lit("")), 256).alias("kept_sha256"))


#: The same rows by windows: from each line on, its first lines that count as a run (one or two with 25 characters, or three) up to three; a window that also starts earlier goes.
ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, ls, list_transform(ls, lambda x: length(regexp_replace(x, '[ \t\n\x0b\f\r]', '', 'g'))) AS cs FROM d),
l AS (SELECT doc_id, len(ls) AS n, p, ls[p] AS a, ls[p:p + 2] AS window3, CASE WHEN cs[p] >= 25 THEN 1 WHEN cs[p] + cs[p + 1] >= 25 THEN 2 ELSE 3 END AS least FROM e, UNNEST(range(1, len(ls) + 1)) AS t(p)),
w AS (SELECT doc_id, p, k, row_number() OVER (PARTITION BY k, window3[1:k] ORDER BY doc_id, p) > 1 AS later FROM l, (SELECT unnest([1, 2, 3]) AS k) WHERE k >= least AND p + k - 1 <= n),
g AS (SELECT DISTINCT doc_id, p + q AS p FROM w, UNNEST(range(0, k)) AS t(q) WHERE later),
f AS (SELECT l.doc_id, l.p, l.a, g.p IS NOT NULL AS gone FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.p = l.p),
h AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM f)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_removed, (count(*) FILTER (opens))::BIGINT AS n_runs,
  sha256(coalesce(string_agg(a, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM h GROUP BY doc_id
"""

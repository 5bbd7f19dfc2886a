"""Repeated lines, equal or within an edit distance, by segment partition.

Distinct lines are cut into one segment more than the threshold. Two lines
within the threshold share a segment, at places that differ little; so each
line's segments are indexed by length, number and text, and every line probes
with its substrings at the places that the length difference allows. Pairs
that meet are sifted by their letter counts and verified by a banded
bit-parallel edit distance: one column of the table at a time, the band's
vertical differences in the bits of two integers. Verified pairs make groups
(connected components); the first occurrence of a group stays.

A segment shared by more lines than ``HOT`` is joined on a finer key: lines
that differ by at most one edit outside a shared segment agree in some
variant of the line with at most one character left out.

Everything is DataFrame expressions. Distinct lines are written once, bucketed
by their digest, so that later joins on it move no text.

Defined results: lines end at a newline; lines of fewer than ``LEAST``
characters are never repeats and always stay; a null text is an empty one. The
first occurrence is the one with the smallest id (nulls last), then by a hash
of the text, then the smallest line number; rows equal in id and text are one
document, whose lines go or stay alike. An empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import plain
from quadrille.operators.traverse import components
from quadrille.session import materialise, scratch_path

THRESHOLD = 1
LEAST = 20
# Lines that may share a key before it is refined.
HOT = 512
# Letters whose counts sift pairs, eight bits each in one long; more of them sift finer and cost a pass over each line.
LETTERS = "etaoni"


def counts(line: str) -> Column:
    """The counts of the letters, modulo 256, in one long."""
    out = F.lit(0).cast("long")
    for i, letter in enumerate(LETTERS):
        n = (F.length(line) - F.length(F.replace(F.col(line), F.lit(letter), F.lit("")))).cast("long")
        out = out.bitwiseOR(F.shiftleft(n.bitwiseAND(F.lit(255)), 8 * i))
    return out


def counts_apart(a: str, b: str) -> Column:
    """A lower bound of twice the edit distance from two letter counts."""
    out = F.lit(0)
    for i in range(len(LETTERS)):
        byte = lambda c: F.shiftrightunsigned(c, 8 * i).bitwiseAND(F.lit(255))
        d = F.abs(byte(a) - byte(b))
        out = out + F.least(d, 256 - d)
    return out


def _segment(length: Column, number: int, parts: int) -> tuple[Column, Column]:
    """Place (from 1) and length of a segment of a line: floors first, then ceilings."""
    floor, rest = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    place = 1 + number * floor + F.greatest(F.lit(0), number - (parts - rest))
    return place, floor + F.when(F.lit(number) >= parts - rest, 1).otherwise(0)


def segment_keys(line: str, n: Column, threshold: int) -> Column:
    """Index keys: array<struct<key, at, size>>, one per segment."""
    parts, out = threshold + 1, []
    for i in range(parts):
        at, size = _segment(n, i, parts)
        out.append(F.struct(F.xxhash64(n, F.lit(i), F.substring(F.col(line), at, size)).alias("key"), at.alias("at"), size.alias("size")))
    return F.array(*out)


def probe_keys(line: str, n: Column, threshold: int) -> Column:
    """Keys of all substrings that a line of equal or smaller length can share as a segment."""
    parts, out = threshold + 1, []
    for shorter in range(threshold + 1):
        length = n - shorter
        for i in range(parts):
            at, size = _segment(length, i, parts)
            # From the left i edits at most may lie before the segment, from the right the others behind it.
            low, high = max(-i, shorter - (threshold - i)), min(i, shorter + (threshold - i))
            for shift in range(low, high + 1):
                place = at + shift
                valid = (length >= parts) & (place >= 1) & (place + size - 1 <= n)
                out.append(F.when(valid, F.struct(F.xxhash64(length, F.lit(i), F.substring(F.col(line), place, size)).alias("key"),
                                                  place.alias("at"), size.alias("size"))))
    return F.array_compact(F.array(*out))


def within(a: str, b: str, threshold: int) -> Column:
    """Whether two lines are within the edit distance, by a banded bit-parallel table.

    The band of column j holds the rows j - threshold to j + threshold, lowest
    bit first. The distance is followed along the band's last row until that is
    the last row of the table, and along the table's last row from there.
    """
    width = 2 * threshold + 1
    mask = (1 << width) - 1
    equal = " | ".join(f"if(coalesce(get(x.p, j - {threshold - bit} - 1) = x.t[j - 1], false), {1 << bit}, 0)" for bit in range(width))
    # d: vertical positive, v: vertical negative, z: zero diagonal, h/k: horizontal positive and negative.
    expression = f"""
      abs(length({a}) - length({b})) <= {threshold} and
      aggregate(array(struct(split({a}, '') as p, split({b}, '') as t, length({a}) as m, length({b}) as n)), {threshold + 1}, (none, x) ->
        aggregate(sequence(1, x.n), struct({(mask << threshold) & mask} as vp, 0 as vn, {threshold} as d),
          (s, j) -> aggregate(array({equal}), s, (o, eq) ->
            aggregate(array((((((eq & o.vp) + o.vp) ^ o.vp) | eq | o.vn) & {mask})), o, (q, z) ->
              aggregate(array(struct((q.vn | ({mask} ^ ((z | q.vp) & {mask}))) as hp, (z & q.vp) as hn)), q, (w, h) -> struct(
                (h.hn | ({mask} ^ ((shiftrightunsigned(z, 1) | h.hp) & {mask}))) as vp,
                (shiftrightunsigned(z, 1) & h.hp) as vn,
                w.d + case when j <= x.m - {threshold} then if((z & {1 << (width - 1)}) = 0, 1, 0)
                      else if((shiftrightunsigned(h.hp, x.m - j + {threshold}) & 1) = 1, 1, 0)
                           - if((shiftrightunsigned(h.hn, x.m - j + {threshold}) & 1) = 1, 1, 0) end as d)))),
          s -> s.d)) <= {threshold}"""
    return F.expr(expression)


def _distinct_lines(docs: DataFrame, text: str, id_column: str, least: int) -> DataFrame:
    """(id, line, first, n, size, letters): digest, text, first occurrence and number of occurrences, length and letter counts of each distinct line."""
    spark = docs.sparkSession
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "line_no")
    own = (_occurrences(docs, text, id_column, least).groupBy("id")
           .agg(F.first("line").alias("line"), F.min(at).alias("first"), F.count("*").alias("n"))
           .withColumns({"size": F.length("line"), "letters": counts("line")}))
    name = f"lines_{uuid.uuid4().hex}"
    (own.write.option("path", scratch_path(spark, "lines")).option("compression", "zstd")
     .bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "id").saveAsTable(name))
    return spark.table(name)


def _occurrences(docs: DataFrame, text: str, id_column: str, least: int) -> DataFrame:
    """(doc_id, text_hash, line_no, line, id) of every line that is long enough."""
    rows = docs.select(F.col(id_column).alias("doc_id"), plain(text).alias("text"))
    lines = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.filter(F.length("line") >= least).withColumn("id", F.unhex(F.md5(F.col("line").cast("binary"))))


def near_pairs(lines: DataFrame, threshold: int = THRESHOLD, hot: int = HOT) -> DataFrame:
    """(src, tgt): pairs of distinct lines to be verified; ``lines`` has id, line, size and letters."""
    cells = lines.select("id", F.col("size").alias("n"), "letters", "line")
    keyed = lambda keys, side: cells.select("id", "n", "letters", F.explode(keys("line", F.col("n"), threshold)).alias("k"), F.lit(side).alias("side"), "line")
    index, probe = keyed(segment_keys, 0), keyed(probe_keys, 1)
    crowded = materialise(index.groupBy("k.key").agg(F.count("*").alias("c")).filter(F.col("c") > hot).select("key"), "hot_segments")
    short = lambda rows: rows.select("id", "n", "letters", F.col("k.key").alias("key"))
    if crowded.isEmpty() or threshold > 1:
        return _met(short(index), short(probe), threshold)
    # The part outside the shared segment, whole and with each character left out.
    rest = F.expr("concat(substring(line, 1, k.at - 1), chr(0), substring(line, k.at + k.size))")
    variants = F.expr("array_distinct(concat(array(xxhash64(k.key, r)), transform(sequence(1, length(r)),"
                      " i -> xxhash64(k.key, concat(substring(r, 1, i - 1), substring(r, i + 1))))))")
    fine = lambda rows: (rows.join(crowded, rows["k.key"] == crowded["key"], "left_semi").withColumn("r", rest)
                         .select("id", "n", "letters", F.explode(variants).alias("key")))
    plain_rows = lambda rows: short(rows).join(crowded, "key", "left_anti")
    return _met(plain_rows(index), plain_rows(probe), threshold).unionByName(_met(fine(index), fine(probe), threshold)).distinct()


def _met(index: DataFrame, probe: DataFrame, threshold: int) -> DataFrame:
    """Pairs with a common key that lengths and letter counts allow, each once."""
    a = index.select("key", F.col("id").alias("src"), F.col("n").alias("n1"), F.col("letters").alias("l1"))
    b = probe.select("key", F.col("id").alias("tgt"), F.col("n").alias("n2"), F.col("letters").alias("l2"))
    # Equal lengths meet in both directions; one is enough.
    allowed = (a["key"] == b["key"]) & (F.col("n2") - F.col("n1")).between(0, threshold) & (
        (F.col("n1") < F.col("n2")) | (F.col("src") < F.col("tgt"))) & (counts_apart("l1", "l2") <= 2 * threshold)
    return a.join(b, allowed).select("src", "tgt").distinct()


def line_classes(docs: DataFrame, text: str = "text", id_column: str = "doc_id", threshold: int = THRESHOLD, least: int = LEAST) -> DataFrame:
    """(id, first): for each distinct line that has an equal or near one, the first occurrence of its group."""
    lines = _distinct_lines(docs, text, id_column, least)
    pairs = materialise(near_pairs(lines, threshold), "line_pairs")
    whole = lines.select("id", "line")
    near = (pairs.join(whole.select(F.col("id").alias("src"), F.col("line").alias("a")), "src")
            .join(whole.select(F.col("id").alias("tgt"), F.col("line").alias("b")), "tgt")
            .filter(within("a", "b", threshold)))
    groups = components(materialise(near.select("src", F.lit("near").alias("rel"), "tgt"), "line_links"))
    named = lines.select("id", "first", "n").join(groups.withColumnRenamed("node", "id"), "id", "left")
    several = named.filter("component IS NOT NULL")
    first = several.groupBy("component").agg(F.min("first").alias("first"))
    grouped = several.select("id", "component").join(first, "component").select("id", "first")
    return materialise(named.filter("component IS NULL AND n > 1").select("id", "first").unionByName(grouped), "line_classes")


def repeats(docs: DataFrame, text: str = "text", id_column: str = "doc_id", threshold: int = THRESHOLD, least: int = LEAST) -> DataFrame:
    """(doc_id, text_hash, lines): the numbers of the lines of a document that repeat an earlier one, in order."""
    classes = line_classes(docs, text, id_column, threshold, least)
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "line_no")
    dropped = (_occurrences(docs, text, id_column, least).drop("line").join(classes, "id")
               .filter(~at.eqNullSafe(F.col("first"))))
    return dropped.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("line_no")).alias("lines"))


def without_repeats(docs: DataFrame, text: str = "text", id_column: str = "doc_id", size: str | None = "n_chars", **settings: int) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and the number of characters in ``size`` where there is such a column."""
    found = materialise(repeats(docs, text, id_column, **settings), "line_repeats")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_column).alias("_id"), F.xxhash64(plain(text)).alias("_hash"))
    keyed = found.select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash"), "lines")
    out = rows.join(keyed, F.col("_id").eqNullSafe(F.col("k_id")) & (F.col("_hash") == F.col("k_hash")), "left")
    out = out.withColumn("_parts", F.split(F.col(f"row.{text}"), "\n"))
    cleaned = F.when(F.col("lines").isNull(), F.col(f"row.{text}")).otherwise(
        F.expr("array_join(transform(array_except(sequence(0, size(_parts) - 1), lines), i -> _parts[i]), '\\n')"))
    columns = []
    for c in docs.columns:
        if c == text:
            columns.append(cleaned.alias(c))
        elif c == size:
            columns.append(F.when(F.col("lines").isNull(), F.col(f"row.{c}")).otherwise(F.length(cleaned)).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(f"row.`{c}`").alias(c))
    return out.select(*columns)


def report(docs: DataFrame, text: str = "text", id_column: str = "doc_id", **settings: int) -> DataFrame:
    """One row per document: doc_id, n_lines, n_repeats, repeats (numbers of the lines that go, joined by commas)."""
    found = repeats(docs, text, id_column, **settings).select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash"), "lines")
    rows = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(plain(text)).alias("_hash"), F.size(F.split(plain(text), "\n")).cast("long").alias("n_lines"))
    out = rows.join(found, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("_hash") == F.col("k_hash")), "left")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_repeats"),
                      F.coalesce(F.array_join(F.col("lines").cast("array<string>"), ","), F.lit("")).alias("repeats"))

"""Merkle fixity audit of replicated record archives.

Every record is hashed where it lies. An archive holds the pages of a block of ids, and its tree goes by ranges of ids, not by ordinals: the
records of a page and hash of its address are a leaf, a page's leaves make a node, and `fanout` neighbouring nodes make one of the next level,
up to a root per archive. A node's hash covers its children's hashes and the offset ranges they take in it, counted from where the
node itself begins, so a record that is lost or longer changes the nodes above it and shifts no others.

Each replica is laid out by itself and its levels are written once. Two replicas are compared from the roots down: only children of
mismatching nodes are joined, and the audit ends where none is left. Payloads are never shuffled, equal records are counted
before anything else, and no task holds more than one leaf of one address's records or the children of one node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import broadcast_if_small, scratch, table, text_or_empty, utf8

FANOUT = 16
#: Pages with ids of one block of this many make one archive.
ARCHIVE_PAGES = 1000


def warc_record(url: Column, html: Column) -> Column:
    """The bytes of a response record; null url or html count as empty."""
    body = utf8(text_or_empty(html))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), text_or_empty(url), F.lit("\r\nContent-Length: "), F.length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(utf8(head), body, utf8(F.lit("\r\n\r\n")))


#: Leaves of a page, by the hash of the address, so that many records of one page spread.
BUCKETS = 256


def lay_out(pages: DataFrame) -> DataFrame:
    """(archive, key, slot, bucket, page_id, uri, bytes, sha256, copies, ordinal, start, stop): pages as records in archives, in the order of page_id, hash of
    the address, address and digest. Equal records are one row with their number, lying one after the other from ordinal and start on.
    Records without page_id are dealt to archives of their own by address, with null for the archive; null url or html count as empty."""
    rows = pages.select("page_id", text_or_empty("url").alias("uri"), warc_record(F.col("url"), F.col("html")).alias("payload"))
    rows = rows.select("page_id", "uri", F.length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("sha256"))
    rows = rows.groupBy("page_id", "uri", "bytes", "sha256").agg(F.count("*").alias("copies"))
    archive, name = F.floor(F.col("page_id") / ARCHIVE_PAGES).cast("long"), F.xxhash64("uri")
    rows = rows.select(
        archive.alias("archive"), F.coalesce(F.concat(F.lit("pages "), archive.cast("string")), F.concat(F.lit("no page "), F.pmod(name, F.lit(4096)).cast("string"))).alias("key"),
        F.coalesce(F.col("page_id") - archive * ARCHIVE_PAGES, F.pmod(F.shiftrightunsigned(name, 20), F.lit(ARCHIVE_PAGES))).cast("long").alias("slot"),
        F.pmod(F.shiftrightunsigned(name, 40), F.lit(BUCKETS)).alias("bucket"), "page_id", "uri", "bytes", "sha256", "copies",
    )
    rows, _ = scratch(rows)
    leaf = ["key", "slot", "bucket"]
    before = Window.partitionBy("key").orderBy("slot", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*leaf).agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.col("bytes")).alias("size"))
    shifts = sums.select(*leaf, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("size_before"))
    within = Window.partitionBy(*leaf).orderBy("uri", "sha256").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumns({"n_within": F.coalesce(F.sum("copies").over(within), F.lit(0)), "size_within": F.coalesce(F.sum(F.col("copies") * F.col("bytes")).over(within), F.lit(0))})
    start = F.col("size_before") + F.col("size_within")
    return placed.join(shifts, leaf).select("archive", *leaf, "page_id", "uri", "bytes", "sha256", "copies", (F.col("n_before") + F.col("n_within")).alias("ordinal"), start.alias("start"), (start + F.col("bytes")).alias("stop"))


def _digest(parts: Column) -> Column:
    """Of parts(start, stop, hash), their offsets counted from the first one's start."""
    first = F.get(parts, F.lit(0))["start"]
    return F.sha2(F.array_join(F.transform(parts, lambda x: F.concat_ws(":", x["start"] - first, x["stop"] - first, x["hash"])), "|"), 256)


def merkle_levels(records: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Written levels of (key, node, start, stop, hash), from the leaves of lay_out's records up to one root per archive."""
    every = F.array_sort(F.collect_list(F.struct("start", "stop", "hash")))
    leaves = records.select("key", (F.col("slot") * BUCKETS + F.col("bucket")).alias("node"), "start", (F.col("start") + F.col("copies") * F.col("bytes")).alias("stop"), F.concat_ws("x", "copies", "sha256").alias("hash"))
    levels, width, step = [], BUCKETS * ARCHIVE_PAGES - 1, 1
    rows = leaves
    while True:
        rows = rows.groupBy("key", F.expr(f"node div {step}").alias("node")).agg(F.min("start").alias("first"), F.max("stop").alias("last"), every.alias("parts"))
        rows, _ = scratch(rows.select("key", "node", F.col("first").alias("start"), F.col("last").alias("stop"), _digest(F.col("parts")).alias("hash")))
        levels.append(rows)
        width //= step
        if not width:
            return levels
        step = BUCKETS if len(levels) == 1 else fanout


def mismatching(left: list[DataFrame], right: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """(key, node) of the leaves whose hashes differ, or that one side lacks, found from the roots down."""
    suspects = None
    for depth in reversed(range(len(left))):
        a, b = (x[depth].select("key", "node", F.col("hash").alias(n)) for x, n in ((left, "expected"), (right, "found")))
        if suspects is not None:
            step = BUCKETS if depth == 0 else fanout
            up = suspects.withColumnRenamed("node", "parent")
            a, b = (x.withColumn("parent", F.expr(f"node div {step}")).join(broadcast_if_small(up), ["key", "parent"], "left_semi").drop("parent") for x in (a, b))
        bad = a.join(b, ["key", "node"], "full").where(~F.col("expected").eqNullSafe(F.col("found"))).select("key", "node")
        suspects, _ = scratch(bad)
        if suspects.isEmpty():
            break
    return suspects


def fixity_audit(primary: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Damaged records of two layouts as lay_out() gives them: archive, ordinal, page_id, start, stop, expected, found, damage, copies. Records of a mismatching
    leaf are matched by address and digest; what is left over is altered, if the other side has one left of the address, else missing
    or surplus. Places are those in the primary, of surplus records those in the replica. Empty tables give no rows; against an empty
    replica every record is missing."""
    sides = [scratch(x)[0] for x in (primary, replica)]
    bad = mismatching(*(merkle_levels(x, fanout) for x in sides), fanout)
    leaf = (F.col("slot") * BUCKETS + F.col("bucket")).alias("node")
    ours, theirs = (x.withColumn("node", leaf).join(broadcast_if_small(bad), ["key", "node"], "left_semi") for x in sides)
    same, place = ["key", "node", "uri", "page", "sha256"], ["archive", "ordinal", "page_id", "start", "stop"]
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("page")
    ours = ours.select("key", "node", "uri", page, "sha256", F.struct(*place).alias("at"), F.col("copies").alias("n"))
    theirs = theirs.select("key", "node", "uri", page, "sha256", F.struct(*place).alias("other_at"), F.col("copies").alias("other_n"))
    both = ours.join(theirs, same, "full").withColumn("more", F.coalesce("n", F.lit(0)) - F.coalesce("other_n", F.lit(0)))
    # What either side has too many of, in runs of copies; runs of an address meet where their numbers overlap.
    address = ["key", "node", "uri", "page"]
    upto = Window.partitionBy(*address).orderBy("sha256").rowsBetween(Window.unboundedPreceding, 0)
    run = lambda rows, n: rows.withColumn("to", F.sum(n).over(upto)).withColumn("from", F.col("to") - n)
    lost = run(both.where("more > 0"), F.col("more")).select(*address, F.col("sha256").alias("expected"), "at", F.col("from").alias("a"), F.col("to").alias("b"))
    come = run(both.where("more < 0"), -F.col("more")).select(*address, F.col("sha256").alias("found"), "other_at", F.col("from").alias("c"), F.col("to").alias("d"))
    lost, _ = scratch(lost)
    come, _ = scratch(come)
    pairs = lost.join(come, address).where("a < d AND c < b").select("at", "expected", "found", F.lit("altered").alias("damage"), (F.least("b", "d") - F.greatest("a", "c")).alias("copies"))
    most = lambda rows, to: rows.groupBy(*address).agg(F.max(to).alias("most"))
    rest = lambda rows, to, other: rows.join(other, address, "left").withColumn("left", F.col(to) - F.greatest(F.col("a" if to == "b" else "c"), F.coalesce("most", F.lit(0)))).where("left > 0")
    gone = rest(lost, "b", most(come, "d")).select("at", "expected", F.lit(None).cast("string").alias("found"), F.lit("missing").alias("damage"), F.col("left").alias("copies"))
    new = rest(come, "d", most(lost, "b")).select(F.col("other_at").alias("at"), F.lit(None).cast("string").alias("expected"), "found", F.lit("surplus").alias("damage"), F.col("left").alias("copies"))
    return pairs.unionByName(gone).unionByName(new).select(*[F.col(f"at.{c}").alias(c) for c in place], "expected", "found", "damage", "copies")


def op7_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a copy of all pages, laid out by itself, in which the last character of pages with id % 97 = 5 was altered and those with id % 211 = 7
    are gone; nulls, repeats, empty tables and extra columns as in lay_out() and fixity_audit()."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    altered = F.when(F.col("page_id") % 97 == 5, F.concat(F.expr("left(html, length(html) - 1)"), F.lit("#"))).otherwise(F.col("html"))
    copy = pages.where(F.coalesce(F.col("page_id") % 211 != 7, F.lit(True))).withColumn("html", altered)
    return fixity_audit(lay_out(pages), lay_out(copy))


ORACLE = """
WITH recs AS (
  SELECT page_id, page_id // 1000 AS archive, coalesce(url, '') AS u, coalesce(html, '') AS h,
         CASE WHEN page_id % 97 = 5 THEN left(html, length(html) - 1) || '#' ELSE coalesce(html, '') END AS g FROM pages),
bytes AS (
  SELECT page_id, archive, u, g, h,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || u || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(h) || chr(13) || chr(10) || chr(13) || chr(10) || h || chr(13) || chr(10) || chr(13) || chr(10) AS payload,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || u || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(g) || chr(13) || chr(10) || chr(13) || chr(10) || g || chr(13) || chr(10) || chr(13) || chr(10) AS copy
  FROM recs),
laid AS (
  SELECT *, row_number() OVER w - 1 AS ordinal, CAST(sum(strlen(payload)) OVER w AS BIGINT) AS stop
  FROM bytes WINDOW w AS (PARTITION BY archive ORDER BY page_id ROWS UNBOUNDED PRECEDING))
SELECT archive, ordinal, page_id, stop - strlen(payload) AS start, stop, sha256(payload) AS expected,
       CASE WHEN page_id % 211 = 7 THEN NULL ELSE sha256(copy) END AS found,
       CASE WHEN page_id % 211 = 7 THEN 'missing' ELSE 'altered' END AS damage, 1 AS copies
FROM laid WHERE page_id % 211 = 7 OR sha256(payload) <> sha256(copy)
"""

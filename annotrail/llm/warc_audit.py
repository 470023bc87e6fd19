"""Merkle fixity audit of WARC replicas.

Pages become WARC/1.0 records, numbered by id, in files of ``SHARD`` numbers. The
records of ``FANOUT`` neighbouring numbers are a contiguous range of offsets; its
node holds the range's bytes and the sums of hashes of its records' SHA-256, so
that no task gathers them, however many records an id has. ``FANOUT`` nodes are
hashed into the next, up to the root of the archive; a file's root is one of
these nodes. Both replicas' trees are built side by side from one stored level.
Two replicas with equal roots are equal. Otherwise the audit goes down from the
root and reads only the children of nodes that differ, so what it moves follows
the damage, not the archive.

Whole numbers are numbered by their distance from the least id. Ids of another
type, or so far apart that the distance is no long, are numbered by their rank
among both replicas' ids, which takes a sort by ranges and a join.

Defined cases: a null url gives a record without a target, null html an empty
body. Rows that are equal in all three columns are one record with ``copies``;
different records of one number stand side by side in its node. Null ids are in
file 0; in the tree they stand after all others, dealt by their digests, one to a
place on average. Two empty replicas are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annotrail.llm.common import stored

SHARD = 4096
FANOUT = 16


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The record as text: headers, blank line, body, two line ends."""
    target = F.coalesce(F.concat(F.lit("WARC-Target-URI: "), url, F.lit("\r\n")), F.lit(""))
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">\r\n"), target,
        F.lit("Content-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def parse(raw: bytes) -> list[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, body) of the records of a WARC file."""
    out, at = [], 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        head = raw[at:end].decode().split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(x.split(": ", 1) for x in head[1:])
        size = int(headers["Content-Length"])
        out.append((at, headers, raw[end + 4 : end + 4 + size]))
        at = end + 4 + size + 4
    return out


def manifest(pages: DataFrame) -> DataFrame:
    """page_id, length, digest, copies: a row for each different record of (page_id, url, html)."""
    text = record(F.col("page_id"), F.col("url"), F.col("html"))
    rows = pages.select("page_id", F.octet_length(text).cast("long").alias("length"), F.sha2(text, 256).alias("digest"))
    return rows.groupBy("page_id", "length", "digest").agg(F.count("*").alias("copies"))


def numbered(first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Both manifests with number, file and place in the tree, and the greatest place."""
    both = first.select("page_id", "digest").union(second.select("page_id", "digest"))
    ends = both.agg(F.min("page_id").alias("least"), F.max("page_id").alias("most"), F.count("page_id").alias("ids"), F.count_if(F.col("page_id").isNull()).alias("nulls")).first()
    whole = isinstance(first.schema["page_id"].dataType, T.IntegralType)
    if not ends["ids"]:
        most, parts = SHARD, [x.withColumn("number", F.lit(None).cast("long")) for x in (first, second)]
    elif whole and ends["most"] - ends["least"] < 1 << 62:
        most = ends["most"] - ends["least"] + SHARD
        # Both differences are within a long, whatever the ids.
        parts = [x.withColumn("number", F.col("page_id").cast("long") - F.lit(ends["least"]).cast("long") + SHARD) for x in (first, second)]
    else:
        ranks, n = _ranked(both.select("page_id").filter("page_id is not null").distinct())
        most = n - 1 + SHARD
        parts = [x.join(ranks, "page_id", "left") for x in (first, second)]
    after = F.lit(most + 1) + F.pmod(F.xxhash64("digest"), F.lit(max(ends["nulls"], 1)))
    parts = [x.withColumn("place", F.coalesce("number", after)).withColumn("number", F.coalesce("number", F.lit(0)).cast("long")) for x in parts]
    return *(x.withColumn("file", F.floor(F.col("number") / SHARD).cast("long")) for x in parts), most + max(ends["nulls"], 1)


def _ranked(ids: DataFrame) -> tuple[DataFrame, int]:
    """(page_id, number) in order of the ids, from SHARD on, and how many there are."""
    spread = stored(ids.repartitionByRange("page_id").withColumn("__p", F.spark_partition_id()), "merkle-ids")
    sizes = sorted((r["__p"], r["n"]) for r in spread.groupBy("__p").agg(F.count("*").alias("n")).collect())
    before, rows = 0, []
    for p, n in sizes:
        rows.append((p, before))
        before += n
    offset = ids.sparkSession.createDataFrame(rows, "__p int, __before bigint")
    rank = F.row_number().over(W.partitionBy("__p").orderBy("page_id")) - 1
    out = spread.withColumn("__k", rank).join(F.broadcast(offset), "__p")
    return out.select("page_id", (F.col("__k") + F.col("__before") + SHARD).cast("long").alias("number")), before


def offsets(rows: DataFrame) -> DataFrame:
    """The numbered manifest with each record's first byte in its file."""
    order = W.partitionBy("file").orderBy("number", "digest").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(F.col("length") * F.col("copies")).over(order), F.lit(0)).cast("long"))


def ranges(a: DataFrame, b: DataFrame) -> DataFrame:
    """(node, x, y): the lowest level of both trees, null where a replica has no record in a range."""

    def side(rows: DataFrame, mine: int) -> DataFrame:
        up = F.floor(F.col("place") / FANOUT).cast("long").alias("node")
        names = [F.xxhash64("number", "digest", "copies", F.lit(k)) for k in range(4)]
        halves = [h.alias(f"h{2 * k + j}") for k, x in enumerate(names) for j, h in enumerate((x.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(x, 32)))]
        return rows.select(up, F.lit(mine).alias("mine"), (F.col("length") * F.col("copies")).alias("size"), *halves)

    def node(mine: int) -> Column:
        here = F.col("mine") == mine
        sums = [F.sum(F.when(here, F.col(c))) for c in ("size", *(f"h{k}" for k in range(8)))]
        return F.when(F.count_if(here) > 0, F.sha2(F.concat_ws(":", *sums), 256))

    both = side(a, 0).unionByName(side(b, 1))
    return stored(both.groupBy("node").agg(node(0).alias("x"), node(1).alias("y")), "merkle")


def tree(lowest: DataFrame, most: int) -> list[DataFrame]:
    """Levels (node, x, y) over places 0 to ``most``, from ranges of records up to the root."""
    levels, width = [lowest], most // FANOUT + 1
    up = F.floor(F.col("node") / FANOUT).cast("long").alias("node")

    def node(side: str) -> Column:
        child = F.when(F.col(side).isNotNull(), F.concat_ws(":", F.col("node").cast("string"), side))
        return F.when(F.count(side) > 0, F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(child))), 256)).alias(side)

    while width > 1:
        levels.append(levels[-1].groupBy(up).agg(node("x"), node("y")))
        width = (width - 1) // FANOUT + 1
    return levels


def descend(levels: list[DataFrame]) -> DataFrame | None:
    """The lowest nodes at which two trees differ; None if the roots agree."""
    differ = ~F.col("x").eqNullSafe(F.col("y"))
    bad = levels[-1].filter(differ).select("node")
    if bad.isEmpty():
        return None
    up = F.floor(F.col("node") / FANOUT).cast("long")
    for level in reversed(levels[:-1]):
        # Of each level only the children of nodes that differ.
        bad = level.join(bad.select(F.col("node").alias("parent")), up == F.col("parent"), "left_semi").filter(differ).select("node")
    return stored(bad, "merkle-differing")


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """Records of two manifests: page_id, file, offset, length, digest, copies, status.

    Status is intact, or for records in differing ranges altered (another digest or
    number of copies in the second replica), missing (no record for it there) or extra
    (only there, and no record's altered form).
    """
    first, second = stored(first, "replica"), stored(second, "replica")
    a, b, most = numbered(first, second)
    bad = descend(tree(ranges(a, b), most))
    whole = offsets(a)
    columns = ["page_id", "file", "offset", "length", "digest", "copies"]
    if bad is None:
        return whole.select(*columns, F.lit("intact").alias("status"))
    within = F.floor(F.col("place") / FANOUT).cast("long") == F.col("node")
    other = b.join(bad, within, "left_semi")
    same = other.select(F.col("number").alias("n"), F.col("digest").alias("d"), F.col("copies").alias("k"))
    judged = whole.join(bad, within, "left").join(same, (F.col("number") == F.col("n")) & (F.col("digest") == F.col("d")), "left")
    # Records of a number that only one replica has are paired by the order of their digests: pairs are altered, the rest is missing or extra.
    key, order = ["number", "digest"], F.row_number().over(W.partitionBy("number").orderBy("digest"))
    mine = a.join(bad, within, "left_semi")
    gone = mine.join(other.select(*key), key, "left_anti").withColumn("rank", order)
    new = other.join(mine.select(*key), key, "left_anti").withColumn("rank", order)
    n_gone, n_new = (x.groupBy("number").agg(F.count("*").alias("others")) for x in (gone, new))
    rest = F.col("rank") > F.coalesce("others", F.lit(0))
    lost = gone.join(n_new, "number", "left").filter(rest).select(*key, F.lit(True).alias("lost"))
    extra = new.join(n_gone, "number", "left").filter(rest).withColumn("offset", F.lit(None).cast("long"))
    judged = judged.join(lost, key, "left")
    status = F.when(F.col("node").isNull() | (F.col("copies") == F.col("k")), "intact").when(F.col("lost"), "missing").otherwise("altered")
    return judged.select(*columns, status.alias("status")).unionByName(extra.select(*columns, F.lit("extra").alias("status")))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with faults of a failing disk: by a hash of the address a body is changed, cut short or lost."""
    fault = F.substring(F.md5(F.col("url").cast("binary")), 1, 2)
    html = F.when(fault == "00", F.concat(F.lit("?"), F.expr("substring(html, 2)"))).when(fault == "01", F.expr("substring(html, 1, length(html) div 2)"))
    return pages.withColumn("html", F.coalesce(html, F.col("html"))).filter(F.coalesce(fault != "02", F.lit(True)))


def report(pages: DataFrame) -> DataFrame:
    """The audit of the pages' archive against a damaged replica."""
    rows = pages.select("page_id", "url", "html")
    return audit(manifest(rows), manifest(damaged(rows)))

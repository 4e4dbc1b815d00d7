"""Merkle fixity audit of web archives kept in replicas.

Pages become WARC response records, records are placed in archives in the order of their ids, and an index
says at which offset of which archive each lies. A replica is hashed record by record; records are hashed together
by ranges of offsets, ranges by groups of neighbours, up to one root an archive. Two replicas are compared from
the roots down, and only below nodes that differ, so that equal archives cost one comparison each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .session import cut

RANGE_BYTES, FANOUT, ARCHIVE_BYTES = 1 << 18, 16, 1 << 26


def response_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``record_id, record``: each page as the bytes of a WARC response record. Null parts are empty, a null id is -1."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    record_id = F.coalesce(F.col(id_col).cast("long"), F.lit(-1))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), record_id.cast("string"),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(F.col(url_col), F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"),
    )
    return pages.select(record_id.alias("record_id"), F.concat(head, html, F.lit("\r\n\r\n")).cast("binary").alias("record"))


def record_digests(records: DataFrame) -> DataFrame:
    """``record_id, n_bytes, digest``. Records that share an id are one: their digest is that of all, in any order."""
    each = records.select("record_id", F.octet_length("record").cast("long").alias("n"), F.sha2("record", 256).alias("d"))
    part = lambda at: F.sum(F.conv(F.substring("d", at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    several = F.sha2(F.concat_ws(",", F.count("*").cast("string"), *(part(at) for at in (1, 16, 31, 46))).cast("binary"), 256)
    return each.groupBy("record_id").agg(
        F.sum("n").alias("n_bytes"), F.when(F.count("*") == 1, F.min("d")).otherwise(several).alias("digest")
    )


def archive_index(digests: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """``archive, record_id, offset``: records dealt over archives of about ``archive_bytes``, in the order of their ids."""
    total = digests.agg(F.sum("n_bytes")).first()[0] or 0
    archives = max(4, -(-total // archive_bytes))
    placed = digests.withColumn("archive", F.pmod(F.col("record_id") * F.lit(7919), F.lit(archives)))
    before = Window.partitionBy("archive").orderBy("record_id").rowsBetween(Window.unboundedPreceding, 0)
    return placed.select("archive", "record_id", (F.sum("n_bytes").over(before) - F.col("n_bytes")).alias("offset"))


def leaves(index: DataFrame, digests: DataFrame) -> DataFrame:
    """A replica's records: ``archive, offset, record_id, digest``.

    Records that the index doesn't know are in archive -1, in the order of their ids (modulo 2**40) and 4,096 bytes apart,
    so that they have one place in all replicas.
    """
    own = F.pmod("record_id", F.lit(1 << 40)) * F.lit(4096)
    return digests.join(index, "record_id", "left").select(
        F.coalesce("archive", F.lit(-1)).alias("archive"), F.coalesce("offset", own).alias("offset"), "record_id", "digest"
    )


def merkle_tree(records: DataFrame, height: int, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> list[DataFrame]:
    """The tree's levels from the ranges of offsets (level 0) up to a root for each archive: ``archive, node, digest``.

    A range holds at most ``range_bytes`` of records and a group ``fanout`` nodes, so no list is long.
    """

    def together(rows: DataFrame, place: str) -> DataFrame:
        parts = F.array_sort(F.collect_list(F.struct(place, "digest")))
        text = F.array_join(F.transform(parts, lambda x: F.concat_ws(":", x[place].cast("string"), x["digest"])), "\n")
        return rows.groupBy("archive", "up").agg(F.sha2(text.cast("binary"), 256).alias("digest")).withColumnRenamed("up", "node")

    level = together(records.withColumn("up", F.floor(F.col("offset") / range_bytes)), "offset")
    levels = [cut(level)]
    for _ in range(height):
        level = together(levels[-1].withColumn("up", F.floor(F.col("node") / fanout)), "node")
        levels.append(cut(level))
    return levels


def merkle_audit(one: DataFrame, two: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """Where two replicas differ: ``archive, offset, record_id, damage, digest_1, digest_2``, a row for each record.

    ``damage`` is "changed", or "missing" or "extra" where only the first or only the second replica has the record.
    Replicas come as leaves(); records at one offset of one archive are told apart by their ids. Equal replicas, and empty
    ones, give no rows.
    """
    one, two = cut(one), cut(two)
    end = one.unionByName(two).agg(F.max("offset")).first()[0] or 0
    height, reach = 0, range_bytes
    while reach <= end:
        height, reach = height + 1, reach * fanout
    trees = [merkle_tree(side, height, range_bytes, fanout) for side in (one, two)]
    differ = None
    for level in range(height, -1, -1):
        sides = []
        for tree in trees:
            nodes = tree[level]
            if differ is not None:  # only below what differs
                nodes = nodes.withColumn("parent", F.floor(F.col("node") / fanout))
                nodes = nodes.join(differ.withColumnRenamed("node", "parent"), ["archive", "parent"], "left_semi")
            sides.append(nodes.select("archive", "node", "digest"))
        both = sides[0].join(sides[1].withColumnRenamed("digest", "other"), ["archive", "node"], "full")
        differ = cut(both.filter(~F.col("digest").eqNullSafe(F.col("other"))).select("archive", "node"))
    keys = ["archive", "offset", "record_id"]
    found = []
    for side in (one, two):
        records = side.withColumn("node", F.floor(F.col("offset") / range_bytes))
        found.append(records.join(differ, ["archive", "node"], "left_semi").select(*keys, "digest"))
    both = found[0].withColumnRenamed("digest", "digest_1").join(found[1].withColumnRenamed("digest", "digest_2"), keys, "full")
    damage = F.when(F.col("digest_2").isNull(), "missing").when(F.col("digest_1").isNull(), "extra").otherwise("changed")
    return both.filter(~F.col("digest_1").eqNullSafe(F.col("digest_2"))).select(*keys, damage.alias("damage"), "digest_1", "digest_2")


def damaged_copy(pages: DataFrame) -> DataFrame:
    """A replica that has suffered: of every 211 ids one page has lost its capital letters and one is gone."""
    fate = F.pmod(F.col("page_id") * 31, F.lit(211))
    html = F.when(fate == 5, F.lower("html")).otherwise(F.col("html"))
    return pages.filter(~F.coalesce(fate == 6, F.lit(False))).select("page_id", "url", html.alias("html"))

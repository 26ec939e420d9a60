"""A Merkle manifest of a dataset: every row is a leaf, every language a tree, and a tree over their roots gives one root.

The tree is reduced in superblocks: the nodes of fanout ** levels consecutive places are one bucket, a task collapses as many levels of it at once and keeps each
node's siblings (the lower proof); bucket roots are the nodes of the next round, until each language has one. Proofs of bucket roots come down the same way and are
appended to the lower ones, so a row moves twice, in buckets of bounded size, however many rows a language has.

Defined results: nulls are hashed as "-", so they differ from empty texts; rows of a null language are a language of their own, the first; within a language rows go by doc_id, null first, and
equal doc_ids by their leaves; repeated rows are leaves of their own; a very long text is hashed where it lies and does not move; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriledger.llm.ordering import positions
from veriledger.llm.storage import materialise, scope

FANOUT, LEVELS = 2, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(*values: Column) -> Column:
    """The hash of a row: each value as its length in bytes and itself, null as a dash."""
    shown = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in shown]), 256)


def fold(node: Column, left: Column, right: Column) -> Column:
    """The root that a node and its siblings give; left and right hold what stands before and after it, level by level."""
    return F.aggregate(F.arrays_zip(left.alias("a"), right.alias("b")), node, lambda acc, s: F.sha2(F.concat(s["a"], acc, s["b"]), 256))


def siblings(left: Column, right: Column) -> Column:
    """The hash of all siblings, level by level, from left to right."""
    return F.sha2(F.array_join(F.flatten(F.zip_with(left, right, lambda a, b: F.array(a, b))), ""), 256)


def _collapse(fanout: int, levels: int):
    def collapse(key: tuple, nodes: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("pos")
        row, place = nodes["digest"].tolist(), list(range(len(nodes)))
        left, right = [[] for _ in place], [[] for _ in place]
        height = 0
        # the first bucket may be a whole tree; all others stand beside it and rise as far as it does
        while height < levels and (len(row) > 1 or key[1] > 0):
            runs = [row[i : i + fanout] for i in range(0, len(row), fanout)]
            for i, p in enumerate(place):
                run, at = runs[p // fanout], p % fanout
                left[i].append("".join(run[:at]))
                right[i].append("".join(run[at + 1 :]))
                place[i] = p // fanout
            row = [hashlib.sha256("".join(run).encode()).hexdigest() for run in runs]
            height += 1
        return nodes.assign(left=left, right=right, bucket_root=row[0])

    return collapse


def tree(nodes: DataFrame, *, fanout: int = FANOUT, levels: int = LEVELS, above=None) -> DataFrame:
    """nodes (grp, pos from 0 in each grp, digest, other columns) with subroot, root, left and right (the siblings' digests of each level).

    above: gives for the roots of all groups (grp, digest) a row each with grp, root, left and right, to continue proofs beyond the groups; else a group's root is the root.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields)
    bucketed = nodes.withColumn("bucket", F.floor(F.col("pos") / fanout**levels))
    lower = materialise(bucketed.groupBy("grp", "bucket").applyInPandas(_collapse(fanout, levels), schema + ", bucket long, left array<string>, right array<string>, bucket_root string"))
    roots = lower.where(F.col("pos") % fanout**levels == 0).select("grp", F.col("bucket").alias("pos"), F.col("bucket_root").alias("digest"))
    if (lower.agg(F.max("bucket")).collect()[0][0] or 0) > 0:
        upper = tree(roots, fanout=fanout, levels=levels, above=above)
    elif above:
        upper = roots.withColumnRenamed("digest", "subroot").join(above(roots.select("grp", "digest")), "grp")
    else:
        none = F.array().cast("array<string>")
        upper = roots.select("grp", "pos", F.col("digest").alias("subroot"), F.col("digest").alias("root"), none.alias("left"), none.alias("right"))
    upper = upper.select("grp", F.col("pos").alias("bucket"), "subroot", "root", F.col("left").alias("_left"), F.col("right").alias("_right"))
    both = lower.join(upper, ["grp", "bucket"])
    return both.select(*nodes.columns, "subroot", "root", F.concat("left", "_left").alias("left"), F.concat("right", "_right").alias("right"))


def manifest(docs: DataFrame, *, fanout: int = FANOUT, levels: int = LEVELS, fields: tuple[str, ...] = FIELDS, group: str = "lang", key: str = "doc_id", also: dict[str, Column] | None = None) -> DataFrame:
    """One row for each of docs: key, leaf, subroot (of its group), root, left and right (its proof), and also (columns of docs' rows).

    The place of a row in its group comes from ranges in order and sums of their counts; of a row only its key and its hashes move.
    """
    groups = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = docs.select(F.col(key).alias("key"), groups.alias("grp"), leaf(*[F.col(f) for f in fields]).alias("digest"), *[c.alias(n) for n, c in (also or {}).items()])
    placed = positions(leaves, F.col("key").asc_nulls_first(), F.col("digest"), by=("grp",))

    def above(roots: DataFrame) -> DataFrame:
        ordered = positions(roots.withColumn("own", F.col("grp")), F.col("own")).withColumn("grp", F.lit(""))
        return tree(ordered, fanout=fanout, levels=levels).select(F.col("own").alias("grp"), "root", "left", "right")

    done = tree(placed, fanout=fanout, levels=levels, above=above)
    return done.select(F.col("key").alias(key), F.col("digest").alias("leaf"), "subroot", "root", "left", "right", *(also or {}))


def verify(proved: DataFrame, docs: DataFrame, *, fields: tuple[str, ...] = FIELDS, key: str = "doc_id") -> DataFrame:
    """(key, verified) for each row of docs, by the proof that the manifest has of its key (unique in both): false if the row changed or the manifest lacks it."""
    now = docs.select(F.col(key), leaf(*[F.col(f) for f in fields]).alias("_now"))
    return now.join(proved.select(key, "root", "left", "right"), key, "left").select(key, F.coalesce(fold(F.col("_now"), F.col("left"), F.col("right")) == F.col("root"), F.lit(False)).alias("verified"))


def op13_superblock_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text")))
    with scope(spark) as kept:
        proved = manifest(docs, also={"tampered": tampered})
        folded = proved.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("left"), F.col("right")))
        kept.append(materialise(folded.select("doc_id", "leaf", "subroot", "root", siblings(F.col("left"), F.col("right")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))))
    return kept[0]


#: CRC-32 of a decimal number's text, bit by bit.
CRC = """(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda a, c: list_reduce(list_prepend(xor(a, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""
_FIELD = "coalesce(concat(strlen(CAST({0} AS VARCHAR)), ':', {0}), '-')"
_LEAF = "sha256(concat(" + ", ".join(_FIELD.format(f) for f in ("doc_id", "source", "lang", "{n}", "text")) + "))"
SQL = {
    "op13_superblock_manifest": f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {_LEAF.format(n="n_chars")} AS leaf,
  CASE WHEN xor({CRC.format("doc_id")}, 4294967295) % 7 = 0 THEN {_LEAF.format(n="(n_chars + 1)")} END AS bad FROM documents),
l AS (SELECT *, row_number() OVER (ORDER BY g, doc_id, leaf) AS id, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
t AS (SELECT g, 0 AS lvl, pos, leaf AS h FROM l UNION ALL
  SELECT g, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM t) WHERE n > 1 GROUP BY g, lvl, pos // 2),
s AS (SELECT g, arg_max(h, lvl) AS subroot, max(lvl) AS height FROM t GROUP BY g),
p AS (SELECT *, row_number() OVER (ORDER BY g) - 1 AS gpos FROM s),
u AS (SELECT 0 AS lvl, gpos AS pos, subroot AS h FROM p UNION ALL
  SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS n FROM u) WHERE n > 1 GROUP BY lvl, pos // 2),
r AS (SELECT arg_max(h, lvl) AS root, max(lvl) AS top FROM u),
steps AS (SELECT id, x.lvl, (l.pos >> x.lvl) % 2 = 1 AS after, coalesce(t.h, '') AS h FROM l JOIN s USING (g), range(64) AS x(lvl) LEFT JOIN t ON t.g = l.g AND t.lvl = x.lvl AND t.pos = xor(l.pos >> x.lvl, 1::BIGINT) WHERE x.lvl < s.height
  UNION ALL SELECT id, height + x.lvl, (gpos >> x.lvl) % 2 = 1, coalesce(u.h, '') FROM l JOIN p USING (g), r, range(64) AS x(lvl) LEFT JOIN u ON u.lvl = x.lvl AND u.pos = xor(p.gpos >> x.lvl, 1::BIGINT) WHERE x.lvl < r.top),
f AS (SELECT id, 0 AS lvl, coalesce(bad, leaf) AS acc FROM l UNION ALL
  SELECT id, f.lvl + 1, sha256(CASE WHEN after THEN h || acc ELSE acc || h END) FROM f JOIN steps USING (id, lvl)),
z AS (SELECT id, arg_max(acc, lvl) AS folded_root FROM f GROUP BY id),
q AS (SELECT id, sha256(string_agg(h, '' ORDER BY lvl)) AS proof FROM steps GROUP BY id)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM l JOIN s USING (g) JOIN z USING (id) LEFT JOIN q USING (id), r"""
}
QUERIES = {"op13_superblock_manifest": op13_superblock_manifest}

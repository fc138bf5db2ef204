"""Merkle manifest of a table by nested-interval labels.

Rows are leaves; per source they are ranked and every 16 consecutive nodes make a parent
until one node, the subroot, is left. A node is labelled by the interval of leaf ranks that
it covers, [lo, hi). Intervals nest, so that

* the ancestor of a node on the next level is the node of that level whose interval
  contains it: an equi-join on the level's bucket, lo div 16^level, which holds one node;
* the siblings of a node are its parent's interval without its own: what lies before lo
  and after hi, cut out of the parent's list of digests by those two differences.

Labels are made from the leaves upwards and paths (the siblings of all ancestors) handed
down from the root, so that only the last join sees the leaves. Ranks come from a range
sort and counts per range, never from one window over a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import ranked
from .storage import saved

FANOUT = 16
#: Hex digits of a digest.
WIDTH = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(columns: list[Column]) -> Column:
    """Digest of a row: each value as its UTF-8 length, a colon and itself, nulls as '-'."""
    texts = [c.cast("string") for c in columns]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def interval_tree(leaves: DataFrame, group: str, fanout: int = FANOUT) -> tuple[list[DataFrame], DataFrame]:
    """(levels, tops) over leaves (group, rank, digest). ``levels[k - 1]`` has the nodes of
    level k, for the groups that still had several nodes below: group, bucket, lo, hi,
    digest, children (the digests below, joined); a node covers the ranks [lo, hi) and is the
    one of its bucket, lo div fanout^k. ``tops`` has the last node of each group: group, n
    (leaves), top. Every table is written; there are log(leaves) levels."""
    sizes = saved(leaves.groupBy(group).agg(F.count("*").alias("n"), F.min(F.when(F.col("rank") == 0, F.col("digest"))).alias("only")), "sizes")
    most = sizes.agg(F.max("n")).first()[0] or 0
    below = leaves.select(group, F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest")
    levels, width = [], 1
    while width < most:
        # groups with one node on the level below are done
        several = sizes.where(F.col("n") > width).select(F.col(group).alias("_several"))
        nodes = below.join(several, F.col(group).eqNullSafe(F.col("_several")), "left_semi")
        width *= fanout
        nodes = nodes.groupBy(group, F.expr(f"lo div {width}").alias("bucket")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sort_array(F.collect_list(F.struct("lo", "digest"))).alias("held"))
        children = F.array_join(F.col("held.digest"), "")
        levels.append(saved(nodes.select(group, "bucket", "lo", "hi", digest(children).alias("digest"), children.alias("children")), "nodes"))
        below = levels[-1].select(group, "lo", "hi", "digest")
    tops = sizes.select(group, "n", F.when(F.col("n") == 1, F.col("only")).alias("top"))
    for at, nodes in enumerate(levels):
        last = nodes.join(sizes.where((F.col("n") > fanout**at) & (F.col("n") <= fanout ** (at + 1))).select(F.col(group).alias("_last")), F.col(group).eqNullSafe(F.col("_last")), "left_semi")
        tops = tops.join(last.select(F.col(group).alias("_group"), F.col("digest").alias("_top")), F.col(group).eqNullSafe(F.col("_group")), "left").select(group, "n", F.coalesce("top", "_top").alias("top"))
    return levels, saved(tops, "tops")


def _siblings(lo: Column, hi: Column, parent: str, below: int) -> Column:
    """The digests (before, after) of the nodes that cover a parent's interval without
    [lo, hi); nodes of that level cover ``below`` ranks, the last one may cover fewer."""
    start = F.expr(f"({parent}.lo)")
    left = ((lo - start) / below).cast("int") * WIDTH
    right = F.ceil((hi - start) / below).cast("int") * WIDTH
    held = F.col(f"{parent}.children")
    return F.struct(F.substring(held, F.lit(1), left).alias("before"), F.substring(held, right + 1, F.length(held)).alias("after"))


def _attach(rows: DataFrame, group: str, nodes: DataFrame, width: int, lo: str, hi: str, fanout: int) -> DataFrame:
    """``rows`` (intervals of one level) with ``step``, their siblings, and ``path``, those of
    their ancestors: the parent is the node of their bucket that contains them. Rows
    without a parent are tops: no step, no path."""
    parent = nodes.select(F.col(group).alias("_group"), F.col("bucket").alias("_bucket"), F.struct("lo", "hi", "children").alias("_parent"), F.col("path").alias("_path"))
    inside = F.col(group).eqNullSafe(F.col("_group")) & (F.expr(f"{lo} div {width}") == F.col("_bucket")) & (F.col(lo) >= F.col("_parent.lo")) & (F.col(hi) <= F.col("_parent.hi"))
    joined = rows.join(parent, inside, "left")
    step = F.when(F.col("_parent").isNotNull(), _siblings(F.col(lo), F.col(hi), "_parent", width // fanout))
    path = F.when(step.isNull(), F.array().cast("array<struct<before:string,after:string>>")).otherwise(F.concat(F.array(step), F.col("_path")))
    return joined.select(*rows.columns, path.alias("path"))


def attach_paths(leaves: DataFrame, group: str, levels: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """``leaves`` (group, rank, ...) with ``path``: array of (before, after), the siblings at
    each level from the leaf's to the one below its group's top."""
    empty = F.array().cast("array<struct<before:string,after:string>>")
    above = None
    for at in range(len(levels) - 1, -1, -1):
        nodes = levels[at]
        nodes = nodes.withColumn("path", empty) if above is None else _attach(nodes, group, above, fanout ** (at + 2), "lo", "hi", fanout)
        above = nodes
    if above is None:
        return leaves.withColumn("path", empty)
    out = leaves.withColumn("_end", F.col("rank") + 1)
    return _attach(out, group, above, fanout, "rank", "_end", fanout).drop("_end")


def fold(start: Column, path: Column) -> Column:
    """The top that follows from a leaf's digest and its path."""
    return F.aggregate(path, start, lambda held, step: digest(step["before"], held, step["after"]))


def merkle_manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", other_cols: tuple[str, ...] = ("lang", "n_chars"), text_col: str = "text", tampered: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source (the group), rank, leaf, subroot, root,
    proof_sha256, folded_root, verified.

    A leaf is the digest of id, group, other columns and text (nulls as '-'); leaves of a
    group ascend by id (null ids first), equal ids by leaf. Every ``fanout`` consecutive nodes,
    the last run also with fewer, become their digest until one is left. These
    subroots, ordered by group (null first, bytewise), likewise make the root. The proof
    is the digest of all siblings up to the root. For rows where ``tampered`` is true, the
    root is folded again from a leaf whose text has A-Z lower-cased; ``verified``
    says whether the folded root is the root (a text without A-Z, or a null one, stays
    as it is and verifies). Repeated rows are leaves of their own. Empty texts are
    values of length 0. A single row is its own subroot and root, with the proof of
    nothing. An empty table has no rows. Other columns of ``docs`` are not read."""
    text, group = F.col(text_col), F.col(group_col)
    fields = lambda t: [F.col(id_col), group, *[F.col(c) for c in other_cols], t]
    changed = F.when(F.coalesce(tampered, F.lit(False)), leaf_digest(fields(F.translate(text, UPPER, LOWER)))) if tampered is not None else F.lit(None).cast("string")
    leaves = docs.select(F.col(id_col).cast("long").alias("doc_id"), group.cast("string").alias("source"), leaf_digest(fields(text)).alias("digest"), changed.alias("changed"))
    leaves = saved(ranked(leaves, "source", ["doc_id", "digest"]), "leaves")

    levels, subroots = interval_tree(leaves, "source", fanout)
    tops = ranked(subroots.select(F.lit(0).alias("all"), "source", F.col("top").alias("digest")), "all", ["source"])
    tops = saved(tops, "subroots")
    upper, roots = interval_tree(tops, "all", fanout)
    tops = attach_paths(tops, "all", upper, fanout).join(roots.select("all", F.col("top").alias("root")), "all")
    tops = saved(tops.select(F.col("source").alias("_source"), F.col("digest").alias("subroot"), "root", F.col("path").alias("_upper")), "paths")

    out = attach_paths(leaves, "source", levels, fanout).join(tops, F.col("source").eqNullSafe(F.col("_source")))
    path = F.concat("path", "_upper")
    out = out.withColumn("path", path)
    proof = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    folded = fold(F.coalesce("changed", "digest"), F.col("path"))
    return out.select(
        "doc_id", "source", "rank", F.col("digest").alias("leaf"), "subroot", "root", digest(proof).alias("proof_sha256"),
        folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def _tree_sql(name: str, leaves: str, depth: int) -> str:
    """CTEs name_0 .. name_depth (grp, idx, digest, children) over ``leaves`` (grp, idx, digest)."""
    out = [f"{name}_0 AS (SELECT grp, idx, digest, '' AS children, count(*) OVER (PARTITION BY grp) AS n FROM {leaves})"]
    for k in range(1, depth + 1):
        out.append(f"""{name}_{k} AS (SELECT grp, idx // {FANOUT} AS idx, sha256(string_agg(digest, '' ORDER BY idx)) AS digest, string_agg(digest, '' ORDER BY idx) AS children,
  count(*) OVER (PARTITION BY grp) AS n FROM {name}_{k - 1} AS below WHERE n > 1 GROUP BY grp, idx // {FANOUT})""")
    return ",\n".join(out)


def _climb_sql(name: str, tree: str, start: str, depth: int) -> str:
    """CTEs name_0 .. name_depth: rows of ``start`` (row, grp, idx, folded, proof) one level higher each."""
    out = [f"{name}_0 AS ({start})"]
    for k in range(1, depth + 1):
        place = f"{WIDTH} * (c.idx % {FANOUT})"
        left, right = f"substr(p.children, 1, ({place})::INT)", f"substr(p.children, ({place} + {WIDTH + 1})::INT)"
        out.append(f"""{name}_{k} AS (SELECT c.row, c.grp, CASE WHEN p.grp IS NULL THEN c.idx ELSE c.idx // {FANOUT} END AS idx,
  CASE WHEN p.grp IS NULL THEN c.folded ELSE sha256({left} || c.folded || {right}) END AS folded,
  CASE WHEN p.grp IS NULL THEN c.proof ELSE c.proof || {left} || {right} END AS proof
  FROM {name}_{k - 1} AS c LEFT JOIN {tree}_{k} AS p ON p.grp = c.grp AND p.idx = c.idx // {FANOUT})""")
    return ",\n".join(out)


def oracle_sql(depth: int = 6, upper: int = 3) -> str:
    """DuckDB SQL for the manifest of ``documents``, level by level: up to 16^depth rows of a
    source and 16^upper sources. A null source is grouped under an empty text, others under
    's' and their name, which sorts nulls first."""
    value = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda t: "sha256(" + " || ".join(map(value, ["doc_id", "source", "lang", "n_chars", t])) + ")"
    bits = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))"
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda a, b: {bits}))"
    return f"""WITH rows AS (SELECT row_number() OVER () AS row, doc_id, source, CASE WHEN source IS NULL THEN '' ELSE 's' || source END AS grp, {leaf("text")} AS digest,
  CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS changed FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx FROM rows),
{_tree_sql("node", "leaves", depth)},
{_climb_sql("up", "node", "SELECT row, grp, idx, coalesce(changed, digest) AS folded, '' AS proof FROM leaves", depth)},
subroots AS (SELECT '' AS grp, row_number() OVER (ORDER BY grp) - 1 AS idx, digest, grp AS source_grp FROM ({" UNION ALL ".join(f"SELECT grp, digest FROM node_{k} WHERE n = 1" for k in range(depth + 1))})),
{_tree_sql("top", "subroots", upper)},
root AS ({" UNION ALL ".join(f"SELECT digest AS root FROM top_{k} WHERE n = 1" for k in range(upper + 1))}),
{_climb_sql("over", "top", f"SELECT row, '' AS grp, s.idx, folded, proof FROM up_{depth} AS u JOIN subroots AS s ON s.source_grp = u.grp", upper)}
SELECT l.doc_id, l.source, l.idx AS rank, l.digest AS leaf, s.digest AS subroot, root.root, sha256(o.proof) AS proof_sha256, o.folded AS folded_root, o.folded = root.root AS verified
FROM leaves AS l JOIN over_{upper} AS o ON o.row = l.row JOIN subroots AS s ON s.source_grp = l.grp, root"""

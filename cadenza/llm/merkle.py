"""Merkle manifest of a dataset: bottom-up build, top-down proof push.

Rows become leaves at the scan, so texts are never shuffled.  Leaves are sorted by range over (source, id), and a
leaf's place in its source is its row in its partition and the rows of the source in the partitions before: a hot source is
many partitions like any other rows.  Every FANOUT consecutive nodes are a run, whose children lie in one row; a run is a
node of the next level, which is written before it is read.  The subroots of the sources are the leaves of one
more tree.  Proofs go down: a child's proof is its own siblings before the suffix that its run inherited, so the
siblings of a run are laid out once for its sixteen children and no leaf looks a level up by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import drop_stage, stage

FANOUT = 16
STEP = "array<struct<left:binary,right:binary>>"


def digest(text: Column) -> Column:
    """Lowercase hex sha256 of a string's UTF-8 bytes, as 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def as_text(node: Column) -> Column:
    return F.lower(F.hex(node))


def leaf_of(*columns: Column) -> Column:
    """The digest of the columns: ``-`` for null, else the count of UTF-8 bytes, ``:`` and the value."""
    parts = [c.cast("string") for c in columns]
    return digest(F.concat(*[F.when(p.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p)) for p in parts]))


def _numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` (tree, hash, ...) with ``at``, the place in the tree by ``order``, and ``size``, the nodes of the tree.

    One row for each partition and tree is all that is summed over a tree.
    """
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stage(nodes.repartitionByRange(n, "tree", *order).sortWithinPartitions("tree", *order).withColumn("row", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("row", 33).alias("part")
    held = rows.groupBy("tree", part).agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("held"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumns({"before": F.coalesce(F.sum("held").over(before), F.lit(0)), "size": F.sum("held").over(Window.partitionBy("tree"))})
    placed = rows.withColumn("part", part).join(held.select("tree", "part", "first", "before", "size"), ["tree", "part"])
    return placed.withColumn("at", F.col("row") - F.col("first") + F.col("before")).drop("part", "row", "first", "before")


def build(nodes: DataFrame, payload: list[str], order: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """(levels, tops) of every tree of ``nodes`` (tree, hash, the payload); tops: tree, hash, size.

    A level has a row for each run: tree, run, kids (hash and, on the lowest level, the payload, in order), hash, of
    (the runs of the tree on this level).  Trees of one node have no run.
    """
    low = _numbered(nodes, order)
    kid = F.struct("at", "hash", *payload)
    levels = []
    while True:
        runs = low.where("size > 1") if levels else low
        runs = runs.groupBy("tree", F.floor(F.col("at") / FANOUT).alias("run")).agg(F.sort_array(F.collect_list(kid)).alias("kids"), F.first("size").alias("size"))
        joined = F.array_join(F.transform("kids", lambda k: as_text(k["hash"])), "")
        # the lowest level keeps trees of one leaf, which is its own subroot
        value = F.when(F.col("size") > 1, digest(joined)).otherwise(F.col("kids")[0]["hash"])
        runs = stage(runs.select("tree", "run", "kids", value.alias("hash"), F.ceil(F.col("size") / FANOUT).alias("of"), "size"), f"level-{len(levels)}")
        levels.append(runs)
        if runs.where("of > 1").isEmpty():
            break
        low = runs.where("of > 1").select("tree", F.col("run").alias("at"), "hash", F.col("of").alias("size"))
        kid = F.struct("at", "hash")
    tops = [x.where("of = 1").select("tree", "hash") for x in levels]
    for t in tops[1:]:
        tops[0] = tops[0].union(t)
    return levels, tops[0]


def push(levels: list[DataFrame], tops: DataFrame, carry: list[str], payload: list[str]) -> DataFrame:
    """The lowest nodes with their proofs: tree, the payload, hash, proof, and the carried columns.

    ``tops``: tree, suffix (the proof of the tree's top) and the carried columns.
    """
    passed = None
    for k in range(len(levels) - 1, -1, -1):
        own = levels[k].where("of = 1").select("tree", "run").join(tops.select("tree", "suffix", *carry), "tree")
        inherited = own if passed is None else own.unionByName(passed)
        rows = levels[k].join(inherited, ["tree", "run"])
        beside = lambda take: F.array_join(F.transform(F.filter("kids", take), lambda x: F.hex(x["hash"])), "")
        rows = rows.withColumn("kid", F.explode("kids"))
        at = F.col("kid.at")
        step = F.struct(F.unhex(beside(lambda x: x["at"] < at)).alias("left"), F.unhex(beside(lambda x: x["at"] > at)).alias("right"))
        proof = F.when(F.col("size") > 1, F.concat(F.array(step), "suffix")).otherwise(F.col("suffix"))
        rows = rows.withColumn("proof", proof)
        if k:
            passed = stage(rows.select("tree", at.alias("run"), F.col("proof").alias("suffix"), *carry), f"proofs-{k}")
    return rows.select("tree", *[F.col(f"kid.{c}").alias(c) for c in payload], F.col("kid.hash").alias("hash"), "proof", *carry)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf (hex text) and its proof lead to."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(as_text(s["left"]), h, as_text(s["right"])).cast("binary"), 256))


def proof_text(proof: Column) -> Column:
    """The siblings of a proof, leaf to root and left to right, as hex text."""
    return F.array_join(F.transform(proof, lambda s: F.concat(as_text(s["left"]), as_text(s["right"]))), "")


def manifest(leaves: DataFrame, payload: list[str], order: list[str]) -> DataFrame:
    """``leaves`` (source, hash, the payload) with subroot, root and proof.

    Leaves of a source follow each other by ``order``, sources by their UTF-8 bytes, null first.  ``proof`` is an
    array from the leaf up of what stands left and right of the node in its run (digests of 32 bytes end to end).
    Equal leaves take neighbouring places.  An empty table has no rows.
    """
    tree = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    levels, tops = build(leaves.withColumn("tree", tree).drop("source"), payload, order)
    sources, top = build(tops.select(F.lit("").alias("tree"), "hash", F.col("tree").alias("name")), ["name"], ["name"])
    roots = push(sources, top.select("tree", F.array().cast(STEP).alias("suffix"), F.col("hash").alias("root")), ["root"], ["name"])
    roots = stage(roots.select(F.col("name").alias("tree"), F.col("hash").alias("subroot"), "root", F.col("proof").alias("suffix")), "roots")
    drop_stage(*sources)
    out = push(levels, roots, ["subroot", "root"], payload)
    source = F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30))
    return out.select(source.alias("source"), *payload, "hash", "subroot", "root", "proof")


def tampered(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def document_manifest(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, leaf, subroot, root, proof, proof_sha256, folded_root, verified.

    The leaf is the digest of doc_id, source, lang, n_chars and text; any of them may be null.  Rows without id come
    first in their source and are never tampered with; rows with equal ids follow each other by their digests.  Where 5
    divides the unsigned crc32 of the decimal id, the text is read again with A-Z lower-cased, and ``folded_root`` is
    what that leaf and the untouched siblings lead to; elsewhere the leaf itself is folded.  Other columns are not read.
    """
    columns = ["doc_id", "source", "lang", "n_chars"]
    own = leaf_of(*map(F.col, columns), F.col("text"))
    again = F.when(tampered(F.col("doc_id")), leaf_of(*map(F.col, columns), F.translate("text", _UPPER, _LOWER)))
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", own.alias("hash"), again.alias("again"))
    # ``row`` parts equal rows between partitions, however many there are
    leaves = stage(leaves.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    m = manifest(leaves, ["doc_id", "again"], ["doc_id", "hash", "tie"])
    m = m.select("doc_id", as_text(F.col("hash")).alias("leaf"), as_text(F.col("subroot")).alias("subroot"), as_text(F.col("root")).alias("root"), "proof", as_text(F.coalesce("again", "hash")).alias("seen"))
    m = m.withColumns({"proof_sha256": F.sha2(proof_text(F.col("proof")).cast("binary"), 256), "folded_root": fold(F.col("seen"), F.col("proof"))})
    return m.withColumn("verified", F.col("folded_root") == F.col("root")).drop("seen")


def _level_sql(k: int, name: str) -> str:
    """One level of tree ``name``: runs of the nodes of level k, where a tree has more than one."""
    return f""", {name}{k + 1} AS (SELECT s, o // 16 AS o, sha256(string_agg(h, '' ORDER BY o)) AS h, max(c) AS below FROM (SELECT *, count(*) OVER (PARTITION BY s) AS c FROM {name}{k}) WHERE c > 1 GROUP BY s, o // 16),
  {name}p{k} AS (SELECT s, o, h, c, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM (SELECT *, count(*) OVER (PARTITION BY s) AS c FROM {name}{k}) WINDOW w AS (PARTITION BY s, o // 16 ORDER BY o))"""


def _oracle() -> str:
    deep, wide = 5, 3
    h = "sha256(coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') || coalesce(octet_length(encode({t})) || ':' || {t}, '-'))"
    lower = f"translate(text, '{_UPPER}', '{_LOWER}')"
    crc = """ct AS (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM (SELECT unnest(range(256))::BIGINT AS i)),
  cl AS (SELECT list(v ORDER BY i) AS t FROM ct),
  cr AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(c // 256, t[(xor(c, x) % 256) + 1])), 4294967295) AS crc FROM (SELECT DISTINCT doc_id FROM documents) u, cl)"""
    sql = f"""WITH {crc}, lv AS (SELECT source AS s, doc_id, {h.format(t='text')} AS h, CASE WHEN crc % 5 = 0 THEN {h.format(t=lower)} END AS again FROM documents JOIN cr USING (doc_id)),
  lf AS (SELECT coalesce('=' || s, '') AS s, doc_id, h, again, row_number() OVER (PARTITION BY s ORDER BY doc_id, h) - 1 AS o FROM lv), a0 AS (SELECT s, o, h FROM lf)"""
    for k in range(deep):
        sql += _level_sql(k, "a")
    tops = " UNION ALL ".join(f"SELECT s, h FROM (SELECT *, count(*) OVER (PARTITION BY s) AS c FROM a{k}) WHERE c = 1" for k in range(deep + 1))
    sql += f", sub AS ({tops}), b0 AS (SELECT 0 AS s, row_number() OVER (ORDER BY encode(s)) - 1 AS o, h FROM sub), nm AS (SELECT s, h AS subroot, row_number() OVER (ORDER BY encode(s)) - 1 AS i FROM sub)"
    for k in range(wide):
        sql += _level_sql(k, "b")
    roots = " UNION ALL ".join(f"SELECT h FROM (SELECT h, count(*) OVER () AS c FROM b{k}) WHERE c = 1" for k in range(wide + 1))
    sql += f", rt AS (SELECT h AS root FROM ({roots}))"
    steps = [f"CASE WHEN a{k}.c > 1 THEN {{'l': a{k}.l, 'r': a{k}.r}} END" for k in range(deep)] + [f"CASE WHEN b{k}.c > 1 THEN {{'l': b{k}.l, 'r': b{k}.r}} END" for k in range(wide)]
    joins = " ".join(f"LEFT JOIN ap{k} a{k} ON a{k}.s = lf.s AND a{k}.o = lf.o // {16**k}" for k in range(deep)) + " JOIN nm ON nm.s = lf.s " + " ".join(f"LEFT JOIN bp{k} b{k} ON b{k}.o = i // {16**k}" for k in range(wide))
    sql += f""", pf AS (SELECT doc_id, lf.h AS leaf, subroot, root, coalesce(again, lf.h) AS seen, list_filter([{', '.join(steps)}], lambda x: x IS NOT NULL) AS p FROM lf {joins}, rt)
  SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(p, lambda x: x.l || x.r), ''), '')) AS proof_sha256, f AS folded_root, f = root AS verified
  FROM (SELECT *, list_reduce(list_prepend({{'l': seen, 'r': ''}}, p), lambda x, y: {{'l': sha256(y.l || x.l || y.r), 'r': ''}}).l AS f FROM pf)"""
    return sql


#: Five levels of a source (a million rows) and three of sources are spelled out.
ORACLE_SQL = _oracle()

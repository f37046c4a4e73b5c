"""Merkle manifest of a dataset: a digest tree per part, and a proof for every row.

Method: time-forward processing.  A node's label is its level and place, so a
parent's label follows those of its children.  A queue ordered by label delivers
each digest to the parent, whose label comes up once all its children are done;
the reversed sweep then delivers, from the root down, the suffix of the proof that
all leaves below a node share.

The queue is external: leaves are ranked within their tree and cut into blocks
of ``2 ** BLOCK`` neighbours.  Between blocks the messages are shuffled rows,
each task getting one block's label interval; inside a block, whose size is
bounded, they stand in a heap.  The roots of a layer's blocks are the leaves of the
next, so n rows need log(n) / BLOCK layers, and a part that holds most rows
is many blocks.  The parts' roots are the leaves of one more tree, swept in the same way.

Ranks come from a range-partitioned, sorted table and prefix sums over its
(partition, tree) counts: no window sees the rows themselves.  Only ids and digests are
shuffled, never texts.  Every layer is a table in the shared folder.

Defined results: a null field is hashed as ``-``; a null tree name is a tree of its
own, before all others; a null id comes first; rows that share an id stand by
leaf digest, and repeated rows each have a leaf; a tree of one leaf is that
leaf; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from functools import reduce
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cogroup_arrow, group_arrow, read, stored

BLOCK = 8       # levels swept by one task; blocks have two to this power leaves
PLACE = (1 << 33) - 1
PATH = "proof array<string>, subroot string, root string"


def framed(c: Column) -> Column:
    """A value as ``length:value`` (length in UTF-8 bytes), null as ``-``."""
    text = c.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: Iterable[Column]) -> Column:
    """The digest of a row's fields."""
    return F.sha2(F.concat(*map(framed, fields)), 256)


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rank`` (from 0) of each row within its tree ``t``, and the tree's size ``n``."""
    at = F.monotonically_increasing_id()
    rows = stored(rows.repartitionByRange("t", *order).sortWithinPartitions("t", *order)
                  .withColumns({"part": F.shiftright(at, 33), "place": at.bitwiseAND(PLACE)}), name)
    # One row per partition and tree, however many rows a tree has.
    counts = rows.groupBy("t", "part").agg(F.count(F.lit(1)).alias("c"), F.min("place").alias("first"))
    before = Window.partitionBy("t").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("t", "part", (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("first")).alias("shift"),
                           F.sum("c").over(Window.partitionBy("t")).alias("n"))
    return (rows.join(starts, ["t", "part"]).withColumn("rank", F.col("place") + F.col("shift"))
            .drop("part", "place", "shift"))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _levels(n: int) -> int:
    """Levels of a block above its leaves, in a layer of ``n`` nodes."""
    return min(BLOCK, (n - 1).bit_length())


def forward(digests: list[str], levels: int) -> dict[tuple[int, int], str]:
    """Digests of a block's nodes by label (level, place): messages to a node leave the
    queue together, children from left to right."""
    nodes = {(0, i): d for i, d in enumerate(digests)}
    queue = [((1, i >> 1), i & 1, d) for i, d in enumerate(digests)] if levels else []
    heapify(queue)
    while queue:
        label, _, got = heappop(queue)
        while queue and queue[0][0] == label:
            got += heappop(queue)[2]
        nodes[label] = digest = _sha(got)
        level, place = label
        if level < levels:
            heappush(queue, ((level + 1, place >> 1), place & 1, digest))
    return nodes


def reversed_sweep(nodes: dict[tuple[int, int], str], levels: int, suffix: list[str]) -> dict[int, list[str]]:
    """The proof of each leaf of a block, from the suffix of its root: siblings as ``L`` or
    ``R`` (their side) and digest, ``-`` where a node was hashed alone."""
    if not levels:
        return {0: suffix}
    queue = [((-levels, 0), suffix)]
    found = {}
    while queue:
        (level, place), path = heappop(queue)
        below, left = -level - 1, -place * 2
        for child, other, side in ((left, left + 1, "R"), (left + 1, left, "L")):
            if (below, child) not in nodes:
                continue
            sibling = nodes.get((below, other))
            sent = ["-" if sibling is None else side + sibling, *path]
            if below:
                heappush(queue, ((-below, -child), sent))
            else:
                found[child] = sent
    return found


def _block_root(block: pa.Table) -> pa.Table:
    block = block.sort_by("rank")
    n, rank = block["n"][0].as_py(), block["rank"][0].as_py()
    levels = _levels(n)
    root = forward(block["digest"].to_pylist(), levels)[levels, 0]
    return pa.table({"t": block["t"][:1], "rank": pa.array([rank >> BLOCK], pa.int64()),
                     "n": pa.array([-(-n >> BLOCK)], pa.int64()), "digest": [root]})


def _block_proofs(block: pa.Table, message: pa.Table) -> pa.Table:
    block = block.sort_by("rank")
    levels = _levels(block["n"][0].as_py())
    m = message.slice(0, 1).to_pylist()[0]
    found = reversed_sweep(forward(block["digest"].to_pylist(), levels), levels, m["proof"])
    return pa.Table.from_arrays(
        [*block.columns, pa.array([found[i] for i in range(block.num_rows)], pa.list_(pa.string())),
         *[pa.array([m[c]] * block.num_rows, pa.string()) for c in ("subroot", "root")]],
        names=[*block.column_names, "proof", "subroot", "root"])


def _in_blocks(layer: DataFrame):
    return layer.withColumn("block", F.shiftright("rank", BLOCK))


def climb(leaves: DataFrame) -> list[DataFrame]:
    """The layers of all trees, from the leaves (t, rank, n, digest) up; a tree's last layer has
    its root alone (n = 1)."""
    layers = [leaves]
    n = leaves.agg(F.max("n")).first()[0] or 0
    while n > 1:
        wide = _in_blocks(layers[-1].filter("n > 1").select("t", "rank", "n", "digest"))
        layers.append(stored(group_arrow(wide, ["t", "block"], _block_root, "t string, rank long, n long, digest string"),
                             "layer"))
        n = -(-n >> BLOCK)
    return layers


def roots(layers: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, [x.filter("n = 1").select("t", "digest") for x in layers])


def descend(layers: list[DataFrame], messages: DataFrame) -> DataFrame:
    """The leaves with ``proof``, ``subroot`` and ``root``, from a message per tree."""
    sent = None
    for depth in range(len(layers) - 1, -1, -1):
        layer = layers[depth]
        got = layer.filter("n = 1").join(messages, "t")
        if sent is not None:
            wide = _in_blocks(layer.filter("n > 1"))
            above = sent.select("t", F.col("rank").alias("block"), "proof", "subroot", "root")
            schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in wide.schema.fields), PATH])
            below = cogroup_arrow(wide, above, ["t", "block"], _block_proofs, schema).drop("block")
            got = got.select(*below.columns).unionAll(below)
        sent = stored(got, "proofs") if depth else got
    return sent


def manifest(docs: DataFrame, fields: dict[str, Column], id_col: str = "doc_id", tree_col: str = "lang",
             also: dict[str, Column] | None = None) -> DataFrame:
    """Per row: ``id``, ``tree``, ``leaf``, ``subroot`` (of its tree), ``root`` and ``proof`` (its siblings
    up to the root, see ``reversed_sweep``), and the columns of ``also`` (computed from the row)."""
    tree = F.col(tree_col).cast("string")
    also = {f"also_{k}": c for k, c in (also or {}).items()}
    rows = stored(docs.select(F.when(tree.isNull(), "").otherwise(F.concat(F.lit("="), tree)).alias("t"),
                              F.col(id_col).alias("id"), leaf(fields.values()).alias("digest"),
                              *[c.alias(k) for k, c in also.items()]), "leaves")
    layers = climb(stored(ranked(rows, ["id", "digest"], "sorted"), "ranked"))
    subroots = stored(roots(layers), "subroots")
    # The trees' roots are the leaves of the tree of trees; names as they sort: null first, then by bytes.
    top = climb(stored(ranked(subroots.select(F.lit("").alias("t"), F.col("t").alias("name"), "digest"), ["name"],
                              "sorted"), "ranked"))
    root = roots(top).select("t", F.array().cast("array<string>").alias("proof"), F.lit("").alias("subroot"),
                             F.col("digest").alias("root"))
    messages = stored(descend(top, root).select(F.col("name").alias("t"), "proof", F.col("digest").alias("subroot"), "root"),
                      "messages")
    out = descend(layers, messages)
    return out.select("id", F.when(F.col("t") != "", F.substring("t", 2, 1 << 30)).alias("tree"), F.col("digest").alias("leaf"),
                      "subroot", "root", "proof", *[F.col(k).alias(k[5:]) for k in also])


def siblings(proof: Column) -> Column:
    """The digest of a proof's siblings, level by level."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.substring(s, 2, 64)), ""), 256)


def fold(digest: Column, proof: Column) -> Column:
    """The root that a leaf digest and a proof lead to."""
    def step(now: Column, s: Column) -> Column:
        other = F.substring(s, 2, 64)
        return F.sha2(F.when(s.startswith("L"), F.concat(other, now)).otherwise(F.concat(now, other)), 256)
    return F.aggregate(proof, digest, step)


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    fields = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    touched = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    tampered = F.when(touched, leaf([*(fields | {"n_chars": F.col("n_chars") + 1}).values()]))
    out = manifest(docs, fields, also={"tampered": tampered})
    return (out.select("id", "leaf", "subroot", "root", siblings(F.col("proof")).alias("proof_sha256"),
                       fold(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root"))
            .select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root",
                    (F.col("folded_root") == F.col("root")).alias("verified")))


def _sql_framed(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"


def _sql_leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_sql_framed, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


# CRC-32 is spelt out: eight shifts a byte over the digits of the id.
OP11_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT *, list_reduce(
      list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
          lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), CAST(range(8) AS BIGINT[])),
          lambda c, k: xor(c // 2, (c % 2) * 3988292384))) AS state
  FROM documents),
leaves AS (
  SELECT doc_id, lang, {_sql_leaf("n_chars")} AS leaf,
         CASE WHEN xor(state, 4294967295) % 7 = 0 THEN {_sql_leaf("(n_chars + 1)")}
              ELSE {_sql_leaf("n_chars")} END AS shown
  FROM docs),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves),
nodes AS (
  SELECT lang, 0 AS level, place, leaf AS digest, count(*) OVER (PARTITION BY lang) AS n FROM placed
  UNION ALL
  SELECT lang, level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (n + 1) // 2
  FROM nodes WHERE n > 1 GROUP BY lang, level, place // 2, n),
subroots AS (
  SELECT lang, level AS height, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place
  FROM nodes WHERE n = 1),
top AS (
  SELECT 0 AS level, place, digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (n + 1) // 2
  FROM top WHERE n > 1 GROUP BY level, place // 2, n),
folded AS (
  SELECT p.doc_id, p.lang, p.place AS leaf_place, 0 AS step, p.leaf, p.shown AS now, '' AS proof
  FROM placed p
  UNION ALL
  SELECT f.doc_id, f.lang, f.leaf_place, f.step + 1, f.leaf,
         sha256(CASE WHEN (b.at // b.size) % 2 = 1 THEN coalesce(b.digest, '') || f.now
                     ELSE f.now || coalesce(b.digest, '') END),
         f.proof || coalesce(b.digest, '')
  FROM folded f JOIN subroots s ON f.lang IS NOT DISTINCT FROM s.lang,
       LATERAL (
         SELECT CASE WHEN f.step < s.height THEN f.leaf_place ELSE s.place END AS at,
                CASE WHEN f.step < s.height THEN 1 << least(f.step, 40) ELSE 1 << greatest(f.step - s.height, 0) END AS size,
                CASE WHEN f.step < s.height
                     THEN (SELECT max(n.digest) FROM nodes n WHERE n.lang IS NOT DISTINCT FROM f.lang AND n.level = f.step
                           AND n.place = xor(f.leaf_place // (1 << least(f.step, 40)), 1))
                     ELSE (SELECT max(t.digest) FROM top t WHERE t.level = f.step - s.height
                           AND t.place = xor(s.place // (1 << greatest(f.step - s.height, 0)), 1)) END AS digest) b
  WHERE f.step < s.height + (SELECT max(level) FROM top))
SELECT f.doc_id, f.leaf, s.digest AS subroot, r.digest AS root, sha256(f.proof) AS proof_sha256,
       f.now AS folded_root, f.now = r.digest AS verified
FROM folded f JOIN subroots s ON f.lang IS NOT DISTINCT FROM s.lang,
     (SELECT digest FROM top WHERE n = 1) r
WHERE f.step = s.height + (SELECT max(level) FROM top)
"""

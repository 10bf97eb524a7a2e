"""Problem 9: a mixture of sources in target shares, by hierarchical budgets.

Sizes are tokens of a public tokenizer. Records hang under a tree of levels (here source, then language). A budget goes down from the
root: each node's children share it by weight; what a child can't fill, even with its allowed repeats, goes to its siblings, and
only what all siblings can't fill is missing at the parent, whose own siblings then take it. Each leaf takes whole
passes (epochs) over its records, and of its last epoch the prefix of a seeded order that fills the rest.

The prefix is found without sorting a leaf: records fall into many hash slices, slices are summed before anything moves, and
only the slice in which the budget ends is ordered.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postmill.llm.common import materialise, strings, table

TOKENIZERS = "/opt/tokenizers"
# Fixed value: the public pre-tokenisation pattern of the 50k byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(maxsize=2)
def encoder(folder: str, name: str):
    import base64

    import tiktoken

    with open(f"{folder}/{name}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, col: str, out: str, folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Add ``out``: the number of tokens of ``col``; 0 for NULL and empty texts."""
    schema = df.select(*[c for c in df.columns if c != out]).withColumn(out, F.lit(0).cast("long")).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder, name).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) for t in strings(batch[col]).to_pylist()]
            keep = [c for c in batch.schema.names if c != out]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(n, pa.int64())], [*keep, out])

    return df.mapInArrow(count, schema)


def fill(weights: list[float], room: list[float], budget: float) -> list[float]:
    """Parts of ``budget`` by weight, none above its room; what a full child leaves goes to the others by weight."""
    parts, open_ = [0.0] * len(weights), [i for i, w in enumerate(weights) if w > 0 and room[i] > 0]
    left = min(budget, sum(room[i] for i in open_))
    while open_ and left > 1e-9:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if parts[i] + left * weights[i] / total >= room[i] - 1e-9]
        if not full:
            for i in open_:
                parts[i] += left * weights[i] / total
            break
        for i in full:
            left -= room[i] - parts[i]
            parts[i] = room[i]
        open_ = [i for i in open_ if i not in full]
    return parts


def leaf_budgets(leaves: list[tuple[tuple, tuple, float]], budget: float, root: bool = True) -> dict[tuple, float]:
    """(path, weights along the path, room) of each leaf -> its budget.

    A child of the root has its own weight, the same for all its leaves; deeper down a node's weight is the sum of its leaves' weights.
    """
    if not leaves:
        return {}
    if not leaves[0][0]:
        return {(): min(budget, leaves[0][2])}
    children: dict = {}
    for path, weights, room in leaves:
        children.setdefault(path[0], ([], []))
        children[path[0]][0].append(weights[0])
        children[path[0]][1].append((path[1:], weights[1:], room))
    names = list(children)
    parts = fill([max(children[k][0]) if root else sum(children[k][0]) for k in names], [sum(x[2] for x in children[k][1]) for k in names], budget)
    return {(k, *p): b for k, part in zip(names, parts) for p, b in leaf_budgets(children[k][1], part, False).items()}


def mixture(sized: DataFrame, key: str, size: str, path: list[str], targets: DataFrame, share: str, repeats: str, budget: float | None = None, seed: int = 17, slice_rows: int = 50_000) -> DataFrame:
    """How often each record is used: (key, path columns, size, uses), records in use only.

    ``path`` names the levels from the root; ``targets`` has a row for each value of the first level with its share and the most
    uses of a record. Deeper levels are weighted by their tokens. Sources without a target get nothing, targets without records leave
    their share to the others. ``budget`` is in tokens; by default it is the tokens of all sources with a target, each counted once. NULL in a level is a value
    of its own; a NULL share or number of repeats counts as 0 and 1. Records of size 0 are never used. A record that appears
    in several rows counts as several records. Repeated targets: the largest share and number hold.
    """
    goal = targets.groupBy(F.col(path[0]).alias("_p0")).agg(F.max(F.coalesce(share, F.lit(0.0))).alias("_share"), F.max(F.coalesce(repeats, F.lit(1))).cast("int").alias("_most"))
    keep = [key, *path, size]
    rows = sized.where(F.col(size) > 0).select(*keep)
    hashed = F.xxhash64(F.lit(seed), F.col("_epoch"), key)
    sums = rows.groupBy(*path).agg(F.sum(size).alias("_tokens"), F.count("*").alias("_rows")).join(goal, F.col(path[0]) == F.col("_p0"))
    # One row for each leaf of the tree; their number does not follow the number of records.
    leaves = [r for r in sums.where("_share > 0 and _most > 0").collect()]
    given = leaf_budgets(
        [(tuple(r[c] for c in path), (r["_share"], *[float(r["_tokens"])] * (len(path) - 1)), float(r["_tokens"] * r["_most"])) for r in leaves],
        sum(r["_tokens"] for r in leaves) if budget is None else budget,
    )
    plan = []
    for r in leaves:
        b = given[tuple(r[c] for c in path)]
        whole = min(r["_most"], int((b + 1e-6) // r["_tokens"]))
        rest = b - whole * r["_tokens"] if whole < r["_most"] else 0.0
        plan.append((*[r[c] for c in path], whole, float(rest), max(1, -(-r["_rows"] // slice_rows) * 8)))
    schema = ", ".join([*(f"_l{i} {rows.schema[c].dataType.simpleString()}" for i, c in enumerate(path)), "_epoch int", "_rest double", "_slices int"])
    plan = F.broadcast(rows.sparkSession.createDataFrame(plan, schema))
    same = [F.col(c).eqNullSafe(F.col(f"_l{i}")) for i, c in enumerate(path)]
    used = rows.join(plan, same).withColumn("_h", hashed).withColumn("_slice", F.expr("pmod(_h, _slices)"))
    # Tokens before each slice, from sums of slices.
    slices = used.where("_rest > 0").groupBy(*path, "_slice").agg(F.sum(size).alias("_in"))
    slices = slices.withColumn("_before", F.sum("_in").over(Window.partitionBy(*path).orderBy("_slice")) - F.col("_in"))
    slices = slices.select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(path)], F.col("_slice").alias("_sl"), "_in", "_before")
    placed = used.join(slices, [F.col(c).eqNullSafe(F.col(f"_s{i}")) for i, c in enumerate(path)] + [F.col("_slice") == F.col("_sl")], "left")
    inside = placed.where("_before is null or _before + _in <= _rest or _before >= _rest").withColumn("_more", F.when(F.expr("_before + _in <= _rest"), 1).otherwise(0))
    split = placed.where("_before < _rest and _before + _in > _rest")
    upto = F.sum(size).over(Window.partitionBy(*path, "_slice").orderBy("_h", key)) + F.col("_before")
    split = split.withColumn("_upto", upto).withColumn("_more", F.when(F.expr(f"_upto - `{size}` / 2 <= _rest"), 1).otherwise(0)).drop("_upto")
    return inside.unionByName(split).withColumn("uses", F.col("_epoch") + F.col("_more")).where("uses > 0").select(*keep, "uses")


def sized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return token_counts(docs, "text", "tokens").drop("text")


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used in the mixture."""
    sized = materialise(sized_documents(spark, sf_dir))
    return mixture(sized, "doc_id", "tokens", ["source", "lang"], table(spark, sf_dir, "source_targets"), "target_share", "max_repeats")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source with a target."""
    used = materialise(p9_mixture(spark, sf_dir).groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("documents"), F.max("uses").alias("most_uses")))
    rows = table(spark, sf_dir, "source_targets").join(used, "source", "left")
    total = F.lit(used.agg(F.sum("tokens")).first()[0])  # one number
    return rows.select("source", "target_share", (F.coalesce("tokens", F.lit(0)) / total).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"))


QUERIES = {"p9_mixture": p9_mixture, "p9_shares": p9_shares}
ORACLE: dict[str, str] = {}

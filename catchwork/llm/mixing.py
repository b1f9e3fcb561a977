"""Mixing sources to target weights along a domain, language, source tree; DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catchwork.frames import prefix_sum, written

LEVELS = ("domain", "lang", "source")


def default_domain() -> Column:
    """The domain of a source where the table has none: one of four by the source's checksum."""
    return F.concat(F.lit("domain"), F.pmod(F.crc32(F.coalesce("source", F.lit(""))), F.lit(4)).cast("string"))


def _weight(level: str, weights: dict[str, float]) -> Column:
    """The stated weight of a node's own name, else 1."""
    out = F.lit(1.0)
    for name, value in sorted(weights.items()):
        out = F.when(F.col(level) == name, F.lit(float(value))).otherwise(out)
    return out


def _filled(nodes: DataFrame, parents: list[str]) -> DataFrame:
    """Shares each parent's `budget` among its children by weight, none over its `room`: what one cannot take goes to its siblings.

    With children in the order of room / weight, those before the first whose even share would not fill them take their room; the
    others split what is left by weight. Windows run over the children of one parent.
    """
    order = Window.partitionBy(*parents).orderBy("ratio", *LEVELS) if parents else Window.partitionBy(F.lit(0)).orderBy("ratio", *LEVELS)
    before, behind = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    rows = nodes.withColumn("ratio", F.col("room") / F.col("weight"))
    rows = rows.withColumn("_full", F.coalesce(F.sum("room").over(before), F.lit(0)).cast("double")).withColumn("_open", F.sum("weight").over(behind))
    level = (F.col("budget") - F.col("_full")) / F.col("_open")  # even share of each unit of weight if this one and all after it stay unfilled
    rows = rows.withColumn("_level", F.when(F.col("ratio") >= level, level))
    first = F.max("_level").over(Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0)))  # levels fall after the first
    return rows.withColumn("share", F.least(F.col("room").cast("double"), F.coalesce(first * F.col("weight"), F.col("room").cast("double"))))


def mix_sources(docs: DataFrame, budget_share: float = 0.6, epochs: int = 2, weights: dict[str, dict[str, float]] | None = None, seed: str = "mix-1", domain: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of a mix: one row for each chosen document and epoch, with columns domain, lang, source, doc_id, epoch, n_tokens, upto, leaf_tokens and text_hash.

    A token is a run of text without ASCII white space; the budget is floor(budget_share * all tokens). weights gives, for each of the levels
    domain, lang and source, weights by name (1 where none is stated). The budget goes down the tree by weight; a leaf
    holds at most epochs times its tokens, an inner node what its leaves hold. Shortages are shared among siblings first and
    reach the parent's siblings only when all of them are full. A leaf's documents lie in the order of a seeded hash, another one in
    each epoch, epoch after epoch; the leaf takes the longest prefix within floor(its share). Ties in the hash go by doc_id,
    then text hash. Null lang or source become the names '(null)'. A null text has no tokens; rows without tokens are not chosen.
    Repeated rows count each. An empty table gives an empty one. Each leaf is cut into hash ranges, so a source with a
    third of all rows spans many tasks.
    """
    weights = weights or {}
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = [F.coalesce(F.col(c), F.lit("(null)")).alias(c) for c in ("lang", "source")]
    tokens = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = docs.select((domain if domain is not None else default_domain()).alias("domain"), *named, F.col(id_col).cast("long").alias("doc_id"), tokens.alias("n_tokens"), F.md5(text).alias("text_hash"))
    rows = written(rows.where("n_tokens > 0"), "mix_rows")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("leaf_tokens")).withColumn("room", F.col("leaf_tokens") * epochs)
    leaves = written(leaves, "mix_leaves")
    total = leaves.agg(F.coalesce(F.sum("leaf_tokens"), F.lit(0))).first()[0]
    budget = float(int(budget_share * total + 1e-6))
    parents: list[str] = []
    shares = None
    for level in LEVELS:
        keys = [*parents, level]
        nodes = leaves.groupBy(*keys).agg(F.sum("room").alias("room")).withColumn("weight", _weight(level, weights.get(level, {})))
        nodes = nodes.withColumn("budget", F.lit(budget)) if shares is None else nodes.join(shares, parents)
        for missing in LEVELS[len(keys) :]:
            nodes = nodes.withColumn(missing, F.lit(""))
        shares = _filled(nodes, parents).select(*keys, F.col("share").alias("budget"))
        parents = keys
    goal = written(shares.select(*LEVELS, F.floor(F.col("budget") + 1e-6).alias("goal")).join(leaves.select(*LEVELS, "leaf_tokens"), list(LEVELS)), "mix_goals")
    n_rows = rows.count()
    wanted = rows.join(goal, list(LEVELS)).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    wanted = wanted.where(F.col("epoch") * F.col("leaf_tokens") < F.col("goal"))  # epochs that the share does not reach
    order = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "epoch", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    wanted = wanted.withColumn("_h", order)
    summed = prefix_sum(wanted, [*LEVELS, "epoch"], "_h", ["doc_id", "text_hash"], F.col("n_tokens"), "_in_epoch", n_rows * epochs)
    upto = F.col("epoch") * F.col("leaf_tokens") + F.col("_in_epoch")
    return summed.withColumn("upto", upto).where(F.col("upto") <= F.col("goal")).select(*LEVELS, "doc_id", F.col("epoch").cast("int").alias("epoch"), "n_tokens", "upto", "leaf_tokens", "text_hash")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that mix_sources chooses, once for each epoch that chooses them. All columns stay, whatever they are called.

    Rows equal in doc_id, text, lang and source are one choice: the first of them stands for all. Null ids, texts, langs and sources are treated
    as in mix_sources.
    """
    def keyed(x: DataFrame, *more: Column) -> DataFrame:
        """x with a 128-bit key of what makes a choice, nulls told apart, so that the join's order serves for taking the first row, too."""
        parts = [F.col("own"), F.isnull("own"), F.col("hash"), F.col("lang"), F.col("source")]
        return x.select(*more, F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit(1), *parts).alias("k2"))

    none = F.lit("(null)")
    chosen = mix_sources(docs, **options).groupBy(F.col("doc_id").alias("own"), F.col("text_hash").alias("hash"), "lang", "source").agg(F.count("*").cast("int").alias("times"))
    chosen = written(keyed(chosen, F.col("times")), "mix_chosen")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own"), F.md5(F.coalesce("text", F.lit(""))).alias("hash"), F.coalesce("lang", none).alias("lang"), F.coalesce("source", none).alias("source"))
    once = keyed(rows, F.col("row")).join(chosen, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    return once.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")

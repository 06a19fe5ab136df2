"""Mixing sources to target weights over a domain / language / source tree.

A token budget goes down the tree by weight.  A child gets at most what its
subtree can supply in ``max_epochs`` passes; what it can't take goes to its
siblings by weight, and only what they can't take either stays with the
parent's siblings, since a parent's share is bounded by its subtree first.
Each leaf then takes whole epochs, and from one more epoch, in an order
seeded by (seed, epoch, doc_id), the prefix of documents that holds the
rest of its quota; the last of these is taken in part (``taken`` tokens).

Shares are closed-form window expressions over the leaves, one row a leaf.
The prefix is a distributed running sum: rows are range-partitioned by
(leaf, seeded key), so a leaf with a third of all rows spans many tasks.

Tokens are words ``[^\\x20\\x09-\\x0D]+``.  Null texts have none and null tree
keys count as ''.  Equal doc_ids are separate rows of the leaf.  A document
without tokens is taken where its place lies before the quota's end.  An
empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepcorpus.session import materialize

LEVELS = ("domain", "lang", "source")
SEED = 17
SHARE = 0.8  # of all tokens: the budget
MAX_EPOCHS = 4
WEIGHTS = {"lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 1.0}}  # by level and name; others weigh 1


def n_words(text: str = "text") -> Column:
    return F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("long")


def domain_of(source: str = "source") -> Column:
    """The first digit of a source's name: the domain where no column gives one."""
    return F.regexp_extract(F.coalesce(F.col(source), F.lit("")), r"^\D*(\d)", 1)


def _weight(level: str, weights: Mapping[str, Mapping[str, float]]) -> Column:
    out = F.lit(1.0)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(float(w))).otherwise(out)
    return out


def budgets(leaves: DataFrame, budget: float, max_epochs: int = MAX_EPOCHS, weights: Mapping = WEIGHTS, levels: Sequence[str] = LEVELS) -> DataFrame:
    """``leaves`` (levels and ``tokens``) with each leaf's whole ``quota``."""
    out = leaves.withColumn("_cap", (F.col("tokens") * max_epochs).cast("double"))
    out = out.withColumn("_share", F.least(F.lit(float(budget)), F.coalesce(F.sum("_cap").over(Window.partitionBy()), F.lit(0.0))))  # a row a leaf
    for depth, level in enumerate(levels):
        parent = list(levels[:depth])
        node = out.groupBy(*parent, level).agg(F.sum("_cap").alias("c"), F.first("_share").alias("b")).withColumn("w", _weight(level, weights))
        whole = Window.partitionBy(*parent)
        before = whole.orderBy(F.col("c") / F.col("w"), level).rowsBetween(Window.unboundedPreceding, -1)
        node = (node.withColumn("c0", F.coalesce(F.sum("c").over(before), F.lit(0.0))).withColumn("w0", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
                .withColumn("full", F.col("c") * (F.sum("w").over(whole) - F.col("w0")) <= F.col("w") * (F.col("b") - F.col("c0"))))
        spare = F.col("b") - F.coalesce(F.sum(F.when(F.col("full"), F.col("c"))).over(whole), F.lit(0.0))
        given = F.when(F.col("full"), F.col("c")).otherwise(F.col("w") * spare / F.sum(F.when(~F.col("full"), F.col("w"))).over(whole))
        out = out.drop("_share").join(node.select(*parent, level, given.alias("_share")), [*parent, level])
    return out.withColumn("quota", F.floor(F.round("_share", 3)).cast("long")).drop("_cap", "_share")


def running_starts(rows: DataFrame, group: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """``rows`` with ``start``: the sum of ``value`` over the rows before, in ``order``, of the same group."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(rows.repartitionByRange(n, *group, *order).withColumn("_part", F.spark_partition_id()), "ordered")
    sums = placed.groupBy("_part", *group).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = sums.select("_part", *group, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)  # within one partition's rows
    return (placed.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(offsets, ["_part", *group])
            .withColumn("start", F.col("_before") + F.col("_inside")).drop("_part", "_before", "_inside"))


def mix(docs: DataFrame, domain: Column | None = None, share: float = SHARE, max_epochs: int = MAX_EPOCHS, weights: Mapping = WEIGHTS, seed: int = SEED) -> DataFrame:
    """doc_id, domain, lang, source, epoch, n_tokens, taken: every document and epoch that the mix takes."""
    domain = domain if domain is not None else F.coalesce(F.col("domain"), F.lit("")) if "domain" in docs.columns else domain_of()
    rows = materialize(docs.select("doc_id", domain.alias("domain"), *(F.coalesce(c, F.lit("")).alias(c) for c in LEVELS[1:]), n_words().alias("n_tokens")), "mix-rows")
    leaves = materialize(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    quotas = materialize(budgets(leaves, float(int(share * total)), max_epochs, weights).filter("tokens > 0")
                         .select(*LEVELS, F.expr("quota div tokens").alias("full"), (F.col("quota") % F.col("tokens")).alias("rest")), "quotas")
    keyed = materialize(rows.join(quotas, list(LEVELS)).withColumn("key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full"), F.col("doc_id")))), "mix-keyed")
    placed = running_starts(keyed, LEVELS, ["key", "doc_id", "n_tokens"], "n_tokens")
    taken = F.when(F.col("start") < F.col("rest"), F.least("n_tokens", F.col("rest") - F.col("start")))
    epochs = F.concat(F.when(F.col("full") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("full") - 1), lambda e: F.struct(e.alias("epoch"), F.col("n_tokens").alias("taken"))))
                      .otherwise(F.array().cast("array<struct<epoch:bigint,taken:bigint>>")),
                      F.when(F.col("_taken").isNotNull(), F.array(F.struct(F.col("full").alias("epoch"), F.col("_taken").alias("taken"))))
                      .otherwise(F.array().cast("array<struct<epoch:bigint,taken:bigint>>")))
    return placed.withColumn("_taken", taken).select("doc_id", *LEVELS, "n_tokens", F.explode(epochs).alias("e")).select("doc_id", *LEVELS, "e.epoch", "n_tokens", "e.taken")


def take(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, once for each epoch, so that a leaf's words are its quota: the last
    document of a leaf's prefix is cut after its ``taken`` words (and ``n_chars``, where there is one, follows).
    Rows that share a doc_id are taken together, each of at most the words that any of them gives."""
    picked = mix(docs, **options).groupBy(F.col("doc_id").alias("_id"), F.col("epoch").alias("_epoch")).agg(F.max("taken").alias("_taken"), F.max(F.col("taken") < F.col("n_tokens")).alias("_cut"))
    rows = docs.join(picked, docs["doc_id"].eqNullSafe(picked["_id"]))
    whole = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # a word and what stands before it
    text = F.when(F.col("_cut"), F.array_join(F.slice(whole, 1, F.col("_taken").cast("int")), "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("_cut"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def _level_sql(depth: int) -> str:
    parent, level = LEVELS[:depth], LEVELS[depth]
    by = f"partition by {', '.join(parent)} " if parent else ""
    keys = ", ".join([*parent, level])
    weight = " ".join(f"when {level} = '{k}' then {v}" for k, v in WEIGHTS.get(level, {}).items())
    weight = f"case {weight} else 1.0 end" if weight else "1.0"
    before = f"{by}order by c / w, {level} rows between unbounded preceding and 1 preceding"
    old, new = f"s{depth}", f"s{depth + 1}"
    return f"""
n{depth} as (select {keys}, sum(cap) c, first(share) b, ({weight})::double w from {old} group by {keys}),
p{depth} as (select *, coalesce(sum(c) over ({before}), 0) c0, coalesce(sum(w) over ({before}), 0) w0, sum(w) over ({by}) w1 from n{depth}),
f{depth} as (select *, c * (w1 - w0) <= w * (b - c0) as is_full from p{depth}),
g{depth} as (select {keys}, case when is_full then c else w * (b - coalesce(sum(c) filter (is_full) over ({by}), 0)) / sum(w) filter (not is_full) over ({by}) end given from f{depth}),
{new} as (select {old}.* exclude (share), given share from {old} join g{depth} using ({keys})),"""


SQL = f"""
with r as (select doc_id, regexp_extract(coalesce(source, ''), '^\\D*(\\d)', 1) as domain, coalesce(lang, '') lang, coalesce(source, '') as source,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint n_tokens from documents),
l as (select domain, lang, source, sum(n_tokens)::bigint tokens from r group by all),
s0 as (select *, (tokens * {MAX_EPOCHS})::double cap, least(floor({SHARE} * (select sum(tokens)::double from l)), sum((tokens * {MAX_EPOCHS})::double) over ()) share from l),
{''.join(_level_sql(d) for d in range(3))}
q as (select domain, lang, source, (floor(round(share, 3))::bigint // tokens) as whole, floor(round(share, 3))::bigint % tokens as rest from s3 where tokens > 0),
k as (select r.*, whole, rest, md5(concat_ws(':', '{SEED}', whole, doc_id)) as seeded from r join q using (domain, lang, source)),
o as (select *, coalesce(sum(n_tokens) over (partition by domain, lang, source order by seeded, doc_id, n_tokens rows between unbounded preceding and 1 preceding), 0) as start from k)
select doc_id, domain, lang, source, e as epoch, n_tokens, n_tokens as taken from o, unnest(generate_series(0, whole - 1)) u(e)
union all select doc_id, domain, lang, source, whole as epoch, n_tokens, least(n_tokens, rest - start)::bigint as taken from o where start < rest
"""

"""Mixing sources to target weights by hierarchical budgeting over a domain-language-source tree.

Leaves are (domain, lang, source). The token budget goes down the tree by weight; a child that holds less than its
share (its tokens times ``max_epochs``) is filled up, and what is left goes to its siblings by their weights; as a
parent never gets more than its leaves hold, a shortage reaches an ancestor only when no sibling can take it. Each leaf
is read in seeded epochs: whole ones first, then the prefix of the next in the order of a seeded hash. Prefix sums
are taken over 256 ranges of the hash first, so that a leaf with a third of all rows is sorted in 256 parts. All
arithmetic is in whole numbers, so results don't depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metascrub.llm import store

#: Fixed values of the registered query: weights of the four domains and of languages; others weigh 1, as all sources do.
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANG_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 2}
SHARE = (6, 10)  #: the budget as a share of all tokens
SEED, MAX_EPOCHS = 17, 4
LEVELS = ("domain", "lang", "source")


def domain() -> Column:
    """The domain of a source: by the last character of its name, in four groups."""
    last = F.right(F.coalesce(F.col("source"), F.lit("")), F.lit(1))
    return F.concat(F.lit("d"), F.when(last == "", 0).otherwise(F.ascii(last) % 4))


def weight(column: str, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for k, v in weights.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


def _share(children: DataFrame, parent: list[str], budget: str, name: str) -> DataFrame:
    """children with ``got``: their parts of the parent's budget, by weight w, at most their capacity cap each."""
    by = Window.partitionBy(*parent)
    order = by.orderBy(F.col("cap") / F.col("w"), name)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    df = children.withColumn("_full", F.col("cap") * rest <= F.col("w") * (F.col(budget) - before))
    full = F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(by), F.lit(0))
    open_ = F.sum(F.when(~F.col("_full"), F.col("w"))).over(by)
    df = df.withColumns({"_done": full, "_open": open_})
    return df.withColumn("got", F.expr(f"if(_full, cap, (w * ({budget} - _done)) div _open)")).drop("_full", "_done", "_open")


def budgets(leaves: DataFrame, share: tuple[int, int], max_epochs: int, domain_weights: dict, lang_weights: dict) -> DataFrame:
    """leaves (domain, lang, source, tokens) with got, their budgets."""
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    weights = {"domain": weight("domain", domain_weights), "lang": weight("lang", lang_weights), "source": F.lit(1)}
    total = leaves.agg(F.expr(f"sum(tokens) * {share[0]} div {share[1]}").alias("budget"))
    top = leaves.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("w", weights["domain"]).join(F.broadcast(total))  # one row
    have = _share(top.withColumn("all", F.lit(1)), ["all"], "budget", "domain").select("domain", F.col("got").alias("budget"))
    mid = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).withColumn("w", weights["lang"]).join(have, "domain")
    have = _share(mid, ["domain"], "budget", "lang").select("domain", "lang", F.col("got").alias("budget"))
    low = leaves.withColumn("w", weights["source"]).join(have, ["domain", "lang"])
    return _share(low, ["domain", "lang"], "budget", "source").select(*LEVELS, "tokens", "got")


def mix(docs: DataFrame, share: tuple[int, int] = SHARE, seed: int = SEED, max_epochs: int = MAX_EPOCHS, domain_weights: dict = DOMAIN_WEIGHTS, lang_weights: dict = LANG_WEIGHTS, domain_of: Column | None = None) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, epoch, shuffle_key: each reading of each selected row; a leaf's readings in
    the order of (epoch, shuffle_key) are its part of the mixture.

    Tokens are words between ASCII white space. Null lang or source count as the empty name. Rows without a token (null,
    empty and blank texts) or with a null doc_id are never selected. Rows that share a doc_id are rows of their own,
    in the order of their tokens. Extra columns are ignored; an empty table gives no rows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.filter("doc_id is not null").select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), (domain_of if domain_of is not None else domain()).alias("domain"),
        F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("n_tokens"))
    rows = store.saved(rows.filter("n_tokens > 0"), "mixing")
    leaves = budgets(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), share, max_epochs, domain_weights, lang_weights)
    leaves = leaves.select(*LEVELS, F.expr("cast(got div tokens as int)").alias("epochs"), F.expr("got % tokens").alias("rest"))
    leaves = store.saved(leaves, "mixing-leaves")  # of a written table Spark knows the size, and sends it to all tasks only if it is small
    key = lambda epoch: F.md5(F.concat_ws("|", F.lit(str(seed)), epoch, F.col("doc_id")).cast("binary"))
    out = rows.join(leaves, list(LEVELS))
    whole = out.filter("epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1))).withColumn("shuffle_key", key(F.col("epoch")))
    part = out.filter("rest > 0").withColumn("epoch", F.col("epochs")).withColumn("shuffle_key", key(F.col("epochs"))).withColumn("_range", F.substring("shuffle_key", 1, 2))
    sums = part.groupBy(*LEVELS, "_range").agg(F.sum("n_tokens").alias("_sum"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.partitionBy(*LEVELS).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*LEVELS, "_range").orderBy("shuffle_key", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    part = part.join(sums, [*LEVELS, "_range"]).withColumn("_upto", F.col("_before") + F.sum("n_tokens").over(inside)).filter("_upto <= rest")
    columns = ["doc_id", *LEVELS, "n_tokens", "epoch", "shuffle_key"]
    return whole.select(columns).unionByName(part.select(columns))


def op10_mixing_sources(spark, sf_dir: str) -> DataFrame:
    """The mixture of all documents at 60 % of their tokens."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _case(column: str, weights: dict[str, int]) -> str:
    return "case " + " ".join(f"when {column} = '{k}' then {v}" for k, v in weights.items()) + " else 1 end"


def _share_sql(source: str, parent: str, name: str) -> str:
    return f"""select *, case when is_full then cap else (w * (budget - done)) // open_w end as got from (
      select *, coalesce(sum(case when is_full then cap end) over (partition by {parent}), 0)::bigint as done, (sum(case when not is_full then w end) over (partition by {parent}))::bigint as open_w from (
        select *, cap * rest_w <= w * (budget - before) as is_full from (
          select *, coalesce(sum(cap) over (partition by {parent} order by cap / w, {name} rows between unbounded preceding and 1 preceding), 0)::bigint as before,
            (sum(w) over (partition by {parent} order by cap / w, {name} rows between current row and unbounded following))::bigint as rest_w from ({source}))))"""


ORACLE = rf"""
with rows_ as (
  select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    'd' || (case when coalesce(source, '') = '' then 0 else ascii(right(source, 1)) % 4 end) as domain,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::bigint as n_tokens
  from documents where doc_id is not null and text is not null),
toks as (select * from rows_ where n_tokens > 0),
leaves as (select domain, lang, source, sum(n_tokens)::bigint as tokens, sum(n_tokens)::bigint * {MAX_EPOCHS} as cap from toks group by all),
total as (select (sum(tokens)::bigint * {SHARE[0]}) // {SHARE[1]} as budget from leaves),
top as (select domain, got as t_budget from ({_share_sql(f"select domain, sum(cap)::bigint as cap, {_case('domain', DOMAIN_WEIGHTS)} as w, 1 as all_, (select budget from total) as budget from leaves group by domain", "all_", "domain")})),
mid as (select domain, lang, got as m_budget from ({_share_sql(f"select domain, lang, sum(cap)::bigint as cap, {_case('lang', LANG_WEIGHTS)} as w, any_value(t_budget) as budget from leaves join top using (domain) group by domain, lang", "domain", "lang")})),
low as (select domain, lang, source, (got // tokens)::int as epochs, got % tokens as rest from ({_share_sql("select domain, lang, source, tokens, cap, 1 as w, m_budget as budget from leaves join mid using (domain, lang)", "domain, lang", "source")})),
own as (select * from toks join low using (domain, lang, source)),
whole as (select doc_id, domain, lang, source, n_tokens, unnest(range(epochs))::int as epoch from own),
part as (select doc_id, domain, lang, source, n_tokens, epochs as epoch, rest, md5('{SEED}|' || epochs || '|' || doc_id) as shuffle_key from own where rest > 0),
cut as (select *, sum(n_tokens) over (partition by domain, lang, source order by shuffle_key, n_tokens rows between unbounded preceding and current row) as upto from part)
select doc_id, domain, lang, source, n_tokens, epoch, md5('{SEED}|' || epoch || '|' || doc_id) as shuffle_key from whole
union all select doc_id, domain, lang, source, n_tokens, epoch, shuffle_key from cut where upto <= rest
"""

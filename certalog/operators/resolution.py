"""Companies of raw names: by alias, else by the one company of a key, else new; names that several companies share are left to be decided."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certalog.functions.text import company_key, once
from certalog.session import staged

#: Names up to which those that are an alias go with every task.
FEW_NAMES = 20_000

#: Legal forms and kinds of business that are taken off names (fixed values).
SUFFIXES = (
    "有限责任公司", "股份有限公司", "有限公司", "集团有限公司", "集团", "股份", "公司", "科技有限公司", "科技", "医疗器械有限公司", "医疗器械", "医疗", "器械", "生物科技有限公司", "生物科技", "生物",
)


def resolve_companies(names: DataFrame, aliases: DataFrame, companies: DataFrame, suffixes: Sequence[str] = SUFFIXES, replacements: dict[str, str] | None = None) -> DataFrame:
    """(key, how, company_id, n_rows, n_names, candidates) of every key of names (raw_name, one row an occurrence).

    aliases: alias (a key), company_id; companies: company_id, name. how is alias, unique (one company has the key), collision (several have: no
    company is taken, candidates tells how many) or create. Names without a key have no row. Raw names are counted before keys are made.
    """
    each = names.groupBy("raw_name").agg(F.count("*").alias("n"))
    told = each.withColumn("key", company_key(F.col("raw_name"), suffixes, replacements)).where("key is not null").groupBy("key").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_names"))
    owners = companies.select("company_id", company_key(F.col("name"), suffixes, replacements).alias("key")).where("key is not null")
    owners = owners.groupBy("key").agg(F.min("company_id").alias("_one"), F.count_distinct("company_id").alias("candidates"))
    known = aliases.select(F.col("alias").alias("key"), F.col("company_id").alias("_alias"))
    out = told.join(known, "key", "left").join(owners, "key", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    how = F.when(F.col("_alias").isNotNull(), "alias").when(F.col("candidates") == 1, "unique").when(F.col("candidates") > 1, "collision").otherwise("create")
    return out.select("key", how.alias("how"), F.coalesce("_alias", F.when(F.col("candidates") == 1, F.col("_one"))).alias("company_id"), "n_rows", "n_names", "candidates")


def rebind(products: DataFrame, aliases: DataFrame, suffixes: Sequence[str] = SUFFIXES, replacements: dict[str, str] | None = None) -> DataFrame:
    """Change rows (product_id, alias, old, new) of the products (product_id, raw_name, company_id) whose name's key is an alias (alias, company_id) of another company.

    Keys are made once a different name; names that are an alias go to every task if they are few, else products and names meet by name.
    """
    names = once(products.select("raw_name").distinct(), alias=company_key(F.col("raw_name"), suffixes, replacements))
    names = staged(names.join(aliases.select("alias", F.col("company_id").alias("new")), "alias"))
    names = F.broadcast(names) if names.count() <= FEW_NAMES else names.hint("merge")
    keyed = products.select("product_id", F.col("company_id").alias("old"), "raw_name").join(names, "raw_name")
    return keyed.where(~F.col("old").eqNullSafe(F.col("new"))).select("product_id", "alias", "old", "new")

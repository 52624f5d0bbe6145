"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions alone.

Documents hang in a tree domain / language / source.  A token budget flows from
the root down: the children of a node share its budget by weight.  A child
whose supply, times ``max_epochs``, is smaller than its share takes all it has,
and the rest is shared again among its siblings; only what all siblings cannot
take is missing from the parent, whose own siblings then take it.  This is done
with whole numbers, in one pass a level, over tables of one row a node.

Each leaf then reads its documents in epochs.  In epoch e they stand in the
order of ``md5(seed / e / doc_id)``; the leaf takes the prefix of that stream
with as many tokens as its budget, so every document comes ``copies`` times
whole, and some come once more, the last one cut.  Only the last epoch needs an
order.  There the documents of a leaf are dealt into slots by the first digits
of their md5, about as many slots as the square root of their number; running
sums over slots tell which slot holds the cut, and only that slot's documents,
as places and sizes without their texts, are put in order to find the document
at the cut.  All others only compare their place with it.

A token is a run without space, tab, LF, VT, FF or CR.  Nulls, empties and
ties: a null text has no tokens and is selected with 0 tokens when its place
lies before the cut; a leaf without any token gives nothing; a null language or source is the language or source
``unknown``, a null identifier is hashed as empty; ties of md5 go to the
shorter text, then to the text's md5, so only equal rows can stand in for each
other; an empty table gives no rows.  Clashing column names do no harm: only
doc_id, text, lang and source are read, unless ``keep`` names more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm import common

#: The most hexadecimal digits that number a slot.
MOST_DIGITS = 8
SEED = 20240607
MAX_EPOCHS = 2
#: Shares of the query: a third of the sources is web text.  Paths not named have weight 1.
WEIGHTS = {"web": 5, "books": 3, "code": 2, "web/en": 4, "books/en": 3, "web/en/src0": 3}
SHARE = (3, 4)


def domain_of(source: Column) -> Column:
    """The query's rule: by the number that ends the source's name."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    kind = F.when(number == "", F.lit(-1)).otherwise(number.try_cast("int") % 3)
    return F.when(kind == 0, "web").when(kind == 1, "books").when(kind == 2, "code").otherwise("other")


def token_list(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, " \t\n\x0b\x0c\r", " " * 6), " "), "")


def first_tokens(text: Column, count: Column) -> Column:
    """The text up to the end of its ``count``-th token, as it stands."""
    words = F.split(F.translate(text, " \t\n\x0b\x0c\r", " " * 6), " ")
    size = F.aggregate(
        words,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("size")),
        lambda acc, w: F.when(acc["n"] >= count, acc).otherwise(F.struct((acc["n"] + (w != "").cast("long")).alias("n"), (acc["size"] + 1 + F.length(w)).alias("size"))),
        lambda acc: acc["size"],
    )
    return F.substring(text, F.lit(1), F.greatest(F.lit(0), size))


def weight_of(path: Column, weights: dict[str, int]) -> Column:
    if not weights:
        return F.lit(1).cast("long")
    table = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, int(v))])
    return F.coalesce(F.try_element_at(table, path), F.lit(1)).cast("long")


def share_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``nodes`` (parent..., name, weight, cap, budget of the parent) with each node's ``given``.

    In the order of cap / weight a child is full if its fair share of what the
    children before it have left is its cap or more.
    """
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    by_ratio = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), name)
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    ranked = nodes.withColumn("before", before).withColumn("onward", onward)
    ranked = ranked.withColumn("full", whole("cap") * whole("onward") <= (whole("budget") - whole("before")) * whole("weight"))
    family = Window.partitionBy(*parent)
    ranked = ranked.withColumn("left", F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(family))
    ranked = ranked.withColumn("hungry", F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0)).over(family))
    by_name = Window.partitionBy(*parent).orderBy(name).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0)).over(by_name)
    ranked = ranked.withColumn("upto", upto)
    # cumulated shares, so that rounding neither loses nor adds a token
    fair = F.expr("(cast(left as decimal(38,0)) * upto) div hungry - (cast(left as decimal(38,0)) * (upto - weight)) div hungry")
    return ranked.withColumn("given", F.when(F.col("full"), F.col("cap")).otherwise(fair)).drop("before", "onward", "full", "left", "hungry", "upto")


def leaf_budgets(supply: DataFrame, weights: dict[str, int], share: tuple[int, int], max_epochs: int) -> DataFrame:
    """(domain, language, origin, supply, given) from (domain, language, origin, supply)."""
    leaves = supply.withColumn("cap", F.col("supply") * max_epochs).withColumn("weight", weight_of(F.concat_ws("/", "domain", "language", "origin"), weights))
    langs = leaves.groupBy("domain", "language").agg(F.sum("cap").alias("cap")).withColumn("weight", weight_of(F.concat_ws("/", "domain", "language"), weights))
    domains = langs.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("weight", weight_of(F.col("domain"), weights))
    own = supply.groupBy("domain").agg(F.sum("supply").alias("supply"))
    total = F.sum("supply").over(Window.partitionBy("root"))
    domains = domains.join(own, "domain").withColumn("root", F.lit(0))
    domains = domains.withColumn("budget", F.least(F.sum("cap").over(Window.partitionBy("root")), F.floor(total * share[0] / F.lit(share[1]).cast("decimal(10,0)"))).cast("long"))
    domains = share_out(domains, ["root"], "domain")
    langs = share_out(langs.join(domains.select("domain", F.col("given").alias("budget")), "domain"), ["domain"], "language")
    leaves = share_out(leaves.join(langs.select("domain", "language", F.col("given").alias("budget")), ["domain", "language"]), ["domain", "language"], "origin")
    return leaves.select("domain", "language", "origin", "supply", "given")


def mix(
    docs: DataFrame,
    domain: Column | None = None,
    weights: dict[str, int] | None = None,
    share: tuple[int, int] = SHARE,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Each row of ``docs(doc_id, text, lang, source)`` that the mixture takes: leaf, tokens, whole copies and tokens of the cut copy.

    ``share`` is the budget as a fraction of all tokens.  ``domain`` is a column
    of ``docs``; by default the query's rule.  ``keep`` adds columns of ``docs``
    under their own names with ``keep_`` before them.
    """
    weights = WEIGHTS if weights is None else weights
    if any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive; leave out what should not be taken")
    origin = F.coalesce(F.col("source").cast("string"), F.lit("unknown"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(domain if domain is not None else domain_of(origin), F.lit("unknown")).alias("domain"),
        F.coalesce(F.col("lang").cast("string"), F.lit("unknown")).alias("language"),
        origin.alias("origin"),
        F.size(token_list(text)).cast("long").alias("tokens"),
        text.alias("text_"),
        *[F.col(c).alias(f"keep_{c}") for c in keep],
    )
    leaf = ["domain", "language", "origin"]
    supply = common.materialize(rows.groupBy(*leaf).agg(F.sum("tokens").alias("supply"), F.count("*").alias("docs")), "supply")
    budgets = leaf_budgets(supply.select(*leaf, "supply"), weights, share, max_epochs)
    digits = F.least(F.lit(MOST_DIGITS), F.greatest(F.lit(1), F.ceil(F.log2("docs") / 8))).cast("int")
    budgets = budgets.join(supply.select(*leaf, digits.alias("digits")), leaf)
    budgets = common.materialize(budgets.select(*leaf, "digits", F.when(F.col("supply") > 0, F.expr("given div supply")).otherwise(0).alias("copies"), F.when(F.col("supply") > 0, F.pmod("given", "supply")).otherwise(0).alias("rest")), "budgets")

    place = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("copies").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    # one row a leaf: broadcast by Spark where its size allows, else joined with skewed leaves split
    placed = rows.join(budgets, leaf).withColumn("place", place).withColumn("slot", F.expr("substring(place, 1, digits)"))
    slots = placed.groupBy(*leaf, "slot", "rest").agg(F.sum("tokens").alias("held"))
    upto = F.sum("held").over(Window.partitionBy(*leaf).orderBy("slot"))
    slots = slots.withColumn("before", upto - F.col("held")).where("before <= rest and rest < before + held").select(*leaf, F.col("slot").alias("cut"), "before")
    slots = common.materialize(slots, "cut-slots")
    # places in the slot at the cut; equal rows count together
    near = placed.join(slots, leaf).where("slot = cut").groupBy(*leaf, "rest", "before", "place", "tokens", F.md5(F.col("text_").cast("binary")).alias("digest")).agg(F.count("*").alias("times"))
    order = Window.partitionBy(*leaf).orderBy("place", "tokens", "digest")
    near = near.withColumn("sofar", F.col("before") + F.sum(F.col("tokens") * F.col("times")).over(order) - F.col("tokens") * F.col("times"))
    at = F.struct("place", "tokens", "digest")
    # the first place that is not taken whole
    cuts = near.where("sofar >= rest or sofar + tokens * times > rest").groupBy(*leaf).agg(F.min(F.struct(at.alias("at"), "sofar", "times")).alias("cut"))
    cuts = common.materialize(cuts.select(*leaf, "cut.at", "cut.sofar", "cut.times"), "cuts")

    own = F.struct("place", "tokens", F.md5(F.col("text_").cast("binary")).alias("digest"))
    known = placed.join(cuts, leaf, "left")
    # most rows are told by their place alone; the digest of a text is needed for its own place only
    side = F.when(F.col("at").isNull(), 1).when(F.col("place") < F.col("at.place"), -1).when(F.col("place") > F.col("at.place"), 1).when(own < F.col("at"), -1).when(own > F.col("at"), 1).otherwise(0)
    known = known.withColumn("side", side)
    columns = [F.col("doc_id"), *[F.col(c) for c in leaf], F.col("tokens"), F.col("copies"), F.col("part"), F.col("text_"), *[F.col(f"keep_{c}") for c in keep]]

    def taken(some: DataFrame, sofar: Column) -> DataFrame:
        part = F.when(F.col("side") < 0, F.col("tokens")).when(F.col("side") > 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.col("tokens"), F.col("rest") - sofar)))
        early = (F.col("side") < 0) | ((F.col("side") == 0) & (sofar < F.col("rest")))
        return some.withColumn("part", part).where((F.col("copies") > 0) | early).select(*columns)

    if cuts.where("times > 1").limit(1).count():
        # equal rows at the cut take their turns
        turn = F.row_number().over(Window.partitionBy(*leaf).orderBy("place")) - 1
        found = taken(known.where("side != 0"), F.lit(0)).unionByName(taken(known.where("side = 0").withColumn("turn", turn), F.col("sofar") + F.col("turn") * F.col("tokens")))
    else:
        found = taken(known, F.col("sofar"))
    return found.withColumnRenamed("part", "cut_tokens")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mix(common.documents(spark, sf_dir))
    return taken.select("doc_id", "domain", "language", "origin", "tokens", "copies", "cut_tokens", (F.col("tokens") * F.col("copies") + F.col("cut_tokens")).alias("taken_tokens"))


def _level(nodes: str, parent: str, name: str) -> str:
    """SQL of ``share_out``."""
    over = f"PARTITION BY {parent}"
    return f"""
    SELECT *, CASE WHEN full_ THEN cap ELSE CAST((left_ * upto) // hungry - (left_ * (upto - weight)) // hungry AS BIGINT) END AS given FROM (
      SELECT *, budget - SUM(CASE WHEN full_ THEN cap ELSE 0 END) OVER ({over}) AS left_,
        SUM(CASE WHEN full_ THEN 0 ELSE weight END) OVER ({over}) AS hungry,
        SUM(CASE WHEN full_ THEN 0 ELSE weight END) OVER ({over} ORDER BY {name} ROWS UNBOUNDED PRECEDING) AS upto FROM (
        SELECT *, cap::HUGEINT * onward <= (budget - before_)::HUGEINT * weight AS full_ FROM (
          SELECT *, COALESCE(SUM(cap) OVER ({over} ORDER BY cap / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_,
            SUM(weight) OVER ({over} ORDER BY cap / weight, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onward
          FROM {nodes})))"""


def _weight(path: str) -> str:
    return f"CASE {path} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items()) + " ELSE 1 END"


def sql_ctes(documents: str = "documents", weights: bool = True, share: tuple[int, int] = SHARE, max_epochs: int = MAX_EPOCHS, domain: str | None = None) -> str:
    """The common table expressions that end in ``taken``."""
    weight = _weight if weights else (lambda path: "1")
    domain = domain or "CASE WHEN regexp_extract(COALESCE(source, 'unknown'), '([0-9]{1,9})$', 1) = '' THEN 'other' ELSE CASE CAST(regexp_extract(source, '([0-9]{1,9})$', 1) AS INT) % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'books' ELSE 'code' END END"
    return f"""
  leaf_rows AS (SELECT doc_id, {domain} AS domain, COALESCE(lang, 'unknown') AS language, COALESCE(source, 'unknown') AS origin,
    CAST(len(regexp_extract_all(COALESCE(text, ''), '[^ \\x09-\\x0D]+')) AS BIGINT) AS tokens, COALESCE(text, '') AS text_ FROM {documents}),
  supplies AS (SELECT domain, language, origin, SUM(tokens)::BIGINT AS supply, (SUM(tokens) * {max_epochs})::BIGINT AS cap, {weight("concat_ws('/', domain, language, origin)")} AS weight FROM leaf_rows GROUP BY domain, language, origin),
  langs AS (SELECT domain, language, SUM(cap)::BIGINT AS cap, {weight("concat_ws('/', domain, language)")} AS weight FROM supplies GROUP BY domain, language),
  domains AS (SELECT domain, 0 AS root, SUM(cap)::BIGINT AS cap, {weight("domain")} AS weight, (SELECT LEAST(SUM(cap), SUM(supply) * {share[0]} // {share[1]}) FROM supplies)::BIGINT AS budget FROM langs GROUP BY domain),
  domains_given AS ({_level("domains", "root", "domain")}),
  langs_given AS ({_level("(SELECT l.*, d.given AS budget FROM langs l JOIN domains_given d USING (domain))", "domain", "language")}),
  leaves_given AS ({_level("(SELECT s.*, l.given AS budget FROM supplies s JOIN langs_given l USING (domain, language))", "domain, language", "origin")}),
  ordered AS (SELECT r.*, CASE WHEN supply > 0 THEN given // supply ELSE 0 END AS copies, CASE WHEN supply > 0 THEN given % supply ELSE 0 END AS rest FROM leaf_rows r JOIN leaves_given g USING (domain, language, origin)),
  running AS (SELECT *, COALESCE(SUM(tokens) OVER (PARTITION BY domain, language, origin ORDER BY md5('{SEED}/' || copies || '/' || COALESCE(CAST(doc_id AS VARCHAR), '')), tokens, md5(text_) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sofar FROM ordered),
  taken AS (SELECT doc_id, domain, language, origin, tokens, copies, GREATEST(0, LEAST(tokens, rest - sofar))::BIGINT AS cut_tokens, text_ FROM running WHERE copies > 0 OR sofar < rest)"""


ORACLE_SQL = f"""WITH {sql_ctes()}
SELECT doc_id, domain, language, origin, tokens, copies::BIGINT AS copies, cut_tokens, (tokens * copies + cut_tokens)::BIGINT AS taken_tokens FROM taken"""

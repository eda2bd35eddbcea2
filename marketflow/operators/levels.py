"""#60 level_requirement and #61 level_backfill.

Rule order is semantic (first matching rule wins), so every rule carries an
explicit ``priority``.  Two physical forms:

* ``level_requirement_expr`` — the rule list is small configuration; it is
  compiled into one CASE chain that runs inside whole-stage codegen with no
  join at all (used at ingest for the stored ``flea_level_required``).
* ``level_requirement`` — rules arrive as a DataFrame, any number of them.  They
  are matched against the *distinct* names, categories and handbook lists only,
  through indexes of equal texts and n-grams, and the results are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.columns import col


def _quote(p: str) -> str:
    return r"\Q" + p + r"\E"


def _boundary_regex(p_lower: str) -> str:
    b = S.BOUNDARY_CLASS
    return f"(?:^|{b}){_quote(p_lower)}(?:$|{b})"


def _split(rules):
    items = [(p, lvl) for k, p, lvl in rules if k == "item"]
    cats = [(p, lvl) for k, p, lvl in rules if k == "category"]
    return items, cats


def _item_cond(lname: Column, pattern: str) -> Column:
    pl = pattern.lower()
    cond = lname == F.lit(pl)
    if len(pattern) >= 5:
        cond = cond | lname.contains(pl)
    elif len(pattern) >= 2:
        cond = cond | lname.rlike(_boundary_regex(pl))
    return cond


def _category_level(cat: Column, cats) -> Column | None:
    """Exact (case-sensitive), then case-insensitive match; null when none."""
    expr = None
    exact = {}
    for p, lvl in cats:
        exact.setdefault(p, lvl)
    for p, lvl in exact.items():
        expr = F.when(cat == F.lit(p), lvl) if expr is None else expr.when(cat == F.lit(p), lvl)
    lc = F.lower(cat)
    for p, lvl in cats:
        c = lc == F.lit(p.lower())
        expr = F.when(c, lvl) if expr is None else expr.when(c, lvl)
    return expr


def _plural_cond(lc: Column, pattern: str) -> Column:
    lk = pattern.lower()
    skip = (((F.length(lc) > len(lk)) & lc.startswith(lk + " "))
            | ((F.lit(len(lk)) > F.length(lc)) & F.lit(lk).startswith(F.concat(lc, F.lit(" ")))))
    same = ((F.rtrim(lc, F.lit("s")) == F.lit(lk.rstrip("s")))
            | (F.rtrim(lc, F.lit("es")) == F.lit(lk.rstrip("es"))))
    return ~skip & same


def level_requirement_expr(name="name", category="category", handbook=None,
                           rules=S.DEFAULT_LEVEL_RULES,
                           default: int = S.FLEA_MARKET_UNLOCK_LEVEL) -> Column:
    """Per-row level requirement as one CASE chain (rules are small config)."""
    items, cats = _split(rules)
    lname = F.lower(F.coalesce(col(name), F.lit("")))
    cat = F.coalesce(col(category), F.lit(""))
    lc = F.lower(cat)
    expr = None

    def add(cond, lvl):
        nonlocal expr
        expr = F.when(cond, F.lit(lvl)) if expr is None else expr.when(cond, F.lit(lvl))

    for p, lvl in items:
        add(_item_cond(lname, p), lvl)
    if cats:
        exact = {}
        for p, lvl in cats:
            exact.setdefault(p, lvl)
        for p, lvl in exact.items():
            add(cat == F.lit(p), lvl)
        for p, lvl in cats:
            add(lc == F.lit(p.lower()), lvl)
        if handbook is not None:
            # First handbook name (in array order) that matches a category rule.
            hb = F.coalesce(col(handbook), F.array().cast("array<string>"))
            per = F.transform(hb, lambda h: _category_level(h, cats))
            first = F.try_element_at(F.filter(per, lambda x: x.isNotNull()), F.lit(1))
            add(first.isNotNull(), first)
        for p, lvl in cats:
            add(_plural_cond(lc, p), lvl)
    if expr is None:
        return F.lit(default).cast("int")
    return expr.otherwise(F.lit(default)).cast("int")


def rules_frame(spark, rules=S.DEFAULT_LEVEL_RULES) -> DataFrame:
    """Rule table with an explicit priority column (position = priority)."""
    rows = [(k, p, int(lvl), i) for i, (k, p, lvl) in enumerate(rules)]
    return spark.createDataFrame(rows, "kind string, pattern string, level int, priority int")


def level_requirement(df: DataFrame, rules: DataFrame, name="name", category="category", handbook=None,
                      out="flea_level_required", default: int = S.FLEA_MARKET_UNLOCK_LEVEL) -> DataFrame:
    """Table-driven form of the rule matcher (same semantics as the CASE chain).

    Every way of matching is an equi-join followed by its exact test, over distinct names, categories and handbook
    lists: equal texts; for patterns of five characters or more one of the pattern's five-grams, the one that fewest
    names hold; for shorter patterns the pattern itself among the names' grams of that length; plurals by their stems.
    """
    r = rules.select("kind", "pattern", "level", "priority", F.lower("pattern").alias("lp"))
    hb = F.array().cast("array<string>") if handbook is None else F.coalesce(F.col(handbook), F.array().cast("array<string>"))
    df = df.withColumns({"_kn": F.coalesce(F.col(name), F.lit("")), "_kc": F.coalesce(F.col(category), F.lit("")), "_kh": hb})
    # Rank = (stage, place, inexact, priority): item rules < exact category < other case < handbook < plural.
    by_name = _best_of(_item_matches(df.select(F.col("_kn").alias("_n")).distinct().withColumn("ln", F.lower("_n")),
                                     r.filter(F.col("kind") == "item")), "_n", "_in")
    of_category = r.filter(F.col("kind") == "category")
    by_category = _best_of(_category_matches(df.select(F.col("_kc").alias("_c")).distinct().withColumn("lc", F.lower("_c")), of_category), "_c", "_ic")
    named = df.select(F.col("_kh").alias("_h")).distinct().select("_h", F.posexplode("_h").alias("_place", "_name"))
    by_handbook = _best_of(named.join(of_category, F.lower("_name") == F.col("lp")).select(
        "_h", _rank(3, F.col("_place"), (F.col("_name") != F.col("pattern")).cast("int")), "level"), "_h", "_ih")
    joined = (df.join(by_name, F.col("_kn") == F.col("_n"), "left").join(by_category, F.col("_kc") == F.col("_c"), "left")
              .join(by_handbook, F.col("_kh") == F.col("_h"), "left"))
    return (joined.withColumn(out, F.coalesce(F.least("_in", "_ic", "_ih")["level"], F.lit(default)).cast("int"))
            .drop("_n", "_c", "_h", "_in", "_ic", "_ih", "_kn", "_kc", "_kh"))


#: Characters of the grams that patterns for substrings are found by.
GRAM = 5


def _rank(stage: int, place: Column | None = None, inexact: Column | None = None) -> Column:
    none = F.lit(0)
    return F.struct(F.lit(stage).alias("stage"), (none if place is None else place).alias("place"),
                    (none if inexact is None else inexact).alias("inexact"), "priority").alias("_rank")


def _best_of(matches: DataFrame, key: str, out: str) -> DataFrame:
    """(key, out): the first rank of each key with its level."""
    return matches.groupBy(key).agg(F.min(F.struct("_rank", "level")).alias(out))


def _grams(text: Column, size) -> Column:
    size = F.lit(size) if isinstance(size, int) else size
    last = F.length(text) - size + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, size)))).otherwise(
        F.array().cast("array<string>"))


def _item_matches(names: DataFrame, r: DataFrame) -> DataFrame:
    """(_n, _rank, level) of every name and item rule that match."""
    ln, lp, size = F.col("ln"), F.col("lp"), F.length("pattern")
    pick = lambda m: m.select("_n", _rank(0), "level")
    equal = pick(names.join(r, ln == lp))
    grams = names.select("_n", "ln", F.explode(_grams(ln, GRAM)).alias("gram"))
    held = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("names"))
    long_ = r.filter(size >= GRAM)
    # The rarest gram of each pattern; one that no name holds matches none.
    of_rule = long_.select(*r.columns, F.explode(_grams(lp, GRAM)).alias("gram"))
    whole = of_rule.join(held, "gram", "left")
    rarest = (whole.groupBy(*r.columns).agg(F.min(F.struct(F.coalesce("names", F.lit(0)).alias("names"), "gram")).alias("x"))
              .filter("x.names > 0").select(*r.columns, F.col("x.gram").alias("gram")))
    inside = pick(grams.join(rarest, "gram").filter(ln.contains(lp)))
    short = r.filter((size >= 2) & (size < GRAM))
    sizes = [x[0] for x in short.select(F.length("lp")).distinct().collect()]      # 2 to 4 characters, a few more for odd letters
    pieces = F.flatten(F.array(*[_grams(ln, n) for n in sizes])) if sizes else F.array().cast("array<string>")
    bclass = S.BOUNDARY_CLASS
    bounded = F.regexp_like(ln, F.concat(F.lit(f"(?:^|{bclass})\\Q"), lp, F.lit(f"\\E(?:$|{bclass})")))
    apart = pick(names.select("_n", "ln", F.explode(pieces).alias("gram")).join(short, F.col("gram") == lp).filter(bounded))
    return equal.unionByName(inside).unionByName(apart)


def _category_matches(categories: DataFrame, r: DataFrame) -> DataFrame:
    """(_c, _rank, level) of every category and rule that are equal in any case, or plural and singular."""
    c, lc, lp = F.col("_c"), F.col("lc"), F.col("lp")
    same = categories.join(r, lc == lp)
    exact = same.filter(c == F.col("pattern")).select("_c", _rank(1), "level")
    other = same.select("_c", _rank(2), "level")
    skip = (((F.length(lc) > F.length(lp)) & lc.startswith(F.concat(lp, F.lit(" "))))
            | ((F.length(lp) > F.length(lc)) & lp.startswith(F.concat(lc, F.lit(" ")))))
    plural = [categories.join(r, F.rtrim(lc, F.lit(end)) == F.rtrim(lp, F.lit(end))).filter(~skip).select("_c", _rank(4), "level")
              for end in ("s", "es")]
    return exact.unionByName(other).unionByName(plural[0]).unionByName(plural[1])


def level_backfill(df: DataFrame, rules=S.DEFAULT_LEVEL_RULES, level="flea_level_required",
                   name="name", category="category") -> DataFrame:
    """#61: re-sync stored levels to the rule set.

    Category equality (case-sensitive) sets the level; item rules then only
    raise it: substring (case-insensitive LIKE) for patterns of 5+ chars, exact
    name equality otherwise.  Applied rule by rule in order, as the updates are; a row
    without a stored level is left alone.
    """
    items, cats = _split(rules)
    lvl = F.col(level)
    for p, v in cats:
        lvl = F.when((F.col(category) == F.lit(p)) & lvl.isNotNull(), F.lit(v)).otherwise(lvl)
    for p, v in items:
        hit = (F.lower(F.col(name)).contains(p.lower()) if len(p) >= 5
               else F.col(name) == F.lit(p))
        lvl = F.when(hit & (lvl < v), F.lit(v)).otherwise(lvl)
    return df.withColumn(level, lvl.cast("int"))


def lock_reference_table(payload: DataFrame, rules=S.DEFAULT_LEVEL_RULES,
                         unlock_level: int = S.FLEA_MARKET_UNLOCK_LEVEL, market: str = "Flea Market") -> DataFrame:
    """The reference table of access levels from payload items: level, flags and the best dealer in any currency.

    Ordered by level (highest first), then name.  The best dealer is the first with the highest price above 0.
    """
    offers = F.coalesce(F.col("sellFor"), F.array().cast(payload.schema["sellFor"].dataType))
    init = F.struct(F.lit(0).cast("long").alias("price"), F.lit(None).cast("string").alias("name"))
    best = F.aggregate(offers, init, lambda acc, o: F.when(
        (F.coalesce(o["price"], F.lit(0)) > acc["price"]) & (F.coalesce(o["vendor"]["name"], F.lit("")) != F.lit(market)),
        F.struct(o["price"].alias("price"), F.coalesce(o["vendor"]["name"], F.lit("")).alias("name"))).otherwise(acc))
    types = F.coalesce(F.col("types"), F.array().cast("array<string>"))
    names = F.transform(F.filter(F.coalesce(F.col("handbookCategories"), F.array().cast(payload.schema["handbookCategories"].dataType)),
                                 lambda h: F.coalesce(h["name"], F.lit("")) != ""), lambda h: h["name"])
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    t = payload.select(
        text("id").alias("item_id"), text("name").alias("name"), text("shortName").alias("short_name"),
        F.when(F.col("category").isNull(), F.lit("Unknown")).otherwise(F.coalesce("category.name", F.lit("Unknown"))).alias("category"),
        names.alias("_names"), F.array_join(types, ", ").alias("types"),
        F.array_contains(types, "noFlea").alias("no_flea"), F.array_contains(types, "markedOnly").alias("marked_only"),
        F.coalesce("basePrice", F.lit(0)).cast("long").alias("base_price"), best.alias("_best"))
    t = t.withColumn("flea_level_required", level_requirement_expr("name", "category", handbook="_names", rules=rules, default=unlock_level))
    best_name = F.when(F.coalesce("_best.name", F.lit("")) == "", F.lit("None")).otherwise(F.col("_best.name"))
    t = t.select(
        "item_id", "name", "short_name", "category", F.array_join("_names", ", ").alias("handbook_categories"), "types",
        "no_flea", "marked_only", "base_price", best_name.alias("best_trader"), F.col("_best.price").alias("trader_price"),
        "flea_level_required", (F.col("flea_level_required") > unlock_level).alias("flea_locked"))
    # A sort samples its input for the bounds; behind a shuffle the sample reads finished rows, and nothing is made twice.
    return t.repartition("item_id", "name").orderBy(F.desc("flea_level_required"), "name")

"""Secret scan with DataFrame functions only.

Three base patterns mark their spans exactly.  The method adds spans: every long
token is scored by two character Markov models, one of random strings and one of
ordinary identifiers, and is a secret when the log-likelihood ratio favours
random.  Both models are fitted on a bounded sample of labelled tokens: values
that the base patterns found are random strings, plain words are identifiers.

Positions come from splitting a text at a pattern: the lengths of the pieces and
of the matches add up to code-point offsets, without a Python function.  Sums and
overlaps run over arrays in a few element-wise rounds, so a text of very
many matches, or one token of any length, takes time in proportion to its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketflow.llm.common import checkpointed

# The base patterns, in the order that kinds are listed.
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
#: Sorts by start, then kind.
_SPANS = "array<struct<start:int,kind:int,stop:int,token:string>>"

#: Tokens that the models judge: runs of these characters, this long at least.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
MIN_TOKEN = 20
#: Labelled tokens of each class that the models are fitted on (the smallest hashes).
FIT_TOKENS = 50_000
#: Plain words that count as samples of identifiers.
IDENTIFIER = r"[A-Za-z_]{6,}"
#: Nats by which a token has to be likelier as a random string than as an identifier.
MIN_RATIO = 8.0
ALPHABET = 128
BACKOFF = 20.0
#: Documents that hold the samples of identifiers, at most.
FIT_DOCS = 2_000


#: A running sum takes in so many earlier sums at each of its steps: enough for the longest array.
_WIDE, _STEPS = 32, 6


def _with(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, zero, op) -> Column:
    """Running ``op`` over an array, in a few rounds of sums over ``_WIDE`` places that lie ever farther apart."""
    def step(apart):
        def one(v):
            last = F.least(F.lit(_WIDE - 1), F.floor((F.size(v) - 1) / apart).cast("int"))
            return F.when(F.size(v) > apart, F.transform(F.sequence(F.lit(0), F.size(v) - 1), lambda i: F.aggregate(
                F.sequence(F.lit(0), last), F.lit(zero), lambda acc, j: op(acc, F.coalesce(F.get(v, i - j * apart), F.lit(zero)))))).otherwise(v)
        return one
    for k in range(_STEPS):
        values = _with(values, step(_WIDE ** k))
    return values


def spans(text: Column, pattern: str, kind: str, long_enough=None) -> Column:
    """array<struct<start, kind, stop, token>> of the leftmost non-overlapping matches, in code points.

    ``long_enough`` maps a match to a condition; matches that fail it are dropped after they have taken their place.
    """
    kind_no = F.lit(KINDS.index(kind))

    def placed(found):
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        ends = _running(F.zip_with(gaps, found, lambda g, t: F.length(g) + F.length(t)), 0, lambda a, b: a + b)
        return F.zip_with(ends, found, lambda e, t: F.struct((e - F.length(t)).alias("start"), kind_no.alias("kind"), e.alias("stop"), t.alias("token")))

    out = _with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed).cast(_SPANS)
    if long_enough is not None:
        out = F.filter(out, lambda s: long_enough(s["token"]))
    none = F.array().cast(_SPANS)
    return F.when(text.rlike(pattern), out).otherwise(none)


def base_spans(text: Column) -> Column:
    """All base spans, by start, then kind as listed."""
    value = lambda t: F.length(F.regexp_extract(t, ASSIGN, 1)) >= 6
    return F.array_sort(F.concat(spans(text, ASSIGN, "assign", value), spans(text, ACCESS, "access"), spans(text, HEX, "hex")))


def _cells(token: Column) -> Column:
    """The cell of every character pair of an ASCII token."""
    def pairs(code):
        return F.zip_with(F.slice(code, F.lit(1), F.size(code) - 1), F.slice(code, F.lit(2), F.size(code) - 1),
                          lambda a, b: a * ALPHABET + b)
    return _with(F.transform(F.split(token, ""), F.ascii), pairs)


def _transitions(tokens: DataFrame) -> DataFrame:
    """(label, cell, n): counts of character pairs, cell = first * ALPHABET + second."""
    return (tokens.where(F.length("token") > 1).select("label", F.explode(_cells(F.col("token"))).alias("cell"))
            .groupBy("label", "cell").agg(F.count("*").alias("n")))


def markov_ratio(tokens: DataFrame) -> DataFrame:
    """One row (ratio array<double>): log P(second|first) of label 1 minus that of label 0, for each cell.

    ``tokens`` (token of ASCII characters, label).  A pair's probability is smoothed towards its second character's
    own, as if BACKOFF pairs had been seen, and that towards uniform; an empty class is uniform.
    """
    n = _transitions(tokens)
    cells = n.sparkSession.range(ALPHABET * ALPHABET).select(F.col("id").cast("int").alias("cell"))
    # Every table here has a row per cell at most: 16,384.
    wide = n.groupBy("cell").agg(*(F.sum(F.when(F.col("label") == y, F.col("n")).otherwise(0)).alias(f"n{y}") for y in (0, 1)))
    full = (cells.join(wide, "cell", "left").fillna(0, ["n0", "n1"])
            .withColumn("first", F.floor(F.col("cell") / ALPHABET)).withColumn("second", F.col("cell") % ALPHABET))
    by = lambda c, name: full.groupBy(c).agg(*(F.sum(f"n{y}").alias(f"{name}{y}") for y in (0, 1)))
    alone = by("second", "s").withColumns({f"t{y}": F.sum(f"s{y}").over(W.partitionBy()) for y in (0, 1)})
    alone = alone.select("second", *(((F.col(f"s{y}") + 0.5) / (F.col(f"t{y}") + 0.5 * ALPHABET)).alias(f"p{y}") for y in (0, 1)))
    p = lambda y: F.log((F.col(f"n{y}") + BACKOFF * F.col(f"p{y}")) / (F.col(f"f{y}") + BACKOFF))
    both = full.join(by("first", "f"), "first").join(alone, "second").select("cell", (p(1) - p(0)).alias("r"))
    return both.agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "r"))), lambda x: x["r"]).alias("ratio"))


def token_ratio(token: Column, ratio: Column) -> Column:
    """Log-likelihood ratio, random over identifier, of the character pairs of an ASCII token."""
    return F.aggregate(F.transform(_cells(token), lambda c: F.get(ratio, c)), F.lit(0.0), lambda acc, x: acc + x)


def train(docs: DataFrame, text_col: str = "text", fit_tokens: int = FIT_TOKENS, fit_docs: int = FIT_DOCS) -> DataFrame:
    """The one-row model of :func:`markov_ratio`, from at most ``fit_tokens`` tokens of each class.

    Random strings are distinct tokens of base spans over all documents; identifiers are distinct plain words of at
    most ``fit_docs`` documents without a base span.  Samples are those with the smallest hashes.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    key = F.xxhash64(t)
    found = docs.select(t.alias("t")).where(F.col("t").rlike(f"{ASSIGN}|{ACCESS}|{HEX}"))
    values = found.select(F.explode(base_spans(F.col("t"))).alias("s")).select(
        F.when(F.col("s.kind") == 0, F.regexp_extract("s.token", ASSIGN, 1)).otherwise(F.col("s.token")).alias("token"))
    values = values.where(F.length("token") >= 16).where(F.col("token").rlike("[0-9]"))
    picked = docs.select(key.alias("k")).distinct().orderBy("k").limit(fit_docs)
    plain = docs.select(t.alias("t"), key.alias("k")).join(F.broadcast(picked), "k")
    words = plain.select(F.explode(F.regexp_extract_all("t", F.lit(IDENTIFIER), F.lit(0))).alias("token"))

    def sample(tokens: DataFrame, label: int) -> DataFrame:
        d = tokens.distinct().orderBy(F.xxhash64("token"), "token").limit(fit_tokens)
        return d.withColumn("label", F.lit(label))

    return checkpointed(markov_ratio(sample(values, 1).unionByName(sample(words, 0))))


def _apart(tokens: Column, base: Column) -> Column:
    """The tokens that no base span overlaps: none before reaches into them, and the next begins behind them."""
    kind, last = KINDS.index("random"), 2**31 - 1

    def clear(all_):
        reach = _running(F.transform(all_, lambda s: F.when(s["kind"] < kind, s["stop"]).otherwise(F.lit(-1))), -1, lambda a, b: F.greatest(a, b))
        ahead = F.reverse(_running(F.reverse(F.transform(all_, lambda s: F.when(s["kind"] < kind, s["start"]).otherwise(F.lit(last)))), last, lambda a, b: F.least(a, b)))
        near = F.arrays_zip(all_.alias("s"), reach.alias("reach"), ahead.alias("ahead"))
        kept = F.filter(near, lambda x: (x["s"]["kind"] == kind) & (x["reach"] <= x["s"]["start"]) & (x["ahead"] >= x["s"]["stop"]))
        return F.transform(kept, lambda x: x["s"])
    return F.when((F.size(base) == 0) | (F.size(tokens) == 0), tokens).otherwise(_with(F.array_sort(F.concat(base, tokens)), clear))


def with_spans(docs: DataFrame, model: DataFrame, text_col: str = "text", base_name: str = "base",
               all_name: str = "spans", min_ratio: float = MIN_RATIO) -> DataFrame:
    """``docs`` with two more columns: base spans and all spans, array<struct<start, kind, stop, token>>, sorted.

    Null text is like empty: no spans.  A token that lies in or over a base span is not repeated as random.
    """
    t = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    one = model.select(F.col("ratio").alias("__ratio"))  # one row of 16,384 numbers
    base = F.col(base_name)
    random = F.filter(_apart(spans(t, TOKEN, "random"), base), lambda s: token_ratio(s["token"], F.col("__ratio")) >= min_ratio)
    return (docs.withColumn(base_name, base_spans(t)).crossJoin(F.broadcast(one))
            .withColumn(all_name, F.array_sort(F.concat(base, random))).drop("__ratio"))


def listed(spans_col: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans_col, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redacted(text: Column, spans_col: Column, mark: str = "[REDACTED]") -> Column:
    """The text with every span (overlaps merged) replaced by ``mark``."""
    def pieces(reach):
        """Places of the text between merged spans: from the farthest stop so far to a start that is not before it."""
        before = F.concat(F.array(F.lit(0)), reach)
        starts = F.concat(F.transform(spans_col, lambda s: s["start"]), F.array(F.length(text)))
        return F.filter(F.zip_with(before, starts, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: p["b"] >= p["a"])

    def joined(chars):
        places = _with(_running(F.transform(spans_col, lambda s: s["stop"]), 0, lambda a, b: F.greatest(a, b)), pieces)
        return F.array_join(F.transform(places, lambda p: F.array_join(F.slice(chars, p["a"] + 1, p["b"] - p["a"]), "")), mark)

    return F.when(F.size(spans_col) == 0, text).otherwise(_with(F.split(text, ""), joined))


def scan(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_ratio: float = MIN_RATIO) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    d = with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model, min_ratio=min_ratio)
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return d.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
                    F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                    listed(F.col("spans")).alias("spans"))

"""URL filter: host and path rules first, then a ratio of two character language models.

Everything is built-in expressions. The models are variable-order Markov models over the
characters of host and path with Witten-Bell smoothing, counted over every URL that a rule
accepts or rejects. The whole model is a table of runs of characters; distinct host and path texts
are cut into runs, joined with it and summed up again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rowassay.session import durable

#: Order of precedence is the length of the rule; (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
ORDER = 3
#: A table of values with at most this many rows is broadcast; of a larger one less than HOT hot keys.
FEW, HOT = 200_000, 20_000
#: Shares that the rows of a hot key are spread over.
SLOTS = 1 << 16
BINS = 200
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
START, END = "\u0002", "\u0003"
SCALE = 1 << 32


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null URL or one without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; nulls where none fits. Of equal rules the first wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        own_host, slash, own_path = text.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + own_path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def padded(text: Column) -> Column:
    return F.concat(F.lit(START * ORDER), text, F.lit(END))


def grams(text: Column) -> Column:
    """Every run of ORDER + 1 characters of the padded text, one for each character to predict."""
    whole = padded(text)
    return F.transform(F.sequence(F.lit(1), F.length(whole) - ORDER), lambda i: F.substr(whole, i, F.lit(ORDER + 1)))


def gram_values(parts: DataFrame) -> DataFrame:
    """gram, uses, value: of every run of ORDER + 1 characters the difference of the two models.

    parts: gram, n0, n1; one row per place in a distinct text, with the number of rejected and
    accepted URLs that have this text. Runs that only open URLs hold count 0 in both models and get
    what the smoothing leaves them, so the table has a value for every run there is to score.
    value is the difference of the log probabilities in steps of 1 / SCALE: sums are exact.
    """
    whole = durable(parts.groupBy("gram").agg(F.count("*").alias("uses"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    sizes = F.explode(F.sequence(F.lit(1), F.lit(ORDER + 1))).alias("size")
    runs = durable(
        whole.select("gram", "n0", "n1", sizes)
        .groupBy(F.expr("right(gram, size)").alias("gram"), "size")
        .agg(*[F.sum(f"n{side}").alias(f"n{side}") for side in (0, 1)])
        .withColumn("context", F.expr("left(gram, size - 1)"))
    )
    contexts = durable(runs.groupBy("context", "size").agg(
        *[F.sum(f"n{side}").alias(f"c{side}") for side in (0, 1)],
        *[F.count(F.when(F.col(f"n{side}") > 0, 1)).alias(f"t{side}") for side in (0, 1)],
    ))
    model = None
    for size in range(1, ORDER + 2):
        level = runs.where(F.col("size") == size).join(contexts.where(F.col("size") == size).drop("size"), "context")
        if model is None:
            level = level.withColumns({f"q{side}": F.lit(1 / 256) for side in (0, 1)})
        else:
            level = level.join(model.select(F.col("gram").alias("__short"), F.col("p0").alias("q0"), F.col("p1").alias("q1")), F.expr("right(gram, size - 1)") == F.col("__short"))
        seen_by = {f"p{s}": F.when(F.col(f"c{s}") > 0, (F.col(f"n{s}") + F.col(f"t{s}") * F.col(f"q{s}")) / (F.col(f"c{s}") + F.col(f"t{s}"))).otherwise(F.col(f"q{s}")) for s in (0, 1)}
        model = durable(level.withColumns(seen_by).select("gram", "p0", "p1"))
    value = F.round(F.log(F.col("p1") / F.col("p0")) * SCALE).cast("long").alias("value")
    return durable(whole.select("gram", "uses").join(model.select("gram", value), "gram"))


def looked_up(rows: DataFrame, table: DataFrame, key: str, spread: str) -> DataFrame:
    """rows with the value of their key. table: key, uses, value; it has every key of the rows.

    A table of up to FEW rows is broadcast. Of a larger one, the keys that more than 1 / HOT of the
    rows use are broadcast, which are under HOT; their rows are spread by the column `spread`, and
    the others meet their keys in a shuffle where none is hot.
    """
    size, total = table.agg(F.count("*"), F.coalesce(F.sum("uses"), F.lit(0))).first()
    if size <= FEW:
        return rows.join(F.broadcast(table.drop("uses")), key)
    is_hot = F.col("uses") * HOT > total
    hot = table.where(is_hot).select(key, F.col("value").alias("__hot"))
    rest = table.where(~is_hot).select(key, F.lit(0).alias("__salt"), "value")
    salt = F.when(F.col("__hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.lit(SLOTS)).cast("int") + 1)
    met = rows.join(F.broadcast(hot), key, "left").withColumn("__salt", salt).join(rest, [key, "__salt"], "left")
    return met.withColumn("value", F.coalesce("__hot", "value")).drop("__hot", "__salt")


def scored(texts: DataFrame) -> DataFrame:
    """texts with their score, the log-likelihood difference per character.

    texts: text (distinct), accepted (null where open), uses. Above 0 a text is more like accepted
    ones.
    """
    parts = texts.select("text", F.explode(grams(F.col("text"))).alias("gram"), *[F.when(F.col("accepted") == side, F.col("uses")).otherwise(0).alias(f"n{side}") for side in (0, 1)])
    found = looked_up(parts.select("text", "gram"), gram_values(parts.drop("text")), "gram", "text")
    sums = found.groupBy("text").agg((F.sum("value") / F.count("*") / SCALE).alias("value"))
    return durable(texts.join(sums, "text"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, score (null where a rule decides).

    Rows the rules leave open are allowed if their score reaches the threshold that best parts
    the URLs the rules accept from those they reject (largest sum of both shares kept right; of
    equal ones the lowest). Without examples of both kinds there is no ratio, and open URLs are
    allowed. A null or empty URL, or one without ://, has empty host and path and is scored like
    any text. Repeated rows each get their row; null ids stay null.
    """
    host, path = host_and_path(F.col(url_column))
    parsed = pages.select(F.col(id_column), host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    ruled = parsed.withColumns({"rule": rule, "verdict": verdict})
    # host and path together tell the rule: a path is empty or starts with the first slash
    accepted = F.when(F.col("rule").isNotNull(), (F.col("verdict") == "allow").cast("int"))
    texts = durable(ruled.groupBy(F.concat("host", "path").alias("text")).agg(F.max(accepted).alias("accepted"), F.count("*").alias("uses")))
    kinds = {r["accepted"]: r["n"] for r in texts.where("accepted IS NOT NULL").groupBy("accepted").agg(F.sum("uses").alias("n")).collect()}
    if len(kinds) < 2:
        return ruled.withColumns({"verdict": F.coalesce("verdict", F.lit("allow")), "score": F.lit(None).cast("double")})
    judged = scored(texts)
    limit = threshold(judged, kinds)
    open_ = ruled.where("rule IS NULL").withColumn("__text", F.concat("host", "path"))
    values = judged.where("accepted IS NULL").select(F.col("text").alias("__text"), "uses", "value")
    found = looked_up(open_, values, "__text", id_column)
    decided = ruled.where("rule IS NOT NULL").withColumn("score", F.lit(None).cast("double"))
    own = found.select(id_column, "host", "path", "rule", F.when(F.col("value") >= limit, "allow").otherwise("block").alias("verdict"), F.col("value").alias("score"))
    return decided.unionByName(own)


def threshold(judged: DataFrame, kinds: dict[int, int]) -> float:
    """From a histogram of BINS steps between -1 and 1 over all decided URLs."""
    step = F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(0.999999), F.col("value"))) * (BINS // 2)).cast("int")
    counts = judged.where("accepted IS NOT NULL").groupBy(step.alias("bin"), "accepted").agg(F.sum("uses").alias("n")).collect()
    best, at = -1.0, 0
    for cut in range(-(BINS // 2), BINS // 2):
        kept = sum(r["n"] for r in counts if r["accepted"] and r["bin"] >= cut) / kinds[1]
        gone = sum(r["n"] for r in counts if not r["accepted"] and r["bin"] < cut) / kinds[0]
        if kept + gone > best + 1e-12:
            best, at = kept + gone, cut
    return at / (BINS // 2)

"""URL filters: host and path rules, then a character language-model ratio. DataFrame operations only.

Rules decide the urls they fit, and those urls are the training rows of two variable-order Markov models over host and path:
accepted and rejected. Characters are kept as they are. A url is cut after each ``/`` and ``.`` into pieces, a context is up to ``CONTEXT`` characters
back to the start of the piece, and each order is smoothed with the next shorter one,
P(c | h) = (n(hc) + BETA * P(c | shorter h)) / (n(h) + BETA), and the shortest with the uniform distribution over ``SYMBOLS``
characters. The score of a url is the mean over its characters of log P_accepted - log P_rejected. The
threshold is calibrated on a fifth of the ruled urls that the counts leave out: the score at which the
rates of right decisions of both classes are largest together.

The model is a table that grows with the urls: one row for each gram, of every order, that stands in any url. Counts are summed
per distinct piece, then per gram, before they are shuffled. A gram joins its shorter one, and a shorter one meets at most one
gram per character of the alphabet, so no key is hot. Each distinct piece is scored once. A url joins its pieces' scores: those
that make up more than a thousandth of all pieces (at most 1,000 of them) are broadcast, the rest are joined by shuffle or,
below ``BROADCAST_BYTES``, broadcast.

Defined results: a null url and one without ``://`` have empty host and path, which no rule fits and whose score is 0; without
ruled urls of both classes the models decide nothing and the verdict is allow; repeated rows are judged alike and each
counts; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import materialize, sized_broadcast

#: (verdict, rule): a host, then a path prefix.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETA, CONTEXT, SYMBOLS = 4.0, 5, 256
FOLDS = 5
BLOCK = 256  # characters of a run
HOT = 1000  # a piece is hot above this fraction of all pieces, so there are fewer hot pieces than this
START = "\x02"
_FIXED = 1e9  # scores are summed as integers of this fraction, so that sums do not depend on their order


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substr(url, F.instr(url, "://") + 3)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def match_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, prefix = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + prefix)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def pieces(text: Column) -> Column:
    """The text cut after each slash and dot: array<string>."""
    return F.regexp_extract_all(text, F.lit(r"[^/.]*[/.]|[^/.]+"), 0)


def grams(piece: Column) -> Column:
    """Each character of a piece after its context, the start mark included: array<string>."""
    text = F.concat(F.lit(START), piece)

    def block(b: Column) -> Column:
        at = b * BLOCK + 2  # the first character of the block in the marked piece, counted from 1
        first = F.greatest(at - CONTEXT, F.lit(1))
        return F.struct((at - first + 1).alias("at"), F.substr(text, first, at + BLOCK - first).alias("run"))

    def ending(run: Column, j: Column) -> Column:
        first = F.greatest(j - CONTEXT, F.lit(1))
        return F.substr(run, first, j - first + 1)

    # a long piece is cut into runs first: within a run a character is near the start, so the work grows with the piece's length
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.length(piece) - 1) / BLOCK).cast("int")), block)
    return F.flatten(F.transform(blocks, lambda x: F.transform(F.sequence(x["at"], F.length(x["run"])), lambda j: ending(x["run"], j))))


def log_ratios(counts: DataFrame) -> DataFrame:
    """gram, yes, no -> gram and r, its log ratio as an integer of 1e-9."""
    length = F.length("gram")
    lower = None
    found = []
    for k in range(CONTEXT + 1):
        seen = counts.where(length > k).groupBy(F.substring("gram", -(k + 1), k + 1).alias("gram")).agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
        context = F.substring("gram", 1, k)
        sums = seen.groupBy(context.alias("h")).agg(F.sum("yes").alias("hyes"), F.sum("no").alias("hno"))
        rows = seen.withColumn("h", context).join(sums, "h").drop("h")
        if lower is None:
            rows = rows.withColumns({"pyes": F.lit(1.0 / SYMBOLS), "pno": F.lit(1.0 / SYMBOLS)})
        else:
            rows = rows.join(lower.withColumnRenamed("gram", "rest"), F.substring("gram", 2, k) == F.col("rest")).drop("rest")
        p = {c: (F.col(c) + BETA * F.col(f"p{c}")) / (F.col(f"h{c}") + BETA) for c in ("yes", "no")}
        lower = materialize(rows.select("gram", p["yes"].alias("pyes"), p["no"].alias("pno")), f"url-order{k}")
        whole = lower if k == CONTEXT else lower.where(F.col("gram").startswith(START))
        found.append(whole.select("gram", F.round((F.log("pyes") - F.log("pno")) * _FIXED).cast("long").alias("r")))
    model = found[0]
    for more in found[1:]:
        model = model.unionByName(more)
    return model


def with_score(rows: DataFrame, counted: DataFrame, model: DataFrame) -> DataFrame:
    """``rows`` (with unique ``row`` and text ``u``) and the length-normalised log-likelihood difference as score; 0 for an empty text.

    ``counted`` holds every distinct piece of ``rows``, its number ``id`` and how often it stands there (``n``). Grams carry the number, as
    a long piece would be copied for each of them.
    """
    model = materialize(model, "url-model")
    text_grams = counted.select("id", F.explode(grams(F.col("piece"))).alias("gram"))
    by_piece = text_grams.join(sized_broadcast(model, model.count(), 64), "gram").groupBy("id").agg(F.sum("r").alias("r"), F.count("*").alias("chars"))
    sized = counted.groupBy().agg(F.sum("n").alias("all"))
    scores = materialize(by_piece.join(counted.select("id", "piece", "n"), "id").withColumn("hot", F.col("n") * HOT > materialize(sized, "url-sum").scalar()).drop("n", "id"), "url-scores")
    hot = scores.where("hot").select("piece", F.col("r").alias("hot_r"), F.col("chars").alias("hot_chars"))
    cold = scores.where("NOT hot").select(F.col("piece").alias("key"), "r", "chars")
    size = cold.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("key") + 32), F.lit(0))).first()
    parts = rows.select("row", F.explode(pieces(F.col("u"))).alias("piece")).join(F.broadcast(hot), "piece", "left")
    # pieces that the hot ones settle get keys of their own, so that they spread
    key = F.when(F.col("hot_r").isNull(), F.col("piece")).otherwise(F.concat(F.lit(START), F.col("row").cast("string")))
    parts = parts.withColumn("key", key).join(sized_broadcast(cold, 1, size[1]), "key", "left")
    sums = parts.groupBy("row").agg(F.sum(F.coalesce("hot_r", "r")).alias("r"), F.sum(F.coalesce("hot_chars", "chars")).alias("chars"))
    mean = F.col("r") / F.col("chars") / _FIXED
    return rows.join(sums, "row", "left").select(*rows.columns, F.coalesce(mean, F.lit(0.0)).alias("score"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, score."""
    host, path = split_url(pages["url"])
    split = pages.select(pages["page_id"], host.alias("host"), path.alias("path"))
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    ruled = split.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), F.concat("host", "path").alias("u"))
    ruled = materialize(ruled.withColumn("row", F.monotonically_increasing_id()), "url-rows")
    left_out = F.pmod(F.xxhash64("u"), F.lit(FOLDS)) == 0
    yes = F.when(F.col("ruled") == "allow", 1).otherwise(0)
    counts = F.when(F.col("rule").isNotNull() & ~left_out, 1).otherwise(0)
    every = ruled.select((counts * yes).alias("yes"), (counts * (1 - yes)).alias("no"), F.explode(pieces(F.col("u"))).alias("piece"))
    counted = materialize(every.groupBy("piece").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"), F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()), "url-pieces")
    seen = counted.select("yes", "no", F.explode(grams(F.col("piece"))).alias("gram")).groupBy("gram").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    model = log_ratios(materialize(seen, "url-counts"))
    scored = materialize(with_score(ruled, counted, model), "url-scored")
    # calibration: classes by score in 401 bins
    calibration = scored.where(left_out & F.col("rule").isNotNull()).select(yes.alias("yes"), F.round(F.greatest(F.lit(-4.0), F.least(F.lit(4.0), F.col("score"))) * 50).cast("int").alias("bin"))
    bins = calibration.groupBy("bin").agg(F.sum("yes").alias("y"), F.sum(1 - F.col("yes")).alias("n"))
    listed = bins.agg(F.array_sort(F.collect_list(F.struct("bin", "y", "n"))).alias("b"), F.sum("y").alias("ys"), F.sum("n").alias("ns"))
    # each bin as the least that is allowed; the threshold lies halfway to the bin below it
    gain = F.transform(
        "b",
        lambda x, i: F.struct(
            F.aggregate("b", F.lit(0.0), lambda a, z: a + F.when(z["bin"] >= x["bin"], z["y"] / F.col("ys")).otherwise(z["n"] / F.col("ns"))).alias("right"),
            (-F.coalesce((F.get("b", i - 1)["bin"] + x["bin"]) / 2, x["bin"] - F.lit(1.0))).alias("at"),
        ),
    )
    best = F.when((F.col("ys") > 0) & (F.col("ns") > 0), -F.array_max(gain)["at"] / 50.0).otherwise(F.lit(-1e9))
    threshold = materialize(listed.select(F.coalesce(best, F.lit(-1e9)).alias("t")), "url-threshold").scalar()
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= threshold, "allow").otherwise("block")).alias("verdict"), "score")

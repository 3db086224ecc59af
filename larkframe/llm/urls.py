"""URL filter: host and path rules, then gradient-boosted trees on lexical features.

Everything is DataFrame expressions. The features are lexical alone: lengths,
depth, digit ratio, entropy, numbers of parameters, labels and dashes, and learned
statistics of suffixes (the top-level domain, what the path ends with). Suffixes are counted in hashed buckets of a fixed number, so
that their table has a bound and no suffix is a hot key.

The trees are oblivious (one split per level) and are fitted by histogram boosting
with a logistic loss: the labelled URLs are first summed up by their binned
features, which is all that boosting ever sees; each level of each tree is one
aggregation that returns a histogram of fixed size. A fitted model is a SQL
expression.

Labels are the verdicts of the rules; the model judges the URLs that no rule fits.
What decides a rule by a path's beginning is not among the features: `held_out`
tells how far lexical features go without it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkframe.llm.common import stage

#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Upper edges of the features' bins.
EDGES = {
    "length": (20, 26, 30, 34, 38, 42, 46, 50, 56, 64, 80, 110, 160, 240),
    "path_length": (1, 3, 5, 7, 9, 11, 13, 16, 20, 26, 34, 50, 80),
    "depth": (0, 1, 2, 3, 4, 5, 6, 8, 12),
    "digit_ratio": (0.0, 0.02, 0.04, 0.06, 0.08, 0.1, 0.13, 0.16, 0.2, 0.3, 0.5),
    "entropy": (2.0, 2.5, 3.0, 3.25, 3.5, 3.6, 3.7, 3.8, 3.9, 4.0, 4.1, 4.2, 4.35, 4.5, 5.0),
    "params": (0, 1, 2, 3, 4, 6, 10),
    "labels": (0, 1, 2, 3, 4, 5, 7),
    "dashes": (0, 1, 2, 3, 5, 8),
    "host_suffix": (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98),
    "path_end": (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98),
}
TREES, DEPTH, RATE, RIDGE = 8, 3, 0.4, 2.0
#: Weight of the overall block rate in a suffix's statistic.
PRIOR = 8.0
#: Hashed buckets that the texts of a suffix statistic are counted in.
BUCKETS = 4096
#: Folds of URLs whose labels are kept from their own statistics.
FOLDS = 5


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first `://` up to `/`, `?`, `#` or end, A-Z lowered; path up to `?`, `#` or end. Both empty without `://`."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matched(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits: struct(rule, verdict), or null; of equally long ones the one given last."""
    found = F.lit(None)
    for own_host, own_path, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(own_path)
        found = F.when(fits, F.struct(F.lit(own_host + own_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _entropy(text: Column) -> Column:
    """Shannon entropy of a string's characters in bits."""
    chars = F.split(text, "")
    n = F.length(text)
    each = F.transform(F.array_distinct(chars), lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(each, F.lit(0.0), lambda a, p: F.when(p > 0, a - p * F.log2(p)).otherwise(a))).otherwise(0.0)


def bucket(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(BUCKETS)).cast("int")


def lexical(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path and the lexical features; the suffixes whose statistics are learned are h_* and e_*, as buckets."""
    host, path = parts(F.col("url"))
    url = F.coalesce(F.col("url"), F.lit(""))
    df = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    digits = F.regexp_count(url, F.lit("[0-9]"))
    last = F.regexp_extract("path", r"([^/]*)/?$", 1)
    return df.select(
        "page_id", "url", "host", "path",
        F.length(url).cast("double").alias("length"),
        F.length("path").cast("double").alias("path_length"),
        F.regexp_count("path", F.lit("/")).cast("double").alias("depth"),
        F.when(F.length(url) > 0, digits / F.length(url)).otherwise(0.0).alias("digit_ratio"),
        _entropy(url).alias("entropy"),
        F.when(url.contains("?"), F.regexp_count(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit("[^&]+"))).otherwise(0).cast("double").alias("params"),
        F.regexp_count("host", F.lit(r"\.")).cast("double").alias("labels"),
        F.regexp_count("host", F.lit("-")).cast("double").alias("dashes"),
        bucket(F.regexp_extract("host", r"([^.]*)$", 1)).alias("h_suffix"),
        bucket(F.when(last.contains("."), F.regexp_extract(last, r"(\.[^.]*)$", 1)).when(F.col("path").endswith("/"), "/").otherwise("")).alias("e_end"),
    )


#: Learned statistics: feature, its text.
STATISTICS = (("host_suffix", "h_suffix"), ("path_end", "e_end"))


def with_statistics(df: DataFrame, labelled: DataFrame, rate: float, apart: bool = False) -> DataFrame:
    """Adds the smoothed share of blocked URLs per suffix text, from `labelled` (the texts, y, fold).

    With `apart`, a row's own fold of URLs does not count, so that a model
    fitted on the statistics does not see a row's label in them.
    """
    for feature, text in STATISTICS:
        folds = labelled.groupBy(text, "fold").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
        known = folds.groupBy(text).agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
        # Broadcast: at most BUCKETS rows, or FOLDS times as many.
        if apart:
            known = known.join(folds, text)
            ratio = (F.col("ts") - F.col("s") + PRIOR * rate) / (F.col("tn") - F.col("n") + PRIOR)
            df = df.join(F.broadcast(known.select(text, "fold", ratio.alias(feature))), [text, "fold"], "left")
        else:
            df = df.join(F.broadcast(known.select(text, ((F.col("ts") + PRIOR * rate) / (F.col("tn") + PRIOR)).alias(feature))), text, "left")
        df = df.withColumn(feature, F.coalesce(feature, F.lit(rate)))
    return df


def binned(feature: str) -> Column:
    """The number of edges below a feature's value."""
    return sum((F.when(F.col(feature) > float(e), 1).otherwise(0) for e in EDGES[feature]), F.lit(0))


@dataclass
class Boosted:
    """Oblivious boosted trees over binned features: bias, and per tree its splits and leaf values."""

    bias: float = 0.0
    trees: list = field(default_factory=list)

    def leaf(self, splits: list) -> Column:
        return sum((F.when(F.col(f"b_{f}") > cut, 1 << level).otherwise(0) for level, (f, cut) in enumerate(splits)), F.lit(0))

    def margin(self) -> Column:
        total = F.lit(self.bias)
        for splits, values in self.trees:
            total = total + F.element_at(F.array(*[F.lit(v) for v in values]), self.leaf(splits) + 1)
        return total


def fit(examples: DataFrame, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Boosted:
    """Fits the trees to `examples`: b_<feature> (int) and y (0 or 1). No examples: a model that allows everything."""
    names = list(EDGES)
    packed = stage(examples.groupBy(*[f"b_{f}" for f in names]).agg(F.count("*").alias("n"), F.sum("y").cast("double").alias("pos")), "url-examples")
    n, pos = packed.agg(F.sum("n"), F.sum("pos")).first()
    model = Boosted()
    if not n:
        model.bias = -1.0
        return model
    model.bias = math.log((pos + 1) / (n - pos + 1))
    bins = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"b_{f}").alias("bin")) for f in names]))
    for _ in range(trees):
        p = 1 / (1 + F.exp(-model.margin()))
        grads = packed.select("*", (F.col("pos") - F.col("n") * p).alias("g"), (F.col("n") * p * (1 - p)).alias("h"))
        splits: list = []
        for _ in range(depth):
            seen = grads.select(model.leaf(splits).alias("leaf"), "g", "h", bins.alias("x")).groupBy("leaf", "x.f", "x.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            hist: dict = {}
            for r in seen:
                hist.setdefault(r.f, {}).setdefault(r.leaf, []).append((r.bin, r.g, r.h))
            best = (1e-9, None)
            for f in names:
                for at in range(len(EDGES[f])):
                    gain = 0.0
                    for rows in hist.get(f, {}).values():
                        g, h = math.fsum(x[1] for x in rows), math.fsum(x[2] for x in rows)
                        g1, h1 = math.fsum(x[1] for x in rows if x[0] > at), math.fsum(x[2] for x in rows if x[0] > at)
                        gain += g1 * g1 / (h1 + RIDGE) + (g - g1) ** 2 / (h - h1 + RIDGE) - g * g / (h + RIDGE)
                    if gain > best[0] * (1 + 1e-9):
                        best = (gain, (f, at))
            if best[1] is None:
                break
            splits.append(best[1])
        if not splits:
            break
        sums = {r.leaf: (r.g, r.h) for r in grads.groupBy(model.leaf(splits).alias("leaf")).agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()}
        values = [rate * sums[k][0] / (sums[k][1] + RIDGE) if k in sums else 0.0 for k in range(1 << len(splits))]
        model.trees.append((splits, values))
    return model


def _known(pages: DataFrame, rules) -> tuple[DataFrame, DataFrame]:
    """(features of all pages and the rule that hits each, the labelled ones with y and fold)."""
    known = stage(lexical(pages.select("page_id", "url")).withColumn("hit", matched(F.col("host"), F.col("path"), rules)), "url-features")
    labelled = known.filter("hit is not null").withColumn("y", (F.col("hit.verdict") == "block").cast("int"))
    return known, labelled.withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS)))


def _bins() -> list[Column]:
    return [binned(f).alias(f"b_{f}") for f in EDGES]


def _fitted(labelled: DataFrame) -> tuple[Boosted, float]:
    rate = labelled.agg(F.coalesce(F.avg("y"), F.lit(0.5))).first()[0]
    return fit(with_statistics(labelled, labelled, rate, apart=True).select("y", *_bins())), rate


def held_out(pages: DataFrame, rules=RULES) -> DataFrame:
    """What the model says of labelled URLs that it has not seen: n, right, log_loss and base_loss (of the block rate alone).

    A fold by the URL's hash is held out: equal URLs are on one side.
    """
    _, labelled = _known(pages, rules)
    seen, apart = labelled.filter("fold > 0"), labelled.filter("fold = 0")
    model, rate = _fitted(seen)
    judged = with_statistics(apart, seen, rate).select("y", *_bins()).select("y", model.margin().alias("m"))
    loss = F.when(F.col("y") == 1, F.log1p(F.exp(-F.col("m")))).otherwise(F.log1p(F.exp("m")))
    base = F.when(F.col("y") == 1, -math.log(max(rate, 1e-9))).otherwise(-math.log(max(1 - rate, 1e-9)))
    return judged.agg(F.count("*").alias("n"), F.avg(((F.col("m") > 0) == (F.col("y") == 1)).cast("double")).alias("right"), F.avg(loss).alias("log_loss"), F.avg(base).alias("base_loss"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """The verdict on every URL: page_id, host, path, rule, verdict, score (the model's chance to block).

    Null and empty URLs and those without `://` have empty host and path and are
    judged by the model. URLs are taken whole, however long. Repeated rows are judged
    alike; of rules that fit the longest decides, of equally long ones the last. Other
    columns, whatever their names, take no part. No rows give no rows.
    """
    known, labelled = _known(pages, rules)
    model, rate = _fitted(labelled)
    scored = with_statistics(known, labelled, rate).select("page_id", "host", "path", "hit", *_bins())
    margin = model.margin()
    return scored.select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce(F.col("hit.verdict"), F.when(margin > 0, "block").otherwise("allow")).alias("verdict"),
        (1 / (1 + F.exp(-margin))).alias("score"),
    )

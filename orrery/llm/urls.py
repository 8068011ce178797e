"""URL filters: rules first, then logistic regression on hashed character n-grams of host and path.

Everything runs as Column expressions: parsing, rules, n-gram hashing, training (gradient steps are aggregations over the
small labelled table) and scoring (a look-up in an array of fixed length per n-gram). No Python touches a row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick

#: Rules of the query: what they name, and what becomes of it.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]

#: Hashed features: their number is the length of the model.
SLOTS = 4096
N = 4

#: Words of hosts and paths that the labelled table is made of: (labelled block, labelled allow).
BLOCK_WORDS = "casino bets poker jackpot slots pills viagra pharma spam farm ads track tracker popup adult xxx porn sex cams malware phish warez crack keygen torrent cheap free win winner loan payday"
ALLOW_WORDS = "news blog wiki docs library school museum garden travel recipes science weather sports music forum history health market photo city books maps code research daily times review studio journal guide"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; without ``://``, empty."""
    return F.coalesce(F.translate(F.regexp_extract(_after(url), r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; without ``://``, empty."""
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*(/[^?#]*)", 1), F.lit(""))


def _after(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))


# --- rules ------------------------------------------------------------------------------------------------------


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def fits(rule: str, host: Column, path: Column) -> Column:
    """The rule's host or a subdomain of it, and a path that starts with the rule's."""
    h, p = split_rule(rule)
    return ((host == h) | host.endswith("." + h)) & path.startswith(p)


def matched(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does. A list of rules is code, not data: for long
    lists, use :func:`match_table`."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r, v in sorted(rules, key=lambda x: (len(x[0]), x[0])):
        ok = fits(r, host, path)
        rule, verdict = F.when(ok, r).otherwise(rule), F.when(ok, v).otherwise(verdict)
    return rule, verdict


def match_table(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Append rule and verdict from a table of rules (rule, verdict) of any length to (host, path, ...).

    Each host is expanded to its suffixes, which meet the rules' hosts in an equi-join; of what fits, the longest wins.
    """
    r = rules.select("rule", "verdict", F.substring_index("rule", "/", 1).alias("_host"))
    r = r.withColumn("_path", F.expr("substring(rule, length(_host) + 1)"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    # Hosts and paths are distinct before they meet the rules: a common host meets them once.
    urls = pages.select("host", "path").distinct()
    hit = urls.withColumn("_host", F.explode(suffixes)).join(r, "_host").where(F.startswith("path", "_path"))
    best = hit.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "rule")).alias("best"))
    best = best.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "best")
    return pages.join(best, F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p")), "left").select(*pages.columns, "best.rule", "best.verdict")


# --- the model --------------------------------------------------------------------------------------------------


def slots(host: Column, path: Column) -> Column:
    """Slots of the distinct character n-grams of host and of path; digits count alike."""
    mark = F.concat(F.lit("^"), host, F.lit("$"), F.regexp_replace(path, "[0-9]+", "0"))
    n = F.length(mark) - (N - 1)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.pmod(F.hash(F.substring(mark, i, F.lit(N))), F.lit(SLOTS)))
    return F.array_distinct(grams)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """A small table (url, label) made of words: label 1 for hosts to block."""
    rows = []
    for label, words in ((1, BLOCK_WORDS.split()), (0, ALLOW_WORDS.split())):
        for i, w in enumerate(words):
            other = words[(i * 7 + 3) % len(words)]
            for k, (scheme, lead) in enumerate((("https", "www."), ("http", ""), ("https", "blog."), ("https", "m."))):
                host = (f"{w}-{other}", f"{w}{other}", w + "-x" * label, f"{other}-{w}")[k]
                zone = ("com", "net", "org", "com")[(i + k) % 4]
                rows.append((f"{scheme}://{lead}{host}.example.{zone}/{('en', 'de', 'fr', 'es')[(i + k) % 4]}/{(i * 37 + k * 11) % 1000}", label))
    # Plain hosts of made-up syllables are harmless: the prior for what carries no sign of either kind.
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    for i in range(60):
        host = "".join(syllables[(i * a + b) % len(syllables)] for a, b in ((7, 1), (11, 3), (13, 5), (17, 2))[: 2 + i % 3])
        rows.append((f"https://{('www.', '', 'blog.', 'm.')[i % 4]}{host}.example.{('com', 'net', 'org')[i % 3]}/{('en', 'de', 'fr', 'es')[i % 4]}/{i * 7 % 1000}", 0))
    return spark.createDataFrame(rows, "url string, label int")


def train(labelled: DataFrame, steps: int = 16, rate: float = 1.5, decay: float = 1e-4) -> tuple[list[float], float]:
    """Weights and intercept of a logistic regression; the table is small and bounded by whoever labels it.

    Each step is one aggregation: predictions from the weights of the step before, gradients summed by slot; at most
    SLOTS + 1 sums come back, which set the next weights with a step of their own each (AdaGrad).
    """
    x = labelled.where("label in (0, 1)").select(slots(host_of(F.col("url")), path_of(F.col("url"))).alias("f"), F.col("label").cast("double").alias("y")).cache()
    n = x.count()
    w, b, seen, seen_b = [0.0] * SLOTS, 0.0, [1e-12] * SLOTS, 1e-12
    for _ in range(steps if n else 0):
        err = x.select("f", (F.col("y") - probability(F.col("f"), w, b)).alias("e"))
        each = err.select(F.explode(F.concat("f", F.array(F.lit(-1)))).alias("slot"), F.col("e"), (F.col("e") / F.sqrt(F.size("f").cast("double"))).alias("part"))
        for r in each.groupBy("slot").agg(F.sum("part").alias("part"), F.sum("e").alias("e")).collect():
            if r.slot < 0:
                seen_b += (r.e / n) ** 2
                b += 0.3 * (r.e / n) / math.sqrt(seen_b)
            else:
                g = r.part / n - decay * w[r.slot]
                seen[r.slot] += g * g
                w[r.slot] += rate * g / math.sqrt(seen[r.slot])
    x.unpersist()
    return w, b


def probability(f: Column, w: list[float], b: float) -> Column:
    """Probability of label 1: looks each slot up in the array of weights."""
    # One literal string parsed once per plan costs less than thousands of literals.
    weights = F.from_json(F.lit("[" + ",".join(f"{v:.6g}" for v in w) + "]"), "array<double>")
    total = F.aggregate(f, F.lit(0.0), lambda acc, i: acc + F.get(weights, i))
    z = total / F.sqrt(F.greatest(F.size(f), F.lit(1)).cast("double")) + b
    return 1 / (1 + F.exp(-z))


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score (probability to block) of every page's url.

    Null urls and such without ``://`` have an empty host and path, and only the model judges them: too little to
    block. Of rules that fit, the longest wins, whatever the model says. Repeated rows are judged each. Only page_id
    and url are read.
    """
    spark = pages.sparkSession
    w, b = train(labelled if labelled is not None else labelled_urls(spark))
    d = pick(pages, "page_id", "url", types={"page_id": "bigint", "url": "string"})
    d = d.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = matched(rules, F.col("host"), F.col("path"))
    d = d.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("_given"), slots(F.col("host"), F.col("path")).alias("_f"))
    d = d.withColumn("score", F.when(F.col("host") == "", F.lit(0.0)).otherwise(probability(F.col("_f"), w, b)))
    return d.select("page_id", "host", "path", "rule", F.coalesce("_given", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")

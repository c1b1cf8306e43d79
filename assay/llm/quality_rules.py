"""Quality rules at host level, in DataFrame functions only.

Each document is measured and held against a few rules. Failures are summed by host, each host's failure
rate is shrunk towards the rate of all hosts under a Beta prior fitted to the hosts by the method of
moments, and the shrunk rate comes back to the host's documents as prior odds that a document is bad. The
document's own failures (or their absence) add to these odds; it is kept while they stay below even. So a
clean document falls only with a host that fails almost always, and a small lapse counts more on a host
known for them.

Defined cases: null text has no words and fails the base rule; a null host is one host of its own, named
by the empty string; repeated rows count each and are all returned; an empty table returns no rows; texts
of any length are measured whole; odds of exactly even reject; further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Base rule.
LEAST_WORDS = 20
REPEAT_WINDOW = 8
MOST_REPEAT_PERCENT = 30
#: Log odds that a document is bad, added to its host's: for each failed strong or weak rule, and for none failed.
STRONG, WEAK, CLEAN = 4.0, 1.5, -2.0
#: A rate's least and most, and the prior's least and most weight in documents.
RATE_BOUNDS = (0.001, 0.999)
WEIGHT_BOUNDS = (1.0, 1000.0)
#: Hosts up to which their verdicts are broadcast; beyond it documents are joined to hosts by a salted shuffle.
BROADCAST_HOSTS = 200_000
SALTS = 64

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The measures, by name, in the order in which they are returned.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``, however often that uses it."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside windows of REPEAT_WINDOW words that stand twice or more in the text."""
    w = REPEAT_WINDOW

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(-w).cast("long").alias("last"))
        step = lambda acc, p: F.struct((acc["total"] + F.least(F.lit(w).cast("long"), p - acc["last"])).alias("total"), p.alias("last"))
        return F.aggregate(at, start, step, lambda acc: acc["total"])

    def repeated(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
        twice = lambda s: F.filter(s, lambda x, k: (F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))))
        positions = let(placed, lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"])))
        return F.when(F.size(windows) == F.size(F.array_distinct(windows)), F.lit(0).cast("long")).otherwise(let(positions, covered))

    hashed = lambda ws: F.transform(ws, lambda x: F.xxhash64(x))
    windows = lambda hs: F.transform(F.sequence(F.lit(1), F.size(hs) - (w - 1)), lambda i: F.xxhash64(F.slice(hs, i, w)))
    return F.when(F.size(words) < w + 1, F.lit(0).cast("long")).otherwise(let(hashed(words), lambda hs: let(windows(hs), repeated)))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the struct column __m: the measures of MEASURES and what the method's own rules need."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def measures(words: Column) -> Column:
        letters = F.length(F.array_join(words, ""))
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            letters.cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.size(x).cast("long").alias("n"))).alias("lines"),
            _repeat_words(words).alias("n_repeat_words"),
            (F.length(text) - F.length(F.translate(text, CAPITALS, ""))).cast("long").alias("n_capitals"),
        )

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    return docs.withColumn("__m", let(words, measures))


def _rules(m: Column) -> tuple[Column, Column, Column]:
    """(base failed, strong rules failed, weak rules failed)."""
    base = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEAT_PERCENT * m["n_words"])
    strong = [4 * m["n_symbols"] > m["n_words"], 2 * m["n_capitals"] > m["word_chars"]]
    weak = [100 * m["lines"]["dup"] > 30 * m["lines"]["n"], (m["word_chars"] > 20 * m["n_words"]) | (m["word_chars"] < 2 * m["n_words"]), 20 * m["n_symbols"] > m["n_words"]]
    count = lambda rules: sum((r.cast("int") for r in rules[1:]), rules[0].cast("int"))
    return base, count(strong), count(weak)


def host_odds(flagged: DataFrame) -> DataFrame:
    """From (__host, __failed): __host and __odds, the log odds of its shrunk failure rate."""
    hosts = flagged.groupBy("__host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("__failed").cast("long")).alias("k"))
    rate = F.col("k") / F.col("n")
    prior = hosts.agg(F.avg(rate).alias("mean"), F.var_samp(rate).alias("spread"), F.avg(1 / F.col("n")).alias("inverse"))
    low, high = (F.lit(x) for x in RATE_BOUNDS)
    mean = F.least(F.greatest(F.coalesce(F.col("mean"), F.lit(0.5)), low), high)
    own = mean * (1 - mean)
    between = F.greatest(F.coalesce(F.col("spread"), F.lit(0.0)) - own * F.coalesce(F.col("inverse"), F.lit(0.0)), F.lit(1e-9))
    weight = F.least(F.greatest(own / between - 1, F.lit(WEIGHT_BOUNDS[0])), F.lit(WEIGHT_BOUNDS[1]))
    prior = prior.select(mean.alias("__mean"), weight.alias("__weight"))
    shrunk = (F.col("k") + F.col("__mean") * F.col("__weight")) / (F.col("n") + F.col("__weight"))
    return hosts.join(F.broadcast(prior)).select("__host", F.log(shrunk / (1 - shrunk)).alias("__odds"))


def judged(docs: DataFrame, text_col: str = "text", host_col: str = "source", columns: list[str] | None = None) -> DataFrame:
    """The wanted columns of ``docs`` (all by default) with __m (measures), __base_failed and __kept."""
    spark = docs.sparkSession
    wanted = ["`" + c.replace("`", "``") + "`" for c in (docs.columns if columns is None else columns)]
    base, strong, weak = _rules(F.col("__m"))
    flagged = measured(docs.select(*dict.fromkeys([*wanted, f"`{text_col}`", f"`{host_col}`"])), text_col).select(
        *wanted,
        "__m",
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("__host"),
        base.alias("__base_failed"),
        strong.alias("__strong"),
        weak.alias("__weak"),
    )
    flagged = flagged.withColumn("__failed", F.col("__base_failed") | (F.col("__strong") > 0) | (F.col("__weak") > 0))
    flagged = materialise(flagged, "measured")
    hosts = materialise(host_odds(flagged), "hosts")
    if hosts.count() <= BROADCAST_HOSTS:
        joined = flagged.join(F.broadcast(hosts), "__host")
    else:
        salted = hosts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = flagged.withColumn("__salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")).join(salted, ["__host", "__salt"]).drop("__salt")
    own = STRONG * F.col("__strong") + WEAK * F.col("__weak") + F.when(F.col("__failed"), 0.0).otherwise(CLEAN)
    return joined.withColumn("__kept", ~F.col("__base_failed") & (F.col("__odds") + own < 0)).select(*wanted, "__m", "__base_failed", "__odds", "__kept")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per document: doc_id, the measures, base_failed, kept."""
    out = judged(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(host_col).alias("host")), "text", "host", ["doc_id"])
    m = F.col("__m")
    return out.select("doc_id", m["n_words"].alias("n_words"), m["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"), m["lines"]["dup"].alias("n_dup_lines"), m["n_repeat_words"].alias("n_repeat_words"), F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))


def passing(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns."""
    packed = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"), F.col(host_col).alias("host"))
    return judged(packed, "text", "host", ["row"]).where("__kept").select("row.*")


#: The query as SQL over ``documents``.
ORACLE_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents
), split AS (
  SELECT rid, doc_id, host, t,
    list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM texts
), words AS (
  SELECT rid, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM split
), windows AS (
  SELECT rid, i, list(w) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS g FROM words
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM windows WHERE len(g) = 8) WHERE c > 1
), covered AS (
  SELECT rid, count(DISTINCT i + k.k) AS n FROM twice, (SELECT unnest(range(8)) AS k) k GROUP BY rid
), m AS (
  SELECT s.rid, doc_id, host,
    len(ws)::BIGINT AS n_words,
    length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    len(ls)::BIGINT AS n_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_capitals
  FROM split s LEFT JOIN covered c ON s.rid = c.rid
), r AS (
  SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
    (4 * n_symbols > n_words)::INT + (2 * n_capitals > word_chars)::INT AS strong,
    (100 * n_dup_lines > 30 * n_lines)::INT + (word_chars > 20 * n_words OR word_chars < 2 * n_words)::INT + (20 * n_symbols > n_words)::INT AS weak
  FROM m
), h AS (
  SELECT host, count(*) AS n, sum((base_failed OR strong > 0 OR weak > 0)::INT) AS k FROM r GROUP BY host
), p0 AS (
  SELECT least(greatest(coalesce(avg(k / n::DOUBLE), 0.5), 0.001), 0.999) AS mean, coalesce(var_samp(k / n::DOUBLE), 0) AS spread, coalesce(avg(1 / n::DOUBLE), 0) AS inverse FROM h
), p AS (
  SELECT mean, least(greatest(mean * (1 - mean) / greatest(spread - mean * (1 - mean) * inverse, 1e-9) - 1, 1.0), 1000.0) AS weight FROM p0
), o AS (
  SELECT host, (k + mean * weight) / (n + weight) AS rate FROM h, p
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND ln(rate / (1 - rate)) + 4.0 * strong + 1.5 * weak + CASE WHEN base_failed OR strong > 0 OR weak > 0 THEN 0.0 ELSE -2.0 END < 0) AS kept
FROM r JOIN o ON r.host = o.host
"""

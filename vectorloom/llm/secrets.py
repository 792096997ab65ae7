"""Secret scans with SQL functions alone: fixed patterns, and a battery of randomness tests for anything that looks drawn at random.

Base spans are the leftmost non-overlapping matches of three patterns. The battery adds others: each run of an encoding's
characters outside base spans gets an inferred encoding; a chi-squared test of its symbols' uniformity, a runs test and a
test of serial correlation give the p-value of its being random symbols. Runs with p below LEAST_P are not. Among the
others false discoveries are controlled in each stratum of encoding and length: p is uniform for random runs and small
for others, so the runs with p of at least one half tell how many random ones there are; the excess over those is the
share of false discoveries among the runs at some p or above. A run whose q-value, the least such share over all limits
that let it in, is at most FALSE_DISCOVERY is reported as a secret of kind `random`.

Matches become rows, and their places are running sums over a document's matches, so a text with any number of them is
scanned in linear work.

Defined results: a null text is empty; documents without spans have zero counts and the digest of an empty string; ties
of start are in the order of KINDS, then of ends; each of repeated rows gets the same result; very long texts are
scanned whole; an empty table gives an empty result; other columns, whatever their names, are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table, texts

#: Kinds as listed: name, pattern whose matches are spans, and the group and length that a match needs.
KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    # the longest runs with so many characters are the matches of `+` that are long enough
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
RANDOM = "random"
#: Runs that the battery tests: in the alphabet of base64, and in that of its form for URLs; = only pads.
CANDIDATES = (r"[A-Za-z0-9+/]{20,}={0,2}", r"[A-Za-z0-9_-]{20,}={0,2}")
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings, the first that fits counts: name, pattern, alphabet, least length at which prose would be discovered.
ENCODINGS = (
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef", 32),
    ("base32", r"^[A-Z2-7]+=*$", UPPER + "234567", 26),
    ("base64", r"^[A-Za-z0-9+/]+=*$", UPPER + LOWER + DIGITS + "+/", 24),
    ("base64url", r"^[A-Za-z0-9_-]+=*$", UPPER + LOWER + DIGITS + "-_", 24),
)
FALSE_DISCOVERY = 0.05
#: p-values are kept on a grid of so many steps a decade, rounded up; steps of EDGE or beyond are too small to be random.
GRID, LEAST_P = 20, 1e-3
EDGE = 60


def _row(place: int):
    return lambda x, i: F.struct(F.lit(place).alias("place"), i.alias("i"), F.length(x["gap"]).cast("long").alias("gap"), x["m"].alias("match"))


def _found(text: Column) -> Column:
    """All matches of all patterns in a text, as (place, i, gap, match): the pattern's, the match's number, the code points since the match before. A text without a match of a pattern costs one search."""
    parts = []
    for place, pattern in enumerate([k[1] for k in KINDS] + list(CANDIDATES)):
        both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
        parts.append(F.when(text.rlike(pattern), F.transform(both, _row(place))).otherwise(F.array().cast("array<struct<place:int,i:int,gap:bigint,match:string>>")))
    return F.filter(F.concat(*parts), lambda x: x["match"].isNotNull())


def spans_of(rows: DataFrame) -> DataFrame:
    """(rid, place, start, end, match) in code points, from (rid, found)."""
    w = Window.partitionBy("rid", "place").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    n = F.length("match").cast("long")
    return rows.select("rid", F.inline("found")).withColumn("end", F.sum(F.col("gap") + n).over(w)).select("rid", "place", (F.col("end") - n).alias("start"), "end", "match")


def _base(spans: DataFrame) -> DataFrame:
    """The matches that are long enough."""
    fits = [(F.col("place") == place) & (F.length(F.regexp_extract("match", pattern, group)) >= least) for place, (_, pattern, group, least) in enumerate(KINDS)]
    return spans.where(reduce(lambda a, b: a | b, fits))


def _clear(base: DataFrame, runs: DataFrame) -> DataFrame:
    """The runs that no base span overlaps: of the base spans that start before a run's end, none ends after its start."""
    end = F.lit(None).cast("long")
    both = base.select("rid", "place", "start", "end", "match", F.col("start").alias("at"), F.lit(1).alias("last"), F.col("end").alias("upto"))
    both = both.union(runs.select("rid", "place", "start", "end", "match", F.col("end").alias("at"), F.lit(0).alias("last"), end.alias("upto")))
    w = Window.partitionBy("rid").orderBy("at", "last").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("before", F.max("upto").over(w)).where("last = 0 and coalesce(before <= start, true)").select("rid", "place", "start", "end", "match")


def _tail(z: Column) -> Column:
    """P(Z > z) of a standard normal for z >= 0 (Abramowitz and Stegun 7.1.26)."""
    x = z / F.sqrt(F.lit(2.0))
    t = 1 / (1 + x * 0.3275911)
    poly = reduce(lambda s, a: s * t + a, (-1.453152027, 1.421413741, -0.284496736, 0.254829592), F.lit(1.061405429))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), poly * t * F.exp(-x * x) / 2))


def _battery(tokens: DataFrame) -> DataFrame:
    """Add encoding, n and p (of being random symbols: small if it isn't) to rows with `token`."""
    name, alphabet, least = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("int")
    for e, pattern, letters, n in reversed(ENCODINGS):
        fits = F.col("token").rlike(pattern)
        name, alphabet, least = F.when(fits, e).otherwise(name), F.when(fits, letters).otherwise(alphabet), F.when(fits, n).otherwise(least)
    df = tokens.withColumn("encoding", name).withColumn("alphabet", alphabet).withColumn("least", least).where("encoding is not null")
    body = F.regexp_replace("token", "=+$", "")
    df = df.withColumn("body", F.when(F.col("encoding") == "hex", F.lower(body)).otherwise(body)).withColumn("n", F.length("body")).where("n >= least").withColumn("a", F.length("alphabet"))
    counts = F.transform(F.split("alphabet", ""), lambda s: (F.col("n") - F.length(F.replace(F.col("body"), s, F.lit("")))).cast("double"))
    df = df.withColumn("chi2", F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * c) * F.col("a") / F.col("n") - F.col("n"))
    df = df.withColumn("x", F.transform(F.split("body", ""), lambda s: F.instr(F.col("alphabet"), s).cast("double") - (F.col("a") + 1) / 2))
    # chi-squared to normal by Wilson and Hilferty
    free = F.col("a") - 1
    z_chi = (F.pow(F.col("chi2") / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    halves = F.array_join(F.transform("x", lambda v: F.when(v > 0, "1").otherwise("0")), "")
    df = df.withColumn("halves", halves).withColumn("ones", F.length(F.replace("halves", F.lit("0"), F.lit(""))).cast("double"))
    df = df.withColumn("runs", F.size(F.regexp_extract_all("halves", F.lit("0+|1+"), F.lit(0))).cast("double"))
    zeros, n = F.col("n") - F.col("ones"), F.col("n").cast("double")
    both = 2 * F.col("ones") * zeros
    mean, var = both / n + 1, both * (both - n) / (n * n * (n - 1))
    z_runs = F.when(var > 0, F.abs(F.col("runs") - mean) / F.sqrt(var)).otherwise(F.sqrt(n))
    products = F.zip_with(F.slice("x", F.lit(1), F.col("n") - 1), F.slice("x", F.lit(2), F.col("n") - 1), lambda u, v: u * v)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    power = total(F.transform("x", lambda v: v * v))
    z_serial = F.when(power > 0, F.abs(total(products) / power) * F.sqrt(n)).otherwise(F.sqrt(n))
    one_sided = F.when(z_chi >= 0, _tail(z_chi)).otherwise(1 - _tail(-z_chi))
    # the least of three, as one p-value (Sidak)
    return df.withColumn("p", 1 - F.pow(1 - F.least(one_sided, F.lit(1.0), 2 * _tail(z_runs), 2 * _tail(z_serial)), F.lit(3.0)))


def q_values(tests: DataFrame) -> DataFrame:
    """(encoding, size, step, q) from (encoding, size, step, upper): the least share of false discoveries at which runs at `step` of the grid are taken for random.

    The strata are a few dozen: an encoding and a power of two each, with at most EDGE steps.
    """
    stratum = Window.partitionBy("encoding", "size")
    hist = tests.groupBy("encoding", "size", "step").agg(F.count("*").alias("n"), F.count(F.when(F.col("upper"), 1)).alias("upper"))
    random = 2 * (F.sum("upper").over(stratum) + 1)  # p is at least one half for half of the random runs
    upto = F.sum("n").over(stratum.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    share = 1 - random * (1 - F.pow(F.lit(10.0), -(F.col("step") + 1) / GRID)) / upto
    hist = hist.withColumn("share", F.greatest(F.lit(0.0), share))
    return hist.withColumn("q", F.min("share").over(stratum.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0))).select("encoding", "size", "step", "q")


def _text_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, q: float = FALSE_DISCOVERY) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random, max_q): counts of base spans, their digest, all spans as text, and the largest q-value among random ones."""
    rows = texts(docs).select("doc_id", F.monotonically_increasing_id().alias("rid"), _found(F.col("text")).alias("found"))
    rows = materialize(rows, "matches")
    spans = materialize(spans_of(rows.where(F.size("found") > 0)), "spans")
    base = _base(spans)
    runs = spans.where((F.col("place") >= len(KINDS)) & F.col("match").rlike("[0-9]") & F.col("match").rlike("[A-Za-z]")).dropDuplicates(["rid", "start", "end"])
    runs = materialize(_clear(base, runs), "runs")
    tests = _battery(runs.select(F.col("match").alias("token")).distinct())
    step = F.floor(-F.log10("p") * GRID).cast("int")
    size = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    tests = tests.where(F.col("p") > LEAST_P).select("token", "encoding", size.alias("size"), F.least(F.lit(EDGE - 1), step).alias("step"), (F.col("p") >= 0.5).alias("upper"))
    tests = materialize(tests, "battery")
    random = tests.join(F.broadcast(q_values(tests)), ["encoding", "size", "step"]).where(F.col("q") <= q).select(F.col("token").alias("match"), "q")
    kind = F.element_at(F.array(*[F.lit(k[0]) for k in KINDS]), F.col("place") + 1)
    all_spans = base.select("rid", "place", "start", "end", kind.alias("kind"), F.lit(None).cast("double").alias("q"))
    all_spans = all_spans.unionByName(runs.join(random, "match").select("rid", F.lit(len(KINDS)).alias("place"), "start", "end", F.lit(RANDOM).alias("kind"), "q"))
    of = all_spans.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "place", "end", "kind"))).alias("all"), F.max("q").alias("max_q"))
    none = F.array().cast("array<struct<start:bigint,place:int,end:bigint,kind:string>>")
    out = rows.where(F.size("found") > 0).select("rid", "doc_id").join(of, "rid", "left").select("doc_id", F.coalesce("all", none).alias("all"), "max_q")
    out = out.union(rows.where(F.size("found") == 0).select("doc_id", none.alias("all"), F.lit(None).cast("double").alias("max_q")))
    count = lambda place: F.size(F.filter("all", lambda x: x["place"] == place)).cast("long")
    counts = [count(place).alias(f"n_{k[0]}") for place, k in enumerate(KINDS)]
    fixed = F.filter("all", lambda x: x["place"] < len(KINDS))
    return out.select("doc_id", *counts, F.sha2(_text_of(fixed), 256).alias("base_sha256"), _text_of(F.col("all")).alias("spans"), count(len(KINDS)).alias("n_random"), F.round("max_q", 6).alias("max_q"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def _tail_sql(z: str) -> str:
    t = f"(1 / (1 + 0.3275911 * {z} / sqrt(2)))"
    poly = f"((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t}"
    return f"least(1.0, greatest(0.0, ({poly}) * exp(-{z} * {z} / 2) / 2))"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _sql() -> str:
    """The same rows in DuckDB's SQL: matches by position, the battery as aggregates over tokens' characters."""
    patterns = [(k[0], k[1]) for k in KINDS] + [(RANDOM, p) for p in CANDIDATES]
    found = " UNION ALL ".join(f"SELECT rid, {i} AS place, '{k}' AS kind, regexp_extract_all(text, {_quoted(p)}) AS ms, string_split_regex(text, {_quoted(p)}) AS gaps FROM d WHERE regexp_matches(text, {_quoted(p)})" for i, (k, p) in enumerate(patterns))
    long_enough = " OR ".join(f"(place = {i} AND length(regexp_extract(m, {_quoted(p)}, {g})) >= {n})" for i, (_, p, g, n) in enumerate(KINDS))
    case = lambda value: "CASE " + " ".join(f"WHEN regexp_matches(m, '{e[1]}') THEN {value(e)}" for e in ENCODINGS) + " END"
    counts = ", ".join(f"count(*) FILTER (kind = '{k[0]}') AS n_{k[0]}" for k in KINDS)
    zero = ", ".join(f"coalesce(n_{k[0]}, 0) AS n_{k[0]}" for k in KINDS)
    as_text = """string_agg(kind || ':' || "start"::BIGINT || ':' || "end"::BIGINT, ',' ORDER BY "start", place, "end")"""
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
f AS ({found}),
e AS (SELECT rid, place, kind, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS g, unnest(range(len(ms))) AS i FROM f),
s AS (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY rid, place ORDER BY i) AS "end" FROM e),
spans AS (SELECT rid, least(place, {len(KINDS)}) AS place, kind, m, "end" - length(m) AS "start", "end" FROM s),
base AS (SELECT * FROM spans WHERE {long_enough}),
runs AS (SELECT DISTINCT * FROM spans r WHERE place = {len(KINDS)} AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = r.rid AND b."start" < r."end" AND r."start" < b."end")),
tok AS (SELECT DISTINCT m, {case(lambda e: f"'{e[0]}'")} AS encoding, {case(lambda e: f"'{e[2]}'")} AS alphabet, {case(lambda e: e[3])} AS least FROM runs),
body AS (SELECT m, encoding, alphabet, length(alphabet) AS a, CASE WHEN encoding = 'hex' THEN lower(regexp_replace(m, '=+$', '')) ELSE regexp_replace(m, '=+$', '') END AS body, least FROM tok WHERE encoding IS NOT NULL),
chars AS (SELECT m, any_value(encoding) AS encoding, any_value(a) AS a, any_value(length(body)) AS n, unnest(any_value(string_split(body, ''))) AS c, unnest(range(any_value(length(body)))) AS i, any_value(alphabet) AS alphabet FROM body WHERE length(body) >= least GROUP BY m),
x AS (SELECT m, encoding, a, n, c, i, strpos(alphabet, c) - (a + 1) / 2.0 AS x FROM chars),
y AS (SELECT *, lag(x) OVER (PARTITION BY m ORDER BY i) AS before FROM x),
chi AS (SELECT m, sum(k * k) AS squares FROM (SELECT m, c, count(*)::DOUBLE AS k FROM x GROUP BY m, c) GROUP BY m),
st AS (SELECT m, any_value(encoding) AS encoding, any_value(a) - 1.0 AS free, any_value(n)::DOUBLE AS n, any_value(squares) * any_value(a) / any_value(n) - any_value(n) AS chi2,
  count(*) FILTER (x > 0)::DOUBLE AS ones, 1.0 + count(*) FILTER ((x > 0) <> (before > 0)) AS runs, sum(x::DOUBLE * before) AS products, sum(x::DOUBLE * x) AS power FROM y JOIN chi USING (m) GROUP BY m),
z AS (SELECT *, (pow(chi2 / free, 1 / 3.0) - (1 - 2 / (9 * free))) / sqrt(2 / (9 * free)) AS z_chi, 2 * ones * (n - ones) AS twice FROM st),
zz AS (SELECT *, CASE WHEN twice * (twice - n) / (n * n * (n - 1)) > 0 THEN abs(runs - twice / n - 1) / sqrt(twice * (twice - n) / (n * n * (n - 1))) ELSE sqrt(n) END AS z_runs, CASE WHEN power > 0 THEN abs(products / power) * sqrt(n) ELSE sqrt(n) END AS z_serial FROM z),
pv AS (SELECT m, encoding, floor(log2(n))::INT AS size, 1 - pow(1 - least(CASE WHEN z_chi >= 0 THEN {_tail_sql('z_chi')} ELSE 1 - {_tail_sql('(-z_chi)')} END, 1.0, 2 * {_tail_sql('z_runs')}, 2 * {_tail_sql('z_serial')}), 3) AS p FROM zz),
tests AS (SELECT m, encoding, size, least({EDGE - 1}, floor(-log10(p) * {GRID}))::INT AS step, p >= 0.5 AS upper FROM pv WHERE p > {LEAST_P}),
hist AS (SELECT encoding, size, step, count(*) AS n, count(*) FILTER (upper) AS upper FROM tests GROUP BY ALL),
cum AS (SELECT *, 2 * (sum(upper) OVER (PARTITION BY encoding, size) + 1) AS random, sum(n) OVER (PARTITION BY encoding, size ORDER BY step) AS upto FROM hist),
shares AS (SELECT encoding, size, step, greatest(0.0, 1 - random * (1 - pow(10.0, -(step + 1) / {GRID}::DOUBLE)) / upto) AS share FROM cum),
qs AS (SELECT encoding, size, step, min(share) OVER (PARTITION BY encoding, size ORDER BY step DESC) AS q FROM shares),
rnd AS (SELECT m, q FROM tests JOIN qs USING (encoding, size, step) WHERE q <= {FALSE_DISCOVERY}),
b AS (SELECT rid, {counts}, {as_text} AS base FROM base GROUP BY rid),
o AS (SELECT rid, {as_text} AS spans, count(*) FILTER (kind = '{RANDOM}') AS n_random, max(q) AS max_q FROM (SELECT *, NULL::DOUBLE AS q FROM base UNION ALL SELECT runs.*, q FROM runs JOIN rnd USING (m)) GROUP BY rid)
SELECT doc_id, {zero}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_random, 0) AS n_random, round(max_q, 6) AS max_q FROM d LEFT JOIN b USING (rid) LEFT JOIN o USING (rid)
"""


OP2_SQL = _sql()

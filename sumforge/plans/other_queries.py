"""Expressions, equality saturation, dataset building, text features and event series."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from sumforge.functions import expressions as E
from sumforge.operators import dataset as D
from sumforge.operators import admission, egraph, ranges, text_features
from sumforge.operators.work import folder
from sumforge.sources.tables import spread, sql_text, table
from sumforge.streaming import limits

# Expression -> canonical, prefix, s-expression; prefix -> s-expression; queries -> normal form; expression -> why it is refused.
FORMS = {
    "x+1": ("x + 1", "add 1 x", "(+ 1 x)"), "x*a": ("a*x", "mul a x", "(* a x)"), "x**2": ("x**2", "pow x 2", "(pow x 2)"), "polylog(2,x)": ("Li(2, x)", "Li 2 x", "(Li 2 x)"),
    "zeta(3)": ("zeta(3)", "zeta 3", "(zeta 3)"), "x**2+sin(x)": ("x**2 + sin(x)", "add pow x 2 sin x", "(+ (pow x 2) (sin x))"), "sin(a*x)": ("sin(a*x)", "sin mul a x", "(sin (* a x))"),
    "x**(-1/2)": ("1/sqrt(x)", "pow x div INT- 1 2", "(pow x (/ -1 2))"), "-x": ("-x", "sub 0 x", "(* -1 x)"), "12*x/5": ("12*x/5", "mul div INT+ 1 2 5 x", "(* (/ 12 5) x)"), "x - x": ("0", "0", "0"), "9**9**9": ("9**9**9", None, None),
}
SEXPS = {"add x 1": "(+ x 1)", "add mul a b c": "(+ (* a b) c)", "mul x INT- 1": "(* x -1)", "add x INT- 1 2": "(+ x -12)", "mul INT+ 1 2 3 x": "(* 123 x)", "add mul INT- 2 x pow y INT- 1": "(+ (* -2 x) (pow y -1))", "mul INT+ 2 5 6 pow div x 2 8": "(* 256 (pow (/ x 2) 8))", "add x": None}
#: The same with a number of each part: % is the number, # is 12 times it and 1; in prefixes both are what tokens they have.
NUMBERED_FORMS = {
    "x+%": ("x + %", "add % x", "(+ % x)"), "%*x*a": ("%*a*x", "mul % mul a x", "(* % (* a x))"), "%*x**2": ("%*x**2", "mul % pow x 2", "(* % (pow x 2))"), "polylog(%,x)": ("Li(%, x)", "Li % x", "(Li % x)"),
    "zeta(%)": ("zeta(%)", "zeta %", "(zeta %)"), "%*x**2+sin(x)": ("%*x**2 + sin(x)", "add mul % pow x 2 sin x", "(+ (* % (pow x 2)) (sin x))"), "sin(x*%)": ("sin(%*x)", "sin mul % x", "(sin (* % x))"), "sin(%*a*x)": ("sin(%*a*x)", "sin mul % mul a x", "(sin (* % (* a x)))"),
    "x**(-1/#)": ("1/x**(1/#)", "pow x div INT- 1 #", "(pow x (/ -1 #))"), "-x*#": ("-#*x", "mul INT- ~ x", "(* -# x)"), "12*x/#": ("12*x/#", "mul div INT+ 1 2 # x", "(* (/ 12 #) x)"), "%*x - x*%": ("0", "0", "0"), "%**9**9": ("%**9**9", None, None),
}
#: % is the number, ~ its digits as tokens.
NUMBERED_SEXPS = {"add x INT+ ~": "(+ x %)", "add mul a b INT+ ~": "(+ (* a b) %)", "mul x INT- ~": "(* x -%)", "add x INT- ~ 2": "(+ x -%2)", "mul INT+ ~ x": "(* % x)", "add mul INT- ~ x pow y INT- 1": "(+ (* -% x) (pow y -1))", "mul INT+ ~ pow div x 2 8": "(* % (pow (/ x 2) 8))", "add INT+ ~": None}
QUERY_FORMS = {"t**2/(t+1)": "x**2/(x + 1)", "u**2/(u+1)": "x**2/(x + 1)", "x**2/(x+1)": "x**2/(x + 1)", "sin(u)/u": "sin(x)/x", "t**n/(t+1)": "x**a/(x + 1)", "2**999999999": None, "eval('1')": None}
VALID = {"x**2": None, "a*x + b": None, "alpha*sin(x)": None, "a*b*c*x": None, "dx*x": "spurious symbols", "theta*x": "spurious symbols", "a*b*c*s*x": "too many params", "theta_4*x": "subscripted variables", "q*x": "unknown params", "foo(x)": "disallowed functions", "I*x": "imaginary unit", "x +": "failed to parse"}
SEEDS = ["sin(x)**2", "x**2+2*x+1", "exp(x)*exp(2*x)", "tan(x)", "x/(x+1)", "log(x**2)", "1/(x**2+1)", "sinh(x)", "cos(2*x)", "a*x+b*x"]


def _forms(spark, cases):
    return spark.createDataFrame([(k,) for k in cases], "input string")


def _described(rows):
    return rows.select("input", E.describe("input").alias("d")).select("input", "d.canonical", "d.prefix", "d.sexp")


def golden_forms(spark, d):
    return _described(_forms(spark, FORMS))


def _numbered(spark, d, cases, **marks):
    """The cases for every part, with its numbers in place of marks."""
    text = F.explode(F.array(*map(F.lit, cases)))
    rows = spread(table(spark, d, "part").select("p_partkey")).select("p_partkey", text.alias("input"))
    for mark, number in marks.values():
        rows = rows.withColumn("input", F.replace("input", F.lit(mark), number.cast("string")))
    return rows.select("input")


def canonicalize(spark, d):
    """FORMS, and the same forms with every part's number, from 2 on."""
    k = F.col("p_partkey") + 2
    return _described(_numbered(spark, d, NUMBERED_FORMS, number=("%", k), twelvefold=("#", k * 12 + 1)).unionByName(_forms(spark, FORMS)))


def golden_sexps(spark, d):
    return _forms(spark, SEXPS).select("input", E.sexp_of_prefix("input").alias("output"))


def prefix_to_sexp(spark, d):
    """SEXPS, and the same prefixes with every part's number, from 10 on."""
    digits = F.array_join(F.split((F.col("p_partkey") + 10).cast("string"), ""), " ")
    return _numbered(spark, d, NUMBERED_SEXPS, digits=("~", digits)).unionByName(_forms(spark, SEXPS)).select("input", E.sexp_of_prefix("input").alias("output"))


def query_normalize(spark, d):
    return _forms(spark, QUERY_FORMS).select("input", E.canonical_query("input").alias("output"))


def symbol_validation(spark, d):
    return _forms(spark, VALID).select("input", E.describe("input").alias("d")).select("input", F.col("d.reason").alias("output"))


def vocabulary(spark, d):
    return spark.createDataFrame(list(enumerate(E.TOKENS)), "id int, token string")


def tokenizer_encode(spark, d):
    """128 ids by native map lookups."""
    rows = _forms(spark, FORMS).select("input", E.describe("input")["prefix"].alias("prefix")).where("prefix is not null")
    return rows.select("input", F.array_join(E.encoded(F.split("prefix", " ")), " ").alias("ids"))


def token_limit_filter(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(F.split("text", " ")).alias("n")).where("n <= 60")


def number_tokens(text):
    """array<string>: the words of a text, whole numbers of several digits or below zero as INT+ or INT- and digits."""
    digits = lambda t: F.filter(F.split(F.regexp_replace(t, "^-", ""), ""), lambda c: c != "")
    negative = lambda t: F.concat(F.array(F.lit("INT-")), digits(t))
    positive = lambda t: F.concat(F.array(F.lit("INT+")), digits(t))
    return F.flatten(F.transform(F.split(text, " "), lambda t: F.when(t.rlike(r"\A-[0-9]+\z"), negative(t)).when(t.rlike(r"\A[0-9]{2,}\z"), positive(t)).otherwise(F.array(t))))


def numeric_tokens(spark, d):
    """How many numbers the words of a document have, and its tokens."""
    rows = table(spark, d, "documents").select("doc_id", number_tokens(F.col("text")).alias("tokens"))
    return rows.select("doc_id", F.size(F.filter("tokens", lambda t: t.isin("INT+", "INT-"))).alias("numbers"), F.md5(F.array_join("tokens", " ")).alias("output"))


def equivalents_generate(spark, d):
    return egraph.generate(spark.createDataFrame([(s,) for s in SEEDS], "seed string"))


def egraph_equiv(spark, d):
    pairs = [("sin(x)**2 + cos(x)**2", "1", True), ("x*(x+1)", "x**2 + x", True), ("sin(x)", "cos(x)", False), ("exp(x)*exp(x)", "exp(2*x)", True)]
    return egraph.equivalences(spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string"))


def relational_ematch(spark, d):
    """The pattern a*b + a*c over a relation of nodes: self joins, the equality of a as a join key.

    A line of an order is the product of its supplier and its part, and each but the first a sum with the line before.
    """
    lines = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_linenumber", "l_suppkey", "l_partkey")
    products = lines.select("id", F.lit("mul").alias("op"), F.col("l_suppkey").alias("l"), F.col("l_partkey").alias("r"))
    n = products.unionByName(lines.where("l_linenumber > 1").select((-F.col("id")).alias("id"), F.lit("add").alias("op"), (F.col("id") - 1).alias("l"), F.col("id").alias("r")))
    m = n.where("op = 'mul'")
    left, right = m.select(F.col("id").alias("l"), F.col("l").alias("a"), F.col("r").alias("b")), m.select(F.col("id").alias("r"), F.col("l").alias("a"), F.col("r").alias("c"))
    return n.where("op = 'add'").select("id", "l", "r").join(left, "l").join(right, ["r", "a"]).select("id", "a", "b", "c")


def seed_split(spark, d):
    return D.split(table(spark, d, "documents").select("doc_id"), "doc_id")


def _members(spark, d):
    return table(spark, d, "embeddings").select(F.col("label").alias("cluster"), F.col("vec_id").alias("id"))


def ordered_pairs_sampled(spark, d):
    return D.ordered_pairs(_members(spark, d))


def negatives(spark, d):
    m = _members(spark, d)
    return D.negatives(D.ordered_pairs(m), m).select("query_id", "positive_id", F.array_join("negatives", ",").alias("negatives"))


def _pairs(words):
    """The neighbours in an array, joined by a space; the array is made once."""
    pairs = lambda w: F.transform(F.when(F.size(w) > 1, F.sequence(F.lit(1), F.size(w) - 1)), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))
    return F.get(F.transform(F.array(words), pairs), F.lit(0))


def permutation_dedup(spark, d):
    sentences = table(spark, d, "documents").select(F.explode(F.split("text", r"\. ")).alias("text"))
    return D.permutation_dedup(sentences.select(F.explode(_pairs(F.split("text", " "))).alias("pair")), "pair")


def tfidf_char_ngrams(spark, d):
    return text_features.tfidf(table(spark, d, "benchmark"), "item_id", "text")


def tfidf_unseen(spark, d):
    """Learnt from benchmark, kept, loaded and applied to documents: how many terms each has, and the heaviest."""
    place = folder(spark, "vectoriser")
    text_features.Vectoriser.fit(table(spark, d, "benchmark"), "item_id", "text").save(spark, place)
    weights = text_features.Vectoriser.load(spark, place).weights(table(spark, d, "documents"), "doc_id", "text")
    best = F.max(F.struct("weight", "term"))
    return weights.groupBy(F.col("id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_terms"), best.alias("best")).select("doc_id", "n_terms", "best.term", "best.weight")


def rolling_rate(spark, d):
    return limits.rolling_count(table(spark, d, "events").select("user_id", "ts", "event_id"), seconds=6 * 3600).select("event_id", "hits")


def rate_limit_stateful(spark, d):
    return limits.rate_limited(table(spark, d, "events"), limit=3, seconds=6 * 3600)


def rate_limit_deployed(spark, d):
    """30 hits of a client, 300 of all, in 60 seconds; 4,096 clients known."""
    return admission.admitted(table(spark, d, "events"))


def rate_limit_overall(spark, d):
    """Limits that these events do reach: 3 hits of a client, 60 of all in six hours; 50 clients known."""
    return admission.admitted(table(spark, d, "events"), admission.Limits(6 * 3600, 3, 60, 50))


def _series(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("name"), F.col("event_id").alias("step"), "value")


def ema_smoothing(spark, d):
    return limits.ema(_series(spark, d)).groupBy("name").agg(F.max_by("ema", "step").alias("e"), F.count(F.lit(1)).alias("n")).select("name", F.round("e", 5).alias("ema"), "n")


def moving_average_valid(spark, d):
    return limits.moving_average(_series(spark, d), 5).select("name", "step", F.round("mean", 5).alias("mean"))


def running_best(spark, d):
    return limits.running_best(_series(spark, d)).select("name", "step", "best", "is_best")


def eval_schedule(spark, d):
    """The steps are those of events, 500 apart."""
    steps = table(spark, d, "events").select((F.col("event_id") * 500).alias("step"))
    return limits.evaluation_schedule(steps, {"quick": 5000, "full": 25000, "deep": 100000}, 10000)


def generator_benchmark(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 5).alias("mean"), F.round(F.expr("percentile(value, 0.5)"), 5).alias("median"), F.round(F.stddev_samp("value"), 5).alias("stdev"), F.min("value").alias("least"), F.max("value").alias("most"))


def startup_profile(spark, d):
    total = table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("mean"))
    whole = total.agg(F.sum("mean").alias("all"))
    return total.join(F.broadcast(whole), F.lit(True)).select("event_type", F.round("mean", 5).alias("mean"), F.round(100 * F.col("mean") / F.col("all"), 4).alias("percent"))


def running_average(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity"), 6).alias("average"))


def evenly_spaced_sample(spark, d):
    """m = 25 rows at equal distances in the order of ids, the first and the last among them."""
    rows = table(spark, d, "embeddings").select("vec_id")
    n = rows.count()
    places = spark.range(25).select(F.floor(F.col("id") * (n - 1) / 24).alias("at")).distinct()
    return ranges.numbered(rows, "vec_id").join(F.broadcast(places), "at").select(F.col("at").cast("long").alias("at"), "vec_id")


def learning_rate_schedule(spark, d):
    """Linear warm-up over 4 epochs, then a half cosine to zero at epoch 20, and so again; each event is an epoch."""
    e = F.col("event_id") % 21
    warm = (e + 1) / 4
    rate = F.when(e < 4, warm).otherwise(0.5 * (1 + F.cos(F.lit(math.pi) * (e - 4) / 16)))
    return table(spark, d, "events").select("event_id", F.round(1e-3 * rate, 9).alias("rate"))


def training_summary(spark, d):
    """Best step of each series, its relative improvement over the first value, and the gap of the last to it."""
    s = _series(spark, d)
    out = s.groupBy("name").agg(F.min("value").alias("best"), F.min_by("step", F.struct("value", "step")).alias("best_step"), F.min_by("value", "step").alias("first"), F.max_by("value", "step").alias("last"))
    return out.select("name", "best", "best_step", F.round((F.col("first") - F.col("best")) / F.col("first"), 6).alias("improvement"), F.round(F.col("last") - F.col("best"), 6).alias("gap"))


def metrics_history(spark, d):
    """Each epoch's mean and the mean of all epochs so far."""
    per = table(spark, d, "events").groupBy((F.floor(F.col("event_id") / 500)).alias("epoch")).agg(F.avg("value").alias("mean"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    per = ranges.numbered(ranges.running(per, "epoch", "mean", of=F.sum, merge=lambda a, b: a + b), "epoch")
    return per.select("epoch", F.round("mean", 6).alias("mean"), F.round("norm", 4).alias("norm"), F.round(F.col("so_far") / (F.col("at") + 1), 6).alias("mean_so_far"))


def parameter_histogram(spark, d):
    rows = _forms(spark, VALID).select(E.describe("input").alias("d"), "input").where("d.valid")
    names = F.array_except(F.array_distinct(F.regexp_extract_all("input", F.lit(r"[A-Za-z_]\w*"), F.lit(0))), F.array(*map(F.lit, ["x", "sin"])))
    return rows.groupBy(F.size(names).alias("params")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    canonicalize, prefix_to_sexp, token_limit_filter, numeric_tokens,
    relational_ematch, seed_split, ordered_pairs_sampled, negatives, permutation_dedup, tfidf_char_ngrams, tfidf_unseen, rolling_rate, rate_limit_stateful, rate_limit_deployed, rate_limit_overall, ema_smoothing,
    moving_average_valid, running_best, eval_schedule, generator_benchmark, startup_profile, running_average, evenly_spaced_sample, learning_rate_schedule,
    training_summary, metrics_history,
)}
#: Over fixed cases only: for tests.
CHECKS = {f.__name__: f for f in (golden_forms, golden_sexps, query_normalize, symbol_validation, vocabulary, tokenizer_encode, equivalents_generate, egraph_equiv, parameter_histogram)}


def _gate(micros: int, per_client: int, overall: int, clients: int) -> str:
    """One hit at a time. log: admitted hits in the window; known: clients by last touch, the latest last; a forgotten client's hits stop counting for it."""
    return f"""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (ORDER BY ts, event_id) AS n FROM events),
s AS (
  SELECT 0::BIGINT AS n, []::STRUCT(c BIGINT, t BIGINT, own BOOLEAN)[] AS log, []::BIGINT[] AS known, NULL::BIGINT AS event_id, NULL::BIGINT AS user_id, NULL::VARCHAR AS outcome
  UNION ALL
  SELECT n, CASE WHEN outcome = 'admitted' THEN list_append(kept, {{'c': user_id, 't': t, 'own': true}}) ELSE kept END, after, event_id, user_id, outcome
  FROM (
    SELECT *, CASE WHEN len(live) >= {overall} THEN 'busy' WHEN len(list_filter(kept, lambda x: x.own AND x.c = user_id)) >= {per_client} THEN 'client' ELSE 'admitted' END AS outcome
    FROM (
      SELECT *, list_transform(live, lambda x: {{'c': x.c, 't': x.t, 'own': x.own AND list_contains(after, x.c)}}) AS kept
      FROM (
        SELECT *, CASE WHEN len(live) >= {overall} THEN known WHEN list_contains(known, user_id) OR len(known) < {clients} THEN list_append(list_filter(known, lambda x: x <> user_id), user_id) ELSE list_append(known[2:], user_id) END AS after
        FROM (SELECT e.n, e.event_id, e.user_id, e.t, s.known, list_filter(s.log, lambda x: e.t - x.t <= {micros}) AS live FROM s JOIN e ON e.n = s.n + 1)))))
SELECT event_id, user_id, outcome FROM s WHERE n > 0"""


def _table(rows, names: str) -> str:
    body = ", ".join("(" + ", ".join(str(x) if isinstance(x, (int, bool)) else sql_text(x) for x in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) t({names})"


_PAIRS = """n AS (SELECT label AS cluster, vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY md5(label || '|' || vec_id), vec_id) - 1 AS at, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
p AS (SELECT a.cluster, a.id AS query_id, b.id AS positive_id FROM n a JOIN n b ON a.cluster = b.cluster AND a.id <> b.id
  AND ((b.at - a.at) % a.n + a.n) % a.n <= CASE WHEN a.n < 200 THEN a.n - 1 ELSE least(70, a.n - 1) END)"""
_NEG = f"""{_PAIRS}, m AS (SELECT label AS cluster, vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS at FROM embeddings),
c AS (SELECT cluster, count(*) AS size, row_number() OVER (ORDER BY cluster) - 1 AS c, count(*) OVER () AS total FROM m GROUP BY cluster),
s AS (SELECT p.*, c.c, c.total, j, ('0x' || substr(md5('c|42|' || query_id || '|' || positive_id || '|' || j), 1, 8))::BIGINT % (c.total - 1) AS d, ('0x' || substr(md5('m|42|' || query_id || '|' || positive_id || '|' || j), 1, 8))::BIGINT AS pick
  FROM p JOIN c USING (cluster), range(3) r(j) WHERE c.total > 1),
f AS (SELECT s.query_id, s.positive_id, s.j, m.id FROM s JOIN c o ON o.c = s.d + (s.d >= s.c)::INT JOIN m ON m.cluster = o.cluster AND m.at = s.pick % o.size)
SELECT query_id, positive_id, string_agg(id::VARCHAR, ',' ORDER BY j) AS negatives FROM f GROUP BY ALL"""

ORACLE_SQL = {
    "canonicalize": f"""WITH n AS (SELECT k, m, CASE WHEN k < 10 THEN k::VARCHAR ELSE 'INT+ ' || d END AS kp, 'INT+ ' || e AS mp, e
  FROM (SELECT k, m, array_to_string(string_split(k::VARCHAR, ''), ' ') AS d, array_to_string(string_split(m::VARCHAR, ''), ' ') AS e FROM (SELECT p_partkey + 2 AS k, 12 * (p_partkey + 2) + 1 AS m FROM part)))
SELECT replace(replace(i, '%', k::VARCHAR), '#', m::VARCHAR) AS input, replace(replace(c, '%', k::VARCHAR), '#', m::VARCHAR) AS canonical,
  replace(replace(replace(p, '%', kp), '#', mp), '~', e) AS prefix, replace(replace(s, '%', k::VARCHAR), '#', m::VARCHAR) AS sexp
FROM n, ({_table([(k, *v) for k, v in NUMBERED_FORMS.items()], "i, c, p, s")}) UNION ALL {_table([(k, *v) for k, v in FORMS.items()], "input, canonical, prefix, sexp")}""",
    "prefix_to_sexp": f"""SELECT replace(i, '~', array_to_string(string_split(k::VARCHAR, ''), ' ')) AS input, replace(o, '%', k::VARCHAR) AS output
FROM (SELECT p_partkey + 10 AS k FROM part), ({_table(NUMBERED_SEXPS.items(), "i, o")}) UNION ALL {_table(SEXPS.items(), "input, output")}""",
    "golden_forms": _table([(k, *v) for k, v in FORMS.items()], "input, canonical, prefix, sexp"),
    "golden_sexps": _table(SEXPS.items(), "input, output"), "query_normalize": _table(QUERY_FORMS.items(), "input, output"), "symbol_validation": _table(VALID.items(), "input, output"),
    "vocabulary": "SELECT id::INT AS id, token FROM (VALUES " + ", ".join(f"({k}, {sql_text(t)})" for k, t in enumerate(E.TOKENS)) + ") t(id, token)",
    "tokenizer_encode": _table([(k, " ".join(map(str, E.encode(prefix.split())))) for k, (_, prefix, _) in FORMS.items() if prefix], "input, ids"),
    "numeric_tokens": """WITH t AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents),
o AS (SELECT doc_id, flatten(list_transform(w, lambda x: CASE WHEN regexp_full_match(x, '-[0-9]+') THEN list_prepend('INT-', string_split(substr(x, 2), '')) WHEN regexp_full_match(x, '[0-9][0-9]+') THEN list_prepend('INT+', string_split(x, '')) ELSE [x] END)) AS l FROM t)
SELECT doc_id, len(list_filter(l, lambda x: x IN ('INT+', 'INT-')))::INT AS numbers, md5(array_to_string(l, ' ')) AS output FROM o""",
    "token_limit_filter": "SELECT doc_id, len(string_split(text, ' '))::INT AS n FROM documents WHERE len(string_split(text, ' ')) <= 60",
    "egraph_equiv": _table([("sin(x)**2 + cos(x)**2", "1", True), ("x*(x+1)", "x**2 + x", True), ("sin(x)", "cos(x)", False), ("exp(x)*exp(x)", "exp(2*x)", True)], "a, b, same"),
    "relational_ematch": """WITH m AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_linenumber AS k, l_suppkey AS l, l_partkey AS r FROM lineitem)
SELECT -s.id AS id, x.l AS a, x.r AS b, y.r AS c FROM m s JOIN m x ON x.id = s.id - 1 JOIN m y ON y.id = s.id AND y.l = x.l WHERE s.k > 1""",
    "seed_split": "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) - 1 AS rk, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN rk < floor(n * 0.8) THEN 'train' WHEN rk < floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM r",
    "ordered_pairs_sampled": f"WITH {_PAIRS} SELECT * FROM p",
    "negatives": f"WITH {_NEG}",
    "permutation_dedup": "WITH s AS (SELECT unnest(string_split(text, '. ')) AS text FROM documents), w AS (SELECT string_split(text, ' ') AS l FROM s), p AS (SELECT unnest(list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1])) AS pair FROM w) SELECT array_to_string(list_sort(string_split(pair, ' ')), ' ') AS tokens, min(pair) AS pair, count(*) AS n FROM p GROUP BY 1",
    "tfidf_char_ngrams": """WITH g AS (SELECT item_id AS id, unnest(list_concat(list_transform(range(1, length(text) + 1), lambda i: substring(text, i, 1)), list_transform(range(1, length(text)), lambda i: substring(text, i, 2)), list_transform(range(1, length(text) - 1), lambda i: substring(text, i, 3)))) AS term FROM benchmark),
t AS (SELECT id, term, count(*) AS tf FROM g GROUP BY ALL), k AS (SELECT term, sum(tf) AS total, count(*) AS df FROM t GROUP BY term ORDER BY total DESC, term LIMIT 384),
w AS (SELECT id, term, tf * (ln((1.0 + (SELECT count(*) FROM benchmark)) / (1 + df)) + 1) AS w FROM t JOIN k USING (term))
SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM w""",
    "tfidf_unseen": """WITH g AS (SELECT item_id AS id, unnest(list_concat(list_transform(range(1, length(text) + 1), lambda i: substring(text, i, 1)), list_transform(range(1, length(text)), lambda i: substring(text, i, 2)), list_transform(range(1, length(text) - 1), lambda i: substring(text, i, 3)))) AS term FROM benchmark),
k AS (SELECT term, count(*) AS total, count(DISTINCT id) AS df FROM g GROUP BY term ORDER BY total DESC, term LIMIT 384),
v AS (SELECT term, ln((1.0 + (SELECT count(*) FROM benchmark)) / (1 + df)) + 1 AS idf FROM k),
d AS (SELECT doc_id, unnest(list_concat(c, list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1]), list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2]))) AS term FROM (SELECT doc_id, regexp_extract_all(text, '(?s).') AS c FROM documents)),
w AS (SELECT doc_id, term, count(*) * any_value(idf) AS w FROM d JOIN v USING (term) GROUP BY ALL),
u AS (SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w)
SELECT doc_id, count(*) AS n_terms, arg_max(term, (weight, term)) AS term, max(weight) AS weight FROM u GROUP BY doc_id""",
    "rate_limit_stateful": """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (
  SELECT DISTINCT user_id, 0::BIGINT AS n, []::BIGINT[] AS log, NULL::BIGINT AS event_id, NULL::BOOLEAN AS admitted FROM e
  UNION ALL
  SELECT user_id, n, CASE WHEN len(live) < 3 THEN list_append(live, t) ELSE live END, event_id, len(live) < 3
  FROM (SELECT e.*, list_filter(s.log, lambda x: e.t - x <= 21600000000) AS live FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))
SELECT event_id, user_id, admitted FROM s WHERE n > 0""",
    "rate_limit_deployed": _gate(60_000_000, 30, 300, 4096),
    "rate_limit_overall": _gate(6 * 3600 * 1_000_000, 3, 60, 50),
    "rolling_rate": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW) AS hits FROM events",
    "ema_smoothing": """WITH s AS (SELECT event_type AS name, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT name, round(sum(value * CASE WHEN i = 1 THEN pow(0.9, n - 1) ELSE 0.1 * pow(0.9, n - i) END), 5) AS ema, count(*) AS n FROM s GROUP BY name""",
    "moving_average_valid": "WITH s AS (SELECT event_type AS name, event_id AS step, avg(value) OVER w AS m, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) SELECT name, step, round(m, 5) AS mean FROM s WHERE n = 5",
    "running_best": "SELECT event_type AS name, event_id AS step, min(value) OVER w AS best, value = min(value) OVER w AS is_best FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)",
    "eval_schedule": "SELECT step, concat_ws(',', CASE WHEN step >= 10000 AND step % 5000 = 0 THEN 'quick' END, CASE WHEN step >= 10000 AND step % 25000 = 0 THEN 'full' END, CASE WHEN step >= 10000 AND step % 100000 = 0 THEN 'deep' END) AS tiers FROM (SELECT event_id * 500 AS step FROM events)",
    "generator_benchmark": "SELECT event_type, round(avg(value), 5) AS mean, round(quantile_cont(value, 0.5), 5) AS median, round(stddev_samp(value), 5) AS stdev, min(value) AS least, max(value) AS most FROM events GROUP BY ALL",
    "startup_profile": "WITH t AS (SELECT event_type, avg(value) AS m FROM events GROUP BY ALL) SELECT event_type, round(m, 5) AS mean, round(100 * m / sum(m) OVER (), 4) AS percent FROM t",
    "evenly_spaced_sample": "WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings) SELECT DISTINCT i AS at, vec_id FROM r, range(25) p(k) WHERE i = floor(k * (n - 1) / 24)",
    "learning_rate_schedule": "SELECT event_id, round(0.001 * CASE WHEN epoch < 4 THEN (epoch + 1) / 4 ELSE 0.5 * (1 + cos(pi() * (epoch - 4) / 16)) END, 9) AS rate FROM (SELECT event_id, event_id % 21 AS epoch FROM events)",
    "training_summary": "WITH s AS (SELECT event_type AS name, min(value) AS best, arg_min(event_id, (value, event_id)) AS best_step, arg_min(value, event_id) AS f, arg_max(value, event_id) AS l FROM events GROUP BY ALL) SELECT name, best, best_step, round((f - best) / f, 6) AS improvement, round(l - best, 6) AS gap FROM s",
    "metrics_history": "WITH p AS (SELECT event_id // 500 AS epoch, avg(value) AS m, sqrt(sum(value * value)) AS n FROM events GROUP BY ALL) SELECT epoch, round(m, 6) AS mean, round(n, 4) AS norm, round(avg(m) OVER (ORDER BY epoch), 6) AS mean_so_far FROM p",
    "parameter_histogram": "SELECT * FROM (VALUES (0, 1), (1, 1), (2, 1), (3, 1)) t(params, n)",
    "running_average": "SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS average FROM lineitem GROUP BY ALL",
}

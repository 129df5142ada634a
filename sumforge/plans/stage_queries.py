"""Queries of the stages, of tokens and of lookups, with their SQL. Documents serve as raw formulas, embeddings as an index."""

from __future__ import annotations

from pyspark.sql import functions as F

from sumforge.functions import expressions as E
from sumforge.functions import latex as L
from sumforge.operators import dataset, stages
from sumforge.plans.store_queries import _instances
from sumforge.sources.tables import sql_text, table

def _normalized(spark, d):
    """Sentences of a document: the first is its leading expression, the others its equivalents."""
    parts = F.split("text", r"\. ")
    return table(spark, d, "documents").select("doc_id", F.col("text").alias("raw_latex"), F.get(parts, F.lit(0)).alias("leading_expression"), F.when(F.size(parts) > 1, F.slice(parts, 2, 2**31 - 1)).otherwise(F.array().cast("array<string>")).alias("equivalent_forms"))


def chain_positions(spark, d):
    return stages.chain_positions(_normalized(spark, d), "doc_id").select("doc_id", "chain_position", F.md5("form").alias("form"))


def inequality_equivalents(spark, d):
    rows = stages.without_equivalents_of_inequalities(_normalized(spark, d))
    return rows.select("doc_id", F.size("equivalent_forms").alias("n"))


def filter_report(spark, d):
    t = F.col("text")
    reason = F.when(t.contains("$$"), "display_math").when(t.rlike("(?i)license"), "license").when(F.length(t) < 200, "short")
    return stages.filter_report(table(spark, d, "documents"), reason, "doc_id").select("reason", "n", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",").alias("examples"))


def unevaluated_rejected(spark, d):
    made = table(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "fr", F.concat(F.lit("Sum("), "text")).when(F.col("lang") == "de", F.concat(F.lit("Integral("), "text")).otherwise(F.col("text")).alias("integrand"))
    return stages.evaluated(made, "integrand").select("doc_id")


def line_range(spark, d):
    return stages.lines(table(spark, d, "documents").select("doc_id", "source"), "doc_id", start=50, limit=100)


def failed_seeds_left_out(spark, d):
    events = table(spark, d, "events")
    seeds = events.select(F.col("user_id").alias("key")).distinct()
    return stages.without_failures(seeds, events.select(F.col("user_id").alias("key"), F.col("event_type").alias("failure_type")), "error")


def search_statistics(spark, d):
    v = table(spark, d, "embeddings")
    return v.agg(F.count(F.lit(1)).alias("n_vectors"), F.max(F.size("embedding")).alias("dimensions"), F.count_distinct("label").alias("n_families"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"))


def analogy_validity(spark, d):
    """Of the analogies asked, how many have their fourth member in the corpus."""
    v = table(spark, d, "embeddings").select("vec_id")
    asked = v.select((F.col("vec_id") + 3).alias("d_id"))
    valid = asked.join(v.withColumnRenamed("vec_id", "d_id"), "d_id", "left_semi")
    counts = asked.withColumn("valid", F.lit(0)).unionByName(valid.withColumn("valid", F.lit(1))).groupBy().agg(F.count_if(F.col("valid") == 0).alias("n"), F.count_if(F.col("valid") == 1).alias("n_valid"))
    return counts.withColumn("rate", F.round(F.col("n_valid") / F.col("n"), 6))


def split_statistics(spark, d):
    rows = dataset.split(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("seeds"), F.sum(F.size(F.split("text", r"\. "))).alias("lines"))


def seed_freeze(spark, d):
    def sentences(name):
        return table(spark, d, name).select(F.explode(F.split("text", r"\. ")).alias("seed")).select(F.trim("seed").alias("seed")).where("seed <> ''")

    synthetic, stored = sentences("benchmark"), sentences("documents")
    return stages.frozen_seeds(synthetic, stored)


def recent_log(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type").join(table(spark, d, "events").select("event_id", "ts"), "event_id").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id", "event_type")


def more_results(spark, d):
    """The second request of a page, with 18 results for 6; the first six are those of the first."""
    g = _instances(spark, d).groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.desc("n"), "hash").limit(18)


def family_fill(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 11 != 0, F.lower("text")).alias("canonical"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("family"))
    return stages.filled_family(rows).select("doc_id", "family")


def reverse_lookup(spark, d):
    """All instances that share the expression of an instance whose id is divisible by 100."""
    i = _instances(spark, d).select("instance_id", "hash", "family")
    return stages.records_of(i, i.where("instance_id % 100 = 0").select("instance_id"))


def store_projections(spark, d):
    """How many rows each table of the rebuilt store has."""
    i = _instances(spark, d)
    groups = i.groupBy("hash").agg(F.min("canonical").alias("canonical"), F.min("family").alias("family"))
    out = None
    for name, rows in stages.store_tables(groups, i).items():
        one = rows.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def api_extraction(spark, d):
    """Formulas of JSON pages: each turn a page, the first of a conversation a question, the others answers; none seen."""
    c = table(spark, d, "conversations")
    item = F.struct(F.col("conv_id").alias("question_id"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), F.lit(None).cast("string").alias("title"), F.concat(F.lit("see $$"), "text", F.lit("$$ there")).alias("body"))
    pages = c.select(F.to_json(F.struct(F.array(item).alias("items"))).alias("body"))
    seen = spark.createDataFrame([], "checksum string")
    return stages.api_formulas(pages, seen).select("latex", "origin", "item_id")


def ocr_extraction(spark, d):
    record = F.struct(F.col("url").alias("integrand_latex"), F.lit("x").alias("variable"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("P"), "page_id")).alias("label"))
    raw = table(spark, d, "pages").select(F.col("page_id").alias("page"), F.to_json(F.struct(F.array(record, record).alias("integrals"))).alias("raw"))
    return stages.ocr_records(raw).select("page", "label", F.col("integral.integrand_latex").alias("latex"))


def author_backfill(spark, d):
    """The source of English documents is known, that of others is filled from what the labels say, where they say it."""
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "en", F.col("source")).alias("author"))
    found = table(spark, d, "labels").select("doc_id", F.concat(F.lit("labelled "), F.col("quality").cast("string")).alias("author"))
    return stages.backfilled(rows, found, "doc_id", "author")


def page_resume(spark, d):
    """Pages whose content was not read before, under any id; those with a label were."""
    pages = table(spark, d, "pages").select("page_id", "html")
    done = pages.join(table(spark, d, "labels").select(F.col("doc_id").alias("page_id")), "page_id", "left_semi").select(F.sha2("html", 256).alias("sha256"))
    return stages.unread(pages, done, "html").select("page_id", "sha256")


def query_guards(spark, d):
    """What is wrong with each turn taken as a request, with its turn for k and a hash of 12 digits, or 11 for assistants."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text", F.expr("left(sha2(cast(conv_id as string), 256), case when role = 'assistant' then 11 else 12 end)").alias("hash"))
    return stages.guarded(rows, "text", "turn", "hash").select("conv_id", "turn", "refused")


def blob_path_map(spark, d):
    paths = F.when(F.col("lang") == "en", F.create_map(F.lit("raw"), F.concat(F.lit("blobs/"), F.col("doc_id").cast("string"))))
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), paths.alias("blob_paths"))
    return stages.blob_paths(rows).select("id", F.col("blob_paths")["raw"].alias("raw"))


def padding_mask(spark, d):
    """Ids padded to the longest of a batch of 16, and how many of them are padding."""
    rows = table(spark, d, "benchmark").select("item_id", F.floor(F.col("item_id") / 16).alias("batch"), F.size(F.split("text", " ")).alias("n"))
    widest = rows.groupBy("batch").agg(F.max("n").alias("width"))
    ids = F.concat(F.array_repeat(F.lit(1), F.col("n")), F.array_repeat(F.lit(0), (F.col("width") - F.col("n")).cast("int")))
    made = rows.join(widest, "batch").withColumn("mask", E.padding_mask(ids))
    return made.select("item_id", F.size("mask").alias("width"), F.size(F.filter("mask", lambda x: x)).alias("n_padding"))


# Ids of the vocabulary and what they stand for; prefix forms, whether they are valid, and as infix.
DECODED = {"1 21 4 17 2 0 0": "add 1 x", "1 17 2 18 19": "x", "1 0 0": "", "1 999 2": "<UNKNOWN_999>"}
PREFIXES = {"add x 1": (True, "x + 1"), "pow x 2": (True, "x**2"), "mul INT- 1 2 x": (True, "-12*x"), "sin mul a x": (True, "sin(a*x)"), "div 1 x": (True, "1/x"), "add foo 1": (False, None), "add x": (True, None)}


def tokenizer_decode(spark, d):
    rows = spark.createDataFrame([(k,) for k in DECODED], "input string")
    return rows.select("input", E.decoded(F.transform(F.split("input", " "), lambda t: t.cast("int"))).alias("output"))


def prefix_to_infix(spark, d):
    rows = spark.createDataFrame([(k,) for k in PREFIXES], "input string")
    return rows.select("input", E.known_tokens(F.col("input")).alias("valid"), E.infix_of_prefix("input").alias("infix"))


def tokenizer_round_trip(spark, d):
    """Words of documents mapped to tokens of the vocabulary, encoded in 128 slots and decoded again."""
    names = E.TOKENS[3:]
    words = F.transform(F.split("text", " "), lambda w: F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.length(w), F.lit(len(names))) + 1).cast("int")))
    rows = table(spark, d, "documents").select("doc_id", words.alias("tokens"))
    ids = rows.withColumn("ids", E.encoded(F.col("tokens")))
    return ids.select("doc_id", F.size("ids").alias("slots"), F.size(F.filter("ids", lambda i: i == 0)).alias("n_padding"), E.decoded(F.col("ids")).alias("text"))


QUERIES = {f.__name__: f for f in (
    chain_positions, inequality_equivalents, filter_report, unevaluated_rejected, line_range, failed_seeds_left_out, search_statistics, analogy_validity, split_statistics,
    seed_freeze, recent_log, more_results, family_fill, reverse_lookup, store_projections, api_extraction, ocr_extraction, blob_path_map, padding_mask,
    tokenizer_round_trip, author_backfill, page_resume, query_guards,
)}
#: Over fixed cases only: for tests.
CHECKS = {f.__name__: f for f in (tokenizer_decode, prefix_to_infix)}

_I = "i AS (SELECT doc_id AS instance_id, substr(sha256(text), 1, 12) AS hash, source AS family, text, doc_id % 97 AS question_id FROM documents)"
_INEQUALITY = r"regexp_matches(text, '\\(" + L.INEQUALITIES + r")([^a-zA-Z]|$)|[<>≤≥≠≪≫]')"


def _family_sql(c: str) -> str:
    arcs = [prefix + f for f in L.FUNCTIONS for prefix in ("", "a")]
    tests = [(f, [f + "("]) for f in [*arcs, "exp", "sqrt", "abs", "zeta", "re", "im"]] + [("log", ["log(", "ln("]), ("polylog", ["polylog(", "li("]), ("pow", ["**", "^"]), ("div", ["/"])]
    cases = ", ".join(f"CASE WHEN {' OR '.join(f'contains({c}, {sql_text(m)})' for m in marks)} THEN {sql_text(name)} END" for name, marks in tests)
    found = f"list_sort(list_filter([{cases}], lambda x: x IS NOT NULL))"
    return f"CASE WHEN len({found}) = 0 THEN 'elementary' ELSE array_to_string({found}, ',') END"


def _values(rows, names: str) -> str:
    show = lambda x: str(x) if isinstance(x, bool) else sql_text(x)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) t({names})"


_NAMES = "[" + ", ".join(map(sql_text, E.TOKENS[3:])) + "]"

ORACLE_SQL = {
    "chain_positions": "WITH s AS (SELECT doc_id, string_split(text, '. ') AS l FROM documents) SELECT doc_id, unnest(range(len(l)))::INT AS chain_position, md5(unnest(l)) AS form FROM s",
    "inequality_equivalents": f"SELECT doc_id, CASE WHEN {_INEQUALITY} THEN 0 ELSE len(string_split(text, '. ')) - 1 END::INT AS n FROM documents",
    "filter_report": "WITH r AS (SELECT doc_id, CASE WHEN contains(text, '$$') THEN 'display_math' WHEN regexp_matches(text, '(?i)license') THEN 'license' WHEN length(text) < 200 THEN 'short' END AS reason FROM documents) SELECT reason, count(*) AS n, array_to_string(list_slice(list_sort(list(doc_id)), 1, 3), ',') AS examples FROM r WHERE reason IS NOT NULL GROUP BY reason",
    "unevaluated_rejected": "SELECT doc_id FROM documents WHERE coalesce(lang, '') NOT IN ('fr', 'de') AND NOT contains(text, 'Sum(') AND NOT contains(text, 'Integral(')",
    "line_range": "WITH r AS (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS line FROM documents) SELECT * FROM r WHERE line BETWEEN 50 AND 149",
    "failed_seeds_left_out": "SELECT DISTINCT user_id AS key FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')",
    "search_statistics": "SELECT count(*) AS n_vectors, max(len(embedding))::INT AS dimensions, count(DISTINCT label) AS n_families, min(vec_id) AS first_id, max(vec_id) AS last_id FROM embeddings",
    "analogy_validity": "WITH a AS (SELECT vec_id + 3 AS d_id FROM embeddings) SELECT count(*) AS n, count(*) FILTER (d_id IN (SELECT vec_id FROM embeddings)) AS n_valid, round(count(*) FILTER (d_id IN (SELECT vec_id FROM embeddings)) / count(*), 6) AS rate FROM a",
    "split_statistics": "WITH r AS (SELECT text, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) - 1 AS rk, count(*) OVER () AS n FROM documents) SELECT CASE WHEN rk < floor(n * 0.8) THEN 'train' WHEN rk < floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split, count(*) AS seeds, sum(len(string_split(text, '. ')))::BIGINT AS lines FROM r GROUP BY 1",
    "seed_freeze": r"WITH s AS (SELECT trim(unnest(string_split(text, '. '))) AS seed, 'synthetic' AS origin FROM benchmark UNION ALL SELECT trim(unnest(string_split(text, '. '))), 'database' FROM documents) SELECT seed, max(origin) AS origin FROM s WHERE seed <> '' AND len(string_split_regex(trim(seed), '\s+')) <= 8 GROUP BY seed",
    "recent_log": "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
    "more_results": f"WITH {_I} SELECT hash, count(*) AS n FROM i GROUP BY hash ORDER BY n DESC, hash LIMIT 18",
    "family_fill": f"WITH r AS (SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN lower(text) END AS c, CASE WHEN doc_id % 3 = 0 THEN source END AS f FROM documents) SELECT doc_id, CASE WHEN f IS NULL AND c IS NOT NULL THEN {_family_sql('c')} ELSE f END AS family FROM r",
    "reverse_lookup": f"WITH {_I} SELECT instance_id, hash, family FROM i WHERE hash IN (SELECT hash FROM i WHERE instance_id % 100 = 0)",
    "store_projections": f"WITH {_I} SELECT 'integrand_groups' AS name, count(DISTINCT hash) AS n FROM i UNION ALL SELECT 'integral_instances', count(*) FROM i UNION ALL SELECT 'mse_metadata', count(*) FROM i WHERE question_id <> 0",
    "api_extraction": "WITH c AS (SELECT CASE WHEN turn > 0 THEN conv_id * 1000 + turn ELSE conv_id END AS item_id, CASE WHEN turn > 0 THEN 'answer_body' ELSE 'question_body' END AS origin, trim(text) AS latex FROM conversations) SELECT latex, arg_min(origin, (item_id, origin)) AS origin, min(item_id) AS item_id FROM c GROUP BY latex",
    "ocr_extraction": "SELECT page_id AS page, CASE WHEN page_id % 2 = 0 THEN 'P' || page_id ELSE page_id || '-' || k END AS label, url AS latex FROM pages, range(1, 3) r(k)",
    "author_backfill": "WITH l AS (SELECT doc_id, min('labelled ' || quality) AS v FROM labels GROUP BY doc_id), r AS (SELECT doc_id, CASE WHEN lang = 'en' THEN source END AS a FROM documents) SELECT doc_id, coalesce(a, v) AS author, a IS NULL AND v IS NOT NULL AS filled FROM r LEFT JOIN l USING (doc_id)",
    "page_resume": "WITH p AS (SELECT page_id, sha256(html) AS sha256 FROM pages) SELECT page_id, sha256 FROM p WHERE sha256 NOT IN (SELECT sha256 FROM p WHERE page_id IN (SELECT doc_id FROM labels))",
    "query_guards": "SELECT conv_id, turn, CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty query' WHEN length(trim(text)) > 200 THEN 'long query' WHEN turn IS NULL OR turn < 1 OR turn > 20 THEN 'k' WHEN role = 'assistant' THEN 'hash' END AS refused FROM conversations",
    "blob_path_map": "SELECT doc_id AS id, 'blobs/' || doc_id AS raw FROM documents WHERE lang = 'en'",
    "padding_mask": "WITH r AS (SELECT item_id, item_id // 16 AS b, len(string_split(text, ' ')) AS n FROM benchmark) SELECT item_id, (max(n) OVER (PARTITION BY b))::INT AS width, (max(n) OVER (PARTITION BY b) - n)::INT AS n_padding FROM r",
    "tokenizer_decode": _values(DECODED.items(), "input, output"),
    "prefix_to_infix": _values([(k, *v) for k, v in PREFIXES.items()], "input, valid, infix"),
    "tokenizer_round_trip": f"WITH w AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda x: ({_NAMES})[length(x) % {len(E.TOKENS) - 3} + 1]) AS l FROM documents) SELECT doc_id, 128 AS slots, greatest(0, 126 - len(l))::INT AS n_padding, array_to_string(list_slice(l, 1, 126), ' ') AS text FROM w",
}

"""Store queries over the driver's tables: documents are instances, sources families, toxic labels removals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sumforge.operators import provenance, run_statistics
from sumforge.operators import store as S
from sumforge.operators.work import folder
from sumforge.sources import keyed_files
from sumforge.sources.tables import table


def _instances(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("instance_id"), S.short_hash(F.col("text")).alias("hash"), F.col("text").alias("canonical"), F.col("source").alias("family"),
        F.when(F.col("lang") == "en", "definite").otherwise("indefinite").alias("kind"), (F.col("doc_id") % 97).alias("question_id"), F.col("text").alias("variant"),
    )


def _removed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("instance_id")).distinct()


def checksum_dedup_keep_first(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("checksum"))
    return rows.groupBy("checksum").agg(F.min("doc_id").alias("doc_id"))


def group_by_hash(spark, d):
    return S.groups(_instances(spark, d))


def group_by_source(spark, d):
    """Groups that hold many texts: the first ten of each source and language by their text, and the first ten ids."""
    rows = _instances(spark, d).withColumn("variant", F.md5("variant"))
    keys = ["family", "kind"]
    return S.firsts(rows, keys, "variant", 10, name="v").join(S.firsts(rows, keys, "instance_id", 10, name="i"), keys).select(*keys, F.array_join("v", "|").alias("variants"), F.array_join("i", "|").alias("ids"))


def conversation_files(spark, d):
    """A file for each conversation, as the sink's manifest has them."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws(": ", "role", F.regexp_replace("text", r"\s+", " ")).alias("line"))
    path = folder(spark, "files")
    keyed_files.write(rows, path, key="conv_id", line="line", order=["turn"])
    return keyed_files.manifest(spark, path).select(F.regexp_extract("file", r"^(\d+)\.txt$", 1).cast("long").alias("conv_id"), "lines", "bytes", "sha256")


def count_groups(spark, d):
    return S.group_counts(_instances(spark, d), _removed(spark, d))


def count_instances(spark, d):
    i = _instances(spark, d)
    return i.agg(F.count(F.lit(1)).alias("n")).crossJoin(S.without_removed(i, _removed(spark, d)).agg(F.count(F.lit(1)).alias("n_active")))  # one row each


def store_statistics(spark, d):
    i = _instances(spark, d).join(_removed(spark, d).withColumn("gone", F.lit(1)), "instance_id", "left")
    return i.agg(F.count_distinct("hash").alias("n_groups"), F.count(F.lit(1)).alias("n_instances"), F.count("gone").alias("n_removed"), (F.count(F.lit(1)) - F.count("gone")).alias("n_active"), F.count_distinct("family").alias("n_families"))


def resume_anti_join(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


def contributor_semi_join(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")


def group_instance_metadata_join(spark, d):
    i = _instances(spark, d)
    meta = table(spark, d, "conversations").where("turn = 0").select(F.col("conv_id").alias("instance_id"), "role", F.length("text").alias("n_text"))
    g = S.groups(i).select("hash", F.col("family").alias("group_family"), "definite", "indefinite")
    return g.join(i.select("hash", "instance_id", "kind"), "hash").join(meta, "instance_id", "left")


def author_lookup_join(spark, d):
    """An instance's author is that of the answer with its id if there is one, else of the question."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("role", "turn").alias("asked_by"), F.max_by("role", "turn").alias("answered_by"), F.max("turn").alias("turns"))
    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 211).alias("conv_id"))
    return docs.join(c, "conv_id", "left").select("doc_id", F.when(F.col("turns") > 0, F.col("answered_by")).otherwise(F.col("asked_by")).alias("author"))


def checksum_normalised(spark, d):
    """The first document of each content, white space and compatible characters taken as equal."""
    rows = table(spark, d, "documents").select("doc_id", provenance.checksum(F.col("text")).alias("checksum"))
    return rows.where("checksum is not null").groupBy("checksum").agg(F.min("doc_id").alias("doc_id"))


def blob_authors(spark, d):
    """Authors of turns from blobs of at most 50 turns; every third turn is asked for as an answer, those of odd number are answers."""
    t = table(spark, d, "conversations").where("conv_id is not null and turn is not null")
    item, part = F.col("conv_id") * 1000 + F.col("turn"), F.floor(F.col("turn") / 50)
    turns = t.select("conv_id", "turn", "role", item.alias("item"), F.format_string("blob_%d_%d.txt", "conv_id", part).alias("blob"))
    odd, owner = F.col("turn") % 2 == 1, F.struct(F.concat_ws("-", "role", "conv_id").alias("display_name"), F.concat(F.lit("https://example.org/u/"), "conv_id").alias("link"))
    items = F.struct(F.when(~odd, F.col("item")).alias("question_id"), F.when(odd, F.col("item")).alias("answer_id"), owner.alias("owner"))
    blobs = turns.groupBy("blob").agg(F.to_json(F.struct(F.sort_array(F.collect_list(items)).alias("items"))).alias("body"))
    origin = F.when(F.col("turn") % 3 == 0, "answer_body").otherwise("question_body")
    records = turns.select("conv_id", "turn", "blob", F.col("item").alias("item_id"), origin.alias("origin")).distinct()
    return provenance.authors(records, provenance.blob_items(blobs)).select("conv_id", "turn", "origin", "author", "author_link")


def run_summaries(spark, d):
    """Each 500 events are a run whose statistics were kept as a JSON array."""
    e = table(spark, d, "events").where("event_id is not null")
    loss = F.abs("value") + 1
    per = F.struct(
        (F.col("event_id") % 500).cast("int").alias("epoch"), loss.alias("train_loss"), (loss + F.col("event_id") % 7).alias("val_loss"),
        (F.lit(0.001) / (1 + F.col("event_id") % 500)).alias("learning_rate"), F.col("ts").cast("string").alias("timestamp"),
    )
    stats = e.groupBy(F.floor(F.col("event_id") / 500).alias("run")).agg(F.to_json(F.sort_array(F.collect_list(per))).alias("body"))
    found = run_statistics.summary(run_statistics.epochs(stats))
    return found.select("run", "n_epochs", "best_epoch", *(F.round(c, 6).alias(c) for c in found.columns if c not in ("run", "n_epochs", "best_epoch")))


def curation_reasons(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").alias("target_id"), F.col("event_type").alias("reason"), F.col("ts").alias("created_at"), F.col("event_id").alias("id"))
    return S.oldest_reason(log)


def paginate_groups(spark, d):
    return S.page(_instances(spark, d).groupBy("hash").agg(F.count(F.lit(1)).alias("n")), "hash", 40, 25)


def paginate_active_groups(spark, d):
    return S.page(S.without_removed(_instances(spark, d), _removed(spark, d)).groupBy("hash").agg(F.count(F.lit(1)).alias("n")), "hash", 40, 25)


def sample_groups_seeded(spark, d):
    return S.seeded_sample(S.without_removed(_instances(spark, d), _removed(spark, d)).select("hash").distinct(), "hash", 50, 42)


def groups_by_family(spark, d):
    return _instances(spark, d).groupBy("family").agg(F.count_distinct("hash").alias("n_groups"), F.count(F.lit(1)).alias("n_instances"))


def point_lookup(spark, d):
    i = _instances(spark, d)
    return i.join(i.groupBy().agg(F.min("hash").alias("hash")), "hash", "left_semi").select("instance_id", "hash", "family")


def rejection_histogram(spark, d):
    t = F.col("text")
    reason = F.coalesce(F.when(F.trim(t) == "", "empty"), F.when(t.contains("$$"), "display_math"), F.when(t.rlike("(?i)license"), "license"), F.when(F.length(t) < 200, "short"), F.lit("accepted"))
    return table(spark, d, "documents").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def acceptance_rate(spark, d):
    ok = (F.length("text") >= 200) & ~F.col("text").contains("$$")
    return table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("accepted"), F.round(F.avg(ok.cast("double")), 6).alias("rate"))


def stage_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", S.record_id("normalized", F.col("doc_id").cast("string"), F.col("text")).alias("normalized_id"), F.concat(F.lit("integrand-group-"), S.short_hash(F.col("text"))).alias("group_id"), F.substring(F.sha2("text", 256), 1, 8).alias("seed_key"))


def safe_url(spark, d):
    u = F.trim("url")
    return table(spark, d, "pages").select("page_id", F.when(u.rlike("^https?://"), u).alias("safe_url"))


def source_url(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") == 0, F.concat(F.lit("https://example.org/q/"), F.col("conv_id"))).otherwise(F.concat(F.lit("https://example.org/a/"), F.col("conv_id"), F.lit("#"), F.col("turn"))).alias("url"))


def closed_forms(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("instance_order"), F.col("turn"), F.posexplode(F.split("text", r"\. ")).alias("position", "form"))
    return S.closed_forms(c.select(F.col("instance_order"), (F.col("turn") * 100000 + F.col("position")).alias("position"), "form")).select("form", "instance_order", "position")


def failure_upsert(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("key"), F.col("event_type").alias("failure_type"), F.col("props").alias("message"), "ts", "event_id")
    return S.upsert_failures(e).select("key", "failure_type", "attempts", "message", F.unix_micros(F.col("first_attempt").cast("timestamp")).alias("first_us"), F.unix_micros(F.col("last_attempt").cast("timestamp")).alias("last_us"))


def answer_to_question(spark, d):
    """Distinct (answer, question) pairs; of an answer seen twice the last line wins."""
    return table(spark, d, "events").groupBy((F.col("event_id") % 5003).alias("answer_id")).agg(F.max_by("user_id", "event_id").alias("question_id"))


def blob_path_update(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.create_map(F.lit("raw"), F.concat(F.lit("blobs/"), F.col("doc_id"))).alias("m"))
    paths = table(spark, d, "labels").select("doc_id", F.concat(F.lit("answers/"), F.col("doc_id")).alias("p"))
    out = docs.join(paths, "doc_id", "left").withColumn("m", F.when(F.col("p").isNotNull(), F.map_concat("m", F.create_map(F.lit("answer_blob"), F.col("p")))).otherwise(F.col("m")))
    return out.select("doc_id", F.array_join(F.transform(F.array_sort(F.map_keys("m")), lambda k: F.concat(k, F.lit("="), F.element_at("m", k))), ";").alias("paths"))


def text_or_base64_blob(spark, d):
    """Pages as text, or as base64 where they hold a NUL."""
    html = F.col("html").cast("binary")
    return table(spark, d, "pages").select("page_id", F.when(F.is_valid_utf8(F.col("html")) & ~F.col("html").contains("\0"), F.col("html")).otherwise(F.base64(html)).alias("body"), F.sha2(html, 256).alias("sha256"), F.octet_length(html).cast("long").alias("n_bytes"))


def url_cross_product(spark, d):
    """Tags by pages: one row for each request."""
    tags = table(spark, d, "documents").select(F.col("source").alias("tag")).distinct()  # a configured list in practice
    return tags.select("tag", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("page")).select("tag", "page", F.concat(F.lit("https://api.example.org/q?tag="), F.url_encode("tag"), F.lit("&page="), F.col("page")).alias("url"))


def equality_saturation_split_unprocessed(spark, d):
    """Seeds that have a cluster, and those that have none."""
    seeds = table(spark, d, "documents").select("doc_id")
    done = table(spark, d, "labels").select("doc_id").distinct().withColumn("done", F.lit(True))
    return seeds.join(done, "doc_id", "left").groupBy(F.coalesce("done", F.lit(False)).alias("processed")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    checksum_dedup_keep_first, group_by_hash, group_by_source, conversation_files, count_groups, count_instances, store_statistics, resume_anti_join, contributor_semi_join, group_instance_metadata_join,
    author_lookup_join, checksum_normalised, blob_authors, run_summaries, curation_reasons, paginate_groups, paginate_active_groups, sample_groups_seeded, groups_by_family, point_lookup, rejection_histogram,
    acceptance_rate, stage_ids, safe_url, source_url, closed_forms, failure_upsert, answer_to_question, blob_path_update, text_or_base64_blob, url_cross_product,
    equality_saturation_split_unprocessed,
)}

_I = "i AS (SELECT doc_id AS instance_id, substr(sha256(text), 1, 12) AS hash, source AS family, CASE WHEN lang = 'en' THEN 'definite' ELSE 'indefinite' END AS kind, doc_id % 97 AS question_id, text AS variant FROM documents), x AS (SELECT DISTINCT doc_id AS instance_id FROM labels WHERE toxic = 1)"
_G = "g AS (SELECT hash, arg_min(family, instance_id) AS family, count(*) FILTER (kind = 'definite') AS definite, count(*) FILTER (kind <> 'definite') AS indefinite, count(DISTINCT CASE WHEN question_id <> 0 THEN question_id END) AS questions, min(instance_id) AS first_id, array_to_string(list_slice(list_sort(list_distinct(list(variant))), 1, 10), '|') AS variants FROM i GROUP BY hash)"

ORACLE_SQL = {
    "checksum_dedup_keep_first": "SELECT 'sha256:' || sha256(text) AS checksum, min(doc_id) AS doc_id FROM documents GROUP BY ALL",
    "group_by_source": """WITH v AS (SELECT DISTINCT source AS family, CASE WHEN lang = 'en' THEN 'definite' ELSE 'indefinite' END AS kind, md5(text) AS v FROM documents),
i AS (SELECT source AS family, CASE WHEN lang = 'en' THEN 'definite' ELSE 'indefinite' END AS kind, doc_id AS i FROM documents),
a AS (SELECT family, kind, string_agg(v, '|' ORDER BY v) AS variants FROM (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY family, kind ORDER BY v) <= 10) GROUP BY ALL),
b AS (SELECT family, kind, string_agg(i, '|' ORDER BY i) AS ids FROM (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY family, kind ORDER BY i) <= 10) GROUP BY ALL)
SELECT family, kind, variants, ids FROM a JOIN b USING (family, kind)""",
    "conversation_files": """WITH l AS (SELECT conv_id, turn, role || ': ' || regexp_replace(text, '\\s+', ' ', 'g') AS line FROM conversations),
f AS (SELECT conv_id, count(*) AS lines, string_agg(line, chr(10) ORDER BY turn) || chr(10) AS body FROM l GROUP BY conv_id)
SELECT conv_id, lines, strlen(body) AS bytes, sha256(body) AS sha256 FROM f""",
    "group_by_hash": f"WITH {_I}, {_G} SELECT * FROM g",
    "count_groups": f"WITH {_I}, f AS (SELECT hash, count(x.instance_id) AS gone, count(*) AS n FROM i LEFT JOIN x USING (instance_id) GROUP BY hash) SELECT count(*) AS n_all, count(*) FILTER (gone = 0) AS n_without_any, count(*) FILTER (gone < n) AS n_without_all FROM f",
    "count_instances": f"WITH {_I} SELECT count(*) AS n, count(*) FILTER (instance_id NOT IN (SELECT instance_id FROM x)) AS n_active FROM i",
    "store_statistics": f"WITH {_I} SELECT count(DISTINCT hash) AS n_groups, count(*) AS n_instances, count(x.instance_id) AS n_removed, count(*) - count(x.instance_id) AS n_active, count(DISTINCT family) AS n_families FROM i LEFT JOIN x USING (instance_id)",
    "resume_anti_join": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "contributor_semi_join": "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "group_instance_metadata_join": f"WITH {_I}, {_G} SELECT hash, g.family AS group_family, definite, indefinite, i.instance_id, i.kind, role, length(c.text) AS n_text FROM g JOIN i USING (hash) LEFT JOIN (SELECT * FROM conversations WHERE turn = 0) c ON c.conv_id = i.instance_id",
    "author_lookup_join": "WITH c AS (SELECT conv_id, arg_min(role, turn) AS a, arg_max(role, turn) AS b, max(turn) AS turns FROM conversations GROUP BY conv_id) SELECT doc_id, CASE WHEN turns > 0 THEN b ELSE a END AS author FROM documents LEFT JOIN c ON c.conv_id = doc_id % 211",
    # NFC and NFKC are the same for the characters of these tables; those that tell them apart are tested
    "checksum_normalised": r"SELECT 'sha256:' || sha256(trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g'))) AS checksum, min(doc_id) AS doc_id FROM documents WHERE length(text) > 0 GROUP BY ALL",
    "blob_authors": """SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'answer_body' ELSE 'question_body' END AS origin, CASE WHEN (turn % 3 = 0) = (turn % 2 = 1) THEN min(coalesce(role || '-', '') || conv_id) END AS author,
  CASE WHEN (turn % 3 = 0) = (turn % 2 = 1) THEN 'https://example.org/u/' || conv_id END AS author_link FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn""",
    "run_summaries": """WITH e AS (SELECT event_id // 500 AS run, event_id % 500 AS k, abs(value) + 1 AS t, abs(value) + 1 + event_id % 7 AS v FROM events),
r AS (SELECT run, count(*) AS n_epochs, arg_max(t, k) AS t, arg_max(v, k) AS v, arg_min(t, k) AS t0, arg_min(v, k) AS v0, max(k) AS last, min(v) AS best, (arg_min(k, (v, k)) - min(k) + 1)::INT AS best_epoch FROM e GROUP BY run)
SELECT run, n_epochs, best_epoch, round(t, 6) AS final_train_loss, round(v, 6) AS final_val_loss, round(0.001 / (1 + last), 6) AS final_lr, round(best, 6) AS best_val_loss,
  round((t0 - t) / t0, 6) AS train_loss_improvement, round((v0 - v) / v0, 6) AS val_loss_improvement, round(v - t, 6) AS val_train_gap, round(v / t, 6) AS overfit_ratio FROM r""",
    "curation_reasons": "SELECT user_id AS target_id, arg_min(event_type, (ts, event_id)) AS reason FROM events GROUP BY user_id",
    "paginate_groups": f"WITH {_I} SELECT hash, count(*) AS n FROM i GROUP BY hash ORDER BY hash LIMIT 25 OFFSET 40",
    "paginate_active_groups": f"WITH {_I} SELECT hash, count(*) AS n FROM i WHERE instance_id NOT IN (SELECT instance_id FROM x) GROUP BY hash ORDER BY hash LIMIT 25 OFFSET 40",
    "sample_groups_seeded": f"WITH {_I}, h AS (SELECT DISTINCT hash FROM i WHERE instance_id NOT IN (SELECT instance_id FROM x)) SELECT hash FROM h ORDER BY md5('42|' || hash), hash LIMIT 50",
    "groups_by_family": f"WITH {_I} SELECT family, count(DISTINCT hash) AS n_groups, count(*) AS n_instances FROM i GROUP BY family",
    "point_lookup": f"WITH {_I} SELECT instance_id, hash, family FROM i WHERE hash = (SELECT min(hash) FROM i)",
    "rejection_histogram": "SELECT CASE WHEN trim(text) = '' THEN 'empty' WHEN contains(text, '$$') THEN 'display_math' WHEN regexp_matches(text, '(?i)license') THEN 'license' WHEN length(text) < 200 THEN 'short' ELSE 'accepted' END AS reason, count(*) AS n FROM documents GROUP BY ALL",
    "acceptance_rate": "SELECT count(*) AS n, count(*) FILTER (length(text) >= 200 AND NOT contains(text, '$$')) AS accepted, round(avg((length(text) >= 200 AND NOT contains(text, '$$'))::INT), 6) AS rate FROM documents",
    "stage_ids": "SELECT doc_id, 'normalized-' || substr(sha1(doc_id || ':' || text), 1, 12) AS normalized_id, 'integrand-group-' || substr(sha256(text), 1, 12) AS group_id, substr(sha256(text), 1, 8) AS seed_key FROM documents",
    "safe_url": "SELECT page_id, CASE WHEN regexp_matches(trim(url), '^https?://') THEN trim(url) END AS safe_url FROM pages",
    "source_url": "SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'https://example.org/q/' || conv_id ELSE 'https://example.org/a/' || conv_id || '#' || turn END AS url FROM conversations",
    "closed_forms": r"WITH s AS (SELECT conv_id, turn, string_split(text, '. ') AS l FROM conversations), f AS (SELECT conv_id AS instance_order, turn * 100000 + unnest(range(0, len(l))) AS position, unnest(l) AS form FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY form ORDER BY instance_order, position) AS rn FROM f WHERE NOT regexp_matches(form, '\\int|\\eqref|\\ref|\\lim')) SELECT form, instance_order, position FROM k WHERE rn = 1",
    "failure_upsert": "SELECT user_id AS key, event_type AS failure_type, count(*) AS attempts, arg_min(props, (ts, event_id)) AS message, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM events WHERE event_type = 'error' GROUP BY ALL",
    "answer_to_question": "SELECT event_id % 5003 AS answer_id, arg_max(user_id, event_id) AS question_id FROM events GROUP BY ALL",
    "blob_path_update": "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN '' ELSE 'answer_blob=answers/' || d.doc_id || ';' END || 'raw=blobs/' || d.doc_id AS paths FROM documents d LEFT JOIN labels l USING (doc_id)",
    "text_or_base64_blob": "SELECT page_id, CASE WHEN contains(html, chr(0)) THEN base64(encode(html)) ELSE html END AS body, sha256(html) AS sha256, strlen(html) AS n_bytes FROM pages",
    "url_cross_product": "SELECT tag, page::INT AS page, 'https://api.example.org/q?tag=' || tag || '&page=' || page AS url FROM (SELECT DISTINCT source AS tag FROM documents), range(1, 6) r(page)",
    "equality_saturation_split_unprocessed": "SELECT doc_id IN (SELECT doc_id FROM labels) AS processed, count(*) AS n FROM documents GROUP BY ALL",
}

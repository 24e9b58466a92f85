"""Corpus validation and manifest reconciliation."""

from pyspark.sql import functions as F

from quern.functions import numbers
from quern.operators import audit, metrics, positions
from quern.plans.declare import Plans
from quern.tables import load

PLANS = Plans()
SPLIT = "CASE WHEN substr(sha256('7|' || {0}), 1, 1) < '2' THEN 'test' ELSE 'train' END"


def split_of(key: str):
    return F.when(F.substring(numbers.sha(F.lit(7), key), 1, 1) < "2", "test").otherwise("train")


@PLANS.query("multi_histogram", "SELECT * FROM (SELECT 'lang' AS key, lang AS value, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source UNION ALL SELECT 'toxic', CAST(toxic AS VARCHAR), count(*) FROM documents LEFT JOIN labels USING (doc_id) GROUP BY toxic UNION ALL SELECT 'quality', CAST(quality AS VARCHAR), count(*) FROM documents LEFT JOIN labels USING (doc_id) GROUP BY quality)")
def multi_histogram(spark, sf):
    both = load(spark, sf, "documents").select("doc_id", "lang", "source").join(load(spark, sf, "labels"), "doc_id", "left")
    return audit.multi_histogram(both, ["lang", "source", "toxic", "quality"])


@PLANS.query("duration_stats", "SELECT event_type, coalesce(round(min(value), 6), 0) AS lo, coalesce(round(max(value), 6), 0) AS hi, coalesce(round(avg(value), 6), 0) AS mean, coalesce(round(quantile_cont(value, 0.5), 6), 0) AS median, CAST(count(value) AS BIGINT) AS n, coalesce(round(sum(value), 4), 0) AS total FROM events GROUP BY event_type")
def duration_stats(spark, sf):
    """All 0 where there is nothing to measure."""
    zero = lambda c: F.coalesce(F.round(c, 6), F.lit(0.0))
    e = load(spark, sf, "events")
    sums = [zero(F.min("value")).alias("lo"), zero(F.max("value")).alias("hi"), zero(F.avg("value")).alias("mean"), F.count("value").alias("n"), F.coalesce(F.round(F.sum("value"), 4), F.lit(0.0)).alias("total")]
    return metrics.with_percentiles(e, ["event_type"], {"value": F.col("value")}, {"median": ("value", 0.5)}, sums).withColumn("median", zero("median"))


@PLANS.query("duplicate_counts", "SELECT 'text' AS key, CAST(count(*) - count(DISTINCT text) AS BIGINT) AS duplicates FROM documents UNION ALL SELECT 'source', count(*) - count(DISTINCT source) FROM documents")
def duplicate_counts(spark, sf):
    return audit.duplicate_counts(load(spark, sf, "documents"), ["text", "source"])


@PLANS.query("leakage_lag", f"WITH d AS (SELECT doc_id, text, {SPLIT.format('doc_id')} AS split FROM documents), l AS (SELECT doc_id, split, lag(split) OVER (PARTITION BY text ORDER BY doc_id) AS before FROM d) SELECT doc_id, split, before FROM l WHERE before <> split")
def leakage_lag(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), split_of("doc_id").alias("split"))
    return audit.leakage(d, F.col("digest"), "split", "doc_id").select("doc_id", "split", "before")


@PLANS.query(
    "corpus_report",
    f"""WITH d AS (SELECT doc_id, text, n_chars, {SPLIT.format('doc_id')} AS split FROM documents),
l AS (SELECT lag(split) OVER (PARTITION BY text ORDER BY doc_id) AS before, split FROM d), x AS (SELECT CAST(count(*) AS BIGINT) AS leaks FROM l WHERE before <> split),
s AS (SELECT CAST(count(*) AS BIGINT) AS samples, CAST(count(*) - count(DISTINCT text) AS BIGINT) AS duplicates, CAST(sum(n_chars) AS BIGINT) AS total, round(avg(n_chars), 6) AS mean FROM d),
u AS (SELECT CAST(count(*) AS BIGINT) AS unlabelled FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
SELECT samples, duplicates, total, mean, leaks, unlabelled, duplicates = 0 AND leaks = 0 AND unlabelled = 0 AS passed FROM s, x, u""",
)
def corpus_report(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), "n_chars", split_of("doc_id").alias("split"))
    groups = d.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
    sums = groups.agg(F.sum("n").alias("samples"), F.sum(F.col("n") - 1).alias("duplicates"), F.sum("chars").alias("total"))
    leaks = audit.leakage(d, F.col("digest"), "split", "doc_id").agg(F.count(F.lit(1)).alias("leaks"))
    free = audit.pending(d, load(spark, sf, "labels"), "doc_id").agg(F.count(F.lit(1)).alias("unlabelled"))
    one = sums.withColumn("one", F.lit(1)).join(leaks.withColumn("one", F.lit(1)), "one").join(free.withColumn("one", F.lit(1)), "one")
    passed = (F.col("duplicates") == 0) & (F.col("leaks") == 0) & (F.col("unlabelled") == 0)
    return one.select("samples", "duplicates", "total", F.round(F.col("total") / F.col("samples"), 6).alias("mean"), "leaks", "unlabelled", passed.alias("passed"))


@PLANS.query("manifest_progress", "SELECT lang, CAST(count(*) AS BIGINT) AS expected, CAST(count(*) FILTER (WHERE quality = 1) AS BIGINT) AS saved, CAST(count(*) FILTER (WHERE quality = 0) AS BIGINT) AS skipped, CAST(count(*) FILTER (WHERE quality IS NULL) AS BIGINT) AS pending FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def manifest_progress(spark, sf):
    both = load(spark, sf, "documents").select("doc_id", "lang").join(load(spark, sf, "labels"), "doc_id", "left")
    return both.groupBy("lang").agg(F.count(F.lit(1)).alias("expected"), F.count_if(F.col("quality") == 1).alias("saved"), F.count_if(F.col("quality") == 0).alias("skipped"), F.count_if(F.col("quality").isNull()).alias("pending"))


@PLANS.query("pending_anti_join", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_anti_join(spark, sf):
    return audit.pending(load(spark, sf, "documents").select("doc_id", "lang"), load(spark, sf, "labels"), "doc_id")


@PLANS.query("previous_run", "WITH p AS (SELECT 'doc_' || doc_id || '.wav' AS name, toxic FROM labels) SELECT doc_id, 'audio/doc_' || doc_id || '.wav' AS path, toxic AS before, toxic IS NOT NULL AS known FROM documents LEFT JOIN p ON name = regexp_extract('audio/doc_' || doc_id || '.wav', '[^/]+$')")
def previous_run(spark, sf):
    """Files of this run with what an earlier run knew of files of the same name, wherever they lie."""
    name = lambda path: F.regexp_extract(path, "[^/]+$", 0)
    path = F.format_string("audio/doc_%d.wav", "doc_id")
    before = load(spark, sf, "labels").select(F.format_string("doc_%d.wav", "doc_id").alias("name"), F.col("toxic").alias("before"))
    files = load(spark, sf, "documents").select("doc_id", path.alias("path")).withColumn("name", name(F.col("path")))
    return files.join(before, "name", "left").select("doc_id", "path", "before", F.col("before").isNotNull().alias("known"))


@PLANS.query("resume_reconcile", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN n_chars % 2 = toxic THEN 'verified' ELSE 'stale' END AS state FROM documents d LEFT JOIN labels l USING (doc_id)")
def resume_reconcile(spark, sf):
    plan = load(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("parity"))
    made = load(spark, sf, "labels").select("doc_id", "toxic", F.lit(True).alias("there"))
    state = F.when(F.col("there").isNull(), "missing").when(F.col("parity").eqNullSafe(F.col("toxic")), "verified").otherwise("stale")
    return plan.join(made, "doc_id", "left").select("doc_id", state.alias("state"))


#: Orders as planned utterances, their sidecars with wrong fields here and there, and files measured by their lines.
SIDECARS = """SELECT o_orderkey AS id, 'audio/' || o_orderkey AS audio, CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice < 50000 THEN NULL ELSE 'customer ' || o_custkey END AS text,
 CASE WHEN o_totalprice > 300000 THEN 'other' ELSE o_orderpriority END AS voice, n AS frames, CASE WHEN n >= 6 THEN -1 ELSE qty END AS duration
FROM orders LEFT JOIN (SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n, CAST(sum(l_quantity) AS DOUBLE) AS qty FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'"""


@PLANS.query(
    "resume_fields",
    f"""WITH s AS ({SIDECARS}), f AS (SELECT l_orderkey AS id, CAST(count(*) AS BIGINT) AS frames, CAST(sum(l_quantity) AS DOUBLE) AS duration FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1),
j AS (SELECT o_orderkey AS id, s.id IS NOT NULL AS there, f.id IS NOT NULL AS disk, concat_ws(',', CASE WHEN 'audio/' || o_orderkey IS DISTINCT FROM s.audio THEN 'audio' END, CASE WHEN 'customer ' || o_custkey IS DISTINCT FROM s.text THEN 'text' END,
 CASE WHEN o_orderpriority IS DISTINCT FROM s.voice THEN 'voice' END, CASE WHEN f.id IS NOT NULL AND s.frames IS DISTINCT FROM f.frames THEN 'frames' END, CASE WHEN f.id IS NOT NULL AND s.duration IS DISTINCT FROM f.duration THEN 'duration' END) AS differing
 FROM orders LEFT JOIN s ON s.id = o_orderkey LEFT JOIN f ON f.id = o_orderkey)
SELECT id, CASE WHEN NOT there THEN 'missing' WHEN NOT disk THEN 'no file' WHEN differing <> '' THEN 'stale' ELSE 'verified' END AS state, CASE WHEN there THEN differing ELSE '' END AS differing FROM j""",
)
def resume_fields(spark, sf):
    """What is left of a plan: every field of it and everything measured must agree."""
    orders, price = load(spark, sf, "orders"), F.col("o_totalprice")
    lines = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("frames"), F.sum("l_quantity").cast("double").alias("duration"))
    plan = orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("audio/"), "o_orderkey").alias("audio"), F.concat(F.lit("customer "), "o_custkey").alias("text"), F.col("o_orderpriority").alias("voice"), "o_orderstatus", price)
    text = F.when((F.col("voice") == "1-URGENT") & (price < 50000), F.lit(None)).otherwise(F.col("text"))
    made = plan.where("o_orderstatus <> 'P'").join(lines, "id", "left")
    sidecars = made.select("id", "audio", text.alias("text"), F.when(price > 300000, "other").otherwise(F.col("voice")).alias("voice"), "frames", F.when(F.col("frames") >= 6, -1.0).otherwise(F.col("duration")).alias("duration"))
    return audit.resume(plan, sidecars, lines.where("frames > 1"), "id", ["audio", "text", "voice"], ["frames", "duration"])


@PLANS.query(
    "reconcile_full_outer",
    """WITH a AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'O' THEN 'O' ELSE 'F' END AS s FROM orders),
b AS (SELECT l_orderkey AS k, max(l_linestatus) AS s FROM lineitem GROUP BY l_orderkey UNION ALL SELECT -o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority = '5-LOW')
SELECT coalesce(a.k, b.k) AS orderkey, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'extra' WHEN a.s IS DISTINCT FROM b.s THEN 'changed' ELSE 'same' END AS state FROM a FULL JOIN b ON a.k = b.k""",
)
def reconcile_full_outer(spark, sf):
    """All orders against all that was made, which has keys that no order has, so that there are extra ones."""
    orders = load(spark, sf, "orders")
    plan = orders.select(F.col("o_orderkey").alias("orderkey"), F.when(F.col("o_orderstatus") == "O", "O").otherwise("F").alias("s"))
    found = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("orderkey")).agg(F.max("l_linestatus").alias("s"))
    more = orders.where("o_orderpriority = '5-LOW'").select(-F.col("o_orderkey"), "o_orderstatus")
    return audit.reconcile(plan, found.unionAll(more), "orderkey", [("s", "s")])


@PLANS.query(
    "set_difference_both",
    """WITH a AS (SELECT o_orderkey AS k FROM orders), b AS (SELECT l_orderkey AS k FROM lineitem UNION ALL SELECT -o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT k, 'missing' AS side FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT k, 'extra' FROM (SELECT k FROM b EXCEPT SELECT k FROM a)""",
)
def set_difference_both(spark, sf):
    """All orders against the keys of lines and some that no order has."""
    orders = load(spark, sf, "orders")
    more = orders.where("o_orderpriority = '1-URGENT'").select((-F.col("o_orderkey")).alias("k"))
    return audit.differences(orders.select(F.col("o_orderkey").alias("k")), load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")).unionAll(more), "k")


#: A manifest of orders with a file for each that has lines; what is wrong with a record comes from its lines and its price.
MANIFEST = """SELECT o_orderkey, o_totalprice, n, total, qty, CASE o_orderstatus WHEN 'F' THEN 'saved' WHEN 'O' THEN 'skipped' ELSE 'lost' END AS status,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'full' WHEN '2-HIGH' THEN 'short' WHEN '3-MEDIUM' THEN 'natural' WHEN '4-NOT SPECIFIED' THEN 'other' ELSE 'full' END AS variant, o_custkey AS street, CASE WHEN n = 6 THEN -1 ELSE o_custkey END AS planned_street,
 CASE WHEN o_totalprice > 400000 THEN NULL WHEN o_orderpriority = '2-HIGH' THEN 'short' WHEN o_orderpriority = '3-MEDIUM' AND n > 1 THEN 'natural' ELSE 'full' END AS planned_variant,
 CASE WHEN n = 1 THEN ' ' ELSE 'raw' END AS reference_raw, CASE WHEN n <= 2 THEN '' ELSE 'said' END AS reference, CASE WHEN n >= 2 THEN 'audio/' || o_orderkey END AS audio, coalesce(total >= 60000, false) AS there, coalesce(qty >= 20, false) AS readable,
 CASE WHEN n = 3 THEN 16000 ELSE 8000 END AS wav_rate, CASE WHEN n = 4 THEN 2 ELSE 1 END AS wav_channels, CASE WHEN n = 5 THEN 1 ELSE 2 END AS wav_bytes, CASE WHEN n = 6 THEN 'ULAW' ELSE 'NONE' END AS codec,
 CASE WHEN qty < 60 THEN 0 ELSE CAST(qty * 8000 AS BIGINT) END AS frames, CASE WHEN total > 250000 THEN 1000 ELSE 10000000 END AS file_bytes, CASE WHEN n = 7 THEN NULL WHEN n = 3 THEN qty / 2 ELSE qty END AS duration, CASE WHEN n = 5 THEN 16000 END AS rate, CASE WHEN n = 4 THEN 2 END AS channels
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(l_extendedprice) AS total, sum(l_quantity) AS qty FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey"""
WAV = "status = 'saved' AND audio IS NOT NULL AND there AND readable"
SECONDS = "(frames / wav_rate)"
RULES = {
    "outside the plan": "planned_variant IS NULL", "unknown variant": "variant = 'other'", "unlike the plan": "variant <> 'other' AND planned_variant IS NOT NULL AND (planned_street <> street OR planned_variant <> variant)", "unknown status": "status = 'lost'",
    "empty raw reference": "status = 'saved' AND trim(reference_raw) = ''", "empty reference": "status = 'saved' AND reference = ''", "no path": "status = 'saved' AND audio IS NULL", "missing file": "status = 'saved' AND audio IS NOT NULL AND NOT there", "unreadable file": "status = 'saved' AND audio IS NOT NULL AND there AND NOT readable",
    "sample rate": f"{WAV} AND wav_rate <> 8000", "channels": f"{WAV} AND wav_channels <> 1", "sample width": f"{WAV} AND wav_bytes <> 2", "compressed": f"{WAV} AND codec <> 'NONE'", "zero duration": f"{WAV} AND frames <= 0", "truncated file": f"{WAV} AND frames * wav_channels * wav_bytes > file_bytes",
    "duration differs": f"{WAV} AND (duration IS NULL OR abs(duration - {SECONDS}) > 0.05)", "recorded sample rate": f"{WAV} AND rate <> 8000", "recorded channels": f"{WAV} AND channels <> 1", "skipped with a file": "status = 'skipped' AND audio IS NOT NULL",
}


def manifest(spark, sf):
    lines = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("total"), F.sum("l_quantity").alias("qty"))
    o = load(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    n, qty, total, by = F.col("n"), F.col("qty"), F.col("total"), F.col("o_orderpriority")
    variant = F.when(by == "2-HIGH", "short").when(by == "3-MEDIUM", "natural").when(by == "4-NOT SPECIFIED", "other").otherwise("full")
    planned = F.when(F.col("o_totalprice") > 400000, F.lit(None)).when(by == "2-HIGH", "short").when((by == "3-MEDIUM") & (n > 1), "natural").otherwise("full")
    return o.select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", "saved").when(F.col("o_orderstatus") == "O", "skipped").otherwise("lost").alias("status"), variant.alias("variant"), F.col("o_custkey").alias("street"), F.lit(True).alias("has_plan"),
        F.when(n == 6, F.lit(-1)).otherwise(F.col("o_custkey")).alias("planned_street"), planned.alias("planned_variant"), F.when(n == 1, " ").otherwise("raw").alias("reference_raw"), F.when(n <= 2, "").otherwise("said").alias("reference"), F.when(n >= 2, F.concat(F.lit("audio/"), F.col("o_orderkey").cast("string"))).alias("audio"),
        F.coalesce(total >= 60000, F.lit(False)).alias("there"), F.coalesce(qty >= 20, F.lit(False)).alias("readable"), F.when(n == 3, 16000).otherwise(8000).alias("wav_rate"), F.when(n == 4, 2).otherwise(1).alias("wav_channels"), F.when(n == 5, 1).otherwise(2).alias("wav_bytes"), F.when(n == 6, "ULAW").otherwise("NONE").alias("codec"),
        F.when(qty < 60, F.lit(0)).otherwise((qty * 8000).cast("long")).alias("frames"), F.when(total > 250000, 1000).otherwise(10_000_000).alias("file_bytes"), F.when(n == 7, F.lit(None)).when(n == 3, qty / 2).otherwise(qty).alias("duration"), F.when(n == 5, 16000).alias("rate"), F.when(n == 4, 2).alias("channels"),
    )


@PLANS.query("manifest_validate", f"WITH m AS ({MANIFEST}) SELECT o_orderkey, unnest(list_filter([{', '.join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in RULES.items())}], lambda x: x IS NOT NULL)) AS rule FROM m")
def manifest_validate(spark, sf):
    return audit.violations(manifest(spark, sf), ["o_orderkey"], audit.manifest_rules(["full", "short", "natural"]))


@PLANS.query("manifest_keys", "SELECT digest, 'duplicate id' AS problem, CAST(n AS BIGINT) AS n FROM (SELECT sha256(text) AS digest, count(*) AS n FROM documents GROUP BY 1) WHERE n > 1")
def manifest_keys(spark, sf):
    """The digest of a text as the id of its record."""
    return audit.key_problems(load(spark, sf, "documents").select(F.sha2("text", 256).alias("digest")), "digest")


@PLANS.query("positional_zip", "WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS pos FROM documents), b AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id DESC) AS pos FROM documents) SELECT pos, a.doc_id AS reference_id, b.doc_id AS prediction_id, lang FROM a JOIN b USING (pos)")
def positional_zip(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "lang").withColumn("back", -F.col("doc_id"))
    both = positions.zip_by_position(d.select(F.col("doc_id").alias("reference_id")), ["reference_id"], d, ["back"])
    return both.select("pos", "reference_id", F.col("doc_id").alias("prediction_id"), "lang")


@PLANS.query(
    "positional_lines",
    """WITH a AS (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS pos FROM lineitem),
b AS (SELECT l_orderkey AS with_order, l_linenumber AS with_line, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos FROM lineitem)
SELECT pos, l_orderkey, l_linenumber, with_order, with_line FROM a JOIN b USING (pos)""",
)
def positional_lines(spark, sf):
    """The lines by price beside the lines by date."""
    lines = load(spark, sf, "lineitem")
    a = lines.select("l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    b = lines.select("l_shipdate", F.col("l_orderkey").alias("with_order"), F.col("l_linenumber").alias("with_line"), F.col("l_partkey").alias("with_part"), F.col("l_suppkey").alias("with_supplier"), F.col("l_extendedprice").alias("with_price"))
    both = positions.zip_by_position(a, ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], b, ["l_shipdate", "with_order", "with_line", "with_part", "with_supplier", "with_price"])
    return both.select("pos", "l_orderkey", "l_linenumber", "with_order", "with_line")


#: Lines as a plan of utterances, with metadata and manifests of splits that disagree with it here and there.
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
PLAN = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_linestatus, CASE WHEN l_linestatus = 'O' AND l_linenumber = 7 THEN l_orderkey * 8 + 6 ELSE l_orderkey * 8 + l_linenumber END AS id,
 CASE l_returnflag WHEN 'N' THEN 'train' WHEN 'A' THEN 'validation' ELSE 'test' END AS split, 'audio/' || l_orderkey || '_' || l_linenumber AS audio, 'part ' || l_partkey AS text FROM lineitem"""
WRONG_META, WRONG_MANIFEST, WRONG_TEXT = "l_quantity >= 50 AND l_linenumber = 1", "l_quantity <= 1 AND l_linenumber = 2", "l_quantity = 49 AND l_linestatus = 'F'"
LOCK_STEP = f"""WITH p AS (SELECT *, row_number() OVER (ORDER BY {', '.join(LINE_ORDER)}) AS place FROM ({PLAN})), last AS (SELECT max(l_orderkey) AS k, min(l_orderkey) AS least FROM p),
m AS (SELECT row_number() OVER (ORDER BY {', '.join(LINE_ORDER)}) AS place, id, split, audio, CASE WHEN {WRONG_META} THEN '?' ELSE text END AS text FROM p, last WHERE l_orderkey < k),
j AS (SELECT p.*, CASE WHEN m.place IS NULL THEN 'metadata ended' WHEN p.id IS DISTINCT FROM m.id OR p.split IS DISTINCT FROM m.split OR p.audio IS DISTINCT FROM m.audio OR p.text IS DISTINCT FROM m.text THEN 'metadata disagrees' END AS problem FROM p LEFT JOIN m USING (place)),
a AS (SELECT * EXCLUDE problem, row_number() OVER (PARTITION BY split ORDER BY place) AS k FROM j WHERE problem IS NULL),
l AS (SELECT split, audio, text, row_number() OVER (PARTITION BY split ORDER BY ok, {', '.join(LINE_ORDER[1:])}) AS k FROM (
 SELECT l_orderkey AS ok, l_linenumber, l_partkey, l_suppkey, l_extendedprice, split, audio, CASE WHEN {WRONG_MANIFEST} THEN '?' ELSE text END AS text FROM p, last WHERE l_orderkey < k AND NOT ({WRONG_META})
 UNION ALL SELECT l_orderkey + 1000000000000, l_linenumber, l_partkey, l_suppkey, l_extendedprice, 'train', audio, text FROM p, last WHERE l_orderkey = least)),
c AS (SELECT a.*, CASE WHEN l.k IS NULL THEN 'manifest ended' WHEN a.audio IS DISTINCT FROM l.audio OR a.text IS DISTINCT FROM l.text THEN 'manifest disagrees' WHEN {WRONG_TEXT} THEN 'text unlike its template' END AS problem FROM a LEFT JOIN l USING (split, k)),
f AS (SELECT id, min(place) AS first FROM c WHERE problem IS NULL GROUP BY id),
x AS (SELECT place, id, problem FROM j WHERE problem IS NOT NULL UNION ALL SELECT place, id, problem FROM c WHERE problem IS NOT NULL UNION ALL SELECT place, id, 'duplicate id' FROM c JOIN f USING (id) WHERE problem IS NULL AND place > first
 UNION ALL SELECT min(l.k), NULL, 'extra rows in ' || split FROM l LEFT JOIN (SELECT split, max(k) AS taken FROM a GROUP BY split) USING (split) WHERE l.k > coalesce(taken, 0) GROUP BY split)"""


def lock_step(spark, sf):
    lines = load(spark, sf, "lineitem")
    split = F.when(F.col("l_returnflag") == "N", "train").when(F.col("l_returnflag") == "A", "validation").otherwise("test")
    number = F.when((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 7), 6).otherwise(F.col("l_linenumber"))
    audio = F.concat_ws("_", F.concat(F.lit("audio/"), "l_orderkey"), "l_linenumber")
    plan = lines.select(*LINE_ORDER, "l_quantity", "l_linestatus", (F.col("l_orderkey") * 8 + number).alias("id"), split.alias("split"), audio.alias("audio"), F.concat(F.lit("part "), "l_partkey").alias("text"))
    ends = F.broadcast(lines.agg(F.max("l_orderkey").alias("last"), F.min("l_orderkey").alias("least")))
    kept = plan.join(ends, F.col("l_orderkey") < F.col("last"))
    metadata = kept.select(*LINE_ORDER, "id", "split", "audio", F.when(F.expr(WRONG_META), "?").otherwise(F.col("text")).alias("text"))
    manifests = kept.where(f"NOT ({WRONG_META})").select(*LINE_ORDER, "split", "audio", F.when(F.expr(WRONG_MANIFEST), "?").otherwise(F.col("text")).alias("text"))
    more = plan.join(ends, F.col("l_orderkey") == F.col("least")).select(F.col("l_orderkey") + 10**12, *LINE_ORDER[1:], F.lit("train"), "audio", "text")
    rules = [positions.Rule("text unlike its template", F.expr(WRONG_TEXT))]
    return positions.lock_step(plan, metadata, manifests.unionAll(more), LINE_ORDER, ["id", "split", "audio", "text"], ["audio", "text"], rules)


@PLANS.query("lock_step_problems", f"{LOCK_STEP} SELECT CAST(place AS BIGINT) AS place, id, problem FROM x")
def lock_step_problems(spark, sf):
    return lock_step(spark, sf)[0]


@PLANS.query("lock_step_first", f"{LOCK_STEP} SELECT problem, CAST(count(*) AS BIGINT) AS n, CAST(min(place) AS BIGINT) AS place, arg_min(id, place) AS id FROM x GROUP BY problem")
def lock_step_first(spark, sf):
    return positions.first_difference(lock_step(spark, sf)[0])


@PLANS.query(
    "corpus_validation",
    f"""{LOCK_STEP}, g AS (SELECT c.* FROM c JOIN f USING (id) WHERE problem IS NULL AND place = first),
leak AS (SELECT count(*) AS leakage FROM (SELECT split, lag(split) OVER (PARTITION BY audio ORDER BY place) AS before FROM g UNION ALL SELECT split, lag(split) OVER (PARTITION BY id // 8 ORDER BY place) FROM g) WHERE before <> split),
need AS (SELECT l_linenumber, split, count(*) AS n FROM p GROUP BY ALL), have AS (SELECT l_linenumber, split, count(*) AS found FROM g GROUP BY ALL),
wrong AS (SELECT count(*) AS miscounted FROM need LEFT JOIN have USING (l_linenumber, split) WHERE n <> coalesce(found, 0)),
t AS (SELECT count(*) AS samples, count(DISTINCT l_linenumber) AS streets, count(*) - count(DISTINCT audio) AS duplicate_audio, min(l_quantity) AS lo, max(l_quantity) AS hi, sum(l_quantity) AS total, quantile_cont(l_quantity, 0.5) AS median FROM g)
SELECT CAST(streets AS BIGINT) AS streets, CAST(samples AS BIGINT) AS samples, (SELECT count(*) FROM p) AS expected, (SELECT count(*) FROM x) AS invalid, CAST(leakage AS BIGINT) AS leakage, CAST(duplicate_audio AS BIGINT) AS duplicates,
 CAST(miscounted AS BIGINT) AS miscounted, (SELECT count(*) FROM p, last WHERE l_orderkey < k) - (SELECT count(*) FROM p) AS files_off, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, CAST(total AS DOUBLE) AS total, CAST(median AS DOUBLE) AS median, false AS passed FROM t, leak, wrong""",
)
def corpus_validation(spark, sf):
    """The whole report: what lock-step finds, leaks of audio and of families, counts of each street and split, and files on disk against the plan."""
    problems, good = lock_step(spark, sf)
    lines = load(spark, sf, "lineitem")
    ends = F.broadcast(lines.agg(F.max("l_orderkey").alias("last")))
    files = lines.join(ends, F.col("l_orderkey") < F.col("last")).select(F.concat_ws("_", F.concat(F.lit("audio/"), "l_orderkey"), "l_linenumber").alias("path"))
    expected = lines.groupBy(F.col("l_linenumber").alias("street"), F.when(F.col("l_returnflag") == "N", "train").when(F.col("l_returnflag") == "A", "validation").otherwise("test").alias("split")).agg(F.count(F.lit(1)).alias("n"))
    return positions.validation_report(problems, good.withColumnRenamed("l_linenumber", "street"), expected, files, {"audio": F.col("audio"), "family": F.floor(F.col("id") / 8)}, "audio", F.col("l_quantity").cast("double"))

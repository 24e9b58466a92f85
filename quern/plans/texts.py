"""Normalisation, scans, projections and formats."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import numbers
from quern.functions import text as tx
from quern.operators import scans
from quern.plans.declare import Plans
from quern.tables import load

PLANS = Plans()
HEADING = r"^Page \d+.*$"
ALLOWED = r"^[\p{L}0-9 ,.'-]+$"
NORM = r"array_to_string(regexp_extract_all(lower(text), '\p{L}+'), ' ')"


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents")


def normal(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", tx.normalize("text", tx.ANY_LETTER).alias("norm"))


@PLANS.query("normalize_text", f"SELECT doc_id, {NORM} AS norm, CAST(len(regexp_extract_all(lower(text), '\\p{{L}}+')) AS BIGINT) AS n_tokens FROM documents")
def normalize_text(spark, sf):
    words = tx.tokens("text", tx.ANY_LETTER)
    return docs(spark, sf).select("doc_id", F.array_join(words, " ").alias("norm"), F.size(words).cast("long").alias("n_tokens"))


@PLANS.query("exact_match", f"WITH d AS (SELECT doc_id, {NORM} AS norm FROM documents) SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS reference_id, doc_id <> min(doc_id) OVER (PARTITION BY norm) AS matched FROM d")
def exact_match(spark, sf):
    """Each text against the first of the same normal form: one reference a group, not all pairs."""
    d = normal(spark, sf).select("doc_id", F.sha2("norm", 256).alias("digest"))
    first = d.groupBy("digest").agg(F.min("doc_id").alias("reference_id"))
    return d.join(first, "digest").select("doc_id", "reference_id", (F.col("doc_id") != F.col("reference_id")).alias("matched"))


@PLANS.query(
    "scan_lines_audit",
    rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
r AS (SELECT doc_id, line_no, CASE WHEN trim(line) = '' THEN 'empty line' WHEN regexp_matches(trim(line), '{HEADING}') THEN 'page heading'
 WHEN NOT regexp_matches(trim(line), '{ALLOWED.replace("'", "''")}') THEN 'invalid characters'
 WHEN row_number() OVER (PARTITION BY doc_id, trim(line) ORDER BY line_no) > 1 THEN 'duplicate' END AS reason FROM l)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, reason FROM r WHERE reason IS NOT NULL""",
)
def scan_lines_audit(spark, sf):
    audited = scans.audit_lines(scans.lines_of(docs(spark, sf), "doc_id", "text"), "doc_id", HEADING, ALLOWED)
    return audited.where("reason IS NOT NULL").select("doc_id", "line_no", "reason")


@PLANS.query("scan_dedupe_audit", f"WITH d AS (SELECT doc_id, {NORM} AS norm FROM documents), f AS (SELECT doc_id, norm, min(doc_id) OVER (PARTITION BY norm) AS first FROM d) SELECT doc_id, CASE WHEN doc_id = first THEN nullif(norm, '') END AS hotword, CASE WHEN norm = '' THEN 'empty' WHEN doc_id <> first THEN 'duplicate' END AS reason FROM f")
def scan_dedupe_audit(spark, sf):
    d = normal(spark, sf).withColumn("digest", F.sha2("norm", 256))
    first = d.groupBy("digest").agg(F.min("doc_id").alias("first"))
    own = F.col("doc_id") == F.col("first")
    return d.join(first, "digest").select("doc_id", F.when(own, F.nullif("norm", F.lit(""))).alias("hotword"), F.when(F.col("norm") == "", "empty").when(~own, "duplicate").alias("reason"))


@PLANS.query("first_wins_dedup", "SELECT min(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS copies FROM documents GROUP BY text")
def first_wins_dedup(spark, sf):
    return docs(spark, sf).groupBy(F.sha2("text", 256)).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("doc_id", "copies")


@PLANS.query("json_bad_rows", "SELECT event_id, NOT json_valid(props) AS bad, CASE WHEN json_valid(props) THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def json_bad_rows(spark, sf):
    return scans.json_rows(load(spark, sf, "events"), "props", "k bigint").select("event_id", "bad", "parsed.k")


@PLANS.query("filter_limit", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IS NOT NULL ORDER BY o_orderkey LIMIT 100")
def filter_limit(spark, sf):
    return scans.saved_records(load(spark, sf, "orders"), (F.col("o_orderstatus") == "F") & F.col("o_orderpriority").isNotNull(), ["o_orderkey"], 100).select("o_orderkey", "o_totalprice")


@PLANS.query("latest_by_key", "SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max_by(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F') GROUP BY o_custkey")
def latest_by_key(spark, sf):
    """The latest that has what a run must have, here a line of the first status."""
    made = load(spark, sf, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    return scans.latest_by(load(spark, sf, "orders").join(made, "o_orderkey", "left_semi"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey", "o_totalprice")


@PLANS.query("export_projection", "SELECT CASE WHEN substr(sha256('7|' || doc_id), 1, 1) < '2' THEN 'test' ELSE 'train' END AS split, 'audio/doc_' || doc_id || '.wav' AS audio, text FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def export_projection(spark, sf):
    split = F.when(F.substring(numbers.sha(F.lit(7), "doc_id"), 1, 1) < "2", "test").otherwise("train")
    saved = docs(spark, sf).join(load(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return saved.select(split.alias("split"), F.format_string("audio/doc_%d.wav", "doc_id").alias("audio"), "text")


@PLANS.query("flatten_row_values", "SELECT d.doc_id, CASE toxic WHEN 1 THEN 'YES' WHEN 0 THEN 'NO' ELSE '' END AS toxic, coalesce(CAST(quality AS VARCHAR), '') AS quality, array_to_string([lang, source], '; ') AS tags FROM documents d LEFT JOIN labels l USING (doc_id)")
def flatten_row_values(spark, sf):
    both = docs(spark, sf).select("doc_id", "lang", "source").join(load(spark, sf, "labels"), "doc_id", "left")
    yes_no = F.when(F.col("toxic") == 1, "YES").when(F.col("toxic") == 0, "NO").otherwise("")
    return both.select("doc_id", yes_no.alias("toxic"), F.coalesce(F.col("quality").cast("string"), F.lit("")).alias("quality"), F.array_join(F.array("lang", "source"), "; ").alias("tags"))


@PLANS.query("format_ids", "SELECT doc_id, printf('street_%03d_%s', doc_id, lang) AS record_id, 'audio/' || printf('street_%03d_%s', doc_id, lang) || '.wav' AS path FROM documents")
def format_ids(spark, sf):
    rid = F.format_string("street_%03d_%s", "doc_id", "lang")
    return docs(spark, sf).select("doc_id", rid.alias("record_id"), F.concat(F.lit("audio/"), rid, F.lit(".wav")).alias("path"))


WEIGHTS = "(VALUES (0.0), (1.5), (5.0), (10.0))"


@PLANS.query("config_labels", f"SELECT DISTINCT event_type || CASE WHEN w = 0 THEN '' ELSE '@w' || CASE WHEN w = floor(w) THEN CAST(CAST(w AS BIGINT) AS VARCHAR) ELSE CAST(CAST(w AS DOUBLE) AS VARCHAR) END END AS label, replace(event_type, '_', ' ') AS display FROM events CROSS JOIN {WEIGHTS} t(w)")
def config_labels(spark, sf):
    kinds = load(spark, sf, "events").select("event_type").distinct()
    both = kinds.withColumn("w", F.explode(F.array(*map(F.lit, (0.0, 1.5, 5.0, 10.0)))))
    label = F.when(F.col("w") == 0, F.col("event_type")).otherwise(F.concat("event_type", F.lit("@w"), numbers.general_format(F.col("w"))))
    return both.select(label.alias("label"), F.regexp_replace("event_type", "_", " ").alias("display"))


@PLANS.query("config_projection", f"SELECT DISTINCT event_type || CASE WHEN w = 0 THEN '' ELSE '@w' || CASE WHEN w = floor(w) THEN CAST(CAST(w AS BIGINT) AS VARCHAR) ELSE CAST(CAST(w AS DOUBLE) AS VARCHAR) END END AS label, event_type AS kind, CASE WHEN w <> 0 THEN CAST(w AS DOUBLE) END AS weight, CASE WHEN event_type = 'view' THEN (SELECT count(*) FROM benchmark) ELSE 0 END AS hotword_count FROM events CROSS JOIN {WEIGHTS} t(w)")
def config_projection(spark, sf):
    """Configurations of a run; only the canonical kind, here "view", says how many hotwords it has."""
    kinds, hotwords = load(spark, sf, "events").select("event_type").distinct(), load(spark, sf, "benchmark").count()
    both = kinds.withColumn("w", F.explode(F.array(*map(F.lit, (0.0, 1.5, 5.0, 10.0)))))
    label = F.when(F.col("w") == 0, F.col("event_type")).otherwise(F.concat("event_type", F.lit("@w"), numbers.general_format(F.col("w"))))
    return both.select(label.alias("label"), F.col("event_type").alias("kind"), F.when(F.col("w") != 0, F.col("w")).alias("weight"), F.when(F.col("event_type") == "view", F.lit(hotwords)).otherwise(F.lit(0)).cast("long").alias("hotword_count"))


@PLANS.query("mode_names", "SELECT DISTINCT event_type, coalesce(t, 0) AS threads, CASE WHEN event_type = 'view' THEN 'sequential_default' WHEN t IS NULL THEN event_type || '_default' ELSE event_type || '_threads_' || t END AS mode, CASE WHEN event_type = 'view' THEN 'sequential' ELSE event_type || '/' || coalesce(CAST(t AS VARCHAR), 'default') END AS subdir FROM events CROSS JOIN (VALUES (NULL), (1), (4)) v(t)")
def mode_names(spark, sf):
    kinds = load(spark, sf, "events").select("event_type").distinct().withColumn("threads", F.explode(F.array(F.lit(None).cast("int"), F.lit(1), F.lit(4))))
    kind, threads = F.col("event_type"), F.col("threads")
    mode = F.when(kind == "view", "sequential_default").when(threads.isNull(), F.concat(kind, F.lit("_default"))).otherwise(F.concat(kind, F.lit("_threads_"), threads.cast("string")))
    return kinds.select("event_type", F.coalesce("threads", F.lit(0)).alias("threads"), mode.alias("mode"), F.when(kind == "view", "sequential").otherwise(F.concat(kind, F.lit("/"), F.coalesce(threads.cast("string"), F.lit("default")))).alias("subdir"))


@PLANS.query("nest_phrase_record", "SELECT conv_id, CAST(count(*) AS BIGINT) AS n_configs, CAST(count(*) FILTER (WHERE role = 'assistant') AS BIGINT) AS n_assistant, arg_min(text, turn) AS first_text, coalesce(max(length(text)) FILTER (WHERE role = 'system'), -1) AS system_length FROM conversations GROUP BY conv_id")
def nest_phrase_record(spark, sf):
    """A conversation as one nested record, read through its map and array."""
    records = nested_records(load(spark, sf, "conversations"))
    system = F.filter("configs", lambda c: c.kind == "system")
    first = F.element_at("decoded", F.element_at("configs", 1).label)
    return records.select("conv_id", F.size("configs").cast("long").alias("n_configs"), F.size(F.filter("configs", lambda c: c.kind == "assistant")).cast("long").alias("n_assistant"), first.alias("first_text"), F.coalesce(F.array_max(F.transform(system, lambda c: F.length(F.element_at(F.col("decoded"), c.label)).cast("long"))), F.lit(-1).cast("long")).alias("system_length"))


def nested_records(turns: DataFrame) -> DataFrame:
    """(conv_id, configs: ordered labels and kinds, decoded: label to text)."""
    label = F.format_string("%06d", "turn")
    rows = turns.select("conv_id", F.struct(label.alias("label"), F.col("role").alias("kind"), "text").alias("row")).groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    return rows.select("conv_id", F.transform("rows", lambda r: F.struct(r.label.alias("label"), r.kind.alias("kind"))).alias("configs"), F.map_from_entries(F.transform("rows", lambda r: F.struct(r.label, r.text))).alias("decoded"))


@PLANS.query("unnest_phrase_record", "SELECT conv_id, turn, role AS kind, text FROM conversations")
def unnest_phrase_record(spark, sf):
    flat = nested_records(load(spark, sf, "conversations")).select("conv_id", "decoded", F.explode("configs").alias("c"))
    return flat.select("conv_id", F.col("c.label").cast("bigint").alias("turn"), "c.kind", F.element_at("decoded", F.col("c.label")).alias("text"))


@PLANS.query("file_row_metrics", "SELECT l_orderkey, l_linenumber, round(l_extendedprice + l_discount + l_tax, 6) AS total, CASE WHEN l_quantity > 0 THEN round((l_extendedprice + l_discount + l_tax) / l_quantity, 8) END AS rtf, l_returnflag = 'R' AS verdict FROM lineitem")
def file_row_metrics(spark, sf):
    total = F.col("l_extendedprice") + F.col("l_discount") + F.col("l_tax")
    rtf = F.when(F.col("l_quantity") > 0, F.round(total / F.col("l_quantity"), 8))
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(total, 6).alias("total"), rtf.alias("rtf"), (F.col("l_returnflag") == "R").alias("verdict"))


def words_sql(n: str) -> str:
    """Cardinal words of a number below a million, in SQL."""

    def group(k: str, units: list[str]) -> str:
        pick = lambda words, at: f"list_extract({words}, CAST({at} AS INTEGER))"
        teen = f"{k} % 100 BETWEEN 10 AND 19"
        return f"{pick(numbers.HUNDREDS, f'{k} // 100')}, CASE WHEN {teen} THEN {pick(numbers.TEENS, f'{k} % 100 - 9')} ELSE {pick(numbers.TENS, f'greatest({k} % 100 // 10 - 1, 0)')} END, CASE WHEN NOT {teen} THEN {pick(units, f'{k} % 10')} END"

    high, low = f"({n} // 1000)", f"({n} % 1000)"
    noun = f"CASE WHEN {high} = 0 THEN NULL WHEN {high} % 100 BETWEEN 11 AND 14 THEN 'тысяч' WHEN {high} % 10 = 1 THEN 'тысяча' WHEN {high} % 10 BETWEEN 2 AND 4 THEN 'тысячи' ELSE 'тысяч' END"
    return f"CASE WHEN {n} = 0 THEN 'ноль' ELSE concat_ws(' ', {group(high, numbers.UNITS_FEMININE)}, {noun}, {group(low, numbers.UNITS)}) END"


#: Names of streets from suppliers: what kind of name one is comes from its region.
STREETS = """SELECT s_suppkey, CASE n_regionkey WHEN 0 THEN n_name || 'ая улица' WHEN 1 THEN n_name || 'яя улица' WHEN 2 THEN 'Улица ' || n_name || ' 65' WHEN 3 THEN 'Переулок ' || n_name ELSE n_name END AS street, n_regionkey AS kind, lower(n_name) AS n
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""


@PLANS.query(
    "declension_rules",
    f"""SELECT s_suppkey, street, CASE kind WHEN 0 THEN n || 'ой улице' WHEN 1 THEN n || 'ей улице' WHEN 2 THEN 'улице ' || n || ' шестьдесят пять' WHEN 3 THEN 'переулке ' || n END AS pre,
CASE kind WHEN 0 THEN n || 'ую улицу' WHEN 1 THEN n || 'юю улицу' WHEN 2 THEN 'улицу ' || n || ' шестьдесят пять' WHEN 3 THEN 'переулок ' || n END AS acc,
CASE kind WHEN 0 THEN n || 'ой улицы' WHEN 1 THEN n || 'ей улицы' WHEN 2 THEN 'улицы ' || n || ' шестьдесят пять' WHEN 3 THEN 'переулка ' || n END AS gen
FROM (SELECT s_suppkey, street, CASE WHEN kind < 2 AND contains(n, ' ') THEN 4 ELSE kind END AS kind, n FROM ({STREETS}))""",
)
def declension_rules(spark, sf):
    """An adjective of more than one word follows no paradigm."""
    both = load(spark, sf, "supplier").join(load(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    kind, name = F.col("n_regionkey"), F.col("n_name")
    street = F.when(kind == 0, F.concat(name, F.lit("ая улица"))).when(kind == 1, F.concat(name, F.lit("яя улица"))).when(kind == 2, F.concat(F.lit("Улица "), name, F.lit(" 65"))).when(kind == 3, F.concat(F.lit("Переулок "), name)).otherwise(name)
    named = both.select("s_suppkey", street.alias("street")).withColumn("f", tx.declension(F.col("street")))
    return named.select("s_suppkey", "street", "f.pre", "f.acc", "f.gen")


@PLANS.query("number_to_words", f"SELECT DISTINCT n, {words_sql('n')} AS words FROM (SELECT o_orderkey % 1000000 AS n FROM orders UNION ALL SELECT CAST(floor(o_totalprice) AS BIGINT) % 1000000 FROM orders)")
def number_to_words(spark, sf):
    """The last six digits of the keys and of the whole prices of orders as words."""
    orders = load(spark, sf, "orders")
    n = orders.select((F.col("o_orderkey") % 1_000_000).alias("n")).unionAll(orders.select(F.floor("o_totalprice") % 1_000_000)).distinct()
    return n.select("n", numbers.number_to_words(F.col("n")).alias("words"))


@PLANS.query("digits_to_words", f"SELECT s_suppkey, 'дом ' || {words_sql('s_suppkey')} || ' корпус ' || {words_sql('s_nationkey')} AS reference FROM supplier")
def digits_to_words(spark, sf):
    """References with the numbers of suppliers and nations in digits."""
    raw = F.format_string("Дом %d, корпус %d!", "s_suppkey", F.col("s_nationkey").cast("long"))
    return load(spark, sf, "supplier").select("s_suppkey", numbers.normalize_reference(raw).alias("reference"))


@PLANS.query("template_accept", r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents), k AS (SELECT DISTINCT array_to_string(regexp_extract_all(lower(text), '\p{L}+'), ' ') AS skeleton FROM benchmark) SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, rtrim(line, '.!?') AS template FROM l WHERE len(regexp_extract_all(line, '\S+')) BETWEEN 3 AND 18 AND length(line) <= 180 AND regexp_matches(line, '^[\p{L} ,]+[.!?]?$') AND array_to_string(regexp_extract_all(lower(line), '\p{L}+'), ' ') NOT IN (SELECT skeleton FROM k)")
def template_accept(spark, sf):
    """Lines within bounds that match the grammar and are no known skeleton."""
    known = load(spark, sf, "benchmark").select(tx.normalize("text", tx.ANY_LETTER).alias("skeleton")).distinct()
    words = F.regexp_count("line", F.lit(r"\S+"))
    good = words.between(3, 18) & (F.length("line") <= 180) & F.rlike("line", F.lit(r"^[\p{L} ,]+[.!?]?$"))
    lines = scans.lines_of(docs(spark, sf), "doc_id", "text").where(good).withColumn("skeleton", tx.normalize("line", tx.ANY_LETTER))
    return lines.join(known, "skeleton", "left_anti").select("doc_id", "line_no", F.expr("rtrim('.!?', line)").alias("template"))

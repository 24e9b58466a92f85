"""The corpus planner's operators."""

from pyspark.sql import functions as F

from quern.functions import numbers
from quern.operators import planning
from quern.plans.declare import Plans
from quern.tables import load

PLANS = Plans()
BANK = [("train", "to {name}", 0), ("train", "please drive me to {name}", 1), ("train", "we wait at {name}", 2), ("test", "the pick up is at {name}", 3)]
PREFIXES, TAILS = ["", "hello", "good day"], ["", "please", "two of us", "now"]
MOST_WORDS = 9
BANK_SQL = "(VALUES " + ", ".join(f"('{s}', '{t}', {i})" for s, t, i in BANK) + ") b(split, template, idx)"
LIST_SQL = lambda name, values: f"(VALUES {', '.join(repr((v,)).replace(',)', ')') for v in values)}) {name[0]}({name})"
CANDIDATES = f"""SELECT n_nationkey, n_name, split, idx, template, prefix, tail, concat_ws(', ', nullif(prefix, ''), replace(template, '{{name}}', lower(n_name)), nullif(tail, '')) AS text
FROM nation CROSS JOIN {BANK_SQL} CROSS JOIN {LIST_SQL('prefix', PREFIXES)} CROSS JOIN {LIST_SQL('tail', TAILS)}
WHERE (len(string_split(template, ' ')) > 2 OR (prefix = '' AND tail = '')) AND NOT (contains(template, 'please') AND tail = 'please') AND NOT (contains(template, 'we ') AND tail = 'two of us')"""
FILTERED = f"SELECT * FROM ({CANDIDATES}) WHERE len(string_split(text, ' ')) <= {MOST_WORDS}"


def plan_rows(spark, sf):
    names = load(spark, sf, "nation").select("n_nationkey", "n_name", F.lower("n_name").alias("name"))
    bank = spark.createDataFrame(BANK, "split string, template string, idx int")
    barred = (F.contains("template", F.lit("please")) & (F.col("tail") == "please")) | (F.contains("template", F.lit("we ")) & (F.col("tail") == "two of us"))
    return planning.candidates(names, bank, PREFIXES, TAILS, MOST_WORDS, barred)


@PLANS.query("plan_candidates", f"SELECT n_nationkey, split, split || ':' || idx AS family, text FROM ({FILTERED})")
def plan_candidates(spark, sf):
    return plan_rows(spark, sf).select("n_nationkey", "split", F.concat("split", F.lit(":"), F.col("idx").cast("string")).alias("family"), "text")


#: Rows of a split, from which size on short texts go first, and how many of a split the special source has at most.
QUOTAS, SHORT_FROM, SPECIAL_SHARE = {"train": 8, "test": 3}, 8, 0.10


@PLANS.query(
    "plan_select",
    f"""WITH c AS (SELECT *, sha256('17|' || n_nationkey || '|' || text) AS h, idx = 2 AS special, CASE split WHEN 'train' THEN 8 ELSE 3 END AS quota FROM ({FILTERED})),
o AS (SELECT *, greatest(1, CAST(floor(quota * 0.1) AS INTEGER)) AS cap, CASE WHEN special THEN 0 WHEN quota >= 8 AND prefix = '' AND tail = '' AND len(string_split(template, ' ')) <= 2 THEN 1 ELSE 2 END AS turn FROM c),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY n_nationkey, split, turn, h, text) AS first FROM o) WHERE first = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY n_nationkey, split, special ORDER BY turn, h, text) AS s FROM u),
r AS (SELECT *, row_number() OVER (PARTITION BY n_nationkey, split ORDER BY turn, h, text) AS rank FROM k WHERE NOT special OR s <= cap)
SELECT n_nationkey, split, CAST(rank AS INTEGER) AS rank, text FROM r WHERE rank <= quota""",
)
def plan_select(spark, sf):
    """The special source first, as far as its share goes, then short texts where the quota is large, then the rest in hashed order."""
    quota = F.when(F.col("split") == "train", QUOTAS["train"]).otherwise(QUOTAS["test"])
    special, short = F.col("idx") == 2, (F.col("prefix") == "") & (F.col("tail") == "") & (F.size(F.split("template", " ")) <= 2)
    rows = plan_rows(spark, sf).withColumn("h", numbers.sha(F.lit(17), "n_nationkey", "text")).withColumn("turn", F.when(special, 0).when((quota >= SHORT_FROM) & short, 1).otherwise(2))
    cap = F.greatest(F.lit(1), F.floor(quota * SPECIAL_SHARE))
    return planning.select_quota(rows, ["n_nationkey", "split"], quota, ["turn", "h", "text"], special, cap).select("n_nationkey", "split", "rank", "text")


#: Rows of a brand, and how many small parts among them.
BRAND_QUOTA, SMALL_CAP = 7, 2
SERIAL = f"""WITH RECURSIVE c AS (SELECT dense_rank() OVER (ORDER BY p_brand) AS g, p_brand, p_type || ' ' || p_size AS text, p_size <= 10 AS special, sha256('23|' || p_partkey) AS h FROM part),
d AS (SELECT g, p_brand, text, special, min(h) AS h FROM c GROUP BY ALL),
e AS MATERIALIZED (SELECT * FROM d WHERE NOT special OR NOT EXISTS (SELECT 1 FROM d o WHERE o.g = d.g AND o.text = d.text AND NOT o.special AND o.h < d.h)),
s(g, used, picked) AS (
 SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[])
 UNION ALL SELECT g + 1, used || new, new FROM (
  SELECT g, any_value(used) AS used, coalesce(list(text ORDER BY rank) FILTER (rank <= {BRAND_QUOTA} AND text IS NOT NULL), CAST([] AS VARCHAR[])) AS new FROM (
   SELECT *, row_number() OVER (ORDER BY h) AS rank FROM (
    SELECT *, max(special) OVER (PARTITION BY text) AS has FROM (
     SELECT s.g, s.used, e.text, coalesce(e.special, false) AS special, e.h, row_number() OVER (PARTITION BY e.special ORDER BY e.h) AS k FROM s LEFT JOIN e ON e.g = s.g + 1 AND NOT list_contains(s.used, e.text) WHERE s.g < (SELECT max(g) FROM e)
    ) WHERE NOT special OR k <= {SMALL_CAP}
   ) WHERE special OR NOT has
  ) GROUP BY g))
, taken AS (SELECT p_brand, unnest(range(1, len(picked) + 1)) AS rank, unnest(picked) AS text FROM s JOIN (SELECT DISTINCT g, p_brand FROM e) USING (g))"""


def brand_rows(spark, sf):
    parts = load(spark, sf, "part")
    rows = parts.select("p_brand", F.concat_ws(" ", "p_type", "p_size").alias("text"), (F.col("p_size") <= 10).alias("special"), numbers.sha(F.lit(23), "p_partkey").alias("h"))
    return planning.select_quota(rows, ["p_brand"], F.lit(BRAND_QUOTA), ["h"], F.col("special"), F.lit(SMALL_CAP))


@PLANS.query("plan_serial", f"{SERIAL} SELECT p_brand, CAST(rank AS INTEGER) AS rank, text FROM taken")
def plan_serial(spark, sf):
    """Types and sizes of parts for each brand, none twice: brands want the same ones, and the later get what is left."""
    return brand_rows(spark, sf).select("p_brand", "rank", "text")


@PLANS.query("plan_unmet", f"{SERIAL} SELECT p_brand, CAST(count(rank) AS BIGINT) AS found, {BRAND_QUOTA} AS quota FROM (SELECT DISTINCT p_brand FROM part) LEFT JOIN taken USING (p_brand) GROUP BY p_brand HAVING count(rank) <> {BRAND_QUOTA}")
def plan_unmet(spark, sf):
    return planning.unmet(brand_rows(spark, sf), load(spark, sf, "part"), ["p_brand"], F.lit(BRAND_QUOTA))


@PLANS.query("round_robin_assign", "WITH s AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS turn FROM supplier) SELECT s_suppkey, CAST(turn AS INTEGER) AS turn, list_extract(['v1', 'v2', 'v3', 'v4', 'v5'], CAST((s_nationkey + turn - 1) % 5 + 1 AS INTEGER)) AS voice FROM s")
def round_robin_assign(spark, sf):
    return planning.round_robin(load(spark, sf, "supplier"), F.col("s_nationkey"), "s_nationkey", "s_suppkey", ["v1", "v2", "v3", "v4", "v5"]).select("s_suppkey", "turn", "voice")


HASHED = "SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('5|' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents"
SPLIT_SQL = f"SELECT doc_id, lang, CASE WHEN n < 2 THEN 'train' WHEN r <= greatest(1, round_even(n * 0.05, 0)) THEN 'test' WHEN r <= 2 * greatest(1, round_even(n * 0.05, 0)) AND n > 2 THEN 'validation' ELSE 'train' END AS split FROM ({HASHED})"


def split_rows(spark, sf):
    return planning.hash_split(load(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 5)


@PLANS.query("hash_split", SPLIT_SQL)
def hash_split(spark, sf):
    return split_rows(spark, sf).select("doc_id", "lang", "split")


@PLANS.query("split_counts", "SELECT source, CAST(count(*) AS BIGINT) AS n, CASE WHEN count(*) = 2 THEN 1 ELSE CAST(count(*) - 2 * greatest(1, round_even(count(*) * 0.05, 0)) AS BIGINT) END AS train, CASE WHEN count(*) = 2 THEN 0 ELSE CAST(greatest(1, round_even(count(*) * 0.05, 0)) AS BIGINT) END AS validation, CAST(greatest(1, round_even(count(*) * 0.05, 0)) AS BIGINT) AS test FROM documents GROUP BY source HAVING count(*) >= 2")
def split_counts(spark, sf):
    n, held, two = F.col("n"), numbers.holdout_size(F.col("n")), F.col("n") == 2
    sizes = load(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return sizes.select("source", "n", F.when(two, 1).otherwise(n - 2 * held).cast("long").alias("train"), F.when(two, 0).otherwise(held).cast("long").alias("validation"), held.alias("test"))


@PLANS.query("split_quota_check", f"WITH s AS ({SPLIT_SQL}), f AS (SELECT lang, split, count(*) AS n FROM s GROUP BY lang, split), t AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), e AS (SELECT lang, x AS split, CASE x WHEN 'train' THEN n - 2 * greatest(1, round_even(n * 0.05, 0)) ELSE greatest(1, round_even(n * 0.05, 0)) END AS n FROM t CROSS JOIN (VALUES ('train'), ('validation'), ('test')) v(x)) SELECT coalesce(f.lang, e.lang) AS lang, coalesce(f.split, e.split) AS split, CAST(coalesce(f.n, 0) AS BIGINT) AS found, CAST(coalesce(e.n, 0) AS BIGINT) AS expected, coalesce(f.n, 0) = coalesce(e.n, 0) AS ok FROM f FULL JOIN e ON f.lang = e.lang AND f.split = e.split")
def split_quota_check(spark, sf):
    found = split_rows(spark, sf).groupBy("lang", "split").agg(F.count(F.lit(1)).alias("found"))
    held = numbers.holdout_size(F.col("n"))
    sizes = load(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("split", F.explode(F.array(*map(F.lit, ("train", "validation", "test")))))
    expected = sizes.select("lang", "split", F.when(F.col("split") == "train", F.col("n") - 2 * held).otherwise(held).cast("long").alias("expected"))
    both = found.join(expected, ["lang", "split"], "full_outer").fillna(0, ["found", "expected"])
    return both.select("lang", "split", "found", "expected", (F.col("found") == F.col("expected")).alias("ok"))


@PLANS.query("deterministic_ids", "SELECT doc_id, substr(h, 1, 24) AS id, CAST(('0x' || substr(h, 1, 8)) AS BIGINT) AS seed, round(CAST(('0x' || substr(h, 1, 13)) AS BIGINT) / 4503599627370496.0, 9) AS draw FROM (SELECT doc_id, sha256('fp|' || doc_id || '|' || lang || '|' || source) AS h FROM documents)")
def deterministic_ids(spark, sf):
    h = F.col("h")
    d = load(spark, sf, "documents").select("doc_id", numbers.sha(F.lit("fp"), "doc_id", "lang", "source").alias("h"))
    return d.select("doc_id", F.substring("h", 1, 24).alias("id"), numbers.hex_number(h, 1, 8).alias("seed"), F.round(numbers.hash_uniform(h), 9).alias("draw"))


#: Digests that are joined to one on the next level.
LEAF = 1024


@PLANS.query(
    "fingerprint",
    f"""WITH r AS (SELECT o_orderkey AS k, sha256(o_orderkey || '|' || o_custkey || '|' || o_orderstatus) AS d FROM orders),
a AS (SELECT k // {LEAF} AS k, count(*) AS n, sha256(string_agg(d, ',' ORDER BY k)) AS d FROM r GROUP BY 1), b AS (SELECT k // {LEAF} AS k, sum(n) AS n, sha256(string_agg(d, ',' ORDER BY k)) AS d FROM a GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(d, ',' ORDER BY k)) AS fingerprint FROM b""",
)
def fingerprint(spark, sf):
    """A digest of all orders: a tree over ranges of their keys, so that no task joins more than the digests of a range."""
    rows = load(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), numbers.sha("o_orderkey", "o_custkey", "o_orderstatus").alias("d"))
    return numbers.tree_digest(rows, LEAF)


@PLANS.query("canonical_digest", """SELECT doc_id, sha256('{"doc_id": ' || doc_id || ', "lang": ' || coalesce(CAST(to_json(lang) AS VARCHAR), 'null') || ', "source": ' || coalesce(CAST(to_json(source) AS VARCHAR), 'null') || '}') AS digest FROM documents""")
def canonical_digest(spark, sf):
    return load(spark, sf, "documents").select("doc_id", numbers.canonical_digest(["doc_id", "lang", "source"]).alias("digest"))


PROFILES = {"clean": 0.25, "normal": 0.5, "noisy": 0.25}


@PLANS.query("weighted_draw", "WITH u AS (SELECT doc_id, CAST(('0x' || substr(sha256('draw|' || doc_id), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u FROM documents) SELECT doc_id, CASE WHEN u < 0.25 THEN 'clean' WHEN u < 0.75 THEN 'normal' ELSE 'noisy' END AS profile FROM u")
def weighted_draw(spark, sf):
    u = numbers.hash_uniform(numbers.sha(F.lit("draw"), "doc_id"))
    return load(spark, sf, "documents").select("doc_id", numbers.weighted_draw(u, PROFILES).alias("profile"))


#: The seed, the voices, the speeds and the shares that configurations per name are made of.
BASE_SEED, VOICES = 20260918, ["kseniya", "xenia", "aidar", "baya", "eugene"]
SPEED_LO, SPEED_STEP, SPEED_WIDTH, SPEED_HI = 0.95, 0.015, 0.08, 1.10
CLEAN, NORMAL, SHARE_STEP, QUIET_SHARE = 0.20, 0.45, 0.01, 0.75


@PLANS.query(
    "per_key_config",
    f"""WITH h AS (SELECT n_name, sha256('{BASE_SEED}:' || n_name) AS h FROM nation), b AS (SELECT n_name, CAST(CAST(('0x' || substr(h, 1, 16)) AS UBIGINT) AS VARCHAR) AS seed, CAST(('0x' || substr(h, 17, 2)) AS INTEGER) % 5 AS turn, {SPEED_LO} + (CAST(('0x' || substr(h, 19, 2)) AS INTEGER) % 6) * {SPEED_STEP} AS lo, {CLEAN} + (CAST(('0x' || substr(h, 21, 2)) AS INTEGER) % 11) * {SHARE_STEP} AS c, {NORMAL} + (CAST(('0x' || substr(h, 23, 2)) AS INTEGER) % 11) * {SHARE_STEP} AS m FROM h)
SELECT n_name, seed, array_to_string(list_slice({VOICES}, turn + 1, 5) || list_slice({VOICES}, 1, turn), ';') AS voices, round(CAST(lo AS DOUBLE), 3) AS speed_lo, round(least(CAST(lo AS DOUBLE) + {SPEED_WIDTH}, {SPEED_HI}), 3) AS speed_hi, round(c / (c + m) * {QUIET_SHARE}, 4) AS clean, round(m / (c + m) * {QUIET_SHARE}, 4) AS normal, round(1.0 - c / (c + m) * {QUIET_SHARE} - m / (c + m) * {QUIET_SHARE}, 4) AS noisy FROM b""",
)
def per_key_config(spark, sf):
    """The same name always has the same seed, order of voices, speeds and shares."""
    byte = lambda k: numbers.hex_number(F.col("h"), 2 * k + 1, 2)
    turn = (byte(8) % len(VOICES)).cast("int")
    voices = F.array(*map(F.lit, VOICES))
    rotated = F.concat(F.slice(voices, turn + 1, F.lit(len(VOICES))), F.slice(voices, F.lit(1), turn))
    lo, clean, normal = F.lit(SPEED_LO) + (byte(9) % 6) * SPEED_STEP, F.lit(CLEAN) + (byte(10) % 11) * SHARE_STEP, F.lit(NORMAL) + (byte(11) % 11) * SHARE_STEP
    share = lambda x: x / (clean + normal) * QUIET_SHARE
    rows = load(spark, sf, "nation").select("n_name", F.sha2(F.concat(F.lit(f"{BASE_SEED}:"), "n_name"), 256).alias("h"))
    return rows.select(
        "n_name", F.conv(F.substring("h", 1, 16), 16, 10).alias("seed"), F.array_join(rotated, ";").alias("voices"), F.round(lo, 3).alias("speed_lo"), F.round(F.least(lo + SPEED_WIDTH, F.lit(SPEED_HI)), 3).alias("speed_hi"),
        F.round(share(clean), 4).alias("clean"), F.round(share(normal), 4).alias("normal"), F.round(1.0 - share(clean) - share(normal), 4).alias("noisy"),
    )


@PLANS.query("cross_plan", "SELECT printf('street_%03d_%s', n_nationkey, v) AS id, n_name, v AS variant, CASE WHEN v = 'full' THEN n_name END AS reference_raw FROM nation CROSS JOIN (VALUES ('full'), ('short'), ('natural')) t(v)")
def cross_plan(spark, sf):
    wide = load(spark, sf, "nation").withColumn("variant", F.explode(F.array(*map(F.lit, ("full", "short", "natural")))))
    return wide.select(F.format_string("street_%03d_%s", "n_nationkey", "variant").alias("id"), "n_name", "variant", F.when(F.col("variant") == "full", F.col("n_name")).alias("reference_raw"))


@PLANS.query("union_dedupe_plan", "WITH p AS (SELECT 'full' AS kind, l_linenumber AS w, 0 AS part FROM lineitem UNION ALL SELECT 'name', l_linenumber, 1 FROM lineitem WHERE l_linenumber < 4 UNION ALL SELECT 'full', l_linenumber, 2 FROM lineitem WHERE l_linenumber > 2) SELECT kind, w, CAST(min(part) AS INTEGER) AS first_part FROM p GROUP BY kind, w")
def union_dedupe_plan(spark, sf):
    w = load(spark, sf, "lineitem").select(F.col("l_linenumber").alias("w"))
    part = lambda kind, rows, k: rows.select(F.lit(kind).alias("kind"), "w", F.lit(k).alias("part"))
    plan = part("full", w, 0).unionByName(part("name", w.where("w < 4"), 1)).unionByName(part("full", w.where("w > 2"), 2))
    return plan.groupBy("kind", "w").agg(F.min("part").alias("first_part"))

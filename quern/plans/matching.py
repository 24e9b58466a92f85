"""Dictionaries and their detection."""

from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators import matching
from quern.plans.declare import Plans
from quern.plans.texts import NORM, docs
from quern.tables import load

PLANS = Plans()
FORMS = f"(SELECT item_id, {NORM} AS form FROM benchmark)"
SHORT = f"(SELECT item_id, array_to_string(list_slice(regexp_extract_all(lower(text), '\\p{{L}}+'), 1, 2), ' ') AS form FROM benchmark)"
TEXTS = f"(SELECT doc_id, {NORM} AS norm FROM documents)"
IN = "f.form <> '' AND contains(' ' || d.norm || ' ', ' ' || f.form || ' ')"


def forms(spark, sf, tokens: int | None = None):
    words = tx.tokens("text", tx.ANY_LETTER)
    form = F.array_join(F.slice(words, 1, tokens) if tokens else words, " ")
    return load(spark, sf, "benchmark").select(F.col("item_id").alias("form_id"), form.alias("form"))


def texts(spark, sf):
    """Every document's tokens, and its normal form where it is asked for."""
    tokens = tx.tokens("text", tx.ANY_LETTER)
    return docs(spark, sf).select(F.col("doc_id").alias("id"), tokens.alias("words"), F.array_join(tokens, " ").alias("norm"))


@PLANS.query("dict_detect", f"SELECT d.doc_id, f.item_id FROM {TEXTS} d JOIN {FORMS} f ON {IN}")
def dict_detect(spark, sf):
    return matching.detect(texts(spark, sf), forms(spark, sf)).select(F.col("id").alias("doc_id"), F.col("form_id").alias("item_id"))


@PLANS.query("dict_build", f"SELECT form AS surface, CAST(len(string_split(form, ' ')) AS INTEGER) AS n_tokens, CAST(count(DISTINCT item_id) AS BIGINT) AS n_items, min(item_id) AS first_item FROM (SELECT * FROM {FORMS} UNION ALL SELECT * FROM {SHORT}) GROUP BY form")
def dict_build(spark, sf):
    both = forms(spark, sf).unionAll(forms(spark, sf, 2))
    return both.groupBy(F.col("form").alias("surface")).agg(F.count_distinct("form_id").alias("n_items"), F.min("form_id").alias("first_item")).select("surface", F.size(F.split("surface", " ")).alias("n_tokens"), "n_items", "first_item")


@PLANS.query("dict_validation", f"WITH f AS (SELECT * FROM {SHORT}), c AS (SELECT form, min(item_id) AS first, count(*) AS n FROM f GROUP BY form) SELECT item_id, form, CASE WHEN length(replace(form, ' ', '')) < 6 THEN 'short' WHEN n > 1 AND item_id <> first THEN 'duplicate' WHEN n > 1 THEN 'clash' END AS problem FROM f JOIN c USING (form) WHERE length(replace(form, ' ', '')) < 6 OR n > 1")
def dict_validation(spark, sf):
    f = forms(spark, sf, 2)
    counts = f.groupBy("form").agg(F.min("form_id").alias("first"), F.count(F.lit(1)).alias("n"))
    letters = F.length(F.replace(F.col("form"), F.lit(" "), F.lit("")))
    problem = F.when(letters < 6, "short").when((F.col("n") > 1) & (F.col("form_id") != F.col("first")), "duplicate").when(F.col("n") > 1, "clash")
    return f.join(counts, "form").select(F.col("form_id").alias("item_id"), "form", problem.alias("problem")).where("problem IS NOT NULL")


#: Forms of nations made from suppliers: what is wrong with one comes from the balance.
BOOK = """SELECT s_suppkey AS ord, CASE WHEN s_acctbal < -500 THEN 'ATLANTIS' ELSE n_name END AS street, CASE WHEN s_acctbal < 1000 THEN left(n_name, 3) WHEN s_acctbal < 3000 THEN s_name WHEN s_acctbal < 4000 THEN '12' WHEN s_acctbal < 6000 THEN 'Brazil' ELSE n_name || ' City' END AS form FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
LETTERS = "array_to_string(regexp_extract_all(lower({0}), '\\p{{L}}+'), ' ')"


def book(spark, sf):
    n, low = load(spark, sf, "nation"), F.col("s_acctbal")
    both = load(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    form = F.when(low < 1000, F.left("n_name", F.lit(3))).when(low < 3000, F.col("s_name")).when(low < 4000, "12").when(low < 6000, "Brazil").otherwise(F.concat("n_name", F.lit(" City")))
    forms = both.select(F.col("s_suppkey").alias("ord"), F.when(low < -500, "ATLANTIS").otherwise(F.col("n_name")).alias("street"), form.alias("form"))
    return forms.withColumn("norm", tx.normalize("form", tx.ANY_LETTER)), n.select(F.col("n_name").alias("street"), tx.normalize("n_name", tx.ANY_LETTER).alias("norm"))


@PLANS.query(
    "dictionary_problems",
    f"""WITH b AS (SELECT *, {LETTERS.format('form')} AS norm, street IN (SELECT n_name FROM nation) AS known FROM ({BOOK})), n AS (SELECT n_name, {LETTERS.format('n_name')} AS norm FROM nation), f AS (SELECT norm, min(ord) AS first FROM b WHERE known AND norm <> '' GROUP BY norm)
SELECT DISTINCT ord, street, form, unnest(list_filter([CASE WHEN NOT known THEN 'unknown street' END, CASE WHEN known AND NOT regexp_full_match(form, '[A-Za-z -]+') THEN 'invalid characters' END, CASE WHEN known AND b.norm = '' THEN 'empty form' END, CASE WHEN known AND b.norm <> '' AND length(replace(b.norm, ' ', '')) < 4 THEN 'too short' END, CASE WHEN known AND b.norm <> '' AND n_name <> street THEN 'name of another' END, CASE WHEN known AND b.norm <> '' AND first < ord THEN 'duplicate form' END], lambda x: x IS NOT NULL)) AS problem FROM b LEFT JOIN n ON n.norm = b.norm LEFT JOIN f ON f.norm = b.norm""",
)
def dictionary_problems(spark, sf):
    forms, names = book(spark, sf)
    return matching.dictionary_problems(forms, names, "^[A-Za-z -]+$")


@PLANS.query("exclusion_problems", f"WITH b AS ({BOOK}), e AS (SELECT CASE n_regionkey WHEN 0 THEN 'OLD ' || n_name ELSE n_name END AS street FROM nation WHERE n_regionkey <= 1) SELECT street, 'unknown exclusion' AS problem FROM e WHERE street NOT IN (SELECT n_name FROM nation) UNION ALL SELECT street, 'in both sections' FROM e WHERE street IN (SELECT street FROM b)")
def exclusion_problems(spark, sf):
    forms, names = book(spark, sf)
    excluded = load(spark, sf, "nation").where("n_regionkey <= 1").select(F.when(F.col("n_regionkey") == 0, F.concat(F.lit("OLD "), "n_name")).otherwise(F.col("n_name")).alias("street"))
    return matching.exclusion_problems(excluded, forms, names)


@PLANS.query("hotword_assembly", f"WITH a AS (SELECT form, 2 * item_id AS ord FROM {FORMS} UNION ALL SELECT form, 2 * item_id + 1 FROM {SHORT}) SELECT form AS hotword, min(ord) AS ord FROM a WHERE form <> '' GROUP BY form")
def hotword_assembly(spark, sf):
    both = forms(spark, sf).select("form", (2 * F.col("form_id")).alias("ord")).unionAll(forms(spark, sf, 2).select("form", (2 * F.col("form_id") + 1).alias("ord")))
    return both.where("form <> ''").groupBy(F.col("form").alias("hotword")).agg(F.min("ord").alias("ord"))


NAMES = "(SELECT n_nationkey AS ord, lower(n_name) AS form FROM nation)"


@PLANS.query("structure_variants", f"WITH p AS (SELECT 'full' AS structure, CAST(ord AS BIGINT) AS ord, form AS hotword FROM {NAMES} UNION ALL SELECT 'name_only', ord, trim(replace(' ' || form || ' ', ' united ', ' ')) FROM {NAMES} UNION ALL SELECT 'components', ord * 1000 + k - 1, list_extract(string_split(form, ' '), CAST(k AS INTEGER)) FROM (SELECT ord, form, unnest(range(1, len(string_split(form, ' ')) + 1)) AS k FROM {NAMES}) x), q AS (SELECT * FROM p UNION ALL SELECT 'full_plus_components', CASE structure WHEN 'full' THEN ord ELSE ord + 1000000000 END, hotword FROM p WHERE structure IN ('full', 'components')) SELECT structure, hotword, min(ord) AS ord FROM q WHERE hotword <> '' GROUP BY structure, hotword")
def structure_variants(spark, sf):
    names = load(spark, sf, "nation").select(F.col("n_nationkey").alias("ord"), F.lower("n_name").alias("form"))
    return matching.structures(names, ["united"])


@PLANS.query("dict_longest_match", f"WITH f AS (SELECT * FROM {FORMS} UNION ALL SELECT * FROM {SHORT}), h AS (SELECT d.doc_id, f.item_id, length(f.form) AS n FROM {TEXTS} d JOIN f ON {IN}), b AS (SELECT h.doc_id, min(item_id) AS a, max(item_id) AS z FROM h JOIN (SELECT doc_id, max(n) AS n FROM h GROUP BY doc_id) m USING (doc_id, n) GROUP BY h.doc_id) SELECT doc_id, coalesce(CASE WHEN a = z THEN a END, -1) AS street, coalesce(a <> z, false) AS ambiguous FROM documents LEFT JOIN b USING (doc_id)")
def dict_longest_match(spark, sf):
    whole = forms(spark, sf).withColumn("street", F.col("form_id"))
    short = forms(spark, sf, 2).withColumn("street", F.col("form_id")).withColumn("form_id", -1 - F.col("form_id"))
    found = matching.longest_match(texts(spark, sf), whole.unionAll(short))
    return found.select(F.col("id").alias("doc_id"), F.coalesce("street", F.lit(-1).cast("long")).alias("street"), "ambiguous")


@PLANS.query("partial_candidates", f"WITH w AS (SELECT item_id, form, string_split(form, ' ') AS t FROM {FORMS}), k AS (SELECT item_id, form, list_filter(t, lambda x: length(x) = list_max(list_transform(t, lambda y: length(y))))[1] AS word FROM w), u AS (SELECT DISTINCT doc_id, norm, unnest(string_split(norm, ' ')) AS word FROM {TEXTS}) SELECT d.doc_id, f.item_id FROM u d JOIN k f ON d.word = f.word WHERE length(f.word) >= 4 AND NOT ({IN})")
def partial_candidates(spark, sf):
    return matching.partial_candidates(texts(spark, sf), forms(spark, sf)).select(F.col("id").alias("doc_id"), F.col("form_id").alias("item_id"))


MATCH = "least(length({a}), length({b})) > 0 AND left({a}, greatest(least(length({a}), length({b}), 3), least(length({a}), length({b})) - 2)) = left({b}, greatest(least(length({a}), length({b}), 3), least(length({a}), length({b})) - 2))"


@PLANS.query("tolerant_match", "WITH w AS (SELECT DISTINCT lower(unnest(string_split(p_type, ' '))) AS word FROM part), v AS (SELECT word, left(word, length(word) - 2) || 'ic' AS mangled FROM w WHERE length(word) > 2) SELECT a.word, b.mangled FROM w a JOIN v b ON " + MATCH.format(a="a.word", b="b.mangled"))
def tolerant_match(spark, sf):
    """Words that differ in their endings only; candidates share their first three letters, or the shorter word is no longer."""
    words = load(spark, sf, "part").select(F.explode(F.split(F.lower("p_type"), " ")).alias("word")).distinct()
    mangled = words.where(F.length("word") > 2).select(F.concat(F.left("word", F.length("word") - 2), F.lit("ic")).alias("mangled"))
    a = words.withColumn("key", F.explode(tx.stem_keys(F.col("word"), False)))
    b = mangled.withColumn("key", F.explode(tx.stem_keys(F.col("mangled"), True)))
    return a.join(b, "key").where(tx.tokens_match(F.col("word"), F.col("mangled"))).select("word", "mangled")


PLACES = "(SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN lower(n_name) WHEN 1 THEN 'the ' || lower(n_name) WHEN 2 THEN left(lower(n_name), length(n_name) - 1) || 'x' ELSE 'nowhere' END AS norm FROM nation)"


@PLANS.query(
    "resolve_entity",
    f"""WITH i AS (SELECT id, norm, trim(replace(' ' || norm || ' ', ' the ', ' ')) AS core FROM {PLACES}), n AS (SELECT n_name AS street, lower(n_name) AS form FROM nation),
h AS (SELECT id, street, 1 AS tier FROM i JOIN n ON norm = form UNION ALL SELECT id, street, 2 FROM i JOIN n ON core = form UNION ALL
 SELECT id, street, 3 FROM i JOIN n ON len(string_split(core, ' ')) = len(string_split(form, ' ')) AND len(list_filter(list_zip(string_split(core, ' '), string_split(form, ' ')), lambda p: NOT ({MATCH.format(a='p[1]', b='p[2]')}))) = 0),
t AS (SELECT id, tier, min(street) AS street FROM h GROUP BY id, tier HAVING count(DISTINCT street) = 1), b AS (SELECT id, min(tier) AS tier FROM t GROUP BY id)
SELECT i.id, t.street, CAST(coalesce(t.tier, 0) AS INTEGER) AS tier FROM i LEFT JOIN b USING (id) LEFT JOIN t ON t.id = b.id AND t.tier = b.tier""",
)
def resolve_entity(spark, sf):
    nation = load(spark, sf, "nation")
    low, k = F.lower("n_name"), F.col("n_nationkey") % 4
    norm = F.when(k == 0, low).when(k == 1, F.concat(F.lit("the "), low)).when(k == 2, F.concat(F.left(low, F.length(low) - 1), F.lit("x"))).otherwise("nowhere")
    found = matching.resolve(nation.select(F.col("n_nationkey").alias("id"), norm.alias("norm")), nation.select(F.col("n_name").alias("street"), low.alias("form")), ["the"])
    return found.select("id", "street", F.coalesce("tier", F.lit(0)).alias("tier"))

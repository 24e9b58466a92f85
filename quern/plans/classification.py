"""Decoder configurations against their baseline.

The texts under test derive from `documents`: the baseline is the first 60 % of
a document's tokens; `full`, `tail` and `same` stand for configurations.
"""

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quern.functions import text as tx
from quern.operators import classify, matching
from quern.plans.declare import Plans
from quern.plans.matching import MATCH, forms
from quern.plans.matching import texts as matching_texts
from quern.plans.texts import docs
from quern.tables import load

PLANS = Plans()
TOKENS = r"regexp_extract_all(lower(text), '\p{L}+')"
BASE = f"""items AS (SELECT item_id, array_to_string({TOKENS}, ' ') AS form FROM benchmark),
d AS (SELECT doc_id, {TOKENS} AS t FROM documents), k AS (SELECT doc_id, t, len(t) AS n, array_to_string(t, ' ') AS norm FROM d),
det AS (SELECT doc_id, min(item_id) AS item FROM k JOIN items ON contains(' ' || norm || ' ', ' ' || form || ' ') GROUP BY doc_id),
x AS (SELECT k.*, coalesce(item, doc_id % (SELECT count(*) FROM benchmark)) AS item_id FROM k LEFT JOIN det USING (doc_id)),
c AS (SELECT doc_id, x.item_id, form, array_to_string(list_slice(t, 1, CAST(floor(n * 0.6) AS INTEGER)), ' ') AS base, cfg,
 CASE cfg WHEN 'full' THEN norm WHEN 'tail' THEN array_to_string(list_slice(t, CAST(floor(n / 2) AS INTEGER) + 1, n), ' ') ELSE array_to_string(list_slice(t, 1, CAST(floor(n * 0.6) AS INTEGER)), ' ') END AS txt
 FROM x JOIN items USING (item_id) CROSS JOIN (VALUES ('full'), ('tail'), ('same')) v(cfg)),
r AS (SELECT *, txt <> base AS changed, contains(' ' || base || ' ', ' ' || form || ' ') AS before, contains(' ' || txt || ' ', ' ' || form || ' ') AS after FROM c),
verdicts AS (SELECT *, CASE WHEN NOT changed THEN 'UNCHANGED' WHEN NOT before AND after THEN 'HELPED' WHEN before AND NOT after THEN 'HARMED' WHEN before AND after THEN 'EXPECTED_KEPT' ELSE 'NEITHER' END AS verdict FROM r)"""
FOUND = """hit AS (SELECT v.doc_id, cfg, i.item_id FROM verdicts v JOIN items i ON contains(' ' || txt || ' ', ' ' || i.form || ' ')),
sets AS (SELECT v.doc_id, v.cfg, list(h.item_id ORDER BY h.item_id) FILTER (WHERE h.item_id IS NOT NULL) AS found FROM verdicts v LEFT JOIN hit h ON h.doc_id = v.doc_id AND h.cfg = v.cfg GROUP BY v.doc_id, v.cfg),
compared AS (SELECT v.*, coalesce(a.found, []) AS found, coalesce(b.found, []) AS base_found FROM verdicts v JOIN sets a ON a.doc_id = v.doc_id AND a.cfg = v.cfg JOIN sets b ON b.doc_id = v.doc_id AND b.cfg = 'same'),
moves AS (SELECT doc_id, cfg, CASE WHEN NOT changed THEN 'UNCHANGED' WHEN len(added) > 0 AND len(base_found) = 0 THEN 'STREET_INTRODUCED' WHEN len(removed) > 0 AND len(found) = 0 THEN 'STREET_LOST'
 WHEN len(added) > 0 AND len(removed) > 0 THEN 'STREET_REPLACED' WHEN len(added) > 0 THEN 'STREET_EXTENDED' WHEN len(removed) > 0 THEN 'STREET_NARROWED' WHEN len(base_found) > 0 AND len(found) > 0 THEN 'SAME_STREET_KEPT' ELSE 'NO_STREET_CHANGED' END AS move,
 verdict, item_id, found, base_found, changed, before, after FROM (SELECT *, list_filter(found, lambda z: NOT list_contains(base_found, z)) AS added, list_filter(base_found, lambda z: NOT list_contains(found, z)) AS removed FROM compared))"""


def facts(spark, sf):
    """Per document the numbers of its tokens, of the baseline's and of those before the tail, lengths of the texts, and which differ from the baseline."""
    t, n = F.col("t"), F.size("t")
    d = docs(spark, sf).select("doc_id", tx.tokens("text", tx.ANY_LETTER).alias("t"))
    full, base = F.array_join(t, " "), F.array_join(F.slice(t, F.lit(1), F.floor(n * 0.6).cast("int")), " ")
    tail = F.array_join(F.slice(t, F.floor(n / 2).cast("int") + 1, n - F.floor(n / 2).cast("int")), " ")
    cfg = lambda name, text: F.struct(F.lit(name).alias("cfg"), F.length(text).alias("length"), (text != base).alias("changed"))
    return d.select("doc_id", F.array(cfg("full", full), cfg("tail", tail), cfg("same", base)).alias("cfgs"), (tail != full).alias("tail_apart"))


def hits(spark, sf, tolerant: bool = False):
    """(doc_id, hits): of each item found in a document whether it stands in the baseline and in the tail, and, but for tolerant hits, whether the baseline or the greedy text (each second token) knows a word of it."""
    if tolerant:
        found = matching.tolerant_positions(matching_texts(spark, sf), forms(spark, sf)).withColumn("known", F.lit(None).cast("boolean"))
    else:
        # made once for each text
        said = F.concat(F.slice("words", F.lit(1), F.floor(F.size("words") * 0.6).cast("int")), F.filter("words", lambda w, i: i % 2 == 0))
        found = matching.positions(matching_texts(spark, sf).withColumn("said", said), forms(spark, sf), n=lambda words, form: F.size(words), known=lambda words, form: F.arrays_overlap(form, F.col("said")))
    one = found.groupBy("id", "form_id").agg(F.max(F.col("pos") + F.col("size") <= F.floor(F.col("n") * 0.6)).alias("base"), F.max(F.col("pos") >= F.floor(F.col("n") / 2)).alias("tail"), F.max("known").alias("known"))
    return one.groupBy(F.col("id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("form_id", "base", "tail", "known"))).alias("hits"))


def verdicts(spark, sf, tolerant: bool = False):
    """A row for each document and configuration with what is found in it and in the baseline.

    Texts are read where items are found; what is joined are the hits, which
    tell for each configuration what stands in it.
    """
    none = F.array().cast("array<struct<form_id:bigint,base:boolean,tail:boolean,known:boolean>>")
    total = load(spark, sf, "benchmark").count()
    exact = hits(spark, sf)
    d = facts(spark, sf).join(exact, "doc_id", "left").withColumn("hits", F.coalesce("hits", none))
    d = d.withColumn("item_id", F.coalesce(F.try_element_at("hits", F.lit(1)).form_id, F.col("doc_id") % total))
    d = d.join(forms(spark, sf).select(F.col("form_id").alias("item_id")), "item_id")
    if tolerant:
        d = d.drop("hits").join(hits(spark, sf, True), "doc_id", "left").withColumn("hits", F.coalesce("hits", none))
    d = d.withColumn("evaluated", F.exists("hits", lambda h: h.form_id == F.col("item_id")))
    # exploding the numbers, not the array: a condition on an exploded array would be pushed into the scan and make its texts anew
    c = d.select("doc_id", "item_id", "hits", "tail_apart", "evaluated", "cfgs", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("k"))
    c = c.withColumn("c", F.element_at("cfgs", F.col("k"))).select("doc_id", "item_id", "hits", "tail_apart", "evaluated", "c.*")
    in_base, in_tail = F.filter("hits", lambda h: h.base), F.filter("hits", lambda h: h.tail)
    here = F.when(F.col("cfg") == "full", F.col("hits")).when(F.col("cfg") == "tail", in_tail).otherwise(in_base)
    c = c.withColumn("here", here).withColumn("base_found", F.transform(in_base, lambda h: h.form_id)).drop("hits")
    c = c.withColumn("found", F.transform("here", lambda h: h.form_id)).withColumn("before", F.array_contains("base_found", F.col("item_id"))).withColumn("after", F.array_contains("found", F.col("item_id")))
    unsupported = F.filter("here", lambda h: (h.form_id != F.col("item_id")) & ~h.known)
    c = c.withColumn("unsupported", F.transform(unsupported, lambda h: h.form_id)).drop("here")
    return c.withColumn("verdict", classify.change_class(F.col("changed"), F.col("before"), F.col("after")))


def moves(spark, sf):
    return verdicts(spark, sf).withColumn("move", classify.transition_class(F.col("changed"), F.col("base_found"), F.col("found")))


def partials(spark, sf):
    """(doc_id, words): of each item whose longest token stands in a document whether it does in the baseline and in the tail."""
    keyed = forms(spark, sf).select("form_id", tx.longest_token(F.split("form", " ")).alias("word")).where(F.length("word") >= 4)
    words = docs(spark, sf).select("doc_id", tx.tokens("text", tx.ANY_LETTER).alias("t"))
    at = words.select("doc_id", F.size("t").alias("n"), F.posexplode("t").alias("pos", "word")).join(keyed, "word")
    one = at.groupBy("doc_id", "form_id").agg(F.max(F.col("pos") < F.floor(F.col("n") * 0.6)).alias("base"), F.max(F.col("pos") >= F.floor(F.col("n") / 2)).alias("tail"))
    return one.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("form_id", "base", "tail"))).alias("words"))


@PLANS.query("classify_change", f"WITH {BASE} SELECT doc_id, item_id, cfg, verdict FROM verdicts")
def classify_change(spark, sf):
    return verdicts(spark, sf).select("doc_id", "item_id", "cfg", "verdict")


DETAIL = """tk AS (SELECT doc_id, list_slice(t, 1, CAST(floor(n * 0.6) AS INTEGER)) || list_filter(t, lambda w, i: i % 2 = 1) AS known FROM k),
lg AS (SELECT item_id, form, list_filter(string_split(form, ' '), lambda x: length(x) = list_max(list_transform(string_split(form, ' '), lambda y: length(y))))[1] AS word FROM items),
par AS (SELECT v.doc_id, v.cfg, list(l.item_id ORDER BY l.item_id) AS ids FROM verdicts v JOIN lg l ON length(l.word) >= 4 AND contains(' ' || txt || ' ', ' ' || l.word || ' ') AND NOT contains(' ' || txt || ' ', ' ' || l.form || ' ') WHERE NOT after GROUP BY v.doc_id, v.cfg),
un AS (SELECT m.doc_id, m.cfg, list(i.item_id ORDER BY i.item_id) AS ids FROM moves m JOIN tk USING (doc_id) JOIN items i ON list_contains(m.found, i.item_id) AND i.item_id <> m.item_id WHERE NOT list_has_any(string_split(i.form, ' '), tk.known) GROUP BY m.doc_id, m.cfg)"""


@PLANS.query("change_detail", f"WITH {BASE}, {FOUND}, {DETAIL} SELECT m.doc_id, m.cfg, verdict, array_to_string(list_filter(found, lambda z: z <> item_id), ';') AS others, array_to_string(list_filter(found, lambda z: NOT list_contains(base_found, z)), ';') AS added, coalesce(array_to_string(un.ids, ';'), '') AS unsupported, coalesce(array_to_string(par.ids, ';'), '') AS partials, len(found) = 0 AND par.ids IS NULL AS no_street, CAST(verdict = 'NEITHER' AS INTEGER) + CAST(un.ids IS NOT NULL AS INTEGER) + CAST(par.ids IS NOT NULL AS INTEGER) AS reasons FROM moves m LEFT JOIN un ON un.doc_id = m.doc_id AND un.cfg = m.cfg LEFT JOIN par ON par.doc_id = m.doc_id AND par.cfg = m.cfg")
def change_detail(spark, sf):
    """What a configuration introduced without support in the baseline or the greedy text, words of items that aren't there whole, and how many reasons there are to look."""
    v = verdicts(spark, sf).join(partials(spark, sf), "doc_id", "left")
    here = F.when(F.col("cfg") == "full", F.col("words")).when(F.col("cfg") == "tail", F.filter("words", lambda w: w.tail)).otherwise(F.filter("words", lambda w: w.base))
    none = F.array().cast("array<bigint>")
    v = v.withColumn("partials", F.when(F.col("after"), none).otherwise(F.array_except(F.coalesce(F.transform(here, lambda w: w.form_id), none), "found")))
    some = lambda c: (F.size(c) > 0).cast("int")
    join = lambda c: F.array_join(F.col(c) if isinstance(c, str) else c, ";")
    others = F.filter("found", lambda z: z != F.col("item_id"))
    no_street = (F.size("found") == 0) & (F.size("partials") == 0)
    return v.select("doc_id", "cfg", "verdict", join(others).alias("others"), join(F.array_except("found", "base_found")).alias("added"), join("unsupported").alias("unsupported"), join("partials").alias("partials"), no_street.alias("no_street"), ((F.col("verdict") == "NEITHER").cast("int") + some("unsupported") + some("partials")).alias("reasons"))


TOLERANT = """ft AS (SELECT item_id, form, string_split(form, ' ') AS f FROM items),
th AS (SELECT p.doc_id, ft.item_id, p.pos, len(ft.f) AS size FROM (SELECT doc_id, t, n, unnest(range(1, n + 1)) AS pos FROM k) p JOIN ft ON left(p.t[p.pos], 1) = left(ft.f[1], 1) AND p.pos + len(ft.f) - 1 <= p.n AND len(list_filter(list_zip(list_slice(p.t, p.pos, p.pos + len(ft.f) - 1), ft.f), lambda p: NOT (MATCHES))) = 0),
tc AS (SELECT v.doc_id, v.cfg, v.item_id, v.changed, k.n FROM verdicts v JOIN k USING (doc_id)),
tb AS (SELECT DISTINCT tc.doc_id, tc.cfg, th.item_id FROM tc JOIN th ON th.doc_id = tc.doc_id AND CASE cfg WHEN 'full' THEN true WHEN 'tail' THEN th.pos > floor(tc.n / 2) ELSE th.pos + size - 1 <= floor(tc.n * 0.6) END),
tf AS (SELECT tc.*, coalesce((SELECT list(item_id ORDER BY item_id) FROM tb WHERE tb.doc_id = tc.doc_id AND tb.cfg = tc.cfg), []) AS found, coalesce((SELECT list(item_id ORDER BY item_id) FROM tb WHERE tb.doc_id = tc.doc_id AND tb.cfg = 'same'), []) AS base_found FROM tc)""".replace("MATCHES", MATCH.format(a="p[1]", b="p[2]"))


@PLANS.query("classify_tolerant", f"WITH {BASE}, {TOLERANT} SELECT doc_id, cfg, CASE WHEN NOT changed OR cfg = 'same' THEN 'UNCHANGED' WHEN list_contains(base_found, item_id) AND NOT list_contains(found, item_id) THEN 'HARMED' WHEN list_contains(found, item_id) AND NOT list_contains(base_found, item_id) THEN 'HELPED' WHEN list_contains(found, item_id) THEN 'EXPECTED_KEPT' WHEN len(found) > 0 THEN 'HARMED' ELSE 'NEITHER' END AS verdict, CAST(len(list_filter(found, lambda z: NOT list_contains(base_found, z))) AS INTEGER) AS n_new FROM tf")
def classify_tolerant(spark, sf):
    """Names count in any inflection, the greedy configuration (here the baseline itself) never as changed, and a switch to another name as harm."""
    other = F.exists("found", lambda x: x != F.col("item_id"))
    verdict = classify.tolerant_class(F.col("changed"), F.col("before"), F.col("after"), other, F.col("cfg") == "same")
    return verdicts(spark, sf, tolerant=True).select("doc_id", "cfg", verdict.alias("verdict"), F.size(F.array_except("found", "base_found")).alias("n_new"))


@PLANS.query("street_transition", f"WITH {BASE}, {FOUND} SELECT doc_id, cfg, move FROM moves")
def street_transition(spark, sf):
    return moves(spark, sf).select("doc_id", "cfg", "move")


COUNT = lambda values, column: ", ".join(f"CAST(count(*) FILTER (WHERE {column} = '{v}') AS BIGINT) AS {v.lower()}" for v in values)


@PLANS.query("config_counters", f"WITH {BASE} SELECT cfg, CAST(count(*) AS BIGINT) AS n, {COUNT(classify.CLASSES, 'verdict')} FROM verdicts GROUP BY cfg")
def config_counters(spark, sf):
    return classify.counters(verdicts(spark, sf), ["cfg"], "verdict", classify.CLASSES)


MOVES = classify.TRANSITIONS


@PLANS.query("sweep_counters", f"WITH {BASE}, {FOUND} SELECT cfg, CAST(count(*) AS BIGINT) AS n, {COUNT(MOVES, 'move')} FROM moves GROUP BY cfg")
def sweep_counters(spark, sf):
    return classify.counters(moves(spark, sf), ["cfg"], "move", MOVES)


@PLANS.query("session_summary", f"WITH {BASE}, e AS (SELECT v.*, f.after AS evaluated FROM verdicts v JOIN verdicts f ON f.doc_id = v.doc_id AND f.cfg = 'full') SELECT cfg, CAST(count(*) AS BIGINT) AS tests, CAST(count(*) FILTER (WHERE evaluated) AS BIGINT) AS evaluated, CAST(count(*) FILTER (WHERE evaluated AND after) AS BIGINT) AS correct, CAST(count(*) FILTER (WHERE verdict = 'HELPED') AS BIGINT) AS helped, CAST(count(*) FILTER (WHERE verdict = 'HARMED') AS BIGINT) AS harmed, coalesce(round(count(*) FILTER (WHERE evaluated AND after) / nullif(count(*) FILTER (WHERE evaluated), 0), 4), 0.0) AS match_rate FROM e GROUP BY cfg")
def session_summary(spark, sf):
    """A test is evaluated where its item was said, that is, stands in the whole document; without one the rate is 0."""
    correct = F.col("evaluated") & F.col("after")
    v = verdicts(spark, sf).groupBy("cfg").agg(F.count(F.lit(1)).alias("tests"), F.count_if("evaluated").alias("evaluated"), F.count_if(correct).alias("correct"), F.count_if(F.col("verdict") == "HELPED").alias("helped"), F.count_if(F.col("verdict") == "HARMED").alias("harmed"))
    return v.withColumn("match_rate", F.coalesce(F.round(F.try_divide(F.col("correct").cast("double"), F.col("evaluated").cast("double")), 4), F.lit(0.0)))


@PLANS.query("example_groups", f"WITH {BASE}, o AS (SELECT cfg, verdict, doc_id, row_number() OVER (PARTITION BY cfg, verdict ORDER BY doc_id) AS place FROM verdicts WHERE verdict IN ('HELPED', 'HARMED', 'NEITHER')) SELECT cfg, verdict, CAST(place AS INTEGER) AS place, doc_id FROM o WHERE place <= 20")
def example_groups(spark, sf):
    """The report's first twenty examples of each kind."""
    place = F.row_number().over(W.partitionBy("cfg", "verdict").orderBy("doc_id"))
    v = verdicts(spark, sf).where(F.col("verdict").isin("HELPED", "HARMED", "NEITHER")).select("cfg", "verdict", "doc_id")
    return v.withColumn("place", place).where("place <= 20").select("cfg", "verdict", "place", "doc_id")


@PLANS.query("example_filters", f"WITH {BASE} SELECT doc_id, cfg, len(list_filter(string_split(form, ' '), lambda w: length(w) > 12)) = 0 AS short_form FROM verdicts WHERE changed AND NOT after AND len(list_filter(string_split(form, ' '), lambda w: length(w) > 12)) = 0")
def example_filters(spark, sf):
    short = F.forall(F.split("form", " "), lambda w: F.length(w) <= 12)
    names = forms(spark, sf).withColumnRenamed("form_id", "item_id")
    return verdicts(spark, sf).join(names, "item_id").where(F.col("changed") & ~F.col("after")).select("doc_id", "cfg", short.alias("short_form")).where("short_form")


@PLANS.query("config_pair_effect", f"WITH {BASE} SELECT a.doc_id, CASE WHEN a.after AND NOT b.after THEN 'broken' WHEN b.after AND NOT a.after THEN 'fixed' ELSE 'identical' END AS effect FROM verdicts a JOIN verdicts b USING (doc_id) WHERE a.cfg = 'full' AND b.cfg = 'tail' AND a.txt <> b.txt")
def config_pair_effect(spark, sf):
    """Both configurations of a document in one aggregation."""
    after = lambda cfg: F.bool_or(F.when(F.col("cfg") == cfg, F.col("after"))).alias(cfg)
    pairs = verdicts(spark, sf).where("tail_apart").groupBy("doc_id").agg(after("full"), after("tail"))
    effect = F.when(F.col("full") & ~F.col("tail"), "broken").when(F.col("tail") & ~F.col("full"), "fixed").otherwise("identical")
    return pairs.select("doc_id", effect.alias("effect"))


@PLANS.query(
    "pair_lists",
    f"""WITH {BASE}, p AS (SELECT a.item_id, a.doc_id, a.txt = b.txt AS identical, b.after AND NOT a.after AS fixed, a.after AND NOT b.after AS broken FROM verdicts a JOIN verdicts b USING (doc_id) WHERE a.cfg = 'same' AND b.cfg = 'full')
SELECT item_id, CAST(count(*) FILTER (WHERE identical) AS BIGINT) AS identical_text, CAST(count(*) FILTER (WHERE fixed AND NOT identical) AS BIGINT) AS fixed, CAST(count(*) FILTER (WHERE broken AND NOT identical) AS BIGINT) AS broken,
 coalesce(array_to_string(list_slice(list(doc_id ORDER BY doc_id) FILTER (WHERE fixed AND NOT identical), 1, 20), ';'), '') AS fixed_ids, coalesce(array_to_string(list_slice(list(doc_id ORDER BY doc_id) FILTER (WHERE broken AND NOT identical), 1, 20), ';'), '') AS broken_ids FROM p GROUP BY item_id""",
)
def pair_lists(spark, sf):
    """For each item what a configuration fixed and broke against the one before it, with the first twenty of each."""
    flag = lambda cfg, what: F.bool_or(F.when(F.col("cfg") == cfg, what))
    pairs = verdicts(spark, sf).groupBy("doc_id", "item_id").agg(flag("same", F.col("after")).alias("before"), flag("full", F.col("after")).alias("now"), flag("full", F.col("changed")).alias("apart"))
    pairs = pairs.select("doc_id", "item_id", (F.col("apart") & F.col("now") & ~F.col("before")).alias("fixed"), (F.col("apart") & F.col("before") & ~F.col("now")).alias("broken"), "apart")
    counts = pairs.groupBy("item_id").agg(F.count_if(~F.col("apart")).alias("identical_text"), F.count_if("fixed").alias("fixed"), F.count_if("broken").alias("broken"))
    kinds = pairs.where("fixed OR broken").select("item_id", "doc_id", F.when(F.col("fixed"), "fixed").otherwise("broken").alias("kind"))
    first = kinds.withColumn("k", F.row_number().over(W.partitionBy("item_id", "kind").orderBy("doc_id"))).where("k <= 20")
    ids = lambda kind: F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("doc_id")))), ";").alias(f"{kind}_ids")
    both = counts.join(first.groupBy("item_id").agg(ids("fixed"), ids("broken")), "item_id", "left")
    return both.select("item_id", "identical_text", "fixed", "broken", F.coalesce("fixed_ids", F.lit("")).alias("fixed_ids"), F.coalesce("broken_ids", F.lit("")).alias("broken_ids"))


@PLANS.query("topk_priority", f"WITH {BASE} SELECT doc_id, cfg, verdict, CASE verdict WHEN 'HARMED' THEN 0 WHEN 'HELPED' THEN 1 ELSE 2 END AS priority FROM verdicts WHERE changed ORDER BY priority, length(txt) DESC, doc_id, cfg LIMIT 15")
def topk_priority(spark, sf):
    priority = F.when(F.col("verdict") == "HARMED", 0).when(F.col("verdict") == "HELPED", 1).otherwise(2)
    v = verdicts(spark, sf).where("changed").withColumn("priority", priority)
    return v.orderBy("priority", F.desc("length"), "doc_id", "cfg").limit(15).select("doc_id", "cfg", "verdict", "priority")


@PLANS.query("best_config", f"WITH {BASE}, s AS (SELECT cfg, CAST(count(*) FILTER (WHERE after) AS BIGINT) AS correct, CAST(count(*) FILTER (WHERE verdict = 'HARMED') AS BIGINT) AS harmed FROM verdicts GROUP BY cfg) SELECT cfg, correct, harmed FROM s ORDER BY correct DESC, harmed, cfg LIMIT 1")
def best_config(spark, sf):
    s = verdicts(spark, sf).groupBy("cfg").agg(F.count_if("after").alias("correct"), F.count_if(F.col("verdict") == "HARMED").alias("harmed"))
    return s.orderBy(F.desc("correct"), "harmed", "cfg").limit(1).select("cfg", "correct", "harmed")

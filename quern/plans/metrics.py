"""Timing, accuracy, determinism, sessions and signals."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quern.functions import text as tx
from quern.operators import metrics
from quern.plans.declare import Plans
from quern.plans.texts import docs
from quern.streaming import speech
from quern.tables import load

PLANS = Plans()
Q = lambda x, q: f"round(quantile_cont({x}, {q}), 6)"


@PLANS.query("distribution", f"SELECT event_type, CAST(count(value) AS BIGINT) AS n, round(avg(value), 6) AS mean, {Q('value', 0.5)} AS median, {Q('value', 0.5)} AS p50, {Q('value', 0.9)} AS p90, {Q('value', 0.95)} AS p95, {Q('value', 0.99)} AS p99, round(min(value), 6) AS lo, round(max(value), 6) AS hi, round(stddev_pop(value), 6) AS std FROM events WHERE NOT isnan(value) GROUP BY event_type")
def distribution(spark, sf):
    return metrics.distribution(load(spark, sf, "events"), ["event_type"], "value")


#: Files of a mode: lines of an order, with their return flag as mode; the last status is an error. The clock runs half as long as the files compute.
FILES = "SELECT l_returnflag, CASE WHEN l_linestatus <> 'F' THEN 'failed' END AS error, l_linenumber = 1 AS exact, l_linenumber <= 2 AS found, l_quantity AS duration, l_extendedprice / 1000000 AS wav_load, l_discount AS model, l_tax AS decoder, (SELECT sum(b.l_discount + b.l_tax) / 2 FROM lineitem b WHERE b.l_returnflag = a.l_returnflag AND b.l_linestatus = 'F') AS wall FROM lineitem a"
R = lambda x: f"round({x}, 6)"
SUMMARY = f"""WITH f AS ({FILES}), o AS (SELECT *, model + decoder AS latency, CASE WHEN duration > 0 THEN round((model + decoder) / duration, 5) END AS rtf, nullif(duration, 0) AS audio FROM f WHERE error IS NULL),
c AS (SELECT l_returnflag, CAST(count(*) AS BIGINT) AS files_total, CAST(count(error) AS BIGINT) AS failed, max(wall) AS wall FROM f GROUP BY l_returnflag),
s AS (SELECT l_returnflag, count(*) AS ok, count(*) FILTER (WHERE exact) AS exact_matches, count(*) FILTER (WHERE found) AS reference_found, sum(wav_load) AS wav_load, sum(model) AS model, sum(decoder) AS decoder, avg(model) AS model_avg, avg(decoder) AS decoder_avg, count(audio) AS audio_files, sum(audio) AS audio, sum(latency) AS latency, count(latency) AS latency_n,
 {R('avg(latency)')} AS latency_mean, {Q('latency', 0.5)} AS latency_median, {Q('latency', 0.5)} AS latency_p50, {Q('latency', 0.9)} AS latency_p90, {Q('latency', 0.95)} AS latency_p95, {Q('latency', 0.99)} AS latency_p99, {R('min(latency)')} AS latency_lo, {R('max(latency)')} AS latency_hi, {R('stddev_pop(latency)')} AS latency_std,
 {R('avg(rtf)')} AS rtf_mean, {Q('rtf', 0.5)} AS rtf_p50, {Q('rtf', 0.95)} AS rtf_p95, {Q('rtf', 0.99)} AS rtf_p99, {R('min(rtf)')} AS rtf_lo, {R('max(rtf)')} AS rtf_hi FROM o GROUP BY l_returnflag)
SELECT l_returnflag, files_total, CAST(coalesce(ok, 0) AS BIGINT) AS ok, failed, CAST(coalesce(exact_matches, 0) AS BIGINT) AS exact_matches, {R('exact_matches / nullif(ok, 0)')} AS exact_accuracy, CAST(coalesce(reference_found, 0) AS BIGINT) AS reference_found, {R('reference_found / nullif(ok, 0)')} AS found_accuracy, CAST(coalesce(latency_n, 0) AS BIGINT) AS latency_n,
 latency_mean, latency_median, latency_p50, latency_p90, latency_p95, latency_p99, latency_lo, latency_hi, latency_std, rtf_mean, rtf_p50, rtf_p95, rtf_p99, rtf_lo, rtf_hi,
 {R('coalesce(wav_load, 0)')} AS wav_load_total, {R('coalesce(model, 0)')} AS acoustic, {R('coalesce(decoder, 0)')} AS decoder, {R('coalesce(model + decoder, 0)')} AS compute_total, {R('model_avg')} AS model_mean, {R('decoder_avg')} AS decoder_mean, {R('model / nullif(model + decoder, 0)')} AS acoustic_share, {R('decoder / nullif(model + decoder, 0)')} AS decoder_share,
 CAST(coalesce(audio_files, 0) AS BIGINT) AS audio_files, {R('coalesce(audio, 0)')} AS audio_total, {R('audio / nullif(audio_files, 0)')} AS audio_mean, {R('coalesce(latency, 0)')} AS total_inference, {R('wall')} AS wall_clock,
 CASE WHEN wall > 0 THEN {R('coalesce(ok, 0) / wall')} END AS throughput, CASE WHEN wall > 0 THEN {R('coalesce(audio, 0) / wall')} END AS throughput_audio, CASE WHEN audio > 0 THEN {R('wall / audio')} END AS wall_rtf FROM c LEFT JOIN s USING (l_returnflag)"""


def summary(spark, sf):
    lines = load(spark, sf, "lineitem")
    walls = lines.where("l_linestatus = 'F'").groupBy("l_returnflag").agg((F.sum(F.col("l_discount") + F.col("l_tax")) / 2).alias("wall"))
    files = lines.join(F.broadcast(walls), "l_returnflag", "left")  # a row for each mode
    line = F.col("l_linenumber")
    files = files.select("l_returnflag", F.when(F.col("l_linestatus") != "F", "failed").alias("error"), (line == 1).alias("exact"), (line <= 2).alias("found"), F.col("l_quantity").alias("duration"), (F.col("l_extendedprice") / 1000000).alias("wav_load"), F.col("l_discount").alias("model"), F.col("l_tax").alias("decoder"), "wall")
    return metrics.mode_summary(files, "l_returnflag")


@PLANS.query("mode_summary", SUMMARY)
def mode_summary(spark, sf):
    return summary(spark, sf)


VERDICT = "CASE WHEN acoustic_share IS NULL THEN 'unknown' WHEN acoustic_share >= 0.6 THEN 'acoustic_model' WHEN 1 - acoustic_share >= 0.6 THEN 'decoder_beam_search_kenlm' ELSE 'mixed' END"


@PLANS.query("bottleneck", f"SELECT l_returnflag, acoustic_share, {VERDICT} AS verdict FROM ({SUMMARY})")
def bottleneck(spark, sf):
    return metrics.bottleneck(summary(spark, sf), "acoustic_share").select("l_returnflag", "acoustic_share", "verdict")


@PLANS.query("quality_gate", "WITH g AS (SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS found_rate, bool_and(value IS NOT NULL AND value >= 0) AS passed FROM events GROUP BY event_type) SELECT *, coalesce(found_rate = (SELECT found_rate FROM g WHERE event_type = 'view'), false) AS as_baseline FROM g")
def quality_gate(spark, sf):
    """All rows must pass; whether a mode finds as much as the baseline mode."""
    good = F.col("value").isNotNull() & (F.col("value") >= 0)
    modes = load(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0)), 6).alias("found_rate"), F.bool_and(good).alias("passed"))
    base = modes.where("event_type = 'view'").agg(F.max("found_rate").alias("base"))  # one row
    return modes.join(F.broadcast(base)).select("event_type", "n", "found_rate", "passed", F.coalesce(F.col("found_rate") == F.col("base"), F.lit(False)).alias("as_baseline"))


@PLANS.query("determinism_check", "WITH m AS (SELECT user_id AS id, event_type AS mode, max(floor(value / 40)) AS hyp FROM events GROUP BY 1, 2), b AS (SELECT id, hyp FROM m WHERE mode = 'view') SELECT mode, CAST(count(*) AS BIGINT) AS compared, CAST(count(*) FILTER (WHERE m.hyp <> b.hyp) AS BIGINT) AS different, coalesce(array_to_string(list_slice(list(m.id ORDER BY m.id) FILTER (WHERE m.hyp <> b.hyp), 1, 20), ';'), '') AS first_ids FROM m JOIN b USING (id) WHERE mode <> 'view' GROUP BY mode")
def determinism_check(spark, sf):
    """Each mode against the baseline mode, user by user; the first 20 that differ are cut before the shuffle."""
    m = load(spark, sf, "events").groupBy(F.col("user_id").alias("id"), F.col("event_type").alias("mode")).agg(F.max(F.floor(F.col("value") / 40)).alias("hyp"))
    base = m.where("mode = 'view'").select("id", F.col("hyp").alias("base"))
    both = m.where("mode <> 'view'").join(base, "id").withColumn("off", F.col("hyp") != F.col("base"))
    counts = both.groupBy("mode").agg(F.count(F.lit(1)).alias("compared"), F.count_if("off").alias("different"))
    place = F.row_number().over(W.partitionBy("mode").orderBy("id"))
    first = both.where("off").select("mode", "id", place.alias("place")).where("place <= 20").groupBy("mode").agg(F.array_join(F.array_sort(F.collect_list("id")), ";").alias("first_ids"))
    return counts.join(first, "mode", "left").select("mode", "compared", "different", F.coalesce("first_ids", F.lit("")).alias("first_ids"))


@PLANS.query(
    "series_quality",
    """WITH m AS (SELECT user_id AS id, event_type AS mode, max(floor(value / 40)) AS hyp FROM events GROUP BY 1, 2), b AS (SELECT id, hyp FROM m WHERE mode = 'view'),
d AS (SELECT count(DISTINCT mode) AS compared_modes, count(DISTINCT mode) FILTER (WHERE m.hyp <> b.hyp) AS different_modes, count(*) FILTER (WHERE m.hyp <> b.hyp) AS different_files FROM m JOIN b USING (id) WHERE mode <> 'view'),
q AS (SELECT count(*) AS files, count(*) FILTER (WHERE value > 50) AS found, count(*) FILTER (WHERE floor(value) = value) AS exact FROM events WHERE event_type = 'view'),
e AS (SELECT count(*) AS expected_files, count(*) FILTER (WHERE value > 50) AS expected_found FROM events WHERE event_type = 'click')
SELECT CAST(files AS BIGINT) AS files, CAST(found AS BIGINT) AS found, round(found / nullif(files, 0), 6) AS found_accuracy, CAST(exact AS BIGINT) AS exact, round(exact / nullif(files, 0), 6) AS exact_accuracy, CAST(expected_files AS BIGINT) AS expected_files, CAST(expected_found AS BIGINT) AS expected_found,
 files = expected_files AND found = expected_found AS matches_expected, CAST(compared_modes AS BIGINT) AS compared_modes, CAST(different_modes AS BIGINT) AS different_modes, CAST(different_files AS BIGINT) AS different_files, different_files = 0 AS deterministic FROM q, e, d""",
)
def series_quality(spark, sf):
    """The quality block of a series, against what another run gave, and whether all modes decode alike."""
    events, value = load(spark, sf, "events"), F.col("value")
    mode = lambda name: F.col("event_type") == name
    quality = events.agg(
        F.count_if(mode("view")).alias("files"), F.count_if(mode("view") & (value > 50)).alias("found"), F.count_if(mode("view") & (F.floor(value) == value)).alias("exact"),
        F.count_if(mode("click")).alias("expected_files"), F.count_if(mode("click") & (value > 50)).alias("expected_found"),
    )
    said = events.groupBy(F.col("user_id").alias("id"), F.col("event_type").alias("mode")).agg(F.max(F.floor(value / 40)).alias("hyp"))
    both = said.where("mode <> 'view'").join(said.where("mode = 'view'").select("id", F.col("hyp").alias("base")), "id")
    modes = both.groupBy("mode").agg(F.count_if(F.col("hyp") != F.col("base")).alias("off"))
    alike = modes.agg(F.count(F.lit(1)).alias("compared_modes"), F.count_if(F.col("off") > 0).alias("different_modes"), F.coalesce(F.sum("off"), F.lit(0)).alias("different_files"))
    share = lambda c: F.round(F.try_divide(F.col(c).cast("double"), F.col("files").cast("double")), 6).alias(f"{c}_accuracy")
    matches = (F.col("files") == F.col("expected_files")) & (F.col("found") == F.col("expected_found"))
    return quality.join(F.broadcast(alike)).select(  # one row and one row
        "files", "found", share("found"), "exact", share("exact"), "expected_files", "expected_found", matches.alias("matches_expected"), "compared_modes", "different_modes", "different_files", (F.col("different_files") == 0).alias("deterministic")
    )


TIMES = "SELECT l_returnflag, CASE WHEN l_linenumber < 7 THEN l_linenumber END AS threads, round(avg(l_discount + l_tax), 6) AS latency FROM lineitem GROUP BY 1, 2"


@PLANS.query("best_mode", f"WITH t AS ({TIMES}) SELECT l_returnflag, min_by(threads, (latency, coalesce(threads, 0))) FILTER (WHERE threads IS NOT NULL) AS threads, min(latency) AS latency, arg_min(coalesce(threads, 0), (latency, coalesce(threads, 0))) AS fewest FROM t GROUP BY l_returnflag")
def best_mode(spark, sf):
    """The lowest mean latency; of equal ones that with fewest threads, where no number counts as 0."""
    line, many = F.col("l_linenumber"), F.coalesce("threads", F.lit(0))
    times = load(spark, sf, "lineitem").groupBy("l_returnflag", F.when(line < 7, line).alias("threads")).agg(F.round(F.avg(F.col("l_discount") + F.col("l_tax")), 6).alias("latency"))
    by = F.struct("latency", many.alias("many"))
    return times.groupBy("l_returnflag").agg(F.min_by("threads", F.when(F.col("threads").isNotNull(), by)).alias("threads"), F.min("latency").alias("latency"), F.min_by(many, by).alias("fewest"))


@PLANS.query("training_length", "SELECT event_id, value FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND value < 20")
def training_length(spark, sf):
    """What is short enough to train on."""
    return load(spark, sf, "events").where((F.col("value") < 20) & ~F.isnan("value")).select("event_id", "value")


@PLANS.query("series_summary", f"WITH s AS ({SUMMARY}), v AS (SELECT *, {VERDICT} AS verdict FROM s) SELECT CAST(count(*) AS BIGINT) AS modes, CAST(sum(ok) AS BIGINT) AS ok, CAST(sum(failed) AS BIGINT) AS failed, min_by(l_returnflag, (wall_rtf, l_returnflag)) AS fastest, max_by(l_returnflag, (throughput, l_returnflag)) AS most_throughput, string_agg(verdict, ';' ORDER BY l_returnflag) AS verdicts FROM v")
def series_summary(spark, sf):
    v = metrics.bottleneck(summary(spark, sf), "acoustic_share")
    verdicts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_returnflag", "verdict"))), lambda x: x.verdict), ";")
    return v.agg(F.count(F.lit(1)).alias("modes"), F.sum("ok").alias("ok"), F.sum("failed").alias("failed"), F.min_by("l_returnflag", F.struct("wall_rtf", "l_returnflag")).alias("fastest"), F.max_by("l_returnflag", F.struct("throughput", "l_returnflag")).alias("most_throughput"), verdicts.alias("verdicts"))


def micros(ts: str):
    """Microseconds since 1970 of a time without a zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts))


@PLANS.query("sampler_deltas", "WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0 AS t, value FROM events), r AS (SELECT user_id, event_id, t, value, (value - lag(value) OVER w) / nullif(t - lag(t) OVER w, 0) AS rate FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) SELECT user_id, CAST(count(rate) AS BIGINT) AS n, round(avg(rate), 9) AS mean_rate, round(max(rate), 9) AS peak_rate, max_by(value, (t, event_id)) AS last_value FROM r GROUP BY user_id")
def sampler_deltas(spark, sf):
    e = load(spark, sf, "events").withColumn("t", micros("ts") / 1000000.0)
    rates = metrics.deltas(e, "user_id", ["t", "event_id"], F.col("t"), "value")
    return rates.groupBy("user_id").agg(F.count("rate").alias("n"), F.round(F.avg("rate"), 9).alias("mean_rate"), F.round(F.max("rate"), 9).alias("peak_rate"), F.max_by("value", F.struct("t", "event_id")).alias("last_value"))


@PLANS.query("sessionize", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k")
def sessionize(spark, sf):
    found = metrics.sessions(load(spark, sf, "events"), "user_id", "ts", "30 minutes")
    return found.select("user_id", micros("first").alias("first_us"), micros("last").alias("last_us"), "n")


#: Components of a vector as levels of blocks of 30 ms: 3 blocks before, 4 quiet ones end it, 2 are speech at least, 24 the longest.
SPEECH = speech.Limits(threshold=0.12, preroll_ms=90, silence_ms=120, longest_ms=720, least_ms=60)
LOUD, QUIET, SIZE = "e[i + 1] >= 0.12", "CASE WHEN e[i + 1] >= 0.12 THEN 0 ELSE quiet + 1 END", "(i - first + 1)"
OVER = f"(first >= 0 AND ((({QUIET}) >= 4 AND {SIZE} - ({QUIET}) >= 2) OR {SIZE} >= 24))"


@PLANS.query("speech_segments", f"WITH RECURSIVE b AS (SELECT vec_id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS e FROM embeddings WHERE embedding IS NOT NULL), s AS (SELECT vec_id, e, 0 AS i, -1 AS first, 0 AS quiet, 0 AS free, NULL::INTEGER AS a, NULL::INTEGER AS z, NULL::INTEGER AS ms FROM b UNION ALL SELECT vec_id, e, i + 1, CASE WHEN {OVER} THEN -1 WHEN first >= 0 THEN first WHEN {LOUD} THEN greatest(free, i - 2) ELSE -1 END, CASE WHEN first >= 0 AND NOT {OVER} THEN {QUIET} ELSE 0 END, CASE WHEN {OVER} THEN i + 1 ELSE free END, CASE WHEN {OVER} THEN first END, i, ({SIZE} - ({QUIET})) * 30 FROM s WHERE i < len(e)) SELECT vec_id, CAST(a AS BIGINT) AS first_block, CAST(z AS BIGINT) AS last_block, CAST(ms AS BIGINT) AS speech_ms FROM s WHERE a IS NOT NULL")
def speech_segments(spark, sf):
    blocks = load(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("stream"), F.posexplode("embedding").alias("block", "x")).select("stream", "block", F.abs(F.col("x").cast("double")).alias("level"))
    return speech.segments(blocks, SPEECH).select(F.col("stream").cast("long").alias("vec_id"), "first_block", "last_block", "speech_ms")


@PLANS.query("array_signal_stats", "SELECT vec_id, round(list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))), 6) AS peak, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) / len(embedding)), 6) AS rms, list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) >= 0.005 AND sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) / len(embedding)) >= 0.0005 AS valid, round(list_aggregate(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))), 'quantile_cont', 0.999), 6) AS q999 FROM embeddings")
def array_signal_stats(spark, sf):
    return metrics.signal_stats(load(spark, sf, "embeddings"), "vec_id", "embedding")


@PLANS.query("array_pcm16", "SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CAST(floor(greatest(-1.0, least(1.0, CAST(x AS DOUBLE))) * 32767 + 0.5) AS INTEGER)), ',') AS samples FROM embeddings")
def array_pcm16(spark, sf):
    return load(spark, sf, "embeddings").select("vec_id", F.array_join(metrics.pcm16("embedding").cast("array<string>"), ",").alias("samples"))


def answer_pairs(spark, sf):
    """Each sentence of each document, an utterance, against itself without every seventh token."""
    said = docs(spark, sf).select("doc_id", "lang", F.posexplode(F.split("text", r"[.\n]")).alias("place", "said"))
    kept = F.filter(F.col("t"), lambda w, i: i % 7 != 6)
    rows = said.select("doc_id", "lang", "place", tx.tokens("said", tx.ANY_LETTER).alias("t")).where(F.size("t") > 0)
    return rows.select("doc_id", "lang", "place", F.array_join("t", " ").alias("reference"), F.array_join(kept, " ").alias("hypothesis"))


@PLANS.query("asr_metrics", r"WITH u AS (SELECT lang, unnest(regexp_split_to_array(text, '[.\n]')) AS said FROM documents), d AS (SELECT lang, regexp_extract_all(lower(said), '\p{L}+') AS t FROM u), k AS (SELECT lang, t, list_filter(t, lambda w, i: i % 7 <> 0) AS h FROM d WHERE len(t) > 0) SELECT lang, CAST(count(*) AS BIGINT) AS n, CAST(sum(len(t) - len(h)) AS BIGINT) AS word_edits, round(sum(len(t) - len(h)) / sum(len(t)), 6) AS wer, round(sum(length(array_to_string(t, ' ')) - length(array_to_string(h, ' '))) / sum(length(array_to_string(t, ' '))), 6) AS cer, CAST(count(*) FILTER (WHERE len(t) = len(h)) AS BIGINT) AS exact FROM k GROUP BY lang")
def asr_metrics(spark, sf):
    """The SQL knows the answer in closed form: dropping tokens costs exactly what was dropped."""
    return metrics.error_rates(answer_pairs(spark, sf), ["lang"])


SAID = r"""u AS (SELECT doc_id, lang, unnest(regexp_split_to_array(text, '[.\n]')) AS said, generate_subscripts(regexp_split_to_array(text, '[.\n]'), 1) AS place FROM documents),
d AS (SELECT doc_id, lang, place, regexp_extract_all(lower(said), '\p{L}+') AS t FROM u), k AS (SELECT doc_id, lang, place, array_to_string(t, ' ') AS ref, array_to_string(list_filter(t, lambda w, i: i % 7 <> 0), ' ') AS hyp FROM d WHERE len(t) > 0)"""
BOOK = r"""i AS (SELECT item_id, regexp_extract_all(lower(text), '\p{L}+') AS w FROM benchmark), f AS (SELECT item_id, array_to_string(w, ' ') AS form FROM i UNION SELECT item_id, array_to_string(list_slice(w, 1, 3), ' ') FROM i)"""


@PLANS.query(
    "street_metrics",
    f"""WITH {SAID}, {BOOK}, h AS (SELECT k.doc_id, k.place, f.item_id, length(form) AS n FROM k JOIN f ON contains(' ' || hyp || ' ', ' ' || form || ' ')), m AS (SELECT doc_id, place, max(n) AS n FROM h GROUP BY doc_id, place),
b AS (SELECT h.doc_id, h.place, min(item_id) AS a, max(item_id) AS z FROM h JOIN m ON h.doc_id = m.doc_id AND h.place = m.place AND h.n = m.n GROUP BY h.doc_id, h.place),
s AS (SELECT k.*, b.a, b.z, e.item_id AS expected, array_to_string(e.w, ' ') AS canonical FROM k JOIN i e ON e.item_id = k.doc_id % (SELECT count(*) FROM benchmark) LEFT JOIN b ON b.doc_id = k.doc_id AND b.place = k.place)
SELECT lang, CAST(count(*) AS BIGINT) AS samples, round(count(*) FILTER (WHERE a = z AND a = expected) / count(*), 9) AS street_accuracy, round(count(*) FILTER (WHERE contains(hyp, canonical)) / count(*), 9) AS exact_street_accuracy, round(count(*) FILTER (WHERE ref = hyp) / count(*), 9) AS exact_utterance_accuracy, CAST(count(*) FILTER (WHERE a <> z) AS BIGINT) AS ambiguous, CAST(count(*) FILTER (WHERE a IS NULL) AS BIGINT) AS no_match FROM s GROUP BY lang""",
)
def street_metrics(spark, sf):
    """Benchmark items as streets: whole and by their first three tokens; a document's utterances should name the item of its number."""
    items = load(spark, sf, "benchmark").select("item_id", tx.tokens("text", tx.ANY_LETTER).alias("w"))
    streets = items.select(F.col("item_id").alias("street"), F.array_join("w", " ").alias("canonical"))
    forms = items.select(F.col("item_id").alias("street"), F.explode(F.array_distinct(F.array(F.array_join("w", " "), F.array_join(F.slice("w", 1, 3), " ")))).alias("form"))
    said = answer_pairs(spark, sf).withColumn("id", F.concat_ws("|", "doc_id", "place")).withColumn("expected", F.col("doc_id") % items.count())
    return metrics.street_accuracy(said, forms, streets, ["lang"])


@PLANS.query("token_change_ratio")
def token_change_ratio(spark, sf):
    return answer_pairs(spark, sf).select("doc_id", "place", F.round(metrics.change_ratio("reference", "hypothesis"), 6).alias("changed"))


#: What is compared with what it was, and how much of it is left.
STRUCTURES, WEIGHTS = ("words", "stems"), (0.5, 0.7, 0.9)
SENTENCES = r"SELECT doc_id, lang, k - 1 AS place, t FROM (SELECT doc_id, lang, k, regexp_extract_all(lower(s[k]), '\p{L}+') AS t FROM (SELECT doc_id, lang, s, unnest(range(1, len(s) + 1)) AS k FROM (SELECT doc_id, lang, regexp_split_to_array(text, '[.\n]') AS s FROM documents))) WHERE len(t) > 0"
SWEEP = f"""WITH x AS ({SENTENCES}), c AS (SELECT doc_id, place, structure, weight, len(t) AS n, CAST(ceil(len(t) * weight) AS BIGINT) AS m FROM x CROSS JOIN (VALUES ('words'), ('stems')) a(structure) CROSS JOIN (VALUES (CAST(0.5 AS DOUBLE)), (0.7), (0.9)) b(weight)),
r AS (SELECT *, round(1 - 2.0 * m / (n + m), 3) AS ratio FROM c)"""


def sweep(spark, sf):
    """Each sentence of each document against its first words (or their first four letters), and the share of tokens that differ."""
    rows = answer_pairs(spark, sf).select("doc_id", "place", F.split("reference", " ").alias("t"))
    wide = rows.withColumn("structure", F.explode(F.array(*map(F.lit, STRUCTURES)))).withColumn("weight", F.explode(F.array(*map(F.lit, WEIGHTS))))
    t = F.when(F.col("structure") == "stems", F.transform("t", lambda w: F.left(w, F.lit(4)))).otherwise(F.col("t"))
    wide = wide.select("doc_id", "place", "structure", "weight", t.alias("t"))
    kept = F.slice("t", F.lit(1), F.ceil(F.size("t") * F.col("weight")).cast("int"))
    texts = wide.select("doc_id", "place", "structure", "weight", F.array_join("t", " ").alias("a"), F.array_join(kept, " ").alias("b"))
    return texts.withColumn("ratio", F.round(metrics.change_ratio("b", "a"), 3))


@PLANS.query("change_counters", f"{SWEEP} SELECT structure, weight, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE m < n) AS BIGINT) AS changed, CAST(count(*) FILTER (WHERE ratio > 0.3) AS BIGINT) AS changed_gt30pct, CAST(count(*) FILTER (WHERE m = n) AS BIGINT) AS unchanged FROM r GROUP BY structure, weight")
def change_counters(spark, sf):
    """How many are changed, and by more than 30 %, for each structure and weight. The SQL knows the ratio as what is left is the beginning of what was."""
    rows = sweep(spark, sf)
    return rows.groupBy("structure", "weight").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") != F.col("b")).alias("changed"), F.count_if(F.col("ratio") > 0.3).alias("changed_gt30pct"), F.count_if(F.col("a") == F.col("b")).alias("unchanged"))


@PLANS.query("change_examples", f"{SWEEP}, o AS (SELECT *, row_number() OVER (PARTITION BY structure, weight ORDER BY ratio DESC, doc_id, place) AS rank FROM r WHERE m < n) SELECT structure, weight, CAST(rank AS INTEGER) AS rank, doc_id, CAST(place AS INTEGER) AS place, ratio FROM o WHERE rank <= 15")
def change_examples(spark, sf):
    """The report's fifteen most changed ones of each structure and weight; cut within parts of a group first, so that no task orders a whole group."""
    order = [F.desc("ratio"), "doc_id", "place"]
    rows = sweep(spark, sf).where("a <> b").select("structure", "weight", "doc_id", "place", "ratio", F.pmod(F.xxhash64("doc_id", "place"), F.lit(256)).alias("part"))
    near = rows.withColumn("rank", F.row_number().over(W.partitionBy("structure", "weight", "part").orderBy(*order))).where("rank <= 15")
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("structure", "weight").orderBy(*order))).where("rank <= 15")
    return ranked.select("structure", "weight", "rank", "doc_id", "place", "ratio")

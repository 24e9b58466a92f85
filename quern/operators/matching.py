"""Finding dictionary forms in texts.

The dictionary is an inverted index: each form stands under its rarest token, by
counts over the corpus, and a text asks only for its tokens that are such an
anchor. All joins are on equal keys, and candidates are verified.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators.audit import violations
from quern.scratch import staged

#: An index is broadcast up to this size of its forms; beyond, it is joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: Places of a text that are looked up together.
PIECE = 64


def _bytes(forms: DataFrame, *words: str) -> int:
    """Size of the forms' tokens, with what an array takes for each."""
    size = sum((F.aggregate(w, F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x) + 16) for w in words), F.lit(64))
    return forms.agg(F.sum(size)).first()[0] or 0


def words_of(texts: DataFrame) -> DataFrame:
    """(id, words) and any further columns of texts(id, norm), or of texts(id, words) as they are; but for `norm`."""
    return texts.drop("norm") if "words" in texts.columns else texts.withColumn("words", F.split("norm", " ")).drop("norm")


def form_index(words: DataFrame, forms: DataFrame) -> DataFrame:
    """(form_id, form_words, anchor, offset) of forms(form_id, form) that can stand in a text of words(id, words): the anchor is the token that fewest words of the corpus are, the first of them. A form with a token that no text has is left out, and so is the empty one."""
    listed = forms.where("form <> ''").select("form_id", F.split("form", " ").alias("form_words")).distinct()
    tokens = staged(listed.select(F.explode("form_words").alias("word")).distinct(), "tokens")
    counts = words.select(F.explode("words").alias("word")).join(tokens, "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    each = listed.select("form_id", "form_words", F.posexplode("form_words").alias("offset", "word")).join(counts, "word", "left")
    rarest = each.groupBy("form_id", "form_words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", F.col("word").alias("anchor"))).alias("a"))
    return staged(rarest.where("a.n > 0").select("form_id", "form_words", "a.anchor", "a.offset"), "form-index")


def positions(texts: DataFrame, forms: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, **extra) -> DataFrame:
    """(id, form_id, pos, size) of forms(form_id, form) standing in texts(id, norm or words) from token `pos` on; both normalised, empty forms nowhere.

    With an index of up to broadcast_bytes a text's words never leave their task,
    and each hit is verified on the tokens beside it; beyond that words and
    anchors meet by word, and texts by id. `extra` are further columns made from
    (text's tokens, form's tokens) and columns of texts for each hit; of
    expressions that are compiled, as a text's hits are gathered before one that isn't,
    each with all tokens of the text.
    """
    words = words_of(texts)
    index = form_index(words, forms)
    if _bytes(index, "form_words") <= broadcast_bytes:
        found = words.select("*", F.posexplode("words").alias("at", "word")).join(F.broadcast(index), F.col("word") == F.col("anchor"))
    else:
        met = words.select("id", F.posexplode("words").alias("at", "word")).join(index, F.col("word") == F.col("anchor")).where(F.col("at") >= F.col("offset"))
        found = met.join(words, "id")
    pos, size = F.col("at") - F.col("offset"), F.size("form_words")
    found = found.where((pos >= 0) & (pos + size <= F.size("words"))).where(F.slice("words", pos + 1, size) == F.col("form_words"))
    return found.select("id", "form_id", pos.alias("pos"), size.alias("size"), *[make(F.col("words"), F.col("form_words")).alias(name) for name, make in extra.items()])


def tolerant_positions(texts: DataFrame, forms: DataFrame) -> DataFrame:
    """(id, form_id, pos, size, n) like positions(), by tokens_match() of token after token, so that a name is found in any inflection; n is the text's number of tokens.

    A name is looked up by its longest token, which few words of a text resemble.
    What may be a name is verified on a piece of the text around it, whose size
    depends on the longest name and not on the text.
    """
    wanted = forms.where("form <> ''").select("form_id", F.split("form", " ").alias("form_words")).withColumn("anchor", tx.longest_token(F.col("form_words")))
    wanted = wanted.withColumn("offset", (F.array_position("form_words", F.col("anchor")) - 1).cast("int"))
    least, back, ahead = wanted.agg(F.min(F.length("anchor")), F.max("offset"), F.max(F.size("form_words") - F.col("offset"))).first()
    short, back, ahead = (least or 0) < 3, back or 0, ahead or 1
    few = _bytes(wanted, "form_words") <= BROADCAST_BYTES
    wanted = wanted.select("form_id", "form_words", "anchor", "offset", F.explode(tx.stem_keys(F.col("anchor"), True)).alias("key"))
    # of PIECE places, more where names are longer, with all that a name at one of them can cover
    step = max(PIECE, back + ahead)
    first = lambda start: F.greatest(start - back, F.lit(0))
    cut = lambda start: F.struct(start.alias("start"), first(start).alias("first"), F.slice("words", first(start) + 1, F.lit(back + step + ahead)).alias("piece"))
    pieces = words_of(texts).select("id", "words", F.size("words").alias("n")).where("n > 0")
    pieces = pieces.select("id", "n", F.explode_outer(F.transform(F.sequence(F.lit(0), F.col("n") - 1, F.lit(step)), cut)).alias("p")).select("id", "n", "p.*")
    starts = pieces.select("id", "n", "start", *(["first", "piece"] if few else []), F.posexplode_outer(F.slice("piece", F.col("start") - F.col("first") + 1, F.lit(step))).alias("k", "word"))
    starts = starts.withColumn("at", F.col("start") + F.col("k")).drop("k")
    word = F.col("word")
    # without names of short words each word of a text has one key
    keys = F.explode(tx.stem_keys(word, False)) if short else F.when(F.length(word) >= 3, F.concat(F.lit("3"), F.left(word, F.lit(3)))).otherwise(F.concat(F.lit("a"), F.length(word).cast("string"), word))
    starts = starts.withColumn("key", keys)
    found = starts.join(F.broadcast(wanted), "key") if few else starts.join(wanted, "key")
    found = found.withColumn("pos", F.col("at") - F.col("offset")).where(tx.tokens_match(word, F.col("anchor")) & (F.col("pos") >= 0) & (F.col("pos") + F.size("form_words") <= F.col("n")))
    if not few:
        found = found.join(pieces.drop("n"), ["id", "start"])
    # the first and last word tell most; the others are exploded, so that only what passes is copied, and only as far as the name goes
    ends = [tx.tokens_match(F.get("piece", F.col("pos") - F.col("first") + k), F.get("form_words", k)) for k in (F.lit(0), F.size("form_words") - 1)]
    found = found.where(ends[0] & ends[1])
    beside = F.explode_outer(F.array(F.slice("piece", F.col("pos") - F.col("first") + 1, F.size("form_words"))))
    found = found.select("id", "form_id", "pos", "form_words", "n", beside.alias("beside"))
    found = found.where(F.forall(F.zip_with("beside", "form_words", tx.tokens_match), lambda x: x))
    return found.select("id", "form_id", "pos", F.size("form_words").alias("size"), "n")


def detect(texts: DataFrame, forms: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, form_id): forms(form_id, form) standing contiguously in texts(id, norm or words)."""
    return positions(texts, forms, broadcast_bytes).select("id", "form_id").distinct()


def longest_match(texts: DataFrame, forms: DataFrame) -> DataFrame:
    """(id, street, ambiguous): the entity of the longest form in characters; several entities at that length are ambiguous."""
    hits = detect(texts, forms).join(forms.select("form_id", "street", F.length("form").alias("n")), "form_id")
    best = hits.groupBy("id").agg(F.max("n").alias("n")).join(hits, ["id", "n"]).groupBy("id").agg(F.min("street").alias("a"), F.max("street").alias("b"))
    both = texts.select("id").join(best, "id", "left")
    one = F.col("a") == F.col("b")
    return both.select("id", F.when(one, F.col("a")).alias("street"), F.coalesce(~one, F.lit(False)).alias("ambiguous"))


def partial_candidates(texts: DataFrame, forms: DataFrame, least: int = 4) -> DataFrame:
    """(id, form_id) where the form's longest token stands in the text but the form does not."""
    words = words_of(texts).select("id", F.explode(F.array_distinct("words")).alias("word"))
    keyed = forms.select("form_id", tx.longest_token(F.split("form", " ")).alias("word")).where(F.length("word") >= least)
    return words.join(keyed, "word").select("id", "form_id").join(detect(texts, forms), ["id", "form_id"], "left_anti").distinct()


def resolve(inputs: DataFrame, names: DataFrame, dropped: list[str]) -> DataFrame:
    """(id, street, tier) of inputs(id, norm) against names(street, form).

    Tier 1 is equality, tier 2 equality without the `dropped` words, tier 3
    tolerant matching of token after token; a tier counts when one name fits.
    """
    core = lambda c: F.filter(F.split(c, " "), lambda w: ~w.isin(dropped) & (w != ""))
    a = inputs.where("norm <> ''").withColumn("core", core("norm"))
    b = names.withColumn("name_core", core("form"))
    exact = a.join(b, F.col("norm") == F.col("form")).select("id", "street", F.lit(1).alias("tier"))
    cores = a.join(b, F.array_join("core", " ") == F.array_join("name_core", " ")).where(F.size("core") > 0).select("id", "street", F.lit(2).alias("tier"))
    # names meet under the stem of their first word
    a_keys = a.where(F.size("core") > 0).withColumn("key", F.explode(tx.stem_keys(F.element_at("core", 1), False)))
    b_keys = b.where(F.size("name_core") > 0).withColumn("key", F.explode(tx.stem_keys(F.element_at("name_core", 1), True)))
    near = a_keys.join(b_keys, "key").where(F.size("core") == F.size("name_core"))
    stems = near.where(F.forall(F.zip_with("core", "name_core", tx.tokens_match), lambda x: x)).select("id", "street", F.lit(3).alias("tier"))
    hits = exact.unionAll(cores).unionAll(stems).groupBy("id", "tier").agg(F.min("street").alias("street"), F.count_distinct("street").alias("n"))
    best = hits.where("n = 1").groupBy("id").agg(F.min(F.struct("tier", "street")).alias("best"))
    return inputs.select("id").join(best, "id", "left").select("id", "best.street", "best.tier")


def dictionary_problems(forms: DataFrame, names: DataFrame, valid: str, least: int = 4) -> DataFrame:
    """(ord, street, form, problem) of forms(ord, street, form, norm) against names(street, norm).

    Of a form of an unknown street nothing else is said, nor of one without a
    letter but its characters; later copies of a form are duplicates of the first.
    """
    known = forms.join(names.select("street", F.lit(True).alias("known")), "street", "left")
    owners = names.select(F.col("norm").alias("_n"), F.col("street").alias("owner"))
    first = forms.join(names.select("street"), "street", "left_semi").where("norm <> ''").groupBy(F.col("norm").alias("_f")).agg(F.min("ord").alias("first"))
    both = known.join(owners, F.col("norm") == F.col("_n"), "left").join(first, F.col("norm") == F.col("_f"), "left")
    there, empty = F.col("known").isNotNull(), F.col("norm") == ""
    rules = [
        ("unknown street", ~there),
        ("invalid characters", there & ~F.rlike("form", F.lit(valid))),
        ("empty form", there & empty),
        ("too short", there & ~empty & (F.length(F.replace(F.col("norm"), F.lit(" "), F.lit(""))) < least)),
        ("name of another", there & ~empty & F.col("owner").isNotNull() & (F.col("owner") != F.col("street"))),
        ("duplicate form", there & ~empty & (F.col("first") < F.col("ord"))),
    ]
    return violations(both, ["ord", "street", "form"], rules).withColumnRenamed("rule", "problem").distinct()


def exclusion_problems(excluded: DataFrame, forms: DataFrame, names: DataFrame) -> DataFrame:
    """(street, problem) of excluded(street): unknown ones, and those that have forms after all."""
    unknown = excluded.join(names, "street", "left_anti").select("street", F.lit("unknown exclusion").alias("problem"))
    return unknown.unionAll(excluded.join(forms, "street", "left_semi").select("street", F.lit("in both sections").alias("problem")))


def structures(names: DataFrame, type_words: list[str]) -> DataFrame:
    """(structure, ord, hotword): whole names, names without type words, single tokens, and all; first occurrence wins."""
    words = F.split("form", " ")
    bare = F.array_join(F.filter(words, lambda w: ~w.isin(type_words)), " ")
    full = names.select(F.lit("full").alias("structure"), F.col("ord").cast("long").alias("ord"), F.col("form").alias("hotword"))
    name = names.select(F.lit("name_only").alias("structure"), F.col("ord").cast("long").alias("ord"), bare.alias("hotword"))
    parts = names.select(F.lit("components").alias("structure"), "ord", F.posexplode(words).alias("k", "hotword")).select("structure", (F.col("ord") * 1000 + F.col("k")).alias("ord"), "hotword")
    both = full.unionAll(parts.withColumn("ord", F.col("ord") + 10**9)).withColumn("structure", F.lit("full_plus_components"))
    return full.unionAll(name).unionAll(parts).unionAll(both).where("hotword <> ''").groupBy("structure", "hotword").agg(F.min("ord").alias("ord"))

"""Numerals as words, hash arithmetic, formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import NUMERALS, RUSSIAN, normalize

#: Russian cardinal words.
UNITS = "один два три четыре пять шесть семь восемь девять".split()
UNITS_FEMININE = ["одна", "две", *UNITS[2:]]
TEENS = "десять одиннадцать двенадцать тринадцать четырнадцать пятнадцать шестнадцать семнадцать восемнадцать девятнадцать".split()
TENS = "двадцать тридцать сорок пятьдесят шестьдесят семьдесят восемьдесят девяносто".split()
HUNDREDS = "сто двести триста четыреста пятьсот шестьсот семьсот восемьсот девятьсот".split()
LARGEST = 999_999


def _pick(words: list[str], index: Column) -> Column:
    """words[index - 1], null outside."""
    return F.when(index.between(1, len(words)), F.element_at(F.array(*map(F.lit, words)), F.greatest(index, F.lit(1)).cast("int")))


def _below_thousand(n: Column, feminine: bool) -> Column:
    hundreds, rest = F.floor(n / 100), n % 100
    teen = rest.between(10, 19)
    return F.array_compact(
        F.array(
            _pick(HUNDREDS, hundreds),
            F.when(teen, _pick(TEENS, rest - 9)).otherwise(_pick(TENS, F.floor(rest / 10) - 1)),
            F.when(~teen, _pick(UNITS_FEMININE if feminine else UNITS, rest % 10)),
        )
    )


def number_to_words(n: Column) -> Column:
    """Cardinal words of 0 to 999999, thousands in the feminine; beyond that an error, null for null."""
    thousands, rest = F.floor(n / 1000), n % 1000
    one, few = thousands % 10 == 1, (thousands % 10).between(2, 4)
    teens = (thousands % 100).between(11, 14)
    word = F.when(teens, "тысяч").when(one, "тысяча").when(few, "тысячи").otherwise("тысяч")
    words = F.concat(F.when(thousands > 0, F.concat(_below_thousand(thousands, True), F.array(word))).otherwise(F.array().cast("array<string>")), _below_thousand(rest, False))
    text = F.when(n == 0, "ноль").otherwise(F.array_join(words, " "))
    wrong = F.raise_error(F.concat(F.lit("number out of range: "), n.cast("string"))).cast("string")
    return F.when(n.isNull(), F.lit(None)).when(n.between(0, LARGEST), text).otherwise(wrong)


def digits_to_words(text: Column) -> Column:
    """Each run of digits as words, reviewed spellings first; an error where one is out of range."""
    reviewed = F.create_map(*[F.lit(x) for pair in NUMERALS.items() for x in pair])

    def said(part: Column) -> Column:
        n = part.try_cast("bigint")
        words = F.when(n.isNull(), F.raise_error(F.concat(F.lit("number out of range: "), part)).cast("string")).otherwise(number_to_words(n))
        return F.when(F.rlike(part, F.lit(r"^\d")), F.coalesce(F.try_element_at(reviewed, part), words)).otherwise(part)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"\d+|\D+"), F.lit(0)), said), "")


def normalize_reference(text: Column, alphabet: str = RUSSIAN) -> Column:
    return normalize(digits_to_words(text), alphabet)


def general_format(x: Column) -> Column:
    """A number without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", x.cast("double")), "0+$", ""), r"\.$", "")


def sha(*parts: Column | str) -> Column:
    """SHA-256 of the parts joined by a character that they don't hold."""
    return F.sha2(F.concat_ws("|", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]), 256)


def tree_digest(rows: DataFrame, leaf: int, levels: int = 2) -> DataFrame:
    """(n, fingerprint) of rows(k, d) with unique whole keys from 0 and digests d: `levels` times the digests of `leaf` keys in a row become one, and what is left at last."""
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "d"))), lambda r: r.d), ","), 256)
    level = rows.select("k", F.lit(1).cast("long").alias("n"), "d")
    for _ in range(levels):
        level = level.groupBy(F.floor(F.col("k") / leaf).alias("_k")).agg(F.sum("n").alias("n"), joined.alias("d")).withColumnRenamed("_k", "k")
    return level.agg(F.sum("n").alias("n"), joined.alias("fingerprint"))


def hex_number(digest: Column, start: int, length: int) -> Column:
    """A part of a hex digest as a number; length at most 15."""
    return F.conv(F.substring(digest, start, length), 16, 10).cast("bigint")


def hash_uniform(digest: Column) -> Column:
    """[0, 1) from 13 hex digits of a digest, exact in a double."""
    return hex_number(digest, 1, 13).cast("double") / float(16**13)


def holdout_size(n: Column) -> Column:
    """Rows for each of validation and test: one in twenty, at least one, rounded half to even; a group of two has none for validation."""
    return F.greatest(F.lit(1), F.bround(n * 0.05)).cast("bigint")


def canonical_json(columns: list[str]) -> Column:
    """A flat record of strings and whole numbers as JSON text with sorted keys and blanks after separators; null is null."""
    value = lambda c: F.regexp_extract(F.to_json(F.array(F.col(c)), {"ignoreNullFields": "false"}), r"(?s)^\[(.*)\]$", 1)
    return F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{c}": '), value(c)) for c in sorted(columns)]), F.lit("}"))


def canonical_digest(columns: list[str]) -> Column:
    return F.sha2(canonical_json(columns), 256)


def weighted_draw(u: Column, weights: dict[str, float]) -> Column:
    """The name that a uniform number in [0, 1) falls to, by weights in their order."""
    names, total, sum_, out = list(weights), sum(weights.values()), 0.0, None
    for name in names[:-1]:
        sum_ += weights[name]
        out = F.when(u * total < sum_, name) if out is None else out.when(u * total < sum_, name)
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])


def split_sizes(n: int) -> dict[str, int]:
    """Rows of each split of n; fewer than two can't be split."""
    if n < 2:
        raise ValueError("a split needs two rows at least")
    held = max(1, round(n * 0.05))
    return {"train": n - 2 * held, "validation": held, "test": held} if n > 2 else {"train": 1, "validation": 0, "test": 1}

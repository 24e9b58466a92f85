"""Column expressions over transcripts: normal forms, containment, tolerant matching, declension.

Everything here is a built-in expression; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that make up words; the Russian alphabet of the recogniser, or any letter.
RUSSIAN, ANY_LETTER = "а-яё", r"\p{L}"
#: Reviewed spellings of numerals in names.
NUMERALS = {"40": "сорок", "50": "пятьдесят", "60": "шестьдесят", "65": "шестьдесят пять", "70": "семьдесят"}


def tokens(text: Column | str, alphabet: str = RUSSIAN) -> Column:
    """Lower-cased runs of letters; null and empty text have none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(f"[{alphabet}]+"), 0), F.array().cast("array<string>"))


def normalize(text: Column | str, alphabet: str = RUSSIAN) -> Column:
    return F.array_join(tokens(text, alphabet), " ")


def padded(text: Column) -> Column:
    return F.concat(F.lit(" "), text, F.lit(" "))


def contains_form(text: Column, form: Column) -> Column:
    """The form's tokens stand in the text next to each other; both are normalised. The empty form is nowhere."""
    return (form != "") & F.contains(padded(text), padded(form))


def common_prefix_length(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    return F.when(n > 0, F.size(F.filter(F.sequence(F.lit(1), n), lambda i: F.left(a, i) == F.left(b, i)))).otherwise(0)


def tokens_match(a: Column, b: Column) -> Column:
    """Two words of one stem: equal in all but their last two letters, at least three, of the shorter one."""
    n = F.least(F.length(a), F.length(b))
    need = F.least(n, F.greatest(F.lit(3), n - 2))
    return (n > 0) & (F.left(a, need) == F.left(b, need))


def stem_keys(word: Column, of_name: bool) -> Column:
    """Keys under which a text's word and a name's word meet exactly once if tokens_match() may hold.

    Words of three letters and more share their first three; a shorter one is a
    beginning of the other.
    """
    n = F.length(word)
    shared = F.when(n >= 3, F.concat(F.lit("3"), F.left(word, F.lit(3))))
    keys = [shared]
    for size in (1, 2):
        begins, whole = F.concat(F.lit(f"a{size}"), F.left(word, F.lit(size))), F.concat(F.lit(f"b{size}"), F.left(word, F.lit(size)))
        keys += [F.when(n >= size, begins), F.when(n == size, whole)] if of_name else [F.when(n == size, begins), F.when(n > size, whole)]
    return F.array_compact(F.array(*keys))


def tolerant_contains(text: Column, form: Column) -> Column:
    """Like contains_form on arrays of tokens, by tokens_match; quadratic in the two lengths at worst."""
    last = F.size(text) - F.size(form)
    here = lambda i: F.forall(F.zip_with(F.slice(text, i + 1, F.size(form)), form, tokens_match), lambda x: x)
    return (F.size(form) > 0) & (last >= 0) & F.exists(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), here)


def longest_token(words: Column) -> Column:
    """The first of the longest."""
    longest = F.array_max(F.transform(words, lambda w: F.length(w)))
    return F.element_at(F.filter(words, lambda w: F.length(w) == longest), 1)


def reviewed(name: Column) -> Column:
    """expand_reviewed(), or an error where a numeral is left."""
    out = expand_reviewed(name)
    return F.when(F.rlike(out, F.lit(r"\d")), F.raise_error(F.concat(F.lit("numeral without review: "), name))).otherwise(out)


def reviewed_declension(name: Column) -> Column:
    """declension(), or an error where numerals or structure are unknown."""
    forms = declension(name)
    bad = forms.isNull() | F.rlike(forms.nom, F.lit(r"\d"))
    return F.when(bad, F.raise_error(F.concat(F.lit("name without review: "), name))).otherwise(forms)


def expand_reviewed(name: Column) -> Column:
    """Reviewed numerals as words; other numerals stay."""
    out = name
    for digits, words in NUMERALS.items():
        out = F.regexp_replace(out, rf"(?<!\d){digits}(?!\d)", words)
    return out


CASES = ("nom", "pre", "acc", "gen", "bare", "at", "to")
#: The endings of each kind of name, case after case as in CASES; $1 is what doesn't change, and a case without an entry isn't said.
PARADIGMS = {
    "^([^ ]+)ая улица$": ("$1ая улица", "$1ой улице", "$1ую улицу", "$1ой улицы", "$1ая", "$1ой", "$1ую"),
    "^([^ ]+)яя улица$": ("$1яя улица", "$1ей улице", "$1юю улицу", "$1ей улицы", "$1яя", "$1ей", "$1юю"),
    "^улица (.+)$": ("улица $1", "улице $1", "улицу $1", "улицы $1", "$1", None, None),
    "^переулок (.+)$": ("переулок $1", "переулке $1", "переулок $1", "переулка $1", None, None, None),
}


def declension(name: Column) -> Column:
    """Case forms of a name with a type word as a struct, by the first of PARADIGMS that it follows; null where it follows none."""
    s = expand_reviewed(F.lower(name))
    none = F.lit(None).cast("string")

    def forms(pattern: str, endings: tuple[str | None, ...]) -> Column:
        filled = [none if e is None else F.regexp_replace(s, pattern, e) for e in endings]
        return F.when(F.rlike(s, F.lit(pattern)), F.struct(*[x.alias(case) for x, case in zip(filled, CASES, strict=True)]))

    return F.coalesce(*[forms(*paradigm) for paradigm in PARADIGMS.items()])


def render(template: Column, forms: Column) -> Column:
    """The template with its one placeholder filled in; null where there isn't just one, or the form is missing."""
    key = F.regexp_extract(template, r"\{(\w+)\}", 1)
    value = F.coalesce(*[F.when(key == k, forms[k]) for k in CASES])
    return F.when(F.regexp_count(template, F.lit(r"\{\w+\}")) == 1, F.replace(template, F.concat(F.lit("{"), key, F.lit("}")), value))

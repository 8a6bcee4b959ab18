"""Text functions as expressions: n-grams, case, validity of labels and keys, suffix and acronym rewriting."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the ASCII punctuation characters.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words(text: Column) -> Column:
    """Parts between white space; none for blank text."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of `n` tokens, none where there are fewer."""
    last = F.size(tokens) - (n - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.slice(tokens, i, F.lit(n)))).otherwise(F.array().cast("array<array<string>>"))


def all_ngrams(tokens: Column, longest: int) -> Column:
    """Runs of 1 to `longest` tokens, shorter ones first."""
    return F.concat(*[ngrams(tokens, n) for n in range(1, longest + 1)])


def shingles(text: Column, k: int) -> Column:
    """Substrings of `k` characters. They are joined from the text's characters, as looking for a place in a long text starts at its head each time."""
    last = F.length(text) - (k - 1)
    run = lambda c, i: F.concat(*[F.get(c, i + j) for j in range(k)])
    of = lambda c: F.transform(F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0))), lambda i: run(c, i))  # noqa: E731  the characters are bound, else each run would part the text anew
    return F.when(last >= 1, F.element_at(F.transform(F.array(F.split(text, "")), of), 1)).otherwise(F.array().cast("array<string>"))


def sliding_windows(tokens: Column, size: int) -> Column:
    """Windows of `size` tokens, one after each step; a shorter list is one window."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - (size - 1), F.lit(1))), lambda i: F.slice(tokens, i, F.lit(size)))


def remove_punctuation(text: Column) -> Column:
    return F.translate(text, PUNCTUATION, "")


def remove_prefix(text: Column, prefix: str) -> Column:
    return F.when(F.startswith(text, F.lit(prefix)), F.substring(text, F.lit(len(prefix) + 1), F.length(text))).otherwise(text)


def to_text(raw: Column, encoding: str = "UTF-8") -> Column:
    """Bytes as text."""
    return F.decode(raw, encoding)


def newlines_to_spaces(text: Column) -> Column:
    """Keeps all offsets."""
    return F.translate(text, "\n", " ")


def acronyms(text: Column) -> Column:
    """Drops the dot behind a capital that isn't within a word: U.S. becomes US."""
    return F.regexp_replace(text, r"(?U)(?<!\w)([A-Z])\.", "$1")


def is_upper(text: Column) -> Column:
    """Has a letter with case and none in lower case."""
    return (F.upper(text) == text) & (F.lower(text) != text)


def is_lower(text: Column) -> Column:
    return (F.lower(text) == text) & (F.upper(text) != text)


def title_case(text: Column) -> Column:
    """Every run of letters with its first letter in upper case, the others in lower."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, F.lit(2), F.length(r))))), "")


def is_title(text: Column) -> Column:
    return (title_case(text) == text) & (F.lower(text) != text)


def first_upper(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def case_variants(text: Column) -> Column:
    """Lower, upper, title case and first letter upper, each once."""
    return F.array_distinct(F.array(F.lower(text), F.upper(text), title_case(text), first_upper(text)))


def restore_case(lemma: Column, original: Column, upper_lemma: bool = False) -> Column:
    """A lemma in the case of the word it stands for: upper words are kept (or the lemma in upper case), title words give title lemmas."""
    return F.when(is_upper(original), F.upper(lemma) if upper_lemma else original).when(is_title(original), title_case(lemma)).otherwise(lemma)


def space_apostrophes(text: Column, punctuation: bool = False) -> Column:
    """A space before both apostrophes, with `punctuation` before every ASCII punctuation character."""
    if punctuation:
        text = F.regexp_replace(text, r"(\p{Punct})", " $1")
        return F.regexp_replace(text, "’", " ’")
    return F.regexp_replace(text, "(['’])", " $1")


def turkish_suffixes(word: Column) -> Column:
    """Ablative and plural endings off words in lower case."""
    return F.when(is_lower(word), F.regexp_replace(F.regexp_replace(word, "[dt][ae]n$", ""), "l[ae]r$", "")).otherwise(word)


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(words(text), 1, n), " ")


def without_parenthesis(label: Column) -> Column:
    """The label before its first `` (``."""
    return F.substring_index(label, " (", 1)


def is_number(label: Column) -> Column:
    """A number, also with a decimal comma or percent signs behind."""
    plain = F.regexp_replace(F.translate(label, ",", "."), "%+$", "")
    return F.trim(plain).rlike(r"^[+-]?((\d+(_\d+)*)?\.?\d+(_\d+)*|\d+(_\d+)*\.)([eE][+-]?\d+)?$") | F.lower(F.trim(plain)).rlike("^[+-]?(nan|inf|infinity)$")


def valid_label(label: Column) -> Column:
    """Not empty, no parenthesis, no spaced dash, no punctuation first, and a Latin letter with something behind it after the first character."""
    shape = rf"^[^{re.escape(PUNCTUATION)}].*[a-zA-Z].+$"
    return F.coalesce((label != "") & (F.instr(label, "(") == 0) & (F.instr(label, " - ") == 0) & label.rlike(shape), F.lit(False))


def valid_key(key: Column, is_label: Column, must_have_space: Column, min_length: int = 4) -> Column:
    """A usable surface form: not empty and not digits only; of `min_length` characters, or three in upper case.

    Entities of classes whose names are ambiguous as single words (`must_have_space`) give only keys with a space; their aliases in upper case pass the first of both
    tests only, so they don't either.
    """
    spaced = F.instr(key, " ") > 0
    alias_ok = is_label | ~must_have_space | spaced | is_upper(key)
    long = (F.length(key) >= min_length) | (is_upper(key) & (F.length(key) >= 3))
    return F.coalesce((key != "") & ~key.rlike(r"^\p{N}+$") & alias_ok & (~must_have_space | spaced) & long, F.lit(False))


def translation_clean(text: Column) -> Column:
    """Of each word the part before an apostrophe; commas become spaces."""
    return F.array_join(F.transform(F.split(F.translate(text, ",", " "), " "), lambda w: F.substring_index(w, "'", 1)), " ")


def description_of(label: Column, description: Column) -> Column:
    """The label where there is no description; the label before a description that doesn't hold it."""
    return F.when(F.coalesce(description, F.lit("")) == "", label).when(F.instr(description, label) == 0, F.concat(label, F.lit(", "), description)).otherwise(description)

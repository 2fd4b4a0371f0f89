"""Text functions as Column expressions; no Python runs per row.

Character classes are spelled out so that letters and digits of every script count as word characters.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, functions as F

from .lexicon import CONTRACTIONS

WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"


def stop_words(language: str = "english") -> list[str]:
    """Spark's stop words for ``language``."""
    return list(StopWordsRemover.loadDefaultStopWords(language))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeeze(c: Column) -> Column:
    """Every run of white space becomes one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, f"[{SPACE}]+", " "))


def strip_links(c: Column) -> Column:
    return F.regexp_replace(c, f"(http|www)[^{SPACE}]+", "")


def strip_clock_times(c: Column) -> Column:
    return F.regexp_replace(c, r"\p{Nd}+:\p{Nd}+", "")


def keep_prose(c: Column) -> Column:
    """Drop all but word characters, white space and ``. , ! ?``."""
    return F.regexp_replace(c, f"[^{WORD}{SPACE}.,!?]", "")


def keep_words(c: Column) -> Column:
    return F.regexp_replace(c, f"[^{WORD}{SPACE}]", "")


def expand_contractions(c: Column, rules: Sequence[tuple[str, str]] = CONTRACTIONS) -> Column:
    """Apply the contraction rules, which never reach across a blank.

    Only words with an apostrophe or a slang form go through the rules; other words, and texts without
    any such word, are left alone.
    """

    def touched(x: Column) -> Column:
        return contains_any(x, ["'", "’", "gonna", "gotta", "wanna"])

    def expanded(word: Column) -> Column:
        for pattern, replacement in rules:
            word = F.regexp_replace(word, pattern, replacement)
        return word

    by_word = F.transform(F.split(c, " "), lambda w: F.when(touched(w), expanded(w)).otherwise(w))
    return F.when(touched(c), F.array_join(by_word, " ")).otherwise(c)


def clean_text(c: Column) -> Column:
    """Full cleaning: links go before contractions, clock times go too."""
    c = strip_links(F.lower(F.coalesce(c, F.lit(""))))
    return bind(c, lambda t: squeeze(keep_prose(strip_clock_times(expand_contractions(t)))))


def clean_for_sentiment(c: Column) -> Column:
    """Cleaning for scoring: contractions before links, clock times lose only their colon."""
    return bind(F.lower(F.coalesce(c, F.lit(""))), lambda t: squeeze(keep_prose(strip_links(expand_contractions(t)))))


def clean_for_clustering(c: Column, stops: Sequence[str] | None = None) -> Column:
    """Cleaning for themes: words only, stop words removed."""
    drop = stop_words() if stops is None else list(stops)

    def cleaned(t: Column) -> Column:
        t = F.regexp_replace(keep_words(strip_links(expand_contractions(t))), r"\bcannot\b", "can not")
        return F.filter(F.split(squeeze(t), " "), lambda w: (w != "") & ~w.isin(drop))

    return F.array_join(bind(F.lower(F.coalesce(c, F.lit(""))), cleaned), " ")


def words(c: Column, min_length: int = 1) -> Column:
    """Lower-cased words of at least ``min_length`` characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"[{WORD}]{{{min_length},}}"), F.lit(0))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"[^{SPACE}]+"))


def contains_any(c: Column, terms: Sequence[str]) -> Column:
    """True if any literal term is a substring."""
    found = F.lit(False)
    for term in terms:
        found = found | c.contains(term)
    return found


def literals_of(pattern: str) -> list[str] | None:
    """Literals of which every match of a pattern holds at least one.

    Only for patterns of plain characters, groups of plain alternatives and quantifiers; None for all others.
    """
    plain = r"[^\\\[\](){}|^$.?*+]"
    item = re.compile(rf"(?:\(((?:{plain}|\|)+)\)|({plain}))([?*+]|\{{\d+,?\d*\}})?")
    at, run, found = 0, "", []
    while at < len(pattern):
        m = item.match(pattern, at)
        if not m or pattern[m.end() : m.end() + 1] in ("?", "+"):  # also lazy and possessive ones
            return None
        group, char, count = m.groups()
        needed = count is None or count == "+" or (count[0] == "{" and int(re.findall(r"\d+", count)[0]) > 0)
        if char and needed:
            run += char
        if group and needed:
            found.append(group.split("|"))
        if group or count:
            found, run = [*found, [run]], ""
        at = m.end()
    best = max([*found, [run]], key=lambda options: min(map(len, options)))
    return best if all(best) else None


def finds(c: Column, pattern: str, parts: Sequence[str]) -> Column:
    """Whether the regular expression made of ``parts`` is found; it is only tried on texts that hold a literal of them."""
    literals = [literals_of(p) for p in parts]
    if not all(literals):
        return c.rlike(pattern)
    return contains_any(c, list(dict.fromkeys(x for options in literals for x in options))) & c.rlike(pattern)


def matches_any(c: Column, patterns: Sequence[str]) -> Column:
    """True if any regular expression is found; one alternation, one pass over texts that can hold it."""
    return finds(c, "|".join(f"({p})" for p in patterns), patterns)


def whole_word(patterns: Sequence[str]) -> str:
    """A pattern that finds any of ``patterns`` as whole words of any script."""
    return f"(^|[^{WORD}])({'|'.join(patterns)})($|[^{WORD}])"


def has_whole_word(c: Column, tokens: Column, terms: Sequence[str]) -> Column:
    """True if any literal term occurs as a whole word or phrase of the text ``c`` with words ``tokens``.

    Single words are looked up among the words; phrases are searched in texts that hold their letters.
    """
    single = [t for t in terms if re.fullmatch(r"\w+", t)]
    phrases = [t for t in terms if t not in single]
    found = F.arrays_overlap(tokens, F.array(*[F.lit(t) for t in single])) if single else F.lit(False)
    if not phrases:
        return found
    pattern = whole_word([re.escape(t).replace("\\ ", " ") for t in phrases])
    return found | (contains_any(c, phrases) & c.rlike(pattern))


def mark_sentence_ends(c: Column) -> Column:
    """Blank after an end mark before a capital, single full stops, a full stop at lower-to-upper joins."""
    c = F.regexp_replace(c, "([.!?])([A-Z])", "$1 $2")
    c = F.regexp_replace(c, r"\.{2,}", ".")
    return F.regexp_replace(c, "([a-z])([A-Z])", "$1. $2")


def end_with_stop(c: Column) -> Column:
    """Append a full stop unless the text ends in ``. ! ?``."""
    return F.when(c.rlike(f"[.!?][{SPACE}]*$"), c).otherwise(F.concat(c, F.lit(".")))


def split_sentences(c: Column) -> Column:
    return F.split(c, f"(?<=[.!?])[{SPACE}]+")


def is_sentence(c: Column, min_words: int = 3, min_chars: int = 15) -> Column:
    """Long enough and free of mentions and links."""
    long_enough = (word_count(c) >= min_words) & (F.length(c) >= min_chars)
    return long_enough & ~c.contains("@") & ~c.contains("http")


def tidy_summary(c: Column) -> Column:
    """No white space before ``. , ! ?``; single full stops."""
    c = F.regexp_replace(c, f"[{SPACE}]+([.,!?])", "$1")
    return F.regexp_replace(c, r"\.{2,}", ".")


def is_blank(c: Column) -> Column:
    return ~F.coalesce(c.rlike(f"[^{SPACE}]"), F.lit(False))


def long_enough(c: Column, min_length: int = 20) -> Column:
    return F.coalesce(F.length(c) >= min_length, F.lit(False))


def title_case(c: Column) -> Column:
    return F.initcap(c)


def before_colon(c: Column) -> Column:
    """The theme name in front of the term list."""
    return F.split_part(c, F.lit(":"), F.lit(1))


def full_label(description: Column, cluster: Column) -> Column:
    return F.concat(description, F.lit(" (Cluster "), cluster.cast("string"), F.lit(")"))


def short_label(description: Column, cluster: Column) -> Column:
    """Main theme in front of ``:`` and ``&`` with the cluster number."""
    main = before_colon(description)
    main = F.when(main.contains("&"), F.trim(F.split_part(main, F.lit("&"), F.lit(1)))).otherwise(main)
    return F.concat(main, F.lit(" ("), cluster.cast("string"), F.lit(")"))

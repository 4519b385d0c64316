"""Text columns: cleaning, tokens, n-grams, keyword marks, fixed-length lists.

Everything here is a native column expression. The word class follows the
Unicode meaning (letters, numbers, underscore), so accented words stay whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes; letters and numbers of all scripts, all white space.
WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
NOT_SPACE = r"[^\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"

# Marker texts of the composed model input.
KEY_MARKER = "[KEY]"
TITLE_END = "[T_END]"
JOURNAL_END = "[J_END]"

# What the cleaner removes first, in this order, and a text that
# must be there for a hit. The e-mail pattern is "some @ some" without blanks.
TAGS = (r"<[^>]+>", ["<"])
URLS = (rf"http{NOT_SPACE}+|www\.{NOT_SPACE}+", ["http", "www."])
EMAILS = (rf"{NOT_SPACE}+@{NOT_SPACE}+", ["@"])


def collapse_whitespace(col: Column) -> Column:
    """Runs of white space become one blank; none is left at either end."""
    return F.trim(_blank_runs(col, SPACE))


def _blank_runs(col: Column, members: str) -> Column:
    """Runs of a character class become one blank; a lone blank is not touched."""
    return F.regexp_replace(col, f"{members}{{2,}}|[{members}&&[^ ]]", " ")


def _blank_hits(col: Column, pattern: str, needed: Sequence[str]) -> Column:
    """Hits of a pattern become a blank; texts that hold none of ``needed`` skip the pattern.

    The text is bound by ``transform`` over a one-member array, so that it is
    computed once although it is named three times.
    """

    def blanked(text: Column) -> Column:
        possible = reduce(lambda a, b: a | b, [text.contains(part) for part in needed])
        return F.when(possible, F.regexp_replace(text, pattern, " ")).otherwise(text)

    return F.get(F.transform(F.array(col), blanked), F.lit(0))


def clean_text(
    col: Column, lower: bool = True, remove_digits: bool = True, remove_punct: bool = True
) -> Column:
    """Lower-case (optional), drop tags, URLs, e-mail addresses, then optionally
    digits and punctuation; every removed run becomes a blank. NULL gives ``''``."""
    text = F.coalesce(col, F.lit(""))
    if lower:
        text = F.lower(text)
    for pattern, needed in (TAGS, URLS, EMAILS):
        text = _blank_hits(text, pattern, needed)
    # digits, punctuation and white space all end as one blank per run: one pass
    numbers = r"\p{Nl}\p{No}" if remove_digits else r"\p{N}"
    if remove_punct:
        members = rf"[^a-zA-Z\p{{L}}{numbers}_]"
    else:
        members = SPACE[:-1] + r"\p{Nd}]" if remove_digits else SPACE
    return F.trim(_blank_runs(text, members))


def word_tokens(col: Column, lower: bool = True) -> Column:
    """Runs of two or more word characters, in text order."""
    text = F.lower(col) if lower else col
    return F.regexp_extract_all(text, F.lit(f"{WORD}{{2,}}"), F.lit(0))


def words(col: Column) -> Column:
    """Parts between white space; a blank text has none."""
    return F.array_remove(F.split(col, f"{SPACE}+"), "")


def word_count(col: Column) -> Column:
    """Number of parts between white space; NULL stays NULL."""
    return F.regexp_count(col, F.lit(f"{NOT_SPACE}+"))


def word_ngrams(tokens: Column, n_min: int = 1, n_max: int = 1) -> Column:
    """The n-grams of a token list for n in ``n_min..n_max``, blank-joined, shorter ones first."""
    parts = []
    for n in range(n_min, n_max + 1):
        count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
        grams = F.slice(tokens, F.lit(1), count)
        for shift in range(1, n):
            following = F.slice(tokens, F.lit(1 + shift), count)
            grams = F.zip_with(grams, following, lambda a, b: F.concat(a, F.lit(" "), b))
        parts.append(grams)
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def compose_input_text(
    title: Column, journal: Column, abstract: Column, null_text: str = "None"
) -> Column:
    """``title [T_END] journal [J_END] abstract``; a NULL part shows as ``null_text``."""

    def shown(part: Column) -> Column:
        return F.coalesce(part.cast("string"), F.lit(null_text))

    return F.concat(
        shown(title), F.lit(f" {TITLE_END} "), shown(journal), F.lit(f" {JOURNAL_END} "), shown(abstract)
    )


def _is_word_char(ch: str) -> bool:
    return ch.isalnum() or ch == "_"


def _keyword_pattern(keyword: str) -> str:
    """Whole-word pattern: at each end the text must switch between word and non-word."""
    quoted = "".join(ch if _is_word_char(ch) or not ch.isascii() else "\\" + ch for ch in keyword)
    # looking back after the keyword is cheaper: it only happens where the keyword stands
    before = f"(?<!{WORD}{quoted})" if _is_word_char(keyword[0]) else f"(?<={WORD}{quoted})"
    after = f"(?!{WORD})" if _is_word_char(keyword[-1]) else f"(?={WORD})"
    return f"(?iu){quoted}{before}{after}"


def mark_keywords(col: Column, keywords: Sequence[str], marker: str = KEY_MARKER) -> Column:
    """Put ``marker`` on both sides of every whole-word hit, ignoring case.

    Keywords are applied one after the other in the given order, and a hit is
    written back in the spelling of the list.
    """
    for keyword in keywords:
        literal = f"{marker} {keyword} {marker}".replace("\\", "\\\\").replace("$", "\\$")
        col = F.regexp_replace(col, _keyword_pattern(keyword), literal)
    return col


def last_path_segment(col: Column) -> Column:
    """Text after the last slash."""
    return F.substring_index(col, "/", -1)


def normalise_doi(col: Column) -> Column:
    """The bare DOI: text after the last ``doi.org/``."""
    return F.substring_index(col, "doi.org/", -1)


def truncate_pad(ids: Column, max_length: int, pad_id: int = 0) -> tuple[Column, Column]:
    """``(input_ids, attention_mask)``, both exactly ``max_length`` long."""
    kept = F.slice(ids, 1, max_length)
    missing = F.lit(max_length) - F.size(kept)
    padded = F.concat(kept, F.array_repeat(F.lit(pad_id), missing))
    mask = F.concat(F.array_repeat(F.lit(1), F.size(kept)), F.array_repeat(F.lit(0), missing))
    return padded, mask

"""Text, regex, emoji and JSON scalar functions (Column -> Column).

All functions are JVM-side expressions that stay inside whole-stage codegen,
except :func:`unescape_and_fold`, the one Arrow-batched helper for the two
steps Spark has no built-in for (HTML unescape and NFKD accent folding).

Java regex note: ``\\w`` and ``\\s`` are ASCII-only unless ``(?U)`` is given,
so every pattern that must behave like Python's Unicode classes carries it.
"""
from __future__ import annotations

import functools
import html
import re
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values that must equal the reference's -------------------------
# Retweet prefix, URL pattern, the escape characters replaced by a space and
# the typographic quotes mapped to ASCII, in the reference's order.
RT_PREFIX = r"RT @[^:\s]+:"
URL = r"https?://\S+"
ESCAPES_TO_SPACE = ["\xa0", "\x9d", "\xb6", "\\", "\t", "\n", "\r", "\f"]
QUOTES = {"’": "'", "‘": "'", "“": '"', "”": '"'}
MENTION = r"@\w+\s?"
MASKED_RUN = r"(@user\s*){4,}"
MASKED_RUN_REPLACEMENT = "@user @user ... @user "
MAIN_OPEN = "[main_tweet]"
MAIN_CLOSE = "[/main_tweet]"
CONTEXT_CLOSE = "[/context]"
GENDER_SIGNS = ["♀", "♂"]
# --------------------------------------------------------------------------


def _class_ranges(members) -> str:
    """A regex class body of ascending code points."""
    out, run = [], []
    for cp in [*members, None]:
        if run and cp != run[-1] + 1:
            out.append("\\x{%04X}" % run[0] + ("-\\x{%04X}" % run[-1] if len(run) > 1 else ""))
            run = []
        run.append(cp)
    return "".join(out)


def _emoji_points() -> list[int]:
    """Code points with the Unicode property Emoji that are an emoji by
    themselves: not the keycap characters (ASCII) and not regional indicators."""
    planes = "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x20000)]))
    return [ord(c) for c in regex.findall(r"\p{Emoji}", planes) if not 0x1F1E6 <= ord(c) <= 0x1F1FF]


# Java's and RE2's regex engines have no emoji property, so the class is
# written out as code-point ranges, from the property table of ``regex``.
EMOJI_RANGES = _class_ranges(_emoji_points())
REGIONAL_INDICATORS = r"\x{1F1E6}-\x{1F1FF}"
SKIN_TONES = r"\x{1F3FB}-\x{1F3FF}"

# Characters outside ASCII that survive clean_unicodes.
NON_KEPT = r"[^\x00-\x7F" + EMOJI_RANGES + REGIONAL_INDICATORS + "]"

# Emoji grammar of the extractor: a flag (two regional indicators), or a base
# emoji with an optional skin tone and an optional gender sign.  This is the
# intended grammar; the reference's loop also copies two extra characters
# after tone+gender, which is not reproduced.
EMOJI_TOKEN = (
    "[" + REGIONAL_INDICATORS + "]{2}"
    "|[" + EMOJI_RANGES + "][" + SKIN_TONES + "]?[♀♂]?"
)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# X1
def remove_retweet_prefix(col) -> Column:
    return F.regexp_replace(_c(col), RT_PREFIX, "")


# X2
def remove_urls(col) -> Column:
    return F.regexp_replace(_c(col), URL, "")


# X3
def escapes_to_space(col) -> Column:
    return F.translate(_c(col), "".join(ESCAPES_TO_SPACE), " " * len(ESCAPES_TO_SPACE))


# X5
def collapse_whitespace(col) -> Column:
    return F.regexp_replace(_c(col), r"(?U)\s+", " ")


# X6 -- trailing only; a leading space survives (trap T3)
def rstrip_whitespace(col) -> Column:
    return F.regexp_replace(_c(col), r"(?U)\s+$", "")


# X7
def ascii_quotes(col) -> Column:
    return F.translate(_c(col), "".join(QUOTES), "".join(QUOTES.values()))


# The same class for Java: the first half turns ASCII away before the long list
# of ranges is looked at, and a run goes at once.
_JAVA_NON_KEPT = r"[\x{80}-\x{10FFFF}&&[^" + EMOJI_RANGES + REGIONAL_INDICATORS + "]]+"


# X9
def keep_ascii_and_emoji(col) -> Column:
    return F.regexp_replace(_c(col), _JAVA_NON_KEPT, "")


# every code point with a non-zero canonical combining class, mapped to
# deletion; built once per Python worker from the Unicode database
_DROP_COMBINING = {cp: None for cp in range(0x110000) if unicodedata.combining(chr(cp))}


_NON_ASCII = re.compile(r"[^\x00-\x7F]+")


@functools.lru_cache(maxsize=1 << 14)
def _fold_run(run: str) -> str:
    return unicodedata.normalize("NFKD", run).translate(_DROP_COMBINING)


def _fold_match(m) -> str:
    run = m.group()  # only short ones are worth remembering
    return _fold_run(run) if len(run) <= 16 else _fold_run.__wrapped__(run)


def _fold_one(s: str) -> str:
    """NFKD, then drop combining marks.  ASCII neither decomposes nor takes part
    in the order of marks, so runs of other characters are folded apart."""
    if s.isascii():
        return s
    return _NON_ASCII.sub(_fold_match, s)


def _x4_to_x8(s):
    if s is None:
        return None
    s = html.unescape(s)                      # X4
    words = s.split()
    if not words:
        return ""
    # White space is the same class for ``split`` and ``\s``; a leading one stays as a space
    s = (" " if s[0].isspace() else "") + " ".join(words)
    if s.isascii():
        return s
    for a, b in QUOTES.items():               # X7
        s = s.replace(a, b)
    return _fold_one(s)                       # X8


@F.pandas_udf(T.StringType())
def unescape_and_fold(s: pd.Series) -> pd.Series:
    """X4..X8 in one Arrow batch pass: HTML unescape, whitespace collapse,
    trailing strip, quote mapping, NFKD accent folding.

    Spark has no HTML unescape and no Unicode normalisation; the three
    middle steps ride along so the column crosses the Arrow boundary once.
    """
    return s.map(_x4_to_x8)


@F.pandas_udf(T.StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    """X4 alone."""
    return s.map(lambda v: None if v is None else html.unescape(v))


@F.pandas_udf(T.StringType())
def remove_diacritics(s: pd.Series) -> pd.Series:
    """X8 alone: NFKD, then drop combining marks."""
    return s.map(lambda v: None if v is None else _fold_one(v))


# Python's whitespace class restricted to ASCII (str.isspace: includes the
# four information separators 0x1C-0x1F, which Java's \s lacks)
_ASCII_PY_WS = r"[\t\n\x0B\f\r\x1C-\x1F ]"


def clean_text(col) -> Column:
    """X1..X9 in the reference's order.

    Only rows that hold an entity candidate ('&') or a non-ASCII character
    need Python (HTML unescape, NFKD folding); the others take the same
    steps as JVM expressions.  The UDF receives NULL for those rows, so
    almost nothing crosses the Arrow boundary for plain ASCII text.
    """
    c = escapes_to_space(remove_urls(remove_retweet_prefix(col)))
    needs_python = c.rlike(r"[^\x00-\x7F]|&")
    py = unescape_and_fold(F.when(needs_python, c))
    native = ascii_quotes(F.regexp_replace(F.regexp_replace(c, _ASCII_PY_WS + "+", " "), _ASCII_PY_WS + "+$", ""))
    # the native branch holds ASCII only
    return F.when(needs_python, keep_ascii_and_emoji(py)).otherwise(native)


def clean_text_native(col) -> Column:
    """X1..X3, X5..X7, X9 only (no Python); for text known to hold neither
    HTML entities nor accents, and as a streaming-safe expression."""
    c = escapes_to_space(remove_urls(remove_retweet_prefix(col)))
    c = ascii_quotes(rstrip_whitespace(collapse_whitespace(c)))
    return keep_ascii_and_emoji(c)


# X10
def extract_emojis(col) -> Column:
    """No part of an emoji is ASCII, so a run of ASCII becomes one space before
    the long classes are tried at every character."""
    return F.regexp_extract_all(F.regexp_replace(_c(col), r"[\x00-\x7F]+", " "), F.lit("(" + EMOJI_TOKEN + ")"), 1)


# X11
def lower_alnum(arr) -> Column:
    return F.transform(_c(arr), lambda x: F.lower(F.regexp_replace(x, "[^a-zA-Z0-9]", "")))


# X12
def remove_tag(col, tag: str) -> Column:
    return F.replace(_c(col), F.lit(tag), F.lit(""))


# X13 / X14
def mask_mentions(col) -> Column:
    masked = F.regexp_replace(_c(col), r"(?U)" + MENTION, "@user ")
    return F.regexp_replace(masked, MASKED_RUN, MASKED_RUN_REPLACEMENT)


# X15
def split_context(col) -> tuple[Column, Column, Column]:
    """previous / main / posterior parts around the main tags (at most two
    splits); the main part is re-prefixed with the opening tag.  Parts that the
    text does not have are NULL."""
    parts = F.split(_c(col), r"\[main_tweet\]|\[/main_tweet\]", 3)
    previous = F.get(parts, 0)
    main = F.concat(F.lit(MAIN_OPEN), F.get(parts, 1))
    posterior = F.get(parts, 2)
    return previous, main, posterior


# X16
def annotation_choices(col) -> Column:
    parsed = F.from_json(_c(col), "choices array<string>")
    return F.coalesce(parsed.getField("choices"), F.array(_c(col)))


# X17
def fill_template(template: str, **placeholders) -> Column:
    out = F.lit(template)
    for key, value in placeholders.items():
        out = F.replace(out, F.lit("{" + key + "}"), _c(value))
    return out


# --- fixed values: the four prompts by type -------------------------------
PROMPTS = {
    "with_fallacy_definition": "Given the following tweet and fallacy definitions, which of the fallacies defined below occurs in the tweet? More than one can occur :\n\nDefinitions:\n{fallacy_def_text}\n\nTweet: {main_tweet}",
    "with_fallacy_definition_with_NotA": "Given the following tweet and fallacy definitions, which of the fallacies defined below occurs in the tweet? More than one can occur. (If none of them occur, you can answer 'none of the above') :\n\nDefinitions:\n{fallacy_def_text}\n\nTweet: {main_tweet}",
    "without_fallacy_definition": "Given the tweet below, which of the following fallacies occurs in the tweet: {fallacies}? More than one can occur. \nTweet: {main_tweet}",
    "without_fallacy_definition_with_NotA": "Given the tweet below, which of the following fallacies occurs in the tweet: {fallacies}? More than one can occur. (If none of them occur, you can answer 'none of the above') \nTweet: {main_tweet}",
}
# --------------------------------------------------------------------------


def prompt_text(prompt_type: str, names: list[str], definitions: dict[str, str], text) -> Column:
    """The prompt of a type: class names or a block of one "name: definition"
    line per class, then the text, whose own braces are left alone."""
    fixed = {"fallacies": ", ".join(names), "fallacy_def_text": "\n".join(f"{n}: {d}" for n, d in definitions.items())}
    before, after = PROMPTS[prompt_type].split("{main_tweet}")
    for key, value in fixed.items():
        before = before.replace("{" + key + "}", value)
    return F.concat(F.lit(before), _c(text), F.lit(after))


def prompt_record(prompt_type: str, flags: dict[str, str], none_flag: str, definitions: dict[str, str], text) -> Column:
    """The record that a line of a training file holds: input, target and 0/1
    target under ``translation``.  ``flags``: label column -> class name."""
    return F.struct(prompt_text(prompt_type, list(flags.values()), definitions, text).alias("input"),
                    target_text(list(flags), list(flags.values())).alias("target"),
                    binary_vector([*flags, none_flag]).alias("binary_target"))


# X18
def target_text(flags: list, names: list[str], none_text: str = "none of the above") -> Column:
    picked = F.array_compact(F.array(*[F.when(_c(f) == 1, F.lit(n)) for f, n in zip(flags, names)]))
    return F.when(F.size(picked) > 0, F.array_join(picked, ", ")).otherwise(F.lit(none_text))


def binary_vector(flags: list) -> Column:
    return F.array(*[_c(f).cast("int") for f in flags])


# X19 (substring decode, trap T15)
def binary_from_text(col, class_names: list[str]) -> Column:
    low = F.lower(_c(col))
    return F.array(*[F.contains(low, F.lit(n.lower())).cast("int") for n in class_names])


# X20
def labels_from_vector(vec, names: list[str]) -> Column:
    name_arr = F.array(*[F.lit(n) for n in names])
    return F.filter(
        F.transform(_c(vec), lambda x, i: F.when(x == 1, F.element_at(name_arr, i + 1))),
        lambda x: x.isNotNull())


# --- fixed value: the form of a run directory's name ----------------------
RUN_NAME = r"^t5-large_prompt_type_(.*?)_epochs_(\d+)_seed_(\d+)"
# --------------------------------------------------------------------------


# X21
def parse_run_name(col) -> tuple[Column, Column, Column]:
    """(prompt type, epochs, seed) of a run name; all NULL if it does not
    have the form, and a number too large for an int is NULL."""
    c = _c(col)
    fits = c.rlike(RUN_NAME)

    def part(i):
        return F.when(fits, F.regexp_extract(c, RUN_NAME, i))
    return part(1), part(2).try_cast("int"), part(3).try_cast("int")


# X22
def run_name(model_col, *parts) -> Column:
    return F.concat_ws("_", F.replace(_c(model_col), F.lit("/"), F.lit("_")), *[_c(p) for p in parts])


# X23
def word_tokens(col) -> Column:
    return F.filter(F.split(_c(col), r"(?U)\s+"), lambda x: x != "")


def truncate_tokens(col, n: int) -> tuple[Column, Column]:
    toks = word_tokens(col)
    return F.array_join(F.slice(toks, 1, n), " "), F.size(toks) > n


# P14
def word_count(col) -> Column:
    return F.size(word_tokens(col))


# X24
def strip(col) -> Column:
    """Without any white space at both ends."""
    return F.regexp_replace(_c(col), r"(?U)^\s+|\s+$", "")


from convgraph.session import pickle_by_value  # noqa: E402

pickle_by_value(__name__)

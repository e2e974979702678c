"""Per-row engineered features.

Word-level lexicons are small tables with a fixed size (a chosen number of
words or tags), joined by broadcast; the per-row averages are hash
aggregations keyed by row id.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convgraph.session import pickle_by_value

pickle_by_value(__name__)

# --- fixed values: the 19 part-of-speech tags counted per row, in order ---
POS_TAGS = ["ADJ", "ADP", "ADV", "AUX", "CONJ", "CCONJ", "DET", "INTJ", "NOUN", "NUM", "PART",
            "PRON", "PROPN", "PUNCT", "SCONJ", "SYM", "VERB", "X", "SPACE"]
# --------------------------------------------------------------------------

# Stand-in tagger: a rule table (no neural tagger on a cluster).  Each rule is
# (tag, kind, argument); the first matching rule wins.
TAG_RULES = [
    ("SPACE", "regex", r"^\s+$"),
    ("NUM", "regex", r"^[0-9]+$"),
    ("PUNCT", "in", [".", ",", ";", ":", "!", "?", "(", ")", '"', "'", "-"]),
    ("DET", "in", ["the", "a", "an", "this", "that", "these", "those", "le", "la", "les", "der", "die", "das", "el"]),
    ("CCONJ", "in", ["and", "or", "but", "et", "und", "y", "ou", "oder"]),
    ("SCONJ", "in", ["if", "because", "while", "que", "dass", "weil"]),
    ("ADP", "in", ["of", "in", "on", "at", "to", "for", "with", "from", "by", "de", "en", "von", "mit", "sur", "pour"]),
    ("AUX", "in", ["is", "are", "was", "were", "be", "been", "est", "ist", "sind", "es"]),
    ("PRON", "in", ["it", "he", "she", "they", "we", "i", "you", "il", "elle", "er", "sie", "wir", "qui"]),
    ("PART", "in", ["not", "no", "nicht", "ne", "pas"]),
    ("INTJ", "in", ["oh", "ah", "wow", "hey"]),
    ("ADV", "regex", r"^[a-z]+ly$"),
    ("VERB", "regex", r"^[a-z]+(ing|ed)$"),
    ("ADJ", "regex", r"^[a-z]+(ous|ful|able|ive|ble)$"),
    ("PROPN", "regex", r"^[A-Z][a-z]+$"),
    ("NOUN", "regex", r"^[A-Za-z]+$"),
    ("SYM", "regex", r"^[^A-Za-z0-9]$"),
]
TOKEN_PATTERN = r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]"


def _tagger():
    """token -> position in POS_TAGS of the first rule that matches, else of
    X.  Word lists that follow each other are one lookup."""
    steps = []
    for tag, kind, arg in TAG_RULES:
        at = POS_TAGS.index(tag)
        if kind == "in":
            if not steps or steps[-1][0] is not None:
                steps.append((None, None, {}))
            for word in arg:
                steps[-1][2].setdefault(word, at)
        else:
            steps.append((re.compile(arg, re.ASCII).search, tag in ("PROPN", "NOUN", "SYM", "SPACE", "NUM"), at))
    other = POS_TAGS.index("X")

    def tag_of(token: str) -> int:
        low = token.lower()
        for search, by_case, at in steps:
            if search is None:
                if low in at:
                    return at[low]
            elif search(token if by_case else low):
                return at
        return other
    return tag_of


def tag_counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Per text the number of tokens of every tag, in the order of POS_TAGS."""
    tokens, tag_of, known = re.compile(TOKEN_PATTERN, re.ASCII), _tagger(), {}
    for texts in batches:
        out = []
        for text in texts:
            n = [0] * len(POS_TAGS)
            for token, k in Counter(tokens.findall(text) if text is not None else ()).items():
                tag = known.get(token)
                if tag is None:
                    tag = known[token] = tag_of(token)
                n[tag] += k
            if len(known) > 1 << 17:  # the tags met so far are only a short cut
                known.clear()
            out.append(n)
        yield pd.Series(out)


def tag_sql(tok: str) -> str:
    parts = []
    for tag, kind, arg in TAG_RULES:
        if kind == "in":
            vals = ", ".join("'" + v.replace("'", "''") + "'" for v in arg)
            cond = f"lower({tok}) IN ({vals})"
        elif tag in ("PROPN", "NOUN", "SYM", "SPACE", "NUM"):
            cond = f"regexp_matches({tok}, '{arg}')"
        else:
            cond = f"regexp_matches(lower({tok}), '{arg}')"
        parts.append(f"WHEN {cond} THEN '{tag}'")
    return "CASE " + " ".join(parts) + " ELSE 'X' END"


def _keys(id_col: str | list[str]) -> list[str]:
    return [id_col] if isinstance(id_col, str) else list(id_col)


def pos_histogram(df: DataFrame, id_col: str | list[str], text_col: str) -> DataFrame:
    """Per row, the count of every one of the 19 tags (zeros kept).
    Tokens are counted where the text is read; one row per text is shuffled."""
    keys = _keys(id_col)
    n = df.select(*keys, F.pandas_udf(tag_counts, "array<bigint>")(F.col(text_col)).alias("_n"))
    counts = n.groupBy(*keys).agg(*[F.sum(F.col("_n")[i]).alias(t) for i, t in enumerate(POS_TAGS)])
    out = df.select(*keys).join(counts, keys, "left").fillna(0, POS_TAGS)
    return out.select(*keys, *[F.col(t).cast("long").alias("POS_" + t) for t in POS_TAGS])


def words(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.filter(F.split(F.lower(c), "[^a-z]+"), lambda x: x != "")


def word_lexicon(docs: DataFrame, text_col: str, min_len: int = 3, frequency: str | None = None) -> DataFrame:
    """Stand-in VAD lexicon: every word of the texts, with scores derived by
    rule.  Its size follows the vocabulary, so it is joined, not broadcast by
    hint; Spark broadcasts it where its measured size allows.  ``frequency``
    names a further column: how often the word occurs."""
    w = docs.select(F.explode(words(text_col)).alias("word")).filter(F.length("word") >= min_len)
    w = w.distinct() if frequency is None else w.groupBy("word").agg(F.count(F.lit(1)).alias(frequency))
    return w.select("word",
                      ((F.length("word") % 10) / 10.0 + F.ascii("word") / 1000.0).alias("valence"),
                      ((F.ascii(F.substring("word", -1, 1)) - 97) / 26.0).alias("arousal"),
                      ((F.length("word") % 7) / 7.0).alias("dominance"),
                      *([frequency] if frequency else []))


# Words of a lexicon that are sent to every task when their frequency is known
# (some 6 MB); all others are joined by shuffle.  A parameter of the plan: the
# scores do not depend on it.
HEAD_WORDS = 1 << 16


def lexicon_scores(df: DataFrame, id_col: str | list[str], text_col: str, lexicon: DataFrame,
                   dims=("valence", "arousal", "dominance"), neutral: float = 0.5,
                   frequency: str | None = None, min_len: int = 1, head_words: int = HEAD_WORDS) -> DataFrame:
    """Mean lexicon score of the matched words of each row; rows with
    no match get ``neutral``.

    With ``frequency`` (a lexicon column; one lexicon row per word) the most
    frequent words are looked up where the texts are read and only the tokens
    of the others are shuffled.  ``min_len``: the lexicon has no shorter word."""
    keys = _keys(id_col)
    toks = df.select(*keys, F.explode(words(text_col)).alias("word"))
    if min_len > 1:
        toks = toks.filter(F.length("word") >= min_len)
    if frequency is None:
        m = toks.join(lexicon, "word").groupBy(*keys).agg(*[F.avg(d).alias(d) for d in dims])
    else:
        head = F.broadcast(lexicon.orderBy(F.desc(frequency), "word").limit(head_words).select("word", *dims))
        rest = toks.join(head, "word", "left_anti").join(lexicon, "word")

        def sums(found):
            return found.groupBy(*keys).agg(*[F.sum(d).alias("_s_" + d) for d in dims],
                                            *[F.count(d).alias("_n_" + d) for d in dims])
        m = sums(toks.join(head, "word")).unionByName(sums(rest)).groupBy(*keys).agg(
            *[(F.sum("_s_" + d) / F.sum("_n_" + d)).alias(d) for d in dims])
    out = df.select(*keys).join(m, keys, "left")
    return out.select(*keys, *[F.coalesce(F.col(d), F.lit(neutral)).alias(d) for d in dims])


def polarity(df: DataFrame, id_col: str, text_col: str, lexicon: DataFrame, score: Column,
             alpha: float = 15.0) -> DataFrame:
    """A31 (re-aimed): lexicon-sum polarity.  Each word scores p (0 when not
    in the lexicon); pos / neg / neu are shares of positive mass, negative
    mass and unscored words; compound = s / sqrt(s^2 + alpha), s = sum p."""
    lex = lexicon.select("word", score.alias("_p"))
    toks = df.select(id_col, F.explode(words(text_col)).alias("word"))
    j = toks.join(lex, "word", "left").withColumn("_p", F.coalesce("_p", F.lit(0.0)))
    g = j.groupBy(id_col).agg(F.sum(F.greatest("_p", F.lit(0.0))).alias("_pos"),
                              F.sum(F.greatest(-F.col("_p"), F.lit(0.0))).alias("_neg"),
                              F.count_if(F.col("_p") == 0).alias("_neu"),
                              F.sum("_p").alias("_s"))
    tot = F.col("_pos") + F.col("_neg") + F.col("_neu")
    share = lambda c: F.when(tot > 0, F.col(c) / tot).otherwise(F.lit(0.0))
    g = g.select(id_col, share("_neg").alias("neg"), share("_neu").alias("neu"), share("_pos").alias("pos"),
                 (F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + alpha)).alias("compound"))
    out = df.select(id_col).join(g, id_col, "left")
    return out.select(id_col, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ["neg", "neu", "pos", "compound"]])


def feature_columns(df: DataFrame, prefixes: list[str]) -> list[str]:
    """Columns whose name starts with one of ``prefixes``."""
    return [c for c in df.columns if any(c.startswith(p) for p in prefixes)]

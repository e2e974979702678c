"""Word lexicons against token tables (J13, A30) and rule-based polarity.

The words of a language are skewed: a few stand in every row.  ``lookup`` finds
them first, from counts that are combined before they are shuffled: a word with
at least one token in ``HOT_SHARE`` is hot, so there are at most that many, and
their scores are broadcast.  All other tokens meet the lexicon in a shuffle in
which no key holds more than that share.
"""
from __future__ import annotations


from pyspark.sql import Column, DataFrame, functions as F

from convgraph.session import cut_lineage

#: A word is hot from one token in this many on; bounds the broadcast rows.
HOT_SHARE = 10_000

# --- fixed values of the published polarity model -------------------------
BOOST = 0.293
CAPITALS = 0.733
NEGATED = -0.74
DECAY = (1.0, 0.95, 0.9)
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
EXCLAMATION, EXCLAMATIONS = 0.292, 4
QUESTION, QUESTIONS, MANY_QUESTIONS = 0.18, 3, 0.96
ALPHA = 15.0
# --------------------------------------------------------------------------

NEGATIONS = ("not", "no", "never", "none", "nobody", "nothing", "neither", "nor", "nowhere", "cannot", "without")
BOOSTERS = ("very", "really", "extremely", "absolutely", "completely", "totally", "so", "highly", "deeply", "especially")
DAMPENERS = ("slightly", "somewhat", "barely", "hardly", "partly", "almost", "rather", "marginally")


def hot_words(tokens: DataFrame, word: str = "word", share: int = HOT_SHARE) -> DataFrame:
    """(word): at most ``share`` words with at least one token in ``share``."""
    counts = tokens.where(F.col(word).isNotNull()).groupBy(word).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))  # one row
    return counts.crossJoin(F.broadcast(total)).where(F.col("_n") * share >= F.col("_total")).select(word)


def lookup(tokens: DataFrame, lexicon: DataFrame, word: str = "word", share: int = HOT_SHARE,
           hot: DataFrame | None = None) -> DataFrame:
    """The tokens that are in the lexicon, with its columns.  ``lexicon`` has
    one row per word.  ``hot``: the hot words, if they are at hand."""
    # at most ``share`` rows
    hot = hot_words(tokens, word, share) if hot is None else hot
    known = hot.join(lexicon.withColumn("_in", F.lit(True)), word, "left").withColumn("_hot", F.lit(True))
    marked = tokens.where(F.col(word).isNotNull()).join(F.broadcast(known), word, "left")
    names = [c for c in lexicon.columns if c != word]
    of_hot = marked.where("_hot AND _in").select(*tokens.columns, *names)
    rest = marked.where("_hot IS NULL").select(*tokens.columns)
    return of_hot.unionByName(rest.join(lexicon, word).select(*tokens.columns, *names))


def lexicon_means(df: DataFrame, id_col: str, words: Column, lexicon: DataFrame, dims, neutral: float = 0.5,
                  share: int = HOT_SHARE) -> DataFrame:
    """Mean scores of the lexicon words of each row, ``neutral`` for a row
    without one.  Ids are taken to be unique."""
    tokens = df.select(F.col(id_col).alias("_id"), F.explode(words).alias("word"))
    found = lookup(tokens, lexicon.select("word", *dims), "word", share)
    # a row of zeros keeps rows without a word in the result of one grouping
    rows = df.select(F.col(id_col).alias("_id"), F.lit(0).cast("long").alias("n"), *[F.lit(0.0).alias(d) for d in dims])
    out = rows.unionByName(found.select("_id", F.lit(1).cast("long").alias("n"), *[F.col(d).cast("double").alias(d) for d in dims])) \
        .groupBy("_id").agg(F.sum("n").alias("n"), *[F.sum(d).alias(d) for d in dims])
    return out.select(F.col("_id").alias(id_col), *[F.coalesce(F.try_divide(F.col(d), F.col("n")), F.lit(neutral)).alias(d) for d in dims])


# ---------------------------------------------------------------- A31

#: What is neither letter nor digit at the start or the end of a word.
_EDGES = r"(?<!\S)[^\p{L}\p{N}\s]++|(?<=[\p{L}\p{N}])[^\p{L}\p{N}\s]++(?!\S)"


def _tokens(text: Column) -> Column:
    """Words between white space without what is not a letter or digit at their
    ends; what has neither is no word.  The ends go in one pass over the text."""
    return F.filter(F.split(F.regexp_replace(text, _EDGES, ""), r"\s+"), lambda w: w != "")


def _once(value: Column, of) -> Column:
    """of(value), with the value computed once a row however often it is used."""
    return F.transform(F.array(value), of)[0]


def modifiers(words: Column) -> Column:
    """For every word of an array (position, word, add, times): what capitals
    and boosters of the three words before add to its score, in the score's
    direction, and what negation and the first "but" multiply it with."""
    def of_words(ws):
        return F.struct(
            F.transform(ws, F.lower).alias("lower"),
            F.transform(ws, lambda w: (w == F.upper(w)) & w.rlike(r"\p{Lu}")).alias("capitals"))

    def of_flags(x):
        n_capitals = F.size(F.filter(x["capitals"], lambda c: c))
        return F.struct(
            x["lower"].alias("lower"), x["capitals"].alias("capitals"),
            F.transform(x["lower"], lambda w: F.when(w.isin(*BOOSTERS), BOOST).when(w.isin(*DAMPENERS), -BOOST).otherwise(0.0)).alias("step"),
            F.transform(x["lower"], lambda w: w.isin(*NEGATIONS) | w.endswith("n't")).alias("negation"),
            ((n_capitals > 0) & (n_capitals < F.size(x["lower"]))).alias("some"), F.array_position(x["lower"], "but").alias("but"))

    def per_word(x):
        def one(w, i):
            def capital(at):
                return x["some"] & F.coalesce(F.get(x["capitals"], at), F.lit(False))
            add = F.when(capital(i), CAPITALS).otherwise(0.0)
            times = F.when(x["but"] == 0, 1.0).when(i + 1 < x["but"], BEFORE_BUT).when(i + 1 > x["but"], AFTER_BUT).otherwise(1.0)
            for d, decay in enumerate(DECAY, start=1):
                step = F.coalesce(F.get(x["step"], i - d), F.lit(0.0))
                # an emphasised booster works as an emphasised word does
                add = add + decay * F.when(capital(i - d), step + F.signum(step) * CAPITALS).otherwise(step)
                times = times * F.when(F.coalesce(F.get(x["negation"], i - d), F.lit(False)), NEGATED).otherwise(1.0)
            return F.struct(i.alias("position"), w.alias("word"), add.alias("add"), times.alias("times"))
        return F.transform(x["lower"], one)
    return _once(_once(_once(words, of_words), of_flags), per_word)


def rule_polarity(df: DataFrame, id_col: str, text_col: str, lexicon: DataFrame, score: str = "score",
                  share: int = HOT_SHARE) -> DataFrame:
    """(id, neg, neu, pos, compound) of each row, by a lexicon and the rules of
    ``modifiers``; exclamation marks and questions strengthen the sum.  A row
    without words has zeros.  Ids are taken to be unique.

    The rules need no neighbour of a token beyond its row, so they are native
    array expressions before the lexicon join; after it a row needs one grouping
    with map-side sums.  What a row has by itself joins in as a row of the union."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("_id"), text.alias("_text"), _tokens(text).alias("_words"))
    # written once: the counts, the hot words and the others read it
    marked = cut_lineage(rows.select("_id", F.inline(modifiers(F.col("_words")))).select("_id", "word", "add", "times"))
    hot = cut_lineage(hot_words(marked, "word", share))
    found = lookup(marked, lexicon.select("word", F.col(score).cast("double").alias("_score")), "word", share, hot)
    value = (F.col("_score") + F.signum("_score") * F.col("add")) * F.col("times")
    zero = F.lit(0.0)

    def count(char):
        return F.length("_text") - F.length(F.replace(F.col("_text"), F.lit(char), F.lit("")))
    bangs, asks = F.least(count("!"), F.lit(EXCLAMATIONS)), count("?")
    emphasis = bangs * EXCLAMATION + F.when(asks <= 1, 0.0).when(asks <= QUESTIONS, asks * QUESTION).otherwise(MANY_QUESTIONS)
    own = rows.select("_id", F.size("_words").cast("long").alias("n"), emphasis.alias("emphasis"), zero.alias("value"))
    per_token = found.select("_id", F.lit(0).cast("long").alias("n"), zero.alias("emphasis"), value.alias("value"))
    v = F.col("value")
    sums = own.unionByName(per_token).groupBy("_id").agg(
        F.sum("n").alias("n"), F.sum("emphasis").alias("emphasis"), F.sum("value").alias("s"),
        F.sum(F.when(v > 0, v + 1.0).otherwise(zero)).alias("up"), F.sum(F.when(v < 0, 1.0 - v).otherwise(zero)).alias("down"),
        F.sum(F.when(v != 0, 1).otherwise(0)).alias("scored"))
    e, s = F.col("emphasis"), F.col("s")
    sums = sums.select("_id", (F.col("n") - F.col("scored")).cast("double").alias("flat"),
                       (F.col("up") + F.when(F.col("up") > F.col("down"), e).otherwise(zero)).alias("up"),
                       (F.col("down") + F.when(F.col("up") < F.col("down"), e).otherwise(zero)).alias("down"),
                       (s + F.signum(s) * e).alias("s"))
    total = F.col("flat") + F.col("up") + F.col("down")
    part = lambda c: F.coalesce(F.try_divide(F.col(c), total), zero)
    return sums.select(F.col("_id").alias(id_col), part("down").alias("neg"), part("flat").alias("neu"), part("up").alias("pos"),
                       (s / F.sqrt(s * s + ALPHA)).alias("compound"))

"""Registered queries: text cleaning, masking, annotation parsing, prompts."""
from __future__ import annotations

from pyspark.sql import functions as F

from convgraph.functions import text as X
from convgraph.plans import standins as S
from convgraph.plans.registry import query

# Python's \s class (Unicode whitespace) spelled out for RE2
_PY_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ESC_SQL = "chr(160) || chr(157) || chr(182) || '\\' || chr(9) || chr(10) || chr(13) || chr(12)"

_CLEAN_SQL = f"""
regexp_replace(
  strip_accents(
    translate(
      regexp_replace(
        regexp_replace(
          translate(
            regexp_replace(regexp_replace(__C__, 'RT @[^:\\s]+:', '', 'g'), 'https?://\\S+', '', 'g'),
            {_ESC_SQL}, '        '),
          '{_PY_WS}+', ' ', 'g'),
        '{_PY_WS}+$', ''),
      '’‘“”', '''''""')),
  '{X.NON_KEPT}', '', 'g')
"""


# ---------------------------------------------------------------- X1-X9
@query("clean_text", f"SELECT doc_id, {_CLEAN_SQL.replace('__C__', 'text')} AS clean FROM documents")
def clean_text(spark, sf):
    d = S.table(spark, sf, "documents")
    return d.select("doc_id", X.clean_text("text").alias("clean"))


# ---------------------------------------------------------------- X13/X14
@query("mask_mentions", """
SELECT doc_id,
       regexp_replace(regexp_replace(text, '@[\\pL\\pN_]+\\s?', '@user ', 'g'),
                      '(@user\\s*){4,}', '@user @user ... @user ', 'g') AS masked
FROM documents
""")
def mask_mentions(spark, sf):
    d = S.table(spark, sf, "documents")
    return d.select("doc_id", X.mask_mentions("text").alias("masked"))


# ---------------------------------------------------------------- X16 + A28
def _names_array():
    return F.array_compact(F.array(*[F.when(F.col(l) == 1, F.lit(l)) for l in S.LABELS]))


_NAMES_SQL = "list_filter([" + ", ".join(
    f"CASE WHEN {l} = 1 THEN '{l}' END" for l in S.LABELS) + "], lambda x: x IS NOT NULL)"


def annotations(spark, sf):
    """Annotation-tool export stand-in: a bare label when one label is set,
    else ``{"choices": [...]}``."""
    lab = S.labelled(spark, sf).withColumn("_names", _names_array())
    ann = F.when(F.size("_names") == 1, F.col("_names")[0]).otherwise(
        F.to_json(F.struct(F.col("_names").alias("choices"))))
    return lab.select("id", ann.alias("fallacy"))


_ANN_SQL = f"""
WITH lab AS ({S.LABELLED_SQL}),
n AS (SELECT id, {_NAMES_SQL} AS names FROM lab),
a AS (SELECT id, CASE WHEN len(names) = 1 THEN names[1]
                      ELSE '{{"choices":' || CAST(to_json(names) AS VARCHAR) || '}}' END AS fallacy FROM n),
p AS (SELECT id, CASE WHEN json_valid(fallacy) AND json_type(fallacy) = 'OBJECT'
                      THEN CAST(json_extract_string(fallacy, '$.choices[*]') AS VARCHAR[])
                      ELSE [fallacy] END AS choices FROM a)
"""


@query("parse_choices", _ANN_SQL + f"""
SELECT id, CAST(len(choices) AS INTEGER) AS n_choices, array_to_string(choices, '|') AS choices,
       {", ".join(f"CAST(list_contains(choices, '{l}') AS INTEGER) AS {l}" for l in S.LABELS)}
FROM p
""")
def parse_choices(spark, sf):
    a = annotations(spark, sf)
    ch = a.select("id", X.annotation_choices("fallacy").alias("choices"))
    return ch.select("id", F.size("choices").alias("n_choices"),
                     F.array_join("choices", "|").alias("choices"),
                     *[F.array_contains("choices", l).cast("int").alias(l) for l in S.LABELS])


# ---------------------------------------------------------------- X17/X18/X19/X20
# --- fixed values: own prompt template and the readable class names -------
TEMPLATE = "Post:\n{main_tweet}\n\nClasses: {classes}\nWrite every class that fits, or: none of the above"
CLASS_NAMES = {"toxic": "toxic", "low_quality": "low quality", "exclaim": "exclamation",
               "mention": "mention", "digits": "digits", "long_text": "long text"}
# --------------------------------------------------------------------------
_CLASSES = ", ".join(CLASS_NAMES.values())


@query("prompt_target", f"""
WITH lab AS ({S.LABELLED_SQL}),
t AS (SELECT id, text,
  list_filter([{", ".join(f"CASE WHEN {l} = 1 THEN '{n}' END" for l, n in CLASS_NAMES.items())}],
              lambda x: x IS NOT NULL) AS picked,
  [{", ".join(S.LABELS)}] AS bin
  FROM lab)
SELECT id,
  replace(replace('{TEMPLATE.replace("'", "''")}', '{{classes}}', '{_CLASSES}'), '{{main_tweet}}', text) AS prompt,
  CASE WHEN len(picked) > 0 THEN array_to_string(picked, ', ') ELSE 'none of the above' END AS target,
  array_to_string(bin, ',') AS binary_target
FROM t
""")
def prompt_target(spark, sf):
    lab = S.labelled(spark, sf)
    prompt = X.fill_template(TEMPLATE.replace("{classes}", _CLASSES), main_tweet="text")
    target = X.target_text(list(CLASS_NAMES), list(CLASS_NAMES.values()))
    return lab.select("id", prompt.alias("prompt"), target.alias("target"),
                      F.array_join(X.binary_vector(S.LABELS).cast("array<string>"), ",").alias("binary_target"))


_DEFINITIONS = {"toxic": "Rude or hateful words.", "low quality": "Little that is worth reading; it's filler.", "exclamation": "It shouts!"}


def _prompt_sql(prompt_type):
    q = lambda x: "'" + x.replace("'", "''") + "'"
    block = "\n".join(f"{n}: {d}" for n, d in _DEFINITIONS.items())
    return (f"replace(replace(replace({q(X.PROMPTS[prompt_type])}, '{{fallacies}}', {q(_CLASSES)}), "
            f"'{{fallacy_def_text}}', {q(block)}), '{{main_tweet}}', text)")


@query("prompt_records", f"""
WITH lab AS ({S.LABELLED_SQL}),
t AS (SELECT *, list_filter([{", ".join(f"CASE WHEN {l} = 1 THEN '{n}' END" for l, n in CLASS_NAMES.items())}], lambda x: x IS NOT NULL) AS picked FROM lab),
r AS ({" UNION ALL ".join(f"SELECT '{p}' AS prompt_type, {_prompt_sql(p)} AS input, picked, [{', '.join(S.LABELS)}] AS bin FROM t" for p in X.PROMPTS)})
SELECT prompt_type, md5(input) AS input_md5, CASE WHEN len(picked) > 0 THEN array_to_string(picked, ', ') ELSE 'none of the above' END AS target,
       array_to_string(bin, ',') AS binary_target FROM r
""")
def prompt_records(spark, sf):
    """Training files of JSON lines, a folder per prompt type, written and read back."""
    from convgraph.session import scratch_path
    from convgraph.sources import io as SIO
    lab, path, out = S.labelled(spark, sf), scratch_path(spark, "prompts"), None
    for prompt_type in X.PROMPTS:
        folder = f"{path}/prompt_type_{prompt_type}"
        SIO.write_jsonl(lab.select(X.prompt_record(prompt_type, CLASS_NAMES, S.NONE_LABEL, _DEFINITIONS, "text").alias("translation")), folder)
        back = SIO.read_jsonl(spark, folder, "translation struct<input: string, target: string, binary_target: array<int>>")
        rows = back.select(F.lit(prompt_type).alias("prompt_type"), F.md5("translation.input").alias("input_md5"), "translation.target",
                           F.array_join(F.col("translation.binary_target").cast("array<string>"), ",").alias("binary_target"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("decode_target", f"""
WITH lab AS ({S.LABELLED_SQL}),
t AS (SELECT id, CASE WHEN len(picked) > 0 THEN array_to_string(picked, ', ') ELSE 'none of the above' END AS target
      FROM (SELECT id, list_filter([{", ".join(f"CASE WHEN {l} = 1 THEN '{n}' END" for l, n in CLASS_NAMES.items())}],
                                   lambda x: x IS NOT NULL) AS picked FROM lab)),
b AS (SELECT id, [{", ".join(f"CAST(contains(lower(target), '{n}') AS INTEGER)" for n in list(CLASS_NAMES.values()) + ['none of the above'])}] AS bin FROM t)
SELECT id, array_to_string(bin, ',') AS predicted_binary,
       array_to_string(list_filter([{", ".join(f"CASE WHEN bin[{i + 1}] = 1 THEN '{l}' END" for i, l in enumerate(S.LABELS))}],
                                   lambda x: x IS NOT NULL), '|') AS predicted_labels
FROM b
""")
def decode_target(spark, sf):
    """X19 + X20: text answer -> 0/1 vector by substring -> label names."""
    lab = S.labelled(spark, sf)
    target = X.target_text(list(CLASS_NAMES), list(CLASS_NAMES.values()))
    vec = X.binary_from_text(target, list(CLASS_NAMES.values()) + ["none of the above"])
    t = lab.select("id", vec.alias("bin"))
    return t.select("id", F.array_join(F.col("bin").cast("array<string>"), ",").alias("predicted_binary"),
                    F.array_join(X.labels_from_vector("bin", S.LABELS), "|").alias("predicted_labels"))


# ---------------------------------------------------------------- X23 / P14
@query("truncate_tokens", f"""
WITH lab AS ({S.LABELLED_SQL}),
t AS (SELECT id, list_filter(regexp_split_to_array(text, '{_PY_WS}+'), lambda x: x <> '') AS toks FROM lab)
SELECT id, CAST(len(toks) AS INTEGER) AS n_tokens, len(toks) > 128 AS truncated,
       array_to_string(toks[1:128], ' ') AS main_text
FROM t
""")
def truncate_tokens(spark, sf):
    lab = S.labelled(spark, sf)
    txt, flag = X.truncate_tokens("text", 128)
    return lab.select("id", X.word_count("text").alias("n_tokens"), flag.alias("truncated"),
                      txt.alias("main_text"))


#: Token limits of posts, of posts with context, of long inputs and of answers.
_LIMITS = (128, 512, 1024, 64)


@query("truncate_limits", f"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{_PY_WS}+'), lambda x: x <> '') AS toks FROM documents)
SELECT doc_id, {", ".join(f"len(toks) > {n} AS cut_{n}, md5(array_to_string(toks[1:{n}], ' ')) AS text_{n}" for n in _LIMITS)} FROM t
""")
def truncate_limits(spark, sf):
    """Every document cut at each of the limits in use."""
    d, cols = S.table(spark, sf, "documents"), []
    for n in _LIMITS:
        txt, flag = X.truncate_tokens("text", n)
        cols += [flag.alias(f"cut_{n}"), F.md5(txt).alias(f"text_{n}")]
    return d.select("doc_id", *cols)


# ---------------------------------------------------------------- J10 + P13 + P9 + P16
@query("annotation_join", _ANN_SQL + f"""
, o AS (SELECT id, {", ".join(f"CAST(list_contains(choices, '{l}') AS INTEGER) AS {l}" for l in S.LABELS)} FROM p)
SELECT o.*, d.source, d.lang, d.n_chars,
       nullif(d.text, '') AS post_text,
       coalesce(d.source, '') || coalesce(d.lang, '') AS source_lang
FROM o LEFT JOIN documents d ON o.id = d.doc_id
""")
def annotation_join(spark, sf):
    """Annotations (one-hot, A28) left-joined to the posts, keeping named
    columns; text columns dropped by pattern (P13); '' -> NULL (P9); a
    null-safe concatenation (P16)."""
    from convgraph.operators import relations as R
    a = annotations(spark, sf).select("id", X.annotation_choices("fallacy").alias("choices"))
    o = a.select("id", *[F.array_contains("choices", l).cast("int").alias(l) for l in S.LABELS])
    d = S.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", "lang", "n_chars",
                                               F.col("text").alias("raw_text"))
    j = o.join(d, "id", "left")
    j = j.withColumn("post_text", R.empty_to_null("raw_text")) \
         .withColumn("source_lang", R.concat_null_safe("source", "lang"))
    return R.drop_like(j, fragment="raw_text")


# ---------------------------------------------------------------- X10 / X11 + A23
@query("emoji_frequency", f"""
WITH t AS (SELECT unnest(regexp_extract_all(text, '({X.EMOJI_TOKEN})', 1)) AS element FROM documents)
SELECT element, count(*) AS frequency FROM t GROUP BY element
""")
def emoji_frequency(spark, sf):
    """Emojis (flags, tone and gender modifiers kept together) by frequency."""
    from convgraph.operators import elements as E
    d = S.table(spark, sf, "documents").select(X.extract_emojis("text").alias("emojis"))
    return E.frequencies(d, "emojis")


@query("mention_frequency", r"""
WITH t AS (SELECT unnest(regexp_extract_all(text, '@([A-Za-z0-9_.]+)', 1)) AS m FROM documents)
SELECT lower(regexp_replace(m, '[^a-zA-Z0-9]', '', 'g')) AS element, count(*) AS frequency FROM t GROUP BY 1
""")
def mention_frequency(spark, sf):
    """Mentions cleaned to lower-case alphanumerics (X11), by frequency."""
    from convgraph.operators import elements as E
    d = S.table(spark, sf, "documents").select(
        X.lower_alnum(F.regexp_extract_all("text", F.lit(r"@([A-Za-z0-9_.]+)"), 1)).alias("mentions"))
    return E.frequencies(d, "mentions")


# ---------------------------------------------------------------- X1, X2, X4-X10, X14 on texts that need them
#: (what stands before a text, what cleaning makes of it, emojis in it)
_DRESSES = [
    ("RT @abc: hi x", " hi x", []),
    ("see https://ex.org/a?b=1&c x", "see x", []),
    ("“a” it’s ‘b’   x", "\"a\" it's 'b' x", []),
    ("Tom &amp; J&eacute;r&ocirc;me &lt;3 &#128512;\tx", "Tom & Jerome <3 😀 x", []),
    ("☆✓🂡🧀 👇🏿€x", "🧀 👇🏿x", ["🧀", "👇🏿"]),
    ("\xa0\n\\ a b\x0bx", " a b x", []),
    ("🤦🏼♀🤷♀ 🇫🇷🇩🇪🇫 🏿 1# x", "🤦🏼♀🤷♀ 🇫🇷🇩🇪🇫 🏿 1# x", ["🤦🏼♀", "🤷♀", "🇫🇷", "🇩🇪", "🏿"]),
    ("♥❤️©→ ½ x", "♥❤© 12 x", ["♥", "❤", "©"]),
]


def _dressed(spark, sf):
    d = S.table(spark, sf, "documents")
    k = (F.col("doc_id") % len(_DRESSES) + 1).cast("int")
    return d.select("doc_id", "text", F.element_at(F.lit([x[0] for x in _DRESSES]), k).alias("dress"))


def _by_doc(values) -> str:
    return f"[{', '.join(values)}][doc_id % {len(_DRESSES)} + 1]"


def _sql_text(x: str) -> str:
    return " || ".join(f"chr({ord(c)})" if ord(c) > 126 or ord(c) < 32 or c == "'" else f"'{c}'" for c in x) or "''"


@query("clean_dressed", f"""
SELECT doc_id, {_by_doc(_sql_text(x[1]) for x in _DRESSES)} || {_CLEAN_SQL.replace('__C__', "('x' || text)")}[2:] AS clean FROM documents
""")
def clean_dressed(spark, sf):
    """Texts behind retweet marks, links, quotes, entities, accents, escapes,
    emojis and signs that are none."""
    return _dressed(spark, sf).select("doc_id", X.clean_text(F.concat("dress", "text")).alias("clean"))


@query("emoji_extract", f"""
SELECT doc_id, {_by_doc(_sql_text("|".join(x[2])) for x in _DRESSES)} AS emojis FROM documents
""")
def emoji_extract(spark, sf):
    """Emojis of the dressed texts in order; the documents themselves have none."""
    d = _dressed(spark, sf)
    return d.select("doc_id", F.array_join(X.extract_emojis(F.concat("dress", "text")), "|").alias("emojis"))


_MENTIONS = [("", ""), ("@a @b_2 @ünal x", "@user @user @user x"), ("@a @b  @c\n@d x", "@user @user ... @user x"),
             ("hi @a@b@c @d @e @f x", "hi @user @user ... @user x")]


@query("mask_runs", f"""
SELECT doc_id, [{", ".join(_sql_text(b) for _a, b in _MENTIONS)}][doc_id % {len(_MENTIONS)} + 1]
  || regexp_replace(regexp_replace(text, '@[\\pL\\pN_]+\\s?', '@user ', 'g'),
                    '(@user\\s*){{4,}}', '@user @user ... @user ', 'g') AS masked FROM documents
""")
def mask_runs(spark, sf):
    """Runs of mentions: four or more are shortened, three are not."""
    d = S.table(spark, sf, "documents")
    before = F.element_at(F.lit([a for a, _b in _MENTIONS]), (F.col("doc_id") % len(_MENTIONS) + 1).cast("int"))
    return d.select("doc_id", X.mask_mentions(F.concat(before, "text")).alias("masked"))

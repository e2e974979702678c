"""The registered queries of the corpus operators and their DuckDB SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from convgraph.llm import exact_dedup as _exact
from convgraph.llm.bpe_duckdb import decode, encode
from convgraph.llm.chat_windows import chat_windows, read_back
from convgraph.llm.common import table
from convgraph.llm.disclosure import KINDS, private_spans, written
from convgraph.llm.html_lstm import extract
from convgraph.llm import merkle as _merkle
from convgraph.llm.minhash_hamming import near_dedup
from convgraph.llm.packing import pack
from convgraph.llm.quality_ledger import BIT, apply_policy, ledger
from convgraph.llm.substring_dedup import substring_dedup
from convgraph.llm.token_counts import token_counts
from convgraph.llm.tokenizer_alignment import tokenizer_alignment
from convgraph.llm import toxicity_chain as _toxicity

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


@query("op1_packing")
def op1_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


@query("op2_token_counts")
def op2_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))


@query("op3_html_lstm")
def op3_html_lstm(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))


@query("op4_bpe_duckdb")
def op4_bpe_duckdb(spark, sf_dir):
    return (decode(encode(table(spark, sf_dir, "documents")))
            .select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                    F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")))


@query("op5_exact_dedup", r"""
    WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
    FROM t WINDOW w AS (PARTITION BY norm)""")
def op5_exact_dedup(spark, sf_dir):
    return _exact.exact_dedup(table(spark, sf_dir, "documents"))


@query("op6_substring_dedup")
def op6_substring_dedup(spark, sf_dir):
    return (substring_dedup(table(spark, sf_dir, "documents"))
            .select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")))


@query("op7_quality_ledger")
def op7_quality_ledger(spark, sf_dir):
    base = BIT["few_words"] | BIT["repeated_windows"]
    return (apply_policy(ledger(table(spark, sf_dir, "documents")), "v2")
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    (F.col("failed").bitwiseAND(F.lit(base)) != 0).alias("base_failed"), "kept", "failed"))


@query("op8_minhash_hamming")
def op8_minhash_hamming(spark, sf_dir):
    return near_dedup(table(spark, sf_dir, "documents"))


@query("op9_chat_windows")
def op9_chat_windows(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)],
                                  "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(chat_windows(rows))


@query("op10_toxicity_chain")
def op10_toxicity_chain(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return _toxicity.score(docs, _toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query("op11_tokenizer_alignment")
def op11_tokenizer_alignment(spark, sf_dir):
    return tokenizer_alignment(table(spark, sf_dir, "documents"))[0]


@query("op12_pii_disclosure")
def op12_pii_disclosure(spark, sf_dir):
    found = private_spans(table(spark, sf_dir, "documents"))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in KINDS],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.concat("base", "added")).alias("spans"))


def _merkle_sql(levels: int = 9, tree_levels: int = 4) -> str:
    """The manifest with one CTE a level (up to 8 ** levels rows a language)."""
    def field(c):
        return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"

    def leaf(text="text"):
        return "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = ("xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), "
           "lambda c: list_prepend(ord(c)::BIGINT, repeat([-1::BIGINT], 8))))), lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) "
           "WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)")
    ctes = [f"""leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM (
        SELECT doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS tree, {leaf()} AS leaf,
               CASE WHEN {crc} % 3 = 0 THEN {leaf(lower)} ELSE {leaf()} END AS shown FROM documents))""",
            "a0 AS (SELECT tree, pos, leaf AS digest FROM leaves)"]

    def climb(a, s, n):
        for k in range(n):
            ctes.append(f"""{s}{k} AS (SELECT tree, pos, digest, count(*) OVER (PARTITION BY tree) > 1 AS hashed,
                coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
                FROM {a}{k} WINDOW run AS (PARTITION BY tree, pos // 8 ORDER BY pos))""")
            ctes.append(f"""{a}{k + 1} AS (SELECT tree, pos // 8 AS pos, CASE WHEN bool_or(hashed)
                THEN sha256(string_agg(digest, '' ORDER BY pos)) ELSE min(digest) END AS digest
                FROM {s}{k} GROUP BY tree, pos // 8)""")
    climb("a", "s", levels)
    ctes.append(f"""b0 AS (SELECT 0 AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, digest, tree AS lang
                FROM a{levels})""")
    climb("b", "t", tree_levels)
    ctes.append("""f0 AS (SELECT f.*, b0.pos AS tree_pos, b0.digest AS subroot, shown AS folded, '' AS proof
                FROM leaves f JOIN b0 ON b0.lang = f.tree)""")
    for k in range(levels + tree_levels):
        s, on = (f"s{k}", f"s.tree = f.tree AND s.pos = f.pos // {8 ** k}") if k < levels else (
            f"t{k - levels}", f"s.pos = f.tree_pos // {8 ** (k - levels)}")
        ctes.append(f"""f{k + 1} AS (SELECT f.* REPLACE (
                CASE WHEN hashed THEN sha256(l || folded || r) ELSE folded END AS folded,
                CASE WHEN hashed THEN proof || l || r ELSE proof END AS proof) FROM f{k} f JOIN {s} s ON {on})""")
    return "WITH " + ", ".join(ctes) + f"""
        SELECT doc_id, leaf, subroot, (SELECT digest FROM b{tree_levels}) AS root, sha256(proof) AS proof_sha256,
               folded AS folded_root, folded = (SELECT digest FROM b{tree_levels}) AS verified
        FROM f{levels + tree_levels}"""


@query("op13_merkle_manifest", _merkle_sql())
def op13_merkle_manifest(spark, sf_dir):
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    shown = F.when(tampered, _merkle.leaf(text=lower)).otherwise(_merkle.leaf())
    folded = _merkle.fold(F.col("shown"), F.col("proof"))
    return (_merkle.manifest(table(spark, sf_dir, "documents"), shown=shown)
            .select("doc_id", "leaf", "subroot", "root", F.sha2(_merkle.siblings(F.col("proof")), 256).alias("proof_sha256"),
                    folded.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))

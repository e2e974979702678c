"""Quality rules: a rule bitmask ledger.

``ledger`` evaluates every rule once per text and stores the measurements and
one long whose bit i says that the text fails rule i.  Policies are versioned
sets of rules; ``apply_policy`` keeps a row if (failed & policy) = 0, and
``ablation`` gives for each rule of a policy the rows that fail it, the rows
that fail it alone and the rows that stay without it, by bitwise aggregation
over the ledger and without touching the texts again.

The measurements are taken per batch with numpy (see ``common``): one pass,
no shuffle; memory is one slice of about 2 MB of text, one text at least.
Words and lines are equal if their bytes are: hashes only bring them together.

Defined results: a null text has no words, so it fails rule 0 only; repeated
rows are measured row by row; an empty table gives an empty ledger.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from convgraph.llm.common import exact_ids, id_text, mix, text_slices, word_hashes, word_spans

SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters",
            "n_upper", "n_bangs")

#: Rule i sets bit i of ``failed``.  New rules go to the end.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("upper_case", "n_letters >= 20 AND 100 * n_upper > 60 * n_letters"),
    ("exclamations", "10 * n_bangs > 3 * n_words AND n_words > 0"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines"),
    "v2": tuple(name for name, _ in RULES),
}


def policy_mask(policy) -> int:
    names = POLICIES[policy] if isinstance(policy, str) else policy
    return sum(BIT[n] for n in set(names))


def measure(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """The MEASURES of each text of a slice."""
    rows, n = len(offs) - 1, len(data)

    def per_row(flags):
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[offs[1:]] - total[offs[:-1]]

    starts, ends, first = word_spans(data, offs)
    words = word_hashes(data, starts, ends)
    n_words = np.diff(first)
    inside = np.zeros(n + 1, dtype=np.int8)
    inside[starts] += 1
    np.subtract.at(inside, ends, 1)
    word_chars = per_row((np.cumsum(inside[:n]) > 0) & ((data & 0xC0) != 0x80))
    is_symbol = np.zeros(256, dtype=bool)
    is_symbol[list(SYMBOLS)] = True
    upper = (data >= 65) & (data <= 90)
    letters = upper | ((data >= 97) & (data <= 122))

    # words inside 3-word windows that occur twice or more in their text; the
    # words of a text are numbered, so windows are compared without a hash
    row = np.repeat(np.arange(rows), n_words)
    covered = np.zeros(len(words) + 1, dtype=np.int32)
    if len(words) >= 3:
        number, bound = exact_ids(data, starts, ends, mix(words ^ mix(row.astype(np.uint64) + np.uint64(1))), row)
        same = np.flatnonzero(row[:-2] == row[2:])
        keys = number[same] * bound + number[same + 1]
        if bound >= 1 << 20:  # three numbers do not fit into 63 bits
            keys = np.unique(keys, return_inverse=True)[1]
        _, back, times = np.unique(keys * bound + number[same + 2], return_inverse=True, return_counts=True)
        twice = same[times[back] > 1]
        covered[twice] += 1
        np.subtract.at(covered, twice + 3, 1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
    n_repeat = covered[first[1:]] - covered[first[:-1]]

    # lines with a word that equal an earlier line of their text
    if n:
        cut = np.unique(np.concatenate([offs[:-1], np.flatnonzero(data == 10) + 1]))
        cut = cut[cut < n]
        stop = np.append(cut[1:], n)
        stop = stop - (data[stop - 1] == 10)
        worded = np.searchsorted(starts, stop) > np.searchsorted(starts, cut)
        a, z = cut[worded], stop[worded]
        line_row = np.searchsorted(offs, a, side="right") - 1
        keys = mix(word_hashes(data, a, z) ^ mix(line_row.astype(np.uint64) + np.uint64(1)))
        _, at = np.unique(exact_ids(data, a, z, keys, line_row)[0], return_index=True)
        n_lines = np.bincount(line_row, minlength=rows)
        n_dup = n_lines - np.bincount(line_row[at], minlength=rows)
    else:
        n_lines = n_dup = np.zeros(rows, dtype=np.int64)
    return [n_words, word_chars, per_row(is_symbol[data]), n_dup, n_repeat, n_lines, per_row(letters),
            per_row(upper), per_row(data == 33)]


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, measurements, failed long): one row per input row."""
    rows = id_text(docs, id_col, text_col)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for lo, hi, data, offs in text_slices(batch):
                cols = [pa.array(np.asarray(c).astype(np.int64)) for c in measure(data, offs)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], *cols], names=["id", *MEASURES])
    kind = rows.schema["id"].dataType.simpleString()
    measured = rows.mapInArrow(run, ", ".join([f"id {kind}", *[f"{m} long" for m in MEASURES]]))
    bits = " + ".join(f"if({rule}, {BIT[name]}L, 0L)" for name, rule in RULES)
    return measured.withColumn("failed", F.expr(bits)).withColumnRenamed("id", id_col)


def apply_policy(rows: DataFrame, policy="v2") -> DataFrame:
    """Adds ``kept``: the row fails no rule of the policy."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(policy_mask(policy))) == 0)


def ablation(rows: DataFrame, policy="v2") -> DataFrame:
    """Per rule of the policy: (rule, n_rows, n_failed, n_failed_alone,
    n_kept, n_kept_without).  One aggregation over the ledger."""
    mask = policy_mask(policy)
    names = [n for n, _ in RULES if BIT[n] & mask]
    bad = F.col("failed").bitwiseAND(F.lit(mask))

    def count(cond):
        return F.coalesce(F.sum(cond.cast("long")), F.lit(0).cast("long"))
    per_rule = F.array(*[F.struct(
        F.lit(n).alias("rule"), F.count(F.lit(1)).alias("n_rows"),
        count(bad.bitwiseAND(F.lit(BIT[n])) != 0).alias("n_failed"),
        count(bad == BIT[n]).alias("n_failed_alone"), count(bad == 0).alias("n_kept"),
        count(bad.bitwiseAND(F.lit(mask & ~BIT[n])) == 0).alias("n_kept_without")) for n in names])
    return rows.agg(per_rule.alias("r")).select(F.inline("r"))

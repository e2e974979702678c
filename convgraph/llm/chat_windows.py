"""Chat formatting: budgeted windows.

A conversation becomes one or more training windows.  Prefix sums of the
tokens of its formatted turns choose turn-aligned spans: from the first new
turn, the largest number of turns whose prefix-sum difference fits what the
budget leaves beside the retained system turn and the repeated history.  Every
window after the first starts with the system turn and at most
``history_turns`` turns (and ``history_tokens`` tokens) from before the span;
these repeats carry no loss.  The loss mask covers the texts of new assistant
turns and nothing else, so each one is trained on exactly once.

Template: ``<|role|>\\n`` + text + ``</s>\\n`` per turn.  Control strings inside
a text (``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``, ``<<SYS>>``,
``<</SYS>>``) get a backslash after their first character, one more than they
had, which ``unescape`` takes away again; roles are percent-encoded.

Conversations are cut into segments of ``segment`` consecutive turn numbers
that are formatted independently (windows do not cross them), so a
conversation of any length spreads over tasks; the turns that a segment may
repeat as history are sent to it as well.

Defined results: null texts and roles are empty; a null turn comes last; turns
with the same number are ordered by role, then text, and identical rows are
all kept; a turn larger than the budget is a window of its own, never cut;
rows with a null conversation id are one conversation; an empty table gives an
empty table.
"""
from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from convgraph.llm.common import worker_cache
from convgraph.llm.token_counts import TokenCounter, vocabulary_path

BUDGET, HISTORY_TURNS, HISTORY_TOKENS, SEGMENT = 2048, 2, 512, 1024
OPEN, CLOSE, END = "<|", "|>\n", "</s>\n"

_CONTROL = re.compile(r"([<\[])(\\*)(\||/?s>|/?INST\]|/?SYS>)")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(\||/?s>|/?INST\]|/?SYS>)")
_TURN = re.compile(r"<\|([^|]*)\|>\n(.*?)</s>\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def head(role: str) -> str:
    return f"{OPEN}{quote(role, safe='')}{CLOSE}"


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted window."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        out.append((unquote(m.group(1)), unescape(m.group(2))))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"not a formatted window at character {at}")
    return out


def plan(sizes: list[int], system: int, budget: int, history_turns: int, history_tokens: int,
         lead: int = 0) -> list[tuple[int, int, int]]:
    """Windows over turns of the given token sizes: (first repeated turn, first
    new turn, end).  ``system``: tokens of the retained system turn; the first
    ``lead`` turns are history only."""
    prefix = [0, *accumulate(sizes)]
    out, at = [], lead
    while at < len(sizes):
        back = at
        while back > 0 and at - back < history_turns and prefix[at] - prefix[back - 1] <= history_tokens:
            back -= 1
        while back < at and system + prefix[at + 1] - prefix[back] > budget:
            back += 1  # the next turn comes before the history
        end = bisect_right(prefix, prefix[back] + budget - system) - 1
        end = max(end, at + 1)
        out.append((back, at, end))
        at = end
    return out


def window_rows(turns: list[dict], system: dict | None, opening: bool, lead: int, settings) -> list[dict]:
    """Formatted windows of one segment.  ``turns``: role, text, tokens in
    order; ``opening``: the segment starts the conversation, so the system
    turn, if any, is its first turn."""
    budget, history_turns, history_tokens = settings
    out = []
    cost = system["tokens"] if system else 0
    own_system = opening and system is not None
    body = turns[1:] if own_system else turns
    spans = plan([t["tokens"] for t in body], cost, budget, history_turns, history_tokens, lead)
    if own_system and not spans:
        spans = [(0, 0, 0)]
    for number, (back, first, end) in enumerate(spans):
        parts, at, loss = [], 0, []
        shown = ([system] if system else []) + body[back:end]
        repeated = first - back + (1 if system and not (own_system and number == 0) else 0)
        for i, t in enumerate(shown):
            opened, text = head(t["role"]), escape(t["text"])
            if i >= repeated and t["role"] == "assistant":
                loss.append((at + len(opened), at + len(opened) + len(text)))
            parts.append(opened + text + END)
            at += len(parts[-1])
        out.append({"formatted": "".join(parts), "n_turns": len(shown), "n_repeated": repeated,
                    "loss_start": [a for a, _ in loss], "loss_end": [b for _, b in loss],
                    "n_tokens": sum(t["tokens"] for t in shown)})
    return out


WINDOW_SCHEMA = ("conv_id long, segment long, window long, formatted string, n_turns long, n_repeated long, "
                 "loss_start array<int>, loss_end array<int>, n_tokens long")


def chat_windows(rows: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS,
                 history_tokens: int = HISTORY_TOKENS, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, segment, window, formatted, n_turns, n_repeated, loss_start,
    loss_end, n_tokens): loss spans are code point offsets into ``formatted``,
    the first ``n_repeated`` turns of a window repeat earlier ones."""
    import public_tokenizers
    path, pattern = vocabulary_path(), public_tokenizers.PATTERN

    @F.pandas_udf("long")
    def tokens(role: pd.Series, text: pd.Series) -> pd.Series:
        box = worker_cache(f"counter-{path}")
        if "counter" not in box:
            box["counter"] = TokenCounter(path, pattern)
        counter = box["counter"]
        counter.trim()
        return pd.Series([counter(head(r) + escape(t) + END) for r, t in zip(role, text)], dtype="int64")

    last = F.lit(2 ** 62)
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"),
                        F.coalesce(F.col("turn").cast("long"), last).alias("turn"),
                        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")) \
        .withColumn("tokens", tokens("role", "text")) \
        .withColumn("segment", F.floor(F.col("turn") / segment))
    start = turns.groupBy("conv_id").agg(F.min(F.struct("turn", "role", "text", "tokens")).alias("first"))
    # kind 0: the conversation's first turn, 1: history from the segment before, 2: turn of the segment
    after = turns.where((F.col("turn") < last) & (F.col("turn") % segment >= segment - history_turns)) \
        .withColumn("segment", F.col("segment") + 1)
    body = turns.withColumn("kind", F.lit(2)).unionByName(after.withColumn("kind", F.lit(1)))
    segments = turns.select("conv_id", "segment").distinct()
    firsts = segments.join(start.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))) \
        .select("conv_id", "first.turn", "first.role", "first.text", "first.tokens", "segment", F.lit(0).alias("kind"))

    def build(key, pdf):
        pdf = pdf.sort_values(["kind", "turn", "role", "text"], kind="stable")
        records = pdf[["kind", "turn", "role", "text", "tokens"]].to_dict("records")
        first, rest = records[0], records[1:]
        history = [t for t in rest if t["kind"] == 1][-history_turns:] if history_turns else []
        mine = [t for t in rest if t["kind"] == 2]
        if not mine:  # only history came: the segment has no turn of its own
            return pd.DataFrame(columns=[f.split()[0] for f in WINDOW_SCHEMA.split(", ")])
        opening = (first["turn"], first["role"], first["text"]) == (mine[0]["turn"], mine[0]["role"], mine[0]["text"]) \
            and first["turn"] // segment == key[1]
        system = first if first["role"] == "system" else None
        if system is not None:
            history = [t for t in history if (t["turn"], t["role"], t["text"]) !=
                       (system["turn"], system["role"], system["text"])]
        made = window_rows(history + mine, system, opening, len(history), (budget, history_turns, history_tokens))
        out = pd.DataFrame(made)
        out.insert(0, "conv_id", pd.Series([None if pd.isna(key[0]) else int(key[0])] * len(out), dtype="Int64"))
        out.insert(1, "segment", int(key[1]))
        out.insert(2, "window", range(len(out)))
        return out
    return body.unionByName(firsts).groupBy("conv_id", "segment").applyInPandas(build, WINDOW_SCHEMA)


def read_back(windows: DataFrame) -> DataFrame:
    """One row per conversation, from the windows alone: (conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars).  The windows of a
    conversation are sorted in one task and hashed as a stream."""
    def run(batches):
        import hashlib
        import pyarrow as pa
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        done, held, current = [], None, None

        def close():
            if held is not None:
                done.append((current, held["n"], held["turns"].hexdigest(), held["chars"], held["loss"].hexdigest(),
                             held["formatted"]))

        def table():
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            cols = list(zip(*done)) if done else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names)
        for batch in batches:
            for w in batch.to_pylist():
                if held is None or w["conv_id"] != current:
                    close()
                    current = w["conv_id"]
                    held = {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "formatted": 0}
                text = w["formatted"]
                held["formatted"] += len(text)
                for role, said in parse(text)[w["n_repeated"]:]:
                    held["n"] += 1
                    held["turns"].update(f"{role}\n{said}\n".encode())
                for a, b in zip(w["loss_start"], w["loss_end"]):
                    said = unescape(text[a:b])
                    held["chars"] += len(said)
                    held["loss"].update(said.encode())
            if len(done) > 5000:
                yield table()
                done = []
        close()
        yield table()
    return (windows.select("conv_id", "segment", "window", "formatted", "n_repeated", "loss_start", "loss_end")
            .repartition("conv_id").sortWithinPartitions("conv_id", "segment", "window")
            .mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                             "loss_sha256 string, formatted_chars long"))

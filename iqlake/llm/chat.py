r"""Chat formatting in budgeted windows.

A conversation becomes windows of at most ``budget`` tokens. Prefix sums of the turns' tokens choose turn-aligned spans: a
long conversation is first cut into stretches by its prefix sum, so that no task ever gathers it whole, and a stretch is
then filled window by window. Every window repeats the system turn, then a limited history of the turns before it, then its
new turns. Only the texts of new assistant turns carry loss; repeated ones are masked.

Template: ``<|im_start|>role\ntext<|im_end|>\n`` for each turn. Inside texts and roles a backslash goes between the ``<`` and
``|`` of anything that could read as a control string (one more where there are some), which ``unescape`` takes out again.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from iqlake.llm.common import Scratch, _same

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
BUDGET, HISTORY, HISTORY_TURNS = 2048, 512, 4
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turn(role: str, text: str) -> tuple[str, int]:
    """The formatted turn, and where its text begins."""
    head = f"{OPEN}{escape_role(role)}\n"
    return f"{head}{escape(text)}{CLOSE}\n", len(head)


def read_window(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn of a formatted window; start and end bound the escaped text."""
    out, pos = [], 0
    while pos < len(text):
        if not text.startswith(OPEN, pos):
            raise ValueError("not a formatted window")
        line = text.index("\n", pos)
        end = text.index(CLOSE, line)
        out.append((unescape_role(text[pos + len(OPEN) : line]), unescape(text[line + 1 : end]), line + 1, end))
        pos = end + len(CLOSE) + 1
    return out


def _count_tokens(ranks_path: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            texts = [format_turn(r, t)[0] for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(encoding.encode_ordinary(t)) for t in texts], pa.int64())], names=["conv", "turn", "role", "text", "tokens"])

    return run


def _windows(budget: int, history: int, history_turns: int):  # noqa: ANN202
    """For sorted rows (conv, stretch, pos, context, is_system, role, text, tokens): the windows of each stretch."""

    def window(conv: object, stretch: int, k: int, context: list, new: list) -> tuple:
        text, starts, ends, at = [], [], [], 0
        for i, (_, role, body, _) in enumerate(context + new):
            turn, head = format_turn(role, body)
            if i >= len(context) and role == "assistant":
                starts.append(at + head)
                ends.append(at + len(turn) - len(CLOSE) - 1)
            text.append(turn)
            at += len(turn)
        return conv, stretch, k, new[0][0], len(context), len(new), sum(x[3] for x in context + new), "".join(text), starts, ends

    def fill(conv: object, stretch: int, system: tuple | None, before: list, turns: list) -> Iterator[tuple]:
        new: list = []
        context: list = []
        used = k = 0
        for t in turns:
            if new and used + t[3] > budget:
                yield window(conv, stretch, k, context, new)
                k += 1
                before = (before + new)[-history_turns:]
                new = []
            if not new:
                is_first = system is not None and t[0] == system[0]
                context = [] if system is None or is_first else [system]
                used = sum(x[3] for x in context)
                spare = min(history, budget - used - t[3])
                tail: list = []
                for x in reversed(before[-history_turns:] if history_turns else []):
                    if x[3] > spare or (system is not None and x[0] == system[0]):
                        break
                    tail.insert(0, x)
                    spare -= x[3]
                context = context + tail
                used += sum(x[3] for x in tail)
            new.append(t)
            used += t[3]
        if new:
            yield window(conv, stretch, k, context, new)

    names = ["conv", "stretch", "window", "first_turn", "n_context", "n_new", "n_tokens", "text", "loss_starts", "loss_ends"]
    kinds = [None, pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, system, before, turns, conv_type = None, None, [], [], None

        def flush() -> None:
            if key is not None:
                out.extend(fill(key[0], key[1], system, before, turns))

        def pack() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k or conv_type) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            conv_type = batch.schema.field(0).type
            for conv, stretch, pos, context, is_system, role, text, tokens in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key is None or key != (conv, stretch):
                    flush()
                    key, system, before, turns = (conv, stretch), None, [], []
                    if len(out) >= 500:
                        yield pack()
                        out = []
                turn = (pos, role, text, tokens)
                if is_system:
                    system = turn
                if not context:
                    turns.append(turn)
                elif not is_system:
                    before.append(turn)
        flush()
        if out:
            yield pack()

    return run


def chat_windows(df: DataFrame, ranks_path: str, budget: int = BUDGET, history: int = HISTORY, history_turns: int = HISTORY_TURNS) -> DataFrame:
    """Windows (conv_id, stretch, window, first_turn, n_context, n_new, n_tokens, text, loss_starts, loss_ends) of ``df`` (conv_id, turn, role, text).

    In code points of ``text``, loss_starts and loss_ends bound what carries loss. Turns go by turn, ties by role and text;
    a null turn comes first, null texts and roles are empty, rows with a null conv_id are one conversation, repeated rows are
    turns of their own. The system turn is a first turn with role system. A turn longer than the budget gets a window of its
    own, after the system turn, and is the only case of more tokens than ``budget``. Other columns are not read.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "chat")
    kind = df.schema["conv_id"].dataType.simpleString()
    rows = df.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("_", F.lit(0)).drop("_").mapInArrow(_count_tokens(ranks_path), f"conv {kind}, turn long, role string, text string, tokens long")
    rows = scratch.save(rows, "turns")
    # Two levels of prefix sums: within stretches of turn numbers, then over stretches.
    part = F.coalesce(F.floor(F.col("turn") / 256), F.lit(-(2**62)))
    rows = rows.withColumn("part", part)
    order = Window.partitionBy("conv", "part").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    totals = rows.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("s"))
    over = Window.partitionBy("conv").orderBy("part")
    totals = totals.select("conv", "part", (F.sum("n").over(over) - F.col("n")).alias("n0"), (F.sum("s").over(over) - F.col("s")).alias("s0"))
    rows = rows.withColumn("p", F.row_number().over(order) - 1).withColumn("s", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
    rows = _same(rows, totals, ["conv", "part"]).select("conv", (F.col("p") + F.col("n0")).cast("long").alias("pos"), "role", "text", "tokens", F.expr(f"(s + s0) div {8 * budget}").alias("stretch"))
    rows = scratch.save(rows, "placed")
    system = (F.col("pos") == 0) & (F.col("role") == "system")
    own = rows.select("conv", "stretch", "pos", F.lit(False).alias("context"), system.alias("is_system"), "role", "text", "tokens")
    later = rows.filter("stretch > 0").groupBy("conv", "stretch").agg(F.min("pos").alias("first"))
    wanted = later.select("conv", "stretch", F.explode(F.array_union(F.array(F.lit(0).cast("long")), F.expr(f"filter(sequence(first - {max(1, history_turns)}, first - 1), x -> x >= 0)"))).alias("pos"))
    context = _same(wanted, rows.drop("stretch"), ["conv", "pos"]).filter(system | (F.col("pos") > 0)).select("conv", "stretch", "pos", F.lit(True).alias("context"), system.alias("is_system"), "role", "text", "tokens")
    dealt = own.union(context).repartition("conv", "stretch").sortWithinPartitions("conv", "stretch", "pos")
    out = dealt.mapInArrow(_windows(budget, history, history_turns), f"conv {kind}, stretch long, window int, first_turn long, n_context int, n_new int, n_tokens long, text string, loss_starts array<int>, loss_ends array<int>")
    out = scratch.save(out.withColumnRenamed("conv", "conv_id"), "windows")
    scratch.drop("turns")
    scratch.drop("placed")
    return out


def read_back(windows: DataFrame) -> DataFrame:
    """One row for each conversation, from its windows alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Windows stream by in order, so a long conversation is never held at once.
    """
    kind = windows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now: list | None = None
        conv_type = None

        def pack() -> pa.RecordBatch:
            kinds = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            cols = list(zip(*done, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        def finish() -> None:
            if now is not None:
                done.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

        for batch in batches:
            conv_type = batch.schema.field(0).type
            for conv, n_context, text, starts, ends in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now is None or now[0] != conv:
                    finish()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    if len(done) >= 1000:
                        yield pack()
                        done = []
                for role, body, _, _ in read_window(text)[n_context:]:
                    now[1] += 1
                    now[2].update(f"{role}\n{body}\n".encode())
                for a, b in zip(starts, ends, strict=True):
                    body = unescape(text[a:b])
                    now[3] += len(body)
                    now[4].update(body.encode())
                now[5] += len(text)
        finish()
        if done:
            yield pack()

    rows = windows.repartition("conv_id").sortWithinPartitions("conv_id", "stretch", "window").select("conv_id", "n_context", "text", "loss_starts", "loss_ends")
    return rows.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

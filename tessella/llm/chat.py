"""Chat formatting with Spark expressions alone.

The turns of a conversation are collected as structs, sorted, cut into blocks of
adjacent turns with the same role, and concatenated. The template:

    <|im_start|>ROLE\\nTEXT[<|im_sep|>TEXT ...]<|im_end|>\\n

with one block per run of turns of a role; <|im_sep|> keeps the merged turns apart.
Inside texts each `<`, backslashes, `|` gets one more backslash, so no text can hold a
control string and the step can be undone. Roles are percent-encoded, which leaves
ordinary names as they are.

Besides the formatted string, `format_chats` returns the loss mask: byte spans of the
texts of assistant turns. `read_back` undoes the template from these two alone.

Edge cases: null text and null role count as empty; turns with equal numbers are ordered
by role, then text; a null conversation id is a conversation; repeated rows are turns of
their own; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import running_starts

#: The control strings of the template.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LOSS_ROLE = "assistant"


def _escaped(text: str) -> str:
    return f"regexp_replace({text}, r'<(\\\\*)\\|', r'<$1\\\\|')"


def _plain(text: str) -> str:
    return f"regexp_replace({text}, r'<(\\\\*)\\\\\\|', r'<$1|')"


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, formatted, loss_spans (array of {start, len} in UTF-8 bytes), n_blocks."""
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.expr(f"url_encode(coalesce(`{role}`, ''))").alias("role"),
        F.expr(_escaped(f"coalesce(`{text}`, '')")).alias("text"),
    )
    got = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    # where a block starts; both uses below keep Catalyst from inlining the array into a lambda
    got = got.select("conv_id", "t", F.expr("filter(sequence(0, size(t) - 1), i -> i = 0 or t[i].role <> get(t, i - 1).role)").alias("starts"))
    got = got.select(
        "conv_id",
        F.expr(
            "transform(starts, (s, k) -> named_struct('role', t[s].role, 'texts', "
            "transform(slice(t, s + 1, coalesce(get(starts, k + 1), size(t)) - s), x -> x.text)))"
        ).alias("blocks"),
    )
    head = rf"concat('{START}', b.role, '\n')"
    got = got.select(
        "conv_id",
        "blocks",
        F.expr(rf"array_join(transform(blocks, b -> concat({head}, array_join(b.texts, '{SEP}'), '{END}\n')), '')").alias("formatted"),
        # pieces in order: a head or separator, then a text; the end of a block goes to the piece after it
        F.expr(
            "flatten(transform(blocks, (b, k) -> transform(b.texts, (x, i) -> named_struct("
            rf"'lead', cast(octet_length(if(i = 0, concat(if(k = 0, '', '{END}\n'), {head}), '{SEP}')) as bigint), "
            f"'len', cast(octet_length(x) as bigint), 'loss', b.role = '{LOSS_ROLE}'))))"
        ).alias("pieces"),
    )
    got = got.select("conv_id", "formatted", F.size("blocks").cast("long").alias("n_blocks"), "pieces", F.expr("transform(pieces, p -> p.lead + p.len)").alias("steps"))
    got = got.withColumn("at", F.expr(running_starts("steps")))
    spans = "transform(filter(arrays_zip(pieces, at), z -> z.pieces.loss), z -> named_struct('start', z.at + z.pieces.lead, 'len', z.pieces.len))"
    return got.select("conv_id", "formatted", F.expr(spans).alias("loss_spans"), "n_blocks")


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, turns (array of {role, text}), loss_text: what the formatted string and its mask say."""
    quoted = lambda s: s.replace("|", "\\|")
    got = chats.select("*", F.expr(rf"filter(split(formatted, r'{quoted(END)}\n', -1), x -> x <> '')").alias("parts"))
    head = rf"substr(p, {len(START) + 1}, instr(p, '\n') - {len(START) + 1})"
    texts = rf"split(substr(p, instr(p, '\n') + 1), r'{quoted(SEP)}', -1)"
    turns = f"flatten(transform(parts, p -> transform({texts}, x -> named_struct('role', url_decode({head}), 'text', {_plain('x')}))))"
    loss = f"array_join(transform(loss_spans, s -> {_plain('cast(substring(raw, cast(s.start as int) + 1, cast(s.len as int)) as string)')}), '')"
    got = got.withColumn("raw", F.col("formatted").cast("binary"))
    return got.select("conv_id", "formatted", "n_blocks", F.expr(turns).alias("turns"), F.expr(loss).alias("loss_text"))


def digests(back: DataFrame) -> DataFrame:
    """The digest columns of the registered query, from what was read back."""
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.expr(r"sha2(cast(array_join(transform(turns, t -> concat(t.role, '\n', t.text, '\n')), '') as binary), 256)").alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_blocks",
    )

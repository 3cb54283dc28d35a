"""Chat formatting from event logs: fold streamed deltas, edits and regenerations into messages, then render.

An event log has rows (conversation, message, seq, kind, role, text). Kinds: `delta` adds text to a message, `edit`
replaces its text so far, `regenerate` discards the message and all later ones of its conversation. Folding by sequence
comes to this: a message keeps its deltas after the last of its own edits and of the regenerations of it or an earlier
message. So the points of cutting are found by aggregates over the few events that cut and a window over messages
without their texts; texts meet twice, once per message and once per conversation.

Rendered turns carry marks; marks that occur inside texts are escaped reversibly, so the output can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from freightlens.session import stage

#: Fixed strings of the template. A turn is HEAD, role, AFTER_ROLE, text, TAIL.
HEAD = "### "
AFTER_ROLE = ": "
TAIL = "</turn>"
BREAK = "\n"
#: Roles with a printed name; others are printed behind `=`.
ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
TRAINED = "assistant"


def escaped(text: Column) -> Column:
    """Control strings made harmless: every backslash is doubled, then marks get a backslash inside."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit(TAIL), F.lit("<\\/turn>"))
    return F.replace(out, F.lit(HEAD), F.lit("#\\## "))


def unescaped(text: Column) -> Column:
    """Each backslash goes and the character behind it stays."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _printed(role: Column) -> Column:
    named = F.coalesce(*[F.when(role == k, F.lit(v)) for k, v in ROLES.items()])
    return F.coalesce(named, F.concat(F.lit("="), F.replace(escaped(F.coalesce(role, F.lit(""))), F.lit(AFTER_ROLE), F.lit(":\\ "))))


def _role(printed: Column) -> Column:
    named = F.coalesce(*[F.when(printed == v, F.lit(k)) for k, v in ROLES.items()])
    return F.coalesce(named, unescaped(F.substring(printed, F.lit(2), F.length(printed))))


def fold(events: DataFrame, conversation: str, message: list[str], seq: str = "seq") -> DataFrame:
    """Final messages: conversation, message columns, role, text.

    `message` orders the messages of a conversation, `seq` its events (any type with an order). The role is that of the
    first event kept that has one; NULL texts are empty. Events of the same seq are folded by kind, then text. A message
    with no event left is gone. NULL conversations and messages are values like any other.
    """
    order = F.struct(*message)
    cuts = events.select(conversation, *message, seq, "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    heads = cuts.groupBy(conversation, *message).agg(
        F.max(F.when(F.col("kind") == "regenerate", F.col(seq))).alias("_regenerated"),
        F.max(F.when(F.col("kind") == "edit", F.col(seq))).alias("_edited"))
    earlier = Window.partitionBy(conversation).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heads = heads.select(conversation, *message, "_edited", F.max("_regenerated").over(earlier).alias("_floor"))
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"h.{c}")) for c in [conversation, *message]]
    joined = cuts.alias("e").join(heads.where("_edited IS NOT NULL OR _floor IS NOT NULL").alias("h"), same, "left")
    kept = joined.where(
        (F.col("kind") != "regenerate")
        & F.coalesce(F.col(f"e.{seq}") > F.col("_floor"), F.lit(True))
        & F.coalesce(F.col(f"e.{seq}") >= F.col("_edited"), F.lit(True))).select("e.*")
    parts = F.sort_array(F.collect_list(F.struct(F.col(seq).alias("seq"), F.col("kind"), F.col("text"), F.col("role"))))
    grouped = kept.groupBy(conversation, *message).agg(parts.alias("_parts"))
    last_edit = F.array_max(F.transform("_parts", lambda p, i: F.when(p["kind"] == "edit", i).otherwise(F.lit(0))))
    used = F.filter("_parts", lambda p, i: i >= last_edit)
    return grouped.select(
        conversation, *message, F.get(F.filter(F.col("_parts.role"), lambda r: r.isNotNull()), F.lit(0)).alias("role"),
        F.array_join(F.transform(used, lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame, conversation: str, message: list[str]) -> DataFrame:
    """One row per conversation: formatted text, and the loss mask as spans (turn, start, end): code points within the
    rendered turn, for texts of the trained role. A conversation is one value; texts are rendered before they meet."""
    front = F.concat(F.lit(HEAD), _printed(F.col("role")), F.lit(AFTER_ROLE))
    body = escaped(F.coalesce("text", F.lit("")))
    turns = messages.select(
        conversation, F.struct(*message).alias("_order"), F.concat(front, body, F.lit(TAIL)).alias("_turn"),
        F.when(F.col("role") == TRAINED, F.struct(F.length(front).alias("start"), (F.length(front) + F.length(body)).alias("end"))).alias("_mask"))
    grouped = turns.groupBy(conversation).agg(F.sort_array(F.collect_list(F.struct("_order", "_turn", "_mask"))).alias("_turns"))
    masks = F.transform("_turns", lambda t, i: F.struct(i.alias("turn"), t["_mask"]["start"].alias("start"), t["_mask"]["end"].alias("end")))
    return grouped.select(
        conversation, F.concat(F.array_join(F.col("_turns._turn"), BREAK), F.lit(BREAK)).alias("formatted"),
        F.filter(masks, lambda m: m["start"].isNotNull()).alias("loss_mask"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as (role, text)."""
    def parse(turn: Column) -> Column:
        role = F.substring_index(F.substring(turn, F.lit(len(HEAD) + 1), F.length(turn)), AFTER_ROLE, 1)
        text = F.substring(turn, F.length(role) + len(HEAD) + len(AFTER_ROLE) + 1, F.length(turn))
        return F.struct(_role(role).alias("role"), unescaped(text).alias("text"))

    return F.transform(_turns(formatted), parse)


def _turns(formatted: Column) -> Column:
    """Rendered turns without their tails. What follows the last tail is dropped."""
    parts = F.split(formatted, f"{TAIL}{BREAK}", -1)
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, joined with nothing between."""
    turns = _turns(formatted)
    return F.array_join(F.transform(mask, lambda m: unescaped(F.substring(F.get(turns, m["turn"]), m["start"] + 1, m["end"] - m["start"]))), "")


def log_of(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Finished turns as a log whose folding gives them back. First each turn is streamed as a draft; all drafts are then
    discarded by regenerations. The new stream of a turn has an opening delta without text, a wrong first half, an edit
    that puts it right, and a delta with the second half. Rows of the same turn follow each other by role and text; repeated rows are turns of their own."""
    whole = F.coalesce(F.col(text), F.lit(""))
    order = Window.partitionBy(conversation, turn).orderBy(F.col(role).asc_nulls_first(), whole)
    rows = turns.select(F.col(conversation).alias("conversation"), F.col(turn).alias("turn"), F.row_number().over(order).alias("copy"),
                        F.col(role).alias("role"), whole.alias("whole"))
    half = F.floor(F.length("whole") / 2).cast("int")
    first, second = F.substring("whole", F.lit(1), half), F.substring(F.col("whole"), half + 1, F.length("whole"))
    no_role, no_text = F.lit(None).cast("string"), F.lit(None).cast("string")

    def event(phase: int, part: int, kind: str, speaker: Column, said: Column) -> Column:
        return F.struct(F.lit(phase).alias("phase"), F.lit(part).alias("part"), F.lit(kind).alias("kind"), speaker.alias("role"), said.alias("text"))

    pieces = F.array(
        event(0, 0, "delta", F.lit("draft"), F.lit("draft: ")), event(0, 1, "delta", no_role, F.reverse("whole")),
        event(1, 0, "regenerate", no_role, no_text),
        event(2, 0, "delta", F.col("role"), F.lit("")), event(2, 1, "delta", no_role, F.concat(F.lit("wrong: "), F.reverse(first))),
        event(2, 2, "edit", F.col("role"), first), event(2, 3, "delta", no_role, second))
    return rows.select("conversation", "turn", "copy", F.explode(pieces).alias("p")).select(
        "conversation", "turn", "copy", F.struct("p.phase", "turn", "copy", "p.part").alias("seq"), "p.kind", "p.role", "p.text")


def format_log(events: DataFrame, conversation: str, message: list[str], seq: str = "seq") -> DataFrame:
    """Fold and render: conversation, formatted, loss_mask."""
    return render(fold(events, conversation, message, seq), conversation, message)

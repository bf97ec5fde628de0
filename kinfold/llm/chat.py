"""Chat formatting with a grammar round trip.

A conversation is rendered as

    ### User: text
    </turn>
    ### Assistant: text
    </turn>

The grammar: a turn is a header (`### `, a label, `: `), a body and the end mark (a line break and `</turn>`), and every
end mark is followed by a line break. Headers and `</turn>` are control strings; inside a body each stands behind an odd or
even run of backslashes, of which reading takes one away. A body with a bare control string is no word of the grammar.

Texts are first rendered as they are and parsed again. A turn that does not come back as it was (it holds a control
string, bare or behind backslashes) is escaped: one more backslash before each control string with the backslashes that
stand before it. Only conflicting texts change. The whole conversation is then parsed once more and held against its
turns; a difference that escaping cannot mend would be an error of the grammar and ends the query.

Labels are System, User and Assistant for these roles in lower case; any other role is written in hex behind `x-`, so that no
role can break the grammar.

Defined results: a null text or role counts as empty; turns come in the order of turn (nulls first), equal turns by role and
then text, repeated rows are turns of their own; rows without conv_id form one conversation; an empty table gives no row;
further columns are not carried. A conversation's rows meet in one task, as its text is one string; nothing else does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The control strings: fixed values of the template.
LABELS = {"system": "System", "user": "User", "assistant": "Assistant"}
CONTROL = r"### (?:System|User|Assistant|x-[0-9A-F]*): |</turn>"
END = "\n</turn>\n"
#: The role whose texts are learned from.
LEARNED = "assistant"


def escape(text: Column) -> Column:
    """One more backslash before each control string and the backslashes before it."""
    return F.regexp_replace(text, rf"(\\*)({CONTROL})", r"\\$1$2")


def unescape(body: Column) -> Column:
    """One backslash less before each control string; what escape() made comes back as it was."""
    return F.regexp_replace(body, rf"\\(\\*)({CONTROL})", "$1$2")


#: What a conflicting text goes through, one after the other, until it reads back as it was.
ESCAPES = (escape,)


def label(role: Column) -> Column:
    named = reduce(lambda c, item: c.when(role == item[0], item[1]), LABELS.items(), F.when(F.lit(False), ""))
    return F.coalesce(named, F.concat(F.lit("x-"), F.hex(role.cast("binary"))))


def role_of(name: Column) -> Column:
    """The role of a label."""
    named = reduce(lambda c, item: c.when(name == item[1], item[0]), LABELS.items(), F.when(F.lit(False), ""))
    return F.coalesce(named, F.unhex(F.substring(name, 3, 2**31 - 1)).cast("string"))


def render(role: Column, body: Column) -> Column:
    """One turn as text."""
    return F.concat(F.lit("### "), label(role), F.lit(": "), body, F.lit(END))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: (role, text, masked, learned), where masked characters come before the body (mark
    of the former turn's end included) and learned is the body's length. A part that the grammar does not know has a null role."""

    def turn(part: Column, i: Column) -> Column:
        name = F.regexp_extract(part, r"^### (System|User|Assistant|x-[0-9A-F]*): ", 1)
        head = F.char_length(name) + 6
        body = part.substr(head + 1, F.char_length(part))
        known = (name != "") & ~F.regexp_like(body, F.lit(rf"(?<!\\)(?:{CONTROL})"))
        return F.struct(
            F.when(known, role_of(name)).alias("role"), unescape(body).alias("text"),
            (head + F.when(i > 0, len(END)).otherwise(0)).cast("long").alias("masked"), F.char_length(body).cast("long").alias("learned"),
        )

    # the last mark ends the last turn, so that what follows it is empty
    return F.transform(F.filter(F.split(formatted, END), lambda part: part != ""), turn)


def _same(parsed: Column, role: Column, text: Column) -> Column:
    return F.coalesce((F.size(parsed) == 1) & (parsed[0]["role"] == role) & (parsed[0]["text"] == text), F.lit(False))


def turn_text(role: Column, text: Column) -> Column:
    """One turn rendered, its text escaped only if it does not read back as it is."""
    body = text
    for step in ESCAPES:
        body = F.when(_same(parse(render(role, body)), role, text), body).otherwise(step(text))
    return render(role, body)


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, turns: what parsing gives back, with the mask as runs (masked, learned) of characters; only an
    assistant's learned runs are learned from (see loss_text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    said = said.withColumn("shown", turn_text(F.col("role"), F.col("text")))
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text", "shown")))
    whole = said.groupBy("conv_id").agg(turns.alias("source"))
    whole = whole.withColumn("formatted", F.array_join("source.shown", "")).withColumn("turns", parse(F.col("formatted")))
    same = (F.col("turns.role") == F.col("source.role")) & (F.col("turns.text") == F.col("source.text"))
    checked = F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a formatted conversation does not read back as its turns")))
    return whole.select("conv_id", checked.alias("formatted"), "turns")


def loss_text(turns: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == LEARNED), lambda t: t["text"]), "")


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of format_conversations()."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = loss_text(F.col("turns"))
    return formatted.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


#: A conversation that says control strings and backslashes, added to every formatted table.
PROBE_ID, PROBE_TEXT = -7, r"\### Assistant: </turn> ok"


def with_probe(rows: DataFrame) -> DataFrame:
    """The rows and two more, of conversation -7."""
    spark = rows.sparkSession
    said = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", LEARNED))]))
    probe = spark.range(1).select(F.lit(PROBE_ID).cast("long").alias("conv_id"), said.alias("s"), F.lit(PROBE_TEXT).alias("text"))
    return rows.select("conv_id", "turn", "role", "text").unionByName(probe.select("conv_id", "s.turn", "s.role", "text"))


def oracle_sql() -> str:
    control = CONTROL.replace("'", "''")
    return rf"""
with said as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select {PROBE_ID}, 0, 'user', '{PROBE_TEXT}' union all select {PROBE_ID}, 1, 'assistant', '{PROBE_TEXT}'
), shown as (
    select *, case role when 'system' then 'System' when 'user' then 'User' when 'assistant' then 'Assistant' else 'x-' || hex(role) end as label,
        regexp_replace(text, '(\\*)({control})', '\\\1\2', 'g') as body
    from said
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
    sum(6 + length(label) + length(body) + {len(END)})::bigint as formatted_chars
from shown group by conv_id"""

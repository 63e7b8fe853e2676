"""Chat formatting: a finite-state machine over roles and a declarative template, DataFrame functions only.

A conversation's turns, in the order of (turn, role, text), become segments; each has a loss flag from
the template. Control strings inside texts and roles are escaped, so the output can be read back.

Defined cases: null texts and roles count as empty; roles that the template doesn't name get its general
form without loss; turns that are repeated are kept, each as a turn of its own. A conversation whose
roles the machine refuses is formatted all the same and marked valid = false. Rows without a conv_id
form one conversation. One conversation is the unit of the output, so its turns meet in one row.
"""
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the format.
HEAD, END = "### ", "</turn>"


@dataclass(frozen=True)
class Template:
    """labels: what stands for a role in a turn's head. loss: the roles that are learned.
    moves: the machine's transitions, state to the roles that may follow."""

    labels: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss: frozenset[str] = frozenset({"assistant"})
    moves: dict[str, frozenset[str]] = field(
        default_factory=lambda: {
            "start": frozenset({"system", "user"}),
            "system": frozenset({"user"}),
            "user": frozenset({"assistant"}),
            "assistant": frozenset({"user", "tool"}),
            "tool": frozenset({"assistant"}),
        }
    )
    final: frozenset[str] = frozenset({"assistant"})


#: What stands for each control character, in the order of escaping. An escape character in the output
#: always begins one of these pairs, so undoing them in the opposite order is exact.
PAIRS = {"\\": "\\e", "<": "\\l", "#": "\\h", ":": "\\c"}


def escaped(text: Column, label: bool = False) -> Column:
    """No control string is left; a label hides its colons too."""
    for c, pair in PAIRS.items():
        if label or c != ":":
            text = F.replace(text, F.lit(c), F.lit(pair))
    return text


def unescaped(text: Column) -> Column:
    for c, pair in reversed(PAIRS.items()):
        text = F.replace(text, F.lit(pair), F.lit(c))
    return text


def _map(values: dict[str, object]) -> Column:
    return F.create_map(*(F.lit(x) for kv in sorted(values.items()) for x in kv))


def state_of(roles: Column, t: Template) -> Column:
    """The machine's state after the roles: the last role, or refused."""
    moves = _map({f"{state}>{role}": role for state, after in t.moves.items() for role in after})
    return F.aggregate(roles, F.lit("start"), lambda s, r: F.coalesce(F.element_at(moves, F.concat(s, F.lit(">"), r)), F.lit("refused")))


def segments_of(turns: Column, t: Template) -> Column:
    """[(text, loss)]: a head without loss, the escaped text with its role's flag, an end mark. The
    mark of a learned turn is no part of the loss, so the learned text is the turn's text exactly."""
    labels = _map(t.labels)

    def one(x: Column) -> Column:
        label = F.coalesce(F.element_at(labels, x["role"]), F.concat(F.lit("="), x["role"]))
        seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            seg(F.concat(F.lit(HEAD), escaped(label, True), F.lit(":\n")), F.lit(False)),
            seg(escaped(x["text"]), x["role"].isin(*sorted(t.loss))),
            seg(F.lit(END + "\n"), F.lit(False)),
        )

    return F.flatten(F.transform(turns, one))


def conversations(rows: DataFrame, t: Template = Template()) -> DataFrame:
    """One row per conversation: conv_id, valid, segments, formatted (the segments' texts joined)."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", empty("role").alias("role"), empty("text").alias("text")))).alias("turns"))
    state = state_of(F.transform("turns", lambda x: x["role"]), t)
    return (
        turns.select("conv_id", state.isin(*sorted(t.final)).alias("valid"), segments_of(F.col("turns"), t).alias("segments"))
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    )


def read_back(formatted: Column, t: Template = Template()) -> Column:
    """[(role, text, loss)] from the formatted string alone."""
    roles = _map({v: k for k, v in t.labels.items()})
    marked = F.filter(F.split(formatted, f"{END}\n", -1), lambda x: x != "")

    def one(x: Column) -> Column:
        at = F.instr(x, ":\n")
        label = unescaped(F.substring(x, F.lit(len(HEAD) + 1), at - 1 - len(HEAD)))
        role = F.coalesce(F.element_at(roles, label), F.regexp_replace(label, "^=", ""))
        text = unescaped(F.substring(x, at + 2, F.length(x)))
        return F.struct(role.alias("role"), text.alias("text"), role.isin(*sorted(t.loss)).alias("loss"))

    return F.transform(marked, one)


def digest(formatted: DataFrame) -> DataFrame:
    """What the contract asks of the output, read back from it."""
    learned = F.array_join(F.transform(F.filter("back", lambda x: x["loss"]), lambda x: x["text"]), "")
    seen = F.array_join(F.transform("back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return (
        formatted.withColumn("back", read_back(F.col("formatted")))
        .withColumn("learned", learned)
        .select(
            "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(seen, 256).alias("turns_sha256"),
            F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"), "valid",
        )
    )

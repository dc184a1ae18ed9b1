"""Chat formatting (5): schema fingerprints select declarative mappings to turns.

A record's layout is the set of its nested field paths, of those that any
registered mapping knows (others are extra columns and change nothing).  Its
hash, the fingerprint, selects the mapping; a fingerprint of no mapping takes the
largest mapping whose paths all occur.  Columns give paths through their schema,
JSON strings through the keys of their objects and of the elements of their
lists, row by row.

Defined results: a null text or role is empty; a null record, or one of unknown
layout, has null turns and its fingerprint; turns of one conversation are
ordered by turn, then role, then text, and repeated rows stay; an empty table
gives an empty one.

Template: each turn is `<|im_start|>role\\ntext<|im_end|>\\n`.  In roles and texts
`<` + n backslashes + `|` gets one more backslash, so no control string can occur
there and removing one backslash restores the text; in roles `%` and line ends
are written %25 and %0A too.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spans import let, running

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """fixed: (role, path) in order, empty optional paths giving no turn; or list + role and text fields in it."""

    name: str
    fixed: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    list_path: str = ""
    role: str = ""
    text: str = ""
    renamed: tuple[tuple[str, str], ...] = ()
    #: One row for each turn: conversation, order, role and text columns.
    row: tuple[str, str, str, str] | None = None

    def paths(self) -> frozenset[str]:
        if self.row:
            return frozenset(self.row)
        if self.list_path:
            return frozenset({self.list_path, f"{self.list_path}.{self.role}", f"{self.list_path}.{self.text}"})
        return frozenset(p for _, p in self.fixed)


#: Layouts by declaration.
MAPPINGS = (
    Mapping("turn rows", row=("conv_id", "turn", "role", "text")),
    Mapping("messages", list_path="messages", role="role", text="content"),
    Mapping("shared conversations", list_path="conversations", role="from", text="value", renamed=(("human", "user"), ("gpt", "assistant"))),
    Mapping("instruction", fixed=(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction with input", fixed=(("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("input",)),
    Mapping("instruction with system", fixed=(("system", "system"), ("user", "instruction"), ("assistant", "output")), optional=("system",)),
    Mapping("instruction with system and input", fixed=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("system", "input")),
    Mapping("prompt and completion", fixed=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt and response", fixed=(("user", "prompt"), ("assistant", "response"))),
    Mapping("question and answer", fixed=(("user", "question"), ("assistant", "answer"))),
)


def fingerprint(paths: frozenset[str] | set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def field_paths(schema: T.StructType, prefix: str = "") -> set[str]:
    """Nested field paths; arrays add nothing of their own."""
    out = set()
    for field in schema.fields:
        path, kind = prefix + field.name, field.dataType
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        out.add(path)
        if isinstance(kind, T.StructType):
            out |= field_paths(kind, path + ".")
    return out


def select_mapping(schema: T.StructType, mappings: tuple[Mapping, ...] = MAPPINGS) -> Mapping:
    """The mapping whose fingerprint is that of the schema's known paths; else the largest whose paths all occur."""
    found = field_paths(schema)
    for mapping in mappings:
        if fingerprint(found & mapping.paths()) == fingerprint(mapping.paths()) and not any(m.paths() > mapping.paths() and m.paths() <= found for m in mappings):
            return mapping
    raise ValueError(f"no mapping for the layout {sorted(found)}")


def _keys(v: Column) -> Column:
    """Keys of an object; none of anything else."""
    return F.coalesce(F.json_object_keys(F.to_json(v)), F.array().cast("array<string>"))


def _variant_paths(v: Column, known: frozenset[str]) -> Column:
    """Sorted known paths of a variant: its keys, and those of the elements of its lists, whatever these hold besides."""
    top = _keys(v)
    paths = [F.when(F.array_contains(top, p), F.lit(p)) for p in sorted(known) if "." not in p]
    for head in sorted({k.split(".")[0] for k in known if "." in k}):
        inner = F.flatten(F.transform(F.coalesce(F.try_variant_get(v, f"$.{head}", "array<variant>"), F.array().cast("array<variant>")), _keys))
        paths += [F.when(F.array_contains(inner, p.split(".", 1)[1]), F.lit(p)) for p in sorted(known) if p.startswith(head + ".")]
    return F.array_sort(F.array_compact(F.array(*paths)))


def _turn_of(m: Mapping):
    def turn(x: Column) -> Column:
        role = x[m.role]
        for old, new in m.renamed:
            role = F.when(x[m.role] == old, new).otherwise(role)
        return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(x[m.text], F.lit("")).alias("text"))

    return turn


def json_turns(records: DataFrame, column: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """records with `fingerprint`, `layout` and `turns`, chosen row by row."""
    usable = [m for m in mappings if not m.row]
    known = frozenset().union(*(m.paths() for m in usable))
    v = F.try_parse_json(F.col(column))
    frame = records.withColumn("_v", v)
    frame = frame.withColumn("_paths", _variant_paths(F.col("_v"), known))
    frame = frame.withColumn("fingerprint", F.substring(F.sha2(F.array_join("_paths", "\n"), 256), 1, 16))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    # last the mapping of the fingerprint; before it, where there is none, the largest whose paths all occur
    exact = [(F.col("fingerprint") == fingerprint(m.paths()), m) for m in usable]
    within = [(F.size(F.array_intersect("_paths", F.array(*map(F.lit, sorted(m.paths()))))) == len(m.paths()), m) for m in sorted(usable, key=lambda m: -len(m.paths()))]
    for here, m in reversed(exact + within):
        if m.list_path:
            items = F.try_variant_get(F.col("_v"), f"$.{m.list_path}", f"array<struct<`{m.role}`:string,`{m.text}`:string>>")
            made = F.transform(items, _turn_of(m))
        else:
            parts = []
            for role, path in m.fixed:
                got = F.try_variant_get(F.col("_v"), f"$.{path}", "string")
                one = F.struct(F.lit(role).alias("role"), F.coalesce(got, F.lit("")).alias("text"))
                parts.append(F.when(F.coalesce(got, F.lit("")) == "", None).otherwise(one) if path in m.optional else one)
            made = F.array_compact(F.array(*parts)).cast(TURNS)
        layout, turns = F.when(here, m.name).otherwise(layout), F.when(here, made).otherwise(turns)
    return frame.withColumn("layout", layout).withColumn("turns", turns).drop("_v", "_paths")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _escaped_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role(escaped: Column) -> Column:
    return F.replace(F.replace(unescape(escaped), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_turns(turns: Column, trained_role: str = "assistant") -> Column:
    """Array of turns to a struct: `formatted`, the loss mask as `loss_turns` (one flag for each
    turn's text) and as `loss_spans` (code points of formatted, end exclusive)."""
    segments = F.transform(turns, lambda t: F.struct(F.concat(F.lit(START), _escaped_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == trained_role).alias("loss")))

    def made(parts: Column) -> Column:
        formatted = F.array_join(F.transform(parts, lambda s: F.concat(s["head"], s["body"], F.lit(END + "\n"))), "")
        sizes = F.transform(parts, lambda s: (F.char_length(s["head"]) + F.char_length(s["body"]) + len(END) + 1).cast("bigint"))

        def span(s: Column, at: Column) -> Column:
            start = at + F.char_length(s["head"])
            return F.when(s["loss"], F.struct(start.alias("start"), (start + F.char_length(s["body"])).alias("end")))

        spans = F.array_compact(F.zip_with(parts, running(sizes), span))
        return F.struct(formatted.alias("formatted"), F.transform(parts, lambda s: s["loss"]).alias("loss_turns"), spans.alias("loss_spans"))

    return let(segments, made)


def _pieces(formatted: Column) -> Column:
    """Each turn without its end mark; texts hold no control string, so cuts are the turns'."""
    return F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda p: p != "")


def _body(piece: Column) -> Column:
    return F.substr(piece, F.locate("\n", piece) + 1)


def parse_turns(formatted: Column) -> Column:
    """The turns, read back from a formatted text."""
    return F.transform(_pieces(formatted), lambda p: F.struct(_role(F.substring_index(F.substr(p, F.lit(len(START) + 1)), "\n", 1)).alias("role"), unescape(_body(p)).alias("text")))


def masked_text(formatted: Column, loss_turns: Column) -> Column:
    """The unescaped text under the mask, read back from a formatted text."""
    bodies = F.transform(_pieces(formatted), lambda p, i: F.struct(p.alias("piece"), F.get(loss_turns, i).alias("loss")))
    return F.array_join(F.transform(F.filter(bodies, lambda b: b["loss"]), lambda b: unescape(_body(b["piece"]))), "")


def format_rows(rows: DataFrame) -> DataFrame:
    """One formatted conversation for each conv_id of rows with one turn each.

    The only shuffle is by conversation; a conversation is one output row and so
    has to fit in a task.
    """
    return format_conversations(row_turns(rows))


def row_turns(rows: DataFrame) -> DataFrame:
    """conv_id and its turns (role, text), in order, of rows with one turn each."""
    mapping = select_mapping(rows.schema)
    if not mapping.row:
        raise ValueError(f"{mapping.name} has one row for a conversation; use json_turns")
    conv, turn, role, text = (F.col(f"`{c}`") for c in mapping.row)
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    made = rows.select(conv.alias("conv_id"), F.struct(turn.alias("turn"), role.alias("role"), text.alias("text")).alias("turn"))
    grouped = made.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_turns and loss_spans of rows of (conv_id, turns), whatever layout they came from."""
    return conversations.select("conv_id", format_turns(F.col("turns")).alias("f")).select("conv_id", "f.formatted", "f.loss_turns", "f.loss_spans")


def digest(conversations: DataFrame) -> DataFrame:
    """What the contract asks for of rows of (conv_id, turns), read back from the formatted output."""
    out = format_conversations(conversations)
    back = out.select("conv_id", "formatted", "loss_turns", parse_turns(F.col("formatted")).alias("turns"))
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = masked_text(F.col("formatted"), F.col("loss_turns"))
    shown = back.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(all_turns, 256).alias("turns_sha256"), loss.alias("loss"), F.char_length("formatted").cast("bigint").alias("formatted_chars"))
    return shown.select("conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")

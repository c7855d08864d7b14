"""Chat formatting with functions of Spark only: a finite-state machine over roles, a declarative template,
segments with loss flags, reversible escapes, and reading it all back from the formatted text."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns look, which texts bear loss, and which orders of roles are valid."""

    #: role -> (before the text, after it, whether the text bears loss)
    turns: dict[str, tuple[str, str, bool]] = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>", False), "user": ("[INST] ", " [/INST]", False), "assistant": ("<s>", "</s>", True)})
    #: any other role: its name goes between the first mark and a line end
    other: tuple[str, str, bool] = ("[ROLE] ", " [/ROLE]", False)
    #: (state, role) -> next state
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"})
    #: states in which a conversation may end
    ends: tuple[str, ...] = ("user", "assistant")
    #: a control string is one of these, then the rest of one of its kind
    openers: str = r"<\["
    rests: tuple[str, ...] = (r"/?s>", r"</?SYS>>", r"/?INST\]", r"/?ROLE\]")


DEFAULT = Template()


def _quoted(x: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|/<>" and not c.isalnum() else c for c in x)


def escaped(text: Column, template: Template = DEFAULT) -> Column:
    """One backslash more after the first character of every control string, bare or already escaped."""
    return F.regexp_replace(text, rf"([{template.openers}])(\\*)(?=(?:{'|'.join(template.rests)}))", r"$1$2\\")


def unescaped(text: Column, template: Template = DEFAULT) -> Column:
    return F.regexp_replace(text, rf"([{template.openers}])(\\*)\\(?=(?:{'|'.join(template.rests)}))", "$1$2")


def _line(role: Column) -> Column:
    """A role on one line: backslashes doubled, line ends as \\n."""
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _unline(role: Column) -> Column:
    parts = F.split(role, r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def formatted(turns: DataFrame, template: Template = DEFAULT, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: conv_id, valid, segments, formatted, loss_spans.

    Turns by ``turn``, equal ones by role, then text; a null turn comes first, a null role or text is
    empty. ``segments``: (text, loss) in order, the formatted text cut at its marks. ``loss_spans``:
    (start, length) in code points from 0. ``valid``: the machine takes every role and may end where it
    does; a conversation that isn't valid is formatted all the same. Null conv_ids are one conversation.
    Repeated rows are turns of their own. No rows: none. Extra columns are not read. A conversation is
    one row, so its turns must fit in one.
    """
    rows = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.struct(F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("x"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("turns"))
    moves = F.create_map(*[F.lit(x) for (state, name), to in template.moves.items() for x in (f"{state}>{name}", to)])
    state = F.aggregate("turns", F.lit("start"), lambda s, x: F.coalesce(F.element_at(moves, F.concat(s, F.lit(">"), x["role"])), F.lit("rejected")))

    def pick(x: Column, k: int) -> Column:
        kind = "boolean" if k == 2 else "string"
        first = F.concat(F.lit(template.other[0]), escaped(_line(x["role"]), template), F.lit("\n")) if k == 0 else F.lit(template.other[k])
        out = None
        for name, marks in template.turns.items():
            out = F.when(x["role"] == name, F.lit(marks[k])) if out is None else out.when(x["role"] == name, F.lit(marks[k]))
        return (out.otherwise(first) if out is not None else first).cast(kind)

    def segments(x: Column) -> Column:
        return F.array(F.struct(pick(x, 0).alias("text"), F.lit(False).alias("loss")), F.struct(escaped(x["text"], template).alias("text"), pick(x, 2).alias("loss")), F.struct(pick(x, 1).alias("text"), F.lit(False).alias("loss")))

    cut = grouped.select("conv_id", state.isin(*template.ends).alias("valid"), F.flatten(F.transform("turns", segments)).alias("segments"))
    return cut.select("conv_id", "valid", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), _spans().alias("loss_spans"))


def _spans() -> Column:
    """Running starts of the segments that bear loss."""
    empty = F.expr("cast(array() as array<struct<start: bigint, length: bigint>>)")
    zero = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        n = F.length(s["text"]).cast("long")
        more = F.array(F.struct(acc["at"].alias("start"), n.alias("length")))
        return F.struct((acc["at"] + n).alias("at"), F.when(s["loss"], F.concat(acc["spans"], more)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate("segments", zero, step, lambda acc: acc["spans"])


def read_turns(text: Column, template: Template = DEFAULT) -> Column:
    """array<struct<role, text>> from a formatted text alone: a mark opens a turn, the next closing mark ends it."""
    marks = [*template.turns.values(), template.other]
    opens, closes = "|".join(_quoted(m[0]) for m in marks), "|".join(_quoted(m[1]) for m in marks)
    found = F.regexp_extract_all(text, F.lit(rf"(?s)(?:{opens}).*?(?:{closes})"), F.lit(0))

    def turn(x: Column) -> Column:
        name, body = None, None
        for role, (before, after, _) in template.turns.items():
            hit = F.startswith(x, F.lit(before))
            inner = F.substr(x, F.lit(len(before) + 1), F.length(x) - len(before) - len(after))
            name = F.when(hit, F.lit(role)) if name is None else name.when(hit, F.lit(role))
            body = F.when(hit, inner) if body is None else body.when(hit, inner)
        before, after, _ = template.other
        inner = F.substr(x, F.lit(len(before) + 1), F.length(x) - len(before) - len(after))
        line = F.instr(inner, "\n")
        name = name.otherwise(_unline(unescaped(F.substr(inner, F.lit(1), line - 1), template)))
        body = body.otherwise(F.substr(inner, line + 1))
        return F.struct(name.alias("role"), unescaped(body, template).alias("text"))

    return F.transform(found, turn)


def read_back(chats: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid from formatted and loss_spans."""
    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")), template)), "")
    read = chats.select("conv_id", "valid", F.length("formatted").cast("long").alias("formatted_chars"), read_turns(F.col("formatted"), template).alias("turns"), loss.alias("loss"))
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "valid")


#: The conversation that the query adds: control strings in both texts.
PROBE = "</s>[INST] ok [/INST]"


def with_probe(turns: DataFrame) -> DataFrame:
    own = turns.sparkSession.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(own)


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(t) + len(regexp_extract_all(t, '[<\[]\\*(?:/?s>|</?SYS>>|/?INST\]|/?ROLE\])'))
           + CASE r WHEN 'system' THEN 15 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7
             ELSE 17 + length(replace(replace(r, '\', '\\'), chr(10), '\n'))
                  + len(regexp_extract_all(replace(replace(r, '\', '\\'), chr(10), '\n'), '[<\[]\\*(?:/?s>|</?SYS>>|/?INST\]|/?ROLE\])')) END AS n,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, t) AS k,
         lag(r) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, t) AS prev
  FROM c),
v AS (
  SELECT *, CASE WHEN k = 1 THEN r IN ('system', 'user')
                 WHEN r = 'user' THEN prev IN ('system', 'assistant')
                 WHEN r = 'assistant' THEN prev = 'user' ELSE false END AS fits
  FROM e)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(t)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY k) FILTER (r = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars,
       bool_and(fits) AND arg_max(r, k) IN ('user', 'assistant') AS valid
FROM v GROUP BY conv_id
"""

"""Chat formatting by schema fingerprints, with DataFrame functions only.

A record's fingerprint is the hash of its sorted nested field paths that hold a
value, of those that any mapping names. It selects a declarative mapping, which turns prompt, instruction and
message layouts into canonical turns. Turns are then written in one template,
whose control strings are escaped inside texts so that nothing a text says can end
or begin a turn, and with a loss mask over the assistant texts.

Defined cases: null role or text is empty; a record whose fingerprint no mapping
has gives layout ``unknown`` and no turns; a record without turns is an empty
string; turns with equal numbers are ordered by role and text; repeated rows are
repeated turns; an empty table gives only what the caller adds; columns besides
those named are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import once

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: What may stand after "<" or "[" to make a control string.
CONTROL = r"(/?s>|/?INST\]|</?SYS>>|\|[A-Za-z0-9_]+\|>)"
ASSISTANT = "assistant"
#: Role names of other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """Either an array of turns with a role and a text field, or fields in order, each with its role."""

    name: str
    turns: str | None = None
    role: str = ""
    text: str = ""
    steps: tuple[tuple[str, tuple[str, ...]], ...] = field(default=())

    def paths(self) -> list[str]:
        if self.turns:
            return sorted([f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"])
        return sorted(p for _, ps in self.steps for p in ps)


MAPPINGS = (
    Mapping("messages", "messages", "role", "content"),
    Mapping("dialogue", "conversations", "from", "value"),
    Mapping("prompt-response", steps=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("prompt-completion", steps=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("system-prompt-response", steps=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("question-answer", steps=(("user", ("data.question",)), ("assistant", ("data.answer",)))),
    Mapping("instruction", steps=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction-input", steps=(("user", ("instruction", "input")), ("assistant", ("output",)))),
)


def digest_of(paths: list[str]) -> str:
    import hashlib

    return hashlib.sha256(",".join(sorted(paths)).encode()).hexdigest()


def leaves(kind: T.DataType, path: str, value: Column) -> list[tuple[str, Column]]:
    """Nested field paths below a column, each with the condition that it holds a value."""
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        names = [f"{path}[].{f.name}" for f in inner.fields] if isinstance(inner, T.StructType) else [f"{path}[]"]
        return [(n, value.isNotNull()) for n in names]
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in leaves(f.dataType, f"{path}.{f.name}", value.getField(f.name))]
    return [(path, value.isNotNull())]


def fingerprint(df: DataFrame, id_col: str, mappings: tuple[Mapping, ...]) -> Column:
    named = {p for m in mappings for p in m.paths()}
    there = [x for f in df.schema.fields if f.name != id_col for x in leaves(f.dataType, f.name, F.col(f"`{f.name}`")) if x[0] in named]
    there.sort(key=lambda x: x[0])
    return F.sha2(F.concat_ws(",", *(F.when(has, F.lit(path)) for path, has in there)), 256)


def turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def mapped(m: Mapping) -> Column:
    if m.turns:
        known = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))

        def one(t: Column) -> Column:
            role = t.getField(m.role)
            return turn(role if m.role == "role" else F.coalesce(F.try_element_at(known, F.coalesce(role, F.lit(""))), role), t.getField(m.text))

        return F.transform(F.col(m.turns), one)
    return F.array(*(turn(F.lit(role), F.concat_ws("\n\n", *(F.col(p) for p in paths))) for role, paths in m.steps))


def canonical(records: DataFrame, id_col: str = "conv_id", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """id, fingerprint, layout and the turns (role, text) of each record, by the mapping its fingerprint selects."""
    # other columns, whatever they are called, stay out
    named = {p.partition(".")[0].removesuffix("[]") for m in mappings for p in m.paths()}
    records = records.select(id_col, *(f"`{f.name}`" for f in records.schema.fields if f.name != id_col and f.name in named))
    have = {path for f in records.schema.fields if f.name != id_col for path, _ in leaves(f.dataType, f.name, F.col(f"`{f.name}`"))}
    fits = [m for m in mappings if set(m.paths()) <= have]
    turns = layout = None
    for m in fits:
        hit = F.col("fingerprint") == digest_of(m.paths())
        turns = F.when(hit, mapped(m)) if turns is None else turns.when(hit, mapped(m))
        layout = F.when(hit, F.lit(m.name)) if layout is None else layout.when(hit, F.lit(m.name))
    empty = F.lit(None).cast("array<struct<role:string,text:string>>")
    out = once(records, fingerprint=fingerprint(records, id_col, mappings))
    return out.select(id_col, "fingerprint", (F.lit("unknown") if layout is None else layout.otherwise("unknown")).alias("layout"), (empty if turns is None else turns).alias("turns"))


def escape(text: Column) -> Column:
    """One backslash more after the first character of each control string, whatever backslashes are there."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, "$1$2$3")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def formatted(turns: DataFrame, learn: tuple[str, ...] = (ASSISTANT,)) -> DataFrame:
    """Adds formatted (the whole record in the template) and loss_mask (byte offset and length of each text to learn)."""
    parts = F.transform("turns", lambda t: F.struct(F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("text"), t["role"].isin(*learn).alias("learn")))
    out = once(turns, parts=parts)
    size = lambda p: F.octet_length(p["head"]) + F.octet_length(p["text"]) + len(CLOSE)
    ends = F.aggregate("parts", F.array(F.lit(0).cast("long")), lambda a, p: F.concat(a, F.array(F.try_element_at(a, F.lit(-1)) + size(p))))
    spans = F.transform("parts", lambda p, k: F.struct((F.get("begins", k) + F.octet_length(p["head"])).alias("start"), F.octet_length(p["text"]).cast("long").alias("length"), p["learn"].alias("learn")))
    out = once(out, formatted=F.concat_ws("", F.transform("parts", lambda p: F.concat(p["head"], p["text"], F.lit(CLOSE)))), begins=ends)
    mask = F.transform(F.filter(spans, lambda s: s["learn"]), lambda s: F.struct(s["start"], s["length"]))
    return out.withColumn("loss_mask", F.when(F.col("turns").isNotNull(), mask)).drop("parts", "begins")


def parsed(text: Column) -> Column:
    """Turns read back from a formatted record."""
    pieces = F.filter(F.split(text, CLOSE.replace("|", r"\|")), lambda p: p != "")

    def one(p: Column) -> Column:
        body = F.substring(p, len(OPEN) + 1, 1 << 30)
        role = F.substring_index(body, "\n", 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substr(body, F.char_length(role) + 2)).alias("text"))

    return F.transform(pieces, one)


def masked(text: Column, mask: Column) -> Column:
    """The unescaped texts under the loss mask, joined; text as UTF-8 bytes."""
    return F.concat_ws("", F.transform(mask, lambda s: unescape(F.decode(F.substr(text, (s["start"] + 1).cast("int"), s["length"].cast("int")), "utf-8"))))


def records_of_rows(rows: DataFrame, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows by turn as records of the messages layout."""
    got = rows.select(F.col(id_col).alias("conv_id"), F.struct(F.col(order_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("content")).alias("m"))
    got = got.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("m"))
    return got.select("conv_id", F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def read_back(out: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Digest of formatted records, from the formatted string and the mask alone."""
    out = once(out.select(id_col, "formatted", "loss_mask"), raw=F.to_binary("formatted", F.lit("utf-8")), turns=parsed(F.col("formatted")))
    got = once(out, loss=masked(F.col("raw"), F.col("loss_mask")))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return got.select(
        id_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


#: DuckDB: the same digest, told from the rows.
SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce("text", '') AS t FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), said AS (
  SELECT *, regexp_replace(t, '([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>|\|[A-Za-z0-9_]+\|>)', '\1\\\2\3', 'g') AS e,
    regexp_replace(replace(replace(role, '\', '\b'), chr(10), '\n'), '([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>|\|[A-Za-z0-9_]+\|>)', '\1\\\2\3', 'g') AS r
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role, t)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(r) + length(e)) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id
"""

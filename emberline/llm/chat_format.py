"""Operator 9: chat formatting by schema fingerprints, with DataFrame functions alone.

A record is JSON in any of several layouts. The hash of its nested field paths selects a declarative mapping to
canonical turns, and a template marks the turns. Control strings inside texts are escaped, so that the output can be
read back turn by turn.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import read_table

#: The control strings. Each begins with a character that the escape follows by a backslash.
TURN, TEXT, END = "[INST]", "[/INST]", "</s>"
TURNS_TYPE = "array<struct<role: string, text: string>>"
#: Bytes of a record up to which it fits a variant, whose strings have 20,000,000 characters at most; from_json reads longer ones.
VARIANT_BYTES = 20_000_000
#: Bytes of a long record's outline up to which it fits a variant (128 MiB, at most thrice the JSON).
OUTLINE_BYTES = 40_000_000
_ANY_LENGTH = {"maxStringLen": str(2**31 - 1), "columnNameOfCorruptRecord": "_bad"}
_STRING = r'(?:[^"\\]++|\\.)*+'


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    example: a record that has the layout's field paths. items: path of an array with a role and a text field, or else
    fields: role and path of each turn, where those that are absent or null are left out if optional. roles: the
    layout's names of roles.
    """

    name: str
    example: str
    items: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()


MAPPINGS = (
    Mapping("messages", '{"messages": [{"role": "", "content": ""}]}', "$.messages", "role", "content"),
    Mapping("conversations", '{"conversations": [{"from": "", "value": ""}]}', "$.conversations", "from", "value", roles=(("human", "user"), ("gpt", "assistant"))),
    Mapping("prompt", '{"prompt": "", "response": ""}', fields=(("user", "$.prompt"), ("assistant", "$.response"))),
    Mapping("completion", '{"prompt": "", "completion": ""}', fields=(("user", "$.prompt"), ("assistant", "$.completion"))),
    Mapping("instruction", '{"system": "", "instruction": "", "output": ""}', fields=(("system", "$.system"), ("user", "$.instruction"), ("assistant", "$.output"))),
    Mapping("nested", '{"data": {"dialog": [{"speaker": "", "utterance": ""}]}}', "$.data.dialog", "speaker", "utterance", roles=(("bot", "assistant"),)),
)


def _long(record: Column) -> Column:
    return F.octet_length(record) > VARIANT_BYTES


def _outline(record: Column) -> Column:
    """record with empty strings for its values and equal flat objects in a row as one, so that its field paths are the same."""
    emptied = F.regexp_replace(record, f'(?s)("{_STRING}"\\s*+:)|("){_STRING}(")', "$1$2$3")
    return F.regexp_replace(emptied, r"(\{[^{}\[\]]*+\})(?:\s*+,\s*+\1)++", "$1")


def _variant(record: Column) -> Column:
    """The record, or a long one's outline, as a variant; null if it isn't JSON. An outline too long for a variant is an error."""
    valid = F.from_json(record, "`_bad` string", _ANY_LENGTH)["_bad"].isNull()
    outline = _outline(record)
    fits = F.when(F.octet_length(outline) > OUTLINE_BYTES, F.raise_error(F.lit("a record has too many fields for its layout to be found")).cast("string")).otherwise(outline)
    return F.try_parse_json(F.when(~_long(record), record).when(valid, fits))


def field_paths(record: Column) -> Column:
    """The nested field paths of a JSON record as text, without the types of values; null if it isn't JSON."""
    return F.regexp_replace(F.schema_of_variant(_variant(record)), r": (?!OBJECT|ARRAY)[A-Z_0-9(),]+|<(?!OBJECT|ARRAY)[A-Z_0-9(),]+(?=>)", "")


def fingerprint(record: Column) -> Column:
    return F.sha2(field_paths(record), 256)


def _get_long(record: Column, path: str, kind: str) -> Column:
    """What try_variant_get gives, of a record of any length."""
    names = path.split(".")[1:]
    value = F.from_json(record, reduce(lambda inner, name: f"struct<`{name}`: {inner}>", reversed(names), kind), _ANY_LENGTH)
    return reduce(lambda v, name: v[name], names, value)


def _turns(mapping: Mapping, value: Callable[[str, str], Column]) -> Column:
    """The turns of a record of which value gives a path as a type."""
    if mapping.items:
        raw = value(mapping.items, f"array<struct<`{mapping.role}`: string, `{mapping.text}`: string>>")
        named = lambda role: F.coalesce(*[F.when(role == a, F.lit(b)) for a, b in mapping.roles], role)
        return F.transform(raw, lambda t: F.struct(named(F.coalesce(t[mapping.role], F.lit(""))).alias("role"), F.coalesce(t[mapping.text], F.lit("")).alias("text")))
    get = lambda path: F.coalesce(value(path, "string"), F.lit(""))
    return F.array(*[F.struct(F.lit(role).alias("role"), get(path).alias("text")) for role, path in mapping.fields])


def canonical_turns(records: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """records with layout, the mapping's name, and turns.

    A null record, one that isn't JSON and one of an unknown layout have null in both. Null texts are empty. Texts may
    have any length that a row's string can have; only numbers of over 1,000 digits, names of over 50,000 characters
    and nesting deeper than 1,000 count as no JSON.
    """
    spark = records.sparkSession
    # One row, of the mappings' examples.
    prints = spark.range(1).select(*[fingerprint(F.lit(m.example)).alias(f"m{i}") for i, m in enumerate(mappings)]).first()
    own = {c.lower() for c in records.columns}
    hash_, variant = (next(n for n in (name + "_" * k for k in range(len(own) + 1)) if n not in own) for name in ("found", "variant"))
    found = records.withColumn(hash_, fingerprint(F.col(record))).withColumn(variant, _variant(F.col(record)))
    cases = list(enumerate(mappings))
    layout = reduce(lambda c, m: F.when(F.col(hash_) == prints[f"m{m[0]}"], F.lit(m[1].name)).otherwise(c), cases, F.lit(None).cast("string"))
    short, long = (lambda path, kind: F.try_variant_get(variant, path, kind)), (lambda path, kind: _get_long(F.col(record), path, kind))
    either = lambda m: F.when(_long(F.col(record)), _turns(m, long)).otherwise(_turns(m, short))
    turns = reduce(lambda c, m: F.when(F.col(hash_) == prints[f"m{m[0]}"], either(m[1])).otherwise(c), cases, F.lit(None).cast(TURNS_TYPE))
    return found.withColumn("layout", layout).withColumn("turns", turns.cast(TURNS_TYPE)).drop(hash_, variant)


def escape(text: Column) -> Column:
    """A backslash after each backslash and each character that begins a control string, so none is left whole."""
    return F.regexp_replace(text, r"([\\<\[])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[])\\", "$1")


def formatted(turns: Column) -> Column:
    """All turns by the template: role and text of each between control strings."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT), escape(t["text"]), F.lit(END))), "")


def loss_spans(turns: Column) -> Column:
    """Start (from 1) and length, in characters of the formatted text, of each assistant text."""
    fixed = len(TURN) + len(TEXT)

    def step(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(escape(t["role"])) + fixed
        size = F.length(escape(t["text"]))
        spans = F.when(t["role"] == "assistant", F.concat(state["spans"], F.array(F.struct(start.alias("start"), size.alias("length"))))).otherwise(state["spans"])
        return F.struct((start + size + len(END)).alias("at"), spans.alias("spans"))

    first = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start: int, length: int>>").alias("spans"))
    return F.aggregate(turns, first, step, lambda state: state["spans"])


def read_turns(text: Column) -> Column:
    """The turns of a formatted text."""
    turn = r"(?s)\[INST\](.*?)\[/INST\](.*?)</s>"
    parts = [F.regexp_extract_all(text, F.lit(turn), F.lit(k)) for k in (1, 2)]
    return F.zip_with(*parts, lambda role, body: F.struct(unescape(role).alias("role"), unescape(body).alias("text")))


def read_loss(text: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(text, s["start"], s["length"]))), "")


def format_chats(records: DataFrame, record: str = "record") -> DataFrame:
    """records with layout, turns, formatted and loss_spans; all null where the layout is unknown.

    No turns give an empty text. Repeated records each get their own; an empty table gives an empty one. A turn may have
    any length; a record is one row, under 2 GB. Other columns pass through, but for those named like a result, which
    the result replaces.
    """
    out = canonical_turns(records, record)
    return out.withColumn("formatted", formatted(F.col("turns"))).withColumn("loss_spans", loss_spans(F.col("turns")))


def as_records(rows: DataFrame) -> DataFrame:
    """conv_id and record, JSON in one of four layouts, of rows conv_id, turn, role, text.

    A user's and an assistant's turn alone are a prompt record, with a system's before them an instruction record, and
    others lists of messages, of the one kind or the other by conv_id. Equal turns stand in the order of role and text;
    repeated rows are turns of their own; null roles and texts are empty.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    roles = F.transform("t", lambda x: x["role"])
    text = lambda k: F.element_at("t", k)["text"]
    human = lambda role: F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    plain = ~F.exists("t", lambda x: x["role"].isin("human", "gpt"))
    prompt = F.to_json(F.struct(text(1).alias("prompt"), text(2).alias("response")))
    instruction = F.to_json(F.struct(text(1).alias("system"), text(2).alias("instruction"), text(3).alias("output")))
    messages = F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages")))
    shared = F.to_json(F.struct(F.transform("t", lambda x: F.struct(human(x["role"]).alias("from"), x["text"].alias("value"))).alias("conversations")))
    record = (
        F.when(roles == F.array(F.lit("user"), F.lit("assistant")), prompt)
        .when(roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")), instruction)
        .when((F.pmod("conv_id", F.lit(2)) == 0) | F.col("conv_id").isNull() | ~plain, messages)
        .otherwise(shared)
    )
    return grouped.select("conv_id", record.alias("record"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(odd)
    chats = format_chats(as_records(rows)).select("conv_id", "layout", "formatted", "loss_spans")
    back = chats.select("conv_id", "layout", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    size = lambda c: F.length(c).cast("long")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), size("loss").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), size("formatted").alias("formatted_chars"), "layout")


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
             sum(17 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\<\[]', '', 'g'))) AS formatted_chars,
             string_agg(role, ',' ORDER BY turn, role, text) AS roles FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars,
       CASE WHEN roles = 'user,assistant' THEN 'prompt' WHEN roles = 'system,user,assistant' THEN 'instruction'
            WHEN conv_id % 2 = 0 THEN 'messages' ELSE 'conversations' END AS layout FROM g
"""

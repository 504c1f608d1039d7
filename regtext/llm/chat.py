"""Operator 4, chat formatting with schema fingerprints (DataFrame functions only).

A record is a JSON object in any of several layouts. Its shape (the tree of its field names, without
types) is hashed, and the hash selects a declarative mapping: either fields with fixed roles (prompt
and instruction layouts) or a list of messages with a role field and a text field. All layouts become
canonical turns ``array<struct<role, text>>``.

Turns are written as ``<turn ROLE>TEXT</turn>`` and a newline each. Inside roles and texts a backslash,
``<`` and ``>`` become ``\\s``, ``\\l`` and ``\\g``, so a control string never appears in a text and every
text can be read back. The loss mask is the list of code-point spans of the assistant texts in the
formatted string. The shape of a long record is parsed off its skeleton, without its texts, and its texts are read
without the parser's length limit, so a text may be as long as a value can be. A skeleton that is too large to be
parsed raises an error.

Defined cases: NULL roles and texts are empty; a shape without a mapping, NULL or malformed JSON gives
NULL turns with ``layout`` NULL (the row stays); an empty message list gives no turns, an empty string
and an empty mask; turns with equal numbers are ordered by role, then text; repeated rows are turns of
their own; a NULL conversation id is one conversation; extra columns are ignored. A conversation is
one output value, so its turns meet in one row; nothing larger than a conversation does.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, or_empty, prefix_sums

TURNS = "array<struct<role:string,text:string>>"
CLOSE = "</turn>\n"
LOSS_ROLE = "assistant"


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns: ``fields`` are (role, field) pairs in order, or ``items`` names a list
    whose elements have ``role`` and ``text`` fields; ``roles`` renames roles."""
    name: str
    shapes: tuple[str, ...]
    fields: tuple[tuple[str, str], ...] = ()
    items: str = ""
    role: str = ""
    text: str = ""
    roles: dict[str, str] = field(default_factory=dict)


def _list_shapes(items: str, *names: str) -> tuple[str, ...]:
    return (f"OBJECT<{items}: ARRAY<OBJECT<{', '.join(sorted(names))}>>>", f"OBJECT<{items}: ARRAY<>>")


# shapes: field names in alphabetical order, nested, without types
MAPPINGS = (
    Mapping("prompt", ("OBJECT<completion, prompt>",), fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt_response", ("OBJECT<prompt, response>",), fields=(("user", "prompt"), ("assistant", "response"))),
    Mapping("instruction", ("OBJECT<input, instruction, output>",),
            fields=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("messages", _list_shapes("messages", "role", "content"), items="messages", role="role", text="content"),
    Mapping("from_value", _list_shapes("conversations", "from", "value"), items="conversations", role="from", text="value",
            roles={"human": "user", "gpt": "assistant"}),
)


LONG_RECORD = 1_000_000  # characters from which a record's texts are emptied before its shape is parsed
MAX_SKELETON = 15_000_000  # bytes that the shape's parser surely takes
ANY_LENGTH = {"maxStringLen": str((1 << 31) - 1)}  # the parser's own limit on a text is 20 million characters


def without_texts(record: Column) -> Column:
    """The JSON text with every string value emptied: the same field names in the same nesting."""
    # without escaped backslashes and quotes, every quote left opens or closes a string
    bare = F.replace(F.replace(record, F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit(""))

    def emptied(parts):  # odd parts are strings; one before a colon is a field name
        return F.array_join(F.transform(parts, lambda p, i: F.when(
            (i % 2 == 0) | F.ltrim(F.get(parts, i + 1)).startswith(":"), p).otherwise("")), '"')

    return bind(F.split(bare, '"'), emptied)


def skeleton(record: Column) -> Column:
    """``without_texts``, less the flat elements of a list that then equal the one just before them."""
    def distinct(items):
        return F.array_join(F.filter(items, lambda x, i: (i == 0) | (x != F.get(items, i - 1)) | x.rlike(r"[\[\]{}]")), "},{")

    return bind(F.split(without_texts(record), r"\},\{"), distinct)


def shape(record: Column) -> Column:
    """Nested field names of a JSON text, types left out: ``OBJECT<messages: ARRAY<OBJECT<content, role>>>``."""
    def typed_shape(short):
        parsed = F.try_parse_json(short)
        # more than the parser takes even without texts: an error, never a record without turns
        return F.schema_of_variant(F.when(parsed.isNull() & (F.octet_length(short) >= MAX_SKELETON), F.raise_error(F.concat(
            F.lit("a record with a skeleton of "), F.octet_length(short).cast("string"), F.lit(" bytes is too large for its shape to be parsed")))
            .cast("variant")).otherwise(parsed))

    typed = bind(F.when(F.length(record) >= LONG_RECORD, skeleton(record)).otherwise(record), typed_shape)
    scalar = r"(?:STRING|VOID|BOOLEAN|BIGINT|DOUBLE|FLOAT|DATE|TIMESTAMP_NTZ|TIMESTAMP|BINARY|VARIANT|UUID|DECIMAL\([0-9]+, ?[0-9]+\)|DECIMAL\([0-9]+,[0-9]+\))"
    return F.regexp_replace(F.regexp_replace(typed, rf": {scalar}(?=[,>])", ""), rf"ARRAY<{scalar}>", "ARRAY<>")


def fingerprint(record: Column) -> Column:
    return F.sha2(shape(record), 256)


def _turns(record: Column, m: Mapping) -> Column:
    if m.fields:
        schema = "struct<" + ",".join(f"`{f}`:string" for _, f in m.fields) + ">"
        return bind(F.from_json(record, schema, ANY_LENGTH), lambda r: F.array(*[F.struct(
            F.lit(role).alias("role"), or_empty(r[f]).alias("text")) for role, f in m.fields]))
    schema = f"struct<`{m.items}`:array<struct<`{m.role}`:string,`{m.text}`:string>>>"
    rename = lambda c: F.coalesce(*[F.when(c == a, F.lit(b)) for a, b in m.roles.items()], c)
    items = F.coalesce(F.from_json(record, schema, ANY_LENGTH)[m.items], F.array().cast(f"array<struct<`{m.role}`:string,`{m.text}`:string>>"))
    return F.transform(items, lambda x: F.struct(rename(or_empty(x[m.role])).alias("role"), or_empty(x[m.text]).alias("text")))


def canonical(records: DataFrame, key: str, record: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``key``, ``layout`` (name of the mapping) and ``turns`` of JSON records in any known layout."""
    marked = records.select(F.col(key), F.col(record).alias("record_"), fingerprint(F.col(record)).alias("fp_"))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for m in mappings:
        chosen = F.col("fp_").isin([hashlib.sha256(s.encode()).hexdigest() for s in m.shapes])
        layout = F.when(chosen, F.lit(m.name)).otherwise(layout)
        turns = F.when(chosen, _turns(F.col("record_"), m)).otherwise(turns)
    return marked.select(key, layout.alias("layout"), turns.alias("turns"))


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def _piece_spans(heads: Column, bodies: Column) -> Column:
    """Code-point spans of the bodies in the concatenation of head, body and close mark of every turn."""
    whole = F.zip_with(heads, bodies, lambda h, b: (F.length(h) + F.length(b) + len(CLOSE)).cast("long"))
    return bind(prefix_sums(whole), lambda at: F.transform(heads, lambda h, i: F.struct(
        (F.get(at, i) + F.length(h)).alias("start"), (F.get(at, i) + F.length(h) + F.length(F.get(bodies, i))).alias("end"))))


def formatted(turns: Column) -> Column:
    """``struct<text, loss>`` of canonical turns: the formatted string and the loss mask's spans."""
    def build(parts):
        heads, bodies = F.transform(parts, lambda p: p["head"]), F.transform(parts, lambda p: p["body"])
        text = F.array_join(F.transform(parts, lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
        spans = bind(heads, lambda h: bind(bodies, lambda b: _piece_spans(h, b)))
        loss = bind(spans, lambda s: F.filter(s, lambda x, i: F.get(parts, i)["loss"]))
        return F.struct(text.alias("text"), loss.alias("loss"))

    parts = F.transform(turns, lambda t: F.struct(
        F.concat(F.lit("<turn "), escape(or_empty(t["role"])), F.lit(">")).alias("head"), escape(or_empty(t["text"])).alias("body"),
        (or_empty(t["role"]) == LOSS_ROLE).alias("loss")))
    return F.when(turns.isNotNull(), bind(parts, build))


def read_back(text: Column) -> Column:
    """Turns of a formatted string, each with the code-point span of its text."""
    def parse(pieces):
        heads = F.transform(pieces, lambda p: F.concat(F.substring_index(p, ">", 1), F.lit(">")))
        bodies = F.transform(pieces, lambda p: F.substr(p, F.length(F.substring_index(p, ">", 1)) + 2))
        return bind(heads, lambda hs: bind(bodies, lambda bs: bind(_piece_spans(hs, bs), lambda spans: F.transform(
            spans, lambda s, i: F.struct(unescape(F.regexp_extract(F.get(hs, i), "(?s)^<turn (.*)>$", 1)).alias("role"),
                                         unescape(F.get(bs, i)).alias("text"), s["start"].alias("start"), s["end"].alias("end"))))))

    pieces = F.split(text, CLOSE)
    return F.when(text == "", F.array().cast("array<struct<role:string,text:string,start:bigint,end:bigint>>")).otherwise(
        bind(pieces, lambda p: bind(F.slice(p, F.lit(1), F.size(p) - 1), parse)))


def under_mask(turns: Column, loss: Column) -> Column:
    """Unescaped text under the loss mask, in order: the read-back turns whose span is in the mask, found
    by one sort of both span lists."""
    def pick(both):
        mine = F.filter(both, lambda x, j: (x["i"] >= 0) & F.coalesce(
            (F.get(both, j - 1)["i"] < 0) & (F.get(both, j - 1)["at"] == x["at"]), F.lit(False)))
        return F.array_join(F.transform(mine, lambda x: F.get(turns, x["i"])["text"]), "")

    at = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))
    masks = F.transform(loss, lambda s: F.struct(at(s).alias("at"), F.lit(-1).alias("i")))
    own = F.transform(turns, lambda t, i: F.struct(at(t).alias("at"), i.alias("i")))
    return bind(F.sort_array(F.concat(masks, own)), pick)


def format_records(records: DataFrame, key: str, record: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``key``, ``layout``, ``formatted`` (string) and ``loss`` (spans ``[start, end)`` of code points)."""
    f = canonical(records, key, record, mappings).withColumn("f_", formatted(F.col("turns")))
    return f.select(key, "layout", F.col("f_.text").alias("formatted"), F.col("f_.loss").alias("loss"))


def as_records(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversation rows as JSON records ``(key, record)`` in the layout that fits: two turns user and
    assistant as prompt and completion, three with a system turn before them as an instruction, other
    chats of the usual roles as from and value (odd ids), everything else as messages."""
    turns = F.sort_array(F.collect_list(F.struct(F.col(turn).alias("n"), or_empty(F.col(role)).alias("role"),
                                                 or_empty(F.col(text)).alias("content"))))
    g = rows.groupBy(F.col(key).alias("key_")).agg(turns.alias("t_"))
    t = F.col("t_")
    roles = F.transform(t, lambda x: x["role"])
    said = lambda i: F.get(t, F.lit(i))["content"]
    usual = F.forall(roles, lambda r: r.isin("user", "assistant", "system"))
    outer = F.create_map(F.lit("user"), F.lit("human"), F.lit("assistant"), F.lit("gpt"), F.lit("system"), F.lit("system"))
    record = F.when(roles == F.array(F.lit("user"), F.lit("assistant")), F.to_json(F.struct(
        said(0).alias("prompt"), said(1).alias("completion")))) \
        .when(roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")), F.to_json(F.struct(
            said(0).alias("instruction"), said(1).alias("input"), said(2).alias("output")))) \
        .when(usual & (F.pmod(F.col("key_"), F.lit(2)) == 1), F.to_json(F.struct(F.transform(t, lambda x: F.struct(
            F.try_element_at(outer, x["role"]).alias("from"), x["content"].alias("value"))).alias("conversations")))) \
        .otherwise(F.to_json(F.struct(F.transform(t, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
                                      .alias("messages"))))
    return g.select(F.col("key_").alias(key), record.alias("record"))

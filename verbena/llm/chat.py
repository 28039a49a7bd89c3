"""Chat formatting [native]: schema fingerprints pick declarative mappings; turns render with a loss mask, reversibly."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role: string, text: string>>"
START, SEP, END = "<|start|>", "<|sep|>", "<|end|>\n"
#: Control strings of this and other common templates; a backslash after their first character breaks them.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPE = "\\"
LOSS_ROLE = "assistant"


@dataclass(frozen=True)
class Layout:
    """A record layout. example gives the field paths; optional names top-level scalars that may be present or not.

    Either items (path of a list), role and text (its fields), or fixed: (role, paths joined by a blank line) per turn.
    """

    name: str
    example: dict
    items: str = ""
    role: str = ""
    text: str = ""
    fixed: tuple = ()
    roles: dict = field(default_factory=dict)
    optional: tuple = ("id",)

    def paths(self) -> list[str]:
        own = [k for k in self.optional if k not in self.example]
        return [_paths(self.example | dict.fromkeys(extra, "")) for n in range(len(own) + 1) for extra in combinations(own, n)]

    def turns(self, record: Column) -> Column:
        def text(value: Column) -> Column:
            return F.coalesce(value, F.lit(""))

        if self.fixed:
            got = [F.struct(F.lit(role).alias("role"), F.array_join(F.filter(F.array(*(text(F.variant_get(record, p, "string")) for p in paths)), lambda x: x != ""), "\n\n").alias("text")) for role, paths in self.fixed]
            return F.array(*got).cast(TURNS)
        kind = f"array<struct<`{self.role}`: string, `{self.text}`: string>>"
        items = F.variant_get(record, self.items, kind) if self.items else F.array(F.struct(F.variant_get(record, f"$.{self.role}", "string").alias(self.role), F.variant_get(record, f"$.{self.text}", "string").alias(self.text)))

        def turn(x: Column) -> Column:
            role = text(x[self.role])
            for theirs, ours in self.roles.items():
                role = F.when(text(x[self.role]) == theirs, F.lit(ours)).otherwise(role)
            return F.struct(role.alias("role"), text(x[self.text]).alias("text"))

        return F.transform(items, turn).cast(TURNS)


def _paths(value: object) -> str:
    if isinstance(value, dict):
        return "OBJECT<" + ", ".join(f"{k}: {_paths(v)}" for k, v in sorted(value.items())) + ">"
    if isinstance(value, list):
        return f"ARRAY<{_paths(value[0])}>"
    return "v"


_HUMAN = {"human": "user", "gpt": "assistant"}
LAYOUTS = (
    Layout("turn_row", {"role": "", "text": ""}, role="role", text="text"),
    Layout("messages", {"messages": [{"role": "", "content": ""}]}, items="$.messages", role="role", text="content"),
    Layout("from_value", {"conversations": [{"from": "", "value": ""}]}, items="$.conversations", role="from", text="value", roles=_HUMAN),
    Layout("instruction", {"instruction": "", "input": "", "output": ""}, fixed=(("user", ("$.instruction", "$.input")), ("assistant", ("$.output",)))),
    Layout("instruction_only", {"instruction": "", "output": ""}, fixed=(("user", ("$.instruction",)), ("assistant", ("$.output",)))),
    Layout("prompt_completion", {"prompt": "", "completion": ""}, fixed=(("user", ("$.prompt",)), ("assistant", ("$.completion",)))),
    Layout("prompt_response", {"prompt": "", "response": ""}, fixed=(("user", ("$.prompt",)), ("assistant", ("$.response",)))),
    Layout("system_prompt", {"system": "", "prompt": "", "response": ""}, fixed=(("system", ("$.system",)), ("user", ("$.prompt",)), ("assistant", ("$.response",)))),
)


def fingerprint(record: Column) -> Column:
    """A hash of a variant's nested field paths; scalar types don't count."""
    scalar = r"(?<=[ <])[A-Z_]+(\(\d+,\d+\))?(?=[,>]|$)"
    return F.xxhash64(F.regexp_replace(F.schema_of_variant(record), scalar, "v"))


def canonical_turns(records: DataFrame, record: str = "record", layouts: tuple = LAYOUTS) -> DataFrame:
    """Adds layout (null if no mapping has the record's fingerprint) and turns: array of (role, text), empty without a layout."""
    got = records.withColumn("fp", fingerprint(F.col(record)))
    name, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for layout in reversed(layouts):
        fits = F.col("fp").isin(*(F.xxhash64(F.lit(p)) for p in layout.paths()))
        name = F.when(fits, F.lit(layout.name)).otherwise(name)
        turns = F.when(fits, F.coalesce(layout.turns(F.col(record)), F.array().cast(TURNS))).otherwise(turns)
    return got.withColumn("layout", name).withColumn("turns", turns).drop("fp")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + ESCAPE + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(records: DataFrame, key: str, order: str, record: str = "record") -> DataFrame:
    """Records (key, order, variant record) -> one row per key: key, layouts, formatted, loss.

    A key's records join by rising order (nulls first; ties by turns). formatted is the rendered conversation; loss has for
    each turn the offset and length (code points, from the turn's start mark) that count for the loss: an assistant's text
    without its marks. Null roles and texts are empty strings, records of unknown layout have no turns, and columns other
    than the three are ignored. A conversation is one value, so it must fit into a string; keys spread over all tasks.
    """
    rows = canonical_turns(records.select(F.col(key).alias("key"), F.col(order).alias("ord"), F.col(record).alias("record")))
    held = rows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("ord", "turns", "layout"))).alias("held"))
    chats = held.select("key", F.array_distinct(F.filter(F.transform("held", lambda x: x["layout"]), lambda x: x.isNotNull())).alias("layouts"), F.flatten(F.transform("held", lambda x: x["turns"])).alias("turns"))

    def render(t: Column) -> Column:
        role, text = escape(t["role"]), escape(t["text"])
        loss = t["role"] == LOSS_ROLE
        return F.struct(
            F.concat(F.lit(START), role, F.lit(SEP), text, F.lit(END)).alias("rendered"),
            (F.lit(len(START) + len(SEP)) + F.length(role)).alias("start"),
            F.when(loss, F.length(text)).otherwise(0).alias("length"),
        )

    done = chats.select("key", "layouts", F.transform("turns", render).alias("r"))
    return done.select(F.col("key").alias(key), "layouts", F.array_join(F.transform("r", lambda x: x["rendered"]), "").alias("formatted"), F.transform("r", lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss"))


def parse_chats(formatted: DataFrame, key: str) -> DataFrame:
    """Reads format_chats' output back: key, turns (role, text), loss_texts (unescaped, in order), formatted_chars."""
    end = END.replace("|", r"\|")
    parts = F.split("formatted", end)
    parts = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(p: Column) -> Column:
        halves = F.split(p, SEP.replace("|", r"\|"))
        return F.struct(unescape(F.substr(halves[0], F.lit(len(START) + 1))).alias("role"), unescape(halves[1]).alias("text"))

    cut = F.zip_with("parts", "loss", lambda p, m: F.when(m["length"] > 0, unescape(F.substr(p, m["start"] + 1, m["length"]))))
    got = formatted.select(key, "formatted", "loss", parts.alias("parts"))
    return got.select(key, F.transform("parts", turn).alias("turns"), F.filter(cut, lambda x: x.isNotNull()).alias("loss_texts"), F.length("formatted").cast("long").alias("formatted_chars"))

"""Chat formatting by schema fingerprints (operator 7).

Records come as JSON text in unlike layouts.  Of the nested field paths
that the layouts know, those that a record has with a text (or null) in them
are hashed; the hash selects a declarative mapping, which turns the record
into canonical turns ``array<struct<role, text>>``.  Paths that no layout
knows do not matter, so further fields do no harm.  Canonical turns are
written with one template: turn marks around each turn, a loss mask over the
assistant texts, and control strings inside texts escaped so that they can
be read back.  Everything is DataFrame functions, and takes time in
proportion to the record, however many turns it has.

Defined cases: null texts and roles are empty; an optional path that is
missing gives no turn; a record that is null, not JSON, has something else
than a text where a layout wants one, or no known layout has null turns
(``layout`` null) and is left for the caller to count; of several layouts
that fit, the first of ``LAYOUTS`` is taken; empty message lists give no
turns (layout ``no_messages``), null messages are left out; ties of a turn number are ordered by
role, then text; rows with a null turn come first; repeated rows are
repeated turns; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermart.llm.common import col

TURNS = "array<struct<role: string, text: string>>"

#: The layouts: name and mapping.  ``list``: the path of a message list, and
#: the paths of role and text in a message.  ``fields``: (role, path, must be
#: there) in turn order.
LAYOUTS = [
    {"name": "messages", "list": ("messages", "role", "content")},
    {"name": "conversations", "list": ("conversations", "from", "value")},
    {"name": "prompt", "fields": [("user", "prompt", True), ("assistant", "completion", True)]},
    {"name": "instruction", "fields": [("system", "system", False), ("user", "instruction", True), ("assistant", "output", True)]},
    {"name": "question", "fields": [("user", "data.question", True), ("assistant", "data.answer", True)]},
]

#: Role names of the list layouts and their canonical names.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant"}

TURN_START, TURN_END = "<|im_start|>", "<|im_end|>\n"
#: Control strings: an opening character and the rest.  An escaped control
#: string has one more backslash between the two than the plain text had.
CONTROL = r"([<\[])(\\*)(\|[A-Za-z_]+\|>|/?s>|/?INST\]|<?/?SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL.replace(r"(\\*)", r"\\(\\*)"), "$1$2$3")


def _at(value: Column | str, path: str) -> Column:
    """What stands at a path of a variant: SQL NULL only where nothing does."""
    return F.try_variant_get(value, f"$.{path}", "variant")


def _is_text(kind: Column) -> Column:
    return kind.isin("STRING", "VOID")


def _list_paths(rule: dict) -> list[str]:
    path, role, text = rule["list"]
    return [f"{path}[]", f"{path}[].{role}", f"{path}[].{text}"]


def layout_paths(rule: dict) -> list[str]:
    """The nested field paths that a layout knows, sorted."""
    return sorted(_list_paths(rule) if "list" in rule else [path for _, path, _ in rule["fields"]])


def layout_fingerprints(rule: dict) -> list[Column]:
    """The fingerprints that select a layout: its paths with and without
    each optional one; a message list may be empty."""
    if "list" in rule:
        some = [_list_paths(rule), _list_paths(rule)[:1]]
    else:
        some = [[]]
        for _, path, must in rule["fields"]:
            some = [s + [path] for s in some] + ([] if must else some)
    return [fingerprint(F.lit(",".join(sorted(s)))) for s in some]


def fingerprint(paths: Column) -> Column:
    """Hash of nested field paths (sorted, comma-joined)."""
    return F.xxhash64(paths)


def _kinds(items: Column, key: str) -> Column:
    """The kind of what stands at ``key`` in every message, empty for nothing."""
    return F.transform(items, lambda m: F.coalesce(F.schema_of_variant(_at(m, key)), F.lit("")))


def known_paths(value: Column | str) -> Column:
    """The paths of a record that some layout knows and that hold a text or
    null; a message list counts as ``path[]``, and a path in its messages if
    one of them has it and none has anything else there."""
    found = []
    for rule in LAYOUTS:
        if "list" in rule:
            items = F.try_variant_get(value, f"$.{rule['list'][0]}", "array<variant>")
            whole, *inner = _list_paths(rule)
            found.append(F.when(items.isNotNull(), F.lit(whole)))
            for path, key in zip(inner, rule["list"][1:]):
                kinds = _kinds(items, key)
                found.append(F.when(F.forall(kinds, lambda k: (k == "") | _is_text(k)) & F.exists(kinds, lambda k: k != ""), F.lit(path)))
        else:
            found += [F.when(_is_text(F.schema_of_variant(_at(value, path))), F.lit(path)) for _, path, _ in rule["fields"]]
    return F.array_sort(F.array_compact(F.array(*found)))


def canonical_turns(records: DataFrame, json_col: str = "record") -> DataFrame:
    """Add ``layout`` and ``turns`` to JSON records of unlike layouts."""
    parsed = records.withColumn("__v", F.try_parse_json(col(json_col)))
    parsed = parsed.withColumn("__p", known_paths("__v"))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for rule in reversed(LAYOUTS):
        mine = F.array_intersect("__p", F.array(*[F.lit(p) for p in layout_paths(rule)]))
        here = fingerprint(F.array_join(mine, ",")).isin(*layout_fingerprints(rule))
        name = F.when(F.size(mine) == 1, F.lit(f"no_{rule['name']}")).otherwise(F.lit(rule["name"])) if "list" in rule else F.lit(rule["name"])
        layout = F.when(here, name).otherwise(layout)
        turns = F.when(here, _mapped(rule)).otherwise(turns)
    return parsed.withColumn("layout", layout).withColumn("turns", turns).drop("__v", "__p")


def _mapped(rule: dict) -> Column:
    if "list" in rule:
        path, role, text = rule["list"]
        items = F.try_variant_get("__v", f"$.{path}", "array<variant>")

        def turn(m):
            name = F.coalesce(F.try_variant_get(m, f"$.{role}", "string"), F.lit(""))
            ours = name
            for theirs, canonical in ROLES.items():
                ours = F.when(name == theirs, F.lit(canonical)).otherwise(ours)
            return F.struct(ours.alias("role"), F.coalesce(F.try_variant_get(m, f"$.{text}", "string"), F.lit("")).alias("text"))
        return F.transform(F.filter(items, lambda m: m.isNotNull() & ~F.is_variant_null(m)), turn)
    return F.array_compact(F.array(*[F.when(F.array_contains("__p", path), F.struct(
        F.lit(role).alias("role"), F.coalesce(F.try_variant_get("__v", f"$.{path}", "string"), F.lit("")).alias("text")))
        for role, path, _ in rule["fields"]]))


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _role_in(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def format_turns(turns: Column, loss_role: str = "assistant") -> Column:
    """``struct<formatted, mask>``: the text of the conversation, and one
    (length, loss) run after another that covers it from start to end."""
    pieces = F.flatten(F.transform(turns, lambda t: F.array(
        F.struct(F.concat(F.lit(TURN_START), _role_out(t["role"]), F.lit("\n")).alias("piece"), F.lit(False).alias("loss")),
        F.struct(escape(t["text"]).alias("piece"), (t["role"] == loss_role).alias("loss")),
        F.struct(F.lit(TURN_END).alias("piece"), F.lit(False).alias("loss")))))
    return F.struct(F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("formatted"),
                    F.transform(pieces, lambda p: F.struct(F.length(p["piece"]).alias("n"),
                                                           p["loss"].alias("loss"))).alias("mask"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, texts unescaped."""
    chunks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda c: c != "")
    return F.transform(chunks, lambda c: F.struct(
        _role_in(F.regexp_extract(c, r"^<\|im_start\|>([^\n]*)\n", 1)).alias("role"),
        unescape(F.regexp_replace(c, r"^<\|im_start\|>[^\n]*\n", "")).alias("text")))


def read_loss(formatted: Column, mask: Column) -> Column:
    """The unescaped text under the loss mask, run after run.  A turn has
    three runs (mark, text, mark); each is cut from its own turn, so the
    text is never searched from its start."""
    heads = F.filter(mask, lambda m, i: i % 3 == 0)
    texts = F.filter(mask, lambda m, i: i % 3 == 1)
    runs = F.zip_with(heads, texts, lambda h, t: F.struct(h["n"].alias("at"), t["n"].alias("n"), t["loss"].alias("loss")))
    turns = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda c: c != "")
    return F.array_join(F.zip_with(turns, runs, lambda c, r: F.when(
        r["loss"], unescape(F.substring(c, r["at"] + 1, r["n"]))).otherwise(F.lit(""))), "")


def records_of(rows: DataFrame) -> DataFrame:
    """Rows by turn (conv_id, turn, role, text) as one JSON record per
    conversation, in the plainest layout that fits its roles.  Turns of one
    conversation meet in one row by definition; different conversations are
    spread by their id, and map-side lists halve what is shuffled."""
    turn = F.struct(col("turn").alias("turn"), F.coalesce(col("role"), F.lit("")).alias("role"),
                    F.coalesce(col("text"), F.lit("")).alias("text"))
    grouped = rows.groupBy(col("conv_id").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("t"))
    roles = F.array_join(F.transform("t", lambda x: F.concat(F.length(x["role"]).cast("string"), F.lit(":"), x["role"])), ",")

    def text(i):
        return F.get("t", F.lit(i))["text"]
    messages = F.to_json(F.struct(F.transform("t", lambda x: F.struct(
        x["text"].alias("content"), x["role"].alias("role"))).alias("messages")))
    pair = F.to_json(F.struct(text(1).alias("completion"), text(0).alias("prompt")))
    triple = F.to_json(F.struct(text(1).alias("instruction"), text(2).alias("output"), text(0).alias("system")))
    return grouped.select("conv_id", F.when(roles == "4:user,9:assistant", pair)
                          .when(roles == "6:system,4:user,9:assistant", triple).otherwise(messages).alias("record"))


def chat_format(records: DataFrame, id_col: str = "conv_id", json_col: str = "record") -> DataFrame:
    """(id, layout, formatted, mask) of JSON records of any known layout."""
    turns = canonical_turns(records.select(col(id_col).alias("conv_id"), col(json_col).alias("record")))
    # an unused second reader of ``turns`` would be folded away: keep it as a column
    return turns.select("conv_id", "layout", "turns", format_turns(F.col("turns")).alias("out")).select(
        "conv_id", "layout", "out.formatted", "out.mask")

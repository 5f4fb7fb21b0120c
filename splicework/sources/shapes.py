"""Shape rules as one table, compiled to one expression per list of records."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.quality import id_ok


@dataclass(frozen=True)
class Rule:
    """What a field must be in records of some kinds (none named: in all); a null field breaks it only if it is required."""

    field: str
    says: str
    holds: Callable[[Column], Column]
    kinds: tuple[str, ...] = ()
    required: bool = False


def _number(low: float, high: float) -> Callable[[Column], Column]:
    return lambda c: c.try_cast("double").between(low, high)


def _whole(c: Column) -> Column:
    return c.rlike(r"^-?\d+$") & (c.try_cast("bigint") >= 0)


def _text(longest: int) -> Callable[[Column], Column]:
    return lambda c: F.char_length(c) <= longest


def _an(kind: str) -> Callable[[Column], Column]:
    return lambda c: id_ok(kind, c)


#: Kinds of edits that name a clip.
_ON_CLIPS = ("trim", "split", "remove", "setEnabled", "move", "setSpeed", "addEffect", "setColor", "setTransform", "removeEffect", "setAudio", "setLabel", "duplicateClip")
# The shapes of edits, with their bounds.
OP_RULES = (
    Rule("op", "unknown kind", lambda c: c.isin(*_ON_CLIPS, "insertClip"), required=True),
    Rule("rationale", "at most 1000 characters", _text(1000)),
    Rule("clipId", "expected a clip id", _an("clip"), _ON_CLIPS, True),
    Rule("clipId", "expected a clip id", _an("clip"), ("insertClip",)),
    Rule("sourceIn", "expected whole microseconds from 0", _whole, ("trim",)),
    Rule("sourceOut", "expected whole microseconds from 0", _whole, ("trim",)),
    Rule("sourceIn", "expected whole microseconds from 0", _whole, ("insertClip",), True),
    Rule("sourceOut", "expected whole microseconds from 0", _whole, ("insertClip",), True),
    Rule("at", "expected whole microseconds from 0", _whole, ("split",), True),
    Rule("at", "expected after or start", lambda c: c.isin("after", "start"), ("duplicateClip",)),
    Rule("newClipId", "expected a clip id", _an("clip"), ("split", "duplicateClip")),
    Rule("enabled", "expected true or false", lambda c: c.isin("true", "false"), ("setEnabled",), True),
    Rule("toIndex", "expected a whole number from 0", _whole, ("move",), True),
    Rule("speed", "expected a number from 0.05 to 20", _number(0.05, 20), ("setSpeed",), True),
    Rule("speed", "expected a number from 0.05 to 20", _number(0.05, 20), ("insertClip",)),
    Rule("effect", "expected an effect", lambda c: F.get_json_object(c, "$.type").isNotNull() & id_ok("effect", F.get_json_object(c, "$.id")), ("addEffect",), True),
    Rule("effectId", "expected an effect id", _an("effect"), ("removeEffect",), True),
    Rule("audio", "expected gain from 0 to 8 and mute", lambda c: c.startswith("{") & F.coalesce(_number(0, 8)(F.get_json_object(c, "$.gain")), F.get_json_object(c, "$.gain").isNull())
         & F.coalesce(F.get_json_object(c, "$.mute").isin("true", "false"), F.lit(True)), ("setAudio",), True),
    Rule("label", "expected at most 200 characters", _text(200), ("setLabel",), True),
    Rule("trackId", "expected a track id", _an("track"), ("insertClip",), True),
    Rule("sourceId", "expected a source id", _an("source"), ("insertClip",), True),
    Rule("atIndex", "expected a whole number from 0", _whole, ("insertClip",)),
)
#: Clips of documents.
CLIP_RULES = (
    Rule("id", "expected a clip id", _an("clip"), required=True),
    Rule("sourceId", "expected a source id", _an("source"), required=True),
    Rule("sourceIn", "expected whole microseconds from 0", lambda c: c >= 0, required=True),
    Rule("sourceOut", "expected whole microseconds from 0", lambda c: c >= 0, required=True),
    Rule("start", "expected whole microseconds from 0", lambda c: c >= 0, required=True),
    Rule("speed", "expected a number from 0.05 to 20", lambda c: c.between(0.05, 20.0)),
    Rule("audio.gain", "expected a number from 0 to 8", lambda c: c.between(0.0, 8.0)),
    Rule("label", "at most 200 characters", _text(200)),
)


def _field(record: Column, path: str) -> Column:
    for name in path.split("."):
        record = record[name]
    return record


def broken(records: Column, rules: tuple[Rule, ...], at: Column, kind: str | None = None) -> Column:
    """Issues of a list of records, ``path.field: what was expected``, in order; no issue for a null list.

    ``at`` is the list's own path; ``kind`` names the field that says which rules hold for a record.
    """
    def of(record: Column, i: Column) -> Column:
        found = []
        for rule in rules:
            value = _field(record, rule.field)
            wrong = F.coalesce(~rule.holds(value), F.lit(rule.required))
            if rule.kinds:
                wrong = wrong & F.coalesce(record[kind].isin(*rule.kinds), F.lit(False))
            found.append(F.when(wrong, F.concat(at, F.lit("["), i.cast("string"), F.lit(f"].{rule.field}: {rule.says}"))))
        return F.array_compact(F.array(*found))

    return F.coalesce(F.flatten(F.transform(records, of)), F.array().cast("array<string>"))

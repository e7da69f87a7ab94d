"""Text columns: keys, ids, numbers and JSON inside text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_key(value: Column, upper: bool = False) -> Column:
    """A key as text: trimmed, without a trailing `.0`."""
    text = F.trim(F.regexp_replace(value.cast("string"), r"\.0$", ""))
    return F.upper(text) if upper else text


def route_key(origin: Column, destination: Column) -> Column:
    return F.concat(origin, F.lit("_"), destination)


def flight_key(airline: Column, number: Column, date: Column) -> Column:
    """AIRLINE|NUMBER|YYYY-MM-DD."""
    return F.concat(F.trim(airline), F.lit("|"), F.trim(number), F.lit("|"), F.date_format(date, "yyyy-MM-dd"))


def flight_display(airline: Column, number: Column, destination: Column, delay: Column, date: Column) -> Column:
    return F.concat(
        F.trim(airline), F.trim(number), F.lit(" to "), F.trim(destination), F.lit(" ("),
        delay.cast("int").cast("string"), F.lit(" min delay on "), F.date_format(date, "yyyy-MM-dd"), F.lit(")"),
    )


def first_int(value: Column, default: int = 45) -> Column:
    """A numeric value kept as whole minutes, else the first number in the text."""
    text = F.trim(value.cast("string"))
    number = F.when(text.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), text.try_cast("double").try_cast("bigint"))
    digits = F.regexp_extract(text, r"([0-9]+)", 1).try_cast("bigint")
    return F.coalesce(number, digits, F.lit(default).cast("bigint"))


def duration_minutes(value: Column, default: int = 45) -> Column:
    """Like `first_int`, but reads '1 hours 15 minutes' as 75."""
    text = F.trim(value.cast("string"))
    hours = F.regexp_extract(text, r"([0-9]+)\s*h", 1).try_cast("bigint")
    minutes = F.regexp_extract(text, r"([0-9]+)\s*m", 1).try_cast("bigint")
    zero = F.lit(0).cast("bigint")
    spelled = F.when(
        hours.isNotNull() | minutes.isNotNull(), F.coalesce(hours, zero) * 60 + F.coalesce(minutes, zero)
    )
    return F.coalesce(spelled, first_int(value, default))


def embedded_json(text: Column) -> Column:
    """Top-level members of the JSON object inside a text; null if there is none.

    Keys are case-sensitive, as in JSON.
    """
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    body = F.when(body != "", body).otherwise(text)
    return F.from_json(body, "map<string,string>", {"allowSingleQuotes": "false", "mode": "PERMISSIVE"})


def cause_reply(text: Column) -> Column:
    """Cause, second cause and search text of an outside model's reply; null if unreadable."""
    members = embedded_json(text)
    primary = F.coalesce(members["primary_cause"], F.lit("Unknown"))
    return F.when(
        members.isNotNull(),
        F.struct(
            primary.alias("primary_cause"),
            F.coalesce(members["secondary_cause"], F.lit("None")).alias("secondary_cause"),
            F.coalesce(members["search_query"], primary).alias("search_query"),
        ),
    )


def _filled(value: Column) -> Column:
    return F.when(value != "", value)


def whole_json(text: Column) -> Column:
    """Top-level members of a text that is one JSON object and nothing else; null otherwise."""
    body = F.trim(text)
    members = F.from_json(body, "map<string,string>", {"allowSingleQuotes": "false", "mode": "PERMISSIVE"})
    return F.when(body.startswith("{") & body.endswith("}"), members)


def action_reply(text: Column, default_action: str, default_reasoning: str) -> Column:
    """Action and reasoning of an outside model's reply; null unless the whole reply is JSON."""
    members = whole_json(text)
    return F.when(
        members.isNotNull(),
        F.struct(
            F.coalesce(_filled(members["action"]), _filled(members["Action"]), F.lit(default_action)).alias("action"),
            F.coalesce(
                _filled(members["reasoning"]), _filled(members["Reasoning"]), F.lit(default_reasoning)
            ).alias("reasoning"),
        ),
    )

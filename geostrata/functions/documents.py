"""Addresses in nested documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A text of a JSON document, or a sign of its structure. Fixed by the format.
_TOKEN = r'"(?:[^"\\]|\\.)*"|[{}\[\]:]'
_URL = r"""https?://[^\s"'<>\\)\]]+"""
_STATE = "struct<depth: int, until: int, cut: boolean, found: array<string>>"


def harvest(doc: Column, skip: tuple[str, ...] = ("geometry",)) -> Column:
    """Addresses in the texts of a JSON document, each once, in the order of the document, but for the values of the names in ``skip``.

    The tokens of the document are passed once with a state: how deep the place is, and to which depth everything is cut
    since a name of ``skip`` has been read. Braces in texts are no structure; a name at any depth cuts its whole value,
    whatever is in it. A document that is null gives null; one that is no JSON gives what its texts hold.
    """
    tokens = F.regexp_extract_all(doc, F.lit(_TOKEN), F.lit(0))
    pairs = F.arrays_zip(tokens.alias("t"), F.concat(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), F.array(F.lit(""))).alias("next"))
    names = [f'"{n}"' for n in skip]

    def text(t: Column) -> Column:
        return F.coalesce(F.get_json_object(F.concat(F.lit('{"t":'), t, F.lit("}")), "$.t"), t)

    def step(s: Column, p: Column) -> Column:
        t, named = p["t"], p["next"] == ":"
        opens, closes = t.isin("{", "["), t.isin("}", "]")
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        within = s["until"].isNotNull()
        is_text = t.startswith('"') & ~named
        begins = ~within & s["cut"] & opens
        until = F.when(begins, s["depth"]).when(within & closes & (depth == s["until"]), F.lit(None)).otherwise(s["until"])
        # a name cuts the value after it: a text goes by itself, a list or an object until it is closed
        cut = F.when(~within & named & t.isin(*names), True).when(t == ":", s["cut"]).otherwise(False)
        urls = F.when(~within & ~s["cut"] & is_text & t.contains("http"), F.regexp_extract_all(text(t), F.lit(_URL), F.lit(0))).otherwise(F.array().cast("array<string>"))
        found = F.when(F.size(urls) > 0, F.concat(s["found"], urls)).otherwise(s["found"])
        return F.struct(depth.cast("int").alias("depth"), until.cast("int").alias("until"), cut.alias("cut"), found.alias("found")).cast(_STATE)

    start = F.struct(F.lit(0).alias("depth"), F.lit(None).cast("int").alias("until"), F.lit(False).alias("cut"), F.array().cast("array<string>").alias("found")).cast(_STATE)
    return F.array_distinct(F.aggregate(pairs, start, step)["found"])

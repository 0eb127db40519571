"""Capture of messy text: checks, a model's items, verification against the input, names and files as rows."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import models, records

#: Most bytes of an input, calls an hour, items of an input, characters of a name; kinds of items.
LARGEST, AN_HOUR, MOST, NAME = 50_000, 60, 20, 80
KINDS = ["decision", "discovery", "correction", "gotcha"]
ITEMS = "items array<struct<title:string,kind:string,body:string,one_line_summary:string,confidence:string>>, filtered_out_count int"


def stub(prompt: str) -> str:
    """A model that keeps every paragraph of its input as an item."""
    body = prompt.split("\n>>>\n", 1)[-1].rsplit("\n<<<", 1)[0]
    parts = [p for p in body.split("\n\n") if p.strip()]
    return json.dumps({"items": [{"title": p.strip().split("\n")[0][:60], "kind": "discovery", "body": p, "one_line_summary": p.strip()[:100], "confidence": "stated"} for p in parts[:MOST]], "filtered_out_count": max(0, len(parts) - MOST)})


def provenance(label: Column, at: Column, chance: Column) -> Column:
    """A name for the group of an input's items: its label and time, or time and some hexadecimal digits."""
    stamp = F.date_format(at, "yyyy-MM-dd'T'HH-mm-ss'Z'")
    slug = F.substring(text.slug(label), 1, NAME)
    nothing = F.concat(F.lit("capture-"), stamp, F.lit("-"), F.substring(F.sha2(chance.cast("string"), 256), 1, 4))
    return F.when(F.trim(F.coalesce(label, F.lit(""))) == "", nothing).otherwise(F.concat(slug, F.lit("-"), stamp))


def rejected(content: Column, secret: Column) -> Column:
    """Why an input is refused, given the secret found in it, or null."""
    said = F.concat(F.lit("secret pattern detected at "), secret["place"], F.lit(" ("), secret["label"], F.lit(")"))
    return F.when(F.trim(F.coalesce(content, F.lit(""))) == "", "empty").when(F.octet_length(content) > LARGEST, "too large").when(secret.isNotNull(), said)


def escaped(content: Column) -> Column:
    """Lines that would close the input's fence in the prompt become harmless."""
    return F.regexp_replace(F.regexp_replace(content, r"(?im)^(?:<<<|---)[ \t]*END[- ]INPUT.*$", "--- END INPUT (escaped) ---"), r"(?im)^(?:<<<|---)[ \t]*INPUT.*$", "--- INPUT (escaped) ---")


def checked(inputs: DataFrame, an_hour: int = AN_HOUR) -> DataFrame:
    """inputs (id, content, label, at) with line ends made equal, provenance, and why one is refused: size, secrets, or more than an_hour calls in an hour."""
    rows = inputs.withColumn("content", F.regexp_replace("content", "\r\n?", "\n")).withColumn("provenance", provenance(F.col("label"), F.col("at"), F.col("id")))
    rows = rows.withColumn("secret", text.secret_found(F.col("content"))).withColumn("reason", rejected(F.col("content"), F.col("secret"))).drop("secret")
    calls = rows.where("reason IS NULL").select(F.col("id").alias("entry"), F.col("at").cast("long").alias("at"))
    late = records.limited(calls, an_hour, by=[]).where("NOT accepted").select(F.col("entry").alias("e"))
    return rows.join(late, F.col("id") == F.col("e"), "left").withColumn("reason", F.when(F.col("e").isNotNull(), "rate limit").otherwise(F.col("reason"))).drop("e")


def verified(answers: DataFrame) -> DataFrame:
    """(id, provenance, at, nth, title, kind, body) of items whose body stands in the input word for word; others are dropped."""
    asked = answers.select("id", "provenance", "at", "content", F.from_json("reply", ITEMS).alias("r"))
    rows = asked.select("id", "provenance", "at", "content", F.posexplode(F.slice("r.items", 1, MOST)).alias("nth", "x"))
    body = F.regexp_replace("x.body", r"\A\s+|\s+\z", "")
    return rows.withColumn("body", body).where((F.col("body") != "") & F.contains("content", F.col("body")) & F.col("x.kind").isin(KINDS)).select("id", "provenance", "at", "nth", "x.title", "x.kind", "body")


def named(items: DataFrame, taken: DataFrame) -> DataFrame:
    """items with a slug each that no other item and no name in taken (slug) has: kind and title, and a number from 2 where those are not enough.

    Numbers go on after the largest that the same base has already, so items of any number of
    inputs are named at once.
    """
    base = F.substring(text.slug(F.concat("kind", F.lit("-"), "title")), 1, NAME)
    rows = items.withColumn("base", F.when(base == "", F.col("kind")).otherwise(base))
    trimmed = lambda c: F.regexp_replace(F.substring(c, 1, NAME - 7), "-+$", "")  # noqa: E731  room for a hyphen and six digits
    rows = rows.withColumn("stem", trimmed(F.col("base")))
    number = F.try_to_number(F.regexp_extract("slug", r"-([0-9]{1,6})$", 1), F.lit("999999")).cast("long")
    last = taken.select(trimmed(F.regexp_replace("slug", r"-[0-9]{1,6}$", "")).alias("s"), F.coalesce(number, F.lit(1)).alias("k")).union(taken.select(trimmed(F.col("slug")), F.lit(1).cast("long")))
    last = last.groupBy("s").agg(F.max("k").alias("top"))
    order = Window.partitionBy("stem").orderBy("at", "id", "nth")
    rows = rows.join(last, F.col("stem") == F.col("s"), "left").withColumn("k", F.row_number().over(order) + F.coalesce("top", F.lit(0)))
    return rows.withColumn("slug", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat("stem", F.lit("-"), F.col("k").cast("string")))).drop("base", "stem", "s", "top", "k")


def files(items: DataFrame) -> DataFrame:
    """(slug, content): the Markdown of each item, with the names of the items that came with it."""
    own = items.select("id", "slug")
    beside = items.select("id", F.col("slug").alias("s")).join(own.withColumnRenamed("slug", "other"), "id").where("s <> other").groupBy("s").agg(F.array_sort(F.collect_list("other")).alias("beside"))
    rows = items.join(beside, F.col("slug") == F.col("s"), "left")
    quoted = lambda c: F.concat(F.lit('"'), text.yaml_escaped(c), F.lit('"'))
    listed = F.array_join(F.transform(F.coalesce("beside", F.array().cast("array<string>")), lambda x: F.concat(F.lit("\n  - "), x)), "")
    head = F.concat(F.lit("---\ntitle: "), quoted(F.col("title")), F.lit("\nkind: "), F.col("kind"), F.lit("\ncaptured_at: "), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("\ncaptured_from: "), quoted(F.col("provenance")), F.lit("\ncaptured_alongside:"), listed, F.lit("\n---\n\n"))
    return rows.select("slug", F.concat(head, F.col("body"), F.lit("\n")).alias("content"))


def capture(inputs: DataFrame, taken: DataFrame, model: Callable[[str], str] = stub, an_hour: int = AN_HOUR) -> tuple[DataFrame, DataFrame]:
    """(items with their slugs, refused inputs with their reasons) of inputs (id, content, label, at)."""
    rows = checked(inputs, an_hour)
    prompt = F.concat(F.lit("Split the text into at most "), F.lit(str(MOST)), F.lit(" items, word for word.\n>>>\n"), escaped(F.col("content")), F.lit("\n<<<"))
    answers = models.ask(rows.where("reason IS NULL").withColumn("prompt", prompt), "prompt", model)
    return named(verified(answers), taken), rows.where("reason IS NOT NULL").select("id", "provenance", "reason")

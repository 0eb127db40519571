"""Language models as an injected function. The default is a stub that answers from its input alone, so nothing here needs a network."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import ship


def stub(prompt: str) -> str:
    return json.dumps({"title": prompt.strip().split("\n")[0][:100], "summary": prompt.strip()[:200]})


def salvage(reply: str) -> dict | None:
    """The first JSON object in a reply, fences and talk around it or not."""
    for m in re.finditer(r"\{", reply or ""):
        try:
            return json.JSONDecoder().raw_decode(reply, m.start())[0]
        except ValueError:
            continue
    return None


def field_spec(spec: str) -> tuple[str, bool]:
    """(name, whether it is a list) of a template's line: name, name: text, or name (type): text; # starts a comment."""
    spec = spec.split("#")[0].strip()
    m = re.match(r"([A-Za-z_]\w*)\s*(?:\(([^)]*)\))?\s*(?::\s*(.*))?$", spec)
    if not m:
        raise ValueError(f"not a field: {spec!r}")
    hint = f"{m[2] or ''} {m[3] or ''}".lower()
    return m[1], bool(re.search(r"\blist\b|\barray\b|\[\]", hint)) or (m[2] is None and m[1].endswith("s") and "one " not in hint and "list of" in hint)


def extraction_schema(specs: list[str]) -> T.StructType:
    """A struct of strings and lists of strings; title or name, or else the first field, must be there."""
    fields = [field_spec(s) for s in specs]
    names = [n for n, _ in fields]
    needed = [n for n in ("title", "name") if n in names] or names[:1]
    return T.StructType([T.StructField(n, T.ArrayType(T.StringType()) if many else T.StringType(), n not in needed) for n, many in fields])


def patient(model: Callable[[str], str], attempts: int = 3, first: float = 1.0, most: float = 30.0) -> Callable[[str], str]:
    """The model, asked again after a failure, `attempts` times in all, with longer and longer waits; the last failure is raised."""

    def call(prompt: str) -> str:
        import time

        for k in range(attempts):
            try:
                return model(prompt)
            except Exception:  # noqa: BLE001  whatever a model's client raises
                if k == attempts - 1:
                    raise
                time.sleep(min(most, first * 2**k))
        raise ValueError("attempts must be 1 or more")

    return call


def ask(df: DataFrame, prompt_col: str, model: Callable[[str], str] = stub) -> DataFrame:
    """df with a reply to each prompt; the function is called in batches on the executors. Null and empty prompts have null replies."""

    ship(df.sparkSession)

    def run(batches):
        for pdf in batches:
            yield pdf.assign(reply=[model(p) if p else None for p in pdf[prompt_col]])

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("reply", T.StringType())]))


def extract(df: DataFrame, prompt_col: str, specs: list[str], model: Callable[[str], str] = stub) -> DataFrame:
    """df with the fields that a model finds; replies without JSON give nulls."""
    ship(df.sparkSession)
    schema = extraction_schema(specs)
    fields = [(f.name, isinstance(f.dataType, T.ArrayType)) for f in schema.fields]

    def clean(value, many: bool):
        if many:
            return [str(x) for x in value] if isinstance(value, list) else ([str(value)] if value else [])
        return str(value) if isinstance(value, (str, int, float)) else None

    def run(batches):
        for pdf in batches:
            found = [salvage(model(p)) if p else None for p in pdf[prompt_col]]
            yield pd.concat([pdf, pd.DataFrame({n: [clean((x or {}).get(n), many) for x in found] for n, many in fields}, index=pdf.index)], axis=1)

    return df.mapInPandas(run, T.StructType([*df.schema.fields, *(T.StructField(f.name, f.dataType) for f in schema.fields)]))

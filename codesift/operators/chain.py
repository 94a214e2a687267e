"""The data plane around a language model: templates, answers, keys, signatures.

The model itself is a function that the caller passes in.
"""

from __future__ import annotations

import hashlib
import hmac
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from codesift.runtime import cut_lineage

ANSWERS = "id BIGINT, steps INT, answer STRING, valid BOOLEAN"


def render(template: str, values: dict[str, Column]) -> Column:
    """``{name}`` replaced by the value of that name; a null value says so in its place."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("{unavailable: " + name + "}")))
    return out


def unfenced(text: Column) -> Column:
    """The text within a code fence, or the text itself."""
    inner = F.regexp_extract(text, r"(?s)^\s*```[A-Za-z]*[ \t]*\r?\n(.*?)\r?\n?[ \t]*```\s*$", 1)
    return F.trim(F.when(inner != "", inner).otherwise(text))


def parsed(text: Column, schema: str) -> Column:
    """The JSON within a text by ``schema``; null where it does not parse."""
    return F.from_json(unfenced(text), schema, {"mode": "PERMISSIVE"})


def parsed_or_raw(text: Column, schema: str) -> Column:
    """``value`` by ``schema`` where the text is a JSON object, or else ``raw_text``."""
    inner = unfenced(text)
    fits = inner.startswith("{") & F.try_parse_json(inner).isNotNull()
    return F.struct(F.when(fits, F.from_json(inner, schema)).alias("value"), F.when(~F.coalesce(fits, F.lit(False)), text).alias("raw_text"))


# The agents, and the steps of a chain with their temperatures.
AGENTS = ("security", "quality", "performance", "observability")
STEPS = (
    ("analyze", 0.1, "You review code for {agent}. List what the change below does and where it may go wrong.\n{text}"),
    ("generate", 0.2, "Write the findings on {agent} that follow from this analysis, as JSON.\n{analyze}"),
    ("critique", 0.1, "Name the findings on {agent} below that the change does not bear out.\n{generate}"),
    ("refine", 0.1, "Give the findings on {agent} again, as JSON, without what the critique refutes.\n{generate}\n{critique}"),
)


def templates(spark: SparkSession) -> DataFrame:
    """(agent, step, place, template, temperature): the prompts of each agent's chain, in order."""
    rows = [(agent, name, place, text.replace("{agent}", agent), heat) for agent in AGENTS for place, (name, heat, text) in enumerate(STEPS)]
    return spark.createDataFrame(rows, "agent STRING, step STRING, place INT, template STRING, temperature DOUBLE")


def run_per_file(parts: DataFrame, whole: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """(id, mode, file_path, answer, failed): a model on each part of (id, file_path, patch), or on (id, text) as a whole.

    A row of one part or none goes whole; of several, a part on which the model
    fails is marked and the others stand; where it fails on all, the row goes
    whole after all.  An answer on a whole that fails is marked as well.
    """

    def ask(column: str, mode: str):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                answers, failed = [], []
                for text in batch[column]:
                    try:
                        answers.append(model(text))
                        failed.append(False)
                    except Exception:  # noqa: BLE001 - whatever the caller's model raises
                        answers.append(None)
                        failed.append(True)
                yield pd.DataFrame({"id": batch["id"], "mode": mode, "file_path": batch["file_path"], "answer": pd.Series(answers, dtype=object, index=batch.index), "failed": failed})

        return run

    schema = "id BIGINT, mode STRING, file_path STRING, answer STRING, failed BOOLEAN"
    several = parts.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    # the model is asked once: its answers are kept before they are counted
    asked = cut_lineage(parts.join(several, "id", "left_semi").select("id", "file_path", "patch").mapInPandas(ask("patch", "files"), schema))
    good = asked.where("NOT failed").select("id").distinct()
    rest = whole.join(good, "id", "left_anti").select("id", F.lit(None).cast("string").alias("file_path"), "text").mapInPandas(ask("text", "whole"), schema)
    return asked.join(good, "id", "left_semi").unionByName(rest)


def run_chain(rows: DataFrame, steps: list[tuple[str, str]], model: Callable[[str], str], check: Callable[[str], bool], repairs: int = 2) -> DataFrame:
    """(id, steps, answer, valid): each row's ``text`` through the steps in order, then repaired until it passes.

    A step's template may name ``{text}`` and the answers of the steps before.
    Rows are independent, so they are spread over tasks; ``coalesce`` before
    the call bounds how many models run at once.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text in zip(batch["id"], batch["text"], strict=True):
                known, answer = {"text": text or ""}, ""
                for name, template in steps:
                    prompt = template
                    for k, v in known.items():
                        prompt = prompt.replace("{" + k + "}", v)
                    answer = known[name] = model(prompt)
                asked = len(steps)
                for _ in range(repairs):
                    if check(answer):
                        break
                    answer, asked = model("Repair: " + answer), asked + 1
                out.append((key, asked, answer, bool(check(answer))))
            yield pd.DataFrame(out, columns=["id", "steps", "answer", "valid"])

    return rows.select("id", "text").mapInPandas(fold, ANSWERS)


def signature(secret: str):
    """A pandas UDF: the ``sha256=`` signature of a body; null for a null body."""

    @F.pandas_udf("string")
    def sign(body: pd.Series) -> pd.Series:
        key = secret.encode()
        return body.map(lambda b: None if b is None else "sha256=" + hmac.new(key, b.encode(), hashlib.sha256).hexdigest())

    return sign


def verified(secret: str):
    """A pandas UDF on (body, signature): equality in constant time; false without a secret, body or signature."""

    @F.pandas_udf("boolean")
    def verify(body: pd.Series, given: pd.Series) -> pd.Series:
        key = secret.encode()
        return pd.Series([bool(secret) and b is not None and g is not None and hmac.compare_digest("sha256=" + hmac.new(key, b.encode(), hashlib.sha256).hexdigest(), g) for b, g in zip(body, given, strict=True)])

    return verify


@F.pandas_udf(StringType())
def name_uuid(name: pd.Series) -> pd.Series:
    """The UUID, version 5, of a name in the DNS name space."""
    return name.map(lambda n: None if n is None else str(uuid.uuid5(uuid.NAMESPACE_DNS, n)))

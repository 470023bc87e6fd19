"""Codebooks: instructions and a typed schema of the codes."""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annotrail.functions.scalar import shortened

_PLAIN = {"string": T.StringType(), "number": T.DoubleType(), "integer": T.IntegerType(), "boolean": T.BooleanType()}


@dataclass(frozen=True)
class Kind:
    """The type of a code: string, number, integer, boolean, enum, array or object."""

    name: str
    description: str = ""
    values: tuple[str, ...] = ()
    items: Kind | None = None
    fields: tuple[tuple[str, Kind], ...] = ()

    def spark(self) -> T.DataType:
        if self.name == "enum":
            return T.StringType()
        if self.name == "array":
            return T.ArrayType(self.items.spark())
        if self.name == "object":
            return T.StructType([T.StructField(n, k.spark()) for n, k in self.fields])
        return _PLAIN[self.name]

    def checked(self, column: Column) -> Column:
        """The column with values outside an enum set to null, at any depth."""
        if self.name == "enum":
            return F.when(column.isin(list(self.values)), column)
        if self.name == "array":
            return F.transform(column, self.items.checked)
        if self.name == "object":
            return F.when(column.isNotNull(), F.struct(*[k.checked(column[n]).alias(n) for n, k in self.fields]))
        return column

    def json(self) -> dict:
        out = {"type": self.name, "description": self.description}
        if self.values:
            out["values"] = list(self.values)
        if self.items:
            out["items"] = self.items.json()
        if self.fields:
            out["fields"] = {n: k.json() for n, k in self.fields}
        return out


def string(description: str = "") -> Kind:
    return Kind("string", description)


def number(description: str = "") -> Kind:
    return Kind("number", description)


def integer(description: str = "") -> Kind:
    return Kind("integer", description)


def boolean(description: str = "") -> Kind:
    return Kind("boolean", description)


def enum(values: list[str], description: str = "") -> Kind:
    return Kind("enum", description, values=tuple(values))


def array(items: Kind, description: str = "") -> Kind:
    return Kind("array", description, items=items)


def record(**fields: Kind) -> Kind:
    return Kind("object", fields=tuple(fields.items()))


@dataclass(frozen=True)
class Codebook:
    name: str
    instructions: str
    schema: Kind
    role: str | None = None
    input_type: str = "text"
    levels: dict = field(default_factory=dict, hash=False)

    def __post_init__(self):
        if self.input_type not in ("text", "image"):
            raise ValueError("input_type must be text or image")
        if self.schema.name != "object":
            raise ValueError("the schema of a codebook must be a record")

    def prompt(self) -> str:
        """Role and instructions with a blank line between."""
        return "\n\n".join(x for x in (self.role, self.instructions) if x)

    def json(self) -> str:
        return json.dumps({"name": self.name, "instructions": self.instructions, "role": self.role, "input_type": self.input_type, "schema": self.schema.json()}, sort_keys=True)

    def __repr__(self) -> str:
        lines = [f"Codebook: {self.name}", f"  Input type: {self.input_type}"]
        if self.role:
            lines.append(f"  Role: {shortened(self.role)}")
        lines += [f"  Instructions: {shortened(self.instructions)}", f"  Output: {', '.join(n for n, _ in self.schema.fields)}"]
        return "\n".join(lines)


@dataclass(frozen=True)
class Task:
    """The older form of a codebook."""

    name: str
    system_prompt: str
    type_def: Kind
    input_type: str = "text"

    def __repr__(self) -> str:
        return f"Task: {self.name}\n  Input type: {self.input_type}\n  Prompt: {shortened(self.system_prompt)}"


def task(name: str, system_prompt: str, type_def: Kind, input_type: str = "text") -> Task:
    warnings.warn("task() is superseded by Codebook", DeprecationWarning, stacklevel=2)
    return Task(name, system_prompt, type_def, input_type)


def as_codebook(x: Codebook | Task) -> Codebook:
    """A codebook; a task's prompt becomes the instructions and its type the schema."""
    if isinstance(x, Codebook):
        return x
    if isinstance(x, Task):
        return Codebook(x.name, x.system_prompt, x.type_def, input_type=x.input_type)
    raise TypeError("neither a codebook nor a task")


def conform(df: DataFrame, codebook: Codebook, column: str = "codes") -> DataFrame:
    """A struct column's values checked against the codebook."""
    return df.withColumn(column, codebook.schema.checked(F.col(column)))


# The wording of the example codebooks.
SENTIMENT = Codebook(
    "Sentiment analysis",
    "Analyze the sentiment of this text, on both a 1-10 scale and as a polarity of negative or positive.",
    record(
        sentiment=enum(["neg", "pos"], "Overall sentiment polarity: negative (neg) or positive (pos)"),
        rating=integer("Sentiment rating from 1 (most negative) to 10 (most positive)"),
    ),
    "You are a political communication analyst evaluating public statements.",
)
STANCE = Codebook(
    "Stance detection",
    "Classify the stance towards climate change expressed in this text. Choose 'Pro' if the text supports action on climate change, 'Contra' if it opposes action, or 'Neutral' if it takes no clear position. Provide a brief explanation for your classification.",
    record(stance=enum(["Pro", "Neutral", "Contra"], "Stance classification"), explanation=string("Brief explanation of the classification")),
    "You are an expert in political communication and discourse analysis.",
)
IDEOLOGY = Codebook(
    "Ideological scaling",
    "Rate the ideological position of this text on a scale from 0 (far left) to 10 (far right). Consider economic and social policy positions. Provide a brief explanation for your score.",
    record(score=integer("Ideological score from 0 (left) to 10 (right)"), explanation=string("Brief justification for the assigned score")),
    "You are an expert political scientist specializing in ideological analysis.",
)
SALIENCE = Codebook(
    "Issue salience",
    "Identify the primary policy issue discussed in this text and rate its salience (prominence/importance) on a scale from 1 (minor mention) to 5 (central focus). Provide a brief explanation.",
    record(issue=string("Primary policy issue"), salience=integer("Salience score from 1 (minor) to 5 (central)"), explanation=string("Brief explanation")),
    "You are an expert in political communication and issue framing.",
)
FACT = Codebook(
    "Fact-checking",
    "Assess whether the main factual claim in this text is true, false, or unverifiable. Provide a brief explanation with evidence if possible.",
    record(claim=string("The main factual claim"), verdict=enum(["True", "False", "Unverifiable"], "Fact-check verdict"), explanation=string("Brief explanation with evidence")),
    "You are an expert fact-checker with knowledge of current events and reliable sources.",
)

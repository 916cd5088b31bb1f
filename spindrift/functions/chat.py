"""Columns of chat messages: final responses, embedded tool calls, malformed output, stream lines."""

from __future__ import annotations

import ast
import math
import operator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Marks in models' output.
BEGIN, END = "[BEGIN FINAL RESPONSE]", "[END FINAL RESPONSE]"
CALLS_OPEN, CALLS_CLOSE = "<tool_calls>", "</tool_calls>"
MALFORMED = (r"<\|start\|>assistant<\|channel\|>", r"(?s)<\|start\|>.*?<\|message\|>", r"(?U)to=functions\.\w+")
CALL_TYPE = "array<struct<name:string,arguments:string>>"


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"


def final_response(text: Column) -> Column:
    """What stands between the marks of a final response, tool calls taken out and trimmed; the whole text without marks."""
    inside = F.regexp_extract(text, rf"(?s){_quoted(BEGIN)}(.*?){_quoted(END)}", 1)
    body = F.when(text.contains(BEGIN) & text.contains(END), inside).otherwise(text)
    return F.trim(F.regexp_replace(F.regexp_replace(body, rf"(?s){_quoted(CALLS_OPEN)}.*?{_quoted(CALLS_CLOSE)}", ""), r"^\s+|\s+$", ""))


def embedded_calls(text: Column) -> Column:
    """(id, name, arguments) of tool calls written into a text as a JSON array; empty where there are none that parse."""
    body = F.regexp_extract(text, rf"(?s){_quoted(CALLS_OPEN)}(.*?){_quoted(CALLS_CLOSE)}", 1)
    calls = F.coalesce(F.from_json(body, CALL_TYPE), F.array().cast(CALL_TYPE))
    return F.transform(calls, lambda c, i: F.struct(F.concat(F.lit("call_"), i.cast("string")).alias("id"), c["name"].alias("name"), c["arguments"].alias("arguments")))


def malformed(text: Column) -> Column:
    out = F.lit(False)
    for pattern in MALFORMED:
        out |= text.rlike(pattern)
    return out


_MESSAGE = "struct<role:string,content:string,tool_calls:array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>>"


def message(response: Column) -> Column:
    """The message of a backend's JSON, in the shape with choices or the plain one."""
    whole = F.from_json(response, f"struct<choices:array<struct<message:{_MESSAGE}>>,message:{_MESSAGE}>")
    return F.coalesce(F.try_element_at(whole["choices"], F.lit(1))["message"], whole["message"])


def stream_delta(line: Column) -> Column:
    """Text that a line of a streamed answer adds, in either backend's shape; null for other lines and for the end."""
    body = F.regexp_replace(line, r"^data: ", "")
    parsed = F.from_json(body, "struct<choices:array<struct<delta:struct<content:string>>>,message:struct<content:string>,done:boolean>")
    return F.when(F.trim(body) != "[DONE]", F.coalesce(F.try_element_at(parsed["choices"], F.lit(1))["delta"]["content"], parsed["message"]["content"]))


def _line(content: Column | None, finish: Column, chunk: str, model: str, created: Column) -> Column:
    delta = F.struct(content.alias("content")) if content is not None else F.lit(None).cast("struct<content:string>")
    choice = F.struct(F.lit(0).alias("index"), delta.alias("delta"), finish.alias("finish_reason"))
    head = F.struct(F.lit(chunk).alias("id"), F.lit("chat.completion.chunk").alias("object"), created.alias("created"), F.lit(model).alias("model"), F.array(choice).alias("choices"))
    body = F.to_json(head, {"ignoreNullFields": "false"})
    return F.concat(F.lit("data: "), body if content is not None else F.replace(body, F.lit('"delta":null'), F.lit('"delta":{}')), F.lit("\n\n"))


#: The last line of a stream.
DONE = "data: [DONE]\n\n"


def stream_chunk(content: Column, created: Column, model: str = "local", chunk: str = "chatcmpl") -> Column:
    """A line of streamed output."""
    return _line(content, F.lit(None).cast("string"), chunk, model, created)


def stream_lines(pieces: Column, created: Column, error: Column | None = None, model: str = "local", chunk: str = "chatcmpl") -> Column:
    """All lines of a streamed answer: one for each piece of text that is not empty, one that says why it ended, and the last.
    With an error, its text comes in the line that ends it."""
    own = F.transform(F.filter(pieces, lambda p: p != ""), lambda p: stream_chunk(p, created, model, chunk))
    stop = _line(None, F.lit("stop"), chunk, model, created)
    if error is not None:
        stop = F.when(error.isNotNull(), _line(error, F.lit("error"), chunk, model, created)).otherwise(stop)
    return F.concat(own, F.array(stop, F.lit(DONE)))


def tool_definition(name: Column, description: Column, parameters: Column) -> Column:
    """A tool as a backend wants it; ``parameters`` is a JSON text."""
    head = F.to_json(F.struct(name.alias("name"), description.alias("description")))
    return F.concat(F.lit('{"type":"function","function":'), F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"parameters":'), parameters, F.lit("}}"))


def request_error(messages: Column) -> Column:
    """Why a request's JSON array of messages is not valid; null where it is."""
    parsed = F.from_json(messages, "array<struct<role:string,content:string>>")
    return F.when(messages.isNull(), "messages is required").when(~F.trim(messages).startswith("[") | parsed.isNull(), "messages must be a list").when(F.size(parsed) == 0, "messages must not be empty")


_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.Pow: operator.pow}
#: A power's exponent at most: larger ones take a worker's time and memory.
MOST_EXPONENT = 10_000


def evaluate(expression: str | None) -> str:
    """Value of an arithmetic expression, or why there is none; no names, calls or other values than numbers."""

    def value(node: ast.AST):
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            return node.value
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            a, b = value(node.left), value(node.right)
            if isinstance(node.op, ast.Pow) and abs(b) > MOST_EXPONENT:
                raise ValueError("exponent too large")
            return _BINARY[type(node.op)](a, b)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -value(node.operand)
        raise ValueError("unsupported expression")

    try:
        out = value(ast.parse(expression or "", mode="eval").body)
        if isinstance(out, float) and math.isfinite(out) and out == int(out):
            out = int(out)
        return str(out)
    except ZeroDivisionError:
        return "Error: division by zero"
    except (ValueError, SyntaxError, TypeError, OverflowError, RecursionError, MemoryError) as e:
        return f"Error: {e if isinstance(e, ValueError) else 'invalid expression'}"



@F.arrow_udf(StringType())
def calculate(expressions: pa.Array) -> pa.Array:
    return pa.array([evaluate(e) for e in expressions.to_pylist()], pa.string())

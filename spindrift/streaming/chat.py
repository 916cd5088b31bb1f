"""Chat streams and tool loops: marker filter across micro-batches, bounded tool loop for each conversation."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spindrift.functions.chat import BEGIN, END


class MarkerFilter:
    """Passes the text between the marks on as it comes: nothing before the first, all but what may be the start of the last."""

    def __init__(self, held: str = "", stage: int = 0) -> None:
        self.held, self.stage = held, stage  # 0 before, 1 within, 2 after

    def push(self, piece: str) -> str:
        self.held += piece
        if self.stage == 0 and (at := self.held.find(BEGIN)) >= 0:
            self.held, self.stage = self.held[at + len(BEGIN) :], 1
        if self.stage == 0:
            return ""
        if self.stage == 2:
            self.held = ""
            return ""
        if (at := self.held.find(END)) >= 0:
            out, self.held, self.stage = self.held[:at], "", 2
            return out
        keep = len(END) - 1
        out, self.held = self.held[:-keep], self.held[-keep:]
        return out

    def finish(self) -> str:
        """What is left when a stream ends: all of it where there were no marks."""
        out, self.held = ("" if self.stage == 2 else self.held), ""
        return out


def filter_markers(stream: DataFrame, idle_ms: int = 3_600_000) -> DataFrame:
    """(conv_id, text) of a stream of pieces (conv_id, seq, piece, last): state is one buffer for each conversation, which
    ends with its last piece, or when none has come for ``idle_ms``."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = MarkerFilter(*state.get) if state.exists else MarkerFilter()
        if state.hasTimedOut:  # nothing came for long: what is held is the end
            state.remove()
            yield pd.DataFrame({"conv_id": [key[0]], "text": [own.finish()]})
            return
        rows = pd.concat(parts).sort_values("seq")
        out = "".join(own.push(p or "") for p in rows["piece"])
        if rows["last"].any():
            out += own.finish()
            state.remove()
        else:
            state.update((own.held, own.stage))
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"conv_id": [key[0]], "text": [out]})

    return stream.groupBy("conv_id").applyInPandasWithState(run, "conv_id long, text string", "held string, stage int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def filter_markers_batch(pieces: DataFrame) -> DataFrame:
    """The same over a table; a conversation's pieces come in order and are not gathered."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, own, out = None, MarkerFilter(), []
        for part in parts:
            done: list[tuple[int, str]] = []
            for conv, piece in zip(part["conv_id"], part["piece"], strict=True):
                if conv != at:
                    if at is not None:
                        done.append((at, "".join(out) + own.finish()))
                    at, own, out = conv, MarkerFilter(), []
                out.append(own.push(piece or ""))
            yield pd.DataFrame(done, columns=["conv_id", "text"])
        if at is not None:
            yield pd.DataFrame([(at, "".join(out) + own.finish())], columns=["conv_id", "text"])

    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "seq").select("conv_id", "piece").mapInPandas(run, "conv_id long, text string")


Backend = Callable[[list[dict], str], dict]
NUDGE = "Use one of the tools to answer."
FALLBACK = "I could not produce a response."


def run_tool(tools: dict[str, Callable], name: str, arguments) -> tuple[str, float]:
    """A tool's answer and its seconds; errors are answers."""
    began = time.monotonic()
    if name not in tools:
        return f"Tool '{name}' not found. Available: {', '.join(sorted(tools))}", 0.0
    try:
        own = json.loads(arguments) if isinstance(arguments, str) else arguments or {}
        return str(tools[name](**own)), time.monotonic() - began
    except Exception as e:  # a tool may raise anything, and the model is to read it
        return f"Error: {e}", time.monotonic() - began


def tool_loop(messages: list[dict], backend: Backend, tools: dict[str, Callable], system: str = "", rounds: int = 5, seconds: float = 120, required: bool = False, bad: Callable[[str], bool] = lambda _: False) -> tuple[str, list[str]]:
    """(answer, tools used): asks, runs the tools asked for and asks again, in bounded rounds and time; a required tool is
    asked for once more; a malformed answer is asked for twice at most."""
    talk = [{"role": "system", "content": system}] * bool(system) + list(messages)
    used: list[str] = []
    end, nudged = time.monotonic() + seconds, False
    for _ in range(rounds):
        if time.monotonic() > end:
            break
        answer = backend(talk, "required" if required and not used else "auto")
        calls = answer.get("tool_calls") or []
        if not calls:
            if required and not used and not nudged:
                nudged = True
                talk.append({"role": "user", "content": NUDGE})
                continue
            if answer.get("content") and not bad(answer["content"]):
                return answer["content"], used
            break
        talk.append({"role": "assistant", "content": answer.get("content") or "", "tool_calls": calls})
        for call in calls:
            name = call["function"]["name"]
            used.append(name)
            talk.append({"role": "tool", "tool_call_id": call.get("id", ""), "content": run_tool(tools, name, call["function"].get("arguments"))[0]})
    for _ in range(2):
        answer = backend(talk, "none").get("content") or ""
        if answer and not bad(answer):
            return answer, used
        talk.append({"role": "user", "content": "Answer in plain text only."})
    return FALLBACK, used


def run_tool_loops(chats: DataFrame, backend: Backend, tools: dict[str, Callable], **how) -> DataFrame:
    """(conv_id, answer, tools_used) for chats (conv_id, messages: array of role and content)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [tool_loop([dict(m.asDict() if hasattr(m, "asDict") else m) for m in ms], backend, tools, **how) for ms in part["messages"]]
            yield pd.DataFrame({"conv_id": part["conv_id"], "answer": [a for a, _ in found], "tools_used": [u for _, u in found]})

    return chats.select("conv_id", "messages").mapInPandas(run, "conv_id long, answer string, tools_used array<string>")


def transcripts(turns: DataFrame) -> DataFrame:
    """(conv_id, messages, n_turns) with messages in order."""
    listed = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy("conv_id").agg(F.transform(listed, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"), F.count("*").alias("n_turns"))

"""A line's tools at a moment, and a loop that lets a language model use them.

The model is passed in; nothing here needs a network.  A tool never raises: an error is data that the
model sees.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.operators import retrieval, tools

MOST_TURNS = 8


class LanguageModel(Protocol):
    def turn(self, messages: list[dict]) -> dict:
        """Either {"tool": name, "input": {...}} or {"answer": text}."""


#: What each tool tells, for the model that may call it.
DESCRIPTIONS = {
    "line_status": "Services seen on a line in the last half hour, how many of them are late, the largest delay, and the alerts now in the feed.",
    "disruption_risk": "The detector's probability that the line is disrupted in the next half hour, from its last whole window; an estimate, not an observation.",
    "predict_delays": "The line's running services with their next call and the delay expected there; an estimate.",
    "similar_past_incidents": "Past incidents most like what the line shows now, with the alert ids to cite; only those first seen before now.",
}


def tool_schemas(lines: list[str]) -> list[dict]:
    """The tools as a model is offered them: each takes one line, of those there are, and nothing else."""
    given = {"type": "object", "properties": {"line": {"type": "string", "enum": list(lines)}}, "required": ["line"], "additionalProperties": False}
    return [{"name": name, "description": text, "strict": True, "input_schema": given} for name, text in DESCRIPTIONS.items()]


@dataclass
class ToolBox:
    """What was known strictly before ``at``; frames are filtered by it on every call."""

    at: Any
    lines: list[str]
    events: DataFrame
    alerts: DataFrame | None = None
    calls: DataFrame | None = None
    index: DataFrame | None = None
    table: DataFrame | None = None
    score: Callable[[DataFrame], DataFrame] | None = None
    late_s: float = 300
    window_s: int = 900
    embedder: Callable = retrieval.hashing_embedder

    def _at(self):
        return F.lit(self.at).cast("timestamp")

    def _rows(self, df: DataFrame) -> list[dict]:
        return [r.asDict(recursive=True) for r in df.collect()]  # a few rows of one line

    def line_status(self, line: str) -> dict:
        own = self.events.filter(F.col("line") == line)
        alerts = []
        if self.alerts is not None:
            live = self.alerts.filter((F.col("first_seen") < self._at()) & (F.col("last_seen") >= self._at() - F.expr("INTERVAL 35 MINUTES")) & F.array_contains("lines", line))
            alerts = self._rows(live.select("alert_id", "header_text").orderBy("first_seen", "alert_id").limit(20))
        return {"line": line, "status": self._rows(tools.situation(own, self._at(), self.late_s)), "alerts": alerts}

    def disruption_risk(self, line: str) -> dict:
        if self.table is None or self.score is None:
            raise ValueError("no detector: pass the detection table and a scorer")
        return {"line": line, "risk": self._rows(tools.risk(self.table, line, self._at(), self.window_s, self.score).select("window_start", "score", "flag"))}

    def predict_delays(self, line: str) -> dict:
        if self.calls is None:
            raise ValueError("no timetable: pass the calls")
        live = tools.running(self.events.filter(F.col("line") == line), self._at())
        out = tools.expected_delays(live, self.calls)
        return {"line": line, "trains": self._rows(out.select("trip_id", "stop_id", "next_stop_id", "expected_delay_s"))}

    def similar_past_incidents(self, line: str, k: int = 5) -> dict:
        if self.index is None:
            raise ValueError("no index: build one and pass it")
        status = self.line_status(line)
        text = " ".join([line, *(a["header_text"] or "" for a in status["alerts"])])
        seconds = int(self.events.sparkSession.range(1).select(F.unix_seconds(self._at())).first()[0])
        found = retrieval.top_k(self.index, self.embedder([text])[0], k, where=retrieval.guards(seen_before=seconds))
        return {"line": line, "incidents": self._rows(found.select("id", "text", "score", "rank"))}

    TOOLS = tuple(DESCRIPTIONS)

    def call(self, name: str, given: dict) -> tuple[str, bool]:
        """The tool's result as JSON, and whether it is an error."""
        try:
            if name not in self.TOOLS:
                raise ValueError(f"no tool {name}; there are {', '.join(self.TOOLS)}")
            if (line := given.get("line")) not in self.lines:
                raise ValueError(f"no line {line}; there are {', '.join(self.lines)}")
            return json.dumps(getattr(self, name)(line), default=str), False
        except Exception as e:  # noqa: BLE001  the model is told
            return json.dumps({"error": str(e)}), True


@dataclass
class Transcript:
    question: str
    as_of: str
    steps: list[dict] = field(default_factory=list)
    answer: str | None = None
    stop_reason: str = ""


def ask(question: str, box: ToolBox, model: LanguageModel, most_turns: int = MOST_TURNS) -> Transcript:
    """Lets the model call tools until it answers, or has had its turns."""
    done = Transcript(question, str(box.at))
    messages = [{"role": "user", "content": question}]
    for _ in range(most_turns):
        said = model.turn(messages)
        if "answer" in said:
            done.answer, done.stop_reason = said["answer"], "answered"
            return done
        output, failed = box.call(said.get("tool", ""), said.get("input") or {})
        done.steps.append({"tool": said.get("tool"), "input": said.get("input"), "output": output, "is_error": failed})
        messages += [{"role": "assistant", "content": json.dumps(said)}, {"role": "tool", "content": output}]
    done.stop_reason = "out of turns"
    return done
